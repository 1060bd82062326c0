"""Skarn: DataFrame-first analytics over time-stamped text records on Apache Spark."""
