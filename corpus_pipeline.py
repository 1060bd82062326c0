"""Five stages over documents, each written as Parquet and read again as the next one's input.

1. toxicity: documents that the boosted trees reject go.
2. near_copies: one document of each group of near copies (five-word shingles, similarity 0.8) stays.
3. decontamination: documents that overlap with a benchmark item go.
4. secrets: secrets in the texts are masked; every document stays.
5. packing: the texts are packed into sequences; one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skarn.llm import common, decontam, jaccard, packing, secret_scan, toxicity


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity.stage_toxicity),
    ("near_copies", jaccard.stage_near_copies),
    ("decontamination", decontam.stage_decontamination),
    ("secrets", secret_scan.stage_secrets),
    ("packing", pack),
]

#: Trained scores and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stage(docs, name)
    return docs
