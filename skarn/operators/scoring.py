"""Votes, candidate aggregation, run comparison, folds and alignment."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import running


def candidates(hits: DataFrame, query: str, group: str, score: str, bonus: float = 0.02, most: int = 3, top: int = 3) -> DataFrame:
    """Per query and group the best score plus a bonus for further hits (up to `most`), ranked, with the margin to the next."""
    agg = hits.groupBy(query, group).agg(F.max(score).alias("best"), F.count("*").alias("hits"))
    total = F.round(F.col("best") + bonus * F.least(F.lit(most), F.col("hits") - 1), 6)
    w = Window.partitionBy(query).orderBy(F.desc("total"), group)
    own = agg.withColumn("total", total).withColumn("rank", F.row_number().over(w)).withColumn("margin", F.round(F.col("total") - F.coalesce(F.lead("total").over(w), F.lit(0.0)), 6))
    return own.where(F.col("rank") <= top)


def votes(ballots: DataFrame, item: str, choice: str, weight: str, order: str) -> DataFrame:
    """The choice with the largest weight (ties to the smallest order) and the runner-up."""
    sums = ballots.groupBy(item, choice).agg(F.round(F.sum(weight), 6).alias("w"), F.min(order).alias("o"))
    ranked = sums.groupBy(item).agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("n"), "o", choice))).alias("r"))
    return ranked.select(item, F.col("r")[0][choice].alias("primary"), F.try_element_at("r", F.lit(2))[choice].alias("secondary"))


def student_p(t: float, df: int) -> float:
    """Two-sided p value of Student's t with a whole number of degrees of freedom, by its finite series in the angle atan(t / sqrt(df))."""
    theta = math.atan(abs(t) / math.sqrt(df))
    cos, sin = math.cos(theta), math.sin(theta)
    term, total = (cos, 0.0) if df % 2 else (1.0, 0.0)
    for k in range(df // 2):
        total += term
        term *= cos * cos * ((2 * k + 2) / (2 * k + 3) if df % 2 else (2 * k + 1) / (2 * k + 2))
    inside = 2 / math.pi * (theta + sin * total) if df % 2 else sin * total
    return min(1.0, max(0.0, 1 - inside))


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Paired comparison of two runs' scores: number, mean difference, t statistic and the two-sided p value of Student's t with n - 1 degrees of freedom.

    With fewer than two pairs t and p are null; without any spread t is 0 and p is 1.
    """
    d = a.join(b.withColumnRenamed(value, "_b"), key).select((F.col(value) - F.col("_b")).alias("d"))
    sums = d.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.when(F.col("n") > 1, F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).otherwise(0.0))

    def run(batches):  # one row
        for b in batches:
            p = [None if x is None else student_p(x, n - 1) for n, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p, pa.float64())], names=["n", "m", "t", "p"])

    full = sums.select("n", "m", t.alias("t")).mapInArrow(run, "n long, m double, t double, p double")
    return full.select("n", F.round("m", 6).alias("mean_diff"), F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


def folds(rows: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """Fold 0..k-1 of each row, even within every stratum, in an order fixed by the key's hash."""
    own = rows.withColumn("_h", F.sha1(F.col(key).cast("string")))
    return running(own, ["_h", key], [stratum], name="fold").withColumn("fold", ((F.col("fold") - 1) % k).cast("int")).drop("_h")


def composite(rows: DataFrame, parts: Sequence[tuple[Column, float]], order: str) -> DataFrame:
    """Weighted sum of the parts, ranked."""
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + weight * value
    own = rows.withColumn("score", F.round(total, 6))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), order)))


def alignment(text: Column, quote: Column) -> tuple[Column, Column]:
    """How often the quote stands in the text, and whether that is unmatched, matched or ambiguous."""
    n = ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")
    return n, F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous")


def contiguous_prefix(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Whether the positions of each key are 1..n without a gap, and n."""
    return rows.groupBy(key).agg(F.countDistinct(position).alias("n"), F.max(position).alias("top")).select(key, "n", (F.col("n") == F.col("top")).alias("is_prefix"))


def presence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column the share of rows with a non-blank value."""
    shares = [F.struct(F.lit(c).alias("field"), F.round(F.avg((F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).cast("double")), 6).alias("rate")) for c in columns]
    return df.agg(F.array(*shares).alias("x")).select(F.explode("x").alias("x")).select("x.*")
