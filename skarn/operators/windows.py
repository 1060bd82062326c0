"""Ranking, keep-first, latest-row and set operators built on windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import running


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, by, order, 1, "_first").drop("_first")


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[str], desc: bool = True) -> DataFrame:
    """The row of each group that has the largest (or smallest) order columns; partial aggregation, no sort of groups."""
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by if desc else F.min_by
    return df.groupBy(*by).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new replace those of old by key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def add_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose key old lacks are added; none is overridden."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def unique_ids(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The second and later rows of a key get #2, #3."""
    return running(df, order, [key], name="_n").withColumn(key, F.when(F.col("_n") > 1, F.concat(F.col(key).cast("string"), F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(key).cast("string"))).drop("_n")


def min_max(x: Column, over: Window | None = None) -> Column:
    """Scaled to 0..1; all equal gives 1."""
    w = over or Window.partitionBy()
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi == lo, 1.0).otherwise((x - lo) / (hi - lo))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page and next_offset (null on the last page), by one look-ahead row."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    more = rows.count() > limit
    return rows.limit(limit).withColumn("next_offset", F.lit(offset + limit if more else None).cast("long"))
