"""TF-IDF over character n-grams, as sparse rows, and their cosine."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pieces

#: Fixed values of V11: lengths of n-grams and the number of terms.
SHORTEST, LONGEST, TERMS = 2, 4, 3000
#: Terms that a task counts before it hands them on.
HELD = 100_000


def word_grams(text: str, shortest: int = SHORTEST, longest: int = LONGEST) -> Iterable[str]:
    """Character n-grams within words padded by a blank on both sides; a padded word shorter than n counts once, as a whole."""
    for w in text.lower().split():
        w = f" {w} "
        for n in range(shortest, longest + 1):
            if len(w) <= n:
                yield w
                break
            for i in range(len(w) - n + 1):
                yield w[i : i + n]


def gram_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, tf and df over all texts: each task adds up its own texts first, up to HELD terms at a time."""

    def run(batches):
        total, docs = Counter(), Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([docs[k] for k in total], pa.int64())], names=["term", "tf", "df"])
            total.clear()
            docs.clear()
            return out

        for b in pieces(batches):
            for t in b.column(0).to_pylist():
                own = Counter(word_grams(t or ""))
                total.update(own)
                docs.update(own.keys())
            if len(total) > HELD:
                yield flushed()
        if total:
            yield flushed()

    found = df.select(F.col(text).cast("string")).mapInArrow(run, "term string, tf long, df long")
    return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def fit_terms(df: DataFrame, key: str, text: str, most: int = TERMS) -> dict[str, tuple[int, float]]:
    """The `most` terms that occur most often (ties to the smaller term), in their own order, with their place and smooth idf.

    The top rows are taken in two steps, per partition and then overall; `most` rows reach the driver.
    """
    n = df.count()
    top = gram_counts(df, key, text).orderBy(F.desc("tf"), "term").limit(most).collect()
    return {r.term: (i, math.log((1 + n) / (1 + r.df)) + 1) for i, r in enumerate(sorted(top, key=lambda r: r.term))}


def sparse_rows(df: DataFrame, key: str, text: str, terms: dict[str, tuple[int, float]]) -> DataFrame:
    """Key, at (places of terms, ascending) and w (tf * idf, length 1) of each row. Null texts and those without a known term have empty arrays. The terms are bounded by their number and go to every task."""
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        for b in pieces(batches):
            at, weights = [], []
            for t in b.column(1).to_pylist():
                known = sorted((shared.value[g][0], n * shared.value[g][1]) for g, n in Counter(word_grams(t or "")).items() if g in shared.value)
                norm = math.sqrt(math.fsum(w * w for _, w in known))
                at.append([i for i, _ in known])
                weights.append([w / norm for _, w in known])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], names=[key, "at", "w"])

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{key}` long, at array<int>, w array<double>")


def sparse_dot(at: Column, w: Column, at2: Column, w2: Column) -> Column:
    """The product of two sparse rows: places of one that the other has too, by map lookup."""
    other = F.map_from_arrays(at2, w2)
    return F.aggregate(F.zip_with(at, w, lambda i, x: x * F.coalesce(F.try_element_at(other, i), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def joined_features(rows: DataFrame, features: DataFrame, key: str, names: list[str], most: int = TERMS, scale: float = 4.0) -> DataFrame:
    """Sparse rows with dense features (from 0 to 1) behind the terms, times `scale`; zeros are left out."""
    both = rows.join(features.select(key, *names), key)
    dense = F.filter(F.array(*[F.struct(F.lit(most + i).alias("i"), (F.coalesce(F.col(c), F.lit(0.0)) * scale).alias("x")) for i, c in enumerate(names)]), lambda s: s["x"] != 0)
    return both.select(key, F.concat("at", F.transform(dense, lambda s: s["i"])).alias("at"), F.concat("w", F.transform(dense, lambda s: s["x"])).alias("w"))
