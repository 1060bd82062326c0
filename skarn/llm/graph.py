"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of one contraction task.
BLOCK = 250_000


def _contract(e: DataFrame, parts: int) -> DataFrame:
    """Each task joins what its own edges connect and returns its stars; a task holds about BLOCK edges."""

    def run(batches):
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = find(u), find(v)
                if p != q:
                    up[max(p, q)] = min(p, q)
        stars = [(x, r) for x in list(up) if (r := find(x)) != x]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars)], names=["u", "v"])

    return e.coalesce(parts).mapInArrow(run, "u long, v long")


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b); loops and repeats are fine.

    A round contracts blocks of edges and then takes one large-star and one small-star step, which
    only group and join on nodes; it ends when the steps change nothing. Rounds are written to the
    shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.stage(e, "edges")
    count = _mark(e)[0]
    while count:
        e = common.stage(_contract(e, -(-count // BLOCK)), "edges")
        seen = _mark(e)
        e = common.stage(_small(_large(e)), "edges")
        now = _mark(e)
        if now == seen:
            break
        count = now[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
