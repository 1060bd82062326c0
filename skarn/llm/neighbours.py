"""Approximate nearest neighbours by collision counting.

Vectors are dealt into blocks of about BLOCK rows. A block keeps, for each of PROJECTIONS random
projections, its vectors in projection order. A query opens a window of half width r around its own
projection in every array; a vector inside collides there. Vectors that collide often enough are
verified by their exact distance. Windows widen by a fixed ratio (virtual rehashing: the arrays stay,
only the added ends are counted) until the k-th verified distance is no larger than r, as closer
vectors then have passed the threshold with high probability, or until the windows hold all.

A task holds one block of vectors, whose arrays it builds once, and AT_ONCE of the queries that stream
past it, whatever the number of either. Each query meets each block, so with a query set that grows
with the table what is moved grows with queries times blocks. Recall against brute force is measured in the tests and stands in the README.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PROJECTIONS, BLOCK = 128, 16_384
#: Queries of a block that are counted at once.
AT_ONCE = 512
RATIO, START = 1.15, 0.5
#: A vector at distance r collides in this share of projections; the threshold lies DEVIATIONS below it.
SHARE, DEVIATIONS = 0.6826894921370859, 1.2


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part: not null, not zero, every component finite."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return own.where(fine)


class Arrays:
    """A block of vectors with, for each projection, its vectors in projection order; built once for all queries that meet it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 17):
        self.ids, self.x = ids, x
        self.a = np.random.default_rng(seed).normal(size=(x.shape[1], PROJECTIONS))
        px = (x @ self.a).T
        self.order = np.argsort(px, 1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(px, self.order, 1)
        # The first radius is small beside the data's spread; widening reaches any scale in few steps
        self.radius = START * (float(np.linalg.norm(x - x.mean(0), axis=1).mean()) or 1.0)

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """Per query: its k nearest verified vectors of this block (vec_id other than its own), as query, vec_id, distance."""
        ids, x, order, arrays, n, m = self.ids, self.x, self.order, self.values, len(self.ids), PROJECTIONS
        pq = q @ self.a
        need = int(np.ceil(m * SHARE - DEVIATIONS * np.sqrt(m * SHARE * (1 - SHARE))))
        lo = np.stack([np.searchsorted(arrays[j], pq[:, j], "left") for j in range(m)], 1)
        hi = lo.copy()
        counts = np.zeros((len(q), n), np.int16)
        best_i = [np.zeros(0, np.int64) for _ in q]
        best_d = [np.zeros(0) for _ in q]
        done = np.zeros((len(q), n), bool)
        r = self.radius
        live = np.arange(len(q))
        while len(live):
            left = np.stack([np.searchsorted(arrays[j], pq[live, j] - r, "left") for j in range(m)], 1)
            right = np.stack([np.searchsorted(arrays[j], pq[live, j] + r, "right") for j in range(m)], 1)
            rest = []
            for row, (i, l, h) in enumerate(zip(live.tolist(), left.tolist(), right.tolist())):
                ol, oh = lo[i].tolist(), hi[i].tolist()
                parts = [order[j, l[j] : ol[j]] for j in range(m) if l[j] < ol[j]] + [order[j, oh[j] : h[j]] for j in range(m) if oh[j] < h[j]]
                if parts:
                    counts[i] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
                lo[i], hi[i] = left[row], right[row]
                fresh = np.flatnonzero((counts[i] >= need) & ~done[i])
                if len(fresh):
                    done[i, fresh] = True
                    fresh = fresh[ids[fresh] != q_ids[i]]
                    dist = np.sqrt(((x[fresh] - q[i]) ** 2).sum(1))
                    ai, ad = np.concatenate([best_i[i], ids[fresh]]), np.concatenate([best_d[i], dist])
                    keep = np.lexsort((ai, ad))[:k]
                    best_i[i], best_d[i] = ai[keep], ad[keep]
                full = len(best_d[i]) == k and best_d[i][-1] <= r
                if not full and not (right[row] - left[row] == n).all():
                    rest.append(i)
            live = np.array(rest, np.int64)
            r *= RATIO
        return [(int(q_ids[i]), int(v), float(s)) for i in range(len(q)) for v, s in zip(best_i[i], best_d[i])]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query, ties to the smaller vec_id.

    vectors and queries: vec_id, embedding. Rows whose vector is null, zero, or holds a null or a
    non-finite component take no part. Of rows that repeat a vec_id, one (the smallest vector)
    stands for it; a query never finds its own vec_id. With fewer candidates, all are returned.
    Vectors of another length than a query's are no candidates of it. An empty side gives no rows.
    """
    one = lambda df: usable(df).groupBy("vec_id").agg(F.min("v").alias("v"))
    base, asked = one(vectors), one(queries)
    parts = max(1, -(-base.count() // block))
    # Blocks of vectors are enough tasks on large tables; on small ones, queries are dealt as well
    q_parts = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // parts))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select(deal(parts, 1).alias("part"), F.size("v").alias("dims"), F.lit(False).alias("asks"), "vec_id", "v").withColumn("q_part", every(q_parts))
    right = asked.select(deal(q_parts, 2).alias("q_part"), F.size("v").alias("dims"), F.lit(True).alias("asks"), "vec_id", "v").withColumn("part", every(parts))
    keys = ["part", "q_part", "dims"]

    def run(batches):
        """Of each block its vectors come first; their arrays are built once, and the block's queries stream past them."""
        group, held, arrays = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], 1)
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist()):
                *own, asks = key[lo].tolist()
                ids, v = batch.column(4).slice(lo, hi - lo).to_numpy(), batch.column(5).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
                if own != group:
                    group, held, arrays = own, [], None
                if not asks:
                    held.append((ids, v))
                elif held or arrays is not None:
                    if arrays is None:
                        arrays, held = Arrays(*(np.concatenate(x) for x in zip(*held))), []
                    for i in range(0, len(ids), AT_ONCE):
                        if rows := arrays.nearest(ids[i : i + AT_ONCE], v[i : i + AT_ONCE], k):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    both = left.select(*keys, "asks", "vec_id", "v").unionByName(right.select(*keys, "asks", "vec_id", "v"))
    found = both.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op9_neighbours": op9_neighbours}
