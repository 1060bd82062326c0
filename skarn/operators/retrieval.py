"""Lexical, dense and fused retrieval over whole tables of queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import saved
from .text import term_counts
from .windows import ranked, top_k

K1, B = 1.5, 0.75


#: Stands for a document itself among its tokens; no token holds a blank.
ITSELF = " "
BROADCAST_TERMS = 200_000
#: Postings of one task that adds up scores, and the query terms that they meet there: no task holds more sums.
POSTINGS, MET = 250_000, 2_000_000


def postings(docs: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """docid, dl, t, tf of the wanted terms (term, t), and one posting for each document under ITSELF, written once.

    A text's terms are counted inside its row, so neither tokens nor counts are shuffled while the
    wanted terms, if they are few, go to every task; many are joined by a shuffle. Of few terms t is a number,
    and a document's postings stay in one row with arrays t and tf (in two, if Arrow batches cut it): a row for
    each posting would make a task that deals out its split hold six times as much (436 against 68 MB at 1 GB).
    """
    held = term_counts(docs, "docid", "text", ITSELF).join(F.broadcast(wanted) if few else wanted, "term").select("docid", "dl", "t", "tf")

    def pack(batches):
        for b in batches:
            if b.num_rows:
                ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
                starts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(sizes) != 0)) + 1])
                ends = pa.array(np.append(starts, b.num_rows), pa.int32())
                cols = [pa.array(ids[starts]), pa.array(sizes[starts]), *(pa.ListArray.from_arrays(ends, b.column(i)) for i in (2, 3))]
                yield pa.RecordBatch.from_arrays(cols, names=["docid", "dl", "t", "tf"])

    return saved(held.mapInArrow(pack, "docid long, dl int, t array<int>, tf array<int>") if few else held)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Qid, docid, score for every pair that shares a token. docs: docid, text; queries: qid, text.

    A query's repeated token counts again. Null texts have no tokens and count as no documents.
    """
    terms = saved(term_counts(queries, "qid", "text").groupBy("qid", "term").agg(F.sum("tf").alias("qtf")))
    few = terms.count() <= BROADCAST_TERMS
    wanted = terms.select("term").unionByName(terms.sparkSession.createDataFrame([(ITSELF,)], "term string")).distinct()
    # Few are numbered from 0 by one task, which sees at most BROADCAST_TERMS rows
    wanted = saved(wanted.withColumn("t", F.row_number().over(Window.orderBy(F.col("term") != ITSELF, "term")) - 1)) if few else wanted.withColumn("t", F.col("term"))
    itself = 0 if few else ITSELF
    posted = postings(docs, wanted, few)
    unpacked = lambda rows: rows.select("docid", "dl", F.inline(F.arrays_zip("t", "tf"))) if few else rows
    # One row of totals, so its broadcast has a fixed size
    stats = unpacked(posted).where(F.col("t") == itself).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = unpacked(posted).where(F.col("t") != itself).groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = saved(terms.join(wanted, "term").join(df, "t").join(F.broadcast(stats)).select("qid", "t", (idf * F.col("qtf")).alias("w"), "avgdl", "df"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # Few query terms meet the postings where a document's lie together: the sums need no further shuffle.
    # A task's sums are those of its documents, so the number of tasks grows with the postings and what they meet
    if few:
        held, meets = weighed.select("t", "df").distinct().agg(F.sum("df")).first()[0] or 0, weighed.agg(F.sum("df")).first()[0] or 0
        tasks = max(12, -(-held // POSTINGS), -(-meets // MET))
        met = unpacked(posted.repartition(tasks, "docid")).join(F.broadcast(weighed.drop("df")), "t")
    else:
        met = posted.where(F.col("t") != itself).join(weighed.drop("df"), "t")
    return met.groupBy("qid", "docid").agg(F.sum(part).alias("score"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, **kw) -> DataFrame:
    """The k best of each query, scores to six places, ties to the smaller docid."""
    scored = bm25(docs, queries, **kw).withColumn("score", F.round("score", 6))
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("docid")], k)


def knn_cosine(base: DataFrame, queries: DataFrame, k: int, block: int = 8192, query_block: int = 512) -> DataFrame:
    """V01, exact: qid, docid, score, rank. base: docid, v; queries: qid, v. Zero vectors take no part.

    Both sides are dealt into blocks of bounded size; each pair of blocks is one matrix product that
    gives its own best k of each query, and those meet in a window of k rows for each block.
    """
    n, m = max(1, -(-base.count() // block)), max(1, -(-queries.count() // query_block))
    deal = lambda c, p: F.pmod(F.xxhash64(c), F.lit(p)).cast("int")
    left = base.select(F.col("docid").alias("id"), F.col("v").cast("array<double>").alias("v"), deal("docid", n).alias("p")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = queries.select(F.col("qid").alias("id"), F.col("v").cast("array<double>").alias("v"), deal("qid", m).alias("q")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def unit(t: pa.Table):
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        norm = np.linalg.norm(x, axis=1)
        keep = norm > 0
        return t.column("id").to_numpy()[keep].astype(np.int64), x[keep] / norm[keep, None]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if a.num_rows and b.num_rows:
            (ids, x), (qs, y) = unit(a), unit(b)
            sim = np.clip(y @ x.T, 0, 1)
            for q, s in zip(qs, sim):
                own = np.lexsort((ids, -np.round(s, 6)))[:k]
                rows += [(int(q), int(ids[i]), float(s[i])) for i in own]
        c = list(zip(*rows)) or [(), (), ()]
        return pa.table({"qid": pa.array(c[0], pa.int64()), "docid": pa.array(c[1], pa.int64()), "score": pa.array(c[2], pa.float64())})

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, "qid long, docid long, score double")
    return top_k(found.withColumn("score", F.round("score", 6)), ["qid"], [F.desc("score"), F.asc("docid")], k)


def rrf(runs: Sequence[tuple[DataFrame, float]], k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of runs (qid, docid, rank), each with a weight."""
    parts = None
    for run, weight in runs:
        one = run.select("qid", "docid", (F.lit(float(weight)) / (k + F.col("rank"))).alias("s"))
        parts = one if parts is None else parts.unionByName(one)
    fused = parts.groupBy("qid", "docid").agg(F.round(F.sum("s"), 8).alias("score"))
    return top_k(fused, ["qid"], [F.desc("score"), F.asc("docid")], top or (1 << 30))


def hybrid(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Both ranked lists side by side, outer on query and document."""
    a = lexical.select("qid", "docid", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    b = dense.select("qid", "docid", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    return a.join(b, ["qid", "docid"], "full_outer")


def merge_segments(hits: DataFrame, k: int, bonus: float = 0.03, cap: float = 0.1) -> DataFrame:
    """Hits (qid, segment, docid, score) of a query's segments: best score for each document, a bonus
    for each further segment, the best of every segment first, then by score."""
    merged = ranked(hits, ["qid", "segment"], [F.desc("score"), F.asc("docid")], "_r").groupBy("qid", "docid").agg(F.max("score").alias("top"), F.countDistinct("segment").alias("segments"), F.max((F.col("_r") == 1).cast("int")).alias("guaranteed"))
    scored = merged.withColumn("score", F.round(F.col("top") + F.least(F.lit(cap), bonus * (F.col("segments") - 1)), 6))
    return top_k(scored, ["qid"], [F.desc("guaranteed"), F.desc("score"), F.asc("docid")], k).select("qid", "docid", "score", "segments", "guaranteed", "rank")


def soft_rerank(hits: DataFrame, boosts: Sequence[tuple[Column, float]], cap: float = 0.20) -> DataFrame:
    """Score * (1 + boost), where boost adds the weight of every condition that holds, up to cap; ranked anew."""
    boost = F.lit(0.0)
    for cond, w in boosts:
        boost = boost + F.when(cond, w).otherwise(0.0)
    out = hits.withColumn("boost", F.least(boost, F.lit(cap))).withColumn("score", F.round(F.col("score") * (1 + F.col("boost")), 6))
    return top_k(out.drop("rank"), ["qid"], [F.desc("score"), F.asc("docid")], 1 << 30)


def to_case(hits: DataFrame) -> DataFrame:
    """The best chunk of each case, ranked."""
    best = hits.groupBy("qid", "case_id").agg(F.max("score").alias("score"))
    return top_k(best, ["qid"], [F.desc("score"), F.asc("case_id")], 1 << 30)


def without_self(run: DataFrame, k: int) -> DataFrame:
    """A query's own document is dropped, the rest ranked anew up to k."""
    own = run.where("docid <> self_doc").drop("rank")
    return top_k(own, ["qid"], [F.desc("score"), F.asc("docid")], k)


def condensed(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Unjudged documents dropped, order kept, ranked anew."""
    return top_k(run.join(qrels.select("qid", "docid"), ["qid", "docid"], "left_semi").withColumnRenamed("rank", "old"), ["qid"], [F.asc("old")], 1 << 30).drop("old")


def round_robin(hits: DataFrame, group: str, k: int) -> DataFrame:
    """Positive scores only; the best of every group, then the second of every group, and so on."""
    w = Window.partitionBy("qid", group).orderBy(F.desc("score"), F.asc("docid"))
    turn = hits.where("score > 0").withColumn("turn", F.row_number().over(w))
    return top_k(turn, ["qid"], [F.asc("turn"), F.desc("score"), F.asc("docid")], k)


def filter_by_score(items: DataFrame, least: float, k: int) -> DataFrame:
    """scores from `least` on; null counts as least - 0.5 and stays; order by score, then the former rank."""
    own = items.where((F.col("score") >= least) | F.col("score").isNull()).withColumn("_s", F.coalesce("score", F.lit(least - 0.5)))
    return top_k(own.withColumnRenamed("rank", "old_rank"), ["qid"], [F.desc("_s"), F.asc("old_rank")], k).drop("_s")


def boosted_rank(hits: DataFrame, matches: Column, weight: float, cap: int, k: int, places: int = 4) -> DataFrame:
    """Similarity plus a weight for each key term found, up to cap terms."""
    out = hits.withColumn("score", F.round(F.col("score") + weight * F.least(matches, F.lit(cap)), places))
    return top_k(out.drop("rank"), ["qid"], [F.desc("score"), F.asc("docid")], k)
