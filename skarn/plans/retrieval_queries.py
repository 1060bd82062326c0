"""Retrieval queries: benchmark items search the documents; every 50th vector searches the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import retrieval as R
from ..operators import text as X
from ..operators import windows as W
from ..operators.state import saved
from .base import Registry, read

REGISTRY = Registry()
add = REGISTRY.add

BM25 = """
WITH toks AS (SELECT doc_id AS docid, regexp_extract_all(lower(text), '[A-Za-z0-9가-힣]+') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9가-힣]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT docid, dl, term, count(*) AS tf FROM (SELECT docid, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lex AS (SELECT qid, docid, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY qid, docid),
bm AS (SELECT * FROM (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM lex) WHERE rank <= {k})
"""
#: A second ranking over all documents, by shared rare characters of their hash embeddings: what the fusion queries fuse with.
DENSE = """, hb AS (SELECT i AS id, q, list_transform(range(0, 16), lambda b: len(list_filter(t, lambda x: CAST('0x' || substr(sha1(x), 1, 2) AS INT) % 16 = b))::DOUBLE) AS v FROM (SELECT doc_id AS i, false AS q, regexp_extract_all(lower(text), '[a-z0-9가-힣]+') AS t FROM documents UNION ALL SELECT item_id, true, regexp_extract_all(lower(text), '[a-z0-9가-힣]+') FROM benchmark)),
hn AS (SELECT id, q, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS v FROM hb WHERE list_dot_product(v, v) > 0),
dn AS (SELECT * FROM (SELECT a.id AS qid, b.id AS docid, round(least(1.0, greatest(0.0, list_cosine_similarity(a.v, b.v))), 6) AS score, CAST(row_number() OVER (PARTITION BY a.id ORDER BY round(least(1.0, greatest(0.0, list_cosine_similarity(a.v, b.v))), 6) DESC, b.id) AS INT) AS rank FROM hn a JOIN hn b ON a.q AND NOT b.q) WHERE rank <= {k})
"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("docid"), "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    return R.bm25_top_k(_docs(spark, d), _items(spark, d), k)


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k nearest documents of each item by hash embeddings."""
    base = saved(X.hash_embedding(_docs(spark, d), "docid", "text").withColumnRenamed("embedding", "v"))
    asked = saved(X.hash_embedding(_items(spark, d), "qid", "text").withColumnRenamed("embedding", "v"))
    return R.knn_cosine(base, asked, k).select("qid", "docid", "score", "rank")


@add(BM25.format(k=10) + "SELECT qid, docid, score, rank FROM bm")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).select("qid", "docid", "score", "rank")


@add("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, b.vec_id AS docid, round(greatest(0, least(1, list_cosine_similarity(q.e, b.e))), 6) AS score FROM v q, v b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id)
SELECT * FROM (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM s) WHERE rank <= 10
""")
def knn_cosine_topk(spark, d):
    base = read(spark, d, "embeddings").select(F.col("vec_id").alias("docid"), F.col("embedding").alias("v"))
    hits = R.knn_cosine(base, base.where("docid % 50 = 0").withColumnRenamed("docid", "qid"), 11).where("qid <> docid").drop("rank")
    return W.top_k(hits, ["qid"], [F.desc("score"), F.asc("docid")], 10).select("qid", "docid", "score", "rank")


RRF = BM25.format(k=50) + DENSE.format(k=50) + """, f AS (SELECT qid, docid, round(sum(s), 8) AS score FROM (
  SELECT qid, docid, {a} / (60 + rank) AS s FROM bm UNION ALL SELECT qid, docid, {b} / (60 + rank) AS s FROM dn) GROUP BY ALL)
SELECT * FROM (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM f) WHERE rank <= 10"""


@add(RRF.format(a="CAST(1 AS DOUBLE)", b="CAST(1 AS DOUBLE)"))
def hybrid_rrf(spark, d):
    run = _bm25(spark, d, 50)
    return R.rrf([(run, 1.0), (_dense(spark, d, 50), 1.0)], top=10)


@add(RRF.format(a="CAST(1 AS DOUBLE)", b="CAST(2 AS DOUBLE)"))
def weighted_rrf(spark, d):
    run = _bm25(spark, d, 50)
    return R.rrf([(run, 1.0), (_dense(spark, d, 50), 2.0)], top=10)


@add(BM25.format(k=20) + DENSE.format(k=10) + """
SELECT qid, docid, l.score AS lexical_score, l.rank AS lexical_rank, s.score AS dense_score, s.rank AS dense_rank
FROM (SELECT * FROM bm WHERE rank <= 10) l FULL OUTER JOIN (SELECT * FROM dn WHERE rank <= 10) s USING (qid, docid)""")
def hybrid_outer(spark, d):
    run = _bm25(spark, d, 20)
    return R.hybrid(run.where("rank <= 10"), _dense(spark, d, 10))


SEGMENTS = BM25.format(k=50) + """, h AS (SELECT qid // 4 AS qid, qid % 4 AS segment, docid, score FROM bm),
best AS (SELECT DISTINCT qid, docid FROM (SELECT *, row_number() OVER (PARTITION BY qid, segment ORDER BY score DESC, docid) AS r FROM h) WHERE r = 1),
m AS (SELECT qid, docid, round(max(score) + least(0.1, 0.03 * (count(DISTINCT segment) - 1)), 6) AS score, count(DISTINCT segment) AS segments FROM h GROUP BY ALL),
g AS (SELECT m.*, CAST(best.docid IS NOT NULL AS INT) AS guaranteed FROM m LEFT JOIN best USING (qid, docid))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY guaranteed DESC, score DESC, docid) AS INT) AS rank FROM g) WHERE rank <= 10"""


@add(SEGMENTS)
def segment_merge_topk(spark, d):
    hits = _bm25(spark, d, 50).select((F.col("qid").cast("double") / 4).cast("long").alias("q"), (F.col("qid") % 4).alias("segment"), "docid", "score").withColumnRenamed("q", "qid")
    return R.merge_segments(hits, 10)


@add(BM25.format(k=20) + """, b AS (SELECT qid, docid, round(score * (1 + boost), 6) AS score, boost FROM (
  SELECT qid, docid, score, least(0.2, CASE WHEN quality = 1 THEN 0.08 ELSE 0 END + CASE WHEN toxic = 0 THEN 0.05 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.1 ELSE 0 END)::DOUBLE AS boost
  FROM bm JOIN documents ON doc_id = docid LEFT JOIN labels USING (doc_id)))
SELECT qid, docid, score, boost, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM b""")
def metadata_soft_rerank(spark, d):
    meta = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), "lang").join(read(spark, d, "labels").withColumnRenamed("doc_id", "docid"), "docid", "left")
    hits = _bm25(spark, d, 20).join(meta, "docid")
    out = R.soft_rerank(hits, [(F.col("quality") == 1, 0.08), (F.col("toxic") == 0, 0.05), (F.col("lang") == "en", 0.1)])
    return out.select("qid", "docid", "score", "boost", "rank")


@add(BM25.format(k=100) + """, c AS (SELECT qid, source AS case_id, max(score) AS score FROM bm JOIN documents ON doc_id = docid GROUP BY ALL)
SELECT qid, case_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, case_id) AS INT) AS rank FROM c""")
def dedup_case_max(spark, d):
    own = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.col("source").alias("case_id"))
    return R.to_case(_bm25(spark, d, 100).join(own, "docid")).select("qid", "case_id", "score", "rank")


@add(BM25.format(k=20) + """, s AS (SELECT bm.qid, docid, score, self FROM bm JOIN (SELECT qid, min(docid) AS self FROM bm WHERE rank <= 3 GROUP BY qid) USING (qid))
SELECT * FROM (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM s WHERE docid <> self) WHERE rank <= 10""")
def noself_topk(spark, d):
    run = _bm25(spark, d, 20)
    own = run.where("rank <= 3").groupBy("qid").agg(F.min("docid").alias("self_doc"))
    return R.without_self(run.join(own, "qid"), 10).select("qid", "docid", "score", "rank")


@add(BM25.format(k=50) + """SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS rank FROM bm WHERE docid IN (SELECT doc_id FROM labels)""")
def condensed_run(spark, d):
    run = _bm25(spark, d, 50)
    known = run.select("qid", "docid").join(read(spark, d, "labels").select(F.col("doc_id").alias("docid")), "docid", "left_semi")
    return R.condensed(run, known).select("qid", "docid", "score", "rank")


@add(BM25.format(k=50) + """, t AS (SELECT qid, docid, score, source, CAST(row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, docid) AS INT) AS turn FROM bm JOIN documents ON doc_id = docid WHERE score > 0)
SELECT * FROM (SELECT qid, docid, score, source, turn, CAST(row_number() OVER (PARTITION BY qid ORDER BY turn, score DESC, docid) AS INT) AS rank FROM t) WHERE rank <= 15""")
def round_robin_sources(spark, d):
    own = read(spark, d, "documents").select(F.col("doc_id").alias("docid"), "source")
    return R.round_robin(_bm25(spark, d, 50).drop("rank").join(own, "docid"), "source", 15).select("qid", "docid", "score", "source", "turn", "rank")


@add(BM25.format(k=30) + """, i AS (SELECT qid, docid, quality + 1 - toxic AS score, rank AS old_rank FROM bm LEFT JOIN labels ON doc_id = docid)
SELECT * FROM (SELECT qid, docid, CAST(score AS INT) AS score, old_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0.5) DESC, old_rank) AS INT) AS rank FROM i WHERE score >= 1 OR score IS NULL) WHERE rank <= 10""")
def grounding_filter(spark, d):
    lab = read(spark, d, "labels").select(F.col("doc_id").alias("docid"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("score"))
    items = _bm25(spark, d, 30).drop("score").join(lab, "docid", "left")
    return R.filter_by_score(items, 1, 10).select("qid", "docid", "score", "old_rank", "rank")


@add(BM25.format(k=30) + """, x AS (SELECT qid, docid, round(score + 0.5 * least(3, CAST(contains(text, 'token') AS INT) + CAST(contains(text, 'License') AS INT) + CAST(contains(text, '@') AS INT) + CAST(contains(text, '|') AS INT)), 6) AS score FROM bm JOIN documents ON doc_id = docid)
SELECT * FROM (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM x) WHERE rank <= 10""")
def boosted_articles(spark, d):
    hits = _bm25(spark, d, 30).join(_docs(spark, d), "docid")
    return R.boosted_rank(hits, C.keyword_hits("text", ["token", "License", "@", "|"]), 0.5, 3, 10, 6).select("qid", "docid", "score", "rank")


@add(BM25.format(k=20) + """SELECT qid, docid, round(CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM bm)""")
def scaled_scores(spark, d):
    from pyspark.sql import Window

    return _bm25(spark, d, 20).select("qid", "docid", F.round(W.min_max(F.col("score"), Window.partitionBy("qid")), 6).alias("scaled"))
