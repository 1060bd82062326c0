"""Evaluation queries. A run ranks the labelled documents of a source by length; relevance is quality + 1 - toxic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluation as E
from ..operators import windows as W
from .base import Registry, read

REGISTRY = Registry()
add = REGISTRY.add

RUN = """
WITH lab AS (SELECT source AS qid, doc_id AS docid, n_chars, lang, quality, toxic, CAST(quality + 1 - toxic AS INT) AS rel FROM documents JOIN labels USING (doc_id)),
run AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, docid) AS rank FROM documents_run),
qrels AS (SELECT qid, docid, rel FROM lab)
""".replace("documents_run", "(SELECT source AS qid, doc_id AS docid, n_chars FROM documents)")
METRICS = RUN + """,
h AS (SELECT r.qid, r.docid, r.rank, coalesce(rel, 0) AS rel, sum(CASE WHEN coalesce(rel, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.qid ORDER BY r.rank) AS ng FROM run r LEFT JOIN qrels USING (qid, docid) WHERE r.rank <= 10),
g AS (SELECT qid, sum(rel / log2(rank + 1.0)) AS dcg, sum(CASE WHEN rel > 0 THEN ng / CAST(rank AS DOUBLE) ELSE 0 END) AS aps, max(CASE WHEN rel > 0 THEN 1.0 / rank ELSE 0 END)::DOUBLE AS rr, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS hits FROM h GROUP BY qid),
i AS (SELECT qid, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1.0) END) AS idcg, count(*) AS nr FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS i FROM qrels WHERE rel > 0) GROUP BY qid),
m AS (SELECT qid, round(coalesce(dcg, 0) / idcg, 6) AS ndcg, round(coalesce(aps, 0) / nr, 6) AS ap, round(coalesce(rr, 0), 6) AS rr, round(coalesce(hits, 0) / CAST(nr AS DOUBLE), 6) AS recall, round(coalesce(hits, 0) / 10.0::DOUBLE, 6) AS precision FROM i LEFT JOIN g USING (qid))
"""
MEANS = "count(*) AS n_queries, round(avg(ndcg), 6) AS mean_ndcg, round(avg(ap), 6) AS mean_ap, round(avg(rr), 6) AS mean_rr, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision"


def _run(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("docid"), "n_chars")
    return W.ranked(docs, ["qid"], [F.desc("n_chars"), F.asc("docid")]).select("qid", "docid", "rank")


def _qrels(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return both.select(F.col("source").alias("qid"), F.col("doc_id").alias("docid"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("rel"))


@add(METRICS + "SELECT * FROM m")
def ir_metrics_per_query(spark, d):
    return E.ir_metrics(_run(spark, d), _qrels(spark, d))


@add(METRICS + f"SELECT {MEANS} FROM m")
def ir_metrics_aggregate(spark, d):
    return E.aggregate_metrics(E.ir_metrics(_run(spark, d), _qrels(spark, d)))


@add(METRICS + f"SELECT CAST(substr(qid, 4, 1) AS VARCHAR) AS slice, {MEANS} FROM m GROUP BY 1")
def slice_metrics(spark, d):
    one = E.ir_metrics(_run(spark, d), _qrels(spark, d)).withColumn("slice", F.substring("qid", 4, 1))
    return E.aggregate_metrics(one, ["slice"])


@add(RUN + """SELECT qid, round(coalesce(hits, 0) / CAST(least(n, 20) AS DOUBLE), 6) AS recall FROM (SELECT qid, count(*) AS n FROM qrels WHERE rel > 0 GROUP BY qid) LEFT JOIN
(SELECT qid, count(*) AS hits FROM run JOIN qrels USING (qid, docid) WHERE rank <= 20 AND rel > 0 GROUP BY qid) USING (qid)""")
def recall_capped(spark, d):
    return E.capped_recall(_run(spark, d), _qrels(spark, d), 20)


@add(RUN + "SELECT qid, round(avg(CASE WHEN rel IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unjudged FROM run LEFT JOIN qrels USING (qid, docid) WHERE rank <= 20 GROUP BY qid")
def unjudged_rate(spark, d):
    return E.unjudged_rate(_run(spark, d), _qrels(spark, d), 20)


@add(RUN + """SELECT qid, count(*) FILTER (rel = 0) AS rel_0, count(*) FILTER (rel = 1) AS rel_1, count(*) FILTER (rel = 2) AS rel_2, round(avg(CASE WHEN rel = 0 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS harmful_rate,
round(avg(CASE WHEN rel = 2 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS useful_rate FROM run JOIN qrels USING (qid, docid) WHERE rank <= 20 GROUP BY qid""")
def topk_breakdown(spark, d):
    return E.breakdown(_run(spark, d), _qrels(spark, d), 20)


#: Three judges: quality, non-toxicity, and length.
JUDGES = "j AS (SELECT doc_id, CAST(quality * 2 AS INT) AS a, CAST(quality + 1 - toxic AS INT) AS b, CAST(CASE WHEN n_chars > 2000 THEN 2 WHEN n_chars > 600 THEN 1 ELSE 0 END AS INT) AS c FROM labels JOIN documents USING (doc_id))"


def _judges(spark, d):
    both = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    size = F.when(F.col("n_chars") > 2000, 2).when(F.col("n_chars") > 600, 1).otherwise(0)
    return both.select("doc_id", (F.col("quality") * 2).cast("int").alias("a"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("b"), size.alias("c"))


@add(f"""WITH {JUDGES}, n AS (SELECT a AS i, b AS j, count(*) AS n FROM j GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n),
mi AS (SELECT i, sum(n) AS n FROM n GROUP BY i), mj AS (SELECT j, sum(n) AS n FROM n GROUP BY j)
SELECT CAST((SELECT t FROM t) AS BIGINT) AS n, round(1 - (SELECT sum(abs(i - j) * n) FROM n) / (SELECT sum(abs(mi.i - mj.j) * CAST(mi.n AS DOUBLE) * mj.n / (SELECT t FROM t)) FROM mi, mj), 6) AS kappa""")
def cohen_kappa_linear(spark, d):
    return E.cohen_linear(_judges(spark, d), "a", "b")


@add(f"""WITH {JUDGES}, v AS (SELECT (a = 0)::INT + (b = 0)::INT + (c = 0)::INT AS v0, (a = 1)::INT + (b = 1)::INT + (c = 1)::INT AS v1, (a = 2)::INT + (b = 2)::INT + (c = 2)::INT AS v2 FROM j),
s AS (SELECT count(*) AS n, avg((v0 * v0 + v1 * v1 + v2 * v2 - 3) / 6.0::DOUBLE) AS p, sum(v0) / (count(*) * 3.0::DOUBLE) AS s0, sum(v1) / (count(*) * 3.0::DOUBLE) AS s1, sum(v2) / (count(*) * 3.0::DOUBLE) AS s2 FROM v)
SELECT n, round((p - (s0 * s0 + s1 * s1 + s2 * s2)) / (1 - (s0 * s0 + s1 * s1 + s2 * s2)), 6) AS kappa FROM s""")
def fleiss_kappa(spark, d):
    return E.fleiss(_judges(spark, d), "doc_id", ["a", "b", "c"])


@add(f"WITH {JUDGES} SELECT doc_id, CAST(floor(list_median) AS INT) AS label FROM (SELECT doc_id, median(x) AS list_median FROM (SELECT doc_id, unnest([a, b, c]) AS x FROM j) GROUP BY doc_id)")
def median_judge(spark, d):
    return _judges(spark, d).select("doc_id", E.median_judge(_judges(spark, d), ["a", "b", "c"]).alias("label"))


@add("""WITH p AS (SELECT least(1.0, n_chars / 5000.0)::DOUBLE AS p, quality AS y FROM documents JOIN labels USING (doc_id)),
b AS (SELECT greatest(1, ceil(p * 10)) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM p GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b""")
def ece_10bin(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return E.calibration_error(both.withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / 5000.0)), "p", "quality")


@add("""WITH c AS (SELECT source, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS k FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, CAST(n AS BIGINT) AS n, round(greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
round(least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM c""")
def wilson_ci(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    low, high = E.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return both.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@add("""WITH t AS (SELECT conv_id, regexp_extract_all(lower(string_agg(text, ' ') FILTER (role = 'user')), '[A-Za-z0-9가-힣]+') AS p, regexp_extract_all(lower(string_agg(text, ' ') FILTER (role = 'assistant')), '[A-Za-z0-9가-힣]+') AS g
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0),
a AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(p) AS w FROM t) GROUP BY ALL), b AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(g) AS w FROM t) GROUP BY ALL),
s AS (SELECT conv_id, sum(least(a.n, b.n)) AS same FROM a JOIN b USING (conv_id, w) GROUP BY conv_id)
SELECT conv_id, round(CASE WHEN coalesce(same, 0) > 0 THEN 2.0 * same / (len(p) + len(g)) ELSE 0 END::DOUBLE, 6) AS f1 FROM t LEFT JOIN s USING (conv_id)""")
def token_f1(spark, d):
    turns = read(spark, d, "conversations")
    side = lambda r: F.flatten(F.collect_list(F.when(F.col("role") == r, C.tokens("text"))))
    pairs = turns.groupBy("conv_id").agg(side("user").alias("p"), side("assistant").alias("g"), F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("s"))
    return E.token_f1(pairs.where("u > 0 and s > 0"), "conv_id", "p", "g")


@add("SELECT event_type, count(value) AS n, round(quantile_cont(value::DOUBLE, 0.5), 2) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 2) AS p95, round(quantile_cont(value::DOUBLE, 0.99), 2) AS p99, round(avg(value), 2) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return E.latency(read(spark, d, "events"), "value", ["event_type"])


@add("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n, value AS p95 FROM v WHERE i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)""")
def nearest_rank_p95(spark, d):
    return E.nearest_rank(read(spark, d, "events"), "value", ["event_type"])


@add("""WITH g AS (SELECT w, t FROM (SELECT unnest([0.2, 0.5, 0.8]) AS w), (SELECT unnest([1000, 2000, 4000]) AS t)),
s AS (SELECT w::DOUBLE AS weight, CAST(t AS INT) AS cut, w * quality + (1 - w) * CASE WHEN n_chars <= t THEN 1 ELSE 0 END AS s FROM documents JOIN labels USING (doc_id), g), m AS (SELECT weight, cut, round(avg(s)::DOUBLE, 6) AS mean_score FROM s GROUP BY ALL)
SELECT weight, cut, mean_score, row_number() OVER (ORDER BY mean_score DESC, weight, cut) = 1 AS best FROM m""")
def parameter_grid(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    grid = [(w, t) for w in (0.2, 0.5, 0.8) for t in (1000, 2000, 4000)]
    cells = both.select("quality", "n_chars", F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(t).alias("cut")) for w, t in grid])).alias("g")).select("quality", "n_chars", "g.*")
    score = F.col("weight") * F.col("quality") + (1 - F.col("weight")) * F.when(F.col("n_chars") <= F.col("cut"), 1).otherwise(0)
    return E.best_setting(cells.withColumn("s", score), ["weight", "cut"], "s")


@add("""SELECT lang, count(*) AS n, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS good, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def category_rates(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.round(F.avg(good.cast("double")), 6).alias("rate"))


@add("""WITH j AS (SELECT CAST(quality AS INT) AS gold, CAST(CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS INT) AS pred FROM labels JOIN documents USING (doc_id))
SELECT gold, pred, count(*) AS n FROM j GROUP BY ALL""")
def confusion_counts(spark, d):
    both = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.groupBy(F.col("quality").cast("int").alias("gold"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("pred")).agg(F.count("*").alias("n"))
