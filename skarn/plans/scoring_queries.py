"""Scoring queries over the star schema and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from .base import Registry, read

REGISTRY = Registry()
add = REGISTRY.add


def _lots(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    return li.join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


@add("""WITH a AS (SELECT o_orderpriority, p_brand, max(l_discount) AS best, count(*) AS hits FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
t AS (SELECT *, round(best + 0.02 * least(3, hits - 1), 6) AS total FROM a), r AS (SELECT *, CAST(row_number() OVER w AS INT) AS rank, round(total - coalesce(lead(total) OVER w, 0), 6) AS margin FROM t WINDOW w AS (PARTITION BY o_orderpriority ORDER BY total DESC, p_brand))
SELECT o_orderpriority, p_brand, best, hits, total, rank, margin FROM r WHERE rank <= 3""")
def department_candidates(spark, d):
    own = _lots(spark, d).join(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.candidates(own, "o_orderpriority", "p_brand", "l_discount").select("o_orderpriority", "p_brand", "best", "hits", "total", "rank", "margin")


@add("""WITH s AS (SELECT l_orderkey, p_brand, round(sum(l_quantity), 6) AS w, min(l_partkey) AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, o, p_brand) AS k FROM s)
SELECT l_orderkey, max(p_brand) FILTER (k = 1) AS "primary", max(p_brand) FILTER (k = 2) AS secondary FROM r GROUP BY l_orderkey""")
def civil_vote(spark, d):
    return S.votes(_lots(spark, d), "l_orderkey", "p_brand", "l_quantity", "l_partkey")


P_VALUE = """, y AS (SELECT count(*) AS n, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM x), z AS (SELECT n, m, t, n - 1 AS df, atan(abs(t) / sqrt(n - 1)) AS th FROM y),
ser AS (SELECT CASE WHEN df % 2 = 1 THEN 2 / pi() * (any_value(th) + sin(any_value(th)) * coalesce(sum(exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * cos(th) ** (2 * k + 1)), 0))
  ELSE sin(any_value(th)) * sum(exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * cos(th) ** (2 * k)) END AS inside FROM (SELECT df, th, unnest(range(0, df // 2)) AS k FROM z) GROUP BY df)
SELECT n, round(m, 6) AS mean_diff, round(t, 6) AS t, round(least(1, greatest(0, 1 - inside)), 6) AS p FROM z, ser"""


@add("WITH a AS (SELECT l_orderkey AS k, avg(l_discount) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, avg(l_tax) AS v FROM lineitem GROUP BY 1), x AS (SELECT a.v - b.v AS d FROM a JOIN b USING (k))" + P_VALUE)
def compare_runs(spark, d):
    li = read(spark, d, "lineitem")
    side = lambda c: li.groupBy(F.col("l_orderkey").alias("k")).agg(F.avg(c).alias("v"))
    return S.compare(side("l_discount"), side("l_tax"), "k", "v")


@add("WITH a AS (SELECT l_partkey AS k, avg(l_discount) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS k, avg(l_tax + 0.01) AS v FROM lineitem GROUP BY 1), x AS (SELECT a.v - b.v AS d FROM a JOIN b USING (k))" + P_VALUE)
def compare_close_runs(spark, d):
    li = read(spark, d, "lineitem").withColumn("shifted", F.col("l_tax") + 0.01)
    side = lambda c: li.groupBy(F.col("l_partkey").alias("k")).agg(F.avg(c).alias("v"))
    return S.compare(side("l_discount"), side("shifted"), "k", "v")


@add("SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INT) AS fold FROM documents")
def stratified_folds(spark, d):
    return S.folds(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5)


@add("""WITH m AS (SELECT lang, avg(quality) AS q, avg(toxic) AS t, avg(n_chars) AS c FROM documents JOIN labels USING (doc_id) GROUP BY lang), s AS (SELECT lang, round(0.5 * q + 0.3 * (1 - t) + 0.2 * (1 - c / max(c) OVER ()), 6) AS score FROM m)
SELECT lang, score, CAST(row_number() OVER (ORDER BY score DESC, lang) AS INT) AS rank FROM s""")
def composite_ranking(spark, d):
    m = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"), F.avg("n_chars").alias("c"))
    top = m.agg(F.max("c").alias("top"))
    rows = m.join(F.broadcast(top))
    return S.composite(rows, [(F.col("q"), 0.5), (1 - F.col("t"), 0.3), (1 - F.col("c") / F.col("top"), 0.2)], "lang").select("lang", "score", "rank")


@add("SELECT doc_id, CAST((length(text) - length(replace(text, 'token', ''))) / 5 AS INT) AS n, CASE (length(text) - length(replace(text, 'token', ''))) / 5 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS state FROM documents")
def quote_alignment(spark, d):
    n, state = S.alignment(F.col("text"), F.lit("token"))
    return read(spark, d, "documents").select("doc_id", n.alias("n"), state.alias("state"))


@add("SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, count(DISTINCT l_linenumber) = max(l_linenumber) AS is_prefix FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def contiguous_lines(spark, d):
    return S.contiguous_prefix(read(spark, d, "lineitem").where("l_returnflag <> 'R'"), "l_orderkey", "l_linenumber")


@add("SELECT 'value' AS field, round(avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS rate FROM events UNION ALL SELECT 'props', round(avg(CASE WHEN props IS NOT NULL AND trim(props) <> '' THEN 1.0 ELSE 0 END)::DOUBLE, 6) FROM events")
def field_presence(spark, d):
    return S.presence(read(spark, d, "events"), ["value", "props"])


@add("""WITH s AS (SELECT doc_id, CAST(contains(text, 'token') AS INT) + CAST(contains(text, 'License') AS INT) + CAST(contains(text, '@') AS INT) + CAST(contains(text, '|') AS INT) AS hits FROM documents)
SELECT doc_id, hits FROM (SELECT *, row_number() OVER (ORDER BY hits DESC, doc_id) AS r FROM s) WHERE r <= 20 AND hits > 0""")
def term_match_topk(spark, d):
    from ..functions import columns as C

    own = read(spark, d, "documents").select("doc_id", C.keyword_hits("text", ["token", "License", "@", "|"]).alias("hits")).where("hits > 0")
    return own.orderBy(F.desc("hits"), "doc_id").limit(20)


@add("""WITH need AS (SELECT DISTINCT o_orderpriority AS priority, p_brand AS brand FROM orders, part), have AS (SELECT DISTINCT o_orderpriority AS priority, p_brand AS brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = l_linenumber)
SELECT priority, brand FROM need EXCEPT SELECT priority, brand FROM have""")
def missing_pairs(spark, d):
    priorities = read(spark, d, "orders").agg(F.collect_set("o_orderpriority").alias("p"))  # five values
    need = read(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct().join(F.broadcast(priorities)).select(F.explode("p").alias("priority"), "brand")
    li = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "part"), (F.col("l_partkey") == F.col("p_partkey")) & (F.col("p_size") == F.col("l_linenumber")))
    have = li.select(F.col("o_orderpriority").alias("priority"), F.col("p_brand").alias("brand")).distinct()
    return need.join(have, ["priority", "brand"], "left_anti")
