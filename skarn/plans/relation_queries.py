"""Joins, diffs, validity, graphs and profiles over the star schema and the text tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relations as J
from ..operators import windows as W
from .base import Registry, read

REGISTRY = Registry()
add = REGISTRY.add


@add("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY o_custkey")
def latest_status(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("last_key"), "o_orderdate")
    return W.best_row(o, ["o_custkey"], ["o_orderdate", "last_key"]).select("o_custkey", "state", "last_key")


VALID = """WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS f, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL 365 DAY END AS t, TIMESTAMP '1996-06-30 00:00:00' AS x FROM orders)
SELECT id, coalesce(f <= x, true) AND coalesce(x <= t, true) AS ok, CASE WHEN NOT (coalesce(f <= x, true) AND coalesce(x <= t, true)) THEN 'outside' WHEN f IS NOT NULL AND t IS NOT NULL THEN 'valid' ELSE 'unverified' END AS status FROM v"""


@add(VALID)
def interval_validity(spark, d):
    o = read(spark, d, "orders")
    begin = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    end = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.expr("interval 365 days"))
    ok, status = J.validity(begin, end, F.lit("1996-06-30 00:00:00").cast(o.schema["o_orderdate"].dataType))
    return o.select(F.col("o_orderkey").alias("id"), ok.alias("ok"), status.alias("status"))


@add("""WITH s AS (SELECT o_custkey AS target, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY 1),
n AS (SELECT DISTINCT l_suppkey AS candidate, o_custkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT candidate, count(*) AS n FROM n LEFT JOIN s USING (target) WHERE coalesce(state, 'missing') NOT IN ('O', 'F') GROUP BY 1)
SELECT s_suppkey AS candidate, coalesce(n, 0) AS n_blocked, coalesce(n, 0) > 0 AS is_blocked FROM supplier LEFT JOIN b ON candidate = s_suppkey""")
def blocked_candidates(spark, d):
    o = read(spark, d, "orders")
    needs = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("candidate"), F.col("o_custkey").alias("target")).distinct()
    status = o.select(F.col("o_custkey").alias("target"), F.col("o_orderstatus").alias("state"), F.struct("o_orderdate", "o_orderkey").alias("revision"))
    return J.blocked(read(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate")), needs, status, ["O", "F"])


@add("""WITH a AS (SELECT p_partkey, p_name, p_size, p_brand FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 8 = 0 THEN 'new' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 13 <> 0),
j AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_size <> b.p_size OR a.p_brand <> b.p_brand THEN 'modified' END AS change,
array_to_string(list_filter([CASE WHEN a.p_size <> b.p_size THEN 'p_size' END, CASE WHEN a.p_brand <> b.p_brand THEN 'p_brand' END], lambda x: x IS NOT NULL), ',') AS f FROM a FULL OUTER JOIN b USING (p_partkey))
SELECT p_partkey, change, CASE WHEN change = 'modified' THEN f ELSE '' END AS fields FROM j WHERE change IS NOT NULL""")
def keyed_diff(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    after = p.where("p_partkey % 13 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 8 == 0, "new").otherwise(F.col("p_brand")))
    return J.keyed_diff(p.where("p_partkey % 11 <> 0"), after, ["p_partkey"], ["p_name", "p_size", "p_brand"])


SPANS = """WITH c AS (SELECT doc_id, CAST(i AS BIGINT) AS a, CAST(i * 400 AS BIGINT) AS s, CAST(least(n_chars, i * 400 + 500) AS BIGINT) AS e FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars // 400 + 1)) AS i FROM documents) WHERE i * 400 < n_chars),
m AS (SELECT doc_id, CAST(i AS BIGINT) AS b, CAST(i * 650 AS BIGINT) AS s, CAST(i * 650 + 120 AS BIGINT) AS e FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars // 650 + 1)) AS i FROM documents))
"""


def _spans(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    grid = lambda step: F.explode(F.sequence(F.lit(0), F.expr(f"n_chars div {step}")))
    one = docs.withColumn("a", grid(400)).where("a * 400 < n_chars").select("doc_id", "a", (F.col("a") * 400).alias("start"), F.least("n_chars", F.col("a") * 400 + 500).alias("end"))
    two = docs.withColumn("b", grid(650)).select("doc_id", "b", (F.col("b") * 650).alias("start"), (F.col("b") * 650 + 120).alias("end"))
    return one, two


@add(SPANS + "SELECT doc_id, a, b, c.s AS s1, c.e AS e1, m.s AS s2, m.e AS e2 FROM c JOIN m USING (doc_id) WHERE c.s < m.e AND m.s < c.e")
def span_overlap_join(spark, d):
    one, two = _spans(spark, d)
    return J.span_overlaps(one, two, ["doc_id"])


@add(SPANS + """, u AS (SELECT doc_id, s, e FROM m WHERE b % 3 <> 0 UNION ALL SELECT doc_id, s + 100, e + 100 FROM m WHERE b % 2 = 0),
g AS (SELECT *, CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM u)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT doc_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY doc_id, k""")
def coalesced_spans(spark, d):
    _, two = _spans(spark, d)
    other = two.where("b % 2 = 0").select("doc_id", (F.col("start") + 100).alias("start"), (F.col("end") + 100).alias("end"))
    return J.coalesced(two.where("b % 3 <> 0").select("doc_id", "start", "end").unionByName(other), ["doc_id"])


@add("""WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM documents WHERE n_chars > 2000), j AS (SELECT doc_id FROM labels)
SELECT doc_id, a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b FROM a FULL OUTER JOIN b USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM j)""")
def pool_union_anti(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    a = docs.where("lang = 'en'").select("doc_id", F.lit(True).alias("in_a"))
    b = docs.where("n_chars > 2000").select("doc_id", F.lit(True).alias("in_b"))
    pool = a.join(b, "doc_id", "full_outer").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return pool.select("doc_id", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


@add("""WITH o AS (SELECT doc_id, quality AS rel FROM labels), n AS (SELECT doc_id, CAST(9 AS INT) AS rel FROM documents WHERE n_chars > 3000)
SELECT doc_id, CAST(rel AS INT) AS rel FROM o UNION ALL SELECT doc_id, rel FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)""")
def add_missing_qrels(spark, d):
    old = read(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("rel"))
    new = read(spark, d, "documents").where("n_chars > 3000").select("doc_id", F.lit(9).alias("rel"))
    return W.add_missing(old, new, ["doc_id"])


@add("""WITH o AS (SELECT c_custkey AS id, c_name AS name FROM customer), n AS (SELECT c_custkey AS id, 'x' || c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000000, c_name FROM customer WHERE c_custkey % 5 = 0)
SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")
def upsert_customers(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = old.where("id % 3 = 0").withColumn("name", F.concat(F.lit("x"), "name")).unionByName(old.where("id % 5 = 0").withColumn("id", F.col("id") + 1000000000))
    return W.upsert(old, new, ["id"])


EDGES = "e AS (SELECT c_nationkey AS head, CAST(100 + s_nationkey AS INT) AS tail FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey HAVING sum(l_quantity) > (SELECT sum(l_quantity) / 500 FROM lineitem))"


def _edges(spark, d):
    """Which customers' nation buys more than a 500th of all from which suppliers' nation."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = read(spark, d, "customer").select("c_custkey", "c_nationkey"), read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    own = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    sold = own.groupBy(F.col("c_nationkey").alias("head"), (F.col("s_nationkey") + 100).cast("int").alias("tail")).agg(F.sum("l_quantity").alias("q"))
    return sold.join(F.broadcast(li.agg((F.sum("l_quantity") / 500).alias("least")))).where("q > least").select("head", "tail")


BOTH = EDGES + ", b AS (SELECT head, tail FROM e UNION SELECT tail, head FROM e)"


@add(f"WITH {BOTH}, two AS (SELECT x.head, y.tail AS \"end\", min(x.tail) AS mid FROM b x JOIN b y ON x.tail = y.head WHERE x.head <> y.tail GROUP BY 1, 2) SELECT head, tail AS \"end\", CAST(1 AS INT) AS hops, CAST(NULL AS INT) AS mid FROM b UNION ALL SELECT head, \"end\", CAST(2 AS INT), mid FROM two t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.head = t.head AND b.tail = t.\"end\")")
def two_hop_paths(spark, d):
    e = _edges(spark, d)
    return J.two_hop(e.unionByName(e.select(F.col("tail").alias("head"), F.col("head").alias("tail"))))


def _rank_sql(rounds: int) -> str:
    """Without any edge nothing flows, which is 0 and not null; halves at the ninth place are decided on twelve, where sums in any order agree."""
    seed = "CASE WHEN node < 5 THEN 0.2 ELSE 0.0 END"
    parts = [f"WITH {BOTH}, m AS (SELECT head, tail, 1.0::DOUBLE / count(*) OVER (PARTITION BY head) AS w FROM b), n AS (SELECT DISTINCT head AS node FROM b UNION SELECT unnest(range(0, 5))), r0 AS (SELECT node, ({seed})::DOUBLE AS p FROM n)"]
    for i in range(rounds):
        parts.append(f"f{i} AS (SELECT tail AS node, sum(p * w) AS f FROM r{i} JOIN m ON node = head GROUP BY 1), r{i + 1} AS (SELECT n.node, 0.1 * ({seed.replace('node', 'n.node')}) + 0.9 * (coalesce(f, 0) + (1 - (SELECT coalesce(sum(f), 0) FROM f{i})) * ({seed.replace('node', 'n.node')})) AS p FROM n LEFT JOIN f{i} ON n.node = f{i}.node)")
    return ", ".join(parts) + f" SELECT CAST(node AS INT) AS node, CAST(round(CAST(p AS DECIMAL(18, 12)), 8) AS DOUBLE) AS score FROM r{rounds}"


@add(_rank_sql(6))
def pagerank_ppr(spark, d):
    e = _edges(spark, d)
    both = e.unionByName(e.select(F.col("tail").alias("head"), F.col("head").alias("tail"))).withColumn("weight", F.lit(1.0))
    seeds = spark.range(5).select(F.col("id").cast("int").alias("node"), F.lit(0.2).alias("p"))
    return J.pagerank(both, seeds, rounds=6)


@add("""WITH RECURSIVE l AS (SELECT p_partkey AS id, p_partkey // 2 AS nxt FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 0), c AS (SELECT p_partkey AS id, p_partkey AS node FROM part UNION ALL SELECT c.id, l.nxt FROM c JOIN l ON c.node = l.id)
SELECT id, min(node) AS "end" FROM c GROUP BY id""")
def replacement_chains(spark, d):
    ids = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    links = ids.where("id % 2 = 0 and id > 0").select("id", F.expr("id div 2").alias("next"))
    return J.live_target(links, ids)


@add("SELECT c_custkey AS id, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS representative FROM customer")
def first_seen_entities(spark, d):
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    return J.representatives(own, ["c_nationkey", "c_mktsegment"], [F.asc("id")], "id").select("id", "representative")


PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '^-?[0-9]+(\\.[0-9]+)?(E[0-9]+)?$')) AS n_number, count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS n_date FROM part"
    for c in ("p_name", "p_brand", "p_type", "p_size")
)


@add(PROFILE)
def column_profile(spark, d):
    return J.unpivot_profile(read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")


RULES = [("licence", [["License", "Licensed"], ["Version"]]), ("secret", [["token"], ["=", ":"]]), ("contact", [["@"], [".com", ".org"]])]


@add("""SELECT doc_id, unnest(list_filter([CASE WHEN (contains(text, 'License') OR contains(text, 'Licensed')) AND contains(text, 'Version') THEN 'licence' END, CASE WHEN contains(text, 'token') AND (contains(text, '=') OR contains(text, ':')) THEN 'secret' END, CASE WHEN contains(text, '@') AND (contains(text, '.com') OR contains(text, '.org')) THEN 'contact' END], lambda x: x IS NOT NULL)) AS rule FROM documents""")
def rule_join(spark, d):
    return J.rule_hits(read(spark, d, "documents"), "doc_id", "text", RULES)


@add(r"""WITH n AS (SELECT DISTINCT t AS toks FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9가-힣]+')[1:3 + item_id % 20] AS t FROM benchmark) WHERE len(t) >= 3), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9가-힣]+') AS toks FROM documents),
g AS (SELECT doc_id, s, toks[s] AS a, toks[s + 1] AS b, toks[s + 2] AS c FROM (SELECT doc_id, toks, unnest(range(1, len(toks) - 1)) AS s FROM d)),
h AS (SELECT doc_id, s, toks AS want FROM g JOIN n ON a = toks[1] AND b = toks[2] AND c = toks[3]),
f AS (SELECT doc_id, array_to_string(want, ' ') AS name, CAST(s - 1 AS INT) AS "start", CAST(s - 1 + len(want) AS INT) AS "end" FROM h JOIN d USING (doc_id) WHERE toks[s:s + len(want) - 1] = want),
w AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM f)
SELECT doc_id, name, "start", "end" FROM w WHERE far IS NULL OR "end" > far""")
def dictionary_join(spark, d):
    head = F.slice(C.tokens("text"), F.lit(1), (F.col("item_id") % 20 + 3).cast("int"))
    names = read(spark, d, "benchmark").select(head.alias("toks")).where("size(toks) >= 3").select(F.array_join("toks", " ").alias("name"), "toks").distinct()
    return J.dictionary_matches(read(spark, d, "documents").select("doc_id", C.tokens("text").alias("toks")), "doc_id", names)


@add("""SELECT r_name, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_region(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_discount").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@add("SELECT o_orderpriority AS priority, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high, count(DISTINCT o_custkey) AS customers, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1")
def price_spread(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high"), F.countDistinct("o_custkey").alias("customers"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"))


@add("""SELECT user_id, CAST(s AS BIGINT) AS session_no, min(ts) AS start_ts, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 86400 THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""")
def user_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumn("before", F.lag("ts").over(w))
    gap = F.col("before").isNull() | (F.unix_timestamp("ts") - F.unix_timestamp("before") > 86400)
    own = e.withColumn("session_no", F.sum(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("user_id", "session_no").agg(F.min("ts").alias("start_ts"), F.count("*").alias("n"))


@add("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def json_property_counts(spark, d):
    return read(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
