"""Queries of citations, coverage, group flags, structuring signals and rankings over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from .base import Registry, read
from .event_queries import EV, _events

REGISTRY = Registry()
add = REGISTRY.add


def _s(c):
    return F.col(c).cast("string")


def _mod(c, n):
    return F.col(c) % n


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


@add("""WITH k AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN k.p IS NULL THEN 'unknown' WHEN l_quantity * 6 > 200 THEN 'long' END AS problem FROM lineitem LEFT JOIN k ON p = l_partkey AND s = l_suppkey""")
def citation_problems(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    ids = [F.concat(F.lit(" "), _s("l_partkey")).alias("chunk_id"), _s("l_suppkey").alias("case_id")]
    cited = li.select("l_orderkey", "l_partkey", "l_suppkey", *ids, F.expr("repeat('x', int(l_quantity * 6))").alias("snippet"))
    return E.citation_problems(cited, li.where("l_returnflag = 'R'").select(*ids)).select("l_orderkey", "l_partkey", "l_suppkey", "problem")


@add("""WITH c AS (SELECT o_custkey AS qid, o_orderkey AS pos, CAST(o_orderkey % 4 AS VARCHAR) AS chunk_id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 2 AS VARCHAR) END AS case_id, '' AS snippet FROM orders WHERE o_orderkey % 3 = 0),
x AS (SELECT o_custkey AS qid, o_orderkey AS pos, CAST(o_orderkey % 4 AS VARCHAR) AS chunk_id, CAST(o_orderkey % 2 AS VARCHAR) AS case_id, o_orderpriority AS snippet FROM orders WHERE o_orderkey % 3 <> 0),
m AS (SELECT qid, chunk_id, arg_max(case_id, pos) AS xc, arg_max(snippet, pos) AS xs FROM x GROUP BY ALL),
good AS (SELECT c.qid, c.pos, c.chunk_id, xc AS case_id, xs AS snippet FROM c JOIN m USING (qid, chunk_id) WHERE c.case_id IN ('', xc)),
spare AS (SELECT h.qid, h.pos, h.chunk_id, h.case_id, h.snippet FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM x) h JOIN m USING (qid, chunk_id) WHERE n <= 3 AND h.case_id = xc AND h.qid NOT IN (SELECT qid FROM good))
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) AS INT) AS ref_id, chunk_id, case_id, snippet FROM (FROM good UNION ALL FROM spare)""")
def normalized_citations(spark, d):
    o = read(spark, d, "orders")
    base = [F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("pos"), _mod("o_orderkey", 4).cast("string").alias("chunk_id")]
    case = _mod("o_orderkey", 2).cast("string")
    cited = o.where("o_orderkey % 3 = 0").select(*base, F.when(_mod("o_orderkey", 5) == 0, "").otherwise(case).alias("case_id"), F.lit("").alias("snippet"))
    return E.kept_citations(cited, o.where("o_orderkey % 3 <> 0").select(*base, case.alias("case_id"), F.col("o_orderpriority").alias("snippet")))


@add("""WITH t AS (SELECT conv_id AS qid, turn, role, list_distinct(list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')), ' '), lambda x: length(x) > 2)) AS terms FROM conversations),
a AS (SELECT qid, turn AS seg, unnest(terms) AS term FROM t WHERE role = 'user' AND turn < 8), b AS (SELECT qid, turn AS pos, unnest(terms) AS term FROM t WHERE role <> 'user'),
h AS (SELECT qid, seg, pos, count(*) + 1.0::DOUBLE / (pos + 2) AS s FROM a JOIN b USING (qid, term) GROUP BY qid, seg, pos), r AS (SELECT *, row_number() OVER (PARTITION BY qid, seg ORDER BY s DESC, pos) AS n FROM h),
g AS (SELECT qid, seg, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY n) AS evidence FROM r WHERE n <= 2 GROUP BY ALL)
SELECT t.qid, t.turn AS seg, CASE WHEN evidence IS NULL THEN 'no_evidence' ELSE 'grounded' END AS status, coalesce(evidence, '') AS evidence FROM t LEFT JOIN g ON g.qid = t.qid AND g.seg = t.turn WHERE role = 'user' AND turn < 8""")
def segment_evidence(spark, d):
    terms = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "")), " "), lambda x: F.length(x) > 2)
    t = read(spark, d, "conversations").select(F.col("conv_id").alias("qid"), "turn", "role", terms.alias("terms"))
    contexts = t.where("role <> 'user'").select("qid", F.col("turn").alias("pos"), "terms", (1.0 / (F.col("turn") + 2)).alias("score"))
    out = E.segment_evidence(t.where("role = 'user'").select("qid", F.col("turn").alias("seg"), "terms"), contexts, most=8)
    return out.withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


@add("""WITH x AS (SELECT o_orderkey, list_filter([CAST(o_custkey AS VARCHAR), CAST(o_orderkey % 7 AS VARCHAR), CAST(o_orderkey % 7 AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, '', CAST(o_custkey AS VARCHAR)], lambda v: v IS NOT NULL AND v <> '') AS l FROM orders)
SELECT o_orderkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS ids FROM x""")
def evidence_id_unions(spark, d):
    own = F.array(_s("o_custkey"), _mod("o_orderkey", 7).cast("string"))
    more = F.array(F.concat(F.lit(" "), _mod("o_orderkey", 7).cast("string")), F.when(_mod("o_orderkey", 2) == 0, F.col("o_orderstatus")), F.lit(" "), _s("o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(E.union_of_ids(own, F.lit(None), more), ",").alias("ids"))


@add("""WITH x AS (SELECT o_orderkey, [o_orderkey % 5, o_orderkey % 7 + 10] AS own, [o_orderkey % 3, o_orderkey % 4 + 20, o_orderkey % 6 + 30, o_orderkey % 8 + 40] AS m FROM orders), y AS (SELECT o_orderkey, list_filter(own, lambda v: v % 2 = 0) AS k, list_filter(m, lambda v: v % 2 = 0) AS m FROM x)
SELECT o_orderkey, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE m[1:2] END, ',') AS ids FROM y""")
def repaired_actions(spark, d):
    k = lambda n, plus: _mod("o_orderkey", n) + plus
    ids = E.repaired_ids(F.array(k(5, 0), k(7, 10)), F.array(k(3, 0), k(4, 20), k(6, 30), k(8, 40)), F.expr("sequence(0L, 60L, 2L)"), most=2)
    return read(spark, d, "orders").select("o_orderkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@add("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size = 7 THEN 'risk_type' END, CASE WHEN p_partkey % 3 = 0 THEN 'high_priority' END, CASE WHEN p_size / 50.0 < 0.8 THEN 'grounding_below_0.8' END) AS reasons FROM part""")
def review_reasons(spark, d):
    why = E.review_reasons(F.col("p_size") == 7, _pick(("HIGH", "LOW", "MEDIUM"), _mod("p_partkey", 3)), F.col("p_size") / 50.0)
    return read(spark, d, "part").select("p_partkey", F.array_join(why, ",").alias("reasons"))


@add("""SELECT (SELECT count(*) FROM orders) AS alerts, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS active, (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '1%') AS critical, count(*) AS insights,
count(*) FILTER (p_size % 4 < 2) AS high, count(*) FILTER (p_size > 40) AS to_review, count(*) FILTER (p_partkey % 5 = 0) AS linked FROM part""")
def dashboard_counts(spark, d):
    alerts = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"), F.when(F.col("o_orderpriority").startswith("1"), "CRITICAL").alias("severity"))
    linked = F.when(_mod("p_partkey", 5) == 0, F.array("p_partkey")).otherwise(F.array().cast("array<bigint>"))
    return E.dashboard_counts(alerts, read(spark, d, "part").select(_pick(("HIGH", "CRITICAL", "LOW", "MEDIUM"), _mod("p_size", 4)).alias("priority"), (F.col("p_size") > 40).alias("review"), linked.alias("linked")))


@add("""SELECT l_suppkey AS "group", count(*) AS n, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at, round(avg(sqrt(l_extendedprice)), 4) AS score, count(DISTINCT (l_returnflag, least(l_linenumber, l_partkey % 3), greatest(l_linenumber, l_partkey % 3), l_linestatus)) AS n_evidence FROM lineitem GROUP BY 1""")
def duplicate_records(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_suppkey", "group")
    proof = li.select("group", F.col("l_returnflag").alias("kind"), F.array(F.col("l_linenumber").cast("long"), _mod("l_partkey", 3)).alias("ids"), F.col("l_linestatus").alias("value"))
    return E.group_records(li.select("group", F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts")), li.select("group", F.sqrt("l_extendedprice").alias("score")), proof)


@add("""WITH x AS (SELECT l_suppkey, CASE WHEN l_linenumber = 2 THEN 0 ELSE sqrt(l_quantity) END AS a, sqrt(l_extendedprice) AS b, CASE l_partkey % 40 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 6 END AS w FROM lineitem)
SELECT l_suppkey, round(avg(a), 4) AS words, round(avg(b), 4) AS place, ['conflict', 'ambiguous', 'missing', 'nearby', 'exact', 'missing'][min(w)] AS state FROM x GROUP BY 1""")
def pair_summaries(spark, d):
    pairs = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") != 2, F.sqrt("l_quantity")).alias("words"), F.sqrt("l_extendedprice").alias("place"), _pick((*E.LOCATION_STATES, "odd"), F.least(F.lit(5), _mod("l_partkey", 40))).alias("state"))
    return E.pair_summary(pairs, "l_suppkey", ["words", "place"], "state")


@add("""WITH x AS (SELECT l_orderkey, l_partkey, ['conflict', 'ambiguous', 'missing', 'nearby', 'exact'][l_linenumber % 5 + 1] AS s, l_returnflag = 'A' AS same, l_quantity * 3 AS h, l_tax * 12 AS sem, l_discount AS ent FROM lineitem)
SELECT l_orderkey, l_partkey, concat_ws(',', CASE WHEN s = 'conflict' THEN 'LOCATION_MISMATCH' END, CASE WHEN s IN ('ambiguous', 'missing') THEN 'LOCATION_AMBIGUOUS' END, CASE WHEN NOT same THEN 'REQUEST_TYPE_MISMATCH' END, CASE WHEN h > 72 THEN 'TIME_WINDOW_TOO_WIDE' END,
CASE WHEN sem >= 0.78 AND ent = 0 AND s IN ('ambiguous', 'missing') THEN 'SEMANTIC_ONLY_MATCH' END) AS flags FROM x""")
def pair_flags(spark, d):
    state = _pick(E.LOCATION_STATES, _mod("l_linenumber", 5))
    flags = E.pair_flags(state, F.col("l_returnflag") == "A", F.col("l_quantity") * 3, F.col("l_tax") * 12, F.col("l_discount"), F.lit(0.1))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.array_join(flags, ",").alias("flags"))


@add(EV + """, x AS (SELECT user_id, department, ['safety_action', 'inquiry', 'repair', 'repair', 'repair'][CAST(id % 5 AS INT) + 1] AS kind, contains(coalesce(props, ''), '77') AS legal, id % 17 = 0 AS unsafe, id % 19 AS seg, id % 23 AS sig FROM ev)
SELECT user_id, concat_ws(',', CASE WHEN count(DISTINCT department) > 1 THEN 'DEPARTMENT_MISMATCH' END, CASE WHEN bool_or(kind = 'safety_action') AND bool_or(kind = 'inquiry') THEN 'SAFETY_AND_INCONVENIENCE_MIXED' END,
CASE WHEN bool_or(legal) THEN 'LEGAL_RIGHTS_OR_DEADLINE_RISK' END, CASE WHEN bool_or(unsafe) THEN 'PII_RISK' END, CASE WHEN max(seg) > 1 THEN 'MULTI_INTENT_SEGMENTS' END, CASE WHEN min(sig) < 3 THEN 'LOW_EVIDENCE' END) AS flags FROM x GROUP BY user_id""")
def group_flags(spark, d):
    kinds = _pick(("safety_action", "inquiry", "repair", "repair", "repair"), _mod("id", 5))
    e = _events(spark, d).select("user_id", "department", kinds.alias("kind"), F.col("props").alias("text"), (_mod("id", 17) == 0).alias("unsafe"), _mod("id", 19).alias("n_segments"), _mod("id", 23).alias("n_signals"))
    return E.group_flags(e, "user_id", ["77"]).withColumn("flags", F.array_join("flags", ","))


@add("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, 0.35 * least((o_orderkey % 9) / 8.0::DOUBLE, 1) + 0.25 * least(sqrt(o_totalprice) / 1200.0, 1) + 0.15 * least((o_orderkey % 8) / 6.0::DOUBLE, 1)
+ 0.15 * least(1.0, length(o_orderpriority) / 80.0::DOUBLE * 0.6 + CASE WHEN contains(o_orderpriority, 'HIGH') THEN 1.0 ELSE 0.4 END * 0.4) + 0.10 * least((o_orderkey % 6) / 4.0::DOUBLE, 1) - CASE WHEN o_orderkey % 10 = 0 THEN 0.15 ELSE 0 END AS q FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY q DESC, o_orderdate, o_orderkey) AS n FROM x) SELECT o_custkey, o_orderkey, round(q::DOUBLE, 4) AS quality FROM r WHERE n = 1""")
def group_representatives(spark, d):
    k = lambda n: _mod("o_orderkey", n)
    q = E.record_quality(k(9), F.sqrt("o_totalprice") / 2, k(8), E.request_specificity(F.col("o_orderpriority"), ["HIGH"]), k(6), k(10) == 0)
    return E.best_records(read(spark, d, "orders").withColumn("quality", q), "o_custkey", "quality", "o_orderdate", "o_orderkey")


@add("""WITH r AS (SELECT l_partkey AS ref, l_orderkey AS id FROM lineitem WHERE l_returnflag <> 'R' UNION SELECT l_partkey // 2, l_orderkey FROM lineitem WHERE l_returnflag <> 'R'), i AS (SELECT ref, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS ids FROM r GROUP BY ref),
g AS (SELECT l_partkey AS ref, string_agg(l_linestatus, ',' ORDER BY l_linestatus) AS reasons FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT p_partkey AS ref, CAST(coalesce(n, 0) AS INT) AS n_ids, coalesce(ids, '') AS ids, coalesce(reasons, '') AS reasons FROM part LEFT JOIN i ON i.ref = p_partkey LEFT JOIN g ON g.ref = p_partkey""")
def target_coverage(spark, d):
    li = read(spark, d, "lineitem")
    rel = li.select(_s("l_orderkey").alias("id"), F.array(F.col("l_partkey"), F.expr("l_partkey div 2")).alias("refs"), (F.col("l_returnflag") != "R").alias("ok"))
    gaps = li.where("l_quantity > 45").select(F.col("l_partkey").alias("ref"), F.col("l_linestatus").alias("reason"))
    return E.target_coverage(read(spark, d, "part").select(F.col("p_partkey").alias("ref")), rel, gaps)


@add("""SELECT l_linenumber, l_returnflag, count(*) % 5 AS recall, count(*) % 3 AS mrr, sum(l_quantity) AS latency FROM lineitem GROUP BY ALL ORDER BY recall DESC, mrr DESC, latency LIMIT 1""")
def best_combination(spark, d):
    own = read(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg((F.count("*") % 5).alias("recall"), (F.count("*") % 3).alias("mrr"), F.sum("l_quantity").alias("latency"))
    return E.best_combination(own, "recall", "mrr", "latency")


@add("""WITH x AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', substr(sha256(source), 1, 12) FROM documents WHERE trim(source) <> ''), c AS (SELECT field, value, count(*) AS n FROM x WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS INT) AS rank FROM c)
SELECT field, value, n, rank FROM r WHERE rank <= 5""")
def top_field_values(spark, d):
    return E.top_values(read(spark, d, "documents").select("lang", "source"), ["lang", "source"], 5, hidden=["source"])


@add("""SELECT l_partkey AS key, min(l_returnflag) AS body FROM lineitem WHERE l_quantity > 40 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1""")
def missing_required_rows(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("body"), "l_quantity", "l_linenumber")
    return E.missing_rows(li.where("l_quantity > 40"), li.where("l_linenumber = 1"), "key", "body")


@add("""WITH r AS (SELECT o_orderkey AS id, unnest([o_custkey, o_custkey + 1]) AS ref FROM orders WHERE o_orderkey % 7 <> 0) SELECT o_orderkey AS id, coalesce(u, false) AS used FROM orders LEFT JOIN (SELECT id, bool_or(c_custkey IS NULL OR c_nationkey < 4) AS u FROM r LEFT JOIN customer ON c_custkey = ref GROUP BY id) x ON x.id = o_orderkey""")
def changed_assessments(spark, d):
    refs = F.when(_mod("o_orderkey", 7) != 0, F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).otherwise(F.array().cast("array<bigint>"))
    known = read(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_nationkey").alias("version"))
    return E.uses_version(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), refs.alias("refs")), known, read(spark, d, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("version")))


@add("""WITH k AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS rep, p_partkey FROM part WHERE p_size IN (SELECT s_suppkey FROM supplier) AND p_size // 2 + 1 IN (SELECT s_suppkey FROM supplier)) SELECT rep, CAST(min(p_partkey) AS VARCHAR) AS id FROM k GROUP BY rep""")
def available_rows(spark, d):
    p = read(spark, d, "part")
    rows = p.select(_s("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.array(F.col("p_size").cast("long"), F.expr("p_size div 2 + 1")).alias("needs"))
    return E.available_rows(rows, p.where("p_partkey % 4 = 0").select(_s("p_partkey").alias("id"), F.col("p_brand").alias("rep")), read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@add("""WITH x AS (SELECT o_orderkey, o_orderkey % 13 + 1 AS m FROM orders) SELECT o_orderkey, CASE WHEN m <= 12 THEN '2024-' || lpad(CAST(m AS VARCHAR), 2, '0') END AS month, '1234' || CASE WHEN m % 2 = 0 THEN '.5' ELSE '' END AS number, CASE WHEN m % 3 = 0 THEN '명' END AS unit,
CASE WHEN m % 2 = 1 THEN '1234' END AS whole, CASE WHEN m <= 12 THEN '2023-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-09' END AS day, CASE WHEN m % 2 = 0 THEN 'true' END AS truth FROM x""")
def strict_literals(spark, d):
    m = _mod("o_orderkey", 13) + 1
    two = F.lpad(m.cast("string"), 2, "0")
    number = F.concat(F.lit(" 1,234"), F.when(m % 2 == 0, ".5").otherwise(""), F.when(m % 3 == 0, " 명").otherwise(""))
    value = lambda text, kind: E.literal(text, kind)["value"]
    return read(spark, d, "orders").select(
        "o_orderkey", value(F.concat(F.lit("2024"), _pick(("", "-", "."), m % 3), two), "month").alias("month"), value(number, "number").alias("number"), E.literal(number, "number")["unit"].alias("unit"), value(number, "integer").alias("whole"),
        value(F.concat(F.lit("2023."), two, F.lit("/09")), "date").alias("day"), value(F.when(m % 2 == 0, "True").otherwise("yes"), "boolean").alias("truth"),
    )


@add("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size END AS a, CASE WHEN p_size % 4 > 0 THEN p_size % 7 END AS b, CASE WHEN p_size % 2 > 0 THEN 2 END AS c FROM part), y AS (SELECT p_partkey, unnest([a, b, c]) AS v FROM x) SELECT p_partkey, CAST(floor(avg(v)) AS INT) AS score FROM y GROUP BY 1""")
def floor_means(spark, d):
    size = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", E.floor_mean(F.when(size % 3 > 0, size), F.when(size % 4 > 0, size % 7), F.when(size % 2 > 0, 2)).alias("score"))


@add("""SELECT count(*) AS n_cases, round(avg(sqrt(c_acctbal + 1000)), 2) AS mean_overall, round(avg(CASE WHEN c_custkey % 2 = 0 THEN sqrt(c_custkey + 1) END), 2) AS mean_context, (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') || '=' || count(*) AS x FROM customer GROUP BY coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown'))) AS levels FROM customer""")
def report_summary(spark, d):
    cases = read(spark, d, "customer").select(F.sqrt(F.col("c_acctbal") + 1000).alias("overall"), F.when(_mod("c_custkey", 2) == 0, F.sqrt(F.col("c_custkey") + 1)).alias("context"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("level"))
    return E.report_summary(cases, ["overall", "context"], "level")


@add("""WITH RECURSIVE t AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ') || [trim(left(p_name, 4)), p_brand, 'Brand', 'x']) AS term, unnest([3.0, 2.4, 1.8, 2.4, 1.8, 3.0]) AS w FROM part), b AS (SELECT id, term, max(w) AS w FROM t WHERE length(term) >= 2 AND term <> 'ring' GROUP BY ALL), r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY w DESC, length(term) DESC, term) AS n FROM b),
f AS (SELECT id, 1 AS n, [term] AS got FROM r WHERE n = 1 UNION ALL SELECT f.id, f.n + 1, CASE WHEN len(got) < 3 AND len(list_filter(got, lambda g: contains(g, r.term))) = 0 THEN list_append(got, r.term) ELSE got END FROM f JOIN r ON r.id = f.id AND r.n = f.n + 1)
SELECT id, array_to_string(arg_max(got, n), ',') AS terms FROM f GROUP BY id""")
def ranked_key_terms(spark, d):
    p = read(spark, d, "part")
    words = F.split("p_name", " ")
    pair = lambda t, w: F.struct(t.alias("term"), F.lit(w).alias("weight"))
    listed = F.array(pair(F.get(words, 0), 3.0), pair(F.get(words, 1), 2.4), pair(F.left(F.col("p_name"), F.lit(4)), 1.8), pair(F.col("p_brand"), 2.4), pair(F.lit("Brand"), 1.8), pair(F.lit("x"), 3.0))
    out = E.ranked_terms(p.select(F.col("p_partkey").alias("id"), F.explode(listed).alias("x")).select("id", "x.*"), "id", ["ring"], limit=3)
    return out.withColumn("terms", F.array_join("terms", ","))


@add("""SELECT p_partkey, 'https://www.law.go.kr/' || CASE WHEN p_size % 2 = 0 THEN url_encode('자치법규') ELSE '' END || 'x/' || replace(p_name, ' ', '%20') || CASE WHEN p_size % 3 = 0 THEN '/' || p_size ELSE '' END AS url FROM part""".replace("url_encode('자치법규')", "'자치법규'").replace("ELSE '' END || 'x/'", "ELSE '법령' END || '/'"))
def law_urls(spark, d):
    return read(spark, d, "part").select("p_partkey", E.law_url(F.concat(F.col("p_name"), F.lit(" ")), F.when(_mod("p_size", 3) == 0, _s("p_size")), _mod("p_size", 2) == 0).alias("url"))


@add("""WITH x AS (SELECT p_partkey, p_name || ' 도로법 제 ' || p_size || ' 조의 02, ' || repeat('z', 60) || ' 제' || p_partkey || '조, 주택시행령 제7조' AS text FROM part), y AS (SELECT *, length(text) AS n FROM x)
SELECT p_partkey, '도로법|제' || CAST(size AS VARCHAR) || '조의2|' || CAST(length(p_name) + 1 AS VARCHAR) || ';|제' || CAST(p_partkey AS VARCHAR) || '조|' || CAST(strpos(text, '제' || p_partkey || '조, ') - 1 AS VARCHAR) || ';' || tail AS cited,
replace(replace(text, '도로법 제 ' || size || ' 조의 02', '[미검증 인용 제거]'), '제' || p_partkey || '조, ', '[미검증 인용 제거], ') AS cleaned FROM (SELECT y.*, p.p_size AS size, p.p_name, '주택시행령|제7조|' || CAST(n - length('주택시행령 제7조') AS VARCHAR) AS tail FROM y JOIN part p USING (p_partkey))""")
def legal_citations(spark, d):
    # A file of few bytes is read by one task; the work on each row is not small
    p = read(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    text = F.concat(F.col("p_name"), F.lit(" 도로법 제 "), _s("p_size"), F.lit(" 조의 02, " + "z" * 60 + " 제"), _s("p_partkey"), F.lit("조, 주택시행령 제7조"))
    own = p.select("p_partkey", text.alias("text")).withColumn("c", E.legal_citations(F.col("text"), ["도로법", "없는 법"]))
    shown = F.transform("c", lambda x: F.concat_ws("|", x["law"], x["article"], x["start"].cast("string")))
    return own.select("p_partkey", F.array_join(shown, ";").alias("cited"), E.without_spans(F.col("text"), F.filter("c", lambda x: ~x["law"].contains("시행령"))).alias("cleaned"))


LEXICON = {"red": ["ring", "small", "bolt"], "big": ["large"], "odd": ["gear", "small", "small", "ring", "bolt", "nut"]}


@add("""WITH x AS (SELECT p_partkey, p_name, list_filter(['ring', 'small', 'bolt'], lambda w: contains(p_name, w)) AS a, list_filter(['large'], lambda w: contains(p_name, w)) AS b, list_filter(['gear', 'small', 'ring', 'bolt', 'nut'], lambda w: contains(p_name, w)) AS c FROM part),
y AS (SELECT p_partkey, unnest([0, 1, 2]) AS i, unnest(['red', 'big', 'odd']) AS name, unnest([a, b, c]) AS m FROM x), r AS (SELECT *, round(least(0.9, 0.45 + 0.15 * len(m)), 2) AS f FROM y WHERE len(m) > 0), t AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY f DESC, len(m[1:3]) DESC, i) AS n FROM r)
SELECT p.p_partkey, coalesce(s, '') AS refs FROM part p LEFT JOIN (SELECT p_partkey, string_agg(name || ':' || array_to_string(m[1:3], '+'), ',' ORDER BY n) AS s FROM t WHERE n <= 2 GROUP BY 1) z USING (p_partkey)""")
def lexicon_refs(spark, d):
    refs = E.lexicon_refs(F.col("p_name"), LEXICON, top=2)
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(refs, lambda x: F.concat(x["name"], F.lit(":"), F.array_join(x["evidence"], "+"))), ",").alias("refs"))


@add("""WITH x AS (SELECT p_partkey, p_name, CASE WHEN contains(replace(p_name, 'small ring', ''), 'ring') THEN 'ring' WHEN contains(p_name, 'bolt') THEN 'bolt' END AS s, CASE WHEN contains(p_name, 'small') THEN 'small' END AS t FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN s IS NOT NULL AND contains(p_name, 'bolt') THEN 'bolt' END, CASE WHEN t IS NOT NULL THEN 'tiny' END) AS objects, CASE WHEN contains(p_name, 'small') THEN 0.85::DOUBLE END AS tiny FROM (SELECT p_partkey, p_name, CASE WHEN contains(p_name, 'bolt') THEN 'bolt' END AS s, t FROM x)""")
def canonical_objects(spark, d):
    objects = E.canonical_objects(F.col("p_name"), {"tiny": ["ring of none", "small"], "bolt": ["bolt"], "none": ["ring"]}, {"ring": "ring"})
    tiny = F.try_element_at(F.filter(objects, lambda x: x["text"] == "tiny"), F.lit(1))["confidence"]
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(objects, lambda x: x["text"]), ",").alias("objects"), tiny.alias("tiny"))


@add("""WITH s AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'fire' END, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 1 THEN 'gas leak' END, CASE WHEN o_orderkey % 2 = 0 THEN 'fire' END], lambda x: x IS NOT NULL) AS l, (CAST(o_orderkey % 2 = 0 AS INT) + CAST(contains(o_orderpriority, 'HIGH') AS INT)) / 4.0 AS h, CASE WHEN o_orderkey % 11 = 0 THEN '높음' END AS f FROM orders),
u AS (SELECT *, len(list_distinct(l)) AS n FROM s), b AS (SELECT *, CASE WHEN n >= 2 THEN '높음' WHEN n > 0 OR h > 0 THEN '보통' ELSE '낮음' END AS base FROM u)
SELECT o_orderkey, CAST(n AS INT) AS n_signals, round(h::DOUBLE, 4) AS hazards, base, CASE WHEN n >= 2 THEN '긴급' WHEN f IS NOT NULL THEN f ELSE base END AS level FROM b""")
def urgency_levels(spark, d):
    k = lambda n: _mod("o_orderkey", n)
    text = F.concat(F.when(k(2) == 0, "a fire now; ").otherwise(""), F.when(k(3) == 0, "gas  leak").otherwise(""), F.when(k(4) == 1, " not seen ").otherwise(" "), F.lit("far too far away, "), F.col("o_orderpriority"))
    own = read(spark, d, "orders").select("o_orderkey", F.regexp_replace(text, "  ", " ").alias("text"))
    signals = E.danger_signals(F.col("text"), ["fire", r"gas\s*leak", "fi.e"], r"not\s*seen")
    hazards = E.share_of_words(F.col("text"), ["fire", "HIGH"], 4)
    base, level = E.urgency(signals, hazards, F.when(k(11) == 0, "높음"))
    return own.select("o_orderkey", F.size(signals).alias("n_signals"), F.round(hazards, 4).alias("hazards"), base.alias("base"), level.alias("level"))


@add("""WITH x AS (SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_nationkey * 6 END AS h, CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END AS l, c_custkey % 4 = 0 AS z FROM customer), y AS (SELECT *, CASE WHEN h <= 24 THEN 2 WHEN h <= 72 THEN 1 WHEN h IS NOT NULL THEN 0 ELSE l END AS p FROM x)
SELECT c_custkey, ['보통', '급함', '매우급함'][least(2, p + CAST(z AS INT)) + 1] AS priority FROM y""")
def category_priorities(spark, d):
    level = F.when(F.col("c_mktsegment") == "BUILDING", "Critical").when(F.col("c_mktsegment") == "HOUSEHOLD", "high").otherwise("low")
    return read(spark, d, "customer").select("c_custkey", E.sla_priority(F.when(F.col("c_nationkey") < 20, F.col("c_nationkey") * 6), level, _mod("c_custkey", 4) == 0).alias("priority"))


@add("""SELECT event_id, round(1 / (1 + exp(-CASE WHEN event_id % 9 = 0 THEN 0 ELSE sqrt(value + 1) - 5 END)), 4) AS score, CASE event_id % 5 WHEN 0 THEN 0.35 WHEN 1 THEN 0.85 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 ELSE 0.25 END::DOUBLE AS stated,
CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 32400 AS local_epoch, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS utc_epoch FROM events""")
def scores_and_times(spark, d):
    e = read(spark, d, "events").select("event_id", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    raw = F.when(_mod("event_id", 9) == 0, F.lit(float("inf"))).otherwise(F.sqrt(F.col("value") + 1) - 5)
    return e.select("event_id", E.sigmoid(raw).alias("score"), E.stated_confidence(_pick((" Low", "high", "?", "7", "0.25"), _mod("event_id", 5))).alias("stated"), E.epoch_of(F.col("t")).alias("local_epoch"), E.epoch_of(F.concat("t", F.lit("Z"))).alias("utc_epoch"))


@add("""WITH x AS (SELECT l_orderkey, l_partkey, l_quantity, ['SAFETY_RISK_SIGNAL', 'HOTSPOT_RESPONSE_REQUIRED', 'PROCESS_DELAY_RISK', 'OTHER'][l_partkey % 4 + 1] AS k, l_linenumber % 2 = 0 AS linked, l_discount AS dis, sqrt(l_extendedprice) AS e FROM lineitem),
s AS (SELECT *, round(0.25 * least(1, l_quantity / 30.0::DOUBLE) + 0.2 * least(1, e / 200 / 3.0::DOUBLE) + 0.2 * CAST(k IN ('SAFETY_RISK_SIGNAL', 'HOTSPOT_RESPONSE_REQUIRED') AS INT) + 0.15 * least(1, l_quantity / 40.0::DOUBLE) + 0.1 * least(1, dis / 0.06::DOUBLE) + 0.1 * CAST(k = 'PROCESS_DELAY_RISK' AS INT), 6) AS score FROM x),
p AS (SELECT *, CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS pr FROM s)
SELECT l_orderkey, l_partkey, l_quantity, score, CASE WHEN k = 'SAFETY_RISK_SIGNAL' AND linked AND pr IN ('LOW', 'MEDIUM') THEN 'HIGH' WHEN k IN ('SAFETY_RISK_SIGNAL', 'HOTSPOT_RESPONSE_REQUIRED') AND pr = 'LOW' THEN 'MEDIUM' ELSE pr END AS priority FROM p""")
def insight_priorities(spark, d):
    kind = _pick(("SAFETY_RISK_SIGNAL", "HOTSPOT_RESPONSE_REQUIRED", "PROCESS_DELAY_RISK", "OTHER"), _mod("l_partkey", 4))
    score, priority = E.insight_priority(F.col("l_quantity"), F.sqrt("l_extendedprice") / 200, kind, F.col("l_quantity"), F.col("l_discount"), _mod("l_linenumber", 2) == 0, {"count": 30, "repeat": 40, "regional": 0.06})
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", score.alias("score"), priority.alias("priority"))


@add("""WITH x AS (SELECT o_orderkey, o_orderkey % 3 AS kept, o_orderkey % 6 AS removed, o_orderkey % 3 AS sup, 3 AS drafted, sqrt(o_totalprice) / 1000 AS c FROM orders), g AS (SELECT *, round(greatest(0, 1 - (CASE WHEN kept = 0 THEN 0.5 ELSE 0 END + least(0.35, 0.1 * removed) + 0.2 * (1 - sup / 3.0::DOUBLE)))::DOUBLE, 4) AS grounding FROM x)
SELECT o_orderkey, grounding, round((0.35 * c + 0.25 * least(1, kept / 2.0::DOUBLE) + 0.2 * grounding + 0.1 * CASE WHEN removed > 2 THEN 1 ELSE 0.7 END + 0.1 * least(1, greatest(kept, 1) / 3.0::DOUBLE)) * CASE WHEN grounding < 0.6 THEN 0.7 ELSE 1 END, 4) AS confidence FROM g""")
def insight_confidences(spark, d):
    k = lambda n: _mod("o_orderkey", n)
    own = read(spark, d, "orders").withColumn("grounding", E.grounding_score(k(3), k(6), k(3), F.lit(3)))
    return own.select("o_orderkey", "grounding", E.insight_confidence(F.sqrt("o_totalprice") / 1000, k(3) / 2.0, F.col("grounding"), k(3), k(6) > 2).alias("confidence"))


@add("""WITH RECURSIVE h AS (SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 6 > 0 THEN 30 + o_orderkey % 90 END AS len FROM orders),
f AS (SELECT DISTINCT qid, 0::BIGINT AS n, 0 AS kept, 0::BIGINT AS used, 0 AS cut, false AS full_ FROM h UNION ALL SELECT qid, n, kept + CAST(t AS INT), used + CASE WHEN t THEN least(len, room) ELSE 0 END, cut + CAST(t AND len > room AS INT), fl FROM (SELECT *, len IS NOT NULL AND kept < 4 AND NOT fl AS t FROM (SELECT h.qid, h.n, h.len, kept, used, cut, full_ OR (h.len IS NOT NULL AND kept < 4 AND 260 - used < 40) AS fl, least(100, greatest(40, 260 - used - 40 * greatest(0, 3 - kept))) AS room FROM f JOIN h ON h.qid = f.qid AND h.n = f.n + 1)))
SELECT f.qid, f.kept AS n_kept, CAST(f.used AS INT) AS used, f.cut AS n_cut, m - f.kept AS n_dropped FROM f JOIN (SELECT qid, max(n) AS m FROM h GROUP BY qid) x ON x.qid = f.qid AND f.n = x.m""")
def packed_contexts(spark, d):
    snippet = F.when(_mod("o_orderkey", 6) > 0, F.expr("repeat('w', int(30 + o_orderkey % 90))"))
    hits = read(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("pos"), _s("o_orderkey").alias("chunk_id"), _s("o_custkey").alias("case_id"), snippet.alias("snippet"))
    return E.packed_context(hits, top_k=4, budget=260, most_chars=100)


@add("""WITH x AS (SELECT p_partkey, p_name || '①' || p_brand || CASE WHEN p_size % 2 = 0 THEN '②' || p_type ELSE '' END AS text, length(p_name) AS a, length(p_name) + 1 + length(p_brand) AS b, p_size % 2 = 0 AS two FROM part)
SELECT p_partkey, unnest(CASE WHEN two THEN [0, a, b] ELSE [0] END)::INT AS start, unnest(CASE WHEN two THEN [text[1:a], text[a + 1:b], text[b + 1:]] ELSE [text] END) AS body, unnest(CASE WHEN two THEN [false, true, true] ELSE [true] END) AS is_target FROM x""")
def circled_clauses(spark, d):
    text = F.concat(F.col("p_name"), F.lit("①"), F.col("p_brand"), F.when(_mod("p_size", 2) == 0, F.concat(F.lit("②"), F.col("p_type"))).otherwise(""))
    return read(spark, d, "part").select("p_partkey", F.explode(E.circled_clauses(text)).alias("x")).select("p_partkey", "x.*")


@add("""WITH x AS (SELECT p_brand, p_partkey, sqrt(p_size) / 8 AS c, p_size > 45 AS s, unnest(list_filter([CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'bolt') THEN 'metal' END, CASE WHEN contains(p_name, 'small') THEN 'size' END], lambda v: v IS NOT NULL)) AS aspect FROM part), t AS (SELECT p_brand, count(*) AS t FROM part GROUP BY 1)
SELECT p_brand, aspect, count(*) AS n, round(0.7 * avg(c) + 0.2 * count(*) / max(t)::DOUBLE + 0.1 * CAST(bool_or(s) AS INT), 4) AS confidence FROM x JOIN t USING (p_brand) GROUP BY ALL""")
def group_aspects(spark, d):
    rows = read(spark, d, "part").select("p_brand", "p_partkey", "p_name", (F.sqrt("p_size") / 8).alias("c"), (F.col("p_size") > 45).alias("s"))
    return E.aspects(rows, "p_brand", "p_partkey", "p_name", "c", "s", {"metal": ["ring", "bolt"], "size": ["small"]})


@add("SELECT doc_id, quality, toxic, sha256(text) AS text_sha FROM labels JOIN documents USING (doc_id) WHERE trim(text, ' ') <> ''")
def labelled_records(spark, d):
    out = E.labelled_records(read(spark, d, "labels"), read(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", "quality", "toxic", F.sha2("text", 256).alias("text_sha"))


@add("""SELECT p_partkey, '{' || CASE WHEN p_size > 3 THEN '"size":' || p_size || ',' ELSE '' END || '"names":"' || replace(p_name, ' ', '|') || '","brand":"' || p_brand || '"}' AS metadata FROM part""")
def flat_metadata(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_size")).alias("size"), F.split("p_name", " ").alias("names"), F.col("p_brand").alias("brand"))
    return E.flat_metadata(p, "p_partkey")
