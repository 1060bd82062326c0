"""Queries of versioned claims, citations, groups and evaluation statistics over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..operators import windows as W
from .base import Registry, read
from .event_queries import _events

REGISTRY = Registry()
add = REGISTRY.add


def _li(spark, d, *cols):
    return read(spark, d, "lineitem").select(*cols)


@add("""WITH o AS (SELECT DISTINCT o_custkey AS s, sha256(o_orderpriority || o_orderstatus) AS v FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT DISTINCT o_custkey AS s, sha256(o_orderpriority || o_orderstatus) AS v FROM orders WHERE o_orderkey % 2 = 1)
SELECT n.s AS source_id, n.v AS version_id FROM n LEFT JOIN o ON o.s = n.s AND o.v = n.v WHERE o.s IS NULL""")
def registered_versions(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.concat("o_orderpriority", "o_orderstatus").alias("content"), F.col("o_orderkey"))
    return K.registered(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")).select("source_id", "version_id")


@add("""SELECT c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS snapshot, CAST(c_custkey % 5 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS revision, c_custkey % 3 = 0 AS switched FROM customer""")
def activated_snapshots(spark, d):
    c = read(spark, d, "customer")
    now = c.select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("snapshot"), (F.col("c_custkey") % 5).alias("revision"))
    asked = c.where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("name"), (F.col("c_nationkey") + 100).alias("target"), (F.col("c_custkey") % 5 + F.col("c_custkey") % 3).alias("expected"))
    return K.activated(now, asked)


@add("""WITH h AS (SELECT l_orderkey AS target, CAST(l_linenumber AS BIGINT) AS revision, l_returnflag AS state FROM lineitem WHERE l_orderkey % 2 = 0), t AS (SELECT o_orderkey AS target, o_orderstatus AS state FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM h UNION ALL SELECT t.target, coalesce(m, 0) + 1, state FROM t LEFT JOIN (SELECT target, max(revision) AS m FROM h GROUP BY target) USING (target)""")
def availability_history(spark, d):
    h = _li(spark, d, F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("revision"), F.col("l_returnflag").alias("state")).where("target % 2 = 0")
    t = read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("target"), F.col("o_orderstatus").alias("state"))
    return K.status_history(h, t)


@add("""WITH b AS (SELECT p_partkey AS id, p_name AS body, 'live' AS state FROM part), c AS (SELECT p_partkey + CASE WHEN p_partkey % 8 = 0 THEN 1000000000 ELSE 0 END AS id, ['upsert', 'deprecate', 'merge'][CAST(p_partkey % 3 AS INT) + 1] AS op, 'new ' || p_brand AS nb FROM part WHERE p_partkey % 4 = 0)
SELECT id, CASE WHEN op = 'upsert' THEN nb ELSE body END AS body, CASE op WHEN 'upsert' THEN 'live' WHEN 'deprecate' THEN 'deprecated' WHEN 'merge' THEN 'merged' ELSE state END AS state FROM b FULL OUTER JOIN c USING (id) WHERE body IS NOT NULL OR op = 'upsert'""")
def projected_items(spark, d):
    p = read(spark, d, "part")
    base = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("body"), F.lit("live").alias("state"))
    op = F.array(*[F.lit(x) for x in ("upsert", "deprecate", "merge")])[(F.col("p_partkey") % 3).cast("int")]
    ident = F.col("p_partkey") + F.when(F.col("p_partkey") % 8 == 0, 1000000000).otherwise(0)
    return K.projected(base, p.where("p_partkey % 4 = 0").select(ident.alias("id"), op.alias("op"), F.concat(F.lit("new "), "p_brand").alias("body")))


@add("""WITH RECURSIVE bad AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 97 = 0 UNION SELECT n.id FROM (SELECT p_partkey AS id, p_partkey // 2 AS need FROM part WHERE p_partkey > 1) n JOIN bad ON n.need = bad.id)
SELECT p_partkey AS id FROM part WHERE p_partkey > 0 AND p_partkey NOT IN (SELECT id FROM bad)""")
def closed_candidates(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return K.closed_selection(p.where("id % 97 <> 0 and id > 0"), p.where("id > 1").select("id", F.expr("id div 2").alias("need")))


BUNDLES = "g AS (SELECT p_brand AS grp, p_partkey AS id FROM part WHERE p_size < 3 UNION ALL SELECT 'K' || p_partkey // 3, p_partkey FROM part WHERE p_size < 25)"


@add(f"""WITH RECURSIVE {BUNDLES}, r AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 1 UNION SELECT b.id FROM r JOIN g a ON a.id = r.id JOIN g b ON b.grp = a.grp) SELECT id FROM r""")
def complete_bundles(spark, d):
    p = read(spark, d, "part")
    groups = p.where("p_size < 3").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id")).unionByName(p.where("p_size < 25").select(F.concat(F.lit("K"), F.expr("p_partkey div 3").cast("string")).alias("group"), F.col("p_partkey").alias("id")))
    return K.bundles(p.where("p_partkey % 50 = 1").select(F.col("p_partkey").alias("id")), groups)


@add("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def dangling_references(spark, d):
    parts = read(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("id"))
    return K.missing_references(_li(spark, d, "l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@add("""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey * 10 + l_linenumber AS id, a.s IS NOT NULL AS valid FROM lineitem LEFT JOIN a ON a.s = l_suppkey AND a.p = l_partkey""")
def citation_validity(spark, d):
    li = _li(spark, d, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    cited = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit(" Act "), F.col("l_suppkey").cast("string")).alias("law"), F.concat(F.col("l_partkey").cast("string"), F.lit(" ")).alias("article"))
    known = li.where("l_returnflag = 'R'").select(F.concat(F.lit("act"), F.col("l_suppkey").cast("string")).alias("law"), F.col("l_partkey").alias("article"))
    return K.citation_checks(cited, known)


TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9가-힣]+'))"


@add(f"""WITH c AS (SELECT conv_id AS answer, text, conv_id * 3 + turn AS chunk FROM conversations), b AS (SELECT answer, {TOK.format('c.text')} AS a, {TOK.format('d.text')} AS t, d.doc_id IS NOT NULL AS found FROM c LEFT JOIN documents d ON d.doc_id = c.chunk)
SELECT answer, round(avg(CASE WHEN NOT found OR len(a) = 0 THEN 0 ELSE len(list_intersect(a, t)) / CAST(len(a) AS DOUBLE) END), 6) AS support, round(avg(CAST(found AS DOUBLE)), 4) AS coverage FROM b GROUP BY answer""")
def citation_support(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("answer"), "text", (F.col("conv_id") * 3 + F.col("turn")).alias("chunk_id"))
    return K.citation_support(c, read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


@add("""SELECT c_nationkey AS "group", string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS alerts FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1""")
def linked_alerts(spark, d):
    groups = read(spark, d, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("id"))
    alerts = read(spark, d, "orders").where("o_totalprice > 1000").select(F.col("o_orderpriority").alias("alert"), F.col("o_custkey").alias("id"))
    return K.linked_ids(groups, alerts).select("group", F.array_join("alerts", ",").alias("alerts"))


@add("""WITH l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber DESC, l_partkey DESC) AS ids FROM lineitem GROUP BY 1), u AS (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM l)
SELECT k AS order_id, string_agg(p_brand, ',' ORDER BY pos) AS brands FROM u JOIN part ON p_partkey = id WHERE p_size < 30 GROUP BY k""")
def events_in_order(spark, d):
    li = _li(spark, d, F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_partkey")
    lists = li.groupBy("order_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")), asc=False), lambda x: x["l_partkey"]).alias("ids"))
    rows = read(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return K.in_order(lists, rows, "order_id", "ids", "brand").select("order_id", F.array_join("values", ",").alias("brands"))


@add("""SELECT a.o_custkey AS "group", a.o_orderkey AS a, b.o_orderkey AS b, CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 1.0 ELSE 0.25 END::DOUBLE AS score FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey""")
def completed_pairs(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    one, two = o.withColumnRenamed("id", "a"), o.withColumnRenamed("id", "b")
    scored = one.join(two, ["group", "o_orderstatus"]).where("a < b").select("a", "b", F.lit(1.0).alias("score"))
    return K.completed_pairs(o.select("group", "id"), scored, F.lit(0.25))


VECTORS = "v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS p FROM v) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label), c AS (SELECT label, CAST(p AS INT) AS pos, round(m / n, 6) AS x FROM m JOIN n USING (label))"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))


@add(f"WITH {VECTORS} SELECT label, pos, x FROM c")
def average_vectors(spark, d):
    return K.mean_vector(_vectors(spark, d), "label")


@add(f"WITH {VECTORS}, k AS (SELECT label, list(x ORDER BY pos) AS mid FROM c GROUP BY label) SELECT label, round(avg(greatest(0, least(1, list_cosine_similarity(e, mid)))), 6) AS similarity FROM v JOIN k USING (label) GROUP BY label")
def centroid_similarity(spark, d):
    return K.centroid_similarity(_vectors(spark, d), "label")


@add("""WITH s AS (SELECT event_type AS department, props AS text, max(ts) AS ts, max_by(event_id, (epoch_us(ts), event_id)) AS id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT department, text, id, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY department ORDER BY ts DESC, id DESC) AS INT) AS rank FROM s) WHERE rank <= 3""")
def representative_texts(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("department"), F.col("props").alias("text"), "ts", F.col("event_id").alias("id"))
    return K.representatives(e, "department", 3).select("department", "text", "id", F.size("ids").cast("long").alias("n"), "rank")


FIRST = "t AS (SELECT conv_id, token, min((turn, p)) AS place FROM (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9가-힣]+') AS w FROM conversations)) GROUP BY ALL)"


@add(f"WITH {FIRST} SELECT conv_id, string_agg(token, ' ' ORDER BY place) AS phrases FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS r FROM t) WHERE r <= 12 GROUP BY conv_id")
def key_phrases(spark, d):
    return K.first_tokens(read(spark, d, "conversations"), "conv_id", "turn", "text", 12).select("conv_id", F.array_join("tokens", " ").alias("phrases"))


CATALOGUE = ["token", "License", "@", "|"]


@add("""WITH c AS (SELECT source, list_filter([CASE WHEN bool_or(contains(text, 'token')) THEN 'token' END, CASE WHEN bool_or(contains(text, 'License')) THEN 'License' END, CASE WHEN bool_or(contains(text, '@')) THEN '@' END, CASE WHEN bool_or(contains(text, '|')) THEN '|' END], lambda x: x IS NOT NULL)[1:2] AS w FROM (SELECT source || lang || doc_id % 40 AS source, text FROM documents) GROUP BY source),
f AS (SELECT source, token, count(*) AS n FROM (SELECT source || lang || doc_id % 40 AS source, unnest(regexp_extract_all(lower(text), '[a-z0-9가-힣]+')) AS token FROM documents) GROUP BY ALL),
t AS (SELECT source, string_agg(token, ' ' ORDER BY n DESC, token) AS w FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS r FROM f) WHERE r <= 2 GROUP BY source)
SELECT c.source, CASE WHEN len(c.w) > 0 THEN array_to_string(c.w, ' ') ELSE coalesce(t.w, '') END AS keywords FROM c LEFT JOIN t USING (source)""")
def group_keywords(spark, d):
    docs = read(spark, d, "documents").select(F.concat("source", "lang", (F.col("doc_id") % 40).cast("string")).alias("source"), "text")
    return K.catalogue_or_frequent(docs, "source", "text", CATALOGUE, 2).select("source", F.array_join("keywords", " ").alias("keywords"))


@add("""WITH q AS (SELECT o_custkey, avg(o_totalprice) / 1000 AS diff FROM orders GROUP BY 1), d AS (SELECT row_number() OVER (ORDER BY o_custkey) - 1 AS pos, round(diff - 150, 6) AS diff FROM q WHERE o_custkey <= 150), n AS (SELECT count(*) AS n, avg(diff) AS mean FROM d),
m AS (SELECT r, sum(diff) / any_value(n) AS m FROM (SELECT r, i, n, CAST('0x' || substr(md5('42-' || r || '-' || i), 1, 8) AS BIGINT) % n AS pos FROM n, range(0, 200) a(r), range(0, (SELECT n FROM n)) b(i)) JOIN d USING (pos) GROUP BY r)
SELECT round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m, n""")
def bootstrap_interval(spark, d):
    q = read(spark, d, "orders").where("o_custkey <= 150").groupBy("o_custkey").agg((F.avg("o_totalprice") / 1000).alias("x"))
    ids = q.agg(F.sort_array(F.collect_list("o_custkey")).alias("ids"))  # 150 queries at most
    own = q.join(F.broadcast(ids)).select((F.array_position("ids", F.col("o_custkey")) - 1).alias("pos"), F.round(F.col("x") - 150, 6).alias("diff"))
    return K.paired_bootstrap(own)


@add("""WITH p AS (SELECT l_orderkey AS c, CASE WHEN l_orderkey % 4 <> 0 THEN 'S' || l_orderkey % 7 END AS label, l_linenumber AS rank, 'S' || l_suppkey % 7 AS unit, l_discount * 10 AS conf FROM lineitem), o AS (SELECT c, max(label) AS label, min(CASE WHEN unit = label AND rank <= 3 THEN rank END) AS hit, max(conf) AS top FROM p GROUP BY c)
SELECT round(avg(CASE WHEN label IS NOT NULL THEN CAST(hit IS NOT NULL AS DOUBLE) END), 6) AS recall, round(avg(CASE WHEN label IS NOT NULL THEN coalesce(1.0::DOUBLE / hit, 0) END), 6) AS mrr, round(avg(CASE WHEN label IS NULL THEN CAST(top < 0.4 AS DOUBLE) END), 6) AS abstained FROM o""")
def unit_predictions(spark, d):
    li = _li(spark, d, "l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    tag = lambda c: F.concat(F.lit("S"), (F.col(c) % 7).cast("string"))
    p = li.select(F.col("l_orderkey").alias("case"), F.when(F.col("l_orderkey") % 4 != 0, tag("l_orderkey")).alias("label"), F.col("l_linenumber").alias("rank"), tag("l_suppkey").alias("unit"), (F.col("l_discount") * 10).alias("confidence"))
    return K.abstention(p, 3, 0.4)


@add("SELECT doc_id, lang FROM documents ORDER BY md5('s-' || doc_id) LIMIT 25")
def sampled_documents(spark, d):
    return K.hashed_sample(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25, "s")


@add("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s-' || doc_id)) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, d):
    return K.hashed_sample(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 5, "s", "lang")


@add("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, 0.1::DOUBLE AS c, l_quantity / 100 AS d FROM lineitem), t AS (SELECT *, a + b + c + d AS t FROM p)
SELECT l_orderkey, l_linenumber, round((a + 2 * b + 3 * c + 4 * d) / t, 6) AS expected, round(-(CASE WHEN a > 0 THEN a / t * ln(a / t) ELSE 0 END + CASE WHEN b > 0 THEN b / t * ln(b / t) ELSE 0 END + c / t * ln(c / t) + CASE WHEN d > 0 THEN d / t * ln(d / t) ELSE 0 END), 6) AS entropy FROM t""")
def option_distributions(spark, d):
    expected, entropy = K.distribution([F.col("l_discount"), F.col("l_tax"), F.lit(0.1), F.col("l_quantity") / 100])
    return _li(spark, d, "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity").select("l_orderkey", "l_linenumber", expected.alias("expected"), entropy.alias("entropy"))


@add("""WITH v AS (SELECT avg(quality)::DOUBLE AS quality, avg(toxic)::DOUBLE AS toxic, count(*)::DOUBLE AS n FROM labels), g AS (SELECT 'quality' AS gate, quality AS value, 0.2::DOUBLE AS bound, quality >= 0.2 AS passed FROM v UNION ALL SELECT 'toxic', toxic, 0.01::DOUBLE, toxic <= 0.01 FROM v UNION ALL SELECT 'n', n, 10::DOUBLE, n >= 10 FROM v)
SELECT gate, round(value, 6) AS value, bound, passed, (SELECT bool_and(passed) FROM g) AS all_passed FROM g""")
def quality_gates(spark, d):
    v = read(spark, d, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.count("*").alias("n"))
    return K.gates(v, [("quality", "least", 0.2), ("toxic", "most", 0.01), ("n", "least", 10)]).withColumn("value", F.round("value", 6))


@add("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_discount * 10 END AS a, CASE WHEN l_tax > 0 THEN l_tax * 10 END AS b, l_quantity / 50 AS c, l_discount * 5 AS d, l_linestatus = 'O' AS pending FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, (coalesce(a, 0) * 0.3::DOUBLE + coalesce(b, 0) * 0.3::DOUBLE + c * 0.25::DOUBLE + CASE WHEN pending THEN 0 ELSE d * 0.15::DOUBLE END) / CASE WHEN pending THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END + least(l_linenumber * 0.01::DOUBLE, 0.05))), 4) AS confidence FROM s""")
def confidence_scores(spark, d):
    li = _li(spark, d, "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
    a, b = F.when(F.col("l_returnflag") != "A", F.col("l_discount") * 10), F.when(F.col("l_tax") > 0, F.col("l_tax") * 10)
    parts = [(a, 0.3, None), (b, 0.3, None), (F.col("l_quantity") / 50, 0.25, None), (F.col("l_discount") * 5, 0.15, F.col("l_linestatus") == "O")]
    return li.select("l_orderkey", "l_linenumber", K.confidence(parts, F.col("l_linenumber") * 0.01, 0.05).alias("confidence"))


@add("""WITH o AS (SELECT o_custkey AS customer, l_suppkey % 20 AS s, max(l_discount) AS confidence, list_sort(list_distinct(list(l_returnflag || l_linestatus)))[1:2] AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT customer, name, confidence, evidence, rank FROM (SELECT customer, 'S' || s AS name, confidence, array_to_string(e, ',') AS evidence, CAST(row_number() OVER (PARTITION BY customer ORDER BY confidence DESC, 'S' || s) AS INT) AS rank FROM o) WHERE rank <= 4""")
def merged_candidates(spark, d):
    own = _li(spark, d, "l_orderkey", "l_suppkey", "l_discount", "l_returnflag", "l_linestatus").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer")), "l_orderkey")
    c = own.select("customer", F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("name"), F.col("l_discount").alias("confidence"), F.concat("l_returnflag", "l_linestatus").alias("evidence"))
    return K.merged_candidates(c, "customer", 4, 2).withColumn("evidence", F.array_join("evidence", ","))


HITS = "h AS (SELECT o_custkey AS qid, l_partkey AS docid, l_orderkey * 10 + l_linenumber AS chunk, l_discount AS score, l_linenumber % 3 AS grounding FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _hits(spark, d):
    own = _li(spark, d, "l_orderkey", "l_linenumber", "l_partkey", "l_discount").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("qid")), "l_orderkey")
    return own.select("qid", F.col("l_partkey").alias("docid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.col("l_discount").alias("score"), (F.col("l_linenumber") % 3).alias("grounding"))


@add(f"""WITH {HITS}, b AS (SELECT qid, docid, max(score) AS score FROM h GROUP BY ALL)
SELECT qid, docid, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM b) WHERE score >= 0.09 OR rank <= 2""")
def reranked_with_floor(spark, d):
    return K.with_floor(_hits(spark, d).groupBy("qid", "docid").agg(F.max("score").alias("score")), 0.09, 2)


@add(f"""WITH {HITS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, docid ORDER BY grounding DESC, score DESC, chunk) AS r FROM h) WHERE r = 1)
SELECT qid, docid, chunk, score, grounding, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY grounding DESC, score DESC, docid) AS INT) AS rank FROM f) WHERE rank <= 5""")
def final_search_results(spark, d):
    return K.final_results(_hits(spark, d), 5).select("qid", "docid", "chunk", "score", "grounding", "rank")


TOPICS = [("secret", ["token", "="]), ("licence", ["License", "Version"]), ("contact", ["@", ".com"])]


@add("""WITH s AS (SELECT doc_id, CAST(contains(text, 'token') AS INT) + CAST(contains(text, '=') AS INT) AS a, CAST(contains(text, 'License') AS INT) + CAST(contains(text, 'Version') AS INT) AS b, CAST(contains(text, '@') AS INT) + CAST(contains(text, '.com') AS INT) AS c FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b, c) < 2 THEN 'general' WHEN a >= b AND a >= c THEN 'secret' WHEN b >= c THEN 'licence' ELSE 'contact' END AS topic FROM s""")
def inferred_topics(spark, d):
    return read(spark, d, "documents").select("doc_id", K.infer_topic(F.col("text"), TOPICS, 2, "general").alias("topic"))


@add("""WITH n AS (SELECT d.doc_id, regexp_extract_all(c.text, '[0-9]+') AS a, regexp_extract_all(d.text, '[0-9]+') AS b FROM documents d JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = (SELECT min(turn) FROM conversations))
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS unsupported FROM n""")
def unsupported_numbers(spark, d):
    c = read(spark, d, "conversations")
    first = c.join(F.broadcast(c.agg(F.min("turn").alias("turn"))), "turn").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("claim"))
    own = read(spark, d, "documents").join(first, "doc_id")
    return own.select("doc_id", F.array_join(F.array_sort(K.unsupported_numbers(F.col("claim"), F.col("text"))), ",").alias("unsupported"))


@add("""WITH u AS (SELECT l_orderkey AS run, CASE WHEN l_linenumber % 7 = 6 THEN 'running' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS s FROM lineitem), n AS (SELECT run, count(*) FILTER (s = 'succeeded') AS succeeded, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'running') AS running, count(*) AS n FROM u GROUP BY run)
SELECT run, CASE WHEN running > 0 THEN 'running' WHEN failed = n THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'succeeded' END AS status, succeeded, failed, running FROM n""")
def run_roll_up(spark, d):
    status = F.when(F.col("l_linenumber") % 7 == 6, "running").when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded")
    return K.roll_up(_li(spark, d, F.col("l_orderkey").alias("run"), status.alias("status")), "run")


@add("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'plan' ELSE p_type END AS reason FROM part WHERE p_size > 10 OR p_partkey % 3 = 0")
def overlaid_exclusions(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("reason"), "p_size")
    return K.overlaid(p.where("p_size > 10").select("id", "reason"), p.where("id % 3 = 0").select("id", F.lit("plan").alias("reason")), ["id"])


@add("""WITH v AS (SELECT lang AS g, doc_id AS v, text FROM documents WHERE n_chars < 3000 AND doc_id % 3 = 0), q AS (SELECT doc_id AS id, lang AS g, substr(text, 11, 24) AS q FROM documents WHERE doc_id % 20 = 0),
h AS (SELECT id, v, position(q IN text) - 1 AS s, row_number() OVER (PARTITION BY id ORDER BY length(text), v) AS r FROM q JOIN v USING (g) WHERE position(q IN text) > 0)
SELECT q.id, h.v AS "view", CAST(h.s AS INT) AS "start" FROM q LEFT JOIN h ON h.id = q.id AND r = 1""")
def located_evidence(spark, d):
    docs = read(spark, d, "documents")
    views = docs.where("n_chars < 3000 and doc_id % 3 = 0").select(F.col("lang").alias("group"), F.col("doc_id").alias("view"), "text")
    quotes = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), F.substring("text", 11, 24).alias("quote"))
    return K.exact_evidence(quotes, views)


@add("""WITH b AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS block, count(*) AS n FROM lineitem GROUP BY ALL) SELECT s.l_partkey, s.l_suppkey, s.l_orderkey, CASE WHEN n = 1 THEN block END AS block FROM lineitem s JOIN b USING (l_partkey, l_suppkey)""")
def exact_rows(spark, d):
    li = _li(spark, d, "l_partkey", "l_suppkey", "l_orderkey")
    return K.exact_row(li, li.withColumnRenamed("l_orderkey", "block"), ["l_partkey", "l_suppkey"])


@add("""WITH r AS (SELECT l_partkey AS candidate, l_suppkey % 2 AS hash, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS revision, l_returnflag AS verdict, l_discount < 0.08 AS cur FROM lineitem), m AS (SELECT r.* FROM r JOIN part ON p_partkey = candidate AND p_size % 2 = hash), b AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY revision DESC) AS n FROM m)
SELECT candidate, revision, verdict FROM b WHERE n = 1 AND cur""")
def reviews_in_force(spark, d):
    reviews = _li(spark, d, F.col("l_partkey").alias("candidate"), (F.col("l_suppkey") % 2).alias("hash"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("revision"), F.col("l_returnflag").alias("verdict"), (F.col("l_discount") < 0.08).alias("current"))
    return K.reviews_in_force(reviews, read(spark, d, "part").select(F.col("p_partkey").alias("candidate"), (F.col("p_size") % 2).cast("long").alias("hash")))


@add("""WITH n AS (SELECT lang AS category, count(*) FILTER (toxic = 1 AND p) AS tp, count(*) FILTER (toxic = 0 AND p) AS fp, count(*) FILTER (toxic = 1 AND NOT p) AS fn, count(*) FILTER (toxic = 0 AND NOT p) AS tn FROM (SELECT lang, toxic, contains(text, '!') AS p FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL) GROUP BY 1)
SELECT category, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END, 6) AS fpr FROM n""")
def category_confusion(spark, d):
    own = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").where("toxic is not null").select(F.col("lang").alias("category"), (F.col("toxic") == 1).alias("truth"), F.contains("text", F.lit("!")).alias("said"))
    return K.confusion(own, "category", "truth", "said")


@add("""SELECT c_nationkey AS "key", max_by(c_custkey, (c_acctbal, c_custkey)) AS id FROM customer GROUP BY 1""")
def deduped_insights(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("priority"), F.col("c_custkey").alias("id"))
    return K.priority_rank(c, "key", ["priority", "id"]).select("key", "id")


@add("""WITH c AS (SELECT o_custkey AS case_id, o_custkey || '__chunk-' || o_orderkey % 4 AS chunk FROM orders), n AS (SELECT case_id, count(*) AS n, max(CAST(chunk = case_id || '__chunk-0' AS INT)) AS cur FROM c GROUP BY 1)
SELECT c.case_id, chunk, n FROM c JOIN n USING (case_id) WHERE n > 1 AND cur = 1 AND chunk <> c.case_id || '__chunk-0'""")
def stale_chunks(spark, d):
    c = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.concat(F.col("o_custkey").cast("string"), F.lit("__chunk-"), (F.col("o_orderkey") % 4).cast("string")).alias("chunk"))
    return K.stale_copies(c).withColumn("case_id", F.col("case_id").cast("long"))


@add("""WITH n AS (SELECT event_type AS department, 'R' || user_id % 5 AS region, count(*) AS n FROM events GROUP BY ALL) SELECT department, string_agg(region || '=' || n, ',' ORDER BY region) AS regions FROM n GROUP BY department""")
def region_summaries(spark, d):
    n = _events(spark, d).groupBy("department", "region").agg(F.count("*").alias("n"))  # A24: a map of few regions for each department
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "region", F.col("n").cast("string"))))
    return n.groupBy("department").agg(F.array_join(entries, ",").alias("regions"))


@add("SELECT o_custkey AS case_id, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS open_total, max(o_orderdate) AS last_ts FROM orders GROUP BY 1")
def structured_metrics(spark, d):
    o = read(spark, d, "orders")  # A25: counts and means under a condition; without such rows the total is null
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 2).alias("open_total"), F.max("o_orderdate").alias("last_ts"))


@add("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax >= 0.08)")
def incremental_index(spark, d):
    todo = read(spark, d, "part").select(F.col("p_partkey").alias("id"))  # U03: records without those of the index
    return todo.join(_li(spark, d, F.col("l_partkey").alias("id"), "l_tax").where("l_tax >= 0.08"), "id", "left_anti")


@add("SELECT o_orderkey AS id, o_orderdate AS started_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_runs(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at")).orderBy(F.desc("started_at"), "id").limit(20)  # W20


@add("""WITH q AS (SELECT c_custkey AS id, c_nationkey FROM customer), s AS (SELECT n_nationkey, min(n_name) AS name FROM nation WHERE n_nationkey % 3 > 0 GROUP BY 1) SELECT id, name AS source, name IS NULL AS missing FROM q LEFT JOIN s ON n_nationkey = c_nationkey""")
def neutral_queries(spark, d):
    first = W.keep_first(read(spark, d, "nation").where("n_nationkey % 3 > 0").select("n_nationkey", F.col("n_name").alias("source")), ["n_nationkey"], [F.asc("source")])  # J13: the first source of a key
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey")).join(first, "n_nationkey", "left")
    return own.select("id", "source", F.col("source").isNull().alias("missing"))
