"""Record queries: cases are customers, documents, events and conversations with derived fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import records as R
from .base import Registry, read
from .event_queries import EV, _events
from .text_queries import _mask

REGISTRY = Registry()
add = REGISTRY.add

TAILS = ["부", "처", "청", "시청", "도", "시", "군", "구", ""]
HEADS = ["제목 : ", "고객: ", "", "상담원 : "]
CASES = """WITH c AS (SELECT c_custkey AS id, n_name || [{tails}][CAST(c_custkey % 9 AS INT) + 1] AS source, [{heads}][CAST(c_custkey % 4 AS INT) + 1] || c_name AS content, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, CASE WHEN ends_with(source, '부') OR ends_with(source, '처') THEN 'central' WHEN ends_with(source, '청') AND NOT regexp_matches(source, '[시도군구]청$') THEN 'central' WHEN regexp_matches(content, '^(고객|상담원)\\s*[:：]') THEN 'cultural'
  WHEN ends_with(source, '도') OR ends_with(source, '시') OR ends_with(source, '군') OR ends_with(source, '구') THEN 'local' WHEN regexp_matches(content, '^제목\\s*[:：]') THEN 'local' ELSE 'central' END AS kind FROM c)
""".format(tails=", ".join(f"'{t}'" for t in TAILS), heads=", ".join(f"'{t}'" for t in HEADS))


def _cases(spark, d):
    own = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    pick = lambda values, n: F.array(*[F.lit(v) for v in values])[(F.col("c_custkey") % n).cast("int")]
    return own.select(F.col("c_custkey").alias("id"), F.concat("n_name", pick(TAILS, 9)).alias("source"), F.concat(pick(HEADS, 4), "c_name").alias("content"), "n_name")


@add(CASES + "SELECT id, source, kind FROM k")
def record_source_types(spark, d):
    return _cases(spark, d).select("id", "source", R.source_type(F.col("source"), F.col("content")).alias("kind"))


@add(CASES + """, p AS (SELECT n_name AS place, n_nationkey AS pos, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0),
m AS (SELECT id, min_by(region, pos) AS begins, max(CASE WHEN place = source THEN region END) AS exact FROM k JOIN p ON starts_with(source, place) AND length(place) >= 2 GROUP BY id)
SELECT k.id, kind, CASE WHEN kind = 'central' THEN '전국' WHEN exact IS NOT NULL THEN exact ELSE coalesce(begins, 'unknown') END AS region FROM k LEFT JOIN m USING (id)""")
def record_regions(spark, d):
    places = read(spark, d, "nation").where("n_nationkey % 5 <> 0").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("place"), F.col("n_nationkey").alias("pos"), F.col("r_name").alias("region"))
    own = _cases(spark, d).withColumn("kind", R.source_type(F.col("source"), F.col("content")))
    return R.region_of(own, "id", "source", "kind", places).select("id", "kind", "region")


@add("""WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '2024130' || (o_orderkey % 10) ELSE strftime(o_orderdate, '%Y%m%d') END AS day, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END AS kind FROM orders)
SELECT id, CASE WHEN try_strptime(day, '%Y%m%d') IS NULL THEN 'now' ELSE strftime(try_strptime(day, '%Y%m%d'), '%Y-%m-%dT%H:%M:%S') || '+09:00' END AS created_at, regexp_replace(day, '^([0-9]{4})([0-9]{2})([0-9]{2})$', '\\1-\\2-\\3') AS day, CASE WHEN trim(kind) = '' THEN '미분류' ELSE trim(kind) END AS category FROM o""")
def record_dates(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    day = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, F.concat(F.lit("2024130"), (F.col("id") % 10).cast("string"))).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    own = o.select("id", day.alias("day"), F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("o_orderpriority")).alias("kind"))
    return own.select("id", R.kst_date(F.col("day"), F.lit("now")).alias("created_at"), R.iso_day(F.col("day")).alias("day"), R.category(F.col("kind")).alias("category"))


@add("""WITH s AS (SELECT doc_id, text, source, position('.' IN text) AS p FROM documents),
q AS (SELECT doc_id, source, trim(CASE WHEN p > 0 THEN substr(text, 1, p - 1) ELSE text END) AS question, trim(CASE WHEN p > 0 THEN substr(text, p + 1) ELSE '' END) AS answer, substr(text, 1, 12) AS title FROM s),
n AS (SELECT *, trim(regexp_replace(upper(trim(source)), '[^A-Z0-9]+', '-', 'g'), '-') AS u FROM q)
SELECT doc_id, length(question) AS question_length, md5(CASE WHEN starts_with(trim(question), trim(title)) OR trim(title) = '' THEN concat_ws(chr(10), nullif(question, ''), nullif(answer, '')) ELSE concat_ws(chr(10), trim(title), nullif(question, ''), nullif(answer, '')) END) AS body,
CASE WHEN doc_id % 10 = 0 THEN 'CASE-UNKNOWN-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') WHEN starts_with(u, 'CASE-') THEN u ELSE 'CASE-' || u END AS case_id FROM n""")
def record_texts(spark, d):
    docs = read(spark, d, "documents")
    question, answer = R.split_answer(F.col("text"), ".")
    own = docs.select("doc_id", question.alias("question"), answer.alias("answer"), F.substring("text", 1, 12).alias("title"), F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("raw"))
    return own.select("doc_id", F.length("question").cast("long").alias("question_length"), F.md5(R.case_text(F.col("title"), F.col("question"), F.col("answer"))).alias("body"), R.case_id(F.col("raw"), F.col("doc_id")).alias("case_id"))


@add(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(substr(text, 1, 100000), ' '), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS v FROM documents),
u AS (SELECT doc_id, w, lower(w) AS k, i FROM (SELECT doc_id, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM s)), f AS (SELECT doc_id, k, min(i) AS i, min_by(w, i) AS w FROM u GROUP BY ALL)
SELECT doc_id, count(*) AS n, md5(string_agg(w, '|' ORDER BY i)) AS signals FROM f GROUP BY doc_id""".replace("substr(text, 1, 100000)", "text"))
def signal_values(spark, d):
    own = R.signal_values(read(spark, d, "documents").select("doc_id", F.split("text", " ").alias("v")), "doc_id", "v")
    return own.select("doc_id", F.size("v").cast("long").alias("n"), F.md5(F.array_join("v", "|")).alias("signals"))


@add("""SELECT conv_id, turn, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 57)) || '...' ELSE t END AS title FROM (SELECT conv_id, turn, coalesce(CASE WHEN turn % 5 = 0 THEN 'Turn ' || turn END, nullif(trim(regexp_replace(regexp_replace(role || ': ' || text, '\\s+', ' ', 'g'), '^ ?[A-Za-z가-힣]{1,12} ?: ?', '')), ''), 'none') AS t FROM conversations)""")
def case_titles(spark, d):
    c = read(spark, d, "conversations")
    explicit = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Turn "), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", R.title_of(explicit, F.concat_ws(": ", "role", "text"), kind=F.lit("none")).alias("title"))


CHUNKS = """WITH c AS (SELECT doc_id, source AS region, lang AS category, CASE WHEN doc_id % 6 = 0 THEN 'soon' ELSE strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INT)), '%Y-%m-%d %H:%M:%S') END AS created_at, list_filter([CASE WHEN contains(text, '@') THEN 'person' END, CASE WHEN contains(text, 'token') THEN 'Hazard' END, CASE WHEN n_chars > 500 THEN 'place' END], lambda x: x IS NOT NULL) AS entity_labels FROM documents)
"""


def _chunks(spark, d):
    docs = read(spark, d, "documents")
    day = F.when(F.col("doc_id") % 6 == 0, "soon").otherwise(F.date_format(F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(days=(F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd HH:mm:ss"))
    labels = F.array_compact(F.array(F.when(F.contains("text", F.lit("@")), "person"), F.when(F.contains("text", F.lit("token")), "Hazard"), F.when(F.col("n_chars") > 500, "place")))
    return docs.select("doc_id", F.col("source").alias("region"), F.col("lang").alias("category"), day.alias("created_at"), labels.alias("entity_labels"))


@add(CHUNKS + """SELECT doc_id FROM c WHERE contains(coalesce(region, ''), '1') AND category = 'en' AND (try_cast(created_at AS TIMESTAMP) IS NULL OR (try_cast(created_at AS TIMESTAMP) >= TIMESTAMP '2024-02-01' AND try_cast(created_at AS TIMESTAMP) <= TIMESTAMP '2024-09-30')) AND list_has_any(list_transform(entity_labels, lambda x: upper(x)), ['PLACE', 'HAZARD'])""")
def metadata_filters(spark, d):
    return _chunks(spark, d).where(R.filters(region="1", kind="en", date_from="2024-02-01", date_to="2024-09-30", labels=["place", "hazard"])).select("doc_id")


@add(CHUNKS + """SELECT doc_id, array_to_string(list_filter(list_transform(entity_labels, lambda x: upper(x)), lambda x: x IN ('PLACE', 'HAZARD')), ',') AS labels, doc_id % 7 = 0 OR doc_id % 5 IN (1, 2) AS unsafe FROM c""")
def allowed_labels(spark, d):
    flag = F.when(F.col("doc_id") % 7 == 0, " True ").otherwise("no")
    status = F.when(F.col("doc_id") % 5 == 1, "review").when(F.col("doc_id") % 5 == 2, "QUARANTINED ").otherwise("ok")
    return _chunks(spark, d).select("doc_id", F.array_join(R.allowed_labels(F.col("entity_labels"), ["PLACE", "HAZARD"]), ",").alias("labels"), R.unsafe(flag, status).alias("unsafe"))


@add(EV + "SELECT id FROM (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE minutes END AS m FROM ev, ref) WHERE status <> 'closed' AND status <> '' AND coalesce(m, (CAST(floor(epoch(as_of)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) / 60.0) >= 90")
def delayed_events(spark, d):
    e = _events(spark, d)
    own = e.join(F.broadcast(e.agg(F.max("ts").alias("as_of")))).withColumn("m", F.when(F.col("id") % 3 != 0, F.col("minutes")))
    return own.where(R.delayed(F.col("status"), F.col("m"), F.col("ts"), F.col("as_of"), 90, ["closed"])).select("id")


@add("""WITH t AS (SELECT doc_id, lower(text) AS text, text AS raw FROM documents)
SELECT doc_id, CASE WHEN contains(raw, 'token') AND contains(raw, '@') THEN 'REVIEW' WHEN regexp_matches(raw, '[0-9]{16}') THEN 'QUARANTINED' ELSE 'PASSED' END AS pii_status, NOT (contains(raw, 'token') AND contains(raw, '@')) AND NOT regexp_matches(raw, '[0-9]{16}') AND raw <> '' AS has_text FROM t""")
def safe_texts(spark, d):
    status, text = R.safety(F.col("text"), ["token", "@"], F.col("text"), ["[0-9]{16}"])
    return read(spark, d, "documents").select("doc_id", status.alias("pii_status"), (text != "").alias("has_text"))


@add("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AND o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def results_without_members(spark, d):
    members = read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("id"))
    own = read(spark, d, "orders").select(F.concat(F.lit("c_"), F.col("o_custkey").cast("string")).alias("case_id"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("doc"), F.col("o_orderkey").alias("id"))
    return R.without_members(own, members, ["case_id", "doc"]).select("id")


@add("""WITH t AS (SELECT conv_id, trim(text) AS task, turn FROM conversations WHERE NOT (regexp_matches(text, '^[A-Z][a-z]* ') AND length(text) < 40 OR (contains(text, '?') AND NOT contains(text, ',')))),
k AS (SELECT conv_id, task, min(turn) AS pos FROM t GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n_all FROM conversations GROUP BY conv_id)
SELECT conv_id, count(*) AS n_tasks, any_value(n_all) - count(*) AS n_dropped, md5(string_agg(task, '|' ORDER BY pos, task)) AS tasks FROM k JOIN n USING (conv_id) GROUP BY conv_id HAVING count(*) >= 2""")
def task_master(spark, d):
    c = read(spark, d, "conversations")
    drop = (F.col("text").rlike("^[A-Z][a-z]* ") & (F.length("text") < 40)) | R.boilerplate(F.col("text"), "$^", "\\?", ",")
    out = R.clean_tasks(c, "conv_id", "text", "turn", drop, 2)
    return out.select("conv_id", F.col("n_tasks").cast("long").alias("n_tasks"), "n_dropped", F.md5(F.array_join("tasks", "|")).alias("tasks"))


TYPES = [("compensation", ["token", "License"]), ("inquiry", ["?", "|"]), ("guidance", ["!"]), ("safety_action", ["@"])]


@add("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(text, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in TYPES) + """ ELSE 'other' END AS request_type, CAST((text IS NOT NULL AND trim(text) <> '') AS INT) + CAST((lang = 'en') AS INT) + CAST((n_chars > 100) AS INT) AS evidence FROM documents""")
def request_types(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", R.request_type(t, TYPES).alias("request_type"), R.evidence_count(t, F.when(F.col("lang") == "en", F.lit("en")), F.when(F.col("n_chars") > 100, F.lit("long")), F.lit(" ")).alias("evidence"))


PAIRS = """WITH p AS (SELECT id, region, CASE id % 4 WHEN 0 THEN [] WHEN 1 THEN ['road' || id % 3] WHEN 2 THEN ['road' || id % 3 || 'east', 'park'] ELSE ['x'] END AS details FROM (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'R' || user_id % 3 END AS region FROM events)),
j AS (SELECT a.id AS a, b.id AS b, a.region AS ra, b.region AS rb, a.details AS da, b.details AS db FROM p a JOIN p b ON b.id = a.id + 1)
"""


@add(PAIRS + """SELECT a, b, s AS state, CASE s WHEN 'exact' THEN 1.0 WHEN 'nearby' THEN 0.75 WHEN 'ambiguous' THEN 0.35 WHEN 'missing' THEN 0.25 ELSE 0.0 END::DOUBLE AS score FROM (SELECT a, b, CASE WHEN ra IS NULL AND rb IS NULL AND len(da) = 0 AND len(db) = 0 THEN 'missing' WHEN (ra IS NULL AND len(da) = 0) OR (rb IS NULL AND len(db) = 0) THEN 'ambiguous'
WHEN len(da) > 0 AND len(db) > 0 AND list_has_any(da, db) THEN 'exact' WHEN len(da) > 0 AND len(db) > 0 AND len(list_filter(da, lambda x: len(list_filter(db, lambda y: (length(x) >= 4 AND starts_with(y, x)) OR (length(y) >= 4 AND starts_with(x, y)))) > 0)) > 0 THEN 'nearby' WHEN len(da) > 0 AND len(db) > 0 THEN 'conflict'
WHEN ra = rb AND ra = 'R0' THEN 'ambiguous' WHEN ra = rb THEN 'exact' ELSE 'conflict' END AS s FROM j)""")
def location_states(spark, d):
    e = read(spark, d, "events")
    tag = F.concat(F.lit("road"), (F.col("event_id") % 3).cast("string"))
    details = F.when(F.col("event_id") % 4 == 0, F.expr("cast(array() as array<string>)")).when(F.col("event_id") % 4 == 1, F.array(tag)).when(F.col("event_id") % 4 == 2, F.array(F.concat(tag, F.lit("east")), F.lit("park"))).otherwise(F.array(F.lit("x")))
    p = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("R"), (F.col("user_id") % 3).cast("string"))).alias("region"), details.alias("details"))
    b = p.select((F.col("id") - 1).alias("id"), F.col("region").alias("rb"), F.col("details").alias("db"))
    state = R.location_state(F.col("region"), F.col("details"), F.col("rb"), F.col("db"), F.col("region") == "R0")
    return p.join(b, "id").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), state.alias("state")).withColumn("score", R.location_score(F.col("state")))


TOK = "regexp_extract_all(lower({}), '[a-z0-9가-힣]+')"


@add(f"""WITH q AS (SELECT item_id, text AS q FROM benchmark), t AS (SELECT doc_id, text, doc_id % 40 AS item_id FROM documents),
s AS (SELECT doc_id, list_distinct({TOK.format('q')}) AS a, list_distinct({TOK.format('text')}) AS b, contains(lower(text), lower(q)) AS inside FROM t JOIN q USING (item_id))
SELECT doc_id, round(least(1.0, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END + CASE WHEN inside THEN 0.15 ELSE 0 END), 4) AS score FROM s""")
def text_scores(spark, d):
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    own = read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id")).join(items, "item_id")
    return own.select("doc_id", R.text_score(F.col("q"), F.col("text")).alias("score"))


@add("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN regexp_replace(' 제 ' || p_size || ' 조', '\\s+', '', 'g') ELSE '제' || CAST(p_size AS INT) || '조' || CASE WHEN p_partkey % 3 > 0 THEN '의' || p_partkey % 3 ELSE '' END END AS article FROM part""")
def article_numbers(spark, d):
    p = read(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" 제 "), F.col("p_size").cast("string"), F.lit(" 조"))).otherwise(F.concat(F.lpad(F.col("p_size").cast("string"), 4, "0"), F.lpad((F.col("p_partkey") % 3).cast("string"), 2, "0")))
    return p.select(F.col("p_partkey").alias("id"), R.article_no(raw).alias("article"))


@add("""WITH t AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN substr(text, 5, 40) WHEN 1 THEN substr(text, 5, 35) || '#' ELSE '#none' END AS q FROM documents), p AS (SELECT *, position(q IN text) AS e, position(substr(q, 1, 30) IN text) AS n FROM t)
SELECT doc_id, CAST(CASE WHEN length(q) > 0 AND e > 0 THEN e - 1 WHEN length(q) >= 30 AND n > 0 THEN n - 1 ELSE 0 END AS INT) AS "start", CAST(CASE WHEN length(q) > 0 AND e > 0 THEN e - 1 + length(q) WHEN length(q) >= 30 AND n > 0 THEN least(n - 1 + length(q), length(text)) ELSE 0 END AS INT) AS "end", CASE WHEN length(q) > 0 AND e > 0 THEN 'exact' WHEN length(q) >= 30 AND n > 0 THEN 'prefix' ELSE 'inferred' END AS kind FROM p""")
def quote_spans(spark, d):
    q = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 5, 40)).when(F.col("doc_id") % 3 == 1, F.concat(F.substring("text", 5, 35), F.lit("#"))).otherwise("#none")
    return read(spark, d, "documents").withColumn("q", q).select("doc_id", R.find_span(F.col("text"), F.col("q")).alias("s")).select("doc_id", "s.start", "s.end", "s.kind")


STEPS = {("candidate", "confirm"): "confirmed", ("candidate", "split"): "split", ("candidate", "reject"): "rejected", ("confirmed", "split"): "split"}
ALLOWED = {"candidate": ["confirm", "split", "reject"], "confirmed": ["split"], "rejected": []}
GROUPS = """WITH g AS (SELECT c_custkey AS id, ['candidate', 'confirmed', 'rejected'][CAST(c_custkey % 3 AS INT) + 1] AS status, c_acctbal < 0 AS blocked, ['confirm', 'split', 'reject', NULL][CAST(c_custkey % 4 AS INT) + 1] AS action FROM customer),
r AS (SELECT *, CASE status || '/' || action WHEN 'candidate/confirm' THEN 'confirmed' WHEN 'candidate/split' THEN 'split' WHEN 'candidate/reject' THEN 'rejected' WHEN 'confirmed/split' THEN 'split' END AS t FROM g)
"""


def _groups(spark, d):
    c = read(spark, d, "customer")
    pick = lambda values: F.array(*[F.lit(v) for v in values])[(F.col("c_custkey") % len(values)).cast("int")]
    return c.select(F.col("c_custkey").alias("id"), pick(list(ALLOWED)).alias("status"), (F.col("c_acctbal") < 0).alias("blocked"), pick(["confirm", "split", "reject", None]).alias("action"))


@add(GROUPS + "SELECT id, CASE WHEN action IS NULL OR t IS NULL OR (blocked AND action = 'confirm') THEN status ELSE t END AS status, CASE WHEN action IS NULL THEN NULL WHEN t IS NULL THEN 'no such step' WHEN blocked AND action = 'confirm' THEN 'blocked' END AS refused FROM r")
def group_decisions(spark, d):
    g = _groups(spark, d)
    return R.transitions(g.drop("action"), g.where("action is not null").select("id", "action"), STEPS, ["confirm"])


@add(GROUPS + "SELECT id, CASE status WHEN 'candidate' THEN CASE WHEN blocked THEN 'split,reject' ELSE 'confirm,split,reject' END WHEN 'confirmed' THEN 'split' ELSE '' END AS actions FROM g")
def group_actions(spark, d):
    return _groups(spark, d).select("id", F.array_join(R.actions(F.col("status"), F.col("blocked"), ALLOWED, ["confirm"]), ",").alias("actions"))


@add("SELECT conv_id, string_agg(CASE WHEN trim(text) = '' THEN NULL ELSE trim(role) || ' ' || trim(text) END, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def analysis_texts(spark, d):
    own = read(spark, d, "conversations").select("conv_id", "turn", R.analysis_text(F.col("role"), F.lit(" "), F.col("text")).alias("t"))
    return own.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " ").alias("body"))


@add(f"SELECT conv_id, turn, role, {_mask('text')} AS masked FROM conversations WHERE text IS NOT NULL")
def masked_turns(spark, d):
    turn = F.struct("turn", "role", F.create_map(F.lit("body"), F.col("text")).alias("parts"))
    whole = read(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))  # a conversation's own turns
    one = R.mask_strings(whole).select("conv_id", F.explode("turns").alias("t"))
    return one.select("conv_id", "t.turn", "t.role", F.col("t.parts")["body"].alias("masked"))


@add("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') END AS valid_to FROM orders""")
def validity_windows(spark, d):
    date = lambda role, c: F.struct(F.lit(role).alias("role"), F.date_format(c, "yyyy-MM-dd").alias("value"), F.lit("day").alias("precision"), F.array("o_orderpriority").alias("evidence_ids"))
    first, last = date("valid_from", F.col("o_orderdate")), date("valid_to", F.col("o_orderdate") + F.expr("interval 90 days"))
    seen = F.struct(F.lit("seen").alias("role"), F.lit("unclear").alias("value"), F.lit("year").alias("precision"), F.lit(None).cast("array<string>").alias("evidence_ids"))
    dates = F.when(F.col("o_orderstatus") != "O", F.array(last, seen, first)).otherwise(F.array(first, seen))
    own = read(spark, d, "orders").withColumn("dates", dates).withColumn("evidence", F.array("o_orderpriority", F.lit("other")))
    return own.select("o_orderkey", R.validity_bounds("dates", "evidence").alias("v")).select("o_orderkey", "v.valid_from", "v.valid_to")


@add("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)""")
def listed_orders(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("suppliers"))  # an order's own lines
    own = read(spark, d, "orders").join(lines, "o_orderkey", "left")
    return R.listed(own, ["o_totalprice", "o_orderkey"], {"o_orderstatus": "F", "o_orderpriority": None}, {"suppliers": 7}).select("o_orderkey", "o_totalprice")
