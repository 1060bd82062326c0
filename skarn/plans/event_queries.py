"""Event queries: region is R0..R4 by user, department the event type, minutes the value, place derived from the user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import duplicates as U
from ..operators import events as V
from ..operators import windows as W
from .base import Registry, read

REGISTRY = Registry()
add = REGISTRY.add

EV = """WITH ev AS (SELECT event_id AS id, ts, 'R' || (user_id % 5) AS region, event_type AS department, value AS minutes, user_id, event_type, props,
CASE WHEN event_id % 7 = 0 THEN 'closed' WHEN event_id % 11 = 0 THEN '' ELSE 'open' END AS status, event_id % 13 = 0 AS reopened,
(37.0 + (user_id % 50) / 100.0)::DOUBLE AS lat, (127.0 + (user_id % 30) / 100.0)::DOUBLE AS lon FROM events),
ref AS (SELECT max(ts) AS as_of FROM ev)
"""


def _events(spark, d):
    e = read(spark, d, "events")
    status = F.when(F.col("event_id") % 7 == 0, "closed").when(F.col("event_id") % 11 == 0, "").otherwise("open")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("region"), F.col("event_type").alias("department"), F.col("value").alias("minutes"), "user_id", "event_type", "props",
        status.alias("status"), (F.col("event_id") % 13 == 0).alias("reopened"), (37.0 + (F.col("user_id") % 50) / 100.0).alias("lat"), (127.0 + (F.col("user_id") % 30) / 100.0).alias("lon"),
    )


SURGE = EV + """, c AS (SELECT department, region, count(*) FILTER (epoch(as_of) - epoch(ts) BETWEEN 0 AND 86400) AS recent, count(*) FILTER (epoch(as_of) - epoch(ts) > 86400 AND epoch(as_of) - epoch(ts) <= 604800) AS older FROM (SELECT ev.*, date_trunc('second', as_of) AS as_of, date_trunc('second', ts) AS ts2 FROM ev, ref) GROUP BY ALL),
s AS (SELECT *, round(older / 7.0::DOUBLE, 6) AS baseline, round(recent / greatest(older / 7.0::DOUBLE, 1.0), 6) AS surge FROM c)
""".replace("epoch(as_of)", "CAST(floor(epoch(as_of)) AS BIGINT)").replace("epoch(ts)", "CAST(floor(epoch(ts)) AS BIGINT)")


def _surge(spark, d):
    return V.surge(_events(spark, d), ["department", "region"], recent_hours=24, ratio=1.2)


@add(SURGE + "SELECT department, region, recent, older, baseline, surge, surge >= 1.2 AND recent >= 3 AS is_surge FROM s")
def surge_counts(spark, d):
    return _surge(spark, d)


@add(SURGE + """, x AS (SELECT department, region, round(greatest(0, least(1, 0.30 * least(1, recent / 3.0) + 0.25 * least(1, surge / 2.5) + 0.20 * 0.5 + 0.15 * 1.0 + 0.10 * 0.2))::DOUBLE, 4) AS score FROM s)
SELECT department, region, score, CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'WARNING' WHEN score >= 0.5 THEN 'WATCH' ELSE 'none' END AS severity, substr(sha1(department || '|' || region), 1, 12) AS alert_id FROM x""")
def surge_score_bands(spark, d):
    s = _surge(spark, d)
    score = V.surge_score(F.col("recent"), F.col("surge"), F.lit(0.5), V.spatial_score(F.lit(1)), F.lit(0.2))
    out = s.withColumn("score", score)
    return out.select("department", "region", "score", C.band(F.col("score"), (0.85, "CRITICAL"), (0.7, "WARNING"), (0.5, "WATCH"), rest="none").alias("severity"), C.content_id(F.col("department"), F.col("region")).alias("alert_id"))


@add(EV + "SELECT department, count(*) AS n_open, round(avg(minutes), 4) AS avg_minutes FROM ev WHERE status = 'open' AND minutes >= 50 GROUP BY department HAVING count(*) >= 3")
def backlog_by_department(spark, d):
    return V.backlog(_events(spark, d), "department", 50, 3, ["closed"])


DOMINANT = EV + """, cell AS (SELECT department, region, count(*) AS n, min(ts) AS f FROM ev GROUP BY ALL), t AS (SELECT department, sum(n)::BIGINT AS total FROM cell GROUP BY 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY n DESC, f, region) AS r FROM cell WHERE region IS NOT NULL) WHERE r = 1),
dom AS (SELECT department, region, n, total, round(n / total::DOUBLE, 6) AS share FROM t LEFT JOIN b USING (department))"""


@add(DOMINANT + " SELECT * FROM dom")
def dominant_region(spark, d):
    return V.dominant(_events(spark, d), ["department"], "region")


@add(DOMINANT + " SELECT * FROM dom WHERE total >= 20 AND n >= 5")
def repeat_signal(spark, d):
    return V.repeated(_events(spark, d), "department", "region", 20, 5)


RULES = [("views", ["view"], 10, 0.1), ("money", ["purchase", "signup"], 10, 0.1), ("faults", ["error"], 10, 0.1), ("never", ["refund"], 1, 0.0)]


@add(EV + """, r AS (SELECT unnest(list_filter(['views', 'money', 'faults'], lambda x: (x = 'views' AND contains(event_type, 'view')) OR (x = 'money' AND (contains(event_type, 'purchase') OR contains(event_type, 'signup'))) OR (x = 'faults' AND contains(event_type, 'error')))) AS rule, ts, region FROM ev),
cell AS (SELECT rule, region, count(*) AS n, min(ts) AS f FROM r GROUP BY ALL), t AS (SELECT rule, sum(n)::BIGINT AS total FROM cell GROUP BY 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY n DESC, f, region) AS k FROM cell) WHERE k = 1)
SELECT rule, region, n, total, round(n / total::DOUBLE, 6) AS share FROM t JOIN b USING (rule) WHERE total >= 10 AND n / total::DOUBLE >= 0.1""")
def keyword_rules(spark, d):
    return V.keyword_alerts(_events(spark, d), RULES, "event_type", "region")


@add(EV + "SELECT region, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM ev GROUP BY region")
def region_share(spark, d):
    own = _events(spark, d).groupBy("region").agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("t"))
    return own.join(F.broadcast(total)).select("region", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@add(EV + """, m AS (SELECT department, round(avg(lat), 6) AS lat0, round(avg(lon), 6) AS lon0 FROM ev GROUP BY 1)
SELECT department, any_value(lat0) AS lat0, any_value(lon0) AS lon0, round(max(2 * 6371.0 * asin(sqrt(least(1, pow(sin((radians(lat0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat0)) * pow(sin(radians(lon0 - lon) / 2), 2))))), 3) AS radius_km FROM ev JOIN m USING (department) GROUP BY department""")
def geo_center_radius(spark, d):
    return V.geo_summary(_events(spark, d), ["department"])


PAIRS = EV + """, p AS (SELECT x.id AS a, y.id AS b, x.ts AS ta, y.ts AS tb, x.minutes AS ma, y.minutes AS mb, floor(epoch(x.ts)) AS ea, floor(epoch(y.ts)) AS eb FROM ev x JOIN ev y ON x.user_id = y.user_id AND x.event_type = y.event_type AND x.id < y.id AND abs(floor(epoch(x.ts)) - floor(epoch(y.ts))) <= 604800),
s AS (SELECT a, b, round(greatest(0, least(1, 0.5 * CASE WHEN abs(ea - eb) / 3600 <= 24 THEN 1 WHEN abs(ea - eb) / 3600 <= 72 THEN 0.8 WHEN abs(ea - eb) / 3600 <= 168 THEN 0.4 ELSE 0 END + 0.5 * (1 - least(1, abs(coalesce(ma, 0) - coalesce(mb, 0)) / 100))))::DOUBLE, 8) AS score FROM p)"""


def _pairs(spark, d):
    own = _events(spark, d)
    keyed = own.withColumn("m", F.coalesce("minutes", F.lit(0.0)))
    both = V.near_in_time(keyed, keyed, 168, ["user_id", "event_type"], ["m"])
    hours = F.abs(F.unix_timestamp("ta") - F.unix_timestamp("tb")) / 3600
    score = V.pair_score([(V.time_step(hours), 0.5), (1 - F.least(F.lit(1.0), F.abs(F.col("ma") - F.col("mb")) / 100), 0.5)], 8)
    return both.select("a", "b", score.alias("score")).where("score >= 0.5")


@add(PAIRS + " SELECT a, b, score FROM s WHERE score >= 0.5")
def duplicate_pairs(spark, d):
    return _pairs(spark, d)


@add(PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT a, b FROM s WHERE score >= 0.5 UNION SELECT b, a FROM s WHERE score >= 0.5), n AS (SELECT DISTINCT a AS node FROM e),
r AS (SELECT node, node AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def duplicate_components(spark, d):
    return V.components(_pairs(spark, d))


@add(EV + "SELECT x.event_type, count(*) AS pairs FROM ev x JOIN ev y ON x.event_type = y.event_type AND x.user_id = y.user_id AND x.id < y.id AND abs(floor(epoch(x.ts)) - floor(epoch(y.ts))) <= 259200 GROUP BY 1")
def pair_time_window_count(spark, d):
    one = V.pair_count(_events(spark, d), 72, ["user_id", "event_type"])
    return one.groupBy("event_type").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


@add(EV + """SELECT department, count(*) AS n, count(*) FILTER (status NOT IN ('', 'closed')) AS n_open, count(*) FILTER (reopened) AS n_reopened, round(avg(reopened::INT), 6) AS reopen_rate, round(avg(minutes), 4) AS avg_minutes, count(DISTINCT ts::DATE) AS days FROM ev GROUP BY department""")
def operational_metrics(spark, d):
    return V.operational(_events(spark, d), ["department"], ["closed"])


@add(SURGE + ", a AS (SELECT substr(sha1(department), 1, 12) AS alert_id, region, surge AS confidence, recent FROM s) SELECT * FROM (SELECT alert_id, region, confidence, recent FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY confidence DESC, recent DESC, region DESC) AS r FROM a) WHERE r = 1)")
def best_alerts(spark, d):
    a = _surge(spark, d).select(C.content_id(F.col("department")).alias("alert_id"), "region", F.col("surge").alias("confidence"), "recent")
    return W.best_row(a, ["alert_id"], ["confidence", "recent", "region"])


@add(EV + "SELECT hour, count(*) AS n, count(*) FILTER (hour >= 22 OR hour < 6) AS n_night FROM (SELECT CAST(extract(hour FROM ts) AS INT) AS hour FROM ev) GROUP BY hour")
def night_events(spark, d):
    h = _events(spark, d).select(F.hour("ts").alias("hour"))
    return h.groupBy("hour").agg(F.count("*").alias("n"), F.count_if(C.is_night(F.col("hour"), 22, 6)).alias("n_night"))


@add("SELECT event_id, ts, event_type FROM (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 500)")
def incremental_batch(spark, d):
    own = read(spark, d, "events").where(F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return own.orderBy("ts", "event_id").limit(500).select("event_id", "ts", "event_type")


@add("""SELECT c_mktsegment AS category, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1996 GROUP BY 1""")
def admin_overview_categories(spark, d):
    o = read(spark, d, "orders").where(F.year("o_orderdate") == 1996).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _placed(spark, d):
    c = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))


@add("SELECT r_name AS region, n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def admin_overview_regions(spark, d):
    return _placed(spark, d).groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))


@add("SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def admin_overview_trend(spark, d):
    return read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@add("SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS issue FROM part JOIN lineitem ON l_partkey = p_partkey) GROUP BY issue")
def admin_overview_issues(spark, d):
    own = read(spark, d, "lineitem").select("l_partkey").join(read(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return own.select(F.explode(F.split("p_type", " ")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@add("SELECT count(*) AS n, max(o_orderdate) AS last_date, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_totalprice > 200000) AS n_high, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders")
def dashboard_state(spark, d):
    return read(spark, d, "orders").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_date"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_totalprice") > 200000).alias("n_high"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_key"))


@add("""WITH e AS (SELECT json_extract_string(props, '$.k') AS k, epoch_us(ts) AS t, 'R' || (user_id % 5) AS r FROM events),
c AS (SELECT k, r, count(*) AS c FROM e GROUP BY ALL), g AS (SELECT k, sum(c)::BIGINT AS n, count(*) AS regions, max(c) AS top FROM c GROUP BY k), s AS (SELECT k, min(t) AS lo, max(t) AS hi FROM e GROUP BY k),
l AS (SELECT e.k, count(*) AS recent FROM e JOIN s USING (k) WHERE t >= hi - 10800000000 GROUP BY e.k)
SELECT k, regions, recent, round(top / n, 6) AS share FROM g JOIN s USING (k) JOIN l USING (k) WHERE n >= 5 AND regions >= 3 AND (hi - lo) / 3600000000 > 12 AND recent < 5 AND top / n < 0.4""")
def dispersed_keywords(spark, d):
    e = read(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k"), "ts", F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("region"))
    return V.dispersed_noise(e, "k", "region")


@add("""WITH e AS (SELECT event_id AS id, ts, 'R' || (user_id % 5) AS region, embedding::DOUBLE[] AS v FROM events JOIN embeddings ON vec_id = event_id % 500), m AS (SELECT max(ts) AS as_of FROM events),
x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), c AS (SELECT label AS cluster, list(a ORDER BY i) AS v FROM (SELECT label, i, round(avg(x), 6) AS a FROM x GROUP BY ALL) GROUP BY label)
SELECT cluster, count(*) FILTER (near) AS older, round(count(*) FILTER (near) / 7.0::DOUBLE, 6) AS baseline FROM (SELECT cluster, ts >= as_of - INTERVAL 7 DAY AND ts < as_of - INTERVAL 3 HOUR AND (cluster % 6 = 5 OR region = 'R' || (cluster % 6)) AND list_cosine_similarity(e.v, c.v) >= 0.25 AS near FROM c, e, m) GROUP BY cluster""")
def similar_baselines(spark, d):
    emb = read(spark, d, "embeddings")
    e = read(spark, d, "events").withColumn("vec_id", F.col("event_id") % 500).join(emb, "vec_id")
    e = e.select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string"), F.lit("x")).alias("region"), F.col("embedding").alias("v"))
    mean = emb.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    as_of = e.agg(F.max("ts").alias("as_of"))
    region = F.when(F.col("label") % 6 != 5, F.concat(F.lit("S"), (F.col("label") % 6).cast("string"), F.lit("x")))
    clusters = mean.join(F.broadcast(as_of)).select(F.col("label").alias("cluster"), region.alias("region"), "v", "as_of", (F.col("as_of") - F.expr("interval 3 hours")).alias("since"))
    return V.similar_before(e, clusters, 0.25)


#: Each event is a record: its place is one of 40, unknown for large values; its entities, unit and segments come from the property k.
RECORDS = """WITH e AS (SELECT event_id AS id, ts, 'R' || (user_id % 5) AS reg, value, event_type AS request, CAST(json_extract(props, '$.k') AS INT) AS k, user_id FROM events),
r AS (SELECT id, ts, request, k, CASE WHEN value > 15 THEN NULL ELSE reg END AS region, CASE WHEN value > 8 THEN [] ELSE ['place' || (user_id % 40)] END AS det, ['k' || k, request] AS ent, CASE WHEN k < 20 THEN [] ELSE ['u' || (k % 3)] END AS units,
  CASE WHEN k < 50 THEN [] ELSE [[request, 'k' || (k % 10)], ['seg' || (k % 4), request]] END AS seg, [request, 'k' || k, reg] AS toks, embedding::DOUBLE[] AS v, k % 7 = 0 AS pii FROM e JOIN embeddings ON vec_id = id % 500),
p AS (SELECT a.id AS a, b.id AS b, a.request = b.request AS same, a.ent AS e1, b.ent AS e2, a.units AS u1, b.units AS u2, a.seg AS s1, b.seg AS s2, a.toks AS t1, b.toks AS t2, a.v AS v1, b.v AS v2, a.pii OR b.pii AS pii, abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) / 3600 AS h,
  CASE WHEN a.region IS NULL AND len(a.det) = 0 AND b.region IS NULL AND len(b.det) = 0 THEN 'missing' WHEN a.region IS NULL AND len(a.det) = 0 OR b.region IS NULL AND len(b.det) = 0 THEN 'ambiguous'
    WHEN len(a.det) > 0 AND len(b.det) > 0 THEN CASE WHEN a.det[1] = b.det[1] THEN 'exact' WHEN starts_with(a.det[1], b.det[1]) OR starts_with(b.det[1], a.det[1]) THEN 'nearby' ELSE 'conflict' END
    WHEN a.region = b.region AND a.region = 'R0' THEN 'ambiguous' WHEN a.region = b.region THEN 'exact' ELSE 'conflict' END AS state
  FROM (SELECT r.*, floor(epoch(ts) / 21600)::BIGINT + o AS bucket FROM r, (VALUES (-1), (0), (1)) t(o)) a JOIN (SELECT *, floor(epoch(ts) / 21600)::BIGINT AS bucket FROM r) b ON a.bucket = b.bucket AND a.id < b.id AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) <= 21600),
q AS (SELECT a, b, state, least(1, greatest(0, list_cosine_similarity(v1, v2))) AS semantic, CASE state WHEN 'exact' THEN 1.0 WHEN 'nearby' THEN 0.75 WHEN 'ambiguous' THEN 0.35 ELSE 0.25 END::DOUBLE AS location,
  len(list_intersect(e1, e2)) / len(list_distinct(list_concat(e1, e2))) AS entities, same::INT::DOUBLE AS request, CASE WHEN len(u1) = 0 OR len(u2) = 0 THEN 0.5 ELSE list_has_any(u1, u2)::INT END::DOUBLE AS unit,
  CASE WHEN h <= 24 THEN 1.0 WHEN h <= 72 THEN 0.8 WHEN h <= 168 THEN 0.4 ELSE 0 END::DOUBLE AS time,
  CASE WHEN len(s1) = 0 OR len(s2) = 0 THEN len(list_intersect(t1, t2)) / len(list_distinct(list_concat(t1, t2))) ELSE list_max(flatten(list_transform(s1, lambda x: list_transform(s2, lambda y: len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))))))) END AS segments FROM p WHERE state <> 'conflict' AND NOT (state = 'ambiguous' AND pii)),
s AS (SELECT *, round(greatest(0, least(1, 0.30::DOUBLE * semantic + 0.20::DOUBLE * location + 0.15::DOUBLE * entities + 0.15::DOUBLE * request + 0.10::DOUBLE * unit + 0.05::DOUBLE * time + 0.05::DOUBLE * segments)), 4) AS score FROM q)
SELECT a, b, state, round(semantic, 4) AS semantic, location, round(entities, 4) AS entities, request, unit, time, round(segments, 4) AS segments, score FROM s WHERE score >= 0.6 AND (state <> 'ambiguous' OR score >= 0.8)"""


@add(RECORDS)
def duplicate_candidates(spark, d):
    e = read(spark, d, "events").withColumn("vec_id", F.col("event_id") % 500).join(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    k = F.get_json_object("props", "$.k").cast("int")
    named = e.select("*", k.alias("k"), F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("reg"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    none = lambda kind: F.array().cast(kind)
    segments = F.array(F.array("event_type", text("k", F.col("k") % 10)), F.array(text("seg", F.col("k") % 4), F.col("event_type")))
    records = named.select(
        F.col("event_id").alias("id"), "ts", F.when(~(F.col("value") > 15), F.col("reg")).alias("region"), (F.col("reg") == "R0").alias("broad"),
        F.when(F.col("value") > 8, none("array<string>")).otherwise(F.array(text("place", F.col("user_id") % 40))).alias("details"), F.array(text("k", F.col("k")), F.col("event_type")).alias("entities"),
        F.when(F.col("k") < 20, none("array<string>")).otherwise(F.array(text("u", F.col("k") % 3))).alias("units"), F.col("event_type").alias("request"),
        F.when(F.col("k") < 50, none("array<array<string>>")).otherwise(segments).alias("segments"), F.array("event_type", text("k", F.col("k")), F.col("reg")).alias("toks"), F.col("embedding").alias("v"), (F.col("k") % 7 == 0).alias("pii"),
    )
    return U.candidates(records, hours=6, least=0.6)
