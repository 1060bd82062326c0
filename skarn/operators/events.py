"""Event analytics: windows anchored at a reference time, alerts, duplicates, regions.

Events: id, ts, region, department, value (minutes), status and text-like columns as named by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .state import saved
from .windows import best_row

#: Nodes that a task holds before it hands on what its links connect.
HELD = 200_000


def with_as_of(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """as_of is the latest event time unless given; one row, so its broadcast has a fixed size."""
    if as_of is not None:
        return events.withColumn("as_of", as_of)
    return events.join(F.broadcast(events.agg(F.max("ts").alias("as_of"))))


def surge(events: DataFrame, by: Sequence[str], recent_hours: int = 3, baseline_days: int = 7, ratio: float = 2.5, least: int = 3, as_of: Column | None = None) -> DataFrame:
    """Recent events [t - 3h, t] against the daily mean of [t - 7d, t - 3h); a surge reaches ratio and `least` events."""
    own = with_as_of(events, as_of)
    age = F.unix_timestamp("as_of") - F.unix_timestamp("ts")
    recent = (age >= 0) & (age <= recent_hours * 3600)
    older = (age > recent_hours * 3600) & (age <= baseline_days * 86400)
    out = own.groupBy(*by).agg(F.count_if(recent).alias("recent"), F.count_if(older).alias("older"))
    base = F.col("older") / float(baseline_days)
    out = out.withColumn("baseline", F.round(base, 6)).withColumn("surge", F.round(F.col("recent") / F.greatest(base, F.lit(1.0)), 6))
    return out.withColumn("is_surge", (F.col("surge") >= ratio) & (F.col("recent") >= least))


def surge_score(count: Column, ratio: Column, cohesion: Column, spatial: Column, risk: Column, least: int = 3, least_ratio: float = 2.5) -> Column:
    """.30 count + .25 surge + .20 cohesion + .15 place + .10 risk, each at most 1, four places; count and surge as shares of what makes a surge."""
    cap = lambda c: F.least(F.lit(1.0), c)
    return F.round(C.clamp(0.30 * cap(count / float(max(least, 1))) + 0.25 * cap(ratio / max(least_ratio, 1.0)) + 0.20 * cohesion + 0.15 * spatial + 0.10 * risk), 4)


def similar_before(events: DataFrame, clusters: DataFrame, threshold: float, days: int = 7, block: int = 8192, cluster_block: int = 512) -> DataFrame:
    """Cluster, older and baseline: events (id, ts, region, v) of the `days` before a cluster's recent part whose vector is near its centre and whose region is compatible, and their daily mean.

    clusters: cluster, region, v (centre), as_of and since (the recent part begins). Both sides are dealt
    into blocks of bounded size; a pair of blocks is one matrix product that gives counts. A cluster
    without such events has 0. Zero vectors are near to nothing; regions are compatible as F09 has it.
    """
    n, m = max(1, -(-events.count() // block)), max(1, -(-clusters.count() // cluster_block))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    vector = F.col("v").cast("array<double>").alias("v")
    region = F.when(F.lower(F.trim("region")).isin("", "unknown"), None).otherwise(F.col("region")).alias("region")
    left = events.where("v is not null and ts is not null").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), region, vector, deal("id", n).alias("p")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = clusters.select("cluster", region, vector, F.unix_micros(F.col("since").cast("timestamp")).alias("hi"), F.unix_micros((F.col("as_of") - F.expr(f"interval {days} days")).cast("timestamp")).alias("lo"), deal("cluster", m).alias("q")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kind = clusters.schema["cluster"].dataType

    def unit(t: pa.Table) -> np.ndarray:
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        count = np.zeros(b.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            near = unit(b) @ unit(a).T >= threshold
            t = a.column("t").to_numpy()
            near &= (t >= b.column("lo").to_numpy()[:, None]) & (t < b.column("hi").to_numpy()[:, None])
            names, own = a.column("region").to_pylist(), b.column("region").to_pylist()
            known = {r: np.array([x is None or r is None or x == r or x.startswith(r) or r.startswith(x) or x[:2] == r[:2] for x in names]) for r in set(own)}
            count = np.array([(near[i] & known[r]).sum() for i, r in enumerate(own)], np.int64)
        return pa.table({"cluster": b.column("cluster"), "older": pa.array(count, pa.int64())})

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, f"cluster {kind.simpleString()}, older long")
    return found.groupBy("cluster").agg(F.sum("older").alias("older")).withColumn("baseline", F.round(F.col("older") / float(max(days, 1)), 6))


def spatial_score(regions: Column) -> Column:
    """By the number of distinct known regions."""
    return F.when(regions == 0, 0.75).when(regions == 1, 1.0).otherwise(0.85)


def backlog(events: DataFrame, by: str, minutes: float, least: int, closed: Sequence[str]) -> DataFrame:
    """Open events over the threshold by department, where there are enough of them."""
    late = events.where(C.is_open(F.col("status"), closed) & (F.col("minutes") >= minutes))
    return late.groupBy(by).agg(F.count("*").alias("n_open"), F.round(F.avg("minutes"), 4).alias("avg_minutes")).where(F.col("n_open") >= least)


def dominant(events: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent known value (ties to the first seen, then the smaller) and its share of all rows."""
    cells = events.groupBy(*by, value).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    best = cells.where(F.col(value).isNotNull())
    best = best.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("first_ts"), F.col(value))).alias("b"))
    return total.join(best, list(by), "left").select(*by, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"), "total", F.round(F.coalesce(F.col("b.n") / F.col("total"), F.lit(1.0)), 6).alias("share"))


def repeated(events: DataFrame, by: str, region: str, least: int, least_region: int) -> DataFrame:
    """Groups with enough events whose dominant region alone has enough too."""
    top = dominant(events, [by], region)
    return top.where((F.col("total") >= least) & (F.col("n") >= least_region))


def keyword_alerts(events: DataFrame, rules: Sequence[tuple[str, Sequence[str], int, float]], text: str, region: str) -> DataFrame:
    """Rules (name, words, least, least share of the dominant region), all in one pass over the events."""
    hit = F.array_compact(F.array(*[F.when(C.contains_any(F.col(text), words), F.lit(name)) for name, words, _, _ in rules]))
    own = events.select("ts", region, F.explode(hit).alias("rule"))
    need = F.create_map(*[F.lit(v) for name, _, n, _ in rules for v in (name, n)])
    share = F.create_map(*[F.lit(v) for name, _, _, s in rules for v in (name, s)])
    out = dominant(own, ["rule"], region)
    return out.where((F.col("total") >= need[F.col("rule")]) & (F.col("share") >= share[F.col("rule")]))


def geo_summary(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Centre (six places) and the largest distance to it (three places)."""
    mid = events.groupBy(*by).agg(F.round(F.avg("lat"), 6).alias("lat0"), F.round(F.avg("lon"), 6).alias("lon0"))
    far = events.join(mid, list(by)).groupBy(*by).agg(F.round(F.max(C.haversine_km(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))), 3).alias("radius_km"))
    return mid.join(far, list(by))


def near_in_time(left: DataFrame, right: DataFrame, hours: float, keys: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b) with a < b, equal keys and at most `hours` apart; columns to keep get an a or b behind their names.

    Time is cut into buckets of that width; a row meets the bucket of its own and the next, so a pair
    meets once, and no pair farther apart than two buckets is looked at.
    """
    width = int(hours * 3600)
    bucket = F.floor(F.unix_timestamp("ts") / width)
    a = left.select(F.col("id").alias("a"), F.col("ts").alias("ta"), *[F.col(k).alias(k) for k in keys], *[F.col(k).alias(f"{k}a") for k in keep], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = right.select(F.col("id").alias("b"), F.col("ts").alias("tb"), *[F.col(k).alias(k) for k in keys], *[F.col(k).alias(f"{k}b") for k in keep], bucket.alias("bucket"))
    close = F.abs(F.unix_timestamp("ta") - F.unix_timestamp("tb")) <= width
    return a.join(b, [*keys, "bucket"]).where((F.col("a") < F.col("b")) & close).drop("bucket")


def pair_count(events: DataFrame, hours: float, keys: Sequence[str] = ()) -> DataFrame:
    """The number of pairs at most `hours` apart, without making the pairs: each event counts those behind it in range."""
    t = F.unix_timestamp("ts")
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-int(hours * 3600), 0)
    tie = Window.partitionBy(*keys, t).orderBy("id")
    same = Window.partitionBy(*keys, t)
    # Those at the same second come into each other's range twice: the later ones are taken off
    own = events.withColumn("_n", F.count("*").over(w) - (F.count("*").over(same) - F.row_number().over(tie)) - 1)
    return own.groupBy(*keys).agg(F.sum("_n").cast("long").alias("pairs"))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _contracted(e: DataFrame) -> DataFrame:
    """Links of the same components: each task joins what its own links connect, HELD nodes at a time, and hands on one link of each node."""

    def run(batches):
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def links(schema: pa.Schema) -> pa.RecordBatch:
            rows = [(x, r) for x in list(up) if (r := find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = find(u), find(v)
                if p != q:
                    up[max(p, q)] = min(p, q)
            if len(up) >= HELD:
                yield links(b.schema)
                up.clear()
        if up:
            yield links(b.schema)

    return e.mapInArrow(run, e.schema)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Node and the smallest node reachable, by large-star and small-star steps until the links no longer change. Ids of any ordered type.

    Without nodes those of the edges between two different ones. Whole numbers and texts are joined inside
    the tasks first, so that of many links in a group only one for each node is shuffled.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = saved((_contracted(e) if e.schema["u"].dataType.typeName() in ("byte", "short", "integer", "long", "string") else e).distinct())
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark, e = now, saved(_small_star(_large_star(e)))
    if nodes is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return nodes.select("node").join(e.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def pair_score(parts: Sequence[tuple[Column, float]], places: int = 4) -> Column:
    """Weighted sum of components, clamped, then rounded."""
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + weight * value
    return F.round(C.clamp(total), places)


def time_step(hours: Column) -> Column:
    """1, .8 and .4 within 24, 72 and 168 hours (fixed values)."""
    return F.when(hours <= 24, 1.0).when(hours <= 72, 0.8).when(hours <= 168, 0.4).otherwise(0.0)


def dedupe_alerts(alerts: DataFrame) -> DataFrame:
    """Of each alert id the row with the highest confidence, then count."""
    return best_row(alerts, ["alert_id"], ["confidence", "recent"])


def operational(events: DataFrame, by: Sequence[str], closed: Sequence[str]) -> DataFrame:
    """Totals, open and reopened counts, rates, distinct days."""
    opened = C.is_open(F.col("status"), closed)
    return events.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(opened).alias("n_open"), F.count_if(F.col("reopened")).alias("n_reopened"),
        F.round(F.avg(F.col("reopened").cast("double")), 6).alias("reopen_rate"), F.round(F.avg("minutes"), 4).alias("avg_minutes"), F.countDistinct(F.to_date("ts")).alias("days"),
    )


def dispersed_noise(events: DataFrame, by: str, region: str, least: int = 5, recent_hours: int = 3, most_share: float = 0.4) -> DataFrame:
    """groups of `least` events or more over three regions or more, a span over four recent windows (12 hours at least), fewer than `least` events in the window before the group's last one, and no region with `most_share` of all its events.

    Region names are compared with blanks trimmed and runs of them as one; blank and null ones are none
    but count among all events. Events without a time take no part.
    """
    name = F.nullif(F.trim(F.regexp_replace(region, "\\s+", " ")), F.lit(""))
    own = events.where("ts is not null").select(by, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), name.alias("r"))
    cells = own.groupBy(by, "r").agg(F.count("*").alias("c"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    groups = cells.groupBy(by).agg(F.sum("c").alias("n"), F.count("r").alias("regions"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.when(F.col("r").isNotNull(), F.col("c"))).alias("top"))
    wide = groups.where((F.col("n") >= least) & (F.col("regions") >= 3) & ((F.col("hi") - F.col("lo")) / 3.6e9 > max(4 * recent_hours, 12)) & (F.col("top") / F.col("n") < most_share))
    late = own.join(wide.select(by, "hi"), by).where(F.col("t") >= F.col("hi") - int(recent_hours * 3.6e9)).groupBy(by).agg(F.count("*").alias("recent"))
    return wide.join(late, by).where(F.col("recent") < least).select(by, "regions", "recent", F.round(F.col("top") / F.col("n"), 6).alias("share"))
