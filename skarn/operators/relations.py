"""Range joins, diffs, validity, chains, coalescing and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import saved
from .windows import best_row


def span_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int = 1000) -> DataFrame:
    """Left (keys, a, start, end) and right (keys, b, start, end) whose half-open spans meet.

    Spans are dealt into cells of `width`; a pair is kept in the first cell that both touch.
    """
    cells = lambda s, e: F.sequence(F.floor(s / width), F.floor((e - 1) / width))
    one = left.where("start < end").select(*keys, "a", F.col("start").alias("s1"), F.col("end").alias("e1"), F.explode(cells(F.col("start"), F.col("end"))).alias("cell"))
    two = right.where("start < end").select(*keys, "b", F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(cells(F.col("start"), F.col("end"))).alias("cell"))
    met = (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")) & (F.col("cell") == F.floor(F.greatest("s1", "s2") / width))
    return one.join(two, [*keys, "cell"]).where(met).drop("cell")


def keyed_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Added, removed and modified keys with the names of the fields that differ."""
    a = before.select(*keys, *[F.col(f).alias(f"{f}_before") for f in fields], F.lit(1).alias("_a"))
    b = after.select(*keys, *[F.col(f).alias(f"{f}_after") for f in fields], F.lit(1).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"{f}_before").eqNullSafe(F.col(f"{f}_after")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "modified")
    return both.select(*keys, kind.alias("change"), F.when(kind == "modified", F.array_join(changed, ",")).otherwise("").alias("fields")).where("change is not null")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fails the job when a key repeats."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.concat_ws(" ", F.lit("repeated key"), *[F.col(k).cast("string") for k in keys])).cast("long")).otherwise(n)).where("_n = 1").drop("_n")


def validity(valid_from: Column, valid_to: Column, as_of: Column) -> tuple[Column, Column]:
    """F16: whether the closed interval holds as_of, and a status; a missing bound passes as unverified."""
    known = valid_from.isNotNull() & valid_to.isNotNull() & as_of.isNotNull()
    ok = F.coalesce(valid_from <= as_of, F.lit(True)) & F.coalesce(as_of <= valid_to, F.lit(True))
    return ok, F.when(~ok, "outside").when(known, "valid").otherwise("unverified")


def latest(history: DataFrame, keys: Sequence[str], revision: str) -> DataFrame:
    """The row with the highest revision of each key."""
    return best_row(history, keys, [revision])


def blocked(candidates: DataFrame, needs: DataFrame, status: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """candidates (candidate) with the number of needs (candidate, target) whose latest status is not allowed or missing."""
    last = latest(status, ["target"], "revision").select("target", "state")
    bad = needs.join(last, "target", "left").where(~F.coalesce(F.col("state"), F.lit("missing")).isin(*allowed)).groupBy("candidate").agg(F.count("*").alias("n_blocked"))
    return candidates.join(bad, "candidate", "left").select("candidate", F.coalesce("n_blocked", F.lit(0)).alias("n_blocked"), (F.coalesce("n_blocked", F.lit(0)) > 0).alias("is_blocked"))


def coalesced(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping and adjacent spans (keys, start, end) as one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_i")


def representatives(rows: DataFrame, key: Sequence[str], order: Sequence[Column], ident: str) -> DataFrame:
    """Each row with the first-seen row of its exact key; a null key stands for itself."""
    first = F.first(ident).over(Window.partitionBy(*key).orderBy(*order))
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    return rows.withColumn("representative", F.when(null, F.col(ident)).otherwise(first))


def two_hop(edges: DataFrame) -> DataFrame:
    """For each pair of head and end one or two steps apart (head <> tail), the hops and the smallest middle."""
    one = edges.select("head", "tail").distinct()
    step = one.select(F.col("head").alias("mid"), F.col("tail").alias("end"))
    two = one.join(step, F.col("tail") == F.col("mid")).where("head <> end").groupBy("head", "end").agg(F.min("mid").alias("mid"))
    near = one.select("head", F.col("tail").alias("end"), F.lit(1).alias("hops"), F.lit(None).cast(two.schema["mid"].dataType).alias("mid"))
    far = two.join(near.select("head", "end"), ["head", "end"], "left_anti").select("head", "end", F.lit(2).alias("hops"), "mid")
    return near.unionByName(far)


def live_target(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Follow links (id, next) to the end of each chain by doubling; a cycle is an error.

    A chain of n links ends after log2(n) + 1 doublings; what still moves after that many runs in a circle.
    """
    known = ids.select("id").unionByName(links.select(F.col("next").alias("id"))).unionByName(links.select("id")).distinct()
    at = saved(known.join(links, "id", "left").select("id", F.coalesce("next", "id").alias("end")))
    for _ in range(links.count().bit_length() + 1):
        jump = at.select(F.col("id").alias("_k"), F.col("end").alias("_e"))
        new = saved(at.join(jump, F.col("end") == F.col("_k")).select("id", F.col("_e").alias("end"), (F.col("_e") != F.col("end")).alias("moved")))
        at = new.select("id", "end")
        if not new.where("moved").take(1):
            if at.join(links.select(F.col("id").alias("end")), "end", "left_semi").take(1):
                break  # a circle closed on itself
            return ids.join(at, "id")
    raise ValueError("replacement chain has a cycle")


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.9, rounds: int = 10) -> DataFrame:
    """Personalised PageRank over edges (head, tail, weight) from seeds (node, p) for a fixed number of rounds, an estimate; graphs.pagerank_many goes on to convergence.

    A node without outgoing edges gives its mass back to the seeds. State is one row for each node,
    checkpointed every few rounds.
    """
    out = edges.groupBy("head").agg(F.sum("weight").alias("total"))
    moves = edges.join(out, "head").select("head", "tail", (F.col("weight") / F.col("total")).alias("w"))
    nodes = edges.select(F.col("head").alias("node")).union(edges.select("tail")).union(seeds.select("node")).distinct()
    total = seeds.agg(F.sum("p").alias("tp"))
    start = nodes.join(seeds, "node", "left").join(F.broadcast(total)).select("node", (F.coalesce("p", F.lit(0.0)) / F.col("tp")).alias("p0"))
    rank = start.select("node", "p0", F.col("p0").alias("p"))
    for r in range(rounds):
        flow = rank.join(moves, F.col("node") == F.col("head")).groupBy("tail").agg(F.sum(F.col("p") * F.col("w")).alias("f"))
        kept = flow.agg(F.coalesce(F.sum("f"), F.lit(0.0)).alias("s"))
        rank = rank.join(flow, F.col("node") == F.col("tail"), "left").join(F.broadcast(kept)).select("node", "p0", ((1 - damping) * F.col("p0") + damping * (F.coalesce("f", F.lit(0.0)) + (1 - F.col("s")) * F.col("p0"))).alias("p"))
        if r % 3 == 2:
            rank = saved(rank)
    # Twelve places first: the order of sums doesn't decide a half at the ninth
    return rank.select("node", F.round(F.col("p").cast("decimal(18,12)"), 8).cast("double").alias("score"))


def rule_hits(texts: DataFrame, key: str, text: str, rules: Sequence[tuple[str, Sequence[Sequence[str]]]]) -> DataFrame:
    """Rules (name, groups of words); a rule holds if every group has a word in the text. One row for each text and rule."""
    held = []
    for name, groups in rules:
        ok = F.lit(True)
        for g in groups:
            own = F.lit(False)
            for w in g:
                own = own | F.contains(F.col(text), F.lit(w))
            ok = ok & own
        held.append(F.when(ok, F.lit(name)))
    return texts.select(key, F.explode(F.array_compact(F.array(*held))).alias("rule"))


SEED = 3


def dictionary_matches(texts: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Names found in a text as runs of whole tokens, those inside a longer found one left out.

    A name is sought by its first SEED tokens (all of them, if it has fewer): places of a text are
    joined on the hash of so many tokens, then the rest of the name is compared, for names of any
    length and number. texts: key (one row for each), toks (array); names: name, toks. Null and empty
    names are found nowhere; a name that stands twice is found once.
    """
    sized = names.where(F.size("toks") > 0).select("name", "toks").distinct()
    head = lambda toks, at, n: F.when(n == 1, F.xxhash64(F.get(toks, at))).when(n == 2, F.xxhash64(F.get(toks, at), F.get(toks, at + 1))).otherwise(F.xxhash64(F.get(toks, at), F.get(toks, at + 1), F.get(toks, at + 2)))
    seeds = sized.select("name", F.size("toks").alias("n"), F.col("toks").alias("want"), F.least(F.size("toks"), F.lit(SEED)).alias("s")).withColumn("seed", head("want", F.lit(0), F.col("s")))
    lengths = sized.agg(F.collect_set(F.least(F.size("toks"), F.lit(SEED))).alias("lengths"))  # one row of at most SEED numbers
    own = texts.join(F.broadcast(lengths)).select(key, "toks", F.explode("lengths").alias("s")).where(F.size("toks") >= F.col("s"))
    places = own.select(key, "s", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("toks") - F.col("s")), lambda i: head("toks", i, F.col("s")))).alias("start", "seed"))
    hits = places.join(seeds, ["s", "seed"]).select(key, "name", "start", "n", "want")
    same = texts.select(key, "toks").join(hits, key).where(F.slice("toks", F.col("start") + 1, F.col("n")) == F.col("want"))
    found = same.select(key, "name", "start", (F.col("start") + F.col("n")).alias("end"))
    w = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_far", F.max("end").over(w)).where(F.col("_far").isNull() | (F.col("end") > F.col("_far"))).drop("_far")


def unpivot_profile(df: DataFrame, key: str) -> DataFrame:
    """For each column: rows, nulls, distinct values, and how many look like numbers or dates."""
    cols = [c for c in df.columns if c != key]
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x")).select("x.name", "x.value")
    return long.groupBy("name").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.countDistinct("value").alias("n_distinct"),
        F.count_if(F.col("value").rlike("^-?[0-9]+(\\.[0-9]+)?(E[0-9]+)?$")).alias("n_number"), F.count_if(F.col("value").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias("n_date"),
    )
