"""Versioned claims, citations, groups and evaluation statistics as joins, aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .dedup import _codes, _hashes
from .events import components
from .state import saved
from .windows import best_row, top_k


def registered(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (source_id, content) of new whose content the source does not hold yet, once each, with their hash as version_id."""
    version = F.sha2(F.col("content"), 256)
    fresh = new.withColumn("version_id", version).dropDuplicates(["source_id", "version_id"])
    return fresh.join(old.select("source_id", version.alias("version_id")), ["source_id", "version_id"], "left_anti")


def activated(pointers: DataFrame, requests: DataFrame) -> DataFrame:
    """Pointers (name, snapshot, revision) after requests (name, target, expected): switched where the revision is the expected one."""
    ok = F.coalesce(F.col("revision") == F.col("expected"), F.lit(False))
    return pointers.join(requests, "name", "left").select("name", F.when(ok, F.col("target")).otherwise(F.col("snapshot")).alias("snapshot"), (F.col("revision") + ok.cast("int")).alias("revision"), ok.alias("switched"))


def status_history(history: DataFrame, targets: DataFrame) -> DataFrame:
    """History (target, revision, state) with new states (target, state) appended under the next revisions."""
    last = history.groupBy("target").agg(F.max("revision").alias("last"))
    added = targets.join(last, "target", "left").select("target", (F.coalesce("last", F.lit(0)) + 1).alias("revision"), "state")
    return history.select("target", F.col("revision").cast("long").alias("revision"), "state").unionByName(added.withColumn("revision", F.col("revision").cast("long")))


def projected(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base (id, body, state) after changes (id, op, body): upsert sets the body, deprecate and merge set the state."""
    c = changes.select("id", "op", F.col("body").alias("_new"))
    out = base.join(c, "id", "full_outer")
    return out.where("body is not null or op = 'upsert'").select("id", F.when(F.col("op") == "upsert", F.col("_new")).otherwise(F.col("body")).alias("body"), F.when(F.col("op") == "deprecate", "deprecated").when(F.col("op") == "merge", "merged").when(F.col("op") == "upsert", "live").otherwise(F.col("state")).alias("state"))


def closed_selection(candidates: DataFrame, needs: DataFrame) -> DataFrame:
    """Candidates (id) without those that need (id, need) one that is not selected, until nothing more falls out."""
    left = candidates.select("id").distinct()
    while True:
        bad = needs.join(left.select(F.col("id").alias("need")), "need", "left_anti").select("id").distinct()
        now = saved(left.join(bad, "id", "left_anti"))
        if now.count() == left.count():
            return now
        left = now


def bundles(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """All members of every group (group, id) that is linked to an asked id through shared members."""
    edges = groups.join(groups.groupBy("group").agg(F.min("id").alias("lead")), "group").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    part = components(edges, groups.select(F.col("id").alias("node")).distinct())
    wanted = part.join(asked.select(F.col("id").alias("node")), "node").select("component").distinct()
    return part.join(wanted, "component").select(F.col("node").alias("id")).unionByName(asked.select("id")).distinct()


def missing_references(items: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """Items whose reference stands in no target (id)."""
    return items.where(F.col(column).isNotNull()).join(targets.select(F.col("id").alias(column)), column, "left_anti")


def citation_checks(citations: DataFrame, articles: DataFrame) -> DataFrame:
    """Citations (id, law, article) with whether an article of that name and number was retrieved; blanks and case don't count."""
    key = lambda c: F.lower(F.regexp_replace(F.col(c).cast("string"), "\\s+", ""))
    known = articles.select(key("law").alias("_l"), key("article").alias("_a")).distinct().withColumn("_ok", F.lit(True))
    own = citations.withColumn("_l", key("law")).withColumn("_a", key("article"))
    return own.join(known, ["_l", "_a"], "left").select("id", F.coalesce("_ok", F.lit(False)).alias("valid"))


def citation_support(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per answer the mean share of its citations' tokens that the cited context has (none: 0), and the share of citations with a context."""
    both = citations.join(contexts.select("chunk_id", F.col("text").alias("context")), "chunk_id", "left")
    share = F.coalesce(C.overlap_ratio(C.tokens("text"), C.tokens("context")), F.lit(0.0))
    return both.groupBy("answer").agg(F.round(F.avg(share), 6).alias("support"), F.round(F.avg(F.col("context").isNotNull().cast("double")), 4).alias("coverage"))


def linked_ids(groups: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per group (group, id) the sorted alerts (alert, id) that share a member."""
    return groups.join(alerts, "id").groupBy("group").agg(F.array_sort(F.collect_set("alert")).alias("alerts"))


def in_order(lists: DataFrame, rows: DataFrame, key: str, ids: str, value: str) -> DataFrame:
    """Values of the listed ids in the list's own order; ids without a row are left out."""
    at = lists.select(key, F.posexplode(ids).alias("pos", "id")).join(rows.select("id", value), "id")
    return at.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("values"))


def completed_pairs(members: DataFrame, scored: DataFrame, missing: Column) -> DataFrame:
    """Every pair (a < b) of a group's members (group, id), with its score or, unscored, `missing`. Groups are those of the verified duplicates, small by nature."""
    a, b = members.select("group", F.col("id").alias("a")), members.select("group", F.col("id").alias("b"))
    return a.join(b, "group").where("a < b").join(scored, ["a", "b"], "left").select("group", "a", "b", F.coalesce("score", missing).alias("score"))


def mean_vector(vectors: DataFrame, by: str) -> DataFrame:
    """Element-wise mean of each group's vectors (column v), brought to length 1, six places."""
    mean = vectors.select(by, F.posexplode("v").alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("m"))
    norm = mean.groupBy(by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, by).select(by, "pos", F.round(F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0), 6).alias("x"))


def centroid_similarity(vectors: DataFrame, by: str) -> DataFrame:
    """Mean cosine of each group's vectors to its mean vector."""
    mid = mean_vector(vectors, by).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mid"))
    return vectors.join(mid, by).groupBy(by).agg(F.round(F.avg(C.cosine(F.col("v"), F.col("mid"))), 6).alias("similarity"))


def representatives(rows: DataFrame, by: str, k: int) -> DataFrame:
    """Per group the k newest distinct texts (by, text, ts, id), each with the ids that share it."""
    same = rows.groupBy(by, "text").agg(F.max(F.struct("ts", "id")).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return top_k(same.select(by, "text", "n.ts", "n.id", "ids"), [by], [F.desc("ts"), F.desc("id")], k)


def first_tokens(rows: DataFrame, by: str, order: str, text: str, k: int) -> DataFrame:
    """Per group the first k distinct tokens in the order of rows."""
    seen = rows.select(by, order, F.posexplode(C.tokens(text)).alias("p", "token")).groupBy(by, "token").agg(F.min(F.struct(order, "p")).alias("at"))
    best = top_k(seen, [by], [F.asc("at")], k)
    return best.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("tokens"))


def catalogue_or_frequent(rows: DataFrame, by: str, text: str, catalogue: Sequence[str], k: int = 8) -> DataFrame:
    """Per group the first k words of the catalogue that occur, else its k most frequent tokens (ties by the token)."""
    hit = F.array(*[F.max(F.contains(F.col(text), F.lit(w)).cast("int")) for w in catalogue])
    words = rows.groupBy(by).agg(hit.alias("h")).select(by, F.slice(F.filter(F.array(*[F.when(F.col("h")[i] == 1, F.lit(w)) for i, w in enumerate(catalogue)]), lambda w: w.isNotNull()), 1, k).alias("words"))
    counts = rows.select(by, F.explode(C.tokens(text)).alias("token")).groupBy(by, "token").agg(F.count("*").alias("n"))
    top = top_k(counts, [by], [F.desc("n"), F.asc("token")], k).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("frequent"))
    return words.join(top, by, "left").select(by, F.when(F.size("words") > 0, F.col("words")).otherwise(F.coalesce("frequent", F.expr("cast(array() as array<string>)"))).alias("keywords"))


def paired_bootstrap(diffs: DataFrame, rounds: int = 200, seed: str = "42") -> DataFrame:
    """Mean difference of two runs over queries (pos from 0, diff), with the 2.5 and 97.5 % points of resampled means.

    Draws come from md5 of seed, round and place, so they are the same everywhere. Queries are few: a list of all of them goes with every round.
    """
    own = diffs.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "diff"))), lambda x: x["diff"]).alias("d"), F.avg("diff").alias("mean"))
    n = F.size("d")
    draw = lambda r, i: F.element_at("d", (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), r.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") % n + 1).cast("int"))
    rows = own.select("d", "mean", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    means = rows.select("mean", F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: draw(F.col("r"), i)), F.lit(0.0), lambda a, x: a + x).alias("s"), n.alias("n"))
    return means.groupBy("mean").agg(F.percentile(F.col("s") / F.col("n"), 0.025).alias("low"), F.percentile(F.col("s") / F.col("n"), 0.975).alias("high")).select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def abstention(predictions: DataFrame, k: int, least: float) -> DataFrame:
    """Predictions (case, label, rank, unit, confidence; label null: none is right): recall and reciprocal rank at k over cases with a label, and how often the others stay below `least`."""
    one = predictions.groupBy("case").agg(F.max("label").alias("label"), F.min(F.when((F.col("unit") == F.col("label")) & (F.col("rank") <= k), F.col("rank"))).alias("hit"), F.max("confidence").alias("top"))
    has = F.col("label").isNotNull()
    return one.agg(F.round(F.avg(F.when(has, F.col("hit").isNotNull().cast("double"))), 6).alias("recall"), F.round(F.avg(F.when(has, F.coalesce(1 / F.col("hit"), F.lit(0.0)))), 6).alias("mrr"), F.round(F.avg(F.when(~has, (F.col("top") < least).cast("double"))), 6).alias("abstained"))


def hashed_sample(df: DataFrame, key: str, k: int, seed: str, by: str | None = None) -> DataFrame:
    """K rows (of each stratum) of the smallest md5 of seed and key: a uniform sample that any engine repeats."""
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")))
    return top_k(df, [by], [order.asc()], k).drop("rank") if by else df.orderBy(order).limit(k)


def distribution(probs: Sequence[Column]) -> tuple[Column, Column]:
    """Expected option (from 1) and entropy in nats of a distribution, after scaling to 1."""
    total = sum(probs[1:], probs[0])
    p = [F.when(total > 0, x / total).otherwise(1.0 / len(probs)) for x in probs]
    expected = sum(((i + 1) * x for i, x in enumerate(p)), F.lit(0.0))
    return F.round(expected, 6), F.round(-sum((F.when(x > 0, x * F.log(x)).otherwise(0.0) for x in p), F.lit(0.0)), 6)


def gates(values: DataFrame, limits: Sequence[tuple[str, str, float]]) -> DataFrame:
    """One row for each limit (name, least or most, bound) over a one-row table: the value, whether it holds, and whether all do."""
    rows = values.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.coalesce((F.col(n) >= b) if kind == "least" else (F.col(n) <= b), F.lit(False)).alias("passed")) for n, kind, b in limits])).alias("g")).select("g.*")
    return rows.join(F.broadcast(rows.agg(F.every("passed").alias("all_passed"))))


def confidence(parts: Sequence[tuple[Column, float, Column | None]], bonus: Column, cap: float) -> Column:
    """Weighted mean of the parts (value, weight, whether it is left out), with the weights scaled to those that count, and a capped bonus; from 0 to 1, four places.

    A missing value counts as 0 and keeps its weight; only a part that is left out (a pending result) gives up its weight.
    """
    out = [(c, v, F.lit(False) if x is None else F.coalesce(x, F.lit(False))) for c, v, x in parts]
    w = sum((F.when(x, 0.0).otherwise(v) for _, v, x in out), F.lit(0.0))
    s = sum((F.when(x, 0.0).otherwise(F.coalesce(c * v, F.lit(0.0))) for c, v, x in out), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(w > 0, s / w + F.least(bonus, F.lit(cap))).otherwise(0.0))), 4)


def merged_candidates(lists: DataFrame, key: str, k: int, most: int = 4) -> DataFrame:
    """Candidates (key, name, confidence, evidence) of several lists by name: the best confidence, up to `most` distinct pieces of evidence, the k best of a key."""
    one = lists.groupBy(key, "name").agg(F.max("confidence").alias("confidence"), F.slice(F.array_sort(F.collect_set("evidence")), 1, most).alias("evidence"))
    return top_k(one, [key], [F.desc("confidence"), F.asc("name")], k)


def with_floor(hits: DataFrame, least: float, keep: int) -> DataFrame:
    """Hits (qid, docid, score) of `least` or more, but never fewer than the `keep` best of a query."""
    return top_k(hits, ["qid"], [F.desc("score"), F.asc("docid")], 1 << 30).where((F.col("score") >= least) | (F.col("rank") <= keep))


def final_results(hits: DataFrame, k: int) -> DataFrame:
    """Per query by grounding, then score; of a document the first, k of them, ranked."""
    first = top_k(hits, ["qid", "docid"], [F.desc("grounding"), F.desc("score"), F.asc("chunk")], 1).drop("rank")
    return top_k(first, ["qid"], [F.desc("grounding"), F.desc("score"), F.asc("docid")], k)


def infer_topic(text: Column, rules: Sequence[tuple[str, Sequence[str]]], least: int, rest: str) -> Column:
    """The topic with the most keyword hits (first on ties) if it has `least`, else the rest."""
    scores = F.array(*[F.struct(C.keyword_hits(text, w).alias("s"), F.lit(-i).alias("p"), F.lit(n).alias("t")) for i, (n, w) in enumerate(rules)])
    best = F.array_max(scores)
    return F.when(best["s"] >= least, best["t"]).otherwise(rest)


def unsupported_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of a claim that its evidence does not hold."""
    digits = lambda c: F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
    return F.array_except(digits(claim), digits(evidence))


def roll_up(units: DataFrame, by: str) -> DataFrame:
    """The status of a run from its units' (failed, running, partial or succeeded) and how many have each."""
    n = {s: F.count_if(F.col("status") == s) for s in ("succeeded", "failed", "running")}
    own = units.groupBy(by).agg(*[v.alias(s) for s, v in n.items()], F.count("*").alias("n"))
    status = F.when(F.col("running") > 0, "running").when(F.col("failed") == F.col("n"), "failed").when(F.col("failed") > 0, "partial").otherwise("succeeded")
    return own.select(by, status.alias("status"), "succeeded", "failed", "running")


def overlaid(declared: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """N50: declared rows with those of the plan laid over them by key."""
    both = declared.withColumn("_o", F.lit(0)).unionByName(plan.withColumn("_o", F.lit(1)))
    return best_row(both, list(keys), ["_o"]).drop("_o")


#: Quotes from ANCHORED code points on meet texts by the smallest hash of GRAM code points in a row among their first ANCHORED ones.
GRAM, ANCHORED = 8, 16


def _anchors(texts: pd.Series) -> pd.Series:
    """Of each ANCHORED code points in a row the smallest hash of GRAM of them."""

    def of(text):
        h = _hashes(_codes(text or ""), GRAM)
        n = ANCHORED - GRAM + 1
        return np.unique(np.lib.stride_tricks.sliding_window_view(h, n).min(axis=1)).view(np.int64) if len(h) >= n else np.zeros(0, np.int64)

    return texts.map(of)


def exact_evidence(quotes: DataFrame, views: DataFrame) -> DataFrame:
    """Quotes (id, group, quote) with the narrowest view (group, view, text) of their group that holds them, and the place; without one, null.

    A text that holds a quote holds its first code points, so it has the quote's anchor; texts are
    compared with quotes of their own anchors only. Shorter quotes are sought in all texts of their
    group, each distinct one once.
    """
    at, anchors = F.position(F.col("quote"), F.col("text")), F.pandas_udf(_anchors, "array<long>")
    asked = quotes.where("quote is not null and group is not null").select("group", "quote").distinct()
    own = saved(views.where("text is not null and group is not null").select("group", "view", "text", F.monotonically_increasing_id().alias("_row")))
    marked = asked.where(F.length("quote") >= ANCHORED).select("group", "quote", F.get(anchors(F.left("quote", F.lit(ANCHORED))), 0).alias("_a"))
    met = own.select("group", "_row", F.explode(anchors("text")).alias("_a")).join(marked, ["group", "_a"]).select("_row", "quote")
    long = met.join(own, "_row").select("group", "quote", "view", "text")
    short = asked.where(F.length("quote") < ANCHORED).join(own, "group").select("group", "quote", "view", "text")
    found = long.unionByName(short).where(at > 0).groupBy("group", "quote").agg(F.min(F.struct(F.length("text").alias("n"), "view", (at - 1).alias("start"))).alias("v"))
    hit = quotes.join(found, ["group", "quote"]).groupBy("id").agg(F.min("v").alias("v"))
    return quotes.select("id").join(hit, "id", "left").select("id", "v.view", "v.start")


def exact_row(refs: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Refs with the one block of the same address; none where several have it."""
    one = blocks.groupBy(*keys).agg(F.min("block").alias("block"), F.count("*").alias("n"))
    return refs.join(one.where("n = 1").drop("n"), list(keys), "left")


def reviews_in_force(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of reviews (candidate, hash, revision, verdict, current) the latest that still matches its candidate's hash, and only if it is current; no older one takes its place."""
    own = reviews.join(candidates.select("candidate", "hash"), ["candidate", "hash"])
    return best_row(own, ["candidate"], ["revision"]).where("current").select("candidate", "revision", "verdict")


def confusion(pairs: DataFrame, by: str, truth: str, said: str) -> DataFrame:
    """Counts, precision, recall and false-positive rate of each category; rates without a base are 0."""
    t, s = F.col(truth), F.col(said)
    n = pairs.groupBy(by).agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    rate = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0), 6)
    return n.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn")).withColumn("fpr", rate("fp", "tn"))


def priority_rank(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Of each overlap key the row with the largest order columns, then all ranked by them."""
    return best_row(rows, [by], order)


def stale_copies(chunks: DataFrame) -> DataFrame:
    """Chunks (case_id, chunk) of cases that have a current one (case_id__chunk-0) beside others: the others are stale."""
    current = F.concat(F.col("case_id"), F.lit("__chunk-0"))
    n = chunks.groupBy("case_id").agg(F.count("*").alias("n"), F.max((F.col("chunk") == current).cast("int")).alias("current"))
    return chunks.join(n.where("n > 1 and current = 1"), "case_id").where(F.col("chunk") != current).select("case_id", "chunk", "n")
