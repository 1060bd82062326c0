"""Impacts of changed sources: guarded updates, and what a history of impacts leaves open."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["before", "after"]


def apply_impacts(current: DataFrame, judged: DataFrame, impacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requirements after a run of impacts, and the run's history rows.

    current: requirement, revision, assessment, status as they are now; judged: requirement, revision,
    assessment as the run has seen them; impacts: run, requirement, impact, new_relevance, recorded. If a
    requirement has moved on since it was judged, or was not judged, its impact is unknown and not newly
    relevant. Any impact but unaffected puts the requirement up for review. Impacts on requirements that
    don't exist are left out; null and null are the same revision.
    """
    seen = judged.select("requirement", F.col("revision").alias("_r"), F.col("assessment").alias("_a"), F.lit(True).alias("_seen"))
    met = impacts.join(current.select("requirement", "revision", "assessment"), "requirement").join(seen, "requirement", "left")
    fresh = F.coalesce(F.col("_seen"), F.lit(False)) & F.col("revision").eqNullSafe(F.col("_r")) & F.col("assessment").eqNullSafe(F.col("_a"))
    history = met.select("run", "requirement", F.when(fresh, F.col("impact")).otherwise("unknown").alias("impact"), (F.col("new_relevance") & fresh).alias("new_relevance"), (~fresh).alias("stale"), "recorded")
    hit = history.groupBy("requirement").agg(F.bool_or(F.col("impact") != "unaffected").alias("_hit"))
    after = current.join(hit, "requirement", "left").withColumn("status", F.when(F.col("_hit"), "needs_review").otherwise(F.col("status"))).drop("_hit")
    return after, history


def latest_impacts(history: DataFrame) -> DataFrame:
    """Before, after, requirement with the impact, uses and time of its latest row (recorded, then seq)."""
    last = history.groupBy(*PAIR, "requirement").agg(F.max_by(F.struct("impact", "uses", "recorded"), F.struct("recorded", "seq")).alias("x"))
    return last.select(*PAIR, "requirement", "x.impact", "x.uses", "x.recorded")


def invalidations(history: DataFrame, evidence: DataFrame) -> DataFrame:
    """Before, after, kind (run, block, claim or requirement), item: what a history of impacts invalidates, one row for each.

    history: before, after, run, requirement, impact, uses (whether the requirement's assessment uses the
    version before), blocks (ids that the run's change touches), recorded, seq. Runs and blocks of a pair of
    versions add up over its whole history; claims are those with evidence (claim, version, block) in one
    of the blocks of the version before; of each requirement its latest impact counts, and it is open
    if that is anything but unaffected and its assessment uses the version. Null items are left out.
    """
    # Each kind is made distinct once, on its own
    found = lambda rows, kind, item: rows.select(*PAIR, F.lit(kind).alias("kind"), F.col(item).alias("item"))
    once = lambda rows, item: rows.where(F.col(item).isNotNull()).select(*PAIR, item).distinct()
    blocks = once(history.select(*PAIR, F.explode("blocks").alias("block")), "block")
    claims = blocks.join(evidence.select("claim", F.col("version").alias("before"), "block"), ["before", "block"])
    open_ = latest_impacts(history).where((F.col("impact") != "unaffected") & F.col("uses") & F.col("requirement").isNotNull())
    parts = [found(once(history, "run"), "run", "run"), found(blocks, "block", "block"), found(once(claims, "claim"), "claim", "claim"), found(open_, "requirement", "requirement")]
    return reduce(DataFrame.unionByName, parts)


IMPACT = "before string, after string, requirement string, impact string, uses boolean, recorded timestamp"


def impact_state(stream: DataFrame) -> DataFrame:
    """N52 on a stream: latest_impacts kept as state, one small row for each pair and requirement; in whatever batches the history comes, the last update of a key equals the batch result."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for b in batches:
            for r in b.itertuples():
                own = (r.recorded.to_pydatetime(), int(r.seq), r.impact, bool(r.uses))
                if best is None or own[:2] >= tuple(best[:2]):
                    best = own
        state.update(best)
        yield pd.DataFrame([(*key, best[2], best[3], best[0])], columns=[*PAIR, "requirement", "impact", "uses", "recorded"])

    return stream.groupBy(*PAIR, "requirement").applyInPandasWithState(update, IMPACT, "recorded timestamp, seq long, impact string, uses boolean", "update", "NoTimeout")


def referring(identifiers: DataFrame, tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Id, table, row, of every row that refers to an id. tables: name to (rows, key column, column of the reference or of an array of references)."""
    out = None
    for name, (rows, key, column) in tables.items():
        many = dict(rows.dtypes)[column].startswith("array")
        own = rows.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("row"), F.explode(F.array_distinct(column)).alias("id") if many else F.col(column).alias("id"))
        one = own.withColumn("id", F.col("id").cast("string"))
        out = one if out is None else out.unionByName(one)
    return identifiers.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct().join(out, "id").select("id", "table", "row")
