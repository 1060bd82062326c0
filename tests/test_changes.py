"""Guarded impacts, replayed histories in batch and stream, row lookups and duplicate pairs against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from skarn.operators import changes as H
from skarn.operators import duplicates as U
from skarn.operators import lexicon as L
from skarn.operators.records import LOCATION_SCORE

AT = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
HISTORY = "before string, after string, run string, requirement string, impact string, uses boolean, blocks array<string>, recorded timestamp, seq long"


def history(n=200, seed=2):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.choice("cd"), f"run{rng.randrange(9)}", f"q{rng.randrange(6)}", rng.choice(("unaffected", "affected", "unknown")), rng.random() < 0.7, rng.choice((None, [], [f"b{rng.randrange(8)}", None, "b1"])), AT(rng.randrange(60)), i) for i in range(n)]


def replay(rows, evidence):
    """The history in time order, one row after the other."""
    out = {}
    for before, after, run, req, impact, uses, blocks, _, _ in sorted(rows, key=lambda r: r[7:]):
        e = out.setdefault((before, after), {"run": set(), "block": set(), "claim": set(), "requirement": set()})
        e["run"].add(run)
        e["block"] |= {b for b in blocks or [] if b}
        e["claim"] |= {c for c, v, b in evidence if v == before and b in e["block"]}
        e["requirement"].discard(req)
        if impact != "unaffected" and uses:
            e["requirement"].add(req)
    return {(*pair, k, i) for pair, e in out.items() for k, items in e.items() for i in items}


def test_history_is_replayed_in_time_order(spark):
    rows = history()
    evidence = [(f"c{i}", "ab"[i % 2], f"b{i % 5}") for i in range(12)]
    ev = spark.createDataFrame(evidence, "claim string, version string, block string")
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        got = {tuple(r) for r in H.invalidations(spark.createDataFrame(rows + rows[:5], HISTORY), ev).collect()}
        assert got == replay(rows, evidence)
    assert H.invalidations(spark.createDataFrame([], HISTORY), ev).count() == 0


def test_stream_and_batch_agree_on_shuffled_batches(spark, tmp_path):
    rows = history(90, 7)
    random.Random(5).shuffle(rows)
    last = {}
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], HISTORY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = H.impact_state(spark.readStream.schema(HISTORY).parquet(str(tmp_path / "in")))
        keep = lambda df, n: last.update({tuple(r)[:3]: tuple(r)[3:] for r in df.collect()})
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r)[:3]: tuple(r)[3:] for r in H.latest_impacts(spark.createDataFrame(rows, HISTORY)).collect()}
    assert last == want


def test_stale_judgements_are_unknown(spark):
    kind = "requirement string, revision int, assessment string, status string"
    current = spark.createDataFrame([("a", 1, "x", "done"), ("b", 2, "x", "done"), ("c", 1, None, "done"), ("d", 1, "y", "done"), ("e", 1, "x", "done")], kind)
    judged = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, None), ("d", 1, "x")], "requirement string, revision int, assessment string")
    impacts = spark.createDataFrame([("r", k, i, True, AT(1)) for k, i in (("a", "affected"), ("b", "unaffected"), ("c", "unaffected"), ("d", "affected"), ("z", "affected"))], "run string, requirement string, impact string, new_relevance boolean, recorded timestamp")
    after, rows = H.apply_impacts(current, judged, impacts)
    assert {r.requirement: r.status for r in after.collect()} == {"a": "needs_review", "b": "needs_review", "c": "done", "d": "needs_review", "e": "done"}
    assert {(r.requirement, r.impact, r.new_relevance, r.stale) for r in rows.collect()} == {("a", "affected", True, False), ("b", "unknown", False, True), ("c", "unaffected", True, False), ("d", "unknown", False, True)}


def test_rows_that_refer_to_an_id(spark):
    links = spark.createDataFrame([("l1", "x"), ("l2", None), ("l3", "y")], "k string, target string")
    sets = spark.createDataFrame([(1, ["x", "x", "y"]), (2, None)], "k int, ids array<string>")
    got = H.referring(spark.createDataFrame([("x",), ("x",), (None,)], "id string"), {"links": (links, "k", "target"), "sets": (sets, "k", "ids")})
    assert sorted(map(tuple, got.collect())) == [("x", "links", "l1"), ("x", "sets", "1")]


def test_rows_picked_by_fields_and_values(spark):
    fields = [("r1", {"단지명": "가나", "No_1": "10"}), ("r2", {"단지명": "가나", "No_1": "100"}), ("r3", {"단지명": "다라", "No_1": "10"}), ("r4", {"단지명": "가나"}), ("r5", None), ("r6", {"No_1": None})]
    asked = [("both", "단지명: '가나' 의 No_1 = 10 은?"), ("one", "단지명 가나"), ("miss", "단지명=가나, No_1=10.5"), ("none", "nothing"), ("apart", "No110 단지명가나 단지명다라"), ("empty", None)]
    q, r = spark.createDataFrame(asked, "qid string, text string"), spark.createDataFrame(fields, "block string, fields map<string,string>")
    ranked = spark.createDataFrame([(k, "r5", 1) for k, _ in asked], "qid string, block string, rank int")
    picked, summary = L.row_lookup(q, r, ranked)
    got = {}
    for x in picked.collect():
        got.setdefault(x.qid, {}).setdefault(x.state, set()).add(x.block)
    assert got == {
        "both": {"matched": {"r1"}, "excluded": {"r2", "r3"}}, "one": {"matched": {"r1", "r2", "r4"}, "excluded": {"r3"}}, "miss": {"matched": {"r1", "r2", "r4"}, "excluded": {"r3"}},
        "none": {"ranked": {"r5"}}, "apart": {"matched": {"r1", "r3"}, "excluded": {"r2"}}, "empty": {"ranked": {"r5"}},
    }
    assert {x.qid: (x.bindings, x.lookup_miss) for x in summary.collect()} == {"both": (2, False), "one": (1, False), "miss": (1, False), "none": (0, False), "apart": (2, False), "empty": (0, False)}
    lost, told = L.row_lookup(spark.createDataFrame([("m", "No_1 100 단지명 다라")], "qid string, text string"), r, ranked.withColumn("qid", F.lit("m")))
    assert [tuple(x) for x in lost.distinct().collect()] == [("m", "r5", "ranked")] and told.first().lookup_miss


def plain_pairs(rows, hours, least):
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0.0
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            gap = abs((a["ts"] - b["ts"]).total_seconds()) / 3600
            if gap > hours:
                continue
            da, db, ra, rb = a["details"] or [], b["details"] or [], a["region"], b["region"]
            if not (ra or da or rb or db):
                state = "missing"
            elif not (ra or da) or not (rb or db):
                state = "ambiguous"
            elif da and db:
                near = any(len(s) >= 4 and t.startswith(s) for x in da for y in db for s, t in [sorted((x, y), key=len)])
                state = "exact" if set(da) & set(db) else "nearby" if near else "conflict"
            else:
                state = "conflict" if not ra or ra != rb else "ambiguous" if a["broad"] else "exact"
            if state == "conflict" or state == "ambiguous" and (a["pii"] or b["pii"]):
                continue
            dot = sum(x * y for x, y in zip(a["v"], b["v"])) / (sum(x * x for x in a["v"]) * sum(y * y for y in b["v"])) ** 0.5
            unit = 0.5 if not a["units"] or not b["units"] else float(bool(set(a["units"]) & set(b["units"])))
            seg = max(jac(x, y) for x in a["segments"] for y in b["segments"]) if a["segments"] and b["segments"] else jac(a["toks"], b["toks"])
            parts = (min(1, max(0, dot)), LOCATION_SCORE[state], jac(a["entities"], b["entities"]), float(a["request"] == b["request"]), unit, 1.0 if gap <= 24 else 0.8 if gap <= 72 else 0.4, seg)
            score = sum(w * p for w, p in zip(U.WEIGHTS.values(), parts))
            if round(score, 4) >= least and (state != "ambiguous" or round(score, 4) >= 0.8):
                out[a["id"], b["id"]] = (state, round(score, 4))
    return out


def test_duplicate_pairs_match_all_pairs(spark):
    rng = random.Random(9)
    pick = lambda xs, k: [rng.choice(xs) for _ in range(rng.randrange(k))]
    rows = []
    for i in range(110):
        details = pick(["park north", "park nor", "abc", "abcd", "mart", "market hall"], 3)
        segments = rng.choice((None, [], [pick("xyzw", 4), ["x", "y"]]))
        rows.append({"id": i, "ts": AT(rng.randrange(60 * 24 * 12)), "region": rng.choice((None, "r1", "r2")), "details": details if rng.random() < 0.6 else rng.choice((None, [])), "entities": pick("efg", 4) or None, "units": pick("uv", 3),
                     "request": rng.choice(("fix", "ask")), "segments": segments, "toks": pick("xyzw", 5), "v": [rng.random() + 0.1, rng.random(), rng.random()], "pii": rng.choice((True, False, None))})
        rows[-1]["broad"] = rows[-1]["region"] == "r2"
    same = {"ts": AT(7), "details": None, "entities": ["only"], "units": ["u"], "request": "fix", "segments": [["x"]], "toks": ["x"], "v": [1.0, 0.5, 0.5], "pii": False}
    rows += [{"id": 200, "region": "r1", "broad": False, **same}, {"id": 201, "region": None, "broad": False, **same}]
    kind = "id long, ts timestamp, region string, broad boolean, details array<string>, entities array<string>, units array<string>, request string, segments array<array<string>>, toks array<string>, v array<double>, pii boolean"
    names = [c.split()[0] for c in kind.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], kind)
    for least in (0.5, 0.3):
        got = {(r.a, r.b): (r.state, r.score) for r in U.candidates(df, least=least).collect()}
        want = plain_pairs(rows, 168, least)
        assert {k: (got.get(k), want[k]) for k in want if k not in got} == {} and got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1.1e-4 for k in want)
    assert {s for s, _ in want.values()} == {"exact", "nearby", "ambiguous", "missing"}
    assert U.candidates(df.limit(0)).count() == 0


def test_nested_texts_are_masked(spark):
    from skarn.operators import records as R

    kind = "id string, n int, s struct<a:string,b:array<struct<c:string,d:int>>>, m map<string,string>, x array<int>"
    rows = [("a@b.co", 1, ("x a@b.co", [("010-1234-5678", 2), (None, 3)]), {"a@b.co": "a@b.co"}, [1]), (None, None, None, None, None)]
    got = R.mask_strings(spark.createDataFrame(rows, kind), keep=["id"]).collect()
    mail, phone = "[REDACTED:EMAIL]", "[REDACTED:PHONE]"
    assert got[0] == ("a@b.co", 1, (f"x {mail}", [(phone, 2), (None, 3)]), {"a@b.co": mail}, [1]) and tuple(got[1]) == (None,) * 5


def test_bounds_of_validity(spark):
    import pytest

    from skarn.operators import records as R

    kind = "k int, dates array<struct<role:string,value:string,precision:string,evidence_ids:array<string>>>, evidence array<string>"
    d = lambda role, value, precision="day", ids=("e1",): (role, value, precision, list(ids))
    both = [d("valid_to", "2024-02-29"), d("event", "never", None, ()), d("valid_from", "2024-01-01", ids=("e1", "e2"))]
    rows = [(1, both, ["e1", "e2"]), (2, [d("valid_from", "2024-01-01")], ["e1"]), (3, [], None), (4, None, ["e1"]), (5, [d("event", None)], None)]
    got = {r.k: tuple(r.v) if r.v else None for r in spark.createDataFrame(rows, kind).select("k", R.validity_bounds("dates", "evidence").alias("v")).collect()}
    assert got == {1: ("2024-01-01", "2024-02-29"), 2: ("2024-01-01", None), 3: (None, None), 4: None, 5: (None, None)}
    wrong = [[d("valid_from", "2024-1-1")], [d("valid_from", "2023-02-29")], [d("valid_to", "2024-01-01", "month")], [d("valid_to", "2024-01-01", ids=())], [d("valid_to", "2024-01-01", ids=("e9",))], [d("valid_to", None)], [d("valid_to", "2024-01-01")] * 2, [d("valid_from", "2024-02-01"), d("valid_to", "2024-01-01")]]
    for dates in wrong:
        with pytest.raises(Exception, match="validity"):
            spark.createDataFrame([(1, dates, ["e1"])], kind).select(R.validity_bounds("dates", "evidence").alias("v")).collect()


def test_listing_filters_only_by_given_values(spark):
    from skarn.operators import records as R

    df = spark.createDataFrame([(1, "a", ["x"], 0.5), (2, "a", ["x", "y"], 0.9), (3, "b", None, 0.7)], "k int, status string, members array<string>, c double")
    ids = lambda **kw: [r.k for r in R.listed(df, ["c"], **kw).collect()]
    assert ids() == [2, 3, 1] and ids(equal={"status": "a"}, holding={"members": None}) == [2, 1] and ids(equal={"status": ""}, holding={"members": "y"}) == [2] and ids(holding={"members": "z"}) == []


def test_blocks_are_made_distinct_once(spark):
    """A history's blocks go straight from their own grouping to the result; no grouping over all kinds follows."""
    out = H.invalidations(spark.createDataFrame([], HISTORY), spark.createDataFrame([], "claim string, version string, block string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")
