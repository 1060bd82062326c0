"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from skarn.functions import columns as C
from skarn.operators import evaluation as E
from skarn.operators import events as V
from skarn.operators import relations as J
from skarn.operators import retrieval as R
from skarn.operators import text as X
from skarn.operators import windows as W
from skarn.plans import pipelines


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_ir_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", d, i + 1, 1.0) for i, d in enumerate(["D1", "D3", "D2", "D5"])], "qid string, docid string, rank int, score double")
    rel = spark.createDataFrame([("q", "D1", 3), ("q", "D3", 2), ("q", "D5", 1)], "qid string, docid string, rel int")
    got = E.ir_metrics(run, rel, 5).first()
    assert (got.recall, got.precision, got.rr) == (1.0, 0.6, 1.0)
    assert got.ap == pytest.approx((1 + 1 + 3 / 4) / 3, abs=1e-6)


def test_kappas_of_perfect_agreement(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3, i % 3) for i in range(9)], "id int, a int, b int, c int")
    assert E.cohen_linear(df, "a", "b").first().kappa == 1.0
    assert E.fleiss(df, "id", ["a", "b", "c"]).first().kappa == 1.0
    judges = spark.createDataFrame([(None, 2, 1), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in judges.select(E.median_judge(judges, ["a", "b", "c"])).collect()] == [1, 0]


def test_columns(spark):
    r = one(
        spark,
        C.clean_text(F.lit(" a_x000D_\r\n\r\n\r\n\r\nb\t\tc\x01 ")).alias("clean"), C.mask_pii(F.lit("mail a.b@c.org, 010-1234-5678 김철수님 900101-1234567 12가 3456 세종로 12 101동 202호")).alias("mask"), C.chunks(F.lit("x" * 901)).alias("chunks"), C.chunks(F.lit("")).alias("none"),
        C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"), C.is_open(F.lit(" Closed "), ["closed"]).alias("open"), C.is_night(F.lit(23), 22, 6).alias("night"),
        C.region_compatible(F.lit("Seoul"), F.lit("Se")).alias("near"), C.tokens_with_bigrams(F.lit("도로 a ab")).alias("grams"), C.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
    )
    assert r.clean == "a\n\nb c" and r.mask == "mail [REDACTED:EMAIL], [REDACTED:PHONE] [REDACTED:NAME] [REDACTED:RRN] [REDACTED:VEHICLE] [REDACTED:ADDRESS] [REDACTED:ADDRESS_DETAIL]"
    assert [len(c) for c in r.chunks] == [500, 500, 101] and r.none == []
    assert r.zero == 0.0 and r.open is False and r.night and r.near
    assert r.grams == ["도로", "ab", "도로"] and r.half == pytest.approx(20015.0868, abs=1e-3)


def test_windows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, W.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, W.add_missing(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    page = W.page(spark.range(5), [F.asc("id")], 2, 2).collect()
    assert [(r.id, r.next_offset) for r in page] == [(2, 4), (3, 4)]
    last = W.page(spark.range(5), [F.asc("id")], 3, 2).collect()
    assert [r.next_offset for r in last] == [None, None]


def test_pairs_in_time_match_brute_force(spark):
    rows = [(i, (i * 7919) % 500_000, i % 3) for i in range(200)]
    e = spark.createDataFrame(rows, "id int, t long, k int").select("id", F.timestamp_seconds("t").alias("ts"), "k")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and abs(a[1] - b[1]) <= 36_000}
    got = [(r.a, r.b) for r in V.near_in_time(e, e, 10, ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert V.pair_count(e, 10, ["k"]).agg(F.sum("pairs")).first()[0] == len(want)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a long, b long")
    got = {r.node: r.component for r in V.components(edges, spark.range(22).withColumnRenamed("id", "node")).collect()}
    assert got == {i: 0 if i < 10 else 10 if i < 21 else 21 for i in range(22)}


def test_relations(spark):
    links = spark.createDataFrame([(1, 2), (2, 3)], "id long, next long")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    assert {r.id: r.end for r in J.live_target(links, ids).collect()} == {1: 3, 2: 3, 3: 3, 4: 4}
    with pytest.raises(Exception, match="cycle"):
        J.live_target(spark.createDataFrame([(1, 2), (2, 1)], "id long, next long"), ids).collect()
    with pytest.raises(Exception, match="repeated key"):
        J.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()
    names = spark.createDataFrame([("road act", ["road", "act"]), ("act", ["act"])], "name string, toks array<string>")
    texts = spark.createDataFrame([(1, ["the", "road", "act", "and", "act"])], "id int, toks array<string>")
    assert sorted((r.name, r.start) for r in J.dictionary_matches(texts, "id", names).collect()) == [("act", 4), ("road act", 1)]


def test_knn_agrees_with_numpy(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 8))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "docid long, v array<double>")
    got = R.knn_cosine(base, base.where("docid < 5").withColumnRenamed("docid", "qid"), 4, block=64, query_block=2).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(5):
        best = np.argsort(-(u @ u[q]))[:4].tolist()
        assert [r.docid for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == best


def test_html_blocks_and_tables():
    rows = X.parse_html("<h1>T</h1><p>a <b>b</b></p><script>x</script><table><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table>")
    assert [(r[2], r[3], r[4]) for r in rows] == [("T", None, None), ("a b", None, None), ("1", 0, 0), ("2", 0, 1), ("3", 1, 1)]
    assert X.parse_html(None) == []


def test_named_stages(spark):
    docs = spark.createDataFrame([(1, "red road"), (2, "blue road"), (3, "green")], "docid long, text string")
    queries = spark.createDataFrame([(1, "red road")], "qid long, text string")
    spec = [{"name": "lex", "type": "bm25", "k": 3}, {"name": "top", "type": "rerank", "input": "lex", "terms": {"blue": 5.0}}]
    out = pipelines.run(spec, {"docs": docs, "queries": queries})
    assert [r.docid for r in out["lex"].orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError, match="unknown stage"):
        pipelines.run([{"name": "x", "type": "none"}], {})


def test_long_chains_and_paths(spark):
    n = 100
    links = spark.range(n).select("id", (F.col("id") + 1).alias("next"))
    got = J.live_target(links, spark.range(n + 1)).collect()
    assert len(got) == n + 1 and {r.end for r in got} == {n}
    order = [(i * 7919) % 2003 for i in range(2003)]  # a path through shuffled ids
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert V.components(edges, spark.range(2003).withColumnRenamed("id", "node")).select("component").distinct().count() == 1
    text = spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert {r.node: r.component for r in V.components(text, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_names_of_many_lengths(spark):
    toks = [f"w{i}" for i in range(300)]
    at, names = 0, []
    for n in range(1, 21):
        names.append((f"n{n}", toks[at : at + n]))
        at += n + 1
    got = J.dictionary_matches(spark.createDataFrame([(1, toks)], "id int, toks array<string>"), "id", spark.createDataFrame(names, "name string, toks array<string>")).collect()
    assert {r.name for r in got} == {n for n, _ in names}


def test_evidence_awkward_values(spark):
    from skarn.operators import evidence as E

    one = spark.range(1).select(F.lit("제0012조 도로법 제3조").alias("t"), F.lit(None).cast("string").alias("nothing"))
    got = one.select(
        E.legal_citations(F.col("t"), ["도로법"]).alias("c"), E.legal_citations(F.col("nothing")).alias("c0"), E.union_of_ids(F.lit(None), F.array(F.lit(" a "), F.lit("a"), F.lit(""))).alias("ids"),
        E.stated_confidence(F.col("nothing")).alias("s0"), E.stated_confidence(F.lit("nan")).alias("s1"), E.epoch_of(F.lit("1970-01-02")).alias("day"), E.epoch_of(F.col("nothing")).alias("no_day"), E.epoch_of(F.lit("soon")).alias("odd_day"),
        E.danger_signals(F.col("nothing"), ["a"], "b").alias("d0"), E.higher(F.lit("?"), F.lit("보통")).alias("level"), E.floor_mean(F.lit(None), F.lit(None)).alias("m"), E.literal(F.lit("1,23"), "number").alias("n"), E.literal(F.lit("2023-02-30"), "date").alias("d"),
        E.without_spans(F.col("t"), E.legal_citations(F.col("t"), ["도로법"])).alias("cut"), E.without_spans(F.col("t"), E.legal_citations(F.col("t"))).alias("overlap"),
    ).collect()[0]
    assert [(c["law"], c["article"], c["start"], c["stop"]) for c in got["c"]] == [("", "제12조", 0, 6), ("도로법", "제3조", 7, 14)]
    assert got["c0"] == [] and got["ids"] == ["a"] and (got["s0"], got["s1"]) == (0.5, 0.5)
    assert (got["day"], got["no_day"], got["odd_day"]) == (86400 - 9 * 3600, 0, 0)
    assert got["d0"] == [] and got["level"] == "보통" and got["m"] is None and not got["n"]["ok"] and not got["d"]["ok"]
    assert got["cut"] == E.REMOVED + " " + E.REMOVED and got["overlap"] == E.REMOVED


def test_evidence_empty_tables(spark):
    from skarn.operators import evidence as E

    cited = spark.createDataFrame([], "qid long, pos long, chunk_id string, case_id string, snippet string")
    context = spark.createDataFrame([(1, 1, "a", "x", "s"), (1, 2, None, "x", "s"), (1, 3, "b", None, "t")], cited.schema)
    assert [(r.ref_id, r.chunk_id) for r in E.kept_citations(cited, context).collect()] == [(1, "a")]
    assert E.kept_citations(cited, cited).count() == 0 and E.packed_context(cited, 3, 100).count() == 0
    assert [r.problem for r in E.citation_problems(context, cited).collect()] == ["unknown"] * 3
    assert E.report_summary(spark.createDataFrame([], "a double, level string"), ["a"], "level").collect()[0]["n_cases"] == 0
    packed = E.packed_context(context, 3, 100).collect()[0]
    assert (packed["n_kept"], packed["n_dropped"]) == (1, 2)


def test_links_of_a_group_are_joined_in_their_task(spark, monkeypatch):
    """Of all links among a group's nodes one for each node is written, also where a task holds few nodes."""
    monkeypatch.setattr(V, "HELD", 7)
    edges = spark.createDataFrame([(f"{g}{i:02d}", f"{g}{j:02d}") for g in "xy" for i in range(30) for j in range(i)] + [("z", "z")], "a string, b string")
    sizes, saved = [], V.saved
    monkeypatch.setattr(V, "saved", lambda df: sizes.append((out := saved(df)).count()) or out)
    assert {r.node: r.component for r in V.components(edges).collect()} == {f"{g}{i:02d}": f"{g}00" for g in "xy" for i in range(30)}
    assert sizes[0] < 400
