"""Steps that have to grow no faster than their input, against plain loops."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.operators import duplicates as U
from skarn.operators import evidence as V
from skarn.operators import graphs as G
from skarn.operators import knowledge as K
from skarn.operators import lexicon as L
from skarn.operators import records as N
from skarn.operators import retrieval as R
from skarn.operators import terms as T
from skarn.operators import text as X
from skarn.operators.batches import pieces
from skarn.plans import relation_queries


@pytest.mark.parametrize("few", [None, True, False])
def test_set_join(spark, few):
    rng = random.Random(5)
    sets = lambda n: [(i // 2 * 2 if i < 6 else i, rng.sample([f"w{k}" for k in range(12)], rng.randrange(0, 8))) for i in range(n)]
    left, right = sets(15), sets(40)
    want = []
    for i, x in left:
        for j, y in right:
            same = len(set(x) & set(y))
            if same and same / (len(x) + len(y) - same) >= 0.4:
                want.append((i, j, round(same / (len(x) + len(y) - same), 6)))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, t array<string>")
    got = [tuple(r) for r in X.set_join(frame(left, "i"), frame(right, "j"), "i", "j", 0.4, few).collect()]
    assert sorted(got) == sorted(want)


def test_pieces_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * (30_000 if i % 50 == 0 else 10) for i in range(999)] + [None])], names=["id", "text"])
    cut = list(pieces([batch.slice(0, 0), batch], rows=100, size=40_000))
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(1000))
    assert all(b.num_rows <= 100 and (b.nbytes <= 40_000 or b.num_rows == 1) for b in cut) and len(cut) > 10


def test_terms_flushed_in_between(spark, monkeypatch):
    monkeypatch.setattr(T, "HELD", 3)
    rows = [(i, "ab cd ab" if i % 2 else None) for i in range(600)]
    got = {r.term: (r.tf, r.df) for r in T.gram_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got[" ab "] == (600, 300) and got["cd"] == (300, 300)


def test_bm25_tasks_grow_with_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(400)], "docid long, text string")
    asked = spark.createDataFrame([(1, "a b3"), (2, "c c")], "qid long, text string")
    whole = sorted(map(tuple, R.bm25_top_k(docs, asked, 5).collect()))
    monkeypatch.setattr(R, "POSTINGS", 20)
    scored = R.bm25(docs, asked)
    assert scored.rdd.getNumPartitions() > 40
    assert sorted(map(tuple, R.bm25_top_k(docs, asked, 5).collect())) == whole


def test_bm25_tasks_grow_with_what_queries_meet(spark, monkeypatch):
    """Short texts that all queries meet: few postings, but a sum for each query and text."""
    docs = spark.createDataFrame([(i, f"a b{i % 7}") for i in range(300)], "docid long, text string")
    asked = spark.createDataFrame([(q, f"a b{q % 7}") for q in range(40)], "qid long, text string")
    whole = sorted(map(tuple, R.bm25_top_k(docs, asked, 5).collect()))
    monkeypatch.setattr(R, "MET", 400, raising=False)
    assert R.bm25(docs, asked).rdd.getNumPartitions() >= 30
    assert sorted(map(tuple, R.bm25_top_k(docs, asked, 5).collect())) == whole and len(whole) == 200


@pytest.mark.parametrize("few", [True, False])
def test_bm25_moves_a_row_for_each_text(spark, monkeypatch, few):
    """A task that deals out its split holds rows of texts, not of postings; scores against a loop."""
    rng = random.Random(9)
    texts = [(i, None if i % 17 == 0 else " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.choice([0, 3, 40])))) for i in range(120)]
    asked = [(q, " ".join(f"w{k}" for k in rng.choices(range(34), k=12))) for q in range(6)]
    toks = {i: t.split() for i, t in texts if t is not None}
    mean = sum(map(len, toks.values())) / len(toks)
    want = {}
    for q, words in asked:
        for w in words.split():
            df = sum(w in t for t in toks.values())
            for i, t in toks.items():
                if tf := t.count(w):
                    want[q, i] = want.get((q, i), 0) + np.log((len(toks) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    moved, held = [], R.postings
    monkeypatch.setattr(R, "postings", lambda *a: moved.append(held(*a)) or moved[-1])
    if not few:
        monkeypatch.setattr(R, "BROADCAST_TERMS", 0)
    got = {(r.qid, r.docid): r.score for r in R.bm25(spark.createDataFrame(texts, "docid long, text string"), spark.createDataFrame(asked, "qid long, text string")).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert not few or moved[0].count() <= len(toks) + 8


@pytest.mark.parametrize("extra", [[], [(0, 0), (1, 0), (0, 1), (2, 1), (3, 2), (0, 3), (4, 3), (0, 2)]])
def test_pagerank_of_few_or_no_edges(spark, tmp_path, extra):
    """Nations that all trade alike have no edge at all; a few that trade more have weights of halves and quarters."""
    import duckdb

    pairs = [(c, s) for c in range(25) for s in range(25)] + extra
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, i AS c_nationkey FROM range(25) t(i)")
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, i AS s_nationkey FROM range(25) t(i)")
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT)")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE)")
    con.executemany("INSERT INTO orders VALUES (?, ?)", [(i, c) for i, (c, _) in enumerate(pairs)])
    con.executemany("INSERT INTO lineitem VALUES (?, ?, 1)", [(i, s) for i, (_, s) in enumerate(pairs)])
    for t in ("customer", "supplier", "orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = con.execute(relation_queries.REGISTRY.sql["pagerank_ppr"]).fetchall()
    got = [tuple(r) for r in relation_queries.pagerank_ppr(spark, str(tmp_path)).select("node", "score").collect()]
    assert sorted(got) == sorted(want) and all(p is not None for _, p in want)


def test_signal_values_stay_in_their_row(spark):
    rows = [(1, ["b  x", " ", "A", "a", None, "B x", "c"]), (2, []), (3, None), (4, [" "]), (5, ["q"]), (5, ["w", "Q", "w "])]
    out = N.signal_values(spark.createDataFrame(rows, "id long, v array<string>"), "id", "v")
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, ["b x", "A", "c"]), (5, ["q", "w"])]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_citations_bind_what_they_repeat(spark):
    """The text's surroundings are cut out once for each article, not once for each use."""
    df = spark.createDataFrame([("주택법 제 03조의2, 도로법 시행령 제7조",)], "t string").select(V.legal_citations(F.col("t"), ["주택법", "없는 법"]).alias("c"))
    assert [tuple(x) for x in df.first().c][0] == ("주택법", "제3조의2", 0, 11)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("substring(") == 1


def test_evidence_by_anchors(spark):
    rng = random.Random(3)
    views = [("g" if i % 3 else "h", i, "".join(rng.choice("abü ") for _ in range(rng.choice([0, 5, 15, 16, 60, 200])))) for i in range(40)] + [("g", 99, None)]
    quotes = [(i, g, t[p : p + rng.choice([0, 3, 15, 16, 24])]) for i, (g, _, t) in enumerate(views) if t for p in [rng.randrange(len(t))]] + [(500, "g", "abab" * 6), (501, None, "a"), (502, "h", None)]
    want = []
    for i, g, q in quotes:
        own = [(len(t), v, t.find(q)) for h, v, t in views if g == h and q is not None and t is not None and q in t]
        want.append((i, *(min(own)[1:] if own else (None, None))))
    out = K.exact_evidence(spark.createDataFrame(quotes, "id long, group string, quote string"), spark.createDataFrame(views, "group string, view long, text string"))
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
    assert "_a" in out._jdf.queryExecution().optimizedPlan().toString()


def test_lookups_are_counted_as_they_are_picked(spark):
    rows = [(i, {"No": str(i % 3), "kind": "ab"[i % 2], "size": None if i % 5 == 0 else str(i % 4)} if i % 7 else None) for i in range(60)]
    asked = [(1, "No 1 and kind: a"), (2, "No=1, No=2, size 3"), (3, "kind b, size 9"), (4, "nothing"), (5, "size 2, kind c"), (6, "No 0 size 1 kind a"), (7, None), (8, "No 2 kind b size 0, size 1")]
    q, r = spark.createDataFrame(asked, "qid long, text string"), spark.createDataFrame(rows, "block long, fields map<string,string>")
    picked, summary = L.row_lookup(q, r, spark.createDataFrame([], "qid long, block long, rank int"))
    want = {x.qid: [x.bindings, x.lookup_miss, 0, 0] for x in summary.collect()}
    for x in picked.collect():
        want[x.qid][2 if x.state == "matched" else 3] += 1
    assert {x.qid: [x.bindings, x.lookup_miss, x.matched, x.excluded] for x in L.lookup_counts(q, r).collect()} == want
    assert sum(w[2] > 0 for w in want.values()) > 3


def test_candidates_leave_their_block_only_if_they_may_score(spark, monkeypatch):
    """Records without places all meet; only pairs whose upper bound reaches the score are handed on, whatever the blocks."""
    rng = random.Random(8)
    rows = [(i, datetime(2024, 1, 1 + i % 2, i % 24), f"q{i % 4}", [f"e{i % 9}", f"q{i % 4}"], [rng.gauss(0, 1) for _ in range(8 if i % 11 else 6)] if i % 13 else [float("nan")] * 8) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, request string, entities array<string>, v array<double>")
    none = "cast(null as string) region, false broad, cast(array() as array<string>) details, array('u') units, cast(array() as array<array<string>>) segments, entities toks, false pii"
    records = df.selectExpr("id", "ts", "request", "entities", "v", *none.split(", "))
    own, (least, hours) = {r.id: r for r in records.collect()}, (0.7, 12)
    want, parts = {}, U.scored("x", "y")
    every = records.select(F.struct("*").alias("x")).crossJoin(records.select(F.struct("*").alias("y"))).where("x.id < y.id and abs(unix_timestamp(x.ts) - unix_timestamp(y.ts)) <= 43200")
    exact = every.select("x", "y", *[F.coalesce(parts[k], F.lit(0.0)).alias(k) for k in U.WEIGHTS])
    want = {(r.a, r.b): round(r.s, 4) for r in exact.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(sum(w * F.col(k) for k, w in U.WEIGHTS.items()), 4).alias("s")).where(f"s >= {least}").collect()}
    seen, met = [], U._met
    monkeypatch.setattr(U, "BLOCK", 7)
    monkeypatch.setattr(U, "_met", lambda *a: seen.append(met(*a)) or seen[0])
    got = {(r.a, r.b): r.score for r in U.candidates(records, hours, least).collect()}
    assert got == want and len(own) == 240 and len(want) > 20
    assert seen[0].count() < every.count() / 4


def test_blocks_of_records_are_split_by_requests_and_entities(monkeypatch):
    """The parts of two blocks hold all pairs that may score, in fewer products; records without a request are like no other."""
    rng = random.Random(12)
    n = 300
    asked = [rng.choice(["q1", "q2", "q3", "q4", None]) for _ in range(n)]
    named = [[f"k{rng.randrange(20)}", *([q] if q else [])] if rng.random() < 0.9 else [] for q in asked]
    bits = lambda rows: pa.array([[hash(x) % U.BITS for x in r] for r in rows], pa.list_(pa.int64()))
    cols = {"key": pa.array(["n"] * n), "id": pa.array(range(n)), "_t": pa.array([rng.randrange(9000) for _ in range(n)]), "_b": pa.array([0] * n), "request": pa.array(asked, pa.string()), "entities": pa.array(named, pa.list_(pa.string())),
            "_q": bits([[q] if q else [] for q in asked]), "_e": bits(named), "_u": bits([[f"u{i % 3}"] if i % 4 else [] for i in range(n)]), "v": pa.array([[rng.gauss(0.5, 1) for _ in range(6 if i % 9 else 5)] if i % 11 else None for i in range(n)], pa.list_(pa.float64()))}
    block = pa.RecordBatch.from_pydict(cols)
    pairs = lambda: sorted((int(i), int(j), round(float(c), 9)) for x, y, cos in U._pairs(block, block, 5000, 0.6) for i, j, c in zip(x, y, cos))
    whole = pairs()
    monkeypatch.setattr(U, "SPLIT", 1)
    need = 0.6 - U.SLACK - 0.2 * 0.25 - 0.1
    jac = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
    sure = {(i, j) for i, j, c in whole if 0.3 * c + 0.15 * jac(named[i], named[j]) + 0.15 * (asked[i] is not None and asked[i] == asked[j]) + 0.1 >= need}
    split = pairs()
    assert sum(len(i) * len(j) for i, j, _ in U._split(block, block, need)) < n * n / 2
    assert len(sure) > 500 and sure <= {(i, j) for i, j, _ in split} <= {(i, j) for i, j, _ in whole}
    assert U._split(block, block, 0.3)[0][0].size == n


def test_walks_move_blocks_not_edges(spark, monkeypatch):
    """Nodes in several blocks, cells in several parts, queries in several groups, against a dense solve."""
    monkeypatch.setattr(G, "NODES", 8)
    monkeypatch.setattr(G, "EDGES", 5)
    monkeypatch.setattr(G, "ASKED", 2)
    rng = random.Random(4)
    edges = [(rng.randrange(25) * 3, rng.randrange(30) * 3, rng.choice((0.5, 1.0, 2.0))) for _ in range(90)]
    seeds = [(f"q{q}", rng.randrange(30) * 3, 0.1 + rng.random()) for q in range(5) for _ in range(3)]
    m = np.zeros((90, 90))
    for h, t, w in edges:
        m[h, t] += w
    flows, flow = [], G._flow
    monkeypatch.setattr(G, "_flow", lambda *a: flows.append(flow(*a)) or flows[-1])
    got = {(r.qid, r.node): r.p for r in G.pagerank_many(spark.createDataFrame(edges, "head long, tail long, weight double"), spark.createDataFrame(seeds, "qid string, node long, p double"), damping=0.5).collect()}
    for q in {q for q, _, _ in seeds}:
        p = np.zeros(90)
        for n, x in [(n, x) for a, n, x in seeds if a == q]:
            p[n] += x
        p /= p.sum()
        out = m.sum(1)
        walk = np.linalg.solve(np.eye(90) - 0.5 * np.where(out[:, None] > 0, m / np.maximum(out, 1e-300)[:, None], p).T, 0.5 * p)
        assert all(abs(got.get((q, n), 0) - walk[n]) < 1e-6 for n in range(90))
    assert "binary" in dict(flows[0].dtypes).values()
