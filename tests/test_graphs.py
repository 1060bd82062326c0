"""Walks against a dense solve, covers against a plain loop, closures, names by regular expressions, numbering, terms, near copies."""

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.operators import dedup as D
from skarn.operators import events as V
from skarn.operators import graphs as G
from skarn.operators import knowledge as K
from skarn.operators import lexicon as L
from skarn.operators import numbers as N
from skarn.operators import scoring as S
from skarn.operators import terms as T
from skarn.plans import graph_queries


def dense_walk(edges, seeds, nodes, damping=0.9):
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for h, t, w in edges:
        if w > 0:
            m[at[h], at[t]] += w
    p = np.zeros(len(nodes))
    for n, x in seeds:
        p[at[n]] += x
    p /= p.sum()
    out = m.sum(1)
    m = np.where(out[:, None] > 0, m / np.maximum(out, 1e-300)[:, None], p)
    return dict(zip(nodes, np.linalg.solve(np.eye(len(nodes)) - damping * m.T, (1 - damping) * p)))


def test_walks_of_many_queries_match_a_dense_solve(spark):
    rng = random.Random(1)
    nodes = list(range(30))
    edges = [(rng.randrange(30), rng.randrange(20), rng.choice((0.5, 1.0, 2.0))) for _ in range(70)] + [(3, 3, 1.0), (5, 25, 1.0), (5, 25, 1.0), (1, 2, 0.0)]
    seeds = {q: [(rng.randrange(30), rng.random()) for _ in range(rng.randint(1, 5))] for q in range(6)} | {6: [(29, 0.2)]}
    given = [(q, n, p) for q, s in seeds.items() for n, p in s] + [(7, 1, 0.0), (None, 1, 1.0), (8, None, 1.0)]
    own = spark.createDataFrame(edges, "head long, tail long, weight double")
    got = {}
    for r in G.pagerank_many(own, spark.createDataFrame(given, "qid long, node long, p double")).collect():
        got.setdefault(r.qid, {})[r.node] = r.p
    assert set(got) == set(seeds)
    for q, s in seeds.items():
        want = dense_walk(edges, s, nodes)
        assert all(abs(got[q].get(n, 0) - x) < 1e-6 for n, x in want.items())
    with pytest.raises(ValueError):
        G.pagerank_many(own, spark.createDataFrame(given, "qid long, node long, p double"), tolerance=1e-12, rounds=4)
    assert G.pagerank_many(own.limit(0), spark.createDataFrame([(1, 5, 2.0)], "qid long, node long, p double")).collect() == [(1, 5, 1.0)]


def test_passages_without_selected_edges_keep_their_scores(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "head long, tail long, weight double")
    selected = spark.createDataFrame([(1, 1, 2, 0.8), (1, 2, 3, 0.4)], "qid long, head long, tail long, score double")
    passages = spark.createDataFrame([(q, d, s) for q in (1, 2) for d, s in ((2, 1.0), (3, 0.5), (9, 0.0))], "qid long, docid long, score double")
    got = {(r.qid, r.docid): (r.score, r.rank) for r in G.graph_ranking(edges, selected, passages).collect()}
    assert [got[2, d] for d in (2, 3, 9)] == [(0.9, 1), (0.45, 2), (0.0, 3)]
    # Ends: 1 has .8, 2 and 3 are passages with scores of their own
    want = dense_walk([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], [(1, 0.8), (2, 0.9), (3, 0.45)], [1, 2, 3])
    assert abs(got[1, 2][0] - want[2]) < 1e-6 and got[1, 9] == (0.0, 3)


def test_what_is_asked_is_read_and_joined_once(spark, monkeypatch):
    """The joins of all lines run once, not once for each use of the few rows that come of them; a walk gives only what is wanted."""
    path, reads, joins = "/root/testdata/sf0.001", [], []
    monkeypatch.setattr(graph_queries, "read", lambda s, d, name: reads.append(name) or s.read.parquet(f"{d}/{name}.parquet"))
    edges, selected, passages = graph_queries._graph(spark, path)
    for df in (edges, selected, passages):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert "lineitem" in reads and not any("l_shipdate" in p or "l_discount" in p or "l_suppkey" in p for p in joins)


def test_a_walk_gives_what_is_wanted(spark):
    lines = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0)], "head long, tail long, weight double")
    seeds = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "qid long, node long, p double")
    some = spark.createDataFrame([(1, 4), (1, 9), (2, 4), (2, 4)], "qid long, node long")
    walk, only = (sorted(map(tuple, G.pagerank_many(lines, seeds, 0.2, 0.01, only=o).collect())) for o in (None, some))
    assert only == [r for r in walk if r[1] == 4] and len(only) == 2 and len(walk) == 8


def test_blocks_are_packed_by_what_is_in_them():
    for x in (np.zeros(64), np.eye(64)[3] * 0.5, np.arange(64.0)):
        raw = pa.array([G._packed(x)], pa.binary())[0]
        assert len(raw.as_py()) <= min(512, 12 * np.count_nonzero(x))
        assert (G._add(np.ones(64), raw, 2.0) == 1 + 2 * x).all()


def plain_cover(ranked, bundles, limit):
    chosen, deferred, given, out = [], [], [], {}
    for cid in ranked:
        spans = bundles.get(cid, [])
        owners = [[o for p, s, e, o in given if p == place and s <= start and e >= end] for place, start, end in spans]
        if spans and all(owners):
            deferred.append(cid)
            out[cid] = ["already_provided_source_context", None, sorted({o for x in owners for o in x})]
        else:
            out[cid] = ["novel_source_context", None, []]
            if len(chosen) < limit:
                chosen.append(cid)
                given += [(*s, cid) for s in spans]
    for i, cid in enumerate(chosen + deferred[: max(0, limit - len(chosen))], 1):
        out[cid][1] = i
    return out


def test_covered_passages_are_deferred(spark):
    rng = random.Random(5)
    ranked, bundles = {}, {}
    for q in range(12):
        ids = [100 * q + i for i in range(rng.randint(1, 14))]
        rng.shuffle(ids)
        ranked[q] = ids
        for d in ids:
            bundles[d] = sorted({(rng.choice("ab"), s, s + rng.randint(1, 30)) for s in (rng.randint(0, 20) for _ in range(rng.randint(0, 3)))})
    # the first row brings two blocks; the second lies in them; the third is new
    ranked[99], bundles[1], bundles[2], bundles[3] = [1, 2, 3], [("b1", 0, 9), ("b2", 0, 5)], [("b1", 2, 9)], [("b3", 0, 1)]
    r = spark.createDataFrame([(q, d, i) for q, ids in ranked.items() for i, d in enumerate(ids, 1)], "qid long, docid long, rank int")
    b = spark.createDataFrame([(d, *s) for d, spans in bundles.items() for s in spans] + [(1, "b1", 0, 9)], "docid long, place string, start int, end int")
    for limit in (1, 2, 5, 50):
        got = {(x.qid, x.docid): [x.reason, x.selected_rank, sorted(x.covered_by)] for x in G.select_passages(r, b, limit).collect()}
        assert got == {(q, d): v for q, ids in ranked.items() for d, v in plain_cover(ids, bundles, limit).items()}
    with pytest.raises(Exception, match="more than 3 rows"):
        G.select_passages(r, b, 2, depth=3).collect()
    assert G.select_passages(r.limit(0), b, 2).count() == 0


def test_closures_follow_directions_cycles_and_long_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1), (1, 2), (None, 1)], "head long, tail long")
    roots = spark.createDataFrame([(1,), (5,), (4,), (1,)], "root long")
    want = {(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (5, 5, 0), (5, 1, 1), (5, 2, 2), (5, 3, 3), (5, 4, 4), (4, 4, 0)}
    assert {tuple(r) for r in G.reachable(edges, roots).collect()} == want
    assert {tuple(r) for r in G.reachable_far(edges, roots).collect()} == {(a, b) for a, b, _ in want}
    with pytest.raises(ValueError, match="missing node: 4"):
        G.reachable(edges, roots, spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "node long"))
    chain = spark.range(10_000).select(F.col("id").alias("head"), (F.col("id") + 1).alias("tail"))
    got = G.reachable_far(chain, spark.createDataFrame([(4,)], "root long"))
    assert got.count() == 9_997 and got.agg(F.max("node")).first()[0] == 10_000


def plain_mentions(texts, aliases):
    norm = lambda t: re.sub(r"\s+", "", t or "").lower().replace("ß", "ss")
    out = set()
    for k, t in texts:
        t, found = norm(t), []
        for a in {norm(a) for a, _ in aliases} - {""}:
            p = re.escape(a)
            if a.isascii():
                p = rf"(?<![a-z0-9]){p}(?![a-z0-9])"
            found += [(m.start(), m.end(), a) for m in re.finditer(p, t)]
        out |= {(k, a, s, e) for s, e, a in found if not any(x <= s and y >= e and y - x > e - s for x, y, _ in found)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"part": 20, "block": 60}])
def test_names_in_texts_match_regular_expressions(spark, monkeypatch, sizes):
    monkeypatch.setattr(L, "LANE", 7)
    rng = random.Random(3)
    make = lambda a, n: "".join(rng.choice(a) for _ in range(rng.randint(1, n)))
    aliases = [(make("abé. ", 6), i % 9) for i in range(60)] + [("AB é", 1), ("abé", 2), ("", 3), ("Straße", 4), (None, 5), ("aa", 6), ("éé", 7), ("a" * 40, 8)]
    texts = [(i, make("abé.. -", 80)) for i in range(40)] + [(100, None), (101, ""), (102, "xx strasse STRASSE. strasse1"), (103, "éééééé"), (104, "a" * 95), (105, "-" + "a" * 40 + "-")]
    t, a = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(aliases, "alias string, target int")
    want = plain_mentions(texts, [x for x in aliases if x[0]])
    assert {tuple(r) for r in L.mentions(t, "k", "text", a, **sizes).select("k", "alias", "start", "end").collect()} == want
    norm = lambda x: re.sub(r"\s+", "", x or "").lower().replace("ß", "ss")
    targets = {}
    for alias, target in aliases:
        if norm(alias):
            targets.setdefault(norm(alias), set()).add(target)
    resolved = {}
    for k, alias, _, _ in want:
        resolved.setdefault(k, []).append(targets[alias])
    rows = {(k, x, any(len(s) > 1 for s in sets)) for k, sets in resolved.items() for x in set().union(*sets)}
    assert {tuple(r) for r in L.resolve(t, "k", "text", a, **sizes).collect()} == rows
    assert L.mentions(t.limit(0), "k", "text", a).count() == 0 and L.mentions(t, "k", "text", a.limit(0)).count() == 0


def test_many_names_in_parts():
    names = [f"n{i:06d}" for i in range(100_000)]
    doc, start, word = L.Automaton(names).scan(["xx n000007,n099999 n0000070", "n050000"])
    assert sorted((int(d), int(s), names[w]) for d, s, w in zip(doc, start, word)) == [(0, 3, "n000007"), (0, 11, "n099999"), (0, 19, "n000007"), (1, 0, "n050000")]


@pytest.mark.parametrize("parts", [1, 64])
def test_numbers_and_totals_do_not_depend_on_partitions(spark, parts):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}" if i % 2 else None, i * 7 % 50 if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, c long")
    got = {r.id: (r.row, r.total) for r in N.running(N.running(df, ["id"], ["g"], parts=parts), [F.desc("id")], (), F.col("c"), parts, "total").collect()}
    seen, want, total = Counter(), {}, 0
    for i, g, _ in rows:
        seen[g] += 1
        want[i] = [seen[g]]
    for i, _, c in reversed(rows):
        total += c or 0
        want[i].append(total)
    assert got == {k: tuple(v) for k, v in want.items()}
    batch = {r.id: r.batch for r in N.batches(df, ["id"], ["g"], "c", 100, parts).collect()}
    sums = Counter()
    for i, g, c in rows:
        assert batch[i] == sums[g] // 100
        sums[g] += c or 0
    assert N.running(df.limit(0), ["id"], parts=parts).count() == 0


def test_quantiles_at_ranks(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 1, 1, 9)] + [("b", None), ("b", 2.0), (None, 3.0)], "g string, v double")
    got = {r.g: (r.n, r.lo, r.hi) for r in N.at_ranks(df, ["g"], "v", {"lo": F.lit(1), "hi": F.col("n")}).collect()}
    assert got == {"a": (5, 1.0, 9.0), "b": (1, 2.0, 2.0), None: (1, 3.0, 3.0)}


def test_character_terms(spark):
    texts = [(0, "Abc a\tab"), (1, None), (2, ""), (3, "abc abc"), (4, "zz"), (5, "zz")]
    df = spark.createDataFrame(texts, "id long, text string")
    assert Counter(T.word_grams("a ab")) == Counter([" a", "a ", " a ", " a", "ab", "b ", " ab", "ab ", " ab "])
    terms = T.fit_terms(df, "id", "text", 5)
    counts = {i: Counter(T.word_grams(t or "")) for i, t in texts}
    total = sum(counts.values(), Counter())
    top = sorted(sorted(total, key=lambda g: (-total[g], g))[:5])
    assert list(terms) == top and [terms[g][0] for g in top] == list(range(5))
    got = {r.id: dict(zip(r.at, r.w)) for r in T.sparse_rows(df, "id", "text", terms).collect()}
    for i, c in counts.items():
        x = {terms[g][0]: n * (math.log(7 / (1 + sum(g in d for d in counts.values()))) + 1) for g, n in c.items() if g in terms}
        norm = math.sqrt(sum(v * v for v in x.values()))
        assert got[i].keys() == x.keys() and all(abs(got[i][k] - v / norm) < 1e-12 for k, v in x.items())
    rows = T.sparse_rows(df, "id", "text", terms)
    pair = rows.alias("a").join(rows.alias("b"), F.expr("a.id = 0 and b.id in (1, 3)")).select(F.col("b.id"), T.sparse_dot(F.col("a.at"), F.col("a.w"), F.col("b.at"), F.col("b.w")).alias("c"))
    assert {r.id: round(r.c, 9) for r in pair.collect()} == {1: 0.0, 3: round(sum(got[0][k] * got[3].get(k, 0) for k in got[0]), 9)}
    dense = T.joined_features(rows, df.select("id", F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("double").alias("z")), "id", ["x", "y", "z"], 5)
    assert {r.id: (r.at[-1], r.w[-1]) for r in dense.collect()} == {i: (5, 2.0) for i, _ in texts}


def loop(rows, threshold):
    """The kept ids, one text after the other."""
    form = lambda t: re.sub(r"[^a-z0-9가-힣\s]+", "", " ".join((t or "").strip().lower().split()))
    kept, seen = [], set()
    for i, t in rows:
        f = form(t)
        if f in seen or f and any(k and SequenceMatcher(None, f, k).ratio() >= threshold for k in (form(x) for _, x in kept)):
            continue
        seen.add(f)
        kept.append((i, t))
    return {i for i, _ in kept}


@pytest.mark.parametrize("threshold", [0.96, 0.93])
def test_near_copies_as_one_text_after_the_other(spark, threshold):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.choice((1, 2, 3, 6, 12, 40, 90)))) for _ in range(70)]
    while len(texts) < 290:  # chains: each a few edits from some text before
        t = list(rng.choice(texts[-60:]))
        for _ in range(rng.randint(1, max(1, len(t) // 40))):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.choice((0, 1, 1))] = rng.choice(("", "x", "q", " "))
        texts.append("".join(t))
    texts += [None, "", "!!", "ab", "AB", "a" * 60, "a" * 61, "ab" * 40, "ab" * 40 + "a"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = sorted(zip(order, texts))
    got = D.keep_first(spark.createDataFrame(rows, "id long, text string"), threshold).collect()
    kept = {r.id for r in got if r.kept}
    assert len(got) == len(rows) and kept == loop(rows, threshold)
    assert all(r.kept_by in kept and r.kept_by < r.id for r in got if not r.kept)
    assert D.keep_first(spark.createDataFrame([(None, "x"), (1, "b"), (1, "a"), (2, "a")], "id long, text string")).collect() is not None
    assert D.keep_first(spark.createDataFrame([], "id long, text string")).count() == 0


def test_near_copies_take_few_steps(spark, monkeypatch):
    """Texts that share words by chance wait for none of each other; groups of copies fall to what was kept before."""
    monkeypatch.setattr(D, "FIRST", 20)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(150)]
    for k in range(90):
        t = list(texts[k % 3])
        t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.insert(rng.randrange(3, len(texts)), "".join(t))
    steps, saved = [], D.saved
    monkeypatch.setattr(D, "saved", lambda df: steps.append(1) or saved(df))
    got = D.keep_first(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    kept = {r.id for r in got if r.kept}
    assert kept == loop(list(enumerate(texts)), 0.96) and 140 < len(kept) < 180
    assert len(steps) < 30


def test_student_p_values():
    for t, df, p in ((12.7062, 1, 0.05), (4.302653, 2, 0.05), (2.228139, 10, 0.05), (-2.262157, 9, 0.05), (1.959988, 100_000, 0.05), (0.0, 5, 1.0), (50.0, 500, 0.0)):
        assert abs(S.student_p(t, df) - p) < 1e-5


def test_pending_results_alone_give_up_their_weight(spark):
    rows = [(0.8, 0.6, 0.4, 0.9, "done", 2), (0.8, 0.6, 0.4, 0.9, "pending", 9), (0.8, None, None, None, "done", 0), (None, None, None, None, "pending", 0)]
    df = spark.createDataFrame(rows, "o double, r double, c double, x double, status string, n int")
    parts = [(F.col("o"), 0.3, None), (F.col("r"), 0.3, None), (F.col("c"), 0.25, None), (F.col("x"), 0.15, F.col("status") == "pending")]
    got = [r.s for r in df.select(K.confidence(parts, F.col("n") * 0.01, 0.05).alias("s")).collect()]
    assert got == [0.675, round((0.24 + 0.18 + 0.1) / 0.85 + 0.05, 4), 0.24, 0.0]


def test_scattered_keywords(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [("noise", at(h), r) for h, r in ((0, "a"), (2, "b"), (5, " c "), (9, "c"), (20, "d"))]
    rows += [("few", at(h), r) for h, r in ((0, "a"), (2, "b"), (20, "c"))] + [("near", at(h), r) for h, r in ((8, "a"), (9, "b"), (10, "c"), (11, "d"), (12, "e"))]
    rows += [("one", at(h), r) for h, r in ((0, "a"), (2, "a"), (5, "a"), (9, "b"), (20, "c"))] + [("blank", at(h), r) for h, r in ((0, "a"), (2, None), (5, " "), (9, "b"), (20, "c"))]
    rows += [("now", at(20), r) for r in "abcde"] + [("now", at(0), "f")]
    got = V.dispersed_noise(spark.createDataFrame(rows, "k string, t string, r string").select("k", F.to_timestamp("t").alias("ts"), "r"), "k", "r")
    assert {r.k: (r.regions, r.recent, r.share) for r in got.where("k <> 'one'").collect()} == {"blank": (3, 1, 0.2)}
    assert {r.k for r in V.dispersed_noise(spark.createDataFrame(rows, "k string, t string, r string").select("k", F.to_timestamp("t").alias("ts"), "r"), "k", "r", most_share=0.5).collect()} == {"noise", "blank"}


def test_events_near_a_cluster_before(spark):
    rng = np.random.default_rng(4)
    ev = [(i, f"2024-01-{1 + i % 9:02d} 10:00:00", ["ab1", "ab2", "c", None, "unknown"][i % 5], rng.normal(size=3).tolist() if i else [0.0, 0.0, 0.0]) for i in range(60)]
    cl = [(k, r, rng.normal(size=3).tolist()) for k, r in enumerate(["ab9", "c", None, "zz"])]
    e = spark.createDataFrame(ev, "id long, t string, region string, v array<double>").withColumn("ts", F.to_timestamp("t"))
    c = spark.createDataFrame(cl, "cluster long, region string, v array<double>").select("*", F.to_timestamp(F.lit("2024-01-09 10:00:00")).alias("as_of"), F.to_timestamp(F.lit("2024-01-08 10:00:00")).alias("since"))
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if any(a) else 0.0
    unknown = lambda r: r in (None, "unknown")
    want = {}
    for k, r, v in cl:
        want[k] = sum(2 <= int(t[8:10]) < 8 and (unknown(r) or unknown(x) or x[:2] == r[:2]) and cos(y, v) >= 0.3 for _, t, x, y in ev)
    for sizes in ({}, {"block": 7, "cluster_block": 2}):
        assert {r.cluster: r.older for r in V.similar_before(e, c, 0.3, **sizes).collect()} == want
