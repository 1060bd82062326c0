"""op11 against all pairs, and the tables' query against DuckDB."""

import os
import random
import sys
import zlib

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from skarn.llm import reputation, variants


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(close), form and counts[form])
    root = {}
    for w in out:
        r = w
        while out[r][0]:
            r = out[r][0]
        root[w] = r
    return {w: (f, root[w], n, k, m) for w, (f, n, k, m) in out.items()}


def words(seed, n, letters, lo, hi):
    rng = random.Random(seed)
    found = {}
    while len(found) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
        for _ in range(rng.randrange(6)):
            found.setdefault(w, rng.choice((2, 3, 20, 35, 400, 5000)))
            i = rng.randrange(len(w) + 1)
            w = rng.choice((w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]))
            if len(w) < lo:
                break
    return found


@pytest.mark.parametrize("case", ["two letters", "many letters", "one group", "beyond the plane"])
@pytest.mark.parametrize("tile", [3, 512])
def test_variants_match_all_pairs(spark, monkeypatch, case, tile):
    if case == "one group":  # all share their first and their last segment, so the group is dealt into tiles
        counts = {"abc" + a + b + "xyzuv": 2 if a != "a" else 70 for a in "abcdefghijklm" for b in "abcdefghijklmno"}
    else:
        counts = words(*{"two letters": (1, 300, "ab", 7, 10), "many letters": (2, 400, "abcdéÿß", 7, 16), "beyond the plane": (3, 150, "a\U0001f600é", 7, 9)}[case])
    if tile == 3:
        monkeypatch.setattr(variants, "PAIRS", 50)
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group(vocab, tile=tile).collect()}
    assert got == expected(counts)


def test_chains_have_one_root(spark):
    counts = {"aaaaaaa" + "b" * i: 2 * 10**i for i in range(9)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r.root for r in variants.group(vocab).collect()} == {"aaaaaaa" + "b" * 8}


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Packed words look small to Spark, at its own threshold too."""
    counts = words(4, 300, "abcd", 7, 9)
    plans, stage = [], variants.common.stage
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(variants.common, "stage", lambda df, label: stage(plan(df), label))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    got = plan(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == expected(counts)
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not [p for p in plans if "Broadcast" in p]


def plain(rows):
    """Counts of the query's words: runs by hand, one code point out of each 31st."""
    letter = lambda c: "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"
    found = cases.collections.Counter()
    for d, text in rows:
        for run in "".join(c if letter(c) else " " for c in text or "").split(" "):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            if run and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def test_whole_texts(spark, tmp_path):
    long = "y" * 300_000
    rows = [(None, None), (None, "Überraschung überraschung"), (1, ""), (2, "×÷×÷×÷× ABCDEFGH-abcdefgh_abcdefgi"), (2, "ABCDEFGH abcdefgi"), (3, long + " " + long), (4, "shorts only here"), (5, "ÀBCDEFGÿ\x00ÀBCDEFGÿ àbcdefgÿ")]
    rows += [(i, "spellings spellings variants") for i in range(10, 80)]
    spark.createDataFrame([(d, t, 1, "w", "f") for d, t in rows], "doc_id long, text string, n long, word string, form string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.op11_variants(spark, str(tmp_path)).collect()}
    counts = plain(rows)
    assert got.keys() == counts.keys()
    short = {w: n for w, n in counts.items() if len(w) < 1000}
    assert {w: got[w] for w in short} == expected(short)
    assert any(r[0] for r in got.values())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(variants.vocabulary(variants.misspelt(variants.runs(none)))).count() == 0


@pytest.mark.parametrize("name", ["op11_variants", "op12_urls"])
def test_queries_match_sql(spark, name):
    path = "/root/testdata/sf0.001"
    module = {"op11_variants": variants, "op12_urls": reputation}[name]
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    df = module.QUERIES[name](spark, path)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({module.ORACLE_SQL[name]})").fetchall()
    assert cases.counted(map(tuple, df.collect())) == cases.counted(want)
