"""op13 against a search over every period."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from skarn.llm import periods, words

KEY = words.mix(np.arange(100, dtype=np.uint64) + np.uint64(77))


def every_run(w):
    """(start, length, period) of all runs, by laying the words over themselves at every distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences(n, seed=3):
    """Powers with and without changes, touching runs of one period, words over two symbols, nested powers."""
    rng = random.Random(seed)
    some = lambda k, most: [rng.randrange(k) for _ in range(rng.randrange(1, most))]
    for i in range(n):
        u = some(2, 5)
        kind = i % 7
        if kind == 0:
            yield some(2, 200)
        elif kind == 1:
            v = some(3, 40)
            yield [5] * rng.randrange(3) + v * rng.randrange(1, 9) + v[: rng.randrange(len(v) + 1)]
        elif kind == 2:
            yield fibonacci(rng.randrange(1, 400))
        elif kind == 3:
            yield [bin(k).count("1") & 1 for k in range(rng.randrange(1, 300))]
        elif kind == 4:
            yield [9] * rng.randrange(2) + (u * 99)[: rng.randrange(90)] + (u * 99)[rng.randrange(4) :][: rng.randrange(90)] + [7] * rng.randrange(2)
        elif kind == 5:
            yield sum(((u * 60)[: rng.randrange(1, 60)] for _ in range(rng.randrange(1, 6))), []) * rng.randrange(1, 4)
        else:
            v = some(4, 31) * 8
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = 9
            yield v


def test_runs_match_brute_force():
    all_ = list(sequences(700)) + [[], [1], [3] * 11, [3] * 12, [3] * 13]
    for lo in range(0, len(all_), 47):
        part = all_[lo : lo + 47]
        h = KEY[np.array([x for d in part for x in d], np.int64)]
        got = [[] for _ in part]
        for d, *run in zip(*(x.tolist() for x in periods.runs(h, np.cumsum([0] + [len(d) for d in part])))):
            got[d].append(tuple(run))
        assert got == [every_run(d) for d in part]


def expected(doc_id, text):
    """The row of one document by the contract, word by word."""
    w = cases.tokens(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = every_run(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("given", ["table", "cases"])
def test_query_matches_brute_force(spark, tmp_path, given):
    if given == "table":
        path = "/root/testdata/sf0.001"
        rows = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect() if len(cases.tokens(r.text)) < 3000}
        assert len(rows) > 150
    else:
        texts = cases.rows(n=90) + [" ".join(f"w{x}" for x in s) for s in sequences(120, 9)]
        path, rows = str(tmp_path), dict(enumerate(texts))
        cases.docs(spark, texts).write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in periods.op13_periods(spark, path).collect()}
    assert {k: got[k] for k in rows} == {k: expected(k, t) for k, t in rows.items()}
    assert any(v[0] for v in got.values())


def test_awkward_rows(spark):
    rows = [(None, None), (None, "a " * 12), (0, None), (1, ""), (2, " \t\n"), (3, "x y " * 7), (3, "x y " * 7), (3, "once"), (4, "word " * 200_000), (5, "x" * 2_000_000), (6, "é \x00 日本 " * 6)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "w", "h") for d, t in rows], "doc_id long, text string, n long, g long, start long, w string, runs string")
    got = cases.counted((r.doc_id, r.n_words, r.text, tuple(map(tuple, r.runs))) for r in periods.collapse(docs).collect())
    one = lambda d, t: (d, len(w := cases.tokens(t)), " ".join(w), ())
    assert got == cases.counted([
        one(None, None), (None, 12, "a", ((0, 12, 1),)), one(0, ""), one(1, ""), one(2, ""), (3, 14, "x y", ((0, 14, 2),)), (3, 14, "x y", ((0, 14, 2),)), one(3, "once"),
        (4, 200_000, "word", ((0, 200_000, 1),)), one(5, "x" * 2_000_000), (6, 18, "é \x00 日本", ((0, 18, 3),)),
    ])
    assert periods.planted(docs).count() == len(rows) and periods.collapse(docs.limit(0)).count() == 0

