"""What counts by an operator's own rule is found, whatever its place or form."""

import os
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases

from skarn.llm import decontam, jaccard, langid, order, packing, quality, secret_scan, substring, toxicity


def counting(size):
    """Agreement patterns of up to 20 words that count for an item of so many words."""
    need = min(decontam.LEAST_WORDS, int(np.ceil(decontam.AGREE * size - 1e-9)))
    for n in range(need, min(size, 20) + 1):
        for k in range(n - int(np.ceil(decontam.AGREE * n - 1e-9)) + 1):
            for out in combinations(range(1, n - 1), k):
                yield "".join("0" if i in out else "1" for i in range(n))


def hit(pattern):
    return any(all(pattern[at + i] == "1" for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for at in range(len(pattern) - len(m) + 1))


def test_every_overlap_that_counts_has_a_seed():
    # Beyond 15 words, four in a row agree: m substitutions leave 4 m agreeing words or more in m + 1 runs
    for size in range(10, 21):
        assert [p for p in counting(size) if not hit(p)] == []


def test_overlaps_with_substitutions_are_found():
    rng = np.random.default_rng(5)
    fresh = iter(range(1 << 30))
    word = lambda: f"q{next(fresh)}"
    docs, items = [], []
    for size, pattern in [(s, p) for s in (10, 11, 12, 15, 20, 40) for p in list(counting(s))[:: 1 if s < 20 else 40]] + [(400, "11110" * 80)]:
        own = [word() for _ in range(size)]
        at = int(rng.integers(0, size - len(pattern) + 1))
        laid = [w if c == "1" else word() for w, c in zip(own[at:], pattern)]
        docs.append(" ".join([word() for _ in range(7)] + laid + [word() for _ in range(5)]))
        items.append(" ".join(own))
    ix = decontam.index(np.arange(len(items)), items)
    got = decontam.find(range(len(docs)), pa.array(docs), ix, decontam.LEAST_WORDS, decontam.AGREE)
    assert sorted((r[0], r[1]) for r in got) == [(i, i) for i in range(len(docs))]


def test_overlaps_match_brute_force(monkeypatch):
    rng = np.random.default_rng(6)
    make = lambda n: [f"v{i}" for i in rng.integers(0, 3, n)]
    items = [make(int(n)) for n in rng.integers(10, 24, 12)]
    docs = [make(int(n)) for n in rng.integers(0, 40, 40)] + [[]]
    want = {}
    for d, a in enumerate(docs):
        for i, b in enumerate(items):
            need = min(decontam.LEAST_WORDS, int(np.ceil(decontam.AGREE * len(b) - 1e-9)))
            for at in range(1 - len(b), len(a)):
                lo, hi = max(at, 0), min(at + len(b), len(a))
                n = decontam.overlap(np.array(a[lo:hi]), np.array(b[lo - at : hi - at]), decontam.AGREE)[1]
                if n >= need:
                    want[d, i] = max(n, want.get((d, i), 0))
    ix = decontam.index(np.arange(len(items)), [" ".join(b) for b in items])
    for most in (1 << 18, 50):
        monkeypatch.setattr(decontam, "MOST_HITS", most)
        monkeypatch.setattr(decontam, "MOST_LAID", most)
        got = decontam.find(range(len(docs)), pa.array([" ".join(a) for a in docs]), ix, decontam.LEAST_WORDS, decontam.AGREE)
        assert {(r[0], r[1]): r[3] for r in got} == want


def parts(spark, *rows):
    """A table with a partition for each list of rows, in their order."""
    out = None
    for own in rows:
        df = spark.createDataFrame(spark.sparkContext.parallelize(own, 1), "doc_id long, text string")
        out = df if out is None else out.union(df)
    return out


@pytest.mark.parametrize("ends", [[None], [""], [" \t", None, "", None]])
def test_last_word_counts_before_empty_texts(spark, ends):
    own = " ".join(f"w{i}" for i in range(49))
    texts = [own + " this", *ends, own + " that", *ends]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(parts(spark, rows[: len(ends) + 1], rows[len(ends) + 1 :])).collect()}
    assert [got[i] for i in range(len(texts))] == cases.without_repeats(texts)


def test_names_of_texts_before_empty_ones():
    h = np.arange(1, 9, dtype=np.uint64)
    other = h.copy()
    other[-1] = 99
    for first in ([0, 3, 8, 8], [0, 8, 8, 8], [0, 0, 8, 8]):
        a, b = substring.text_names(h, np.array(first)), substring.text_names(other, np.array(first))
        k = int(np.flatnonzero(np.diff(first))[-1])
        alone = substring.text_names(h[first[k] :], np.array([0, len(h) - first[k]]))
        assert all(x[k] != y[k] and x[k] == z[0] for x, y, z in zip(a, b, alone))
    assert [x.tolist() for x in substring.text_names(h[:0], np.array([0, 0]))] == [x[:1].tolist() for x in substring.text_names(h, np.array([0, 0, 8]))]


@pytest.mark.parametrize("end", [None, "", " \t"])
def test_largest_shingle_counts_before_empty_sets(spark, end):
    # Two sets of six that share the five smaller n-grams: 5 of 7, below 0.85
    for i in range(10_000):
        texts = [" ".join([f"p{i}w{j}" for j in range(8)] + [last]) for last in ("this", "that")]
        a, b = (v for _, v, _ in jaccard.sets(pa.array(texts[:1]), 4)), (v for _, v, _ in jaccard.sets(pa.array(texts[1:]), 4))
        a, b = next(a), next(b)
        if (a[:-1] == b[:-1]).all():
            break
    assert a[-1] != b[-1]
    got = {r.doc_id: r.component_id for r in jaccard.join(parts(spark, [(0, texts[0]), (1, end)], [(2, texts[1]), (3, end)]), 4, 85, 100).collect()}
    assert got == {i: i for i in range(4)}


def repeated_ids():
    """(id, text) where ids repeat with the same text and with others, one of them near or part of a text of another id."""
    import random

    rng = random.Random(8)
    make = lambda n: [f"r{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = make(120), make(120), make(102)
    near = a[:60] + ["other"] + a[61:]
    rows = [(1, a[:100]), (2, a), (2, b), (3, near), (3, b), (3, b), (3, c + a[:70]), (4, c), (4, c), (5, make(10) + b[:60] + make(9)), (5, make(120)), (None, a), (6, []), (6, a)]
    return [(d, " ".join(w)) for d, w in rows]


def test_repeated_ids_keep_their_rows(spark):
    rows = repeated_ids()
    words_ = [cases.tokens(t) for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words_):
        for k in range(len(w) - 49 if d is not None else 0):
            first[tuple(w[k : k + 50])] = min(d, first.get(tuple(w[k : k + 50]), d))
    want = []
    for (d, _), w in zip(rows, words_):
        gone = set()
        for k in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[k : k + 50])] < d:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), cases.hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.dedup(parts(spark, rows[::2], rows[1::2])).collect()
    assert cases.counted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == cases.counted(want)


def test_repeated_ids_keep_their_links(spark):
    rows = repeated_ids()
    group, sizes = cases.groups([t for _, t in rows], 4, 85, 100)
    own = [d is not None for d, _ in rows]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    # a null id links nothing; no other row hangs on it here
    want = cases.counted((d, n, least[g] if ok else None) for (d, _), g, n, ok in zip(rows, group, sizes, own))
    got = jaccard.join(parts(spark, rows[::2], rows[1::2]), 4, 85, 100).collect()
    assert cases.counted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = jaccard.stage_near_copies(spark, parts(spark, rows), SF)
    groups_, _ = cases.groups([t for _, t in rows], 5, 8, 10)
    least = {}
    for (d, _), g in zip(rows, groups_):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    assert cases.counted(map(tuple, kept.collect())) == cases.counted(r for r, g in zip(rows, groups_) if r[0] is None or not r[1] or least[g] == r[0])


SECRETS = [
    'password = "hunter2A9"', 'password = "s3cr!t@P#9"', 'passwd: Tr0ub4dor&3', "password=pa$$w0rd%12", 'api_key = "qzxkvjwpmtbrhgdlfncs"', "secret: QZXKVJWPMTBRHGDLFNCSWX", "--password hunter2A9",
]
PLAIN = ["the password required", "access controls and credentials", 'title = "Introduction"', "Note: configuration", "see https://www.example.com/docs/introduction", "Bundesverfassungsgericht and counterrevolutionary", None, ""]


def test_short_and_signed_secrets_are_found(spark):
    value = lambda t: t.split()[-1].split("=")[-1].strip('"')
    rows = [(i, t and f"some words {t} and others") for i, t in enumerate(SECRETS + PLAIN)]
    docs = parts(spark, rows)
    got = {(r.doc_id, r.start, r.length) for r in secret_scan.scan(docs).where("is_secret").collect()}
    assert got == {(i, rows[i][1].index(value(t)), len(value(t))) for i, t in enumerate(SECRETS)}
    left = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert left == {i: t if i >= len(SECRETS) else t.replace(value(SECRETS[i]), "[SECRET]") for i, t in rows}


def test_planted_keys_in_real_texts(spark):
    """Precision and recall of keys of forms that the training never names, set into the table's own texts."""
    import random

    rng = random.Random(4)
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text").orderBy("doc_id").collect()]
    clean = {(r.doc_id, r.start) for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("is_secret").collect()}
    planted, texts = set(), []
    for i, r in enumerate(rows):
        w = r.text.split(" ")
        if i % 4 == 0:
            key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(rng.choice((12, 24, 40))))
            head = " ".join(w[: len(w) // 2]) + rng.choice((' db_password = "', ' export API_TOKEN="', ' {"client_secret": "'))
            planted.add((r.doc_id, len(head)))
            texts.append((r.doc_id, head + key + '" ' + " ".join(w[len(w) // 2 :])))
        else:  # look-alikes of other forms: versions, ids and addresses
            extra = rng.choice(("build 2024.11.28-rc1 of", "see issue/123456789012 for", "mailto:anna.berg@host.example.org", "order no. 2024-000123-45", "sha256 digest " + "%064x" % rng.getrandbits(256)))
            texts.append((r.doc_id, " ".join(w[: len(w) // 2]) + " " + extra + " " + " ".join(w[len(w) // 2 :])))
    got = {(r.doc_id, r.start) for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).where("is_secret").collect()}
    shifted = {d for d, _ in clean}
    false = {x for x in got - planted if x[0] not in shifted}
    assert len(got & planted) >= 0.95 * len(planted)
    assert len(false) <= 0.05 * len(planted)


def test_candidates_of_awkward_texts_take_linear_time():
    for t in ("a=" * 300_000, "token:" * 100_000, "&token=" * 100_000, "key " * 100_000, ":" * 300_000, "= " * 100_000):
        secret_scan.candidates(t)


SF = "/root/testdata/sf0.001"
CLASHES = "uid long, rep long, family long, gram long, h1 long, y int, fold long, seed long, shard long, names string, value string, label string, held_out boolean, is_secret boolean, sequence_id long, _uid long, start long"
AWKWARD = [
    (None, None), (None, "a null id with a few words"), (0, None), (1, ""), (2, " \t\n"), (3, "the same row stands twice here with the same words in it"), (3, "the same row stands twice here with the same words in it"),
    (4, "tie tie tie tie tie tie"), (5, "tie tie tie tie tie tie"), (6, "word " * 300_000), (7, "x" * 3_000_000), (8, "é ñ ü 日本語 \x00 end"), (-9, "negative id"), (1 << 62, "large id"),
]


def awkward(spark, rows=AWKWARD):
    """Documents with nulls in every column, and columns named like those that operators use inside."""
    names = CLASHES.replace(",", "").split()[::2]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
    return spark.createDataFrame([(d, t, *[None] * (3 + len(names))) for d, t in rows], kinds).repartition(3)


def shape(df):
    return cases.counted((r.doc_id, len(r.text or ""), r.text is None) for r in df.collect())


@pytest.mark.parametrize("i", range(5))
def test_stages_on_awkward_tables(spark, i):
    import corpus_pipeline

    name, step = corpus_pipeline.STAGES[i]
    for docs in (awkward(spark), awkward(spark, [])):
        got, want = step(spark, docs, SF), shape(docs)
        if name == "packing":
            own = {(r.doc_id, r.doc_tokens) for r in got.collect()}
            assert {d for d, _ in own} == {d for d, *_ in want}
            continue
        assert got.columns == docs.columns and got.schema["text"].dataType == docs.schema["text"].dataType
        if name == "near_copies":  # equal texts of two ids: the larger id goes; a row that stands twice stays twice
            want -= cases.counted([(5, 23, False)])
        assert shape(got) == want


OPERATORS = {
    "secrets": lambda s, d: secret_scan.scan(d), "quality": lambda s, d: quality.classify(d, labels(s)), "order": lambda s, d: order.read(s, order.materialise(d, length=64), 64),
    "substrings": lambda s, d: substring.dedup(d), "language": lambda s, d: langid.identify(d), "jaccard": lambda s, d: jaccard.join(d, 4, 85, 100),
    "packing": lambda s, d: packing.pack(d), "toxicity": lambda s, d: toxicity.classify(d, labels(s)), "decontamination": lambda s, d: decontam.overlaps(d, s.read.parquet(f"{SF}/benchmark.parquet")),
}


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] * 3 + [(None, 1, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_on_awkward_tables(spark, name):
    docs = awkward(spark)
    got = OPERATORS[name](spark, docs).collect()
    if name in ("quality", "substrings", "language", "jaccard", "toxicity"):  # one row for each row
        assert cases.counted(r.doc_id for r in got) == cases.counted(d for d, _ in AWKWARD)
    elif name == "packing":
        assert {r.doc_id for r in got} == {d for d, _ in AWKWARD}
    elif name in ("secrets", "decontamination"):
        assert not [r for r in got if name == "decontamination" or r.is_secret]
    assert OPERATORS[name](spark, awkward(spark, [])).count() == 0
