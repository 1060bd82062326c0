"""Operators on documents against plain counterparts, with awkward rows and empty tables."""

import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import cases

from skarn.llm import decontam, jaccard, langid, neighbours, order, packing, quality, secret_scan, substring, tokens, toxicity, trees, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return cases.rows()


def test_words_in_small_pieces():
    texts = ["a b", "", None, "  ", "q" * 300 + " " + "zz " * 200, "é ñ\x1cx\ty", "end"]
    for most in (8, 64, 1 << 20):
        got = [[bytes(b.buf[s:e]).decode() for s, e in zip(b.starts[b.first[i] : b.first[i + 1]], b.ends[b.first[i] : b.first[i + 1]])] for b in words.blocks(pa.array(texts, pa.string()), most=most) for i in range(len(b.first) - 1)]
        assert got == [cases.tokens(t) for t in texts]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 8, 10)])
def test_jaccard_matches_all_pairs(spark, texts, k, num, den):
    want, sizes = cases.groups(texts, k, num, den)
    got = {r.doc_id: r for r in jaccard.join(cases.docs(spark, texts), k, num, den).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_jaccard_in_large_groups_and_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(90):  # one family far over the size that is paired, in several blocks
        w = list(base)
        w[i % 40], w[(i * 7) % 40] = f"x{i}", f"y{i}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "BLOCK", 1000)
    want, _ = cases.groups(texts, 4, 60, 100)
    got = {r.doc_id: r.component_id for r in jaccard.join(cases.docs(spark, texts), 4, 60, 100).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_jaccard_empty_null_id_and_repeated_rows(spark):
    assert jaccard.join(cases.empty(spark), 4, 85, 100).count() == 0
    own = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.join(own, 4, 85, 100).collect()), key=str) == [(1, 1), (3, 1), (3, 1), (None, None)]


def test_stage_keeps_one_of_each_group(spark, texts):
    left = {r.doc_id for r in jaccard.stage_near_copies(spark, cases.docs(spark, texts), SF).collect()}
    assert left == {i for i, c in enumerate(cases.groups(texts, 5, 8, 10)[0]) if i == c}


def test_substrings_match_brute_force(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(cases.docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == cases.without_repeats(texts)


def test_substrings_empty_and_null_id(spark):
    assert substring.dedup(cases.empty(spark)).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    own = spark.createDataFrame([(None, long), (2, long), (5, long + " tail")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup(own).collect()} == {None: 0, 2: 0, 5: 80}


def test_ids_equal_the_library(texts):
    own = tokens.WordIds(tokens.word_ids().__class__ and __import__("public_tokenizers").path(tokens.VOCABULARY))
    odd = ["don't we'll I'VE", "a\x1cb", "İstanbul ΣΑΣ", "<|endoftext|> x", "é", "12,345.67 $$%% --a", "日本語 テスト", "x.\x01y", "'s 's,", "Café, no."]
    for t in [*texts, *odd]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == own.slow.encode(t or "", add_special_tokens=False).ids


def test_packing_round_trip(spark, texts):
    encode = tokens.word_ids().ids
    got = packing.pack(cases.docs(spark, texts)).collect()
    for i, t in enumerate(texts):
        ids = encode(t) + (2).to_bytes(4, "little")
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert own[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(own, own[1:]))
        assert own[-1].start + own[-1].length == len(ids) // 4 == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    for s in {r.sequence_id for r in got}:
        own = sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:]))
        assert own[-1].offset + own[-1].length <= 4096
    assert packing.pack(cases.empty(spark)).count() == 0


def test_cuts_are_whole_and_harmonic():
    for n in range(1, 4096):
        parts = packing.cuts(n, 4096, 32)
        assert sum(parts) == n and (min(parts) >= 32 or len(parts) == 1)
        assert all(p == 4096 // (4096 // p) for p in parts if p >= 64)


def test_packing_fills_sequences(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(2))
    used, most = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert used / (4096 * most) > 0.98


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 5, 17, 1000):
        f = order.Feistel(n, key=5)
        slots = f.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (f.index(slots) == np.arange(n)).all()
    assert (order.Feistel(1000, 1).slot(np.arange(1000)) != order.Feistel(1000, 2).slot(np.arange(1000))).any()


def shards_hold_the_sequences_in_feistel_order(spark, table, rows, length, per_shard):
    """Slot s holds sequence index(s) of some order of the splits; sequences of a split run over its documents in order."""
    path = order.materialise(table, length=length, per_shard=per_shard)
    got = sorted(order.read(spark, path, length, per_shard).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    assert all(r.byte_offset == (r.slot % per_shard) * order.stride(length) and r.shard == r.slot // per_shard for r in got)
    encode = tokens.word_ids().ids
    by_index = sorted(zip(order.Feistel(len(got)).index(np.arange(len(got))).tolist(), got))
    assert [i for i, _ in by_index] == list(range(len(got)))
    # In index order the documents stand one after another, whole, each split's last sequence padded
    flat, firsts, at = [], {}, 0
    for _, r in by_index:
        firsts[at] = r.doc_id
        flat += np.frombuffer(r.ids, "<u2").tolist()
        at += r.n_ids
    docs, start, seen = {}, 0, []
    for i, x in enumerate(flat):
        if x == 2:
            docs.setdefault(tuple(flat[start : i + 1]), []).append(start)
            seen.append((start, tuple(flat[start : i + 1])))
            start = i + 1
    assert start == len(flat)
    want = [(d, (*np.frombuffer(encode(t), "<u4").tolist(), 2)) for d, t in rows]
    assert cases.counted(x for _, x in seen) == cases.counted(x for _, x in want)
    spans = sorted(seen)
    owner = {}
    for begin, x in spans:
        if begin in firsts:
            owner.setdefault((firsts[begin], x), 0)
    assert set(owner) <= set(want)
    return path, got


def test_shards_round_trip_and_resume(spark, texts, tmp_path):
    source = str(tmp_path / "docs")
    cases.docs(spark, texts).write.parquet(source)
    path, got = shards_hold_the_sequences_in_feistel_order(spark, spark.read.parquet(source), list(enumerate(texts)), 64, 16)
    assert sorted(r.slot for r in order.read(spark, path, 64, 16, start=21).collect()) == list(range(21, len(got)))


def test_shards_of_tables_not_from_files(spark, texts):
    shards_hold_the_sequences_in_feistel_order(spark, cases.docs(spark, texts, 4), list(enumerate(texts)), 64, 16)
    rows = [(None, "a b"), (7, "a b"), (7, "a b"), (8, None), (9, "")]
    path, got = shards_hold_the_sequences_in_feistel_order(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows, 4, 3)
    assert {r.doc_id for r in got} <= {None, 7, 8, 9}


def test_shards_of_a_table_read_twice(spark, texts, tmp_path):
    source = str(tmp_path / "docs")
    cases.docs(spark, texts).write.parquet(source)
    table = spark.read.parquet(source)
    shards_hold_the_sequences_in_feistel_order(spark, table.union(table), list(enumerate(texts)) * 2, 64, 16)


def test_shards_of_an_empty_table(spark, tmp_path):
    source = str(tmp_path / "none")
    cases.empty(spark).write.parquet(source)
    assert order.read(spark, order.materialise(spark.read.parquet(source))).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    rng = np.random.default_rng(1)
    item = [f"term{i}" for i in rng.integers(0, 10_000, 40)]
    noise = lambda n: [f"other{i}" for i in rng.integers(0, 10_000, n)]
    edited = list(item)
    for i in (4, 13, 22, 31):
        edited[i] = "changed"
    own = [" ".join(noise(30) + item + noise(9)), " ".join(noise(50)), " ".join(noise(20) + edited), "; ".join(w.upper() for w in item), " ".join(item[:8] + noise(30)), None, ""]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    table = cases.docs(spark, own)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(table, bench).collect()} == {(0, 1), (2, 1), (3, 1)}
    left = decontam.clean(table, bench)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {1, 4, 5, 6}
    assert decontam.overlaps(cases.empty(spark), bench).count() == 0
    assert decontam.overlaps(table, bench.limit(0)).count() == 0
    joined = decontam.overlaps(table, bench, block=1)  # a benchmark too large for a broadcast gives the same
    assert cases.counted(joined.collect()) == cases.counted(decontam.overlaps(table, bench).collect())
    left = decontam.clean(table, bench, block=1)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {1, 4, 5, 6}


@pytest.mark.parametrize("block", [decontam.BLOCK, 1])
def test_decontamination_of_short_items_and_awkward_rows(spark, block):
    own = ["we say alpha beta gamma delta epsilon here", "yes no", "they said yes no twice", None, "", "one two three four five six seven eight nine " * 400, "one two three four five six seven eight nine"]
    docs = cases.docs(spark, own).withColumn("_uid", F.lit(1)).withColumn("item_id", F.lit(2))
    docs = docs.unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(1, "Alpha, beta gamma; delta EPSILON"), (None, "yes no"), (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "alpha beta gamma delta zeta"), (1, "Alpha, beta gamma; delta EPSILON")], "item_id long, text string")
    got = cases.counted((r.doc_id, r.item_id, r.agree) for r in decontam.overlaps(docs, bench, block=block).collect())
    assert got == {(0, 1, 5): 2, (None, 1, 5): 2, (1, None, 2): 1, (5, 3, 9): 1, (6, 3, 9): 1}
    left = decontam.clean(docs, bench, block=block)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, 4}
    assert decontam.clean(docs.limit(0), bench, block=block).count() == 0 and decontam.clean(docs, bench.limit(0), block=block).count() == docs.count()


def test_long_overlaps_take_linear_time():
    a = np.arange(300_000) % 7
    b = np.where(np.arange(300_000) % 4 == 0, 99, a)
    assert decontam.overlap(a, b, 0.8)[1] < 100 and decontam.overlap(a, a, 0.8) == (0, 300_000, 300_000)


def test_decontamination_finds_every_planted_item(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()}
    assert want and want <= got and len(got) <= 1.2 * len(want)


def test_secrets(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    own = [f'words token = "{key}" more', "call 4539 1488 0343 6467 now", "write a.77@mail3.example.com today", "number 4485275742308327 here", None, "", "ErsteZweiteDritteVierte"]
    table = cases.docs(spark, own)
    got = secret_scan.scan(table)
    assert [(r.doc_id, r.start, r.length) for r in got.where("is_secret").collect()] == [(0, 15, 40)]
    clean = {r.doc_id: r for r in secret_scan.redact(table).collect()}
    assert clean[0].text == 'words token = "[SECRET]" more' and clean[0].n_chars == len(clean[0].text) and len(clean) == len(own)
    assert clean[4].text is None and clean[3].text == own[3]
    assert secret_scan.scan(cases.empty(spark)).count() == 0


def test_forest_holds_out():
    found = secret_scan.labelled_findings(seed=11)
    model = secret_scan.train(secret_scan.labelled_findings(seed=3))
    x = np.array([secret_scan.describe(t, s, k) for t, s, k, _ in found])
    assert ((model.score(x) >= 0.5) == np.array([f[3] for f in found])).mean() > 0.95


def test_isotonic_rises_and_boosting_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = trees.boost(x[:400], y[:400])
    assert ((model.margin(x[400:]) > 0) == y[400:]).mean() > 0.85
    curve = trees.isotonic(model.margin(x[400:]), y[400:])
    assert (np.diff(curve(np.linspace(-5, 5, 50))) >= 0).all()


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.95)])
def test_classifiers_hold_out(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels).cache()
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    both = got.join(labels, "doc_id").where("held_out")
    assert both.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.when(F.col(label) == 1, F.col("score")).otherwise(1 - F.col("score"))))
    assert both.agg(F.avg(-F.log(p))).first()[0] < 0.2


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_awkward_tables(spark, module, texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        got = module.classify(cases.docs(spark, texts), labels).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(texts))) and all(0 <= r.score <= 1 for r in got)
    assert module.classify(cases.empty(spark), few).count() == 0


def test_language(spark, texts):
    rng = np.random.default_rng(0)
    make = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(30))
    data = [(i, make(["the", "ing", "ou"]) if i % 2 else make(["sch", "ü", "ein"]), "en" if i % 2 else "de", "s", 0) for i in range(120)]
    data += [(200, None, "en", "s", 0), (201, "12 !?", "en", "s", 0), (202, "the ing", None, "s", 0), (203, "schein" * 5000, "de", "s", 0)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    held = [d for d in data if d[0] < 120 and got[d[0]].held_out]
    assert held and np.mean([got[d[0]].lang_pred == d[2] for d in held]) > 0.95
    assert all(got[d[0]].held_out == (zlib.crc32(str(d[0]).encode()) % 5 == 0) for d in data)
    assert (got[200].lang_pred, got[201].lang_pred, got[203].lang_pred) == ("und", "und", "de") and got[200].score == 0
    none = langid.identify(cases.docs(spark, texts).withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"] and langid.identify(cases.empty(spark)).count() == 0


def test_language_of_the_tables_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97


def test_language_sees_beyond_words_and_windows(spark):
    net = langid.Network.fresh(["a", "b"], 6, seed=2)
    one = words.buffer(pa.array(["ab cd ef gh" * 100, "gh ef cd ab" * 100]))
    total = langid.pooled(net, *one)
    assert abs(total[0] - total[1]).max() > 1e-3  # the order of words counts
    whole, mask = langid.padded([one[0][: int(one[1][1])].tobytes()])
    lp = net.log_probs(np.ascontiguousarray(whole.T.astype(np.intp)), np.ascontiguousarray(mask.T)).sum((0, 2))
    assert np.abs(lp - total[0]).max() < 0.01 * np.abs(lp).max()  # windows with their overlap label as one long pass does


def test_more_languages_than_documents_of_each(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    data = [(i, " ".join([alphabet[i % 13] + alphabet[13 + i % 13]] * 40), f"l{i % 13}") for i in range(13 * 30)] + [(2, "xx yy", "other"), (2, "zz", "l1")]
    got = langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(data) and np.mean([r.lang_pred == f"l{r.doc_id % 13}" for r in got if r.held_out]) > 0.9


def test_gradients_by_finite_differences():
    net = langid.Network.fresh(["a", "b", "c"], 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = langid.padded([b"abc", b"de", b"fghij"])
    y, weight = np.array([0, 1, 2]), np.ones(3)
    _, g = net.gradients(x, mask, y, weight)
    for k in net.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.w[k][at] += 1e-3
        up = net.gradients(x, mask, y, weight)[0]
        net.w[k][at] -= 2e-3
        down = net.gradients(x, mask, y, weight)[0]
        net.w[k][at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=1e-3, abs=1e-5)


def test_neighbours_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "AT_ONCE", 7)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("*", "null as part", "1 as q_part", "'x' as dims", "true as asks", "2 as v", "0 as rank")
    got = neighbours.search(vectors, vectors.where("vec_id % 100 = 0"), block=700).collect()
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(r.score == d[ids == r.vec_id][0] for r in own)
        hit, total = hit + len(best & {r.vec_id for r in own}), total + 10
    assert hit / total >= 0.9


def test_neighbours_awkward(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [0.9, 0.1]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = neighbours.search(v, v.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 7, 6] and got[0].score == 0.0
    assert neighbours.search(v.limit(0), v).count() == 0 and neighbours.search(v, v.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = step(spark, docs, SF)
        assert docs.count() <= before or name == "packing"
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "packing"]
