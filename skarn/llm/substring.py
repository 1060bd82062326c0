"""Substring dedup by recompression.

1. Words get names (hashes). In each round, runs of one symbol and then pairs of neighbours are named
   afresh; whether two neighbours pair up depends on their names alone, so equal substrings get equal
   interior symbols in every document. A symbol knows how far its naming has looked to either side.
2. Spark groups the symbols of the last round by name: a name that only one text has marks every
   window that holds all its naming looked at as unique. Equal texts share all symbols, hence the
   name of the whole sequence; they are represented by the smallest doc_id.
3. Windows that no such symbol rules out are grouped by the hash of their words, which verifies the
   repeats by 128 bits; a window is removed if a smaller doc_id has it too.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Runs are named in every seventh round, from the first on: later runs are rare, and naming them looks far to both sides.
WINDOW, ROUNDS, RUNS_EVERY, ANCHOR = 50, 6, 7, 5
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
#: The inverse of BASE modulo 2^64.
UNBASE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FAR = 1 << 40


def _ends(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last member of each group that head opens."""
    at = np.flatnonzero(head)
    return at, np.append(at[1:], len(head)) - 1


def _beside(doc: np.ndarray, at: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
    """The bound of each symbol's neighbour; at a document's end there is none to look at, which counts as far off."""
    to = at + step
    inside = (to >= 0) & (to < len(doc))
    to = np.clip(to, 0, len(doc) - 1)
    return np.where(inside & (doc[to] == doc[at]), bound[to], step * FAR)


def _runs(name, doc, lo, hi, size, salt: int):
    """Runs of one symbol get one name; where a run ends depends on both neighbours."""
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    at, last = _ends(head)
    count = last - at + 1
    new = np.where(count > 1, words.mix(name[at] + count.astype(U64) * BASE + U64(salt)), name[at])
    return new, doc[at], np.minimum(lo[at], _beside(doc, at, lo, -1)), np.maximum(hi[last], _beside(doc, last, hi, 1)), size[at] * count


def _pairs(name, doc, lo, hi, size, salt: int):
    """A name's bit says whether it opens or closes a pair. A pair needs no look beyond itself; an opener without
    a closer has looked at its right neighbour, a closer without an opener at its left one."""
    closes = (words.mix(name + U64(1000 + salt)) & U64(1)) == 1
    head = np.ones(len(name), bool)
    head[1:] = ~(~closes[:-1] & closes[1:] & (doc[1:] == doc[:-1]))
    at, last = _ends(head)
    two = last > at
    new = np.where(two, words.mix(words.mix(name[at] + U64(salt)) * BASE + name[last]), name[at])
    left = np.where(~two & closes[at], np.minimum(lo[at], _beside(doc, at, lo, -1)), lo[at])
    right = np.where(~two & ~closes[at], np.maximum(hi[at], _beside(doc, at, hi, 1)), hi[last])
    return new, doc[at], left, right, np.where(two, size[at] + size[last], size[at])


def recompress(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """Anchors, the symbols of ANCHOR words or more after the rounds: name, document, and the half-open range of words that the naming depends on.

    Shorter symbols, mostly common words that found no partner, say little and are left out.
    """
    name, lo = hashes.copy(), np.arange(len(hashes))
    doc, hi, size = np.repeat(np.arange(len(first) - 1), np.diff(first)), lo + 1, np.ones(len(hashes), np.int64)
    for r in range(rounds if len(name) else 0):
        if r % RUNS_EVERY == 0:
            name, doc, lo, hi, size = _runs(name, doc, lo, hi, size, 2 * r + 1)
        name, doc, lo, hi, size = _pairs(name, doc, lo, hi, size, 2 * r + 2)
    use = size >= ANCHOR
    return name[use], doc[use], lo[use], hi[use]


def text_names(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each whole sequence of words (the symbol at the top of the recompression)."""
    out = []
    size = np.diff(first)
    at = np.arange(len(hashes)) - np.repeat(first[:-1], size)
    for salt in (1, 2):
        key = words.mix(at.astype(U64) * BASE + U64(salt)) | U64(1)
        # one zero more, so that texts without words at the end begin there and the last word stays with its own text
        total = np.add.reduceat(np.append(words.mix(hashes ^ key) * key, U64(0)), first[:-1])
        out.append(words.mix(np.where(size > 0, total, 0).astype(U64) + size.astype(U64)))
    return out[0], out[1]


def _kept(block: words.Block, d: int, gone: np.ndarray | None) -> str:
    """sha256 of a document's kept words joined by spaces."""
    lo, hi = int(block.first[d]), int(block.first[d + 1])
    raw = block.buf
    keep = range(lo, hi) if gone is None else (np.flatnonzero(~gone) + lo).tolist()
    data = raw.tobytes() if len(raw) < (1 << 16) else None
    get = (lambda i: data[block.starts[i] : block.ends[i]]) if data is not None else (lambda i: raw[block.starts[i] : block.ends[i]].tobytes())
    return hashlib.sha256(b" ".join([get(i) for i in keep])).hexdigest()


def ruled_out(n: int, first: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """For each word, whether the window from it holds all that the naming of some unique symbol has looked at.

    A unique symbol that looked at words lo..hi rules out the windows from hi - WINDOW to lo.
    """
    bad = np.flatnonzero(unique & (hi - lo <= WINDOW))
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(hi[bad] - WINDOW, first[:-1][of[bad]]), 1)
    np.add.at(mark, lo[bad] + 1, -1)
    return np.cumsum(mark[:n]) > 0


def summary(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, key, number of words, names of the whole text, sha256 of its words, whether it has windows that no symbol can rule out, and its distinct last symbols."""

    def run(batches):
        for batch in batches:
            for b in words.blocks(batch.column(1), seed=21):
                n = np.diff(b.first)
                h1, h2 = text_names(b.hashes, b.first)
                name, doc, lo, hi = recompress(b.hashes, b.first, rounds)
                free = ~ruled_out(len(b.hashes), b.first, doc, lo, hi, np.ones(len(name), bool))
                free &= np.arange(len(free)) + WINDOW <= np.repeat(b.first[1:], n)
                open_ = np.bincount(b.doc[free], minlength=len(n)) > 0
                long = n[doc] >= WINDOW if len(doc) else np.zeros(0, bool)
                v, c = words.distinct(name[long], np.bincount(doc[long], minlength=len(n)))
                data = bytes(b.buf)
                sha = [hashlib.sha256(b" ".join(data[s:e].split())).hexdigest() for s, e in _spans(b)]
                ids = batch.column(0).slice(b.rows.start, b.rows.stop - b.rows.start)
                keys = batch.column(2).slice(b.rows.start, b.rows.stop - b.rows.start)
                cols = [ids, keys, pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sha), pa.array(open_), words.lists(v, c)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n", "h1", "h2", "sha", "open", "names"])

    return common.stage(docs.mapInArrow(run, "doc_id long, key long, n long, h1 long, h2 long, sha string, open boolean, names array<long>"), "symbols")


def _spans(b: words.Block):
    """Byte range from a document's first word to its last."""
    for lo, hi in zip(b.first[:-1].tolist(), b.first[1:].tolist()):
        yield (int(b.starts[lo]), int(b.ends[hi - 1])) if hi > lo else (0, 0)


def window_hashes(hashes: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW words from each word on (of a whole block; ends are the caller's to drop)."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(0, U64)
    power = np.concatenate([[U64(1)], np.cumprod(np.full(n, BASE, U64))])
    undo = np.concatenate([[U64(1)], np.cumprod(np.full(n, UNBASE, U64))])
    total = np.concatenate([[U64(0)], np.cumsum(hashes * power[:-1], dtype=U64)])
    return words.mix((total[WINDOW:] - total[:-WINDOW]) * undo[: n - WINDOW + 1])


def candidate_windows(texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Windows that hold no unique symbol: doc_id, key, pos, how many equal ones follow one another, h, g. texts: doc_id, text, shared (names that other texts have too), key."""

    def run(batches):
        for batch in batches:
            for b in words.blocks(batch.column(1), seed=21):
                if len(b.hashes) < WINDOW:
                    continue
                own = batch.column(2).slice(b.rows.start, b.rows.stop - b.rows.start)
                ok = np.concatenate([np.zeros(0, U64), own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)])
                ok = np.unique(ok)
                n = len(b.hashes)
                doc = b.doc
                name, of, dlo, dhi = recompress(b.hashes, b.first, rounds)
                at = np.minimum(np.searchsorted(ok, name), max(len(ok) - 1, 0))
                unique = (ok[at] != name) if len(ok) else np.ones(len(name), bool)
                pos = np.flatnonzero(~ruled_out(n, b.first, of, dlo, dhi, unique))
                pos = pos[pos + WINDOW <= b.first[1:][doc[pos]]]
                if not len(pos):
                    continue
                h = window_hashes(b.hashes)[pos]
                # Within a long run of one word, windows are equal: they go as one row with their number
                new = np.ones(len(pos), bool)
                new[1:] = (h[1:] != h[:-1]) | (pos[1:] != pos[:-1] + 1) | (doc[pos[1:]] != doc[pos[:-1]])
                many = np.diff(np.append(np.flatnonzero(new), len(pos)))
                pos, h = pos[new], h[new]
                g = window_hashes(words.mix(b.hashes ^ U64(5)))[pos]
                ids = np.array(batch.column(0).slice(b.rows.start, b.rows.stop - b.rows.start).to_pylist(), np.int64)
                keys = batch.column(3).slice(b.rows.start, b.rows.stop - b.rows.start).to_numpy()
                cols = [pa.array(ids[doc[pos]]), pa.array(keys[doc[pos]]), pa.array((pos - b.first[:-1][doc[pos]]).astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "pos", "many", "h", "g"])

    return texts.mapInArrow(run, "doc_id long, key long, pos int, many int, h long, g long")


def removed(texts: DataFrame) -> DataFrame:
    """doc_id, key, n_removed and kept_sha256. texts: doc_id, text, starts (pos and many of the repeated windows), key."""

    def run(batches):
        for batch in batches:
            rows = []
            for b in words.blocks(batch.column(1), seed=21, hashed=False):
                for d in range(len(b.first) - 1):
                    n = int(b.first[d + 1] - b.first[d])
                    at = batch.column(2)[b.rows.start + d].as_py() or []
                    mark = np.zeros(n + WINDOW + 1, np.int64)
                    np.add.at(mark, np.array([x["pos"] for x in at], np.int64), 1)
                    np.add.at(mark, np.array([x["pos"] + x["many"] - 1 + WINDOW for x in at], np.int64), -1)
                    gone = np.cumsum(mark)[:n] > 0
                    rows.append((batch.column(0)[b.rows.start + d].as_py(), batch.column(3)[b.rows.start + d].as_py(), int(gone.sum()), _kept(b, d, gone)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "key", "n_removed", "kept_sha256"])

    return texts.mapInArrow(run, "doc_id long, key long, n_removed long, kept_sha256 string")


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df as a table in buckets by keys, its files in the shared folder: later joins on the keys move the other side only."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).option("compression", "zstd").option("path", f"{common.shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def dedup(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    Null and empty texts have no words. Documents of fewer than 50 words keep all. A row with a null
    doc_id is neither a source nor changed. Each row counts on its own: rows that repeat a doc_id, with
    the same text or another, give a row each, and none is a smaller document than the other.
    """
    own = common.texts(docs).withColumn("key", common.text_key())
    table = summary(own, rounds)
    usable = table.where((F.col("n") >= WINDOW) & F.col("doc_id").isNotNull())
    reps = common.stage(usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "texts")
    # Let the optimizer thin joins by Bloom filters of their small sides before the large ones are shuffled, at any size
    own.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    own.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1GB")
    own_reps = usable.join(reps, ["h1", "h2", "n"]).where("doc_id = rep")
    stand = own_reps.select("doc_id", F.explode("names").alias("name"))
    twice = stand.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    twice = common.stage(twice.select("name"), "shared").where(F.col("name") >= -(1 << 63))
    # What the texts of one doc_id share is pooled: names that a text lacks say nothing about it
    shared = stand.join(twice, "name").groupBy("doc_id").agg(F.collect_set("name").alias("shared"))
    # Texts with a shared symbol, and those with windows that no symbol can rule out
    none = F.expr("cast(array() as array<bigint>)")
    marked = own_reps.groupBy("doc_id").agg(F.max("open").alias("open")).join(shared, "doc_id", "left").where(F.col("open") | F.col("shared").isNotNull())
    marked = common.stage(marked.select("doc_id", F.coalesce("shared", none).alias("shared")), "marked")
    name, row = f"skarn_{uuid.uuid4().hex}", ["doc_id", "key"]
    try:
        some = bucketed(own.join(marked.where("size(shared) >= 0"), "doc_id").select("doc_id", "text", "shared", "key"), row, name)
        # Read twice below: hashing the windows again costs less than to keep and move them once more
        found = candidate_windows(some, rounds)
        first = found.groupBy("h", "g").agg(F.min("doc_id").alias("lo"))
        starts = found.join(first, ["h", "g"]).where("doc_id > lo").groupBy(*row).agg(F.collect_set(F.struct("pos", "many")).alias("starts"))
        cut = removed(some.select("doc_id", "text", "key").join(starts, row).select("doc_id", "text", "starts", "key"))
        cut = common.stage(cut.dropDuplicates(row), "cut")
    finally:
        own.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    copies = table.join(reps, ["h1", "h2", "n"], "left")
    out = copies.join(cut, row, "left")
    whole = F.col("rep") < F.col("doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_substrings": op4_substrings}
