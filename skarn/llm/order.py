"""Training-order materialisation of token sequences as binary shards.

The token ids of all documents form fixed-length sequences. A keyed Feistel permutation with cycle
walking gives every sequence its global slot in training order, without a sort of random keys and
without a table: any slot can be computed, and inverted, from the key. Slots are cut into ranges; a
range is one shard, written by one task as records of fixed stride, so a reader can go to any slot
by arithmetic and go on from there.

A record is RECORD: slot, first document, number of ids that are no padding, crc32 of the ids, the
ids as unsigned 16-bit little-endian numbers, and one closing byte (0x0A).
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .words import U64, mix

LENGTH, PER_SHARD, KEY, END_ID, PAD_ID, ROUNDS = 1024, 4096, 20_240_229, 2, 0, 6
#: Bytes of the shards that one task writes.
RANGE = 1 << 25
#: Stands for a null doc_id in a record.
NULL_ID = -(1 << 63)
HEAD = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("ids", "<u4"), ("crc32", "<u4")])


def stride(length: int = LENGTH) -> int:
    return HEAD.itemsize + 2 * length + 1


class Feistel:
    """A bijection of range(n): a balanced network on the next even number of bits, walked until it lands below n."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mix(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key))
        self.low = U64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        h = U64(self.half)
        a, b = x >> h, x & self.low
        for k in keys:
            if back:
                a, b = b ^ (mix(a ^ k) & self.low), a
            else:
                a, b = b, a ^ (mix(b ^ k) & self.low)
        return (a << h) | b

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(U64), keys, back)
        while len(out := np.flatnonzero(x >= U64(self.n))):
            x[out] = self._once(x[out], keys, back)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def _splits(docs: DataFrame) -> DataFrame:
    """The texts with the file split that each was read from; within a split the order of rows is fixed."""
    own = common.texts(docs)
    return own.select("doc_id", "text", F.input_file_name().alias("file"), F.input_file_block_start().alias("at"))


def _runs(batch) -> list[tuple[str, int, int, int]]:
    """Rows lo to hi of a batch that come from one split."""
    files, at = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    out, lo = [], 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], at[i]) != (files[lo], at[lo]):
            out.append((files[lo], at[lo], lo, i))
            lo = i
    return out


def sequence_counts(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """file, at, sequences: how many sequences each split gives, one row for each task that met the split."""

    def run(batches):
        encoder, total = tokens.word_ids(vocabulary), {}
        for batch in batches:
            for file, at, lo, hi in _runs(batch):
                n = hi - lo + int(encoder.counts(batch.column(1).slice(lo, hi - lo)).sum())
                total[file, at] = total.get((file, at), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array([-(-n // length) for n in total.values()], pa.int64())], names=["file", "at", "sequences"])

    return docs.mapInArrow(run, "file string, at long, sequences long")


def _bases(own: DataFrame, vocabulary: str, length: int) -> tuple[dict, int] | None:
    """The first sequence number and the count of each split, and the total; None if splits don't name the rows' places.

    One row for each file split comes to the driver, no more than Spark itself tracks there.
    """
    base, n = {}, 0
    for r in sorted(sequence_counts(own, vocabulary, length).collect()):
        if not r["file"] or (r["file"], r["at"]) in base:
            return None
        base[r["file"], r["at"]] = (n, r["sequences"])
        n += r["sequences"]
    return base, n


def materialise(docs: DataFrame, path: str | None = None, vocabulary: str = tokens.VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> str:
    """Write the shards below path (a new folder of the shared one by default) and return it.

    Sequences run over the documents of a file split; the last one of a split is padded. The first
    pass counts each split's sequences, the second one writes them, and it fails if a split then
    gives another number. A table whose rows don't come straight from files, or that reads a file
    twice, is written to the shared folder first. Null and empty texts give the end id alone; rows
    that repeat a doc_id are documents of their own; a null doc_id is kept. No rows give no shards.
    """
    spark = docs.sparkSession
    path = path or f"{common.shared_dir(spark)}/skarn-shards-{uuid.uuid4().hex}"
    own = _splits(docs)
    found = _bases(own, vocabulary, length)
    if found is None:
        own = _splits(common.stage(common.texts(docs), "ordered"))
        found = _bases(own, vocabulary, length)
    base, n = found
    if not n:
        spark.createDataFrame([], "shard long, value string").write.partitionBy("shard").text(path)
        return path
    bases = spark.sparkContext.broadcast(base)
    walk = Feistel(n, key)

    def records(split, first_docs, ids: bytes, done: int):
        """Slots and record bytes of the whole sequences in ids; done: sequences of the split before."""
        k = len(first_docs)
        slots = walk.slot(np.arange(bases.value[split][0] + done, bases.value[split][0] + done + k))
        out = []
        for i, slot in enumerate(slots.tolist()):
            raw = ids[2 * length * i : 2 * length * (i + 1)]
            head = np.zeros(1, HEAD)
            head[0] = (slot, first_docs[i], len(raw) // 2, zlib.crc32(raw))
            out.append(head.tobytes() + raw + np.full(length - len(raw) // 2, PAD_ID, "<u2").tobytes() + b"\n")
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(out, pa.binary())], names=["slot", "record"])

    def run(batches):
        encoder = tokens.word_ids(vocabulary)
        if encoder.most_id > 0xFFFF:
            raise ValueError("records hold 16-bit ids; this vocabulary has larger ones")
        split, ids, places, owners, done = None, bytearray(), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def flush(last: bool):
            nonlocal ids, places, owners, done
            k = len(ids) // 2 // length
            if last and len(ids) % (2 * length):
                k += 1
            if last and done + k != bases.value[split][1]:
                raise RuntimeError(f"the rows of {split} changed between the passes")
            if not k:
                return None
            firsts = owners[np.searchsorted(places, np.arange(k) * length, "right") - 1]
            out = records(split, firsts.tolist(), bytes(ids[: 2 * length * k]), done)
            keep = max(0, int(np.searchsorted(places, k * length, "right")) - 1)
            owners, places = owners[keep:], np.maximum(places[keep:] - k * length, 0)
            ids, done = ids[2 * length * k :], done + k
            return out

        for batch in batches:
            for file, at, lo, hi in _runs(batch):
                if (file, at) != split:
                    if split is not None and (out := flush(True)) is not None:
                        yield out
                    split, ids, places, owners, done = (file, at), bytearray(), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                docs_ = batch.column(0).slice(lo, hi - lo).fill_null(NULL_ID).to_numpy()
                for rows, new, offs in encoder.blocks(batch.column(1).slice(lo, hi - lo)):
                    owners = np.concatenate([owners, docs_[rows]])
                    places = np.concatenate([places, len(ids) // 2 + offs[:-1] + np.arange(len(offs) - 1)])
                    ids += np.insert(new, offs[1:], END_ID).astype("<u2").tobytes()
                    if len(ids) >= 512 * length and (out := flush(False)) is not None:
                        yield out
        if split is not None and (out := flush(True)) is not None:
            yield out

    # Ranges of slots, each of whole shards; slots are spread evenly, so no sample is needed to cut them
    per_range = per_shard * max(1, RANGE // (per_shard * stride(length)))
    made = own.mapInArrow(run, "slot long, record binary").withColumn("shard", F.expr(f"slot div {per_shard}"))
    lines = made.repartitionById(-(-n // per_range), F.expr(f"cast(slot div {per_range} as int)")).sortWithinPartitions("slot")
    written = Observation()
    # A text writer puts a line end after each value, which is the record's last byte
    value = F.expr(f"substring(record, 1, {stride(length) - 1})").cast("string").alias("value")
    lines.observe(written, F.count("*").alias("n")).select("shard", value).write.partitionBy("shard").text(path)
    if written.get["n"] != n:
        raise RuntimeError("the table changed between the passes")
    return path


def read(spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, start: int = 0) -> DataFrame:
    """slot, shard, byte_offset, doc_id, n_ids, crc32, ids (binary) from slot `start` on; earlier shards are not opened.

    A shard is read whole by one task (per_shard records of fixed stride); a record whose crc32 does not hold is an error.
    """
    size = stride(length)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py()
                rec = np.frombuffer(raw, np.uint8).reshape(-1, size)
                head = np.frombuffer(np.ascontiguousarray(rec[:, : HEAD.itemsize]).tobytes(), HEAD)
                ids = [raw[size * j + HEAD.itemsize : size * j + HEAD.itemsize + 2 * int(h["ids"])] for j, h in enumerate(head)]
                if any(zlib.crc32(x) != int(c) for x, c in zip(ids, head["crc32"])):
                    raise ValueError("a record is damaged")
                cols = [pa.array(head["slot"].astype(np.int64)), pa.array(np.arange(len(head), dtype=np.int64) * size), pa.array(head["doc_id"].astype(np.int64), mask=head["doc_id"] == NULL_ID), pa.array(head["ids"].astype(np.int32)), pa.array(head["crc32"].astype(np.int64)), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["slot", "byte_offset", "doc_id", "n_ids", "crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # Folders name the shards; without any there are no rows
    files = files.where(F.col("shard") >= start // per_shard) if "shard" in files.columns else files.limit(0)
    out = files.select("content").mapInArrow(run, "slot long, byte_offset long, doc_id long, n_ids int, crc32 long, ids binary").where(F.col("slot") >= start)
    return out.select("slot", F.expr(f"slot div {per_shard}").alias("shard"), "byte_offset", "doc_id", "n_ids", "crc32", "ids")


def op3_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of the whole table and reads them back: one row for each sequence, in no order of its own."""
    path = materialise(common.table(spark, sf_dir, "documents"))
    return read(spark, path).drop("ids")


QUERIES = {"op3_order": op3_order}
