"""Harmonic packing of token runs into fixed-capacity sequences.

Class k holds pieces of capacity // (k + 1) < length <= capacity // k; a sequence of class k takes
exactly k of them. Documents may be cut, so each remainder is cut at the largest reciprocal of the
capacity below it: pieces then fill their class's sequences nearly to the last token. Every task
packs its own rows, without a shuffle; the sequences that a task leaves open at its end are merged
by best fit within that task, so a task adds one short sequence at most.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens

CAPACITY, END_ID, LEAST = 4096, 2, 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


@lru_cache(maxsize=None)
def cuts(rest: int, capacity: int, least: int) -> tuple[int, ...]:
    """Piece lengths for a remainder below the capacity; no piece is shorter than `least` unless the remainder is."""
    if rest <= 0:
        return ()
    k = capacity // rest
    if rest == capacity // k or rest < 2 * least:
        return (rest,)
    size = next((s for j in range(k + 1, capacity + 1) if rest - (s := capacity // j) >= least), 0)
    return (size, *cuts(rest - size, capacity, least)) if size >= least else (rest,)


class Bins:
    """Open sequences of one task, one for each class."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open = capacity, first, {}

    def add(self, piece: tuple) -> list[tuple]:
        """Rows of the sequence that this piece completes, if any. piece: doc_id, start, length, crc, doc_tokens."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self._close(self.open.pop(k)) if len(held) == k else []

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        at, rows = 0, []
        for p in pieces:
            rows.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return rows

    def rest(self) -> Iterator[tuple]:
        """Best fit, longest first, over what is still open."""
        free: list[tuple[int, int]] = []
        filled: list[list[tuple]] = []
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            at = bisect.bisect_left(free, (p[2], -1))
            if at < len(free):
                room, b = free.pop(at)
            else:
                room, b = self.capacity, len(filled)
                filled.append([])
            filled[b].append(p)
            if room > p[2]:
                bisect.insort(free, (room - p[2], b))
        self.open = {}
        for pieces in filled:
            yield from self._close(pieces)


def pack(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, least: int = LEAST) -> DataFrame:
    """One row for each piece of each document.

    A document's ids are those of its text and then end_id; null and empty texts give end_id alone.
    doc_id may be null or repeated: every row is a document of its own. Extra columns are ignored;
    an empty table gives no rows. Ids of a sequence come from the task's number, so a task that runs
    again over the same rows gives the same sequences.
    """

    def run(batches):
        encode = tokens.word_ids(vocabulary).each
        tail = end_id.to_bytes(4, "little")
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            rows: list[tuple] = []
            for doc, own in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = own.astype("<u4").tobytes() + tail
                n, at = len(ids) // 4, 0
                for size in (capacity,) * (n // capacity) + cuts(n % capacity, capacity, least):
                    rows += bins.add((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    at += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=ARROW)
        if rows := list(bins.rest()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=ARROW)

    return common.texts(docs).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
