"""Vectorised words of Arrow text columns: boundaries, 64-bit hashes, hashed n-grams.

A block holds a run of documents as one byte buffer. Work proceeds in pieces of about PIECE bytes
that end at separators, so memory stays bounded by the piece, not by the longest document. A text
without separators is one piece; its only arrays of its length are of single bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Words of more bytes are hashed in parts of this size.
LONG = 1 << 14
U64 = np.uint64
#: Odd 64-bit multipliers: the splitmix64 finaliser and the golden ratio step (fixed values).
MIX1, MIX2, STEP = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= MIX1
    x ^= x >> U64(27)
    x *= MIX2
    x ^= x >> U64(31)
    return x


def keys(n: int, seed: int, start: int = 0) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers from the given place on, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(start + 1, start + n + 1, dtype=U64) * STEP + U64(seed)) | U64(1)


BYTE_KEY = keys(256, 11)


def separators(extra: bytes = b"") -> np.ndarray:
    """Which bytes part words: space and 0x09 to 0x0D, and those of extra."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E), *extra]] = True
    return table


SPACES = separators()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1, in UTF-8, in lower case; the length stays."""
    out = LOWER[buf]
    if len(buf) > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][capital] += 32
    return out


ASIS = np.arange(256, dtype=np.uint8)


@dataclass
class Block:
    """Words of a run of documents. first[i]:first[i+1] are the words of document i."""

    rows: slice
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def _piece_words(buf: np.ndarray, cuts: np.ndarray, seps: np.ndarray, fold_case, seed: int, want: bool, upto: int | None = None):
    """Starts, ends and hashes of the words in buf; cuts: where a document begins; upto: bytes of a word that count."""
    solid = ~seps[buf]
    new = np.empty(len(buf), bool)
    new[0] = True
    new[1:] = ~solid[:-1]
    new[cuts[cuts < len(buf)]] = True
    starts = np.flatnonzero(solid & new)
    last = np.empty(len(buf), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    last[inner - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    if not want or not len(starts):
        return starts, ends, np.zeros(len(starts), U64)
    size = ends - starts
    folded = fold_case[buf] if isinstance(fold_case, np.ndarray) else fold_case(buf)
    total = np.zeros(len(starts), U64)
    short = size <= LONG
    if short.all():
        own, first = size, starts
    else:
        own, first = size[short], starts[short]
    if len(own):
        begin = np.cumsum(own) - own
        pos = np.arange(int(own.sum())) - np.repeat(begin, own)
        value = BYTE_KEY[folded[np.repeat(first, own) + pos]] * keys(int(own.max()), 1000 + seed)[pos]
        if upto is not None:
            value[pos >= upto] = 0
        total[short] = np.add.reduceat(value, begin)
    for i in np.flatnonzero(~short).tolist():  # a very long word goes in parts, so memory follows the part
        end = int(ends[i]) if upto is None else min(int(ends[i]), int(starts[i]) + upto)
        for lo in range(int(starts[i]), end, LONG):
            hi = min(lo + LONG, end)
            total[i] += (BYTE_KEY[folded[lo:hi]] * keys(hi - lo, 1000 + seed, lo - int(starts[i]))).sum(dtype=U64)
    counted = size if upto is None else np.minimum(size, upto)
    return starts, ends, mix(total + counted.astype(U64) * STEP)


def blocks(column: pa.Array, seps: np.ndarray = SPACES, fold_case=ASIS, seed: int = 0, hashed: bool = True, most: int = PIECE, upto: int | None = None) -> Iterator[Block]:
    """Blocks of whole documents of about `most` bytes (one longer document is a block of its own).

    fold_case: a table by byte, or a function of the buffer that keeps its length.
    """
    data, offs = buffer(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        buf, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        parts, at = [], 0
        while at < len(buf):
            to = min(at + most, len(buf))
            while to < len(buf):  # a piece ends after a separator or at a document's end
                gap = np.flatnonzero(seps[buf[to : to + 4096]])
                stop = own[np.searchsorted(own, to)]
                near = min(stop, to + int(gap[0]) + 1 if len(gap) else to + 4096)
                to = int(near)
                if len(gap) or to == stop:
                    break
            s, e, h = _piece_words(buf[at:to], own[:-1][(own[:-1] >= at) & (own[:-1] < to)] - at, seps, fold_case, seed, hashed, upto)
            parts.append((s + at, e + at, h))
            at = to
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
        yield Block(slice(lo, hi), buf, starts, ends, hashes, np.searchsorted(starts, own, "left"))
        lo = hi


def ngrams(hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 77) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row and their counts by document; a document of 1 to k-1 words gives its whole sequence."""
    n = len(hashes)
    coef = keys(k, seed)
    padded = np.concatenate([hashes, np.zeros(k, U64)])
    size = np.diff(first)
    short = (size > 0) & (size < k)
    count = np.where(size >= k, size - k + 1, short.astype(np.int64))
    doc = np.repeat(np.arange(len(size)), count)
    begin = np.cumsum(count) - count
    at = first[:-1][doc] + np.arange(len(doc)) - begin[doc]
    room = np.minimum(k, size)[doc] if n else np.zeros(0, np.int64)
    total = room.astype(U64) * STEP
    for j in range(k):
        part = padded[at + j] * coef[j]
        if short.any():
            part = np.where(room > j, part, U64(0))
        total += part
    return mix(total), count


def distinct(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document in ascending order, and how many; count: values by document."""
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], np.bincount(d[keep], minlength=len(count))


def lists(values: np.ndarray, count: np.ndarray, kind=None) -> pa.Array:
    """A list column from flat values and counts by row."""
    offs = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    flat = values.view(np.int64) if values.dtype == U64 else values
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, kind))
