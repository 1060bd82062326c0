"""Dense statistics of whole texts, computed over byte buffers."""

from __future__ import annotations

import numpy as np

from .words import SPACES, Block

#: Byte classes (fixed order): 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 stop, 7 shout, 8 symbol, 9 bar, 10 first byte of a longer letter, 11 further byte, 12 quote or bracket
CLASSES = 13
CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate([b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\x0b\x0c", b"\n\r", b".,;:", b"!?", b"#$%&*@^~+=<>", b"|", bytes(range(0xC0, 256)), bytes(range(0x80, 0xC0)), b"\"'`()[]{}"]):
    CLASS[list(_bytes)] = _k


def by_doc(block: Block, offs: np.ndarray) -> np.ndarray:
    """Counts of byte classes by document."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
    return np.bincount(doc * CLASSES + CLASS[block.buf], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)


def sums(block: Block, values: np.ndarray) -> np.ndarray:
    """Sums of a value of words by document."""
    total = np.concatenate([[0], np.cumsum(values, dtype=float)])
    return total[block.first[1:]] - total[block.first[:-1]]


def word_stats(block: Block) -> dict[str, np.ndarray]:
    n = np.diff(block.first).astype(float)
    size = (block.ends - block.starts).astype(float)
    doc = block.doc
    order = np.lexsort((block.hashes, doc))
    h, d = block.hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    run = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(len(n))
    np.maximum.at(top, d[new], run)
    same = np.zeros(len(doc))
    same[1:] = (block.hashes[1:] == block.hashes[:-1]) & (doc[1:] == doc[:-1])
    first, last = CLASS[block.buf[block.starts]], CLASS[block.buf[block.ends - 1]]
    low = np.maximum(n, 1)
    mean = sums(block, size) / low
    return {
        "n": n,
        "mean_len": mean,
        "sd_len": np.sqrt(np.maximum(0, sums(block, size * size) / low - mean**2)),
        "distinct": np.bincount(d[new], minlength=len(n)) / low,
        "top_share": top / low,
        "same_next": sums(block, same) / low,
        "capital": sums(block, (first == 2) | (first == 10)) / low,
        "symbol_end": sums(block, last == 8) / low,
        "shout_end": sums(block, last == 7) / low,
        "stop_end": sums(block, last == 6) / low,
        "bar": sums(block, first == 9) / low,
        "has_digit": sums(block, (first == 3)) / low,
    }


def ratios(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


__all__ = ["CLASS", "CLASSES", "SPACES", "by_doc", "ratios", "sums", "word_stats"]
