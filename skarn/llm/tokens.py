"""Token ids of whole texts by a vocabulary file of the `tokenizers` library, with a fast path.

For vocabularies that drop white space and mark word ends, a text's ids are those of its words in
a row, so each distinct word is encoded once per worker and looked up by its 64-bit hash. Plain Latin words take a merge table of
the same ranks (with the word end as a byte of its own); every other word goes to the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa

from . import words

VOCABULARY = "word_bpe_49k.json"
#: Distinct words that a worker keeps, the table's slots, and the ids of a word that is kept, at most.
MEMO, SLOTS, KEPT_IDS = 1_000_000, 1 << 21, 64
END = "\x01"
SIGNS = np.frombuffer(b".,", np.uint8)
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
U64 = np.uint64


def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordIds:
    """Little-endian unsigned 32-bit ids as bytes, equal to the library's."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        letter = _byte_of_letter()

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(letter[c] for c in (token[:-4] if end else token)) + (END.encode() if end else b"")

        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        for b in range(256):
            ranks.setdefault(bytes([b]) + END.encode(), len(ranks))
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(a + b), len(ranks))
        own = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        self.lut = np.zeros(len(ranks), np.uint32)
        for k, r in ranks.items():
            self.lut[r] = own.get(k, 0)
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x01\s]+\x01", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.last = np.array([k.endswith(END.encode()) for k in ranks])
        self.most_id = int(self.lut.max())
        # open addressing over word hashes; a slot holds where the word's ids stand in flat, and how many
        self.keys = np.zeros(SLOTS, np.uint64)
        self.start, self.size = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.flat, self.used, self.words = np.zeros(1 << 20, np.uint32), 0, 0

    def _plain(self, block: words.Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters, with or without a closing sign, in a row, and their counts: all merged in one call."""
        low = words.lower_latin(block.buf)
        begin, end = block.starts[at], block.ends[at]
        signed = np.isin(low[end - 1], SIGNS)
        # each word's bytes, END, and for a closing sign that sign and END once more
        size = end - begin
        room = size + 1 + signed
        to = np.cumsum(room) - room
        out = np.full(int(room.sum()), END.encode()[0], np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(to, size) + inner
        place[np.cumsum(size)[signed] - 1] += 1
        out[place] = low[np.repeat(begin, size) + inner]
        ranks = np.array(self.fast(out.tobytes().decode()), np.int64)
        ends = np.flatnonzero(self.last[ranks]) + 1
        stop = ends[np.cumsum(1 + signed) - 1]
        return self.lut[ranks], np.diff(stop, prepend=0)

    def _other(self, word: str) -> np.ndarray:
        if word.isascii() and word.isprintable() and "<|" not in word:
            return self.lut[self.fast(self.parts.sub("\\g<0>" + END, word.lower()))]
        return np.array(self.slow.encode(word, add_special_tokens=False).ids, np.uint32)

    def _learn(self, block: words.Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words at these places of the block, in a row, and their counts."""
        begin, end = block.starts[at], block.ends[at]
        buf = block.buf
        letter = LETTERS[buf]
        if len(buf) > 1:  # the letters of Latin-1 are C3 and a further byte
            second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0xBF) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            letter[:-1] |= second
            letter[1:] |= second
        count = np.concatenate([[0], np.cumsum(letter)])
        core = end - np.isin(buf[end - 1], SIGNS)
        easy = (count[core] - count[begin] == core - begin) & (core > begin) & (core - begin <= words.LONG)
        n = np.zeros(len(at), np.int64)
        ids, n[easy] = self._plain(block, at[easy]) if easy.any() else (np.zeros(0, np.uint32), 0)
        rest = [self._other(buf[s:e].tobytes().decode()) for s, e in zip(begin[~easy].tolist(), end[~easy].tolist())]
        n[~easy] = [len(r) for r in rest]
        out = np.empty(int(n.sum()), np.uint32)
        which = np.repeat(easy, n)
        out[which] = ids
        out[~which] = np.concatenate([np.zeros(0, np.uint32), *rest])
        return out, n

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (hashes & U64(SLOTS - 1)).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == hashes, at, -1)
        live = np.flatnonzero((held != hashes) & (held != 0))
        while len(live):
            at[live] = (at[live] + 1) & (SLOTS - 1)
            held = self.keys[at[live]]
            hit = held == hashes[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit & (held != 0)]
        return out

    def _keep(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Enter distinct new words into the table."""
        at = (hashes & U64(SLOTS - 1)).astype(np.int64)
        live = np.arange(len(hashes))
        while len(live):
            free = self.keys[at[live]] == 0
            self.keys[at[live[free]]] = hashes[live[free]]
            done = self.keys[at[live]] == hashes[live]
            own = live[done]
            self.start[at[own]], self.size[at[own]] = start[own], size[own]
            live = live[~done]
            at[live] = (at[live] + 1) & (SLOTS - 1)
        self.words += len(hashes)

    def _table(self, block: words.Block) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids stand in self.flat, and how many there are; new words are learned and kept while there is room."""
        hashes = np.maximum(block.hashes, U64(1))
        slot = self._find(hashes)
        start, size = self.start[slot], self.size[slot].astype(np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            seen, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            flat, n = self._learn(block, new[first])
            begin = self.used + np.cumsum(n) - n
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(flat) + len(self.flat), np.uint32)])
            self.flat[self.used : self.used + len(flat)] = flat
            start[new], size[new] = begin[inverse], n[inverse]
            short = np.flatnonzero(n <= KEPT_IDS)[: max(0, MEMO - self.words)]
            if len(short):
                # ids of words that are not kept stay in flat only up to the last kept one
                self._keep(seen[short], begin[short], n[short])
                self.used = int(begin[short[-1]] + n[short[-1]])
        return start, size

    def counts(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(column), np.int64)
        for b in words.blocks(column, seed=31):
            if len(b.hashes):
                total = np.concatenate([[0], np.cumsum(self._table(b)[1])])
                out[b.rows] = np.diff(total[b.first])
        return out

    def blocks(self, column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """By block of documents: rows, the ids of all in a row, and where each document's begin (and the last ends)."""
        for b in words.blocks(column, seed=31):
            if not len(b.hashes):
                yield b.rows, np.zeros(0, np.uint32), np.zeros(len(b.first), np.int64)
                continue
            start, size = self._table(b)
            end = np.cumsum(size)
            ids = self.flat[np.repeat(start - (end - size), size) + np.arange(end[-1])]
            yield b.rows, ids, np.concatenate([[0], end])[b.first]

    def each(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for _, ids, offs in self.blocks(column):
            for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
                yield ids[lo:hi]

    def ids(self, text: str | None) -> bytes:
        return next(self.each(pa.array([text], pa.string()))).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def word_ids(vocabulary: str = VOCABULARY) -> WordIds:
    """One encoder per worker process; the file's place is asked for where the task runs."""
    return WordIds(public_tokenizers.path(vocabulary))
