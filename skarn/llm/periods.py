"""Periodic runs of words by string synchronising sets.

1. Words get 64-bit hashes; texts stand in one sequence, parted by symbols that occur once. Names of
   stretches of 2, 4, 8, ... words come from pairs of names of half the length.
2. Periods under SMALL words are found where the sequence equals itself so many words on.
3. For a scale of t words, a place is selected if the smallest name of t words among the places up to t
   words on stands at it or t words on; names within highly periodic regions (period of t/3 or less)
   don't take part, so selected places stay sparse. The choice depends on the next 2 t words alone: in
   a run, what is selected is selected again a period later. Two selected places 3 t to 6 t words apart
   with the same next 2 t words propose their distance as a period.
4. Of a run with such a period, no place is selected only if its whole first period is highly
   periodic. Then two runs of one smaller period p touch inside of it, and the way they lie to each
   other fixes the period modulo p: these are proposed as well. As scales go up, runs of smaller
   periods are known by then.
5. A proposal is laid out word by word to both sides; of equal stretches the smallest period counts.

So every run is found: nothing is sampled and no length is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

LEAST, SMALL, FIRST = 12, 12, 4
U64 = np.uint64
NONE = U64(0xFFFFFFFFFFFFFFFF)
EMPTY = np.zeros(0, np.int64)
#: Cells of one comparison.
CELLS = 1 << 19


def least(q):
    """Words that a stretch of period q has to have to be kept: runs of one or two words serve the first scales already."""
    return np.where(q == 1, FIRST, np.where(q == 2, 2 * FIRST, np.maximum(LEAST, 2 * q)))


def agreeing(t: np.ndarray, at: np.ndarray, q: np.ndarray, step: int = 1, most: np.ndarray | None = None) -> np.ndarray:
    """How many words from each place on, in the direction of step, are the same q words later; no more than `most`. t ends in symbols of their own on both sides."""
    got = np.zeros(len(at), np.int64)
    live, width = np.arange(len(at)) if most is None else np.flatnonzero(most > 0), 8
    while len(live):
        left = []
        for part in np.array_split(live, -(-len(live) * width // CELLS)):
            cols = got[part][:, None] + np.arange(width)
            pos = np.clip(at[part][:, None] + step * cols, 0, len(t) - 1)
            other = np.minimum(pos + q[part][:, None], len(t) - 1)
            same = (t[pos] == t[other]) & (pos < other)
            if most is not None:
                same &= cols < most[part][:, None]
            full = same.all(1)
            got[part] += np.where(full, width, same.argmin(1))
            left.append(part[full])
        live, width = np.concatenate(left), min(width * 4, 1 << 14)
    return got


class Found:
    """Runs by start, end (exclusive) and period; of equal stretches the smallest period."""

    def __init__(self):
        self.start, self.end, self.period = EMPTY, EMPTY, EMPTY

    def add(self, start, end, period):
        use = end - start >= least(period)
        s, e, p = (np.concatenate([a, b[use]]) for a, b in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((p, e, s))
        s, e, p = s[order], e[order], p[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.start, self.end, self.period = s[new], e[new], p[new]


def small_periods(t: np.ndarray, found: Found) -> None:
    for q in range(1, SMALL):
        same = np.flatnonzero(t[q:] == t[:-q]) if len(t) > q else EMPTY
        if not len(same):
            continue
        head = np.ones(len(same), bool)
        head[1:] = same[1:] != same[:-1] + 1
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(same)) - 1
        s, e = same[at], same[last] + 1 + q
        found.add(s, e, np.full(len(s), q))


def highly_periodic(n: int, tau: int, found: Found) -> np.ndarray:
    """Places from which tau words have a period of tau / 3 or less."""
    use = (3 * found.period <= tau) & (found.end - found.start >= tau)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, found.start[use], 1)
    np.add.at(mark, found.end[use] - tau + 1, -1)
    return np.cumsum(mark[:n]) > 0


def selected(names: np.ndarray, tau: int, found: Found) -> np.ndarray:
    """The synchronising set of a scale. names: of tau words from each place on."""
    n = len(names) - tau
    if n <= 0:
        return EMPTY
    h = words.mix(names ^ U64(tau))
    h[highly_periodic(len(h), tau, found)] = NONE
    low, size = h, 1  # minima of size places; twice the size each time, at last tau + 1 places by two that overlap
    while 2 * size <= tau + 1:
        low, size = np.minimum(low[: len(low) - size], low[size:]), 2 * size
    rest = tau + 1 - size
    low = np.minimum(low[:n], low[rest : rest + n])
    return np.flatnonzero((low != NONE) & ((low == h[:n]) | (low == h[tau : tau + n])))


def equal_contexts(place: np.ndarray, context: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of selected places 3 tau to 6 tau words apart with equal contexts: the first place and the distance."""
    at, far, d = [EMPTY], [EMPTY], 1
    while d < len(place):
        gap = place[d:] - place[:-d]
        if not (gap < 6 * tau).any():
            break
        use = np.flatnonzero((gap >= 3 * tau) & (gap < 6 * tau) & (context[d:] == context[:-d]))
        at.append(place[use])
        far.append(gap[use])
        d += 1
    return np.concatenate(at), np.concatenate(far)


def lay_out(t: np.ndarray, at: np.ndarray, q: np.ndarray, sure: np.ndarray, found: Found) -> None:
    """Stretches around proposals. at: a place, from which `sure` words are the same q words later."""
    if not len(at):
        return
    order = np.lexsort((at, q))
    at, q, end = at[order], q[order], (at + sure)[order]
    # Places of one period in a row are laid out together: each word of the gaps between them is compared once
    follow = np.append(np.where(q[1:] == q[:-1], at[1:], len(t)), len(t))
    gap = np.clip(follow - end, 0, np.maximum(q, LEAST))
    reach = end + agreeing(t, end, q, 1, gap)
    head = np.ones(len(at), bool)
    head[1:] = reach[:-1] < follow[:-1]
    first = np.flatnonzero(head)
    s, e, p = at[first], np.maximum.reduceat(reach, first), q[first]
    e = e + agreeing(t, e, p)
    s = s - agreeing(t, s - 1, p, -1)
    found.add(s, e + p, p)


def touching(t: np.ndarray, tau: int, found: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proposals 3 tau to 6 tau of two touching runs of one smaller period: a place, the period, how many words are sure."""
    use = np.flatnonzero((9 * found.period < 6 * tau) & (found.end - found.start >= 3 * tau))
    s, e, p = found.start[use], found.end[use], found.period[use]
    order = np.lexsort((s, p))
    s, e, p = s[order], e[order], p[order]
    at, far, sure = [EMPTY], [EMPTY], [EMPTY]
    for i in np.flatnonzero((p[1:] == p[:-1]) & (e[:-1] >= s[1:])).tolist():
        a1, b1, a2, b2, per = int(s[i]), int(e[i]), int(s[i + 1]), int(e[i + 1]), int(p[i])
        root, within = t[a2 : a2 + per].tobytes(), t[b1 - 2 * per : b1 - 1].tobytes()
        k = within.find(root)
        while k >= 0 and k % 8:
            k = within.find(root, k + 1)
        if k < 0:
            continue
        q = a2 - (b1 - 2 * per + k // 8)
        q += -(-(max(3 * tau, 9 * per) - q) // per) * per
        q = np.arange(q, min(6 * tau - 1, b1 - a1, b2 - a2, (b2 - a1) // 2) + 1, per)
        x0, x1 = np.maximum(a1, a2 - q), np.minimum(b1, b2 - q)
        at.append(x0)
        far.append(q)
        sure.append(x1 - x0)
    return np.concatenate(at), np.concatenate(far), np.concatenate(sure)


def wider(names: np.ndarray, tau: int) -> np.ndarray:
    """Names of 2 tau words from those of tau words."""
    return words.mix(names * words.MIX1 + words.mix(np.append(names[tau:], np.zeros(min(tau, len(names)), U64)) + U64(tau)))


def sequence(hashes: np.ndarray, first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of docs, with a symbol of its own before each document and at the end, and where each begins."""
    size = np.diff(first)[docs]
    begin = np.cumsum(size + 1) - size
    t = words.mix(np.arange(int(size.sum()) + len(docs) + 1, dtype=U64) + U64(0x5EED << 40))
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    t[np.repeat(begin, size) + step] = hashes[np.repeat(first[:-1][docs], size) + step]
    return t, begin


def runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start within it, length and period of each run of LEAST words or more, by document, start and period."""
    size = np.diff(first)
    docs = np.flatnonzero(size >= LEAST)
    t, begin = sequence(hashes, first, docs)
    found, names, tau, out = Found(), t, 1, []
    small_periods(t, found)
    while tau < FIRST:
        names, tau = wider(names, tau), 2 * tau
    while len(docs):
        keep = size[docs] >= 6 * tau  # others can't have periods of this scale
        of = np.searchsorted(begin, found.start, "right") - 1
        done = ~keep[of]
        out.append((docs[of[done]], (found.start - begin[of])[done], (found.end - found.start)[done], found.period[done]))
        if not keep.all():
            mask = np.append(np.repeat(keep, size[docs] + 1), True)
            t, names = t[mask], names[mask]
            moved = np.cumsum((size[docs] + 1) * keep) - size[docs]
            shift = (moved - begin)[of][~done]
            found.start, found.end, found.period = found.start[~done] + shift, found.end[~done] + shift, found.period[~done]
            docs, begin = docs[keep], moved[keep]
            if not len(docs):
                break
        wide = wider(names, tau)
        place = selected(names, tau, found)
        at, far = equal_contexts(place, wide[place], tau)
        lay_out(t, at, far, np.full(len(at), 2 * tau), found)
        lay_out(t, *touching(t, tau, found), found)
        names, tau = wide, 2 * tau
    doc, start, length, period = (np.concatenate(x) if x else EMPTY for x in (zip(*out) if out else [()] * 4))
    use = length >= LEAST
    order = np.lexsort((period[use], start[use], doc[use]))
    return doc[use][order], start[use][order], length[use][order], period[use][order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("text", pa.string())])


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and text: the words of each row without the repeats in its runs, joined by one space.

    A run is a stretch of at least 12 words and two periods that can't be made longer; its words after
    the first period go, those of nested and overlapping runs alike. Every row gives one row: null and
    empty texts have no words, rows that repeat a doc_id are taken one by one, a null doc_id stays
    null. Other columns are left out. A text of any length is one sequence; a task holds some 100
    bytes for each word of its longest text. Words are compared by 64-bit hashes.
    """

    def run(batches):
        for batch in batches:
            for b in words.blocks(batch.column(1), seed=31):
                doc, start, length, period = runs(b.hashes, b.first)
                count = np.bincount(doc, minlength=len(b.first) - 1)
                gone = np.zeros(len(b.hashes) + 1, np.int64)
                np.add.at(gone, b.first[doc] + start + period, 1)
                np.add.at(gone, b.first[doc] + start + length, -1)
                keep = np.cumsum(gone[:-1]) == 0
                offs = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                listed = pa.ListArray.from_arrays(offs, pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(RUN)))
                ids = batch.column(0).slice(b.rows.start, b.rows.stop - b.rows.start)
                cols = [ids, pa.array(np.diff(b.first).astype(np.int64)), listed, pa.array(_kept(b, keep, count), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, schema=RESULT)

    return common.texts(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def _kept(b: words.Block, keep: np.ndarray, count: np.ndarray):
    """The kept words of each document."""
    data = b.buf.tobytes()
    for d, (lo, hi) in enumerate(zip(b.first[:-1].tolist(), b.first[1:].tolist())):
        if hi == lo:
            yield b""
        elif not count[d]:
            yield b" ".join(data[b.starts[lo] : b.ends[hi - 1]].split())
        else:
            at = np.flatnonzero(keep[lo:hi]) + lo
            yield b" ".join([data[s:e] for s, e in zip(b.starts[at].tolist(), b.ends[at].tolist())])


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in every tenth document by crc32 the words from some place on repeat with one period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    n = w.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    p = n.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    laid = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return p.select("doc_id", F.when(F.col("n") > 0, laid).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(planted(common.table(spark, sf_dir, "documents")))
    longest = F.expr("array_sort(runs, (x, y) -> case when x.length <> y.length then if(x.length > y.length, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) else if(x.period < y.period, -1, 1) end)[0]")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return top.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {"op13_periods": op13_periods}
