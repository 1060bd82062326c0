"""Spelling variants by dense prefix-suffix tiling.

1. Words and their numbers of occurrences are counted over all texts.
2. A word is cut into three segments. Two words of one edit agree outside of one segment of the shorter
   one, so a word goes to the groups of what remains without its first, second or last segment, for its
   own length and for the length below as that of the shorter word. Only words of one group meet.
3. A group of more than TILE words is dealt into blocks by hash, and each pair of blocks is a tile of
   its own; a task holds the tiles of some thousand words, whatever the size of the group.
4. Within a tile, words stand as padded matrices of code points, from the left and from the right.
   Pairs of rows are compared column by column; if the common prefix and the common suffix together
   have the longer word's length less one or more, the pair is one edit apart. A pair counts in the
   segment of its first difference alone, hence once.
5. Each task gives for each word how many near words it saw and the best of them; Spark adds these up.
   Roots follow by pointer doubling: each link makes the count tenfold, so chains have few links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
LEAST, TWICE, RATIO = 7, 2, 10
#: Words of a block, rows of a chunk that are compared at once, cells of a chunk's matrix, pairs of one comparison.
TILE, ROWS, CELLS, PAIRS = 512, 1 << 15, 1 << 22, 1 << 19


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by sorted parts on both sides: Spark would size packed words, and what is exploded from them, by the bytes of their files and broadcast them."""
    return left.join(right.hint("merge"), on, how)


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and run: each maximal run of letters of at least so many code points, with A-Z in lower case. Null texts have none."""
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    return found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(runs: DataFrame) -> DataFrame:
    """word: of every 31st run by crc32 of document and run, one code point is taken out. Runs of a null doc_id stay as they are."""
    h = F.coalesce(F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")), F.lit(1))
    cut = runs.select("run", h.alias("h")).withColumn("k", F.expr("cast(h % length(run) as int)"))
    return cut.select(F.expr("if(h % 31 = 0, concat(substring(run, 1, k), substring(run, k + 2)), run)").alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """word and n of the words that have so many code points and occurrences."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def keyed(vocab: DataFrame, least: int) -> DataFrame:
    """key, part (length of the shorter word and which segment is left out), word, n: the groups of each word."""
    parts = F.expr(f"""
        flatten(transform(sequence(greatest(size - 1, {least}), size), m -> transform(sequence(0, 2), j -> struct(3 * m + j as part,
            xxhash64(m, j, substring(word, 1, int(j * m div 3)), substring(word, int(size - m + (j + 1) * m div 3 + 1))) as key))))""")
    rows = vocab.select("word", "n", F.length("word").alias("size")).select("word", "n", F.explode(parts).alias("g"))
    return rows.select("g.key", "g.part", "word", "n")


def tiles(vocab: DataFrame, least: int, tile: int) -> DataFrame:
    """key, i, j, side (whether the row is of block j, not i), part, word, n: rows of groups of two words or more, for each tile that they stand in."""
    rows = keyed(vocab, least)
    blocks = rows.groupBy("key").agg(F.count("*").alias("g")).where("g > 1").select("key", F.ceil(F.col("g") / tile).cast("int").alias("blocks"))
    met = merged(rows, blocks, "key").withColumn("own", F.expr("cast(pmod(xxhash64(word, 3), blocks) as int)"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "part", "word", "n")


def one_edit(left: np.ndarray, right: np.ndarray, fore: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows are one edit apart, and their common prefixes. fore and back: code points by column, from the left and from the right, padded with zeros."""
    common_ends = []
    for codes in (fore, back):
        alive = np.arange(len(left))
        got = np.zeros(len(left), np.int32)
        for column in codes:
            alive = alive[column[left[alive]] == column[right[alive]]]
            if not len(alive):
                break
            got[alive] += 1
        common_ends.append(got)
    longer, shorter = np.maximum(size[left], size[right]), np.minimum(size[left], size[right])
    prefix, suffix = common_ends
    return (prefix + suffix >= longer - 1) & (longer - shorter <= 1), np.minimum(prefix, shorter)


class Chunk:
    """Rows of whole tiles."""

    def __init__(self, tile: np.ndarray, cross: np.ndarray, side: np.ndarray, part: np.ndarray, word: list[str], n: np.ndarray):
        self.tile, self.cross, self.side, self.part, self.n = tile, cross, side, part, n
        self.word = np.array(word)
        self.size = np.array([len(w) for w in word], np.int64)
        width = self.word.dtype.itemsize // 4
        codes = self.word.view(np.uint32).reshape(len(word), width)
        at = self.size[:, None] - 1 - np.arange(width)
        self.fore = np.ascontiguousarray(codes.T)
        self.back = np.ascontiguousarray(np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), 1), 0).T)

    def pairs(self):
        """Near pairs of rows, some at a time."""
        n = len(self.tile)
        head = np.flatnonzero(np.append(True, self.tile[1:] != self.tile[:-1]))
        count = np.repeat(np.append(head[1:], n), np.diff(np.append(head, n))) - np.arange(n) - 1
        total = np.cumsum(count)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
            some = count[lo:hi]
            left = np.repeat(np.arange(lo, hi), some)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some)
            m = self.part[left] // 3
            use = (self.part[left] == self.part[right]) & (self.size[left] + self.size[right] <= 2 * m + 1) & ~(self.cross[left] & (self.side[left] == self.side[right]))
            left, right, m = left[use], right[use], m[use]
            near, prefix = one_edit(left, right, self.fore, self.back, self.size)
            at = np.minimum(prefix, m - 1)
            near &= (at >= m // 3).astype(np.int64) + (at >= 2 * m // 3) == self.part[left] % 3
            yield left[near], right[near]
            lo = hi

    def best(self) -> pa.RecordBatch | None:
        """Of each word with near ones in its tile: their number, the largest n and the first word that has it."""
        found = list(self.pairs())
        a, b = (np.concatenate(x) for x in zip(*found))
        if not len(a):
            return None
        row, near = np.concatenate([a, b]), np.concatenate([b, a])
        some = np.unique(row)
        rank = np.zeros(len(self.tile), np.int64)
        rank[some] = np.unique(self.word[some], return_inverse=True)[1]
        order = np.lexsort((rank[near], -self.n[near], row))
        row, near = row[order], near[order]
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        cols = [self.word[row[at]], np.diff(np.append(at, len(row))), self.n[near[at]], self.word[near[at]]]
        return pa.RecordBatch.from_arrays([pa.array(c.tolist(), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "c", "form_n", "form"])


def near_words(vocab: DataFrame, least: int = LEAST, tile: int = TILE) -> DataFrame:
    """word, n_near, form_n and form (the near word of largest n; of equal n the smallest) of the words with near ones. vocab: distinct words of `least` code points or more, and n."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(last: bool = False):
            nonlocal held
            t = pa.Table.from_batches(held)
            key, i, j = (t.column(c).to_numpy() for c in range(3))
            new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            end = len(key) if last else int(np.flatnonzero(new)[-1])  # the last tile may go on in the next batch
            held = t.slice(end).to_batches()
            if end:
                side, part, word, n = (t.column(c).slice(0, end) for c in range(3, 7))
                return Chunk(np.cumsum(new[:end]), i[:end] != j[:end], side.to_numpy(), part.to_numpy().astype(np.int64), word.to_pylist(), n.to_numpy()).best()
            return None

        for batch in batches:
            wide = np.maximum.accumulate(pc.utf8_length(batch.column(5)).to_numpy())  # words come by length
            at = 0
            while at < len(batch):
                room = np.arange(1, min(ROWS, len(batch) - at) + 1)
                some = max(1, int((room * wide[at : at + len(room)] <= CELLS).sum()))
                held.append(batch.slice(at, some))
                at += some
                rows = sum(map(len, held))
                if (rows >= ROWS or rows * wide[at - 1] >= CELLS) and (out := flush()) is not None:
                    yield out
        if held and (out := flush(True)) is not None:
            yield out

    dealt = tiles(vocab, least, tile).repartition("key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    found = dealt.mapInArrow(run, "word string, c long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """word and root: the end of the chain of forms from each word that has one. links: word, form; each link multiplies n, which is at most `most`, by ratio or more."""
    chain = max(1, math.floor(math.log(max(most, 1), ratio)) + 1)
    at = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(chain))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = common.stage(merged(at, on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def group(vocab: DataFrame, least: int = LEAST, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of vocab (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near
    word of largest n, of equal n the first in code-point order, if that n is `ratio` times its own or
    more; else null, as is form_n. root: the end of the chain of forms, the word itself if it has none.
    vocab has each word once (vocabulary() sees to it); shorter words than `least` must not stand in it.
    Words may be of any length: a task's matrices are as wide as its longest word.
    """
    common.small_batches(vocab.sparkSession)
    vocab = common.stage(vocab.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = near_words(vocab, least, tile)
    fits = F.col("form_n") >= ratio * F.col("n")
    full = merged(vocab, near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    full = common.stage(full, "forms")
    most = vocab.agg(F.max("n")).first()[0] or 1
    ends = roots(full.where("form is not null").select("word", "form"), most, ratio)
    return merged(full, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(vocabulary(misspelt(runs(common.table(spark, sf_dir, "documents")))))


QUERIES = {"op11_variants": op11_variants}

ORACLE_SQL = {
    "op11_variants": r"""
WITH RECURSIVE r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) x(i)),
b AS (SELECT doc_id, run, c, t, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::bigint] ELSE [195::bigint, unicode(x)::bigint - 64] END)) AS bytes FROM r, crc),
h AS (SELECT run, c, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda s, y: xor(s // 256, t[xor(s % 256, y) + 1])), 4294967295) END AS h FROM b),
w AS (SELECT word, sum(c)::bigint AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word, x.n, y.word AS near, y.n AS m FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT w.word, w.n, d.word, d.n FROM w JOIN d ON w.word = d.rest UNION SELECT d.word, d.n, w.word, w.n FROM w JOIN d ON w.word = d.rest),
g AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS form, max(m) AS form_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN g USING (word)),
e AS (SELECT word, form AS root, 1 AS k FROM f WHERE form IS NOT NULL UNION ALL SELECT e.word, f.form, k + 1 FROM e JOIN f ON f.word = e.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN (SELECT word, arg_max(root, k) AS root FROM e GROUP BY word) l USING (word)""",
}
