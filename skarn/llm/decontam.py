"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a run of words: only the words under its ones are hashed, so two runs
that differ under a zero still meet. Windows of the benchmark and of the documents are hashed under
every mask and joined on the hash. Around each hit, the item is laid over the document at that place
and the agreeing words are counted, which tolerates substitutions anywhere in the overlap. The masks
are such that no overlap that counts can avoid them all.

A benchmark of up to BLOCK words goes to every task as a sorted index, so its seeds meet the
documents' where these are read, and nothing is shuffled. A larger one is joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Fixed masks. Of 13 words or more that agree in 0.8, four agree in a row, except where each fourth of 15 words is
#: substituted; that pattern and those of 10 and 11 words with two substitutions meet under the second mask.
MASKS = ("1111", "111011")
#: Items with fewer words are compared as one run; those with fewer than LEAST_RUN only with whole texts, as such few words stand in clean texts by chance.
LEAST_ITEM, LEAST_RUN = 10, 5
#: Words of a benchmark whose index is sent to every task; a larger one is joined on its seeds.
BLOCK = 200_000
#: Leading bits of a seed in the filter that thins the documents' seeds before that join, and the parts that a seed's documents are dealt into.
FILTER_BITS, SALTS = 24, 8
#: Hits that are expanded at once, and words that are laid out at once.
MOST_HITS = 1 << 18
MOST_LAID = 1 << 20
#: An overlap counts if it spans so many words, or this share of a shorter item, and so many of its words agree.
LEAST_WORDS, AGREE = 13, 0.8
SEPS = words.separators(bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~")
UID = "_skarn_uid"
SCHEMA = "doc_id long, item_id long, start long, length long, agree long, item_words long"


def blocks(column: pa.Array):
    return words.blocks(pc.utf8_lower(column), SEPS, seed=9)


def seeds(hashes: np.ndarray, mask: str, k: int) -> np.ndarray:
    """The hash under a mask of the window at each word; windows beyond the end are the caller's to drop."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    coef = words.keys(len(ones), 500 + k)
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for c, i in zip(coef, ones):
        total += hashes[i : i + n] * c
    return words.mix(total)


@dataclass
class Index:
    """Sorted seed hashes of a block of items, with the item and the place of each."""

    ids: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    keys: list[np.ndarray]
    items: list[np.ndarray]
    places: list[np.ndarray]
    filters: list[np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    lead: int

    def runs(self, k: int, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For windows with these hashes: the window, the item and the place in the item, for every match, in parts of bounded size."""
        maybe = np.flatnonzero(self.filters[k][(seen >> np.uint64(64 - self.lead)).astype(np.int64)])
        lo = np.searchsorted(self.keys[k], seen[maybe], "left")
        n = np.searchsorted(self.keys[k], seen[maybe], "right") - lo
        maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
        part = (np.cumsum(n) - n) // MOST_HITS
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(n)]]) if len(n) else [0]
        for a, z in zip(cuts[:-1], cuts[1:]):
            own = n[a:z]
            at = np.repeat(lo[a:z], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            yield np.repeat(maybe[a:z], own), self.items[k][at], self.places[k][at]


def index(ids: np.ndarray, texts: list[str | None]) -> Index:
    blocks_ = list(blocks(pa.array(texts, pa.string())))
    hashes = np.concatenate([b.hashes for b in blocks_]) if blocks_ else np.zeros(0, np.uint64)
    size = np.concatenate([np.diff(b.first) for b in blocks_]) if blocks_ else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    out = Index(list(ids), first, hashes, [], [], [], [], {}, 20 if len(hashes) > 4096 else 10)
    for k, mask in enumerate(MASKS):
        h = seeds(hashes, mask, k)
        item = np.repeat(np.arange(len(size)), size)[: len(h)]
        place = np.arange(len(h)) - first[item]
        keep = (place + len(mask) <= size[item]) & (size[item] >= LEAST_ITEM)
        h, item, place = h[keep], item[keep], place[keep]
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << out.lead, bool)
        bits[(h >> np.uint64(64 - out.lead)).astype(np.int64)] = True
        out.keys.append(h[order])
        out.items.append(item[order])
        out.places.append(place[order])
        out.filters.append(bits)
    for n in range(1, LEAST_ITEM):
        items = np.flatnonzero(size == n)
        if len(items):
            h = seeds(hashes, "1" * n, n)[first[items]]
            order = np.argsort(h, kind="stable")
            out.short[n] = h[order], items[order]
    return out


def overlap(a: np.ndarray, b: np.ndarray, agree: float) -> tuple[int, int, int]:
    """The longest run of two aligned word sequences that starts and ends in agreement and agrees in that share of its words: start, length, agreeing words."""
    same = a == b
    last = np.flatnonzero(same)
    if not len(last):
        return 0, 0, 0
    # with v(i) = agreeing words before i - agree * i, in whole numbers, the run i..j holds if v(j + 1) >= v(i)
    share = Fraction(agree).limit_denominator(10_000)
    count = np.concatenate([[0], np.cumsum(same)])
    v = share.denominator * count - share.numerator * np.arange(len(same) + 1)
    least = np.minimum.accumulate(np.where(same, v[:-1], np.iinfo(np.int64).max))
    # the first start whose v is low enough for each end; least falls, so it is found by bisection
    first = np.searchsorted(-least, -v[last + 1], "left")
    length = np.where(first <= last, last - first + 1, 0)
    k = int(length.argmax())
    i, n = int(first[k]), int(length[k])
    return (i, n, int(count[i + n] - count[i])) if n else (0, 0, 0)


def able(doc: np.ndarray, item: np.ndarray, at: np.ndarray, own: np.ndarray, size: np.ndarray, need: np.ndarray, agree: float) -> np.ndarray:
    """Which layings of size item words from own over document words from at hold a run of need words or more that counts (see overlap)."""
    share = Fraction(agree).limit_denominator(10_000)
    out = np.zeros(len(at), bool)
    part = (np.cumsum(size) - size) // MOST_LAID
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        n = size[rows]
        begin = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - begin[of]
        same = doc[at[rows][of] + inner] == item[own[rows][of] + inner]
        # before and after a word: agreeing words less the share of all, lower by a step for each laying, so that a running least never reaches back
        step = 2 * share.denominator * (int(n.max(initial=0)) + 2)
        after = np.cumsum(share.denominator * same - share.numerator) - of * step
        before = after - share.denominator * same + share.numerator
        least = np.minimum.accumulate(np.where(same, before, before + step // 2))
        first = inner - need[rows][of] + 1
        j = np.flatnonzero(same & (first >= 0))
        good = j[after[j] >= least[begin[of[j]] + first[j]]]
        out[rows[of[good]]] = True
    return out


def find(batch_ids, column: pa.Array, ix: Index, least: int, agree: float) -> list[tuple]:
    """The best overlap of each document and item that qualifies."""
    best: dict[tuple, tuple] = {}
    sizes = np.diff(ix.first)
    need = np.minimum(least, np.maximum(1, np.ceil(agree * sizes - 1e-9).astype(np.int64)))
    for block in blocks(column):
        doc = block.doc
        span = len(block.hashes) + int(sizes.max(initial=0)) + 1
        for k, mask in enumerate(MASKS):
            h = seeds(block.hashes, mask, k)
            if not len(h) or not len(ix.keys[k]):
                continue
            for w, item, place in ix.runs(k, h):
                inside = doc[w] == doc[w + len(mask) - 1]
                lay = np.unique(((doc[w] * len(sizes) + item) * span + (w - place + span - len(block.hashes)))[inside])
                pair, at = lay // span, lay % span - (span - len(block.hashes))
                d, i = pair // len(sizes), pair % len(sizes)
                a, z = np.maximum(at, block.first[d]), np.minimum(at + sizes[i], block.first[d + 1])
                good = able(block.hashes, ix.hashes, a, ix.first[i] + a - at, z - a, need[i], agree)
                for d, i, at, a, z in np.column_stack([d, i, at, a, z])[good].tolist():
                    if best.get((block.rows.start + d, i), (0, 0, 0))[1] >= z - a:
                        continue
                    s, n, same = overlap(block.hashes[a:z], ix.hashes[ix.first[i] + a - at : ix.first[i] + z - at], agree)
                    if n >= need[i] and n > best.get((block.rows.start + d, i), (0, 0, 0))[1]:
                        best[block.rows.start + d, i] = (a - int(block.first[d]) + s, n, same)
        for n, (keys, items) in ix.short.items():  # an item too short for a mask has to stand in full
            h = seeds(block.hashes, "1" * n, n)
            if not len(h):
                continue
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for w in np.flatnonzero(hi > lo).tolist():
                d = int(doc[w])
                if w + n > block.first[d + 1] or (n < LEAST_RUN and block.first[d + 1] - block.first[d] != n):
                    continue
                for i in items[lo[w] : hi[w]].tolist():
                    if (block.hashes[w : w + n] == ix.hashes[ix.first[i] : ix.first[i + 1]]).all():
                        best.setdefault((block.rows.start + d, i), (w - int(block.first[d]), n, n))
    return [(batch_ids[d], ix.ids[i], s, n, same, int(sizes[i])) for (d, i), (s, n, same) in best.items()]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id (may be null) and text of the items that have a text."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def small_index(items: DataFrame, block: int = BLOCK):
    """A broadcast index of all items, if their bytes show that they hold no more than `block` words; otherwise None."""
    total = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (total[0] or 0) > 6 * block or total[1] > block:
        return None
    own = items.orderBy("item_id", "text").toArrow()
    return items.sparkSession.sparkContext.broadcast(index(own.column("item_id").to_pylist(), own.column("text").to_pylist()))


def _found(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in schema.split(", ")])


def seed_pairs(numbered: DataFrame, items: DataFrame) -> DataFrame:
    """uid, item: documents and items that share a seed, by a join of their hashes. numbered: uid, text; items: item, text.

    A filter of fixed size, laid over the items' seeds by an aggregate, keeps most of the documents' seeds out of the shuffle.
    """

    def emit(key: str, shared=None):
        def run(batches):
            for batch in batches:
                ids, hs = [], []
                for block in blocks(batch.column(1)):
                    doc, size = block.doc, np.diff(block.first)
                    for k, mask in [*enumerate(MASKS), *((n, "1" * n) for n in range(1, LEAST_ITEM))]:
                        h = words.mix(seeds(block.hashes, mask, k) ^ words.U64(len(mask)))
                        w = np.flatnonzero(doc[: len(h)] == doc[len(mask) - 1 : len(mask) - 1 + len(h)])
                        n = size[doc[w]]
                        if key == "item":  # a short item gives one seed, itself
                            w = w[(n >= LEAST_ITEM) if mask in MASKS else (n == len(mask))]
                        elif mask not in MASKS and len(mask) < LEAST_RUN:
                            w = w[n == len(mask)]
                        if shared is not None:
                            w = w[shared.value[(h[w] >> words.U64(64 - FILTER_BITS)).astype(np.int64)]]
                        pairs = np.unique(np.column_stack([doc[w].astype(np.uint64), h[w]]), axis=0)
                        ids.append(pairs[:, 0].astype(np.int64) + block.rows.start)
                        hs.append(pairs[:, 1])
                own = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(h.view(np.int64))], names=[key, "seed"])

        return run

    item_seeds = common.stage(items.select("item", "text").mapInArrow(emit("item"), "item long, seed long").distinct(), "seeds")
    cell = F.shiftrightunsigned("seed", 64 - FILTER_BITS) + 1
    maps = item_seeds.groupBy(F.bitmap_bucket_number(cell).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("m")).collect()  # 2^FILTER_BITS bits at most
    bits = np.zeros(1 << FILTER_BITS, bool)
    for r in maps:
        own = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little").astype(bool)
        bits[(r["k"] - 1) * len(own) : r["k"] * len(own)] = own
    shared = items.sparkSession.sparkContext.broadcast(bits)
    doc_seeds = numbered.select("uid", "text").mapInArrow(emit("uid", shared), "uid long, seed long")
    # Both sides are spread by a salt, so a seed that many documents have is no single task's
    salted = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return doc_seeds.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"]).select("uid", "item").distinct()


def joined(docs: DataFrame, benchmark: DataFrame, least: int, agree: float) -> tuple[DataFrame, DataFrame]:
    """For a benchmark of any size: docs numbered by uid (staged), and uid with the rest of SCHEMA of their overlaps.

    Each pair that shares a seed is then judged by its two texts, in groups of pairs of one document.
    """
    numbered = common.stage(docs.withColumn(UID, F.monotonically_increasing_id()), "numbered")
    items = common.stage(benchmark_items(benchmark).select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    texts = numbered.select(F.col(UID).alias("uid"), F.col("text").cast("string").alias("text"))
    pairs = common.stage(seed_pairs(texts, items), "pairs")
    both = pairs.join(texts, "uid").join(items.withColumnRenamed("text", "item_text"), "item").select("uid", "item_id", "text", "item_text")
    schema = SCHEMA.replace("doc_id", "uid")

    def run(batches):
        for batch in batches:
            rows = []
            ids, names, texts_, items_ = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                ix = index([names[i].as_py()], [items_[i].as_py()])
                rows += find([ids[i].as_py()], texts_.slice(i, 1), ix, least, agree)
            if rows:
                yield _found(rows, schema)

    return numbered, both.mapInArrow(run, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, agree: float = AGREE, block: int = BLOCK) -> DataFrame:
    """Each document and benchmark item that overlap: where, over how many words, and how many agree.

    Words are runs between blanks and ASCII punctuation, in lower case. Null and empty texts and
    items overlap with nothing. Repeated doc_ids each give their rows, repeated items too; a null
    doc_id or item_id stays null. Items of fewer than LEAST_ITEM words have to stand in full, those
    of fewer than LEAST_RUN have to be the whole text. A benchmark of up to `block` words is held
    against the documents where they are read; a larger one is joined on its seeds.
    """
    shared = small_index(benchmark_items(benchmark), block)
    own = common.texts(docs)
    if shared is None:
        numbered, found = joined(own, benchmark, least, agree)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return found.join(numbered.select(F.col(UID).alias("uid"), "doc_id"), "uid").select(*names)

    def run(batches):
        for batch in batches:
            rows = find(batch.column(0).to_pylist(), batch.column(1), shared.value, least, agree)
            if rows:
                yield _found(rows, SCHEMA)

    return own.mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, agree: float = AGREE, block: int = BLOCK) -> DataFrame:
    """The rows of docs that overlap with no item, with all their columns; see overlaps."""
    common.small_batches(docs.sparkSession)
    shared = small_index(benchmark_items(benchmark), block)
    if shared is None:
        numbered, found = joined(docs, benchmark, least, agree)
        return numbered.join(found.select(F.col("uid").alias(UID)).distinct(), UID, "left_anti").select(*docs.columns)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            bad = {r[0] for r in find(range(batch.num_rows), batch.column(at), shared.value, least, agree)}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; each row is judged by its own text."""
    return clean(docs, common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
