"""N-gram Jaccard join by prefix trees.

1. Each document becomes the set of its hashed n-grams; equal sets are one class, whose smallest
   doc_id stands for it.
2. N-grams are ordered globally: common ones last (counted over all documents), then by hash. Sets
   of similarity t share one of the first n - ceil(t n) + 1, so only that prefix is posted.
3. Pairs that meet in small posting groups are kept if the n-grams that they share there can still
   add up to t; large groups are chained to one member. What is connected then is a family.
4. A family's sets meet in one task, or in blocks of bounded size when they are many: they are stored
   in a trie in the global order, and each set walks it, sharing the overlap of a common path and
   leaving a subtree once the words that remain can't reach t, or once it is linked already.

Pairs found this way link documents; the smallest doc_id reachable names the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, graph, words

#: n-grams in more documents than this are common; groups up to this size are paired.
COMMON = 32
#: The common n-grams that every task gets: 8 MB, the most frequent ones. Others just come earlier in the order.
MOST_COMMON = 1_000_000
#: n-grams of one block of a family.
BLOCK = 1_500_000
STEP = 16


def sets(column: pa.Array, k: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """By block of documents: the distinct n-grams of each in ascending order, and how many."""
    for b in words.blocks(column, words.SPACES, words.LOWER, seed=1):
        grams, count = words.ngrams(b.hashes, b.first, k)
        yield b.rows, *words.distinct(grams, count)


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """n - ceil(t n) + 1."""
    return np.where(n > 0, n - (n * num + den - 1) // den + 1, 0)


def _heads(values: np.ndarray, count: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `want` values of each row."""
    want = np.minimum(want, count)
    begin = np.cumsum(count) - count
    at = np.repeat(begin - (np.cumsum(want) - want), want) + np.arange(want.sum())
    return values[at], want


def common_grams(docs: DataFrame, k: int, num: int, den: int) -> np.ndarray:
    """n-grams that stand early in the sets of more than COMMON documents, ascending."""

    def run(batches):
        for batch in batches:
            parts = []
            for _, v, n in sets(batch.column(1), k):
                parts.append(_heads(v, n, prefix_size(n, num, den) + 16)[0])
            v, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int32))], names=["gram", "n"])

    counts = docs.mapInArrow(run, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    top = counts.orderBy(F.desc("n"), "gram").limit(MOST_COMMON).select("gram").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def fingerprint(v: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two halves of each set's name. v: the sets one after the other; n: their sizes."""
    # one zero more, so that empty sets at the end begin there and the last n-gram stays with its own set
    return [np.where(n > 0, np.add.reduceat(np.append(words.mix(v ^ words.U64(s)), words.U64(0)), np.cumsum(n) - n), 0).astype(np.uint64).view(np.int64) for s in (1, 2)]


def prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, key, n, two halves of the set's fingerprint, and the prefix in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(common_grams(docs, k, num, den))

    def run(batches):
        for batch in batches:
            for rows, v, n in sets(batch.column(1), k):
                doc = np.repeat(np.arange(len(n)), n)
                late = _member(v, shared.value)
                order = np.lexsort((v, late, doc))
                head, want = _heads(v[order], n, prefix_size(n, num, den))
                ids, keys = (batch.column(c).slice(rows.start, rows.stop - rows.start) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n.astype(np.int64)), *map(pa.array, fingerprint(v, n)), words.lists(head, want)], names=["doc_id", "key", "n", "h1", "h2", "grams"])

    return common.stage(docs.mapInArrow(run, "doc_id long, key long, n long, h1 long, h2 long, grams array<long>"), "prefixes")


def candidate_edges(posted: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect every two documents whose prefixes allow similarity t. posted: gram, rep, n."""
    size = posted.groupBy("gram").agg(F.count("*").alias("g"), F.min("rep").alias("lead")).where("g > 1")
    met = common.stage(posted.join(size, "gram"), "postings")
    large = met.where(F.col("g") > COMMON)
    chain = large.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    lost = large.groupBy("rep").agg(F.count("*").alias("lost"))
    small = met.where(F.col("g") <= COMMON)
    left, right = small.select("gram", F.col("rep").alias("a"), F.col("n").alias("na")), small.select("gram", F.col("rep").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    pairs = left.join(right, "gram").where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("s"))
    pairs = pairs.join(lost.withColumnRenamed("rep", "a").withColumnRenamed("lost", "la"), "a", "left").join(lost.withColumnRenamed("rep", "b").withColumnRenamed("lost", "lb"), "b", "left")
    # Of the shorter prefix, what is neither shared here nor hidden in a large group is missing from the other set
    # only if it stands before the other prefix's end; so the bound is taken for the document whose prefix is shorter in the order, unknown here: the weaker of both holds
    short = lambda n: n - F.ceil(n * num / den) + 1
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    hidden = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    found = F.col("s") + hidden
    able = F.greatest(found + F.col("na") - short(F.col("na")), found + F.col("nb") - short(F.col("nb"))) >= need
    return chain.unionByName(pairs.where(able).select("a", "b"))


class Trie:
    """Sets in the global order as paths of STEP-gram nodes, level by level."""

    def __init__(self, items: list[np.ndarray], rank: dict | None = None):
        self.size = np.array([len(s) for s in items])
        self.levels = -(-int(self.size.max()) // STEP)
        order = sorted(range(len(items)), key=lambda i: items[i].astype(">u8").tobytes())
        self.rows = np.array(order)
        self.sorted_size = self.size[order]
        flat = np.concatenate([items[i] for i in order])
        self.grams, self.flat = np.unique(flat, return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(self.sorted_size)])
        shared = np.zeros(len(order), np.int64)  # how far a path runs along the one before
        for i in range(1, len(order)):
            a, b = self.flat[self.begin[i - 1] : self.begin[i]], self.flat[self.begin[i] : self.begin[i + 1]]
            k = min(len(a), len(b))
            d = np.flatnonzero(a[:k] != b[:k])
            shared[i] = d[0] if len(d) else k
        self.shared = shared

    def walk(self, probe: np.ndarray, num: int, den: int, skip) -> np.ndarray:
        """Rows (as given) whose set is similar to the probe. skip(rows) marks those that need no answer."""
        at = np.searchsorted(self.grams, probe)
        at = np.minimum(at, len(self.grams) - 1)
        inside = np.zeros(len(self.grams) + 1, bool)
        inside[at[self.grams[at] == probe]] = True
        n = len(probe)
        live = np.flatnonzero((np.minimum(self.sorted_size, n) * den >= np.maximum(self.sorted_size, n) * num) & ~skip(self.rows))
        need = -(-(self.sorted_size + n) * num // (num + den))
        got = np.zeros(len(self.rows), np.int64)
        level = 0
        while len(live):
            lo = level * STEP
            deep = live[self.sorted_size[live] > lo]
            if not len(deep):
                break
            hi = np.minimum(self.sorted_size[deep], lo + STEP)
            # A path that runs along the live one before it through this level shares its partial overlap
            fresh = np.ones(len(deep), bool)
            fresh[1:] = ~((np.diff(deep) == 1) & (self.shared[deep[1:]] >= hi[1:]) & (hi[1:] == hi[:-1]))
            own = deep[fresh]
            cols = self.begin[own][:, None] + lo + np.arange(STEP)
            part = (inside[self.flat[np.minimum(cols, len(self.flat) - 1)]] & (np.arange(STEP) < (hi[fresh] - lo)[:, None])).sum(1)
            got[deep] += part[np.cumsum(fresh) - 1]
            rest = np.maximum(self.sorted_size[live] - lo - STEP, 0)
            live = live[got[live] + rest >= need[live]]
            level += 1
            if len(live) and (self.sorted_size[live] <= level * STEP).all():
                break
        live = live[got[live] >= need[live]]
        return self.rows[live]


class Union:
    """Union by smallest id within a task."""

    def __init__(self, ids: list[int]):
        self.up = {i: i for i in ids}

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def family_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all similar sets of one block (right is None) or between two blocks; not those that follow from others."""
    trie = Trie([s for _, s in left])
    ids = np.array([i for i, _ in left])
    union = Union(list({i for i, _ in left} | {i for i, _ in right or []}))
    root = ids.copy()
    out = []
    for i, s in left if right is None else right:
        me = union.find(i)
        for row in trie.walk(s, num, den, lambda rows: root[rows] == me).tolist():  # noqa: B023
            if union.join(i, int(ids[row])):
                out.append((i, int(ids[row])))
        now = union.find(i)
        if now != me or out and out[-1][0] == i:
            root = np.array([union.find(int(x)) for x in ids])
        if right is None and (root == root[0]).all():
            break
    return out


def family_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """members (rep, doc_id, h1, h2, family, blocks) with their sets as bytes, once for each pair of blocks that they meet in."""

    def run(batches):
        for batch in batches:
            for rows, v, n in sets(batch.column(1), k):
                part = batch.slice(rows.start, rows.stop - rows.start)
                # Of the texts of one doc_id, only those with the member's set are it
                same = np.logical_and(*(h == part.column(c).to_numpy() for h, c in zip(fingerprint(v, n), (5, 6))))
                offs = np.concatenate([[0], np.cumsum(n)])
                own = [v[offs[i] : offs[i + 1]].tobytes() for i in np.flatnonzero(same).tolist()]
                mask = pa.array(same)
                yield pa.RecordBatch.from_arrays([*(part.column(c).filter(mask) for c in (2, 3, 4)), pa.array(own, pa.binary())], names=["rep", "family", "blocks", "grams"])

    # Most documents have no family: let the optimizer filter the texts by a Bloom filter of the members before they are shuffled, at any size
    docs.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    docs.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1GB")
    texts = docs.join(members.where("blocks >= 1"), "doc_id").select("doc_id", "text", "rep", "family", "blocks", "h1", "h2")
    got = texts.mapInArrow(run, "rep long, family long, blocks int, grams binary")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return got.withColumn("own", own).withColumn("other", other).select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "grams")


def linked(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within families, by the trie walk of each block or pair of blocks."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        (_, i, j), own = rows[0][0], [(r, np.frombuffer(g, np.uint64)) for _, o, r, g in rows if o == rows[0][0][1]]
        own = [x for x in own if len(x[1])]
        if i == j:
            return family_links(own, None, num, den) if len(own) > 1 else []
        other = [(r, np.frombuffer(g, np.uint64)) for _, o, r, g in rows if o == j]
        return family_links(own, other, num, den) if own and other else []

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in range(6)]
            for family, i, j, own, rep, grams in zip(*cols):
                if held and held[0][0] != (family, i, j):
                    out += flush(held)
                    held = []
                if held and held[-1][2] == rep:  # a row that stands twice
                    continue
                held.append(((family, i, j), own, rep, grams))
            if out:
                yield _links(out)
        if held and (out := flush(held)):
            yield _links(out)

    keys = ["family", "i", "j"]
    return family_sets(docs, members, k).repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "a long, b long")


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b"])


def join(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and the key of its text, for Jaccard similarity num/den on k-word shingles.

    Words are runs of other than blanks, with A-Z in lower case. A text of fewer than k words has
    one shingle, its whole sequence. Null and empty texts have none and link with nothing. A row
    with a null doc_id links with nothing and has a null component. Each row is judged on its own, also
    where rows repeat a doc_id; a component has the smallest doc_id of its rows.
    """
    own = common.texts(docs).withColumn("key", common.text_key())
    table = prefixes(own, k, num, den)
    known = table.where("n > 0 and doc_id is not null")
    # A class is a set. Its smallest doc_id stands for it from here on, a hash where other texts have that id too; short ids keep what is moved small
    reps = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    shared = F.count("*").over(Window.partitionBy("least")) > 1
    reps = common.stage(reps.withColumn("rep", F.when(shared, F.xxhash64("h1", "h2")).otherwise(F.col("least"))), "classes")
    first = (known.h1 == reps.h1) & (known.h2 == reps.h2) & (known.doc_id == reps.least)
    # Read three times below: written once, the prefixes are shuffled once
    stand = common.stage(known.join(reps, first).select("rep", "least", reps.h1, reps.h2, "n", "grams").dropDuplicates(["rep"]), "sets")
    posted = stand.select("rep", "n", F.explode("grams").alias("gram"))
    families = graph.components(candidate_edges(posted, num, den)).withColumnRenamed("component", "family")
    sized = stand.select("rep", "least", "h1", "h2", "n").join(families, F.col("rep") == F.col("node")).select("rep", "least", "h1", "h2", "n", "family")
    blocks = sized.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK)).cast("int").alias("blocks"))
    members = common.stage(sized.join(blocks, "family").select("rep", F.col("least").alias("doc_id"), "h1", "h2", "family", "blocks"), "families")
    found = common.stage(graph.components(linked(own, members, k, num, den)), "links")
    lead = found.join(reps.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = found.join(lead, "component").select("node", "component_id")
    by_class = reps.join(named, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component_id", "least").alias("component_id"))
    out = table.join(by_class, ["h1", "h2"], "left")
    alone = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"), "key")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), 4, 85, 100).drop("key")


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Rows without a doc_id stay, as do null and empty texts. Of rows that repeat a doc_id, each is judged
    by its own text; those that belong to one group all stay.
    """
    drop = join(docs, 5, 8, 10).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone"), F.col("key").alias("_text")).distinct()
    return docs.join(drop, (docs["doc_id"] == drop["_gone"]) & (common.text_key(docs["text"]) == drop["_text"]), "left_anti")


QUERIES = {"op6_jaccard": op6_jaccard}
