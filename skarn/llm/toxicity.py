"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon has a fixed part (common English insults) and a part learned from the labelled rows:
words, and beginnings of words, that stand far more often in toxic documents. Copies of one
document are one witness, so a family of copies can't teach its rare words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, features, words
from .quality import labelled
from .trees import Boosted, Isotonic, boost, isotonic

#: At most so many labelled rows are fitted, those of the smallest hashes.
FIT_ROWS = 20_000
#: Entries of the learned lexicon, and the evidence (twice the log likelihood ratio) that one needs.
LEXICON, EVIDENCE = 4_000, 20.0
HEAD = 5
THRESHOLD = 0.7
#: Parts of the labelled families that are left out in turn for the calibration.
FOLDS = 3
#: Insults, and words that address a person.
INSULTS = b"idiot idiots moron morons stupid dumb trash scum loser losers worthless pathetic disgusting clown imbecile filthy vermin garbage".split()
PERSON = b"you your yours yourself youre du dich dir dein deine ihr euch euer tu te ti tus vous votre vos ton tes usted ustedes vosotros".split()
#: Digits and signs that stand for letters.
LEET = {b"0": b"o", b"1": b"i", b"3": b"e", b"4": b"a", b"5": b"s", b"7": b"t", b"@": b"a", b"$": b"s"}

PUNCTUATION = words.separators(bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~")
LETTER = np.arange(256, dtype=np.uint8)
for _a, _b in LEET.items():
    LETTER[_a[0]] = _b[0]
#: Signs dropped inside a word before its letters are compared.
DROPPED = np.zeros(256, bool)
DROPPED[list(b".-_*'~^")] = True
NAMES = ("insults", "learned", "heads", "learned_n", "heads_n", "hidden", "near_person", "person", "upper", "upper_words", "shout", "stop", "symbol", "digit", "mixed", "stretched", "log_words", "mean_len")


def plain(column: pa.Array, upto: int | None = None):
    """Blocks of lower-case words parted at blanks and punctuation."""
    return words.blocks(column, PUNCTUATION, words.lower_latin, upto=upto, seed=5)


def hashes_of(terms: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([b.hashes for b in plain(pa.array([t.decode() for t in terms]))]))


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


@dataclass
class Lexicon:
    """Sorted hashes of learned words and of learned beginnings of words."""

    whole: np.ndarray
    heads: np.ndarray


def _unhidden(column: pa.Array) -> pa.Array:
    """The texts without the signs that part a word's letters."""
    data, offs = words.buffer(column)
    inner = DROPPED[data]
    keep = np.concatenate([[0], np.cumsum(~inner)])
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(keep[offs].astype(np.int64)), pa.py_buffer(data[~inner].tobytes())])


def statistics(column: pa.Array, lexicons: list[Lexicon]) -> list[np.ndarray]:
    """Dense features of each text, once for each lexicon; null counts as empty."""
    insults, person = hashes_of(INSULTS), hashes_of(PERSON)
    known = [np.unique(np.concatenate([insults, x.whole])) for x in lexicons]
    out: list[list[np.ndarray]] = [[] for _ in lexicons]
    for block, head in zip(plain(column), plain(column, HEAD)):
        part = column.slice(block.rows.start, block.rows.stop - block.rows.start)
        _, offs = words.buffer(part)
        c = features.by_doc(block, offs)
        r = features.ratios(c)
        n = np.diff(block.first).astype(float)
        low = np.maximum(n, 1)
        insult, you, doc = member(block.hashes, insults), member(block.hashes, person), block.doc
        beside = np.zeros(len(you), bool)  # within five words of one that addresses a person
        for k in range(1, 6):
            same_doc = doc[k:] == doc[:-k]
            beside[k:] |= you[:-k] & same_doc
            beside[:-k] |= you[k:] & same_doc
        opened = [np.zeros(len(n)) for _ in lexicons]
        for other in words.blocks(_unhidden(part), words.SPACES, lambda buf: LETTER[words.lower_latin(buf)], seed=5):
            for x, table in zip(opened, known):
                x[other.rows] = features.sums(other, member(other.hashes, table))
        kind = features.CLASS[block.buf]
        inside = np.concatenate([[0], np.cumsum(kind == 3)])
        letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
        capital = np.concatenate([[0], np.cumsum(kind == 2)])
        size = block.ends - block.starts
        digits, alpha, caps = (x[block.ends] - x[block.starts] for x in (inside, letters, capital))
        three = np.zeros(len(block.buf) + 1)
        if len(block.buf) > 2:
            same = (block.buf[2:] == block.buf[1:-1]) & (block.buf[1:-1] == block.buf[:-2])
            three[3:] = np.cumsum(same)
        fixed = [
            features.sums(block, you) / low, r[:, 2], features.sums(block, (caps == size) & (size > 1)) / low, r[:, 7], r[:, 6], r[:, 8], r[:, 3],
            features.sums(block, (digits > 0) & (alpha > 0) & (digits < alpha)) / low, features.sums(block, three[block.ends] > three[block.starts + np.minimum(2, size)]) / low,
            np.log1p(n), features.sums(block, size) / low,
        ]
        for x, lexicon, seen in zip(out, lexicons, opened):
            bad = insult | member(block.hashes, lexicon.whole)
            hits, heads = features.sums(block, bad), features.sums(head, member(head.hashes, lexicon.heads))
            own = [features.sums(block, insult) / low, hits / low, heads / low, np.log1p(hits), np.log1p(heads), np.maximum(0, seen - hits) / low, features.sums(block, bad & beside) / low]
            x.append(np.column_stack(own + fixed))
    return [np.vstack(x) if x else np.zeros((0, len(NAMES))) for x in out]


def family_of(whole: words.Block) -> np.ndarray:
    """The smallest hash of two words in a row of each document: copies mostly share it."""
    pairs, count = words.ngrams(whole.hashes, whole.first, 2)
    out = np.full(len(whole.first) - 1, np.iinfo(np.int64).max, np.int64)
    np.minimum.at(out, np.repeat(np.arange(len(out)), count), pairs.view(np.int64))
    return out


def learn_lexicons(own: DataFrame, most: int = LEXICON, evidence: float = EVIDENCE) -> list[Lexicon]:
    """Words and beginnings of words with strong evidence of toxicity in a bounded labelled sample (doc_id, text, y).

    The first lexicon is learned from all families of copies, lexicon k + 1 from those outside fold k.
    """

    def run(batches):
        for batch in batches:
            column, toxic = batch.column(1), batch.column(2).to_numpy()
            for whole, head in zip(plain(column), plain(column, HEAD)):
                y, family = toxic[whole.rows], family_of(whole)
                for kind, block in ((0, whole), (1, head)):
                    v, k = words.distinct(block.hashes, np.diff(block.first))
                    doc = np.repeat(np.arange(len(y)), k)
                    cols = [pa.array(np.full(len(v), kind, np.int32)), pa.array(v.view(np.int64)), pa.array(family[doc]), pa.array(y[doc].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["kind", "word", "family", "y"])

    share = own.agg(F.avg("y")).first()[0]
    if not share or share >= 1:
        return [Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * (FOLDS + 1)
    seen = own.mapInArrow(run, "kind int, word long, family long, y int").groupBy("kind", "word", "family").agg(F.max("y").alias("y"))
    fold = F.pmod("family", F.lit(FOLDS))
    parts = [F.sum(F.when((fold == k) & (F.col("y") == v), 1.0).otherwise(0.0)).alias(f"{n}{k}") for k in range(FOLDS) for v, n in ((1, "a"), (0, "b"))]
    counts = common.stage(seen.groupBy("kind", "word").agg(*parts, F.count("*").alias("n")).where("n >= 4"), "words")
    out = []
    for left_out in (None, *range(FOLDS)):
        a, b = (sum((F.col(f"{n}{k}") for k in range(FOLDS) if k != left_out), F.lit(0.0)) for n in "ab")
        n, p, q = a + b, F.lit(float(share)), a / F.greatest(a + b, F.lit(1.0))
        safe = lambda x: F.when(x > 0, x).otherwise(1.0)
        g2 = 2 * (a * F.log(safe(q) / p) + b * F.log(safe(1 - q) / (1 - p)))
        kept = counts.where((n >= 4) & (q >= 0.9)).withColumn("g2", g2).where(F.col("g2") >= evidence)
        rows = kept.orderBy(F.desc("g2"), "kind", "word").limit(most).select("kind", "word").collect()
        pick = lambda kind: np.sort(np.array([r.word for r in rows if r.kind == kind], np.int64).view(np.uint64))  # noqa: B023, E731
        out.append(Lexicon(pick(0), pick(1)))
    return out


@dataclass
class Toxicity:
    trees: Boosted
    curve: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.curve(self.trees.margin(x)), 0, 1)


def fit(x: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Toxicity | float:
    """Trees on all rows; the calibration curve from margins of rows that neither the trees nor the lexicon have seen.

    x[0]: statistics by the lexicon of all rows; x[k + 1]: by the lexicon learned outside fold k.
    """
    if len(y) < 8 or min((y == 0).sum(), (y == 1).sum()) < 3:
        return float(y.mean()) if len(y) else 0.0
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            margin[fold == k] = boost(x[k + 1][fold != k], y[fold != k]).margin(x[k + 1][fold == k])
    return Toxicity(boost(x[0], y), isotonic(margin, y))


def trained(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """The lexicon and the calibrated trees, both from the bounded labelled sample alone (of repeated ids the smallest text)."""
    sample = labelled(labels, "toxic", rows)
    # Of rows that repeat a labelled id, one text teaches, so the sample stays bounded
    own = common.texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    own = common.stage(own, "labelled")
    lexicons = learn_lexicons(own)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            fold = np.concatenate([np.zeros(0, np.int64), *(family_of(b) % FOLDS for b in plain(column))])
            x = [v.astype(np.float32) for v in statistics(column, lexicons)]
            cols = [words.lists(v.ravel(), np.full(len(v), len(NAMES)), pa.float32()) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fold), *cols], names=["doc_id", "y", "fold", *(f"x{k}" for k in range(FOLDS + 1))])

    schema = "doc_id long, y int, fold long, " + ", ".join(f"x{k} array<float>" for k in range(FOLDS + 1))
    got = own.mapInArrow(run, schema).toArrow()
    got = got.take(np.lexsort((got.column("fold").to_numpy(), got.column("doc_id").to_numpy())))  # at most `rows` labelled ids
    x = [np.array(got.column(f"x{k}").to_pylist(), dtype=float).reshape(got.num_rows, len(NAMES)) for k in range(FOLDS + 1)]
    return lexicons[0], fit(x, got.column("y").to_numpy().astype(float), got.column("fold").to_numpy())


def scores(column: pa.Array, lexicon: Lexicon, model: Toxicity | float) -> np.ndarray:
    return np.full(len(column), model) if isinstance(model, float) else model.score(statistics(column, [lexicon])[0])


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every text for toxicity: doc_id, held_out, score, predicted.

    Null and empty texts are scored as empty. Repeated doc_ids each give a row; a null doc_id gives
    null for held_out. Without labels of both classes the score is the labels' mean (0 if none).
    """
    lexicon, model = trained(docs, labels, rows)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), lexicon, model), pa.float64())], names=["doc_id", "score"])

    out = common.texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; no join is needed."""
    lexicon, model = trained(docs, labels, rows)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), lexicon, model) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those predicted toxic; each row is judged by its own text, whatever its doc_id."""
    return reject(docs, common.table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
