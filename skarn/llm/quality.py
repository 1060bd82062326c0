"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, features, words

#: At most so many labelled rows are fitted, those of the smallest hashes.
FIT_ROWS = 20_000
SHRINK = (0.02, 0.1, 0.3, 0.6)
NAMES = ("log_bytes", "log_words", "mean_len", "sd_len", "distinct", "top_share", "same_next", "capital", "symbol_end", "shout_end", "stop_end", "bar", "upper", "digit", "line", "shout", "symbol", "other", "bracket", "high")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; null counts as empty."""
    out = []
    for block in words.blocks(column):
        offs = _offsets(column, block)
        c = features.by_doc(block, offs)
        r = features.ratios(c)
        w = features.word_stats(block)
        root = lambda x: np.sqrt(np.clip(x, 0, None))
        out.append(np.column_stack([
            np.log1p(c.sum(1)), np.log1p(w["n"]), np.log1p(w["mean_len"]), np.log1p(w["sd_len"]), w["distinct"], root(w["top_share"]), root(w["same_next"]),
            root(w["capital"]), root(w["symbol_end"]), root(w["shout_end"]), root(w["stop_end"]), root(w["bar"]),
            root(r[:, 2]), root(r[:, 3]), root(r[:, 5]), root(r[:, 7]), root(r[:, 8]), root(r[:, 0]), root(r[:, 12]), root(r[:, 10]),
        ]))
    return np.vstack(out) if out else np.zeros((0, len(NAMES)))


def _offsets(column: pa.Array, block: words.Block) -> np.ndarray:
    _, offs = words.buffer(column.slice(block.rows.start, block.rows.stop - block.rows.start))
    return offs


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors of the shrunken covariances and log priors, all fixed at the fit."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdet: list[float]
    prior: list[float]
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 over class 0, with priors."""
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        part = []
        for m, low, det, p in zip(self.means, self.factors, self.logdet, self.prior):
            y = low @ (z - m).T
            part.append(p - 0.5 * (y * y).sum(0) - det)
        return part[1] - part[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -35, 35)))


def _fit(x: np.ndarray, y: np.ndarray, shrink: float) -> Discriminant:
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / scale, -12, 12)
    d = z.shape[1]
    pooled = np.cov(z.T) + 1e-6 * np.eye(d)
    out = Discriminant(centre, scale, [], [], [], [])
    for k in (0, 1):
        own = z[y == k]
        cov = np.cov(own.T) if len(own) > 1 else pooled
        cov = (1 - shrink) * cov + shrink * (0.5 * np.diag(np.diag(cov)) + 0.5 * np.trace(cov) / d * np.eye(d)) + 1e-3 * np.eye(d)
        low = np.linalg.cholesky(cov)
        out.means.append(own.mean(0))
        out.factors.append(np.linalg.inv(low))
        out.logdet.append(float(np.log(np.diag(low)).sum()))
        out.prior.append(float(np.log(len(own) / len(z))))
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | float:
    """The shrinkage with the best cross-fitted log loss after a fitted slope and shift; one class alone gives its share."""
    if len(y) < 8 or min((y == 0).sum(), (y == 1).sum()) < 3:
        return float(y.mean()) if len(y) else 0.5
    part = np.arange(len(y)) % 3
    best = None
    for shrink in SHRINK:
        margin = np.zeros(len(y))
        for k in range(3):
            if len(set(y[part != k])) < 2 or not (part == k).any():
                continue
            margin[part == k] = _fit(x[part != k], y[part != k], shrink).margin(x[part == k])
        a, b, loss = _logistic(np.clip(margin, -60, 60), y)
        if best is None or loss < best[0]:
            best = (loss, shrink, a, b)
    out = _fit(x, y, best[1])
    out.slope, out.shift = best[2], best[3]
    return out


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and log loss of labels on a margin, by Newton steps with a weak pull to slope 1."""
    w = np.array([1.0, 0.0])
    x = np.column_stack([m, np.ones_like(m)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) + 1e-2 * (w - [1, 0])
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        w[0] = max(w[0], 1e-3)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -35, 35))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def labelled(labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """Up to `rows` labelled rows outside the held-out fold: a bounded table that may be broadcast.

    Rows with a null id or label are left out; of repeated ids the largest label counts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    own = own.where(common.fold("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def measured(docs: DataFrame, compute, width: int) -> DataFrame:
    """doc_id and an array of `width` statistics of each text, written once to the shared folder."""

    def run(batches):
        for batch in batches:
            x = compute(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), words.lists(x.ravel(), np.full(len(x), width), pa.float32())], names=["doc_id", "x"])

    return common.stage(common.texts(docs).mapInArrow(run, "doc_id long, x array<float>"), "statistics")


def collected(stats: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bounded sample's statistics and labels, in the order of doc_id; of rows that repeat an id the smallest statistics."""
    got = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).orderBy("doc_id").toArrow()
    if not got.num_rows:
        return np.zeros((0, 1)), np.zeros(0)
    x = np.array(got.column("x").to_pylist(), dtype=float)
    return x, got.column("y").to_numpy().astype(float)


def scored(stats: DataFrame, model, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of stats."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            s = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Scores every text for quality: doc_id, held_out, score, predicted.

    Null and empty texts are scored as empty. Repeated doc_ids each give a row; a null doc_id gives
    null for held_out. Without labels of both classes the score is the labels' mean (0.5 if none).
    """
    sample = labelled(labels, "quality", rows)
    stats = measured(docs, statistics, len(NAMES))
    return scored(stats, fit(*collected(stats, sample)), 0.5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality": op2_quality}
