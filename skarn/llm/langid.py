"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

The network runs over all bytes of a text (A-Z and Latin-1 capitals in lower case), blanks, digits
and signs included, so its states carry over from word to word. Long texts are cut into windows of
CORE bytes; a window also reads OVERLAP bytes to either side, whose states it takes over but whose
labels belong to the neighbour. Every byte gets a distribution over languages from the states before
and behind it; a document's is pooled from the log probabilities of all its bytes. Gates and states
use the softsign x / (1 + |x|), which costs a fraction of tanh.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: About so many labelled documents are fitted, spread evenly over the languages (LEAST_DOCS of each at least), and so many windows of each.
FIT_DOCS, LEAST_DOCS, WINDOWS, FIT_LENGTH = 2_000, 16, 5, 96
HIDDEN, EPOCHS, BATCH = 10, 4, 256
CORE, OVERLAP, ROWS = 448, 32, 1024
#: A word's worth of bytes, and how many of them decide at most: bytes of one text are no independent witnesses.
BYTES_A_WITNESS, MOST_WITNESSES = 6, 20


def softsign(x: np.ndarray) -> np.ndarray:
    """In place."""
    x /= 1 + np.abs(x)
    return x


def padded(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix and mask of sequences."""
    size = np.array([len(b) for b in items])
    mask = np.arange(int(size.max())) < size[:, None]
    out = np.zeros(mask.shape, np.uint8)
    out[mask] = np.frombuffer(b"".join(items), np.uint8)
    return out, mask


@dataclass
class Network:
    """Byte tables (to update gate, reset gate and new state), recurrent matrices and the output layer, for both directions.

    Arrays run over units first and sequences last.
    """

    langs: list[str]
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.5, (3 * hidden, 256)).astype(np.float32)
            w["u" + d] = rng.normal(0, 1.5 * hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        w["o"] = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32)
        w["c"] = np.zeros((len(langs), 1), np.float32)
        return cls(langs, w)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, layer: np.ndarray | None = None):
        """States (time, units, sequences) of one direction, and what the backward pass needs; with a layer, its outputs
        from the states alone. A state is zero beyond a sequence's end."""
        t, n = x.shape
        table, u = self.w["x" + d], self.w["u" + d]
        k = u.shape[1]
        h = np.zeros((k, n), u.dtype)
        keep = layer is None
        states, held = np.empty((t, k if keep else len(layer), n), u.dtype), []
        full = mask.all(1)
        gate, new, part, fed = np.empty((2 * k, n), u.dtype), np.empty((k, n), u.dtype), np.empty((k, n), u.dtype), np.empty((3 * k, n), u.dtype)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            np.take(table, x[i], 1, out=fed, mode="clip")
            np.matmul(u[: 2 * k], h, out=gate)
            gate += fed[: 2 * k]
            s = softsign(gate)  # the gates are (1 + s) / 2
            np.multiply(s[k:], h, out=part)
            part += h
            part *= 0.5
            np.matmul(u[2 * k :], part, out=new)
            new += fed[2 * k :]
            c = softsign(new)
            if keep:
                held.append((i, h.copy(), s.copy(), c.copy()))
            c -= h
            np.multiply(s[:k], c, out=part)
            part += c
            part *= 0.5
            h += part
            if not full[i]:
                h *= mask[i]
            if keep:
                states[i] = h
            else:
                np.matmul(layer, h, out=states[i])
        return states, held

    def log_probs(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(time, languages, sequences); x and mask: (time, sequences)."""
        k = self.w["uf"].shape[1]
        out = self._pass(x, mask, "f", np.ascontiguousarray(self.w["o"][:, :k]))[0]
        out += self._pass(x, mask, "b", np.ascontiguousarray(self.w["o"][:, k:]))[0]
        out += self.w["c"]
        return log_softmax(out, 1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean loss over positions, and its gradients by backpropagation through time; x and mask: (sequences, time)."""
        x, mask = np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T)
        k = self.w["uf"].shape[1]
        (sf, hf), (sb, hb) = self._pass(x, mask, "f"), self._pass(x, mask, "b")
        both = np.concatenate([sf, sb], 1)
        lp = log_softmax(np.matmul(self.w["o"], both) + self.w["c"], 1)
        w = mask * (weight / mask.sum(0))
        total = w.sum()
        at = np.arange(len(y))
        loss = -(lp[:, y, at] * w).sum() / total
        g = np.exp(lp)
        g[:, y, at] -= 1
        g *= (w / total)[:, None, :].astype(g.dtype)
        out = {"o": np.einsum("thn,tln->lh", both, g), "c": g.sum((0, 2))[:, None]}
        back = np.matmul(self.w["o"].T, g)
        for d, held, part in (("f", hf, back[:, :k]), ("b", hb, back[:, k:])):
            u = self.w["u" + d]
            gx, gu = np.zeros_like(self.w["x" + d]).T.copy(), np.zeros_like(u)
            gh = np.zeros_like(part[0])
            for i, h, s, c in reversed(held):
                z, r, m = (1 + s[:k]) / 2, (1 + s[k:]) / 2, mask[i]
                gh = (gh + part[i]) * m
                gc = gh * z * (1 - np.abs(c)) ** 2
                grh = u[2 * k :].T @ gc
                gate = np.concatenate([gh * (c - h), grh * h]) * (1 - np.abs(s)) ** 2 / 2
                gu[: 2 * k] += gate @ h.T
                gu[2 * k :] += gc @ (r * h).T
                np.add.at(gx, x[i], np.concatenate([gate, gc]).T)
                gh = gh * (1 - z) + grh * r + u[: 2 * k].T @ gate
            out["x" + d], out["u" + d] = gx.T, gu
        return float(loss), out


def log_softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    x = x - x.max(axis, keepdims=True)
    x -= np.log(np.exp(x).sum(axis, keepdims=True))
    return x


def train(items: list[bytes], y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam over batches of sequences of like length; every language weighs the same."""
    net = Network.fresh(langs, seed=seed)
    share = np.bincount(y, minlength=len(langs)).astype(float)
    weight = (len(y) / (len(langs) * np.maximum(share, 1)))[y]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    s = {k: np.zeros_like(v) for k, v in net.w.items()}
    size = np.array([len(b) for b in items])
    step = 0
    for epoch in range(epochs):
        order = np.argsort(size + rng.uniform(0, 8, len(size)), kind="stable")
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rng.shuffle(batches)
        for rows in batches:
            x, mask = padded([items[i] for i in rows])
            _, g = net.gradients(x, mask, y[rows], weight[rows])
            step += 1
            rate = 0.03 * 0.4**epoch
            for k, v in g.items():
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The sum of each document's log probabilities over all its bytes (documents, languages); buf: lower-case bytes."""
    size = np.diff(offs)
    parts = -(-size // CORE)
    owner = np.repeat(np.arange(len(size)), parts)
    core = offs[:-1][owner] + CORE * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(core + CORE, offs[1:][owner])
    lo, hi = np.maximum(core - OVERLAP, offs[:-1][owner]), np.minimum(stop + OVERLAP, offs[1:][owner])
    out = np.zeros((len(size), len(net.langs)))
    order = np.argsort(hi - lo, kind="stable")
    for at in range(0, len(order), ROWS):
        own = order[at : at + ROWS]
        t = np.arange(int((hi - lo)[own].max()))[:, None]
        x = buf[np.minimum(lo[own] + t, hi[own] - 1)].astype(np.intp)
        lp = net.log_probs(x, t < (hi - lo)[own])
        mine = (t >= (core - lo)[own]) & (t < (stop - lo)[own])
        np.add.at(out, owner[own], np.einsum("tln,tn->nl", lp, mine.astype(lp.dtype)))
    return out


def training_windows(docs: DataFrame, most: int = FIT_DOCS, windows: int = WINDOWS, length: int = FIT_LENGTH) -> tuple[list[bytes], list[str]]:
    """A bounded sample of labelled documents outside the held-out fold, as windows from all over each text; a text's label is its own row's."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where((common.fold("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = own.groupBy("lang").count().orderBy("lang").collect()  # one row for each language
    if not counts:
        return [], []
    per_lang, width = max(LEAST_DOCS, most // len(counts)), 1 << 30
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1, per_lang / r["count"]) * width))])

    def run(batches):
        for batch in batches:
            out, lang = [], []
            data, offs = words.buffer(batch.column(0))
            names = batch.column(1).to_pylist()
            for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                n = min(windows, -(-(hi - lo) // length))
                step = (hi - lo - length) / max(1, n - 1)
                for k in range(n):
                    at = lo + int(max(0.0, step) * k)
                    out.append(words.lower_latin(data[at : min(at + length, hi)]).tobytes())
                    lang.append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(lang, pa.string())], names=["window", "lang"])

    sample = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(width)) < share[F.col("lang")]).select("text", "lang")
    got = sample.mapInArrow(run, "window binary, lang string").orderBy(F.xxhash64("window"), "window", "lang").limit(2 * per_lang * windows * len(counts)).toArrow()
    return got.column("window").to_pylist(), got.column("lang").to_pylist()


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter give `und` and 0. A language with no labelled document
    outside the held-out fold can't be predicted; without any label all is `und`. Repeated doc_ids
    each give a row, and each such row teaches its own label; a null doc_id gives null for held_out.
    """
    common.small_batches(docs.sparkSession)
    if net is None:
        items, names = training_windows(docs)
        langs = sorted(set(names))
        net = train(items, np.array([langs.index(n) for n in names]), langs) if langs else None

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            n = batch.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if net is not None and letter.any():
                data, offs = words.buffer(column)
                size = np.diff(offs)
                total = pooled(net, words.lower_latin(data), offs)
                mean = total / np.maximum(size, 1)[:, None]
                p = np.exp(log_softmax(mean * np.minimum(size / BYTES_A_WITNESS, MOST_WITNESSES)[:, None]))
                best = p.argmax(1)
                pred, score = np.array(net.langs, object)[best], p[np.arange(n), best]
            pred[~letter], score[~letter] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = common.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_language": op5_language}
