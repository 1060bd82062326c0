"""Small awkward tables and plain counterparts of the operators."""

import collections
import hashlib
import random
import re

SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, score double, component_id long, x array<double>"


def rows(seed=0, n=60, words=90, vocabulary=400):
    """Random texts with exact and near copies, shared passages, nulls, empty and very long ones, repeated words."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    passage = [rng.choice(vocab) for _ in range(70)]
    texts = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, words))]
        kind = i % 6
        if kind == 1 and texts:
            w = texts[rng.randrange(len(texts))].split()
        elif kind == 2 and texts:
            w = texts[rng.randrange(len(texts))].split()
            w[rng.randrange(len(w))] = "Changed"
        elif kind == 3:
            w = w + passage + w[:5]
        elif kind == 4:
            w = [w[0]] * rng.randint(1, 150)
        texts.append(" ".join(w))
    texts[5] = " ".join(rng.choice(vocab) for _ in range(6000))
    texts += [None, "", " \t\n", "one", "tie tie tie", "tie tie tie"]
    return texts


def docs(spark, texts, partitions=3):
    data = [(i, t, "en", "s", len(t or ""), 1, 0.5, 9, [1.0]) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return re.findall(SPACE, text or "")


def shingles(text, k):
    w = tokens(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(texts, k, num, den):
    """Smallest linked id of each text, by comparing all pairs."""
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def without_repeats(texts, window=50):
    """(words, removed, sha256 of what is kept) of each text, in the order of ids."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        w = tokens(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def counted(items):
    return collections.Counter(items)
