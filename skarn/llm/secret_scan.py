"""Secret scans: candidate strings, judged by a random forest.

A candidate is a long run of key characters, or any value of LEAST_BESIDE characters or more that is
assigned to a name or stands beside a telling word. The forest sees its length,
how its characters follow one another, how much of it common words cover, whether it stands in a
path or an address, and the words beside it. It is trained from labelled findings: a DataFrame of
(text, start, length, secret) that a caller may give; by default findings generated from public key
formats and from their usual look-alikes, whose labels say how they were made, not how they look.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .trees import Forest, forest

#: Findings of a given table that are fitted, at most.
FIT_ROWS = 4_000
THRESHOLD = 0.5
LEAST, LEAST_BESIDE = 16, 8
MASK = "[SECRET]"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.\-]{%d,}" % LEAST)
#: Words beside a secret, words beside a look-alike, and common parts of words.
NEAR_SECRET = frozenset("token secret password passwd pwd apikey api_key key credential credentials auth authorization bearer access_key private_key client_secret access".split())
NEAR_OTHER = frozenset("commit sha md5 sha1 sha256 checksum digest hash uuid guid id version build revision ref etag http https www file path href src".split())
COMMON = "the and ing ion ent for ter ate ers ess ity ver est age con ble com pro ass ort ort ist und sch ein der ich die les que our eau ment cion ado para test data file user name image index main page view list item type text code node time date size path home docs lib src bin www http html json config example sample default value string number public private static class".split()
NAMES = ("length", "digits", "upper", "lower", "signs", "switches", "entropy", "rare_pairs", "hex", "longest_letters", "longest_digits", "dictionary", "slashes", "dots", "dashes", "near_secret", "near_other", "assigned", "quoted", "uuid", "prefix", "only_letters", "vowels", "distinct")
PREFIX = re.compile(r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|pk_live_|AIza|ya29\.|eyJ|npm_|hf_|SG\.)")
UUID = re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
ASSIGN = re.compile(r"""([A-Za-z_][A-Za-z0-9_\-]*)["']?\s*(?:=>|:=|=|:)\s*(["'`]?)$""")
WORD = re.compile(r"[^\W\d_]+(?:_[^\W\d_]+)*")
WINDOW = 48
SEPARATOR = re.compile(r"(?:=>|:=|=|:)\s*")
#: An assigned value: up to its own quote, or up to a blank, a quote or the next parameter of an address.
VALUE = re.compile(r"""(?P<q>["'`])(?P<quoted>(?:(?!(?P=q))\S)+)|(?!//)(?P<bare>(?:(?![&;,?][\w.\-]+=)[^\s"'`])+)""")
TELLING = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(NEAR_SECRET, key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)
TOKEN = re.compile(r"\S+")
#: A value is looked for in so many tokens before and after a telling word. Signs that open or close a value in running text are not part of it.
TOKENS_BEFORE, TOKENS_AFTER = 2, 3
OPENING, CLOSING = "\"'`([{<", "\"'`)]}>.,;:"
ENDS = "=./-+_"


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Start and length of text[start:end] without signs that open or close it."""
    raw = text[start:end]
    own = raw.lstrip(OPENING)
    return end - len(own), len(own.rstrip(CLOSING))


def beside(text: str) -> set[tuple[int, int]]:
    """Start and length of the values that are assigned to a name or stand near a telling word.

    A value within another one is given only if its name tells; so no text is read more than a few times.
    """
    out, reach, told = set(), 0, 0
    for m in SEPARATOR.finditer(text):
        tells = None
        if m.start() < reach:
            tells = TELLING.search(text, max(0, m.start() - WINDOW), m.start())
            if tells is None or m.start() < told:
                continue
        if not ASSIGN.search(text[max(0, m.end() - WINDOW) : m.end()]):
            continue
        v = VALUE.match(text, m.end())
        kind = v and v.lastgroup
        if not v:
            continue
        reach = max(reach, v.end())
        if tells:
            told = v.end()
        out.add((v.start(kind), v.end(kind) - v.start(kind)) if kind == "quoted" else _trimmed(text, *v.span(kind)))
    words = [m.start() for m in TELLING.finditer(text)]
    if words:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        starts = [t[0] for t in tokens]
        for k in {bisect.bisect_right(starts, w) - 1 for w in words}:
            for j in (*range(max(0, k - TOKENS_BEFORE), k), *range(k + 1, min(len(tokens), k + 1 + TOKENS_AFTER))):
                out.add(_trimmed(text, *tokens[j]))
    return {(s, k) for s, k in out if k >= LEAST_BESIDE}


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Start and length of every candidate, by start; candidates may overlap. Signs at the ends of a bare one are not part of it."""
    text = text or ""
    out = beside(text)
    known = set()
    for s, k in out:
        own = text[s : s + k]
        known.add((s + k - len(own.lstrip(ENDS)), len(own.strip(ENDS))))
    for m in CANDIDATE.finditer(text):
        raw = m.group()
        own = raw.strip(ENDS)
        found = (m.start() + len(raw) - len(raw.lstrip(ENDS)), len(own))
        if len(own) >= LEAST and found not in known:
            out.add(found)
    return sorted(out)


def describe(text: str, start: int, length: int) -> list[float]:
    """The forest's columns for one candidate."""
    s = text[start : start + length]
    before, after = text[max(0, start - WINDOW) : start], text[start + length : start + length + WINDOW]
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in s]
    n = len(s)
    share = lambda k: kind.count(k) / n
    count = [s.count(c) / n for c in set(s)]
    low = s.lower()
    covered = bytearray(n)
    for w in COMMON:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = b"\x01" * len(w)
            at = low.find(w, at + 1)
    runs = lambda k: max((len(x) for x in "".join("x" if y in k else " " for y in kind).split()), default=0)
    assign = ASSIGN.search(before)
    near = [p for w in WORD.findall(before)[-3:] + WORD.findall(after)[:2] for p in (w.lower(), *w.lower().split("_"))]
    if assign:
        near += [assign.group(1).lower(), *re.split(r"[_\-]", assign.group(1).lower())]
    letters = [c for c in low if c.isalpha()]
    vowels = sum(c in "aeiou" for c in letters) / max(1, len(letters))
    rare = sum(1 for a, b in zip(kind, kind[1:]) if {a, b} in ({"d", "l"}, {"d", "u"})) / n
    return [
        min(n, 200), share("d"), share("u"), share("l"), share("s"), sum(a != b for a, b in zip(kind, kind[1:])) / n,
        -sum(p * math.log2(p) for p in count), rare, float(all(c in "0123456789abcdefABCDEF" for c in s)), runs("ul") / n, runs("d") / n, sum(covered) / n,
        s.count("/") + before[-1:].count("/"), s.count("."), s.count("-"), float(any(w in NEAR_SECRET for w in near)), float(any(w in NEAR_OTHER for w in near)),
        float(assign is not None), float(before[-1:] in "\"'`" and before != ""), float(bool(UUID.match(s))), float(bool(PREFIX.match(s))), float(len(letters) == n), vowels, len(count) / n,
    ]


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """Generated findings (text, start, length, secret): public key formats and their look-alikes in running words."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = "an er in on re th he st nd ou ent tion ing der ein sch ver les que eau ment cion ado ra co mi".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    name = lambda: rng.choice(sorted(NEAR_SECRET))
    signs = "!@#$%&*"

    def long(k: int) -> str:
        """A plain word of k letters or more."""
        w = word()
        while len(w) < k:
            w += word()
        return w

    keys = [
        lambda: pick(hexa, rng.choice((32, 40, 64))), lambda: pick(alnum, rng.randint(20, 64)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 40), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum + "_-", 30) + "." + pick(alnum + "_-", 40), lambda: pick(alnum + "+/", 40), lambda: pick(alnum, 12) + "_" + pick(alnum, 12),
        lambda: pick(string.ascii_lowercase, rng.randint(16, 40)), lambda: pick(string.ascii_uppercase, rng.randint(16, 40)),
        lambda: pick(alnum, rng.randint(8, 15)), lambda: pick(alnum + signs * 3, rng.randint(8, 20)), lambda: pick(alnum + signs * 3, rng.randint(8, 20)),
        lambda: long(6) + pick(string.digits, rng.randint(1, 4)) + rng.choice(("", *signs)), lambda: long(5).capitalize() + pick(string.digits, rng.randint(1, 3)) + pick(string.ascii_uppercase, 1) + pick(string.digits, 1),
    ]
    around = [lambda v: f'{name()} = "{v}"', lambda v: f"{name()}: {v}", lambda v: f"{name().upper()}={v}", lambda v: f"'{name()}': '{v}'", lambda v: f"Authorization: Bearer {v}", lambda v: f"--{name()} {v}", lambda v: f"{name()} {v}", lambda v: f"{name()} is {v}"]
    plain = [
        lambda: (word() + "." + str(rng.randint(1, 99)) + "@mail" + str(rng.randint(1, 9)) + ".example.com", "{}"), lambda: (pick(string.digits, 16), rng.choice(("{}", "id {}", "number {}"))),
        lambda: (pick(hexa, 40), rng.choice(("commit {}", "sha {}", "checksum {}", "sha1: {}"))), lambda: (pick(hexa, 64), rng.choice(("sha256: {}", "digest {}", "sha256:{}"))), lambda: (pick(hexa, 32), rng.choice(("md5 {}", "hash {}", "etag {}"))),
        lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rng.choice(("uuid {}", "id: {}", "{}"))), lambda: ("/".join(word() for _ in range(4)) + f"/{word()}{rng.randint(1, 99)}.html", rng.choice(("https://{}", "/{}", "file {}"))),
        lambda: (word().capitalize() + word().capitalize() + word().capitalize() + word().capitalize() + word(), "{}"), lambda: (f"{word()}-{word()}-{rng.randint(1, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}-build{rng.randint(1, 999)}", "version {}"),
        lambda: (word() + "_" + word() + "_" + word() + str(rng.randint(1, 99)), "{}"), lambda: (pick(string.digits, 20), "{}"), lambda: ("." * 3 + pick(string.digits, 4) + "-" * 8 + pick(string.digits, 6), "{}"), lambda: (str(rng.randint(1990, 2030)) + "-" + "-".join(pick(string.digits, 2) for _ in range(5)), "{}"),
        # plain words beside telling words, values of other names, and long runs of letters
        lambda: (long(8), f"{name()} {{}}"), lambda: (long(8), f"the {name()} {word()} {{}}"), lambda: (long(8), f"{{}} {name()}"), lambda: (long(8), f"{name()}: {{}}"), lambda: (long(4) + "-" + long(4), f"{name()} {{}}"),
        lambda: (rng.choice((long(5), long(5).upper(), long(5).capitalize())) + rng.choice("!?") * rng.randint(1, 3), rng.choice((f"{name()} {{}}", f"{{}} {name()}", f'{name()} = "{pick(hexa, 40)}"!! {{}}', "{}"))),
        lambda: (long(8), rng.choice(('title = "{}"', "note: {}", "name: '{}'", "author={}", '"label": "{}"'))), lambda: (long(6) + pick(string.digits, rng.randint(2, 4)), rng.choice(('user = "{}"', "login: {}", "username={}", '"host": "{}"'))),
        lambda: (long(16), "{}"), lambda: (long(16).upper(), "{}"), lambda: (long(5).capitalize() + "-" + long(10), "{}"), lambda: ("/".join(long(4) for _ in range(4)), rng.choice(("{}", "/{}", "path: {}"))), lambda: (pick(string.digits, rng.randint(8, 12)), rng.choice(("number: {}", "id={}", "date: {}"))),
    ]
    out = []
    for i in range(n):
        if i % 2:
            value, left = rng.choice(keys)(), None
            core = rng.choice(around)(value)
        else:
            value, left = rng.choice(plain)()
            core = left.format(value)
        text = " ".join(word() for _ in range(rng.randint(0, 8))) + " " + core + " " + " ".join(word() for _ in range(rng.randint(0, 8)))
        at = text.rindex(value)
        for s, k in candidates(text):
            if s < at + len(value) and at < s + k:
                out.append((text, s, k, i % 2))
            elif i % 2 and text[s : s + k].isalpha():  # a word beside the secret's name
                out.append((text, s, k, 0))
    return out


def train(found: list[tuple[str, int, int, int]]) -> Forest:
    x = np.array([describe(t, s, k) for t, s, k, _ in found])
    return forest(x, np.array([f[3] for f in found], dtype=float))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate of each text: doc_id, start, length, secret_sha256, score, is_secret.

    start and length count characters. The string itself is never returned. Candidates may overlap,
    as a value and a run of key characters within it. Null and empty texts
    have no candidates. Repeated doc_ids each give their rows; a null doc_id stays null.
    """
    if findings is None:
        found = labelled_findings()
    else:
        found = [tuple(r) for r in findings.select("text", "start", "length", "secret").orderBy(F.xxhash64("text", "start")).limit(FIT_ROWS).collect()]
    model = train(found)

    def run(batches):
        for batch in batches:
            rows, x = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                for s, k in candidates(t):
                    own, at = t[max(0, s - WINDOW) : s + k + WINDOW], min(s, WINDOW)
                    x.append(describe(own, at, k))
                    rows.append((doc, s, k, hashlib.sha256(t[s : s + k].encode()).hexdigest()))
            if rows:
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(np.array(x)))], names=["doc_id", "start", "length", "secret_sha256", "score"])

    out = common.texts(docs).mapInArrow(run, "doc_id long, start long, length long, secret_sha256 string, score double")
    return out.withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """The documents with each secret in their texts replaced by mask and n_chars counted anew, all columns kept."""
    model = train(labelled_findings())

    @F.pandas_udf("string")
    def clean(texts):
        def one(t):
            found = candidates(t)
            if not found:
                return t
            keep = model.score(np.array([describe(t[max(0, s - WINDOW) : s + k + WINDOW], min(s, WINDOW), k) for s, k in found])) >= threshold
            spans = []
            for (s, k), bad in zip(found, keep):
                if bad and spans and s < spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s + k)
                elif bad:
                    spans.append([s, s + k])
            for s, e in reversed(spans):
                t = t[:s] + mask + t[e:]
            return t

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return redact(docs)


QUERIES = {"op1_secrets": op1_secrets}
