"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9가-힣]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case runs of Latin letters, digits and Hangul syllables."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def tokens_with_bigrams(text: Column | str) -> Column:
    """Words of two characters or more, and the character pairs of Hangul words."""
    words = F.filter(tokens(text), lambda w: F.length(w) >= 2)
    pairs = F.flatten(F.transform(F.filter(words, lambda w: w.rlike("^[가-힣]+$")), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.concat(words, pairs)


def clean_text(text: Column | str) -> Column:
    """Drop _x000D_ and control characters, unify line ends and blanks, at most two line ends in a row."""
    c = F.regexp_replace(col(text), "_x000D_", "")
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\t", " ")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    c = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {2,}", " ")
    return F.regexp_replace(c, "^[ \n]+|[ \n]+$", "")


def dedup_form(text: Column | str) -> Column:
    """Lower case, single blanks, and only letters, digits and Hangul besides."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(col(text)), "\\s+", " ")), "[^a-z0-9가-힣\\s]+", "")


def squash(text: Column | str) -> Column:
    """No blanks, lower case."""
    return F.lower(F.regexp_replace(col(text), "\\s+", ""))


def redact_runs(text: Column | str) -> Column:
    """Runs of masking marks become one label."""
    return F.regexp_replace(F.regexp_replace(col(text), "▲{2,}", "[REDACTED:NAME]"), "○{2,}", "[REDACTED:ORG]")


#: Fixed values of P20, in order: label, what may not stand before, the pattern, what may not stand after. Each rule sees what the ones before it left.
PII_RULES: tuple[tuple[str, str, str, str], ...] = (
    ("EMAIL", "[A-Za-z0-9._%+-]", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[A-Za-z0-9.-]"),
    ("PHONE", "[0-9]", "(?:01[016789]|02|0[3-6][1-5])[-.\\s]?[0-9]{3,4}[-.\\s]?[0-9]{4}", "[0-9]"),
    ("RRN", "[\\p{L}\\p{N}_]", "[0-9]{6}[-\\s]?[1-4][0-9]{6}", "[\\p{L}\\p{N}_]"),
    ("ACCOUNT", "[\\p{L}\\p{N}_]", "[0-9]{2,6}[-\\s][0-9]{2,6}[-\\s][0-9]{2,8}", "[\\p{L}\\p{N}_]"),
    ("VEHICLE", "[\\p{L}\\p{N}_]", "[0-9]{2,3}\\s?[가-힣]\\s?[0-9]{4}", "[\\p{L}\\p{N}_]"),
    ("ADDRESS", "", "(?:[가-힣A-Za-z0-9]+(?:로|길)\\s?[0-9]+(?:-[0-9]+)?|[0-9]{1,5}\\s?번지)", ""),
    ("ADDRESS_DETAIL", "[0-9]", "(?:[0-9]{1,4}\\s?동\\s?[0-9]{1,4}\\s?호|[0-9]{1,4}\\s?호)", "[0-9]"),
    ("NAME", "[가-힣]", "[김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남노하곽성차주우구민류나진지엄채원천방공현함변여추도소석선마길위연명기반탁제모구어은][가-힣]{1,2}\\s?(?:님|씨)", ""),
)


def pii_pattern(rule: tuple[str, str, str, str]) -> str:
    _, before, body, after = rule
    return (f"(?<!{before})" if before else "") + body + (f"(?!{after})" if after else "")


def mask_pii(text: Column | str, rules: Sequence[tuple[str, str, str, str]] = PII_RULES) -> Column:
    """P20: ordered redactions; null counts as empty."""
    def once(c: Column, rule: tuple[str, str, str, str]) -> Column:
        # An array of one holds the text so far, so that each rule is evaluated once
        needed = F.contains(c, F.lit("@")) if rule[0] == "EMAIL" else c.rlike("[0-9]" if rule[0] != "NAME" else "[님씨]")
        return F.when(needed, F.regexp_replace(c, pii_pattern(rule), f"[REDACTED:{rule[0]}]")).otherwise(c)

    def step(texts: Column, rule: tuple[str, str, str, str]) -> Column:
        return F.transform(texts, lambda c: once(c, rule))

    out = F.array(F.coalesce(col(text), F.lit("")))
    for rule in rules:
        out = step(out, rule)
    return out[0]


def pii_labels(text: Column | str, masked: Column | str, rules: Sequence[tuple[str, str, str, str]] = PII_RULES) -> Column:
    """P20: labels of the redactions that a masked text has over its source, in the rules' order."""
    tags = lambda c, tag: F.length(c) - F.length(F.replace(c, F.lit(tag), F.lit("")))
    source = F.coalesce(col(text), F.lit(""))
    return F.array_compact(F.array(*[F.when(tags(col(masked), f"[REDACTED:{r[0]}]") > tags(source, f"[REDACTED:{r[0]}]"), F.lit(r[0])) for r in rules]))


def contains_any(text: Column | str, words: Iterable[str]) -> Column:
    """F07."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(col(text), w))


def keyword_hits(text: Column | str, words: Iterable[str]) -> Column:
    """How many of the words stand in the text."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(col(text), F.lit(w)).cast("int")
    return out


def chunks(text: Column | str, size: int = 500, overlap: int = 100) -> Column:
    """Character windows over the text with blanks collapsed; the window that reaches the end is the last."""
    step = size - overlap

    def cut(c: Column) -> Column:
        n = F.length(c)
        last = (F.ceil((n - size) / F.lit(step)) * step).cast("int")
        starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))
        return F.when(n > 0, F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(F.expr("cast(array() as array<string>)"))

    # The text goes through an array of one, so that the inner lambda holds it cleaned and doesn't clean it again for each chunk
    return F.transform(F.array(F.trim(F.regexp_replace(col(text), "[ \\t\\r\\n]+", " "))), cut)[0]


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def overlap_ratio(a: Column | str, b: Column | str) -> Column:
    """Share of a's distinct tokens that b has."""
    own = F.array_distinct(col(a))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, col(b))) / F.size(own))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; 0 for a zero vector; a longer vector counts up to the other's length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm))).otherwise(0.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """X34, on a sphere of 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def band(score: Column, *levels: tuple[float, str], rest: str) -> Column:
    """The first level whose threshold the score reaches."""
    out = None
    for at, name in levels:
        out = F.when(score >= at, name) if out is None else out.when(score >= at, name)
    return out.otherwise(rest)


def content_id(*parts: Column, length: int = 12) -> Column:
    """The head of sha1 over the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def region_compatible(a: Column, b: Column) -> Column:
    """unknown, equal, one begins the other, or the same first two characters; not transitive."""
    unknown = lambda c: c.isNull() | F.lower(F.trim(c)).isin("", "unknown")
    return unknown(a) | unknown(b) | (a == b) | F.startswith(a, b) | F.startswith(b, a) | (F.substring(a, 1, 2) == F.substring(b, 1, 2))


def is_open(status: Column, closed: Sequence[str]) -> Column:
    """blank is not open, a closed status is not open, any other is."""
    s = F.lower(F.trim(status))
    return F.when(status.isNull() | (s == "") | s.isin(*closed), False).otherwise(True)


def is_night(hour: Column, start: int, end: int) -> Column:
    """an hour interval that may wrap around midnight."""
    return (hour >= start) | (hour < end) if start > end else (hour >= start) & (hour < end)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
