"""Record normalisation, safety and metadata filters: column expressions and small plans over record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .state import saved

#: Fixed values of P04: the institution of its own kind, endings of ministries, of offices and of local places.
CULTURAL, MINISTRY, OFFICE, LOCAL_OFFICE, LOCAL = "국립아시아문화전당", ("부", "처"), "청", "[시도군구]청$", ("도", "시", "군", "구")


def source_type(source: Column, content: Column, places: Sequence[str] = ()) -> Column:
    """The first rule that holds: the institution, ministries and offices, dialogues, places, titled texts; else central."""
    ends = lambda tails: F.exists(F.array(*[F.lit(t) for t in tails]), lambda t: F.endswith(source, t))
    text = F.trim(content)
    known = source.isin(*places) if places else F.lit(False)
    return (
        F.when(F.contains(source, F.lit(CULTURAL)), "cultural").when(ends(MINISTRY), "central").when(F.endswith(source, F.lit(OFFICE)) & ~source.rlike(LOCAL_OFFICE), "central")
        .when(text.rlike("^(?:고객|상담원)\\s*[:：]"), "cultural").when(known | ends(LOCAL), "local").when(text.rlike("^제목\\s*[:：]"), "local").otherwise("central")
    )


def region_of(records: DataFrame, key: str, source: str, kind: str, places: DataFrame) -> DataFrame:
    """Records with region: the whole country for central ones, an exact name's region, else that of the first name (place, pos, region) that begins the source, else unknown.

    Names are short and few kinds of length, so a source meets them by equality on its own beginnings.
    """
    heads = records.select(key, source, F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(source))), lambda n: F.substring(F.col(source), F.lit(1), n))).alias("place"))
    found = heads.join(places, "place").groupBy(key).agg(F.max_by("region", F.col("place") == F.col(source)).alias("exact_or_any"), F.max((F.col("place") == F.col(source)).cast("int")).alias("exact"), F.min_by("region", "pos").alias("begins"))
    out = records.join(found, key, "left")
    return out.withColumn("region", F.when(F.col(kind) == "central", "전국").when(F.col("exact") == 1, F.col("exact_or_any")).otherwise(F.coalesce("begins", F.lit("unknown")))).drop("exact_or_any", "exact", "begins")


def kst_date(day: Column, as_of: Column) -> Column:
    """YYYYMMDD as an ISO time at +09:00; a blank or impossible day gives as_of, which a caller states."""
    own = F.trim(day)
    found = F.when(own.rlike("^[0-9]{8}$"), F.try_to_timestamp(own, F.lit("yyyyMMdd")))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd'T'HH:mm:ss'+09:00'"), as_of)


def iso_day(day: Column) -> Column:
    """Eight digits as an ISO day, anything else as it is."""
    return F.regexp_replace(F.trim(day), "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")


def category(value: Column) -> Column:
    """A blank category is 미분류."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("미분류"))


def case_id(raw: Column, index: Column) -> Column:
    """Capitals, other signs as one dash, CASE- before; a missing one is numbered by its row."""
    own = F.regexp_replace(F.regexp_replace(F.upper(F.trim(raw)), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    unknown = F.concat(F.lit("CASE-UNKNOWN-"), F.lpad(index.cast("string"), 6, "0"))
    return F.when(raw.isNull() | (raw == ""), unknown).when(own.startswith("CASE-"), own).otherwise(F.concat(F.lit("CASE-"), own))


def split_answer(text: Column, marker: str) -> tuple[Column, Column]:
    """P10: what stands before and after the first marker; without one, all is the question."""
    at = F.locate(marker, text)
    return F.trim(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)), F.trim(F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(F.lit("")))


def case_text(title: Column, question: Column, answer: Column | None = None) -> Column:
    """Title and question in lines, the title only if the question doesn't begin with it; then the answer."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    head = F.when(F.startswith(F.trim(question), F.trim(title)), F.lit(None)).otherwise(blank(title))
    return F.concat_ws("\n", head, blank(question), *([blank(answer)] if answer is not None else []))


def first_text(*choices: Column) -> Column:
    """The first of the choices that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices], F.lit(""))


def analysis_text(*parts: Column) -> Column:
    """The parts that aren't blank, trimmed, joined by blanks."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def signal_values(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Key and its values with single blanks, the blank ones dropped, and of those equal but for case the first, in order."""
    def listed(df: DataFrame) -> DataFrame:
        squeezed = F.transform(values, lambda v, i: F.struct(i.alias("pos"), F.trim(F.regexp_replace(v, "\\s+", " ")).alias("v")))
        return df.select(key, _firsts(F.filter(squeezed, lambda x: x["v"] != "")).alias("f")).where(F.size("f") > 0)

    # A row's values stay in it; only rows that repeat a key travel, to be compared with each other
    again = saved(rows.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"))
    same = F.col(key).eqNullSafe(F.col("_again"))
    merged = listed(rows.join(again, same, "left_semi")).groupBy(key).agg(F.collect_list("f").alias("f")).select(key, _firsts(F.flatten("f")).alias("f"))
    return listed(rows.join(again, same, "left_anti")).unionByName(merged).select(key, F.transform("f", lambda x: x["v"]).alias(values))


def _firsts(pairs: Column) -> Column:
    """Of (pos, v) that are equal but for case the first, in order."""
    keyed = F.array_sort(F.transform(pairs, lambda x: F.struct(F.lower(x["v"]).alias("k"), x["pos"].alias("pos"), x["v"].alias("v"))))
    # The sorted array is bound to a name, so it isn't made again for each element
    first = F.flatten(F.transform(F.array(keyed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))))
    return F.array_sort(F.transform(first, lambda x: F.struct(x["pos"].alias("pos"), x["v"].alias("v"))))


def title_of(explicit: Column, *texts: Column, kind: Column, most: int = 60) -> Column:
    """The explicit title, else the first text without its speaker's label, else the category; cut with dots."""
    own = F.coalesce(F.nullif(F.trim(explicit), F.lit("")), *[F.nullif(F.trim(F.regexp_replace(F.regexp_replace(t, "\\s+", " "), "^ ?[A-Za-z가-힣]{1,12} ?: ?", "")), F.lit("")) for t in texts], kind)
    return F.when(F.length(own) > most, F.concat(F.rtrim(F.substring(own, 1, most - 3)), F.lit("..."))).otherwise(own)


def filters(region: str | None = None, kind: str | None = None, created_at: str | None = None, date_from: str | None = None, date_to: str | None = None, labels: Sequence[str] = ()) -> Column:
    """F01, F02 over region, category, created_at (text) and entity_labels: region by substring, category and day by equality,
    a closed range of times that an unparsable time passes, and labels by overlap. Put it before a search's ranking."""
    ok = F.lit(True)
    if region:
        ok &= F.contains(F.coalesce("region", F.lit("")), F.lit(region))
    if kind:
        ok &= F.coalesce("category", F.lit("")) == kind
    if created_at:
        ok &= F.coalesce("created_at", F.lit("")) == created_at
    at = F.try_to_timestamp(F.col("created_at"))
    if date_from:
        ok &= F.coalesce(at >= F.try_to_timestamp(F.lit(date_from)), F.lit(True))
    if date_to:
        ok &= F.coalesce(at <= F.try_to_timestamp(F.lit(date_to)), F.lit(True))
    if labels:
        ok &= F.arrays_overlap(F.transform(F.coalesce("entity_labels", F.expr("cast(array() as array<string>)")), lambda x: F.upper(x)), F.array(*[F.lit(x.upper()) for x in labels]))
    return ok


def allowed_labels(values: Column, allowed: Sequence[str]) -> Column:
    """distinct upper-case labels of the whitelist, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.upper(v)), lambda v: v.isin(*allowed)))


def unsafe(flag: Column, status: Column) -> Column:
    """a truthy flag, or a status under review or in quarantine."""
    return F.coalesce(F.lower(F.trim(flag)).isin("true", "1", "yes", "y"), F.lit(False)) | F.coalesce(F.upper(F.trim(status)).isin("REVIEW", "QUARANTINED"), F.lit(False))


def delayed(status: Column, minutes: Column, ts: Column, as_of: Column, least: float, closed: Sequence[str]) -> Column:
    """open, and handled for (or, unknown, open since) `least` minutes."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 60.0
    return C.is_open(status, closed) & (F.coalesce(minutes, age) >= least)


def safety(text: Column, risk: Sequence[str], masked: Column, left: Sequence[str]) -> tuple[Column, Column]:
    """A status, REVIEW if all risk patterns meet in the text, QUARANTINED if a pattern is left after masking, else PASSED; and the text that may be used."""
    every = F.lit(True)
    for p in risk:
        every &= text.rlike(p)
    remains = F.lit(False)
    for p in left:
        remains |= masked.rlike(p)
    status = F.when(F.coalesce(text, F.lit("")) == "", "PASSED").when(every, "REVIEW").when(remains, "QUARANTINED").otherwise("PASSED")
    return status, F.when(status == "PASSED", masked).otherwise("")


def processed(docs: DataFrame, risk: Sequence[str], left: Sequence[str]) -> DataFrame:
    """P25: docs with clean and masked text and pii_status; rows that aren't passed keep their columns but no text."""
    own = docs.withColumn("text", C.mask_pii(C.clean_text("text")))
    status, text = safety(F.col("text"), risk, F.col("text"), left)
    return own.withColumn("pii_status", status).withColumn("text", text)


def without_members(results: DataFrame, members: DataFrame, ids: Sequence[str]) -> DataFrame:
    """results whose id columns all differ, as case ids without signs and case, from every member (id)."""
    plain = lambda c: F.lower(F.regexp_replace(c.cast("string"), "[^A-Za-z0-9]+", ""))
    bad = members.select(plain(F.col("id")).alias("_k")).distinct()
    for c in ids:
        results = results.withColumn("_k", plain(F.col(c))).join(bad, "_k", "left_anti").drop("_k")
    return results


def boilerplate(task: Column, hard: str, soft: str, anchor: str) -> Column:
    """matches a hard pattern, or a soft one without an anchor."""
    return task.rlike(hard) | (task.rlike(soft) & ~task.rlike(anchor))


def clean_tasks(tasks: DataFrame, by: str, text: str, order: str, drop: Column, least: int) -> DataFrame:
    """per group the distinct tasks that aren't boilerplate, in order, with the number dropped; groups of `least` tasks or more."""
    kept = tasks.where(~drop).groupBy(by, F.trim(text).alias("task")).agg(F.min(order).alias("pos"))
    total = tasks.groupBy(by).agg(F.count("*").alias("n_all"))
    out = kept.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "task"))), lambda x: x["task"]).alias("tasks"))
    return out.where(F.size("tasks") >= least).join(total, by).select(by, "tasks", F.size("tasks").alias("n_tasks"), (F.col("n_all") - F.size("tasks")).alias("n_dropped"))


def request_type(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first type of the ordered rules (type, words) with a word in the text; else other."""
    out = F.when(F.lit(False), "")
    for name, words in rules:
        out = out.when(C.contains_any(text, words), name)
    return out.otherwise("other")


def location_state(a_region: Column, a_details: Column, b_region: Column, b_details: Column, broad: Column) -> Column:
    """Missing, ambiguous, exact, nearby or conflict, from the regions and the detail places of two records.

    broad: whether the first region is a wide one. A detail of four letters or more that begins another is nearby.
    """
    none = lambda r, d: r.isNull() & (F.size(d) == 0)
    begins = lambda x, y: (F.length(x) >= 4) & F.startswith(y, x)
    near = F.exists(a_details, lambda x: F.exists(b_details, lambda y: begins(x, y) | begins(y, x)))
    both = (F.size(a_details) > 0) & (F.size(b_details) > 0)
    return (
        F.when(none(a_region, a_details) & none(b_region, b_details), "missing").when(none(a_region, a_details) | none(b_region, b_details), "ambiguous")
        .when(both & F.arrays_overlap(a_details, b_details), "exact").when(both & near, "nearby").when(both, "conflict")
        .when((a_region == b_region) & broad, "ambiguous").when(a_region == b_region, "exact").otherwise("conflict")
    )


#: Fixed values of X45.
LOCATION_SCORE = {"exact": 1.0, "nearby": 0.75, "ambiguous": 0.35, "missing": 0.25, "conflict": 0.0}


def location_score(state: Column) -> Column:
    """X45."""
    return F.create_map(*[F.lit(v) for kv in LOCATION_SCORE.items() for v in kv])[state]


def evidence_count(*signals: Column) -> Column:
    """How many of the signals are present (not null and not blank)."""
    out = F.lit(0)
    for s in signals:
        out += F.coalesce(F.trim(s.cast("string")) != "", F.lit(False)).cast("int")
    return out


def segment_similarity(a: Column, b: Column) -> Column:
    """The best Jaccard similarity of any two segments (arrays of tokens)."""
    return F.coalesce(F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: C.jaccard(x, y))))), F.lit(0.0))


def text_score(query: Column, text: Column, bonus: float = 0.15) -> Column:
    """Jaccard of the token sets, a bonus if the text holds the query, at most 1, four places."""
    sim = C.jaccard(F.array_distinct(C.tokens(query)), F.array_distinct(C.tokens(text)))
    return F.round(F.least(F.lit(1.0), sim + F.when(F.contains(F.lower(text), F.lower(query)), bonus).otherwise(0.0)), 4)


def article_no(raw: Column) -> Column:
    """000300 is 제3조, 000302 제3조의2; other forms lose their blanks."""
    main, sub = F.substring(raw, 1, 4).cast("int"), F.substring(raw, 5, 2).cast("int")
    out = F.concat(F.lit("제"), main.cast("string"), F.lit("조"), F.when(sub > 0, F.concat(F.lit("의"), sub.cast("string"))).otherwise(""))
    return F.when(raw.rlike("^[0-9]{6}$"), out).otherwise(F.regexp_replace(raw, "\\s+", ""))


def find_span(text: Column, quote: Column, head: int = 30) -> Column:
    """X11: start, end and kind of a quote in a text: exact, by its first letters, or inferred (0, 0)."""
    exact, near = F.position(quote, text), F.position(F.substring(quote, 1, head), text)
    span = lambda s, e, k: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(k).alias("kind"))
    n = F.length(quote)
    return F.when((n > 0) & (exact > 0), span(exact - 1, exact - 1 + n, "exact")).when((n >= head) & (near > 0), span(near - 1, F.least(near - 1 + n, F.length(text)), "prefix")).otherwise(span(F.lit(0), F.lit(0), "inferred"))


def actions(status: Column, blocked: Column, table: Mapping[str, Sequence[str]], guarded: Sequence[str]) -> Column:
    """The actions that a status allows, without the guarded ones where a flag blocks."""
    own = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]) if v else F.expr("cast(array() as array<string>)"))])[status]
    return F.when(blocked, F.array_except(own, F.array(*[F.lit(g) for g in guarded]))).otherwise(own)


def transitions(groups: DataFrame, requests: DataFrame, table: Mapping[tuple[str, str], str], guarded: Sequence[str]) -> DataFrame:
    """Groups (id, status, blocked) after requests (id, action): the new status, or the old one and why it was refused."""
    rows = F.create_map(*[x for (s, a), t in table.items() for x in (F.lit(f"{s}/{a}"), F.lit(t))])
    asked = groups.join(requests, "id", "left")
    to = rows[F.concat_ws("/", "status", "action")]
    refused = F.when(F.col("action").isNull(), F.lit(None)).when(to.isNull(), "no such step").when(F.col("blocked") & F.col("action").isin(*guarded), "blocked")
    return asked.select("id", F.when(F.col("action").isNotNull() & refused.isNull(), to).otherwise(F.col("status")).alias("status"), refused.alias("refused"))


def mask_strings(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every text in df masked as P20 has it, in whatever depth of structs, arrays and map values it stands; columns of keep, map keys, nulls and other types stay as they are."""

    def masked(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(c.isNotNull(), C.mask_pii(c))
        if isinstance(kind, T.ArrayType) and holds_text(kind.elementType):
            return F.transform(c, lambda x: masked(x, kind.elementType))
        if isinstance(kind, T.MapType) and holds_text(kind.valueType):
            return F.transform_values(c, lambda k, v: masked(v, kind.valueType))
        if isinstance(kind, T.StructType) and holds_text(kind):
            return F.when(c.isNotNull(), F.struct(*[masked(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
        return c

    def holds_text(kind: T.DataType) -> bool:
        parts = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else []
        return isinstance(kind, T.StringType) or any(map(holds_text, parts))

    return df.select(*[F.col(f"`{f.name}`") if f.name in keep else masked(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def validity_bounds(dates: str, evidence: str) -> Column:
    """valid_from and valid_to of a claim's dates (array of role, value, precision, evidence_ids), as a struct of texts; null where a bound is not given.

    A bound has to be given once, as a day in ISO form, with evidence ids that are all among the claim's
    own; and the first may not lie behind the second. Anything else fails the job. Dates of other roles
    say nothing about validity.
    """
    own = F.filter(dates, lambda d: d["role"].isin("valid_from", "valid_to"))
    day = lambda v: F.coalesce(F.date_format(F.try_to_date(v, "yyyy-MM-dd"), "yyyy-MM-dd") == v, F.lit(False))
    known = lambda ids: F.coalesce((F.size(ids) > 0) & (F.size(F.array_except(ids, F.coalesce(F.col(evidence), F.array().cast("array<string>")))) == 0), F.lit(False))
    fine = F.forall(own, lambda d: F.coalesce(d["precision"] == "day", F.lit(False)) & day(d["value"]) & known(d["evidence_ids"]))
    once = F.size(F.array_distinct(F.transform(own, lambda d: d["role"]))) == F.size(own)
    value = lambda role: F.get(F.transform(F.filter(own, lambda d: d["role"] == role), lambda d: d["value"]), F.lit(0))
    ordered = F.coalesce(value("valid_from") <= value("valid_to"), F.lit(True))
    bounds = F.struct(value("valid_from").alias("valid_from"), value("valid_to").alias("valid_to"))
    wrong = lambda text: F.raise_error(F.lit(text)).cast("struct<valid_from:string,valid_to:string>")
    empty = F.lit(None).cast("struct<valid_from:string,valid_to:string>")
    return F.when(F.col(dates).isNull(), empty).when(~(fine & once), wrong("a bound of validity needs one day and evidence of the claim")).when(~ordered, wrong("validity begins after its end")).otherwise(bounds)


def listed(rows: DataFrame, order: Sequence[str], equal: Mapping[str, object | None] | None = None, holding: Mapping[str, object | None] | None = None) -> DataFrame:
    """rows whose columns equal the given values and whose arrays hold them, the largest `order` first; a filter without a value (null or blank) is none."""
    given = lambda m: [(c, v) for c, v in (m or {}).items() if v is not None and v != ""]
    out = rows
    for c, v in given(equal):
        out = out.where(F.col(c) == F.lit(v))
    for c, v in given(holding):
        out = out.where(F.array_contains(c, v))
    return out.orderBy(*[F.desc(c) for c in order])
