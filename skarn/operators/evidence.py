"""Evidence of derived statements: citations, coverage, flags of groups, structuring signals and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of X10: the form of an article, the form of a law's name before it, and how far before it that may begin.
ARTICLE = r"제\s*(\d+)\s*조(?:\s*의\s*(\d+))?"
LAW_NAME = r"([가-힣A-Za-z0-9()ㆍ·]+(?:\s[가-힣A-Za-z0-9()ㆍ·]+){0,6}?(?:법률|시행령|시행규칙|법|규칙|조례|규정))\s*$"
LOOK_BACK, REMOVED = 50, "[미검증 인용 제거]"
#: Fixed values of X09.
LAW_SITE, LAW_KIND, ORDINANCE_KIND = "https://www.law.go.kr/", "법령", "자치법규"
#: Fixed values of X23, W24 and X24: levels from low to high.
URGENCY, PRIORITY = ("낮음", "보통", "높음", "긴급"), ("보통", "급함", "매우급함")
#: Fixed values of N63: units that may follow a number.
UNITS = "세대|호|개동|동|개|명|원|%"
#: Fixed values of A55: location states from the worst.
LOCATION_STATES = ("conflict", "ambiguous", "missing", "nearby", "exact")


def _blankless(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def citation_problems(citations: DataFrame, contexts: DataFrame, most: int = 200) -> DataFrame:
    """Citations (chunk_id, case_id, snippet) with their problem: unknown (no context of that chunk and case, or a blank id), long (a snippet over `most` letters), else null."""
    known = contexts.select(_blankless("chunk_id").alias("_k"), _blankless("case_id").alias("_c")).where("_k <> '' and _c <> ''").distinct().withColumn("_known", F.lit(True))
    own = citations.withColumn("_k", _blankless("chunk_id")).withColumn("_c", _blankless("case_id")).join(known, ["_k", "_c"], "left")
    return own.withColumn("problem", F.when(F.col("_known").isNull(), "unknown").when(F.length(_blankless("snippet")) > most, "long")).drop("_k", "_c", "_known")


def kept_citations(citations: DataFrame, contexts: DataFrame, first: int = 3, most: int = 200) -> DataFrame:
    """Citations (qid, pos, chunk_id, case_id, snippet) that fit a context of the same columns, blanks filled from it, numbered by ref_id.

    A query without one that fits gets its first contexts. Of contexts of one chunk the last counts. Answers hold few citations, so numbering by query is small.
    """
    cols = ["qid", "pos", "chunk_id", "case_id", "snippet"]
    by_query = Window.partitionBy("qid")
    heads = contexts.withColumn("_n", F.row_number().over(by_query.orderBy("pos"))).where(F.col("_n") <= first)
    asked = citations.select(*cols, F.lit(0).alias("_tier")).unionByName(heads.select(*cols, F.lit(1).alias("_tier"))).where(F.coalesce("chunk_id", F.lit("")) != "")
    known = contexts.groupBy("qid", "chunk_id").agg(F.max_by(F.struct("case_id", "snippet"), "pos").alias("_x"))
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("_x")[c], F.lit(""))
    met = asked.join(known, ["qid", "chunk_id"]).select("qid", "pos", "chunk_id", filled("case_id").alias("case_id"), F.substring(F.trim(filled("snippet")), 1, most).alias("snippet"), "_tier", F.coalesce(F.col("_x")["case_id"], F.lit("")).alias("_case"))
    fit = met.where("case_id <> '' and snippet <> '' and (_case = '' or case_id = _case)")
    best = fit.withColumn("_best", F.min("_tier").over(by_query)).where("_tier = _best")
    return best.select("qid", F.row_number().over(by_query.orderBy("pos")).alias("ref_id"), "chunk_id", "case_id", "snippet")


def segment_evidence(segments: DataFrame, contexts: DataFrame, most: int = 4, k: int = 2) -> DataFrame:
    """For each of the first `most` segments (qid, seg from 0, terms) the k contexts (qid, pos, terms, score) of the largest number of shared terms plus score, ties to the earlier.

    Both sides meet on (qid, term), so no segment meets a context that shares nothing with it.
    """
    asked = segments.where(F.col("seg") < most)
    a = asked.select("qid", "seg", F.explode(F.array_distinct("terms")).alias("term"))
    b = contexts.select("qid", "pos", "score", F.explode(F.array_distinct("terms")).alias("term"))
    hits = a.join(b, ["qid", "term"]).groupBy("qid", "seg", "pos").agg((F.count("*") + F.max(F.coalesce("score", F.lit(0.0)))).alias("_s"))
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy("qid", "seg").orderBy(F.desc("_s"), "pos"))).where(F.col("_r") <= k)
    found = ranked.groupBy("qid", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "pos"))), lambda x: x["pos"]).alias("evidence"))
    out = asked.select("qid", "seg").join(found, ["qid", "seg"], "left")
    return out.select("qid", "seg", F.when(F.col("evidence").isNull(), "no_evidence").otherwise("grounded").alias("status"), F.coalesce("evidence", F.array().cast("array<long>")).alias("evidence"))


def union_of_ids(*lists: Column) -> Column:
    """The distinct ids of all lists in their order, trimmed, without blank ones; a null list is empty."""
    whole = F.concat(*[F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")) for c in lists])
    return F.array_distinct(F.filter(F.transform(whole, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def repaired_ids(own: Column, matched: Column, valid: Column, most: int = 3) -> Column:
    """An action's own valid ids, else the first `most` valid ones of its matching labels; empty where the action has to go."""
    kept = F.array_intersect(own, valid)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.array_intersect(matched, valid), 1, most))


def review_reasons(risk: Column, priority: Column, grounding: Column, least: float = 0.8) -> Column:
    """Why a person has to look: the type of risk, a high priority, weak grounding; empty if nothing holds."""
    return F.array_compact(F.array(F.when(risk, "risk_type"), F.when(priority.isin("HIGH", "CRITICAL"), "high_priority"), F.when(grounding < least, f"grounding_below_{least}")))


def dashboard_counts(alerts: DataFrame, insights: DataFrame) -> DataFrame:
    """One row of counts over alerts (status, severity) and insights (priority, review, linked: an array of alert ids)."""
    a = alerts.agg(F.count("*").alias("alerts"), F.count_if(F.col("status").isin("ACTIVE", "UPDATED")).alias("active"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    b = insights.agg(F.count("*").alias("insights"), F.count_if(F.col("priority").isin("HIGH", "CRITICAL")).alias("high"), F.count_if("review").alias("to_review"), F.count_if(F.size("linked") > 0).alias("linked"))
    return a.join(F.broadcast(b))  # one row each


def group_records(members: DataFrame, pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per group of members (group, id, ts) its size, first and last time, the mean score of its pairs (group, score), and the number of distinct pieces of evidence (group, kind, ids, value), whatever the order of ids."""
    base = members.groupBy("group").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    score = pairs.groupBy("group").agg(F.round(F.avg("score"), 4).alias("score"))
    kept = evidence.select("group", "kind", F.array_sort("ids").alias("ids"), F.col("value").cast("string").alias("value")).distinct().groupBy("group").agg(F.count("*").alias("n_evidence"))
    return base.join(score, "group", "left").join(kept, "group", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def pair_summary(pairs: DataFrame, by: str, parts: Sequence[str], state: str) -> DataFrame:
    """Per group the mean of each part (a missing one counts as 0), four places, and the worst location state; missing if none is known."""
    worst = F.min(F.array_position(F.array(*[F.lit(s) for s in LOCATION_STATES]), F.col(state)))
    own = pairs.withColumn(state, F.when(F.col(state).isin(*LOCATION_STATES), F.col(state)))
    means = own.groupBy(by).agg(*[F.round(F.avg(F.coalesce(F.col(p), F.lit(0.0))), 4).alias(p) for p in parts], worst.alias("_w"))
    return means.withColumn(state, F.coalesce(F.get(F.array(*[F.lit(s) for s in LOCATION_STATES]), F.col("_w").cast("int") - 1), F.lit("missing"))).drop("_w")


def pair_flags(state: Column, same_type: Column, hours: Column, semantic: Column, entity: Column, segment: Column) -> Column:
    """What speaks against merging a pair, in a fixed order."""
    vague = state.isin("ambiguous", "missing")
    return F.array_compact(F.array(
        F.when(state == "conflict", "LOCATION_MISMATCH"), F.when(vague, "LOCATION_AMBIGUOUS"), F.when(~same_type, "REQUEST_TYPE_MISMATCH"), F.when(hours > 72, "TIME_WINDOW_TOO_WIDE"),
        F.when((semantic >= 0.78) & (entity == 0) & vague & (segment < 0.2), "SEMANTIC_ONLY_MATCH"),
    ))


def group_flags(events: DataFrame, by: str, rights: Sequence[str]) -> DataFrame:
    """Per group of events (department, kind, text, unsafe, n_segments, n_signals) what speaks against merging it. Only counts leave a group, so a large one is cheap."""
    any_of = lambda c: F.max(F.coalesce(c, F.lit(False)))
    place = F.nullif(F.regexp_replace("department", r"\s", ""), F.lit(""))
    low, high = F.min(place), F.max(place)
    legal = F.exists(F.array(*[F.lit(w) for w in rights]), lambda w: F.contains("text", w))
    marks = events.groupBy(by).agg(
        F.when(low != high, "DEPARTMENT_MISMATCH").alias("_a"),
        F.when(any_of(F.col("kind") == "safety_action") & any_of(F.col("kind").isin("inquiry", "guidance", "other")), "SAFETY_AND_INCONVENIENCE_MIXED").alias("_b"),
        F.when(any_of(legal), "LEGAL_RIGHTS_OR_DEADLINE_RISK").alias("_c"), F.when(any_of(F.col("unsafe")), "PII_RISK").alias("_d"),
        F.when(any_of(F.col("n_segments") > 1), "MULTI_INTENT_SEGMENTS").alias("_e"), F.when(any_of(F.col("n_signals") < 3), "LOW_EVIDENCE").alias("_f"),
    )
    return marks.select(by, F.array_compact(F.array("_a", "_b", "_c", "_d", "_e", "_f")).alias("flags"))


def record_quality(signals: Column, letters: Column, entities: Column, specificity: Column, segments: Column, unsafe: Column) -> Column:
    """How well a record can stand for its group, from 0 to 1."""
    part = lambda c, full: F.least(F.coalesce(c, F.lit(0)) / F.lit(float(full)), F.lit(1.0))
    total = 0.35 * part(signals, 8) + 0.25 * part(letters, 600) + 0.15 * part(entities, 6) + 0.15 * specificity + 0.10 * part(segments, 4) - F.when(unsafe, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def request_specificity(text: Column, markers: Sequence[str]) -> Column:
    """Longer requests and those with a marker word are more specific."""
    marked = F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))
    return F.least(F.lit(1.0), F.length(text) / 80.0 * 0.6 + F.when(marked, 1.0).otherwise(0.4) * 0.4)


def best_records(rows: DataFrame, by: str, quality: str, ts: str, key: str) -> DataFrame:
    """Per group the row of the best quality, ties to the earlier, then to the smaller key; an aggregate, no sort."""
    return rows.groupBy(by).agg(F.min_by(F.struct(key, quality), F.struct(-F.col(quality), F.col(ts), F.col(key))).alias("x")).select(by, F.col(f"x.{key}").alias(key), F.round(f"x.{quality}", 4).alias(quality))


def target_coverage(targets: DataFrame, relations: DataFrame, gaps: DataFrame) -> DataFrame:
    """Each target (ref) with the sorted ids of the relations (id, refs, ok) that name it and are ok, and the sorted reasons of its gaps (ref, reason)."""
    named = relations.where("ok").select("id", F.explode(F.array_distinct("refs")).alias("ref")).groupBy("ref").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    told = gaps.groupBy("ref").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    out = targets.join(named, "ref", "left").join(told, "ref", "left")
    return out.select("ref", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",").alias("ids"), F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), ",").alias("reasons"))


def best_combination(rows: DataFrame, recall: str, mrr: str, latency: str) -> DataFrame:
    """The setting of the best recall, then reciprocal rank, then the lowest latency."""
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(recall), F.col(mrr), -F.col(latency))).alias("x")).select("x.*")


def top_values(df: DataFrame, columns: Sequence[str], k: int, hidden: Sequence[str] = ()) -> DataFrame:
    """The k most frequent non-blank values of each column (ties to the smaller value); hidden columns show 12 digits of the value's SHA-256."""
    shown = lambda c: F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 12) if c in hidden else F.col(c).cast("string")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.when(_blankless(c) != "", shown(c)).alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def missing_rows(required: DataFrame, claims: DataFrame, key: str, body: str) -> DataFrame:
    """Keys of required rows without a claim, with their body; keys whose required rows differ are in conflict and are left out."""
    agreed = required.groupBy(key).agg(F.min(body).alias(body), F.countDistinct(body).alias("_n")).where("_n = 1").drop("_n")
    return agreed.join(claims.select(key).distinct(), key, "left_anti")


def uses_version(assessments: DataFrame, evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """Assessments (id, refs) with whether one of their refs belongs to a changed version; a ref that evidence (ref, version) doesn't know counts as used, to be safe."""
    known = evidence.join(changed.select("version", F.lit(True).alias("_hit")), "version", "left").groupBy("ref").agg(F.max(F.coalesce("_hit", F.lit(False))).alias("_hit"))
    used = assessments.select("id", F.explode("refs").alias("ref")).join(known, "ref", "left").groupBy("id").agg(F.max(F.coalesce("_hit", F.lit(True))).alias("used"))
    return assessments.select("id").join(used, "id", "left").withColumn("used", F.coalesce("used", F.lit(False)))


def available_rows(rows: DataFrame, names: DataFrame, available: DataFrame) -> DataFrame:
    """Rows (id, pos, needs) all of whose needs are available (id), under their representative (names: id, rep); of one representative the first."""
    short = rows.select("id", F.explode("needs").alias("need")).join(available.select(F.col("id").alias("need")), "need", "left_anti").select("id").distinct()
    kept = rows.join(short, "id", "left_anti").join(names, "id", "left")
    return kept.groupBy(F.coalesce("rep", "id").alias("rep")).agg(F.min_by("id", "pos").alias("id"))


def literal(text: Column, kind: str) -> Column:
    """Struct (value, unit, ok) of a literal that has to be a month, number, integer, date, boolean or string; nothing is guessed."""
    own = F.trim(text)
    unit = F.lit(None).cast("string")
    if kind == "month":
        y, m = F.regexp_extract(own, r"^(\d{4})[.\-/]?(\d{2})$", 1), F.regexp_extract(own, r"^(\d{4})[.\-/]?(\d{2})$", 2)
        value = F.when((m >= "01") & (m <= "12") & (y > "0000"), F.concat_ws("-", y, m))
    elif kind in ("number", "integer"):
        shape = rf"^([+-]?(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?)\s*({UNITS})?$"
        bare = F.replace(F.regexp_extract(own, shape, 1), F.lit(","), F.lit(""))
        fits = own.rlike(shape) & (~F.contains(bare, F.lit(".")) if kind == "integer" else F.lit(True))
        value, unit = F.when(fits, bare), F.when(fits, F.nullif(F.regexp_extract(own, shape, 2), F.lit("")))
    elif kind == "date":
        value = F.when(own.rlike(r"^\d{4}[.\-/]\d{2}[.\-/]\d{2}$"), F.date_format(F.try_to_timestamp(F.regexp_replace(own, "[./]", "-"), F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))
    elif kind == "boolean":
        value = F.when(F.lower(own).isin("true", "false"), F.lower(own))
    else:
        value = own
    return F.struct(value.alias("value"), unit.alias("unit"), value.isNotNull().alias("ok"))


def floor_mean(*scores: Column) -> Column:
    """The floor of the mean of the known scores; null if none is known."""
    known = F.array_compact(F.array(*[s.cast("double") for s in scores]))
    return F.when(F.size(known) > 0, F.floor(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).cast("int"))


def report_summary(cases: DataFrame, scores: Sequence[str], level: str) -> DataFrame:
    """The number of cases, the mean of each score over those that have it (none: 0), two places, and the counts of each level as an array of (level, n)."""
    means = cases.agg(F.count("*").alias("n_cases"), *[F.coalesce(F.round(F.avg(s), 2), F.lit(0.0)).alias(f"mean_{s}") for s in scores])
    counts = cases.groupBy(F.coalesce(level, F.lit("unknown")).alias("level")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws("=", "level", "n"))).alias("levels"))
    return means.join(F.broadcast(counts.select(F.array_join("levels", ";").alias("levels"))))  # one row each


def ranked_terms(terms: DataFrame, key: str, generic: Sequence[str], limit: int = 8) -> DataFrame:
    """Terms (key, term, weight) by their best weight, longer ones first (then by the term), without generic and one-letter ones and without parts of terms taken before; `limit` of them.

    A key's terms come from fixed word lists, so a row's array is bounded by those lists.
    """
    own = terms.withColumn("term", F.trim("term")).where((F.length("term") >= 2) & ~F.col("term").isin(*generic)).groupBy(key, "term").agg(F.max("weight").alias("w"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), (-F.length("term")).alias("n"), "term")))
    listed = own.groupBy(key).agg(F.transform(order, lambda x: x["term"]).alias("all"))
    take = lambda got, t: F.when((F.size(got) < limit) & ~F.exists(got, lambda g: F.contains(g, t)), F.concat(got, F.array(t))).otherwise(got)
    return listed.select(key, F.aggregate("all", F.array().cast("array<string>"), take).alias("terms"))


def higher(a: Column, b: Column, order: Sequence[str] = URGENCY) -> Column:
    """The higher of two levels, the first on ties; an unknown one counts as the lowest."""
    at = lambda c: F.greatest(F.lit(1), F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(1)))
    return F.when(at(a) >= at(b), a).otherwise(b)


def law_url(name: Column, article: Column, ordinance: Column) -> Column:
    """The public address of a law and its article, with blanks as %20 and slashes as they are."""
    quote = lambda c: F.replace(F.replace(F.replace(F.url_encode(F.trim(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))
    head = F.concat(F.lit(LAW_SITE), F.when(ordinance, ORDINANCE_KIND).otherwise(LAW_KIND), F.lit("/"), quote(F.coalesce(name, F.lit(""))))
    return F.when(F.coalesce(article, F.lit("")) != "", F.concat(head, F.lit("/"), quote(article))).otherwise(head)


def legal_citations(text: Column, known: Sequence[str] = ()) -> Column:
    """An array of (law, article, start, stop) for each article named in a text, places from 0.

    The law is the longest known name in the 50 letters before the article, else a name that ends right before it, else empty; null texts have none.
    """
    own = F.coalesce(text, F.lit(""))
    hits = F.regexp_extract_all(own, F.lit(ARTICLE), F.lit(0))
    gaps = F.split(own, ARTICLE, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,raw:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        return F.struct((at + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), x["hit"].alias("raw")))).alias("out"))

    places = F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")), begin, step)["out"]

    # Each stage binds what the next one uses several times: inside a lambda nothing else keeps it from being made again
    seen = F.transform(places, lambda x: F.struct(x["at"].alias("at"), x["raw"].alias("raw"), F.substring(own, F.greatest(F.lit(0), x["at"] - LOOK_BACK) + 1, F.least(x["at"], F.lit(LOOK_BACK))).alias("before")))

    def named(x: Column) -> Column:
        names = [F.when(F.contains(x["before"], F.lit(n)), F.lit(n)) for n in sorted({n for n in known if n}, key=lambda n: (-len(n), n))]
        return F.struct(x["at"].alias("at"), x["raw"].alias("raw"), x["before"].alias("before"), F.coalesce(*names, F.lit("")).alias("listed"))

    def tailed(x: Column) -> Column:
        law = F.when(x["listed"] != "", x["listed"]).otherwise(F.regexp_extract(x["before"], LAW_NAME, 1))
        return F.struct(x["at"].alias("at"), x["raw"].alias("raw"), x["before"].alias("before"), x["listed"].alias("listed"), law.alias("law"), F.regexp_extract(x["raw"], ARTICLE, 1).alias("number"), F.regexp_extract(x["raw"], ARTICLE, 2).alias("part"))

    def describe(x: Column) -> Column:
        before, law = x["before"], x["law"]
        from_right = F.position(F.reverse(law), F.reverse(before))  # the last place of the name
        stop_of_law = F.when(x["listed"] != "", F.length(before) - from_right + 1).otherwise(F.length(F.rtrim(before)))
        start = F.when(law == "", x["at"]).otherwise(x["at"] - F.length(before) + stop_of_law - F.length(law))
        plain = lambda n: F.regexp_replace(n, "^0+(?=\\d)", "")
        article = F.concat(F.lit("제"), plain(x["number"]), F.lit("조"), F.when(x["part"] != "", F.concat(F.lit("의"), plain(x["part"]))).otherwise(""))
        return F.struct(law.alias("law"), article.alias("article"), start.cast("int").alias("start"), (x["at"] + F.length(x["raw"])).cast("int").alias("stop"))

    return F.transform(F.transform(F.transform(seen, named), tailed), describe)


def without_spans(text: Column, spans: Column) -> Column:
    """The text with a mark in the place of each span (start, stop); spans that overlap share one mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(REMOVED))
        return F.struct(F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    done = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def lexicon_refs(text: Column, lexicon: Mapping[str, Sequence[str]], top: int = 4) -> Column:
    """An array of (name, confidence, evidence) of names with a trigger in the text, by confidence, then by the number of shown triggers, then in the lexicon's order."""
    rows = []
    for i, (name, words) in enumerate(lexicon.items()):
        met = F.filter(F.array(*[F.lit(w) for w in dict.fromkeys(words)]), lambda w: F.contains(text, w))
        sure = F.round(F.least(F.lit(0.9), 0.45 + 0.15 * F.size(met)), 2)
        shown = F.slice(met, 1, 3)
        rows.append(F.when(F.size(met) > 0, F.struct((-sure).alias("o"), (-F.size(shown)).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name"), sure.alias("confidence"), shown.alias("evidence"))))
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*rows))), 1, top), lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence"), x["evidence"].alias("evidence")))


def canonical_objects(text: Column, lexicon: Mapping[str, Sequence[str]], exclusions: Mapping[str, str] | None = None) -> Column:
    """An array of (text, confidence, evidence) of objects of which the text has a surface that isn't only part of an excluded expression; a name that stands there itself is surer."""
    rows = []
    for i, (name, surfaces) in enumerate(lexicon.items()):
        found = F.lit(None).cast("string")
        for surface in reversed(surfaces):
            rest = F.regexp_replace(text, exclusions[surface], "") if exclusions and surface in exclusions else text
            found = F.when(F.contains(rest, F.lit(surface)), F.lit(surface)).otherwise(found)
        span = F.trim(F.regexp_substr(text, F.concat(F.lit(r"[0-9A-Za-z가-힣]{0,8}\s?\Q"), found, F.lit(r"\E"))))
        sure = F.when(F.contains(text, F.lit(name)), 0.9).otherwise(0.85)
        rows.append(F.when(found.isNotNull(), F.struct((-sure).alias("o"), F.lit(i).alias("i"), F.lit(name).alias("text"), sure.alias("confidence"), span.alias("evidence"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*rows))), lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["evidence"].alias("evidence")))


def danger_signals(text: Column, patterns: Sequence[str], negation: str, tail: int = 14) -> Column:
    """The distinct first matches of the patterns, in their order, but for those that what follows (`tail` letters) negates."""
    own = F.coalesce(text, F.lit(""))
    spans = []
    for p in patterns:
        span = F.regexp_substr(own, F.lit(p))
        after = F.substring(own, F.position(span, own) + F.length(span), F.lit(tail))
        spans.append(F.when(span.isNotNull() & ~F.concat(span, after).rlike(negation), span))
    return F.array_distinct(F.array_compact(F.array(*spans)))


def share_of_words(text: Column, words: Sequence[str], full: int) -> Column:
    """How many of the words stand in the text, as a share of `full`, at most 1."""
    return F.least(F.lit(1.0), F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))) / float(full))


def urgency(signals: Column, hazards: Column, floor: Column) -> tuple[Column, Column]:
    """The level by rules and the final level: two signals of danger are urgent whatever else holds, and no level is below the category's floor (null: none)."""
    n = F.size(signals)
    base = F.when(n >= 2, URGENCY[2]).when((n > 0) | (hazards > 0), URGENCY[1]).otherwise(URGENCY[0])
    level = F.when(n >= 2, URGENCY[3]).otherwise(base)
    return base, F.when(floor.isNull(), level).otherwise(higher(level, floor))


def sla_priority(hours: Column, level: Column, hazard: Column) -> Column:
    """The priority of a category by its hours to answer, else by its level, one step higher with a hazard."""
    base = F.when(hours <= 24, 2).when(hours <= 72, 1).when(hours.isNotNull(), 0).when(F.lower(level) == "critical", 2).when(F.lower(level) == "high", 1).otherwise(0)
    return F.get(F.array(*[F.lit(p) for p in PRIORITY]), F.least(F.lit(2), base + F.coalesce(hazard.cast("int"), F.lit(0))))


def sigmoid(score: Column) -> Column:
    """A score between 0 and 1, four places; null, NaN and infinite scores give 0.5."""
    own = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)
    return F.round(1.0 / (1.0 + F.exp(-own)), 4)


def stated_confidence(value: Column) -> Column:
    """Low, medium, high or a number as text, from 0 to 1; anything else is 0.5."""
    own = F.lower(F.trim(value.cast("string")))
    number = own.try_cast("double")
    number = F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    return F.coalesce(F.when(own == "low", 0.35).when(own == "medium", 0.65).when(own == "high", 0.85), number, F.lit(0.5))


def epoch_of(text: Column, zone: str = "+09:00") -> Column:
    """Seconds of an ISO time; one without a zone is taken in `zone`; 0 for what isn't a time."""
    own = F.trim(text)
    full = F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(own, F.lit("T00:00:00"))).otherwise(own)
    zoned = F.when(full.rlike(r"(Z|[+-]\d{2}:\d{2})$"), full).otherwise(F.concat(full, F.lit(zone)))
    return F.coalesce(F.unix_timestamp(F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}"), zoned).try_cast("timestamp")), F.lit(0)).cast("long")


def insight_priority(count: Column, surge: Column, kind: Column, repeat: Column, regional: Column, linked: Column, full: Mapping[str, float], bands: tuple[float, float] = (0.85, 0.70)) -> tuple[Column, Column]:
    """The weighted score and its priority, raised where danger or a linked alert asks for it. `full` names the values of count, repeat and regional that count as 1."""
    part = lambda c, f: F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0)) / float(f))
    hot = kind.isin("SAFETY_RISK_SIGNAL", "HOTSPOT_RESPONSE_REQUIRED")
    slow = kind.isin("PROCESS_DELAY_RISK", "DEPARTMENT_WORKLOAD_BOTTLENECK")
    score = F.round(0.25 * part(count, full["count"]) + 0.20 * part(surge, 3.0) + 0.20 * hot.cast("double") + 0.15 * part(repeat, full["repeat"]) + 0.10 * part(regional, full["regional"]) + 0.10 * slow.cast("double"), 6)
    plain = F.when(score >= bands[0], "CRITICAL").when(score >= bands[1], "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")
    raised = F.when((kind == "SAFETY_RISK_SIGNAL") & linked & plain.isin("LOW", "MEDIUM"), "HIGH").when(hot & (plain == "LOW"), "MEDIUM").otherwise(plain)
    return score, raised


def insight_confidence(cohesion: Column, coverage: Column, grounding: Column, regions: Column, measured: Column, least: float = 0.6) -> Column:
    """Weighted confidence, four places; weak grounding takes three tenths of it."""
    total = 0.35 * F.coalesce(cohesion, F.lit(0.75)) + 0.25 * F.least(F.lit(1.0), coverage) + 0.20 * grounding + 0.10 * F.when(measured, 1.0).otherwise(0.7) + 0.10 * F.least(F.lit(1.0), F.greatest(regions, F.lit(1)) / 3.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * F.when(grounding < least, 0.7).otherwise(1.0))), 4)


def grounding_score(kept: Column, removed: Column, supported: Column, drafted: Column) -> Column:
    """1 less what is lost by having no action left, by removed terms, and by drafted actions without support."""
    lost = F.when(kept == 0, 0.5).otherwise(0.0) + F.least(F.lit(0.35), 0.1 * removed) + 0.2 * (1 - supported / F.greatest(drafted, F.lit(1)).cast("double"))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - lost)), 4)


def packed_context(hits: DataFrame, top_k: int, budget: int, most_chunks: int = 8, most_chars: int = 320, least: int = 40) -> DataFrame:
    """Per query the first hits (qid, pos, chunk_id, case_id, snippet) that fit a budget of letters, each cut so that `least` letters stay for every later place.

    Gives qid, n_kept, used, n_cut and n_dropped. Hits without an id or text are dropped. A query's hits are the few that a search returns, so its array is small.
    """
    places = max(1, min(most_chunks, max(1, top_k)))
    text = F.trim(F.regexp_replace(F.coalesce("snippet", F.lit("")), r"\s+", " "))
    good = (_blankless("chunk_id") != "") & (_blankless("case_id") != "") & (text != "")
    listed = hits.groupBy("qid").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(good, text).alias("text")))), lambda x: x["text"]).alias("texts"))
    zero = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("used"), F.lit(0).alias("cut"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        left = budget - acc["used"]
        room = F.least(F.lit(most_chars), F.greatest(F.lit(least), left - least * F.greatest(F.lit(0), places - acc["kept"] - 1)))
        full = acc["full"] | (x.isNotNull() & (acc["kept"] < places) & (left < least))
        takes = x.isNotNull() & (acc["kept"] < places) & ~full
        long = F.length(x) > room
        size = F.when(long, F.length(F.rtrim(F.substring(x, F.lit(1), room - 3))) + 3).otherwise(F.length(x))
        add = lambda c: F.when(takes, c).otherwise(0)
        return F.struct((acc["kept"] + add(F.lit(1))).alias("kept"), (acc["used"] + add(size)).alias("used"), (acc["cut"] + add(long.cast("int"))).alias("cut"), full.alias("full"))

    return listed.select("qid", "n", F.aggregate("texts", zero, step).alias("x")).select("qid", F.col("x.kept").alias("n_kept"), F.col("x.used").alias("used"), F.col("x.cut").alias("n_cut"), (F.col("n") - F.col("x.kept")).alias("n_dropped"))


def circled_clauses(text: Column) -> Column:
    """An array of (start, body, is_target), cut before each circled number; a text with fewer than two of them is one clause."""
    parts = F.when(F.size(F.regexp_extract_all(text, F.lit("[①-⑳]"), F.lit(0))) >= 2, F.filter(F.split(text, "(?=[①-⑳])", -1), lambda p: p != "")).otherwise(F.array(text))
    many = F.size(parts) > 1
    start = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p))
    return F.transform(parts, lambda p, i: F.struct(start(i).alias("start"), p.alias("body"), (~many | p.rlike("^[①-⑳]")).alias("is_target")))


def aspects(rows: DataFrame, by: str, key: str, text: str, confidence: str, has_span: str, catalogue: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per group and aspect of the catalogue the number of records that name it and a confidence of the mean, the share of the group's records, and whether a span is known."""
    found = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)), F.lit(name)) for name, words in catalogue.items()]))
    total = rows.groupBy(by).agg(F.countDistinct(key).alias("_t"))
    got = rows.select(by, key, confidence, has_span, F.explode(found).alias("aspect")).groupBy(by, "aspect").agg(F.countDistinct(key).alias("n"), F.avg(confidence).alias("_c"), F.max(F.col(has_span).cast("int")).alias("_s"))
    sure = 0.70 * F.col("_c") + 0.20 * F.least(F.lit(1.0), F.col("n") / F.col("_t")) + 0.10 * F.col("_s")
    return got.join(total, by).select(by, "aspect", "n", F.round(sure, 4).alias("confidence"))


def labelled_records(labels: DataFrame, records: DataFrame, key: str, text: str) -> DataFrame:
    """Labels with the text of their record; labels without a record or with a blank text fall out."""
    return labels.join(records.select(key, text).where(F.trim(text) != ""), key)


def flat_metadata(records: DataFrame, key: str) -> DataFrame:
    """Key and one JSON text of the other columns, lists joined by |, nulls left out."""
    cols = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in records.dtypes if c != key]
    return records.select(key, F.to_json(F.struct(*cols)).alias("metadata"))
