"""Text queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import text as X
from ..operators import windows as W
from .base import Registry, read

REGISTRY = Registry()
add = REGISTRY.add

CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '_x000D_', '', 'g'), '\r\n?', chr(10), 'g'), '\t', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""
TOK = "regexp_extract_all(lower(text), '[A-Za-z0-9가-힣]+')"


def _masked_sql(inner: str, rule) -> str:
    """RE2 has no look-around: the neighbours are matched and put back, twice, as two hits may share one."""
    label, before, body, after = rule
    head, tail = (f"(^|{before.replace('[', '[^', 1)})" if before else "()"), (f"({after.replace('[', '[^', 1)}|$)" if after else "()")
    for _ in range(2):
        inner = f"regexp_replace({inner}, '{head}{body}{tail}', '\\1[REDACTED:{label}]\\2', 'g')"
    return inner


def _mask(inner: str) -> str:
    for rule in C.PII_RULES:
        inner = _masked_sql(inner, rule)
    return inner


@add(f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def clean_text_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", C.clean_text("text").alias("clean"))


@add(f"SELECT doc_id, {_mask('text')} AS masked FROM documents")
def mask_pii_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", C.mask_pii("text").alias("masked"))


@add("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{r[0]}' AS label, count(*) AS n FROM m WHERE contains(masked, '[REDACTED:{r[0]}]')" for r in C.PII_RULES).join([f"WITH m AS MATERIALIZED (SELECT {_mask('text')} AS masked FROM documents) ", ""]) + ") WHERE n > 0")
def pii_label_counts(spark, d):
    # Through an array of one, so the masked text is made once for all labels
    own = read(spark, d, "documents").select(F.explode(F.transform(F.array(C.mask_pii("text")), lambda m: C.pii_labels("text", m))).alias("labels"))
    return own.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


NORMAL = r"regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^a-z0-9가-힣\s]+', '', 'g')"


@add(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORMAL}")
def exact_dedup_documents(spark, d):
    sig = read(spark, d, "documents").select("doc_id", F.sha2(C.dedup_form("text"), 256).alias("sig"))
    return sig.groupBy("sig").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@add(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS c FROM documents), n AS (SELECT doc_id, c, length(c) AS n FROM t WHERE length(c) > 0)
SELECT doc_id, CAST(i AS INT) AS chunk_no, substr(c, i * 400 + 1, 500) AS chunk FROM (SELECT doc_id, c, unnest(range(0, CASE WHEN n <= 500 THEN 1 ELSE CAST(ceil((n - 500) / 400.0) AS INT) + 1 END)) AS i FROM n)""")
def chunk_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(C.chunks("text")).alias("chunk_no", "chunk"))


@add(f"""WITH t AS (SELECT doc_id, {TOK} AS t FROM documents),
b AS (SELECT doc_id, t, list_transform(t, lambda x: CAST('0x' || substr(sha1(x), 1, 2) AS INT) % 16) AS k FROM t),
v AS (SELECT doc_id, list_transform(range(0, 16), lambda i: len(list_filter(k, lambda y: y = i)) * 0.08::DOUBLE) AS v FROM b),
m AS (SELECT doc_id, v, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT doc_id, CAST(b AS INT) AS bucket, round(CASE WHEN n > 0 THEN v[b + 1] / n ELSE 0 END, 6) AS weight FROM m, range(0, 16) r(b)""")
def hash_embedding(spark, d):
    vectors = X.hash_embedding(read(spark, d, "documents"), "doc_id", "text")
    return vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))


@add(f"""WITH t AS (SELECT doc_id, list_distinct({TOK}) AS t FROM documents), q AS (SELECT item_id, list_distinct({TOK}) AS t FROM benchmark)
SELECT item_id, doc_id, round(len(list_intersect(q.t, t.t)) / CAST(len(q.t) + len(t.t) - len(list_intersect(q.t, t.t)) AS DOUBLE), 6) AS jaccard FROM q, t WHERE len(list_intersect(q.t, t.t)) / CAST(len(q.t) + len(t.t) - len(list_intersect(q.t, t.t)) AS DOUBLE) >= 0.2""")
def token_set_matches(spark, d):
    side = lambda name, key: read(spark, d, name).select(key, F.array_distinct(C.tokens("text")).alias("t"))
    return X.set_join(side("benchmark", "item_id"), side("documents", "doc_id"), "item_id", "doc_id", 0.2)


TOPICS = {"english": (["the", "and", "ing"], 2.0), "german": (["der", "und", "sch"], 2.0), "french": (["les", "que", "eau"], 2.0), "spanish": (["ción", "ado", "los"], 2.0), "secret": (["token", "@"], 1.0)}


def _topic_case(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)


@add("WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS topic, {i} AS pos, ({_topic_case(w)}) * {v}::DOUBLE AS score FROM documents" for i, (k, (w, v)) in enumerate(TOPICS.items())) + """),
r AS (SELECT *, sum(score) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS second FROM s)
SELECT doc_id, CASE WHEN score > 0 THEN topic ELSE 'general' END AS topic, round(CASE WHEN total > 0 THEN score / total ELSE 0 END, 6) AS confidence, score - second < 1 AS ambiguous FROM r WHERE rn = 1""")
def topic_scores(spark, d):
    return X.topics(read(spark, d, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id", "text", TOPICS, margin=1.0)


@add("""SELECT doc_id, CAST(CASE WHEN length(text) > 2000 THEN 2 WHEN length(text) > 500 THEN 1 ELSE 0 END + least(2, length(text) - length(replace(text, chr(10), ''))) + CASE WHEN contains(text, '|') THEN 1 ELSE 0 END AS INT) AS points FROM documents""".replace("SELECT doc_id, CAST", "WITH p AS (SELECT doc_id, CAST", 1) + ") SELECT doc_id, points, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level FROM p")
def complexity_score(spark, d):
    return read(spark, d, "documents").select("doc_id", X.complexity("text").alias("points")).withColumn("level", C.band(F.col("points"), (4, "high"), (2, "medium"), rest="low"))


ROUTES = {"high": (20, 600), "medium": (10, 400), "low": (5, 200)}


@add("""WITH p AS (SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' ELSE 'low' END AS level FROM documents)
SELECT doc_id, level, CAST(CASE level WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END AS INT) AS k, CAST(CASE level WHEN 'high' THEN 600 WHEN 'medium' THEN 400 ELSE 200 END AS INT) AS snippet FROM p""")
def route_lookup(spark, d):
    level = C.band(F.col("n_chars"), (4001, "high"), (1001, "medium"), rest="low")
    own = read(spark, d, "documents").select("doc_id", level.alias("level"))
    pick = lambda i: F.create_map(*[F.lit(v) for k, r in ROUTES.items() for v in (k, r[i])])[F.col("level")]
    return own.select("doc_id", "level", pick(0).alias("k"), pick(1).alias("snippet"))


@add("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 50 THEN 'too_short' END, CASE WHEN length(text) > 20000 THEN 'too_long' END, CASE WHEN contains(text, '@') THEN 'has_address' END, CASE WHEN n_chars <> length(text) THEN 'bad_length' END, CASE WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'bad_lang' END, CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'has_card' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents""")
def quality_rules(spark, d):
    t = F.col("text")
    codes = X.error_codes([
        ("too_short", F.length(t) < 50), ("too_long", F.length(t) > 20000), ("has_address", F.contains(t, F.lit("@"))),
        ("bad_length", F.col("n_chars") != F.length(t)), ("bad_lang", ~F.col("lang").isin("en", "de", "fr", "es")), ("has_card", t.rlike("[0-9]{16}")),
    ])
    return read(spark, d, "documents").select("doc_id", F.array_join(codes, ",").alias("errors"))


@add("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id")
def dialogue_split(spark, d):
    return X.dialogues(read(spark, d, "conversations"))


@add(f"""WITH t AS (SELECT doc_id, {TOK} AS t FROM documents), w AS (SELECT doc_id, x, min(p) AS p FROM (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS p FROM t) WHERE length(x) >= 4 GROUP BY ALL)
SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM w) WHERE r <= 12 GROUP BY doc_id""")
def key_terms(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(X.key_terms("text", 12, 4), " ").alias("terms")).where("terms <> ''")


@add(f"""SELECT doc_id, round(CASE WHEN len(list_distinct({TOK})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({TOK}), ['the', 'and', 'of', 'der', 'die', 'les', 'que', 'los'])) / CAST(len(list_distinct({TOK})) AS DOUBLE) END, 6) AS ratio FROM documents""")
def stopword_overlap(spark, d):
    words = F.array(*[F.lit(w) for w in "the and of der die les que los".split()])
    return read(spark, d, "documents").select("doc_id", F.round(C.overlap_ratio(C.tokens("text"), words), 6).alias("ratio"))


@add("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 140) || ' … ' || substr(text, length(text) - 56, 57) END AS snippet FROM documents""")
def snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", X.snippet("text", 200).alias("snippet"))


@add("""SELECT doc_id, segment_no, segment FROM (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS segment_no, unnest(s) AS segment, len(s) AS n FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: length(x) >= 20) AS s FROM documents)) WHERE n >= 2""".replace("\\\\n", "\\n"))
def request_segments(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(X.segments("text")).alias("segment_no", "segment"))


@add("SELECT doc_id, substr(sha1(source || '|' || lang || '|' || CAST(doc_id AS VARCHAR)), 1, 12) AS id, lower(regexp_replace(source, '[^A-Za-z0-9]+', '-', 'g')) AS case_id FROM documents")
def content_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", C.content_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"), F.lower(F.regexp_replace("source", "[^A-Za-z0-9]+", "-")).alias("case_id"))


@add()
def html_blocks(spark, d):
    return X.html_blocks(read(spark, d, "pages"), "page_id", "html")


@add("WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, CASE WHEN n > 1 THEN source || '#' || n ELSE source END AS source FROM t")
def unique_source_ids(spark, d):
    return W.unique_ids(read(spark, d, "documents").select("doc_id", "source"), "source", [F.asc("doc_id")]).select("doc_id", "source")


@add("SELECT lang, doc_id, n_chars FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def longest_by_language(spark, d):
    own = read(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return W.top_k(own, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 5).select("lang", "doc_id", "n_chars")
