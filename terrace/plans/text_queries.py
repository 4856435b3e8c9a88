"""Queries for the text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.columns import n_rows

from terrace.functions import lexicons as lx
from terrace.operators import text as tx
from terrace.plans.registry import Tables, query
from terrace.session import spread


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(expr: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(p)})" for p in phrases) + ")"


def sql_in_class(name: str) -> str:
    listed, endings = tx.TERM_CLASSES[name]
    parts = [f"w IN ({', '.join(map(quoted, listed))})"] + [f"suffix(w, '{e}')" for e in endings]
    return "(" + " OR ".join(parts) + ")"


# The same white space as one class of the other engine's patterns.
_SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, NOT_LETTER = f"[{_SPACES}]+", f"[^a-z{_SPACES}]"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {quoted(SPACE)}), lambda w: w <> '')"


TERMS = f"list_filter(list_transform({sql_words('text')}, lambda w: lower(trim(w, {quoted(tx.EDGE_MARKS)}))), lambda w: w <> '')"
LETTERS = f"regexp_replace(lower(text), {quoted(NOT_LETTER)}, '', 'g')"
REPEATED = "|".join(chr(c) * 4 for c in range(ord("a"), ord("z") + 1))
BAD = f"""(regexp_matches(w, '{REPEATED}') OR (w NOT IN ({', '.join(map(quoted, lx.COMMON_WORDS))}) AND
    ((length(w) >= 4 AND regexp_matches(w, '^({"|".join(lx.MASH_PREFIXES)})')) OR (length(w) >= 5 AND NOT regexp_matches(w, '[aeiouy]')))))"""
SANITY = f"""CASE WHEN len({sql_words('text')}) < 4 THEN 'REJECT_INSUFFICIENT_LENGTH'
    WHEN len(list_filter({sql_words(LETTERS)}, lambda w: {BAD})) > 0 THEN 'REJECT_GIBBERISH_DETECTED'
    WHEN {sql_any('lower(text)', lx.LIVE_MARKERS)} AND ({sql_any('lower(text)', lx.MONTHLY_MARKERS)} OR {sql_any('lower(text)', lx.SENSOR_MARKERS)})
      THEN 'FLAG_CONTRADICTION' ELSE 'SANITY_PASSED' END"""


def class_size(name: str) -> str:
    return f"len(list_distinct(list_filter({TERMS}, lambda w: {sql_in_class(name)})))"


def documents(t: Tables) -> DataFrame:
    """Text rules are bound by the processor; a small input is spread over all cores first."""
    return spread(t.documents)


@query("n1_text_sanity", f"SELECT doc_id, source, {SANITY} AS reason FROM documents")
def _(t):
    return documents(t).select("doc_id", "source", tx.text_sanity("text").alias("reason"))


@query("n1_text_sanity_by_role", f"SELECT role, {SANITY} AS reason, count(*) AS text_count FROM conversations GROUP BY 1, 2")
def _(t):
    return t.conversations.groupBy("role", tx.text_sanity("text").alias("reason")).agg(n_rows().alias("text_count"))


# Marker pair fitted to the prose of the tables: English function words beside French ones.
FIRST, SECOND = (" the ", " and ", " of "), (" le ", " la ", " un ")


@query(
    "n2_contradiction_flag",
    f"""SELECT conv_id, turn, {sql_any('lower(text)', FIRST)} AND {sql_any('lower(text)', SECOND)} AS mixed,
          {sql_any('lower(text)', lx.LIVE_MARKERS)} AND ({sql_any('lower(text)', lx.MONTHLY_MARKERS)}
          OR {sql_any('lower(text)', lx.SENSOR_MARKERS)}) AS contradicts FROM conversations""",
)
def _(t):
    return t.conversations.select(
        "conv_id", "turn", tx.contradiction_flag("text", FIRST, SECOND).alias("mixed"), tx.contradiction("text").alias("contradicts")
    )


def tag_sql(tag: str) -> str:
    hit = sql_any("lower(text)", lx.TAG_PHRASES[tag])
    return f"({hit} OR regexp_matches(lower(text), '{lx.TAG_PATTERNS[tag]}'))" if tag in lx.TAG_PATTERNS else hit


@query(
    "n3_lexicon_tags",
    "SELECT tag, count(*) AS text_count FROM (SELECT unnest(list_filter(["
    + ", ".join(f"CASE WHEN {tag_sql(tag)} THEN '{tag}' END" for tag in lx.TAG_PHRASES)
    + f", CASE WHEN NOT {sql_any('lower(text)', lx.NO_HISTORY_PHRASES)} THEN 'needs_history' END"
    + "], lambda x: x IS NOT NULL)) AS tag FROM documents) GROUP BY 1",
)
def _(t):
    return tx.tag_counts(documents(t), "text")


TERM_ROWS = f"(SELECT doc_id, lang, unnest(list_distinct({TERMS})) AS term FROM documents)"
FREQUENT = f"""(SELECT lang AS tag, term FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r
    FROM {TERM_ROWS} GROUP BY 1, 2) WHERE r <= 20)"""


@query(
    "n3_data_lexicon_tags",
    f"""SELECT d.lang, f.tag, count(DISTINCT d.doc_id) AS text_count, count(*) AS hits FROM {TERM_ROWS} d JOIN {FREQUENT} f
        ON f.term = d.term GROUP BY 1, 2""",
)
def _(t):
    # Lexicon built from the texts themselves: the 20 most widespread terms of each language.
    lexicon = tx.frequent_terms(documents(t), ["doc_id"], "text", "lang", 20).select(F.col("lang").alias("tag"), "term")
    hits = tx.lexicon_tags(documents(t), ["doc_id", "lang"], "text", lexicon)
    return hits.groupBy("lang", "tag").agg(n_rows().alias("text_count"), F.sum("hits").alias("hits"))


NOUN_N = class_size("nouns")
LOW = "lower(text)"
COMPLETE = {
    "workload_intent": sql_any(LOW, lx.WORKLOAD_PHRASES),
    "entity_grain": f"((n >= 2 AND {sql_any(LOW, lx.GRAIN_PHRASES)}) OR n >= 3 OR {sql_any(LOW, lx.OFFERING_PHRASES)})",
    "temporal_policy": sql_any(LOW, lx.HISTORY_PHRASES),
    "lifecycle_funnel": sql_any(LOW, lx.LIFECYCLE_PHRASES),
    "relationship_multiplicity": f"(n >= 2 OR {sql_any(LOW, lx.RELATION_PHRASES)})",
}


@query(
    "n4_completeness_score",
    "SELECT doc_id, CAST("
    + " + ".join(f"CAST({v} AS INTEGER) * 20" for v in COMPLETE.values())
    + " AS DOUBLE) AS score, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN NOT {v} THEN '{k}' END" for k, v in COMPLETE.items())
    + f"], lambda x: x IS NOT NULL), ',') AS missing FROM (SELECT doc_id, text, {NOUN_N} AS n FROM documents)",
)
def _(t):
    scored = tx.completeness_score(documents(t), "text")
    return scored.select("doc_id", "score", F.array_join("missing", ",").alias("missing"))


@query(
    "n5_term_roles",
    f"""SELECT doc_id, CAST({class_size('nouns')} AS INTEGER) AS nouns, CAST({class_size('verbs')} AS INTEGER) AS verbs,
          CAST({class_size('adjectives')} AS INTEGER) AS adjectives FROM documents""",
)
def _(t):
    roles = tx.term_roles(documents(t), ["doc_id"], "text")
    return roles.select("doc_id", *[F.size(c).alias(c) for c in ("nouns", "verbs", "adjectives")])


@query(
    "n5_term_role_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS role, w AS term, count(*) AS text_count FROM (SELECT term AS w FROM {TERM_ROWS}) WHERE {sql_in_class(c)} GROUP BY 2"
        for c in tx.TERM_CLASSES
    ),
)
def _(t):
    return tx.term_role_counts(documents(t), ["doc_id"], "text")


@query(
    "n6_label_accuracy",
    f"""SELECT lang, count(*) AS total, count(*) FILTER (WHERE p = quality) AS correct,
          count(*) FILTER (WHERE p = quality) * 100.0::DOUBLE / count(*) AS accuracy_pct
        FROM (SELECT lang, quality, CASE WHEN {SANITY} = 'SANITY_PASSED' THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id))
        GROUP BY 1""",
)
def _(t):
    rows = documents(t).join(t.labels, "doc_id")
    predicted = F.when(tx.text_sanity("text") == "SANITY_PASSED", 1).otherwise(0)
    return tx.label_accuracy(rows, predicted, F.col("quality"), ["lang"])
