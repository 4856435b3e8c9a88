"""Text rules as built-in expressions over whole texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import lexicons as lx
from terrace.functions.columns import any_of, col
from terrace.session import BROADCAST_ROWS, written

# White space beyond ASCII that text splitting knows; it is mapped to a blank first, which keeps the
# patterns to plain classes (several times faster).
ODD_SPACES = "\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
FOUR_WORDS = r"\S+(?:\s+\S+){3}"
# Patterns over a whole text reduced to letters and spaces: each match lies inside one word. The ordinary
# words that are never flagged all hold a vowel and start no mash, so they need no test of their own.
REPEATED = r"([a-z])\1{3}"
MASH = r"(?:^|\s)(?:" + "|".join(lx.MASH_PREFIXES) + ")"
NO_VOWEL = r"(?:^|\s)[bcdfghjklmnpqrstvwxz]{5,}(?:$|\s)"
EDGE_MARKS = ".,;:()\"'"


def plain_spaces(text: str | Column) -> Column:
    return F.translate(col(text), ODD_SPACES, " " * len(ODD_SPACES))


def words(text: str | Column) -> Column:
    return F.filter(F.split(plain_spaces(text), r"\s+"), lambda w: w != "")


def has_any(text: Column, phrases: Sequence[str]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in phrases])


def is_gibberish(text: str | Column) -> Column:
    """A word (letters a-z only) with four equal letters in a row, a keyboard-mash start, or five or more
    letters without a vowel. Whole-text patterns: no word array is built."""
    letters = F.regexp_replace(F.lower(plain_spaces(text)), r"[^a-z\s]", "")
    return F.regexp_like(letters, F.lit(f"{REPEATED}|{MASH}|{NO_VOWEL}"))


def contradiction(text: str | Column) -> Column:
    t = F.lower(col(text))
    return has_any(t, lx.LIVE_MARKERS) & (has_any(t, lx.MONTHLY_MARKERS) | has_any(t, lx.SENSOR_MARKERS))


def text_sanity(text: str | Column) -> Column:
    """Reason code of the first rule a text breaks, else SANITY_PASSED. NULL text counts as too short."""
    too_short = F.coalesce(~plain_spaces(text).rlike(FOUR_WORDS), F.lit(True))
    return (
        F.when(too_short, "REJECT_INSUFFICIENT_LENGTH")
        .when(is_gibberish(text), "REJECT_GIBBERISH_DETECTED")
        .when(contradiction(text), "FLAG_CONTRADICTION")
        .otherwise("SANITY_PASSED")
    )


def contradiction_flag(text: str | Column, first: Sequence[str], second: Sequence[str]) -> Column:
    """Does a text hold a marker of both lists?"""
    t = F.lower(col(text))
    return has_any(t, first) & has_any(t, second)


def tag_column(
    text: str | Column, phrases: Mapping[str, Sequence[str]] = lx.TAG_PHRASES,
    patterns: Mapping[str, str] = lx.TAG_PATTERNS, history: bool = True,
) -> Column:
    """Array of the tags whose phrase or pattern occurs in the lower-cased text."""
    t = col(text)
    hits = []
    for tag, listed in phrases.items():
        hit = has_any(t, listed)
        if tag in patterns:
            hit = hit | t.rlike(patterns[tag])
        hits.append(F.when(hit, F.lit(tag)))
    if history:
        hits.append(F.when(~has_any(t, lx.NO_HISTORY_PHRASES), F.lit("needs_history")))
    return F.array_compact(F.array(*hits))


def tag_counts(df: DataFrame, text: str, by: Sequence[str] = (), **lexicon) -> DataFrame:
    """Texts per tag of the lexicon; the text is lower-cased once for all phrases."""
    low = df.select(*by, F.lower(text).alias("_low"))
    return low.select(*by, F.explode(tag_column("_low", **lexicon)).alias("tag")).groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("text_count"))


def distinct_terms(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, term): the distinct stripped, lower-cased terms of each text."""
    return df.select(*keys, F.explode(terms(text)).alias("term"))


def frequent_terms(df: DataFrame, keys: Sequence[str], text: str, by: str, k: int) -> DataFrame:
    """The k terms of each group that occur in most texts (ties by term)."""
    freq = distinct_terms(df, [*keys, by], text).groupBy(by, "term").agg(F.count(F.lit(1)).alias("text_count"))
    w = Window.partitionBy(by).orderBy(F.desc("text_count"), "term")
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lexicon_tags(df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame) -> DataFrame:
    """(keys, tag, hits) for a lexicon table (tag, term) of single terms: an equi-join on the term. A lexicon of at most BROADCAST_ROWS rows,
    counted first, is sent to the texts, which then stay where they are; a larger one is shuffled with their terms."""
    known = written(lexicon.select("tag", "term"), "lexicon")
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known.hint("merge")
    joined = distinct_terms(df, keys, text).join(known, "term")
    return joined.groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("hits"))


def terms(text: str | Column) -> Column:
    """Distinct lower-cased terms of a text without the marks around them."""
    stripped = F.transform(F.array_distinct(words(text)), lambda w: F.lower(F.btrim(w, F.lit(EDGE_MARKS))))
    return F.filter(F.array_distinct(stripped), lambda w: w != "")


def _in_class(word: Column, listed: Sequence[str], endings: Sequence[str]) -> Column:
    return word.isin(*listed) | any_of([F.endswith(word, F.lit(e)) for e in endings])


TERM_CLASSES = {
    "nouns": (lx.NOUNS, lx.NOUN_ENDINGS),
    "verbs": (lx.VERBS, lx.VERB_ENDINGS),
    "adjectives": (lx.ADJECTIVES, lx.ADJECTIVE_ENDINGS),
}


def class_terms(found: str | Column, name: str) -> Column:
    """Sorted terms of one class among `terms`. A term may be in several classes."""
    listed, endings = TERM_CLASSES[name]
    return F.array_sort(F.filter(col(found), lambda w: _in_class(w, listed, endings)))


def term_roles(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    split = df.select(*keys, terms(text).alias("_terms"))
    return split.select(*keys, *[class_terms("_terms", n).alias(n) for n in TERM_CLASSES])


def term_role_counts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Texts per term and class."""
    one = distinct_terms(df, keys, text)
    roles = F.array_compact(
        F.array(*[F.when(_in_class(F.col("term"), *spec), F.lit(n)) for n, spec in TERM_CLASSES.items()])
    )
    return one.select("term", F.explode(roles).alias("role")).groupBy("role", "term").agg(
        F.count(F.lit(1)).alias("text_count")
    )


def completeness(text: str | Column, noun_count: Column) -> dict[str, Column]:
    """The five answered questions of a lower-cased text as boolean columns."""
    t, nouns = col(text), noun_count
    return {
        "workload_intent": has_any(t, lx.WORKLOAD_PHRASES),
        "entity_grain": ((nouns >= 2) & has_any(t, lx.GRAIN_PHRASES)) | (nouns >= 3) | has_any(t, lx.OFFERING_PHRASES),
        "temporal_policy": has_any(t, lx.HISTORY_PHRASES),
        "lifecycle_funnel": has_any(t, lx.LIFECYCLE_PHRASES),
        "relationship_multiplicity": (nouns >= 2) | has_any(t, lx.RELATION_PHRASES),
    }


def completeness_score(df: DataFrame, text: str) -> DataFrame:
    """Adds score (20 points per answered question), is_sufficient and the missing questions."""
    prepared = df.withColumns({"_low": F.lower(text), "_nouns": F.size(class_terms(terms(text), "nouns"))})
    answers = completeness("_low", F.col("_nouns"))
    rows = prepared.withColumns({f"_{k}": F.coalesce(v, F.lit(False)) for k, v in answers.items()})
    score = sum((F.col(f"_{k}").cast("int") * 20 for k in answers), F.lit(0)).cast("double")
    missing = F.array_compact(F.array(*[F.when(~F.col(f"_{k}"), F.lit(k)) for k in answers]))
    scored = rows.withColumns({"score": score, "missing": missing}).withColumn("is_sufficient", F.col("score") >= 100)
    return scored.drop("_low", "_nouns", *[f"_{k}" for k in answers])


def label_accuracy(df: DataFrame, predicted: Column, expected: Column, by: Sequence[str] = ()) -> DataFrame:
    hit = predicted == expected
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"),
        (F.count_if(hit) * 100.0 / F.count(F.lit(1))).cast("double").alias("accuracy_pct"),
    )
