"""URL verdicts: rules first, then segmentation and naive Bayes.

Host labels are cut into words by a unigram Viterbi search: word counts come from a whole corpus, the pieces of all distinct labels are joined with
them (no vocabulary is broadcast), and the best cut is found per label. Multinomial naive Bayes with Laplace smoothing scores the words of the host
and the tokens of the path; it is trained on the URLs that rules decide and on hosts that hold a seed word of a block list (a parameter), with the
whole table's counts. Each distinct (host, path) is scored once.

A null url, or one without `://`, has empty host and path, no rule and no tokens; its verdict is allow. A rule fits its host and all subdomains;
the longest rule wins. Repeated rows and repeated or null page ids stay as they are. Hosts with empty labels, and labels of any length, are cut all the same. With no URL
of one class the method allows all. Extra columns take no part.
"""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import stored

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SEEDS = ("spam", "pills", "casino", "viagra", "porn", "malware", "phish", "xxx")
LONGEST = 24
UNKNOWN_LOG10 = -2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the module says."""
    at = F.instr(url, "://")
    rest = F.when(url.isNotNull() & (at > 0), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return host, path


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """`urls` (host, path, ...) with rule and rule_verdict."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return urls.withColumn("rule", none if rule is None else rule).withColumn("rule_verdict", none if verdict is None else verdict)


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts; words of letters only, A-Z lower-cased, two to LONGEST letters."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text).cast("string")), "[^\\p{L}]+")).alias("word"))
    return words.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segmented(labels: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(label, words) for distinct labels: the cut of highest product of word probabilities. A letter that starts no known word costs a fixed
    probability; equal cuts go to the one with fewer words, then to the longer first word."""
    place = F.explode(F.sequence(F.lit(1), F.length("label")))
    starts = labels.where(F.length("label") > 1).select("label", place.alias("start"))
    sizes = F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("label") - F.col("start") + 1))
    cuts = starts.where(F.length("label") > F.col("start")).select("label", "start", F.explode(sizes).alias("size")).withColumn("word", F.substring("label", F.col("start"), F.col("size")))
    known = cuts.join(counts, "word").select("label", F.col("start").cast("int").alias("start"), F.col("size").cast("int").alias("size"), F.log10(F.col("n") / F.lit(float(total))).alias("score"))
    listed = known.groupBy("label").agg(F.collect_list(F.struct("start", "size", "score")).alias("pieces"))  # at most LONGEST per letter of one label

    @F.pandas_udf("array<string>")
    def best(label: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([viterbi(text, [] if p is None else p) for text, p in zip(label, pieces)])

    return labels.join(listed, "label", "left").select("label", best("label", "pieces").alias("words"))


def viterbi(label: str, pieces) -> list[str]:
    """The best cut of `label`, from right to left. pieces: start (from 1), size and log10 probability of known words."""
    at = {}
    for p in pieces:
        at.setdefault(int(p["start"]) - 1, []).append((int(p["size"]), float(p["score"])))
    n = len(label)
    score, words, size = [0.0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        options = [(round(s + score[i + k], 9), -1 - words[i + k], k) for k, s in at.get(i, [])] + [(round(UNKNOWN_LOG10 * 2 + score[i + 1], 9), -1 - words[i + 1], 1)]
        top = max(options)
        score[i], words[i], size[i] = top[0], -top[1], top[2]
    out, i = [], 0
    while i < n:
        out.append(label[i : i + size[i]])
        i += size[i]
    return out


def path_tokens(path: Column) -> Column:
    """Tokens of a path; numbers by their number of digits."""
    parts = F.filter(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("p:#"), F.length(x).cast("string"))).otherwise(F.concat(F.lit("p:"), x)))


def judged(pages: DataFrame, corpus: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words and score (log odds of block; positive blocks where no rule fits) of every page."""
    from functools import reduce

    url = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    page = ruled(url.select("page_id", host.alias("host"), path.alias("path")), rules)
    urls = stored(page.groupBy("host", "path", "rule", "rule_verdict").agg(F.count(F.lit(1)).alias("rows")), "url-distinct")
    counts = stored(word_counts(corpus, "text"), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    hosts = urls.select("host").distinct()
    name, suffix = F.regexp_extract("host", "^(.*)\\.[^.]*$", 1), F.regexp_extract("host", "([^.]*)$", 1)  # the last label stays whole
    labels = hosts.select("host", F.posexplode(F.split(name, "[.\\-_]")).alias("pos", "label"))
    cut = segmented(labels.select("label").where("label <> ''").distinct(), counts, total)
    found = labels.join(cut, "label", "left").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("cut"))  # the labels of one host
    words = found.select("host", F.concat(F.flatten(F.transform("cut", lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))), F.array(suffix)).alias("host_words"))
    words = stored(words, "url-hosts")  # one row per distinct host
    seeded = reduce(lambda a, b: a | b, [F.contains("host", F.lit(s)) for s in seeds], F.lit(False))
    label = F.when(seeded & (F.col("rule_verdict").isNull() | (F.col("rule_verdict") == "block")), "block").when(~seeded, F.col("rule_verdict"))
    tokens = F.concat(F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x)), path_tokens(F.col("path")))
    known = stored(urls.join(words, "host", "left").select("host", "path", "rows", "host_words", label.alias("label"), tokens.alias("tokens")), "url-tokens")
    taught = known.where("label is not null")
    spread = taught.select("label", "rows", F.explode("tokens").alias("token"))
    of = lambda what: F.sum(F.when(F.col("label") == what, F.col("rows")).otherwise(0))
    model = stored(spread.groupBy("token").agg(of("block").alias("b"), of("allow").alias("a")), "url-model")
    sums = model.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count(F.lit(1))).first()
    docs = taught.agg(F.coalesce(of("block"), F.lit(0)), F.coalesce(of("allow"), F.lit(0))).first()
    prior = math.log((docs[0] + 1) / (docs[1] + 1)) if docs[0] and docs[1] else -1e9
    odds = F.log((F.col("b") + 1) / F.lit(float(sums[0] + sums[2] + 1))) - F.log((F.col("a") + 1) / F.lit(float(sums[1] + sums[2] + 1)))
    scores = known.select("host", "path", F.explode("tokens").alias("token")).join(model.select("token", odds.alias("odds")), "token", "left").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    scored = known.join(scores, ["host", "path"], "left").select("host", "path", "host_words", F.round(F.coalesce("odds", F.lit(0.0)) + F.lit(prior), 6).alias("score"))
    plain = F.when((F.col("host") != "") & (F.col("score") > 0), "block").otherwise("allow")
    return page.join(scored, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", plain).alias("verdict"), "host_words", "score")
