"""Ordinal quality classifier: a cumulative-link (proportional odds) regression on graded ratings.

Whole texts become hashed features: every word and every word shape (letter case, digits, symbols, a repeat of the word before) with weight
1 + log(count), each kind scaled to length one, in `BUCKETS` cells. One weight vector is shared by all grades; ordered thresholds t1 < t2 < ...
give P(grade >= j) = sigmoid(w.x - t_j). Scores are the expected grade and the tail probability of the top grade, by which documents are selected.

The model is fitted on at most `sample` labelled documents (smallest hash of doc_id first: a documented bound; each grade gets at most its equal share plus what
others leave). Only their hashed features reach the one fitting task. Scoring reads every document, with the weights (a fixed BUCKETS doubles) broadcast.

Labels without a document, or with a null grade, are left out; a document with several labels takes the lowest grade. With no label or a single grade the
model is constant: all documents get that grade (the top one, if there is none). A null text is empty: it has no features, so its score is the thresholds' alone.
Extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Words, mixed, slices, stored

BUCKETS = 1 << 18
SAMPLE = 24_000
RARE = 3
AT_ONCE = 1 << 20  # features whose doubles are held at a time
MARKS = b".,;:!?*%$#&|()[]\"'"
SEED = 11
LEAST = 0.35  # of the top grade's probability; grades weigh alike in the fit, so a third means no evidence either way


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


# byte classes of a word's shape: upper, lower (and all bytes above ASCII), digit, other
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))


def _shape(word: bytes) -> bytes:
    t = word.translate(_CLASS)
    out = bytearray(t[:1])
    for b in t[1:]:
        if b != out[-1]:
            out.append(b)
    return bytes(out[:8])


class Features:
    """Hashed features of texts, as (cells, values); words and shapes are remembered up to a bound."""

    def __init__(self):
        self.words, self.shapes = Words(), {}

    def shape(self, word: bytes) -> int:
        got = self.shapes.get(word)
        if got is None:
            if len(self.shapes) > Words.LIMIT:
                self.shapes.clear()
            got = self.shapes[word] = int(self.words([b"\x00" + _shape(word)])[0] & np.uint64(0x7FFFFFFFFFFFFFFF))
        return got

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        raw = text.split() if text else []
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        words = self.words([w.strip(MARKS) for w in text.lower().split()])
        shapes = np.fromiter(map(self.shape, raw), np.uint64, len(raw))
        again = np.zeros(len(raw), bool)
        again[1:] = words[1:] == words[:-1]
        shapes = np.where(again, shapes ^ np.uint64(0x55), shapes)
        cells, values = [], []
        for kind, hashes in ((1, words), (2, shapes)):
            found, counts = np.unique(mixed(hashes + np.uint64(kind)) % np.uint64(BUCKETS), return_counts=True)
            v = 1 + np.log(counts)
            cells.append(found.astype(np.int64))
            values.append(v if kind == 1 else v * 4 / np.sqrt((v * v).sum()))
        return np.concatenate(cells), np.concatenate(values).astype(np.float32)


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1..top, a row per document."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - linear[:, None], -50, 50)))


def fit_arrays(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int, rounds: int = 150, lasso: float = 3e-4) -> Ordinal:
    """Accelerated proximal gradient on the likelihood of the grades, all grades weighing alike. Every weight has its own step (a separable
    bound of the curvature), so rare words move as fast as common ones, and a lasso penalty leaves only words that tell grades apart.
    Thresholds stay ordered: they are a first one and the logs of positive steps."""
    n = len(rows)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c, _ in rows])
    cells, values = np.concatenate([c for c, _ in rows]).astype(np.int32, copy=False), np.concatenate([v for _, v in rows])
    often = np.bincount(cells, minlength=BUCKETS) >= RARE
    used, keep = np.flatnonzero(often), often[cells]
    owner, values, cells = owner[keep], values[keep], (np.cumsum(often, dtype=np.int32) - 1)[cells[keep]]
    parts = [slice(at, at + AT_ONCE) for at in range(0, len(cells), AT_ONCE)]

    def sums(of: np.ndarray, size: int, weight) -> np.ndarray:
        """Sum of value * weight(part) by `of`, with doubles of one part at a time."""
        out = np.zeros(size)
        for p in parts:
            out += np.bincount(of[p], weights=values[p] * weight(p), minlength=size)
        return out

    share = np.bincount(grades, minlength=top + 1)
    each = (1 / np.maximum(share, 1))[grades]
    each /= each.sum()
    total = sums(owner, n, lambda p: 1.0)
    step = 1 / (0.5 * sums(cells, len(used), lambda p: (each * total)[owner[p]]) + 1e-12)
    i, one, zero = np.arange(n), np.ones((n, 1)), np.zeros((n, 1))
    w, t = np.zeros(len(used)), np.array([-3.0 * top, *[np.log(3.0)] * (top - 1)])
    ahead_w, ahead_t, pace = w, t, 1.0
    for _ in range(rounds):
        gaps = np.concatenate([ahead_t[:1], np.exp(ahead_t[1:])])
        x = sums(owner, n, lambda p: ahead_w[cells[p]])
        up = 1 / (1 + np.exp(np.clip(np.cumsum(gaps)[None, :] - x[:, None], -50, 50)))  # P(grade >= j), j = 1..top
        tail, slope = np.hstack([one, up, zero]), np.hstack([zero, up * (1 - up), zero])
        scale = each / np.maximum(tail[i, grades] - tail[i, grades + 1], 1e-9)
        low, high = scale * slope[i, grades], scale * slope[i, grades + 1]
        by_threshold = np.bincount(grades, weights=low, minlength=top + 2) - np.bincount(grades + 1, weights=high, minlength=top + 2)
        by_gap = np.cumsum(by_threshold[1 : top + 1][::-1])[::-1] * np.concatenate([[1.0], gaps[1:]])
        new_w = ahead_w - step * sums(cells, len(used), lambda p: (high - low)[owner[p]])
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * lasso, 0)
        new_t = ahead_t - 0.5 * by_gap
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / next_pace
        ahead_w, ahead_t = new_w + push * (new_w - w), new_t + push * (new_t - t)
        w, t, pace = new_w, new_t, next_pace
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Ordinal(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def fit(documents: DataFrame, graded: DataFrame, top: int = 2, sample: int = SAMPLE) -> Ordinal:
    """`graded`: doc_id, grade (0..top). One task fits, on a bounded number of hashed documents."""
    order = F.xxhash64("doc_id", F.lit(SEED))
    ranked = graded.where(F.col("grade").between(0, top) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")).withColumn("o", order)
    share = sample // (top + 1)
    parts = [ranked.where(F.col("grade") == g).orderBy("o").limit(share) for g in range(top + 1)]
    rest = ranked.orderBy("o").limit(sample)  # grades that are short leave room for the others
    picked = parts[0]
    for p in [*parts[1:], rest]:
        picked = picked.union(p)
    picked = stored(picked.select("doc_id", "grade").distinct(), "ordinal-sample")  # at most 2 * sample rows
    texts = documents.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")

    def hashed(batches):
        make = Features()
        for b in (part for whole in batches for part in slices(whole, whole.column("text"))):
            got = [make(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([c.astype("<i4").tobytes() for c, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], names=["doc_id", "grade", "cells", "values"])

    features = texts.mapInArrow(hashed, "doc_id long, grade int, cells binary, values binary")

    def one(frame):
        import pandas as pd

        frame = frame.sort_values("doc_id").drop_duplicates("doc_id")
        grades = frame["grade"].to_numpy(np.int64)
        if len(np.unique(grades)) < 2:
            edge = np.where(np.arange(1, top + 1) <= grades[0], -50.0, 50.0)
            return pd.DataFrame({"weights": [np.zeros(0).tobytes()], "thresholds": [edge.tobytes()]})
        model = fit_arrays([(np.frombuffer(c, "<i4"), np.frombuffer(v, np.float32)) for c, v in zip(frame["cells"], frame["values"])], grades, top)
        return pd.DataFrame({"weights": [model.weights.astype(np.float32).tobytes()], "thresholds": [model.thresholds.tobytes()]})

    got = features.groupBy(F.lit(True).alias("whole")).applyInPandas(one, "weights binary, thresholds binary").collect()  # bounded: at most 2 * sample documents of hashed features in, one row of BUCKETS floats out
    if not got:
        return Ordinal(np.zeros(BUCKETS), np.full(top, -50.0))
    weights = np.frombuffer(got[0][0], np.float32).astype(np.float64)
    return Ordinal(weights if len(weights) else np.zeros(BUCKETS), np.frombuffer(got[0][1]))


SCORED = "expected_grade double, tail double"


def scored(documents: DataFrame, model: Ordinal) -> DataFrame:
    """`documents` with expected_grade and tail (probability of the top grade). No shuffle."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # BUCKETS floats
    schema = documents.withColumn("expected_grade", F.lit(0.0)).withColumn("tail", F.lit(0.0)).schema
    others = [c for c in documents.columns if c not in ("expected_grade", "tail")]

    def run(batches):
        weights, thresholds = sent.value
        model_, make = Ordinal(weights, thresholds), Features()
        for b in batches:
            x = np.zeros(b.num_rows)
            for i, t in enumerate(b.column("text")):
                cells, values = make(t.as_py().encode() if t.is_valid else None)
                x[i] = float((weights[cells].astype(np.float64) * values).sum())
            tails = model_.tails(x)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array(np.round(tails.sum(axis=1), 9)), pa.array(np.round(tails[:, -1], 9))], names=[*others, "expected_grade", "tail"])

    return documents.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(run, schema)


def selected(documents: DataFrame, graded: DataFrame, least: float = LEAST, top: int = 2, sample: int = SAMPLE) -> DataFrame:
    """`documents` with expected_grade, tail and keep (tail >= least)."""
    return scored(documents, fit(documents, graded, top, sample)).withColumn("keep", F.col("tail") >= least)
