"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores, lower-cased. A document and a test item that share a seed (a run of `LEAST` words) are tiled: the longest
common runs that do not overlap are marked again and again, found by a running Karp-Rabin hash whose length shrinks to `LEAST`. The share of the
item's words under tiles is its coverage, wherever in the document and in whatever order its parts stand; `THRESHOLD` or more is contamination.

The items are sent to all tasks in parts of at most `PART_WORDS` words (a fixed size, checked; a larger benchmark takes more passes over the documents),
so documents are read in place and never shuffled. Null texts are empty. Items of fewer than `LEAST` words take no part. Equal coverage goes to the
smaller item_id. Rows with null or repeated doc_id are judged like any other row. No items, no contamination. Extra columns are kept by `marked`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Words, shingle_hashes

LEAST = 5
THRESHOLD = 0.5
PART_WORDS = 2_000_000
FILTER_BITS = 22
BASE, PRIME = 1_000_003, (1 << 61) - 1
WORD = re.compile(r"\w+").findall


def tiles(item: list[int], text: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(item start, text start, length) of the greedy tiling of two sequences of word hashes; longest first."""
    used_item, used_text, out = bytearray(len(item)), bytearray(len(text)), []
    length = max(min(len(item), len(text)), least)
    while True:
        matches, longer = _scan(item, text, used_item, used_text, length)
        if longer > 2 * length:
            length = longer
            continue
        for size in sorted(matches, reverse=True):
            for i, j in matches[size]:
                if not any(used_item[i : i + size]) and not any(used_text[j : j + size]):
                    used_item[i : i + size] = used_text[j : j + size] = b"\x01" * size
                    out.append((i, j, size))
        if length == least:
            if not matches:
                return out
            continue  # what a marked tile has cut off may still hold runs of the least length
        length = least if length <= 2 * least else length // 2


def _windows(words: list[int], used: bytearray, length: int):
    """(start, running hash) of each run of `length` words that are not used."""
    drop, h, n = pow(BASE, length - 1, PRIME), 0, 0
    for i, w in enumerate(words):
        if used[i]:
            h = n = 0
            continue
        if n == length:
            h = (h - words[i - length] % PRIME * drop) % PRIME
            n -= 1
        h = (h * BASE + w) % PRIME
        n += 1
        if n == length:
            yield i - length + 1, h


def _scan(item, text, used_item, used_text, length) -> tuple[dict[int, list[tuple[int, int]]], int]:
    """Maximal matches of at least `length` words, by size; and the size of one over twice as long, if met."""
    at = defaultdict(list)
    for i, h in _windows(item, used_item, length):
        at[h].append(i)
    matches = defaultdict(list)
    for j, h in _windows(text, used_text, length):
        for i in at.get(h, ()):
            if item[i : i + length] != text[j : j + length]:
                continue
            if i and j and not used_item[i - 1] and not used_text[j - 1] and item[i - 1] == text[j - 1]:
                continue  # part of a longer match that began before
            size = length
            while i + size < len(item) and j + size < len(text) and not used_item[i + size] and not used_text[j + size] and item[i + size] == text[j + size]:
                size += 1
            if size > 2 * length:
                return matches, size
            matches[size].append((i, j))
    return matches, 0


class Items:
    """Test items with their seeds; `best` tiles a document against all items it shares a seed with."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words, self.items, seeds, owner = Words(), [], [], []
        for item_id, text in items:
            hashes = self.words(WORD((text or "").lower()))
            if len(hashes) >= LEAST:
                found = shingle_hashes(hashes, LEAST)
                seeds.append(found)
                owner.append(np.full(len(found), len(self.items)))
                self.items.append((item_id, hashes.tolist()))
        seeds, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (seeds, owner))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[seeds & np.uint64((1 << FILTER_BITS) - 1)] = True

    def best(self, text: str | None) -> list[tuple[int, float]]:
        """(item_id, coverage) of each item that shares a seed with the text."""
        hashes = self.words(WORD(text.lower())) if text else np.zeros(0, np.uint64)
        if len(hashes) < LEAST or not self.items:
            return []
        own = shingle_hashes(hashes, LEAST)
        places = np.flatnonzero(self.maybe[own & np.uint64((1 << FILTER_BITS) - 1)])
        if not len(places):
            return []
        first, last = np.searchsorted(self.seeds, own[places]), np.searchsorted(self.seeds, own[places], "right")
        hit = defaultdict(list)
        for p, a, z in zip(places.tolist(), first.tolist(), last.tolist()):
            for k in set(self.owner[a:z].tolist()):
                hit[k].append(p)
        out = []
        for k, at in hit.items():
            item_id, item = self.items[k]
            text_words, end = [], -1  # only words under a seed of the item can be in a tile; a mark between stretches that do not touch
            for p in at:
                if p > end:
                    text_words.append(-1)
                    end = p
                text_words += hashes[end : p + LEAST].tolist()
                end = p + LEAST
            out.append((item_id, sum(size for _, _, size in tiles(item, text_words)) / len(item)))
        return out


def item_parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of about PART_WORDS words, one after the other, each read by its own small job."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    total = own.agg(F.sum(F.size(F.split("text", "\\W+")))).first()[0] or 0
    parts = -(-int(total) // PART_WORDS) or 1
    for p in range(parts):
        yield [(r[0], r[1]) for r in own.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).orderBy("item_id", "text").collect()]


FOUND = "item_id long, coverage double, n_items int"


def marked(documents: DataFrame, benchmark: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """`keep` columns of every document with item_id and coverage of the best covered item (null without any seed), n_items at or over the
    threshold, and contaminated."""
    out = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    schema = out.schema
    out = out.withColumns({"__item": F.lit(None).cast("long"), "__coverage": F.lit(0.0), "__n": F.lit(0)})
    names = [f.name for f in schema]
    for part in item_parts(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            items = Items(sent.value)
            for b in batches:
                best_item, best, n = (b.column(c).to_pylist() for c in ("__item", "__coverage", "__n"))
                for i, t in enumerate(b.column("text")):
                    for item_id, coverage in items.best(t.as_py()):
                        n[i] += coverage >= threshold
                        if (-coverage, item_id) < (-best[i], best_item[i] if best_item[i] is not None else 1 << 62):
                            best_item[i], best[i] = item_id, coverage
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(best_item, pa.int64()), pa.array(best, pa.float64()), pa.array(n, pa.int32())], names=[*names, "__item", "__coverage", "__n"])

        out = out.mapInArrow(run, out.schema)
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__item").alias("item_id"), F.round("__coverage", 9).alias("coverage"), F.col("__n").alias("n_items"), (F.col("__coverage") >= threshold).alias("contaminated"))


def covered(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_items, contaminated of every document."""
    return marked(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, ["doc_id"])
