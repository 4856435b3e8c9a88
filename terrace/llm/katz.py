"""Katz backoff language model of words, order two, counted and scored in packed blocks.

p(w | h) = d(c) * c(h, w) / c(h) for pairs seen in training, else alpha(h) * p(w); p(w) = d(c) * c(w) / N for known words, else the mass that unigram discounting
leaves, as one unknown word. d is Good-Turing's discount for counts up to `LIMIT` in Katz's form; where counts of counts do not allow it
(tiny tables), it is 1 - D / c with D = n1 / (n1 + 2 n2). alpha(h) is what h's discounted pairs leave, over what p leaves of words not seen after h, so every history
sums to one exactly; a history whose pairs leave nothing (all counts above `LIMIT`) counts once more in its denominator.

Texts are cut into words once, into stored chunks of word codes. Each chunk asks for the counts of its distinct words and pairs: requests and answers travel
packed by (part, chunk), parts are chosen by hash, pairs of one history together, those of frequent histories by pair, so no part holds more
than its share. Tables of the model (counts of words and pairs, backoff weights) are stored by part. Scoring looks each pair of a chunk up and falls back
recursively. What is gathered grows with the corpus; nothing whole passes the driver but counts of counts.

Words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end. Words are keyed by 64-bit hashes. A null text is empty (its end only). Repeated rows count each
time. Rows with null doc_id are in training unless `held_out` says otherwise. An empty table gives no rows; with no training rows every word is unknown, with probability one. Extra columns take no part.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import Words, mixed, stored, word_list

LIMIT = 5
CHUNK_BYTES = 8 << 20
PART_TOKENS = 2_000_000
END = xxhash.xxh3_64_intdigest(b" ")  # no word holds a space
START = 1 << 46  # the history of a text's first word, above all ids
CODES, WORD_REPLY, WORD_TABLE, PAIR_REPLY, HISTORY, NEED, PAIR_TABLE, ALPHA_REPLY, ALPHA_TABLE = range(9)
ROW = "kind int, chunk long, part long, body binary, counts array<long>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed body; unsigned integers in the least width that holds them."""
    out = []
    for a in arrays:
        if a.dtype.kind == "u" and a.dtype.itemsize > 1:
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in ("u1", "u2", "u4", "u8") if top < 1 << 8 * int(t[1])))
        raw = a.tobytes()
        out.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(raw)) + raw)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    at, out = 0, []
    while at < len(data):
        kind, size = struct.unpack_from("<2sQ", data, at)
        out.append(np.frombuffer(data, "<" + kind.decode() if kind[1:] != b"1" else kind.decode(), count=size // int(kind[1:]), offset=at + 10))
        at += 10 + size
    return out


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "chunk", "part", "body", "counts"])


class Discounts:
    """Discounted counts from counts of counts n[1..LIMIT+1]."""

    def __init__(self, n: list[int]):
        n1, n2 = n[0], n[1]
        spare = (LIMIT + 1) * n[LIMIT] / n1 if n1 else 1.0
        d = [((r + 1) * n[r] / (r * n[r - 1]) - spare) / (1 - spare) if n[r - 1] and spare < 1 else 0.0 for r in range(1, LIMIT + 1)]
        if not all(0 < x < 1 for x in d):
            off = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            d = [1 - off / r for r in range(1, LIMIT + 1)]
        self.table = np.array([0.0, *d, 1.0])

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return self.table[np.minimum(counts, LIMIT + 1).astype(np.int64)] * counts


class Unigrams:
    """p(w) by count: `total` tokens, `distinct` words, counts of counts."""

    def __init__(self, total: int, distinct: int, of_counts: list[int]):
        self.total, self.distinct, self.discounts = total, distinct, Discounts(of_counts)
        kept = sum(float(self.discounts(np.array([r]))[0]) * of_counts[r - 1] for r in range(1, LIMIT + 1)) + total - sum(r * of_counts[r - 1] for r in range(1, LIMIT + 1))
        self.over = total if kept < total else total + 1
        self.unknown = 1 - kept / self.over if total else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts(counts) / max(self.over, 1), self.unknown)


def chunks(documents: DataFrame) -> DataFrame:
    """One row per about CHUNK_BYTES of text: distinct word hashes, their training counts, word codes, doc ids, lengths, flags (1 held out, 2 null id)."""

    def cut(batches):
        hashes_of = Words()
        docs, lengths, flags, hashes, held = [], [], [], [], 0

        def row():
            nonlocal docs, lengths, flags, hashes, held
            flat, size = np.concatenate(hashes), np.array(lengths, np.uint64)
            words, codes = np.unique(flat, return_inverse=True)
            taught = np.repeat((np.array(flags, np.uint8) & 1) == 0, size.astype(np.int64))
            often = np.bincount(codes, minlength=len(words))
            order = np.argsort(-often, kind="stable")  # small codes for frequent words
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            trained = np.bincount(codes, weights=taught, minlength=len(words)).astype(np.uint64)[order]
            body = pack(place[codes].astype(np.uint64), np.array(docs, np.int64), size, np.array(flags, np.uint8), _slots(words[order]))
            out = {"body": body, "words": pack(words[order], trained), "counts": [len(flat), len(words)]}
            docs, lengths, flags, hashes, held = [], [], [], [], 0
            return pa.RecordBatch.from_pylist([out], schema=pa.schema([("body", pa.binary()), ("words", pa.binary()), ("counts", pa.list_(pa.int64()))]))

        end = np.array([END], np.uint64)
        for b in batches:
            for doc, text, out in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("held_out").to_pylist()):
                raw = text.as_py()
                found = np.concatenate([hashes_of(word_list(raw)), end])
                docs.append(0 if doc is None else doc)
                flags.append(bool(out) + 2 * (doc is None))
                lengths.append(len(found))
                hashes.append(found)
                held += len(raw or b"")
                if held >= CHUNK_BYTES:
                    yield row()
        if docs:
            yield row()

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), "held_out")
    rows = narrow.mapInArrow(cut, "body binary, words binary, counts array<long>")
    named = rows.select(F.lit(CODES).alias("kind"), F.monotonically_increasing_id().alias("chunk"), F.lit(0).cast("long").alias("part"), "body", "words", "counts")
    return stored(named, "lm-chunks")


def _dealt(part: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, positions) of each part that has any; positions in their order."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[cut[p] : cut[p + 1]]) for p in range(parts) if cut[p + 1] > cut[p]]


def _slots(keys: np.ndarray) -> np.ndarray:
    """24 bits of each key's hash, by which parts are chosen."""
    return mixed(keys) & np.uint64(0xFFFFFF)


def _key_parts(slots: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    return _dealt((slots % np.uint64(parts)).astype(np.int64), parts)


def rises(x: np.ndarray) -> np.ndarray:
    """Steps of ascending whole numbers, which pack well; np.cumsum goes back."""
    return np.diff(x.astype(np.int64), prepend=0).astype(np.uint64)


def risen(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.astype(np.int64))


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int64()), ("body", pa.binary()), ("counts", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def word_tables(chunk_rows: DataFrame, parts: int) -> DataFrame:
    """Training counts of all words by part, and to each chunk the counts of its own."""

    def ask(batches):
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist()):
                words, trained = unpack(body)
                yield _arrow([(CODES, chunk, p, pack(words[at], trained[at]), []) for p, at in _key_parts(_slots(words), parts)])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(b) for b in frame["body"]]
        words, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([a[1] for a in asked]).astype(float), minlength=len(words)).astype(np.uint64)
        part, at, out = int(frame["part"].iloc[0]), 0, []
        for chunk, a in zip(frame["chunk"], asked):
            own = place[at : at + len(a[0])]
            out.append((WORD_REPLY, chunk, part, pack((own * parts + part + 1).astype(np.uint64), total[own]), []))
            at += len(a[0])
        seen = total[total > 0]
        counts = [int(seen.sum()), len(seen), *np.bincount(np.minimum(seen, LIMIT + 2).astype(np.int64), minlength=LIMIT + 3)[1 : LIMIT + 2].tolist()]
        return _rows([*out, (WORD_TABLE, -1, part, pack(words, total), counts)])

    asked = chunk_rows.select("chunk", "words").mapInArrow(ask, ROW)
    return stored(asked.groupBy("part").applyInPandas(answer, ROW), "lm-words")


def _known(frame: pd.DataFrame, parts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A chunk's arrays, and the ids and training counts of its words."""
    own = unpack(frame.loc[frame["kind"] == CODES, "body"].iloc[0])
    replies = frame[frame["kind"] == WORD_REPLY]
    replies = dict(zip(replies["part"], replies["body"]))
    ids, counts = np.zeros(len(own[4]), np.int64), np.zeros(len(own[4]), np.int64)
    for p, at in _key_parts(own[4].astype(np.uint64), parts):
        ids[at], counts[at] = unpack(replies[p])
    return own, ids, counts


class Pairs:
    """Distinct (history, word) pairs of a chunk, in a fixed order, with the part each goes to."""

    def __init__(self, own: list[np.ndarray], ids: np.ndarray, counts: np.ndarray, documents: int, parts: int, most: float):
        codes, _, lengths, flags, _ = own
        codes, lengths = codes.astype(np.int64), lengths.astype(np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        codes = place[codes]  # by ascending id; the start of a text comes last, as id START
        self.words, self.counts = np.append(ids[order], START).astype(np.int64), np.append(counts[order], documents)
        self.codes = codes
        first = np.cumsum(lengths) - lengths
        before = np.empty(len(codes), np.int64)
        before[1:] = codes[:-1]
        before[first] = len(ids)
        keys, self.place = np.unique(before * len(self.words) + codes, return_inverse=True)
        self.h, self.w = keys // len(self.words), keys % len(self.words)
        taught = np.repeat((flags & 1) == 0, lengths)
        self.trained = np.bincount(self.place, weights=taught, minlength=len(keys)).astype(np.uint64)
        hh, hw = self.words[self.h], self.words[self.w]
        hh, hw = hh.astype(np.uint64), hw.astype(np.uint64)
        key = np.where(self.counts[self.h] > most, hh ^ mixed(hw), hh)
        self.parts = _key_parts(_slots(key), parts)


def pair_tables(chunk_rows: DataFrame, word_rows: DataFrame, unigrams: Unigrams, documents: int, parts: int) -> DataFrame:
    """Training counts of all pairs by part, to each chunk the counts of its own, and per history what its backoff weight needs."""
    most = unigrams.total / parts

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        own, ids, counts = _known(frame, parts)
        pairs, chunk, out = Pairs(own, ids, counts, documents, parts, most), int(frame["chunk"].iloc[0]), []
        for p, at in pairs.parts:
            h, h_at = np.unique(pairs.h[at], return_inverse=True)
            w, w_at = np.unique(pairs.w[at], return_inverse=True)
            body = pack(rises(pairs.words[h]), pairs.counts[h].astype(np.uint64), rises(h_at), rises(pairs.words[w]), pairs.counts[w].astype(np.uint64), w_at.astype(np.uint64), pairs.trained[at])
            out.append((CODES, chunk, p, body, []))
        return _rows(out)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(b) for b in frame["body"]]
        asked = [[risen(a[0]), a[1], risen(a[2]), risen(a[3]), *a[4:]] for a in asked]
        h, h_first, h_all = np.unique(np.concatenate([a[0] for a in asked]), return_index=True, return_inverse=True)
        h_count = np.concatenate([a[1] for a in asked]).astype(np.int64)[h_first]
        w, w_first, w_all = np.unique(np.concatenate([a[3] for a in asked]), return_index=True, return_inverse=True)
        w_count = np.concatenate([a[4] for a in asked]).astype(np.int64)[w_first]
        h_off, w_off, keys = 0, 0, []
        for a in asked:
            keys.append(h_all[h_off + a[2]] * len(w) + w_all[w_off + a[5].astype(np.int64)])
            h_off, w_off = h_off + len(a[0]), w_off + len(a[3])
        flat = np.concatenate(keys)
        pairs, place = np.unique(flat, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([a[6] for a in asked]).astype(float), minlength=len(pairs)).astype(np.int64)
        ph, pw, seen = pairs // len(w), pairs % len(w), total > 0
        per_count = [np.bincount(ph[total == r], minlength=len(h)) for r in range(1, LIMIT + 1)]
        above = np.bincount(ph, weights=np.where(total > LIMIT, total, 0), minlength=len(h))
        covered = np.bincount(ph[seen], weights=unigrams.p(w_count[pw[seen]]), minlength=len(h))
        low = sum(per_count) > 0
        part, at, out = int(frame["part"].iloc[0]), 0, []
        for chunk, k in zip(frame["chunk"], keys):
            own = place[at : at + len(k)]
            at += len(k)
            out.append((PAIR_REPLY, chunk, part, pack(total[own].astype(np.uint64)), []))
            unsure = np.unique(ph[own][((total[own] == 0) | ~low[ph[own]]) & (h_count[ph[own]] > 0)])
            if len(unsure):
                out.append((NEED, chunk, part, pack(rises(h[unsure])), []))
        counts = np.bincount(np.minimum(total, LIMIT + 2), minlength=LIMIT + 3)[1 : LIMIT + 2].tolist()
        out.append((HISTORY, -1, part, pack(rises(h), h_count.astype(np.uint64), *[x.astype(np.uint64) for x in per_count], above.astype(np.uint64), covered), counts))
        out.append((PAIR_TABLE, -1, part, pack(rises(h), rises(ph[seen]), rises(w), pw[seen].astype(np.uint64), total[seen].astype(np.uint64)), []))
        return _rows(out)

    asked = chunk_rows.drop("words").unionByName(word_rows.where(F.col("kind") == WORD_REPLY)).groupBy("chunk").applyInPandas(ask, ROW)
    return stored(asked.groupBy("part").applyInPandas(answer, ROW), "lm-pairs")


def alpha_tables(pair_rows: DataFrame, discounts: Discounts, parts: int) -> DataFrame:
    """Backoff weights and denominators by part, and to each chunk those it needs."""

    def deal(batches):
        for b in batches:
            for kind, chunk, body in zip(b.column("kind").to_pylist(), b.column("chunk").to_pylist(), b.column("body").to_pylist()):
                h, *arrays = unpack(body)
                h = risen(h)
                yield _arrow([(kind, chunk, p, pack(rises(h[at]), *[a[at] for a in arrays]), []) for p, at in _key_parts(_slots(h.astype(np.uint64)), parts)])

    def weigh(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        told = [unpack(b) for b in frame.loc[frame["kind"] == HISTORY, "body"]]
        if not told:
            return _rows([])
        h, first, at = np.unique(np.concatenate([risen(t[0]) for t in told]), return_index=True, return_inverse=True)
        count = np.concatenate([t[1] for t in told]).astype(np.int64)[first]
        summed = [np.bincount(at, weights=np.concatenate([t[i] for t in told]).astype(float), minlength=len(h)) for i in range(2, LIMIT + 4)]
        kept = sum(r * discounts.table[r] * summed[r - 1] for r in range(1, LIMIT + 1)) + summed[LIMIT]
        low = sum(summed[:LIMIT]) > 0
        over = np.where(low | (count == 0), count, count + 1)
        alpha = np.where(count > 0, (1 - kept / np.maximum(over, 1)) / (1 - summed[LIMIT + 1]), 1.0)
        out = [(ALPHA_TABLE, -1, part, pack(rises(h), over.astype(np.uint64), alpha), [])]
        needs = frame[frame["kind"] == NEED]
        for chunk, body in zip(needs["chunk"], needs["body"]):
            asked = risen(unpack(body)[0])
            found = np.searchsorted(h, asked)
            out.append((ALPHA_REPLY, chunk, part, pack(rises(asked), over[found].astype(np.uint64), alpha[found]), []))
        return _rows(out)

    asked = pair_rows.where(F.col("kind").isin(HISTORY, NEED)).mapInArrow(deal, ROW)
    return stored(asked.groupBy("part").applyInPandas(weigh, ROW), "lm-alpha")


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(documents: DataFrame) -> DataFrame:
    """Train on rows with held_out false and score all rows. documents: doc_id, text, held_out."""
    chunk_rows = chunks(documents)
    tokens = chunk_rows.agg(F.sum(F.col("counts")[0])).first()[0] or 0
    floor = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(floor, -(-int(tokens) // PART_TOKENS))
    word_rows = word_tables(chunk_rows, parts)
    total, distinct, *n1 = _summed(word_rows.where(F.col("kind") == WORD_TABLE), LIMIT + 3)
    unigrams = Unigrams(total, distinct, n1)
    of_end = _count_of(word_rows, parts, END)
    pair_rows = pair_tables(chunk_rows, word_rows, unigrams, of_end, parts)
    discounts = Discounts(_summed(pair_rows.where(F.col("kind") == HISTORY), LIMIT + 1))
    alpha_rows = alpha_tables(pair_rows, discounts, parts)
    most = total / parts

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        own, ids, counts = _known(frame, parts)
        pairs = Pairs(own, ids, counts, of_end, parts, most)
        replies = frame[frame["kind"] == PAIR_REPLY]
        replies = {p: b for p, b in zip(replies["part"], replies["body"])}
        seen = np.zeros(len(pairs.h), np.int64)
        for p, at in pairs.parts:
            seen[at] = unpack(replies[p])[0]
        over, alpha = pairs.counts.astype(float), np.ones(len(pairs.words))
        for body in frame.loc[frame["kind"] == ALPHA_REPLY, "body"]:
            h, o, a = unpack(body)
            at = np.searchsorted(pairs.words, risen(h))
            over[at], alpha[at] = o, a
        counts = pairs.counts[:-1]
        lower = unigrams.p(counts)  # order one
        p = np.where(seen > 0, discounts(seen) / np.maximum(over[pairs.h], 1), alpha[pairs.h] * lower[pairs.w])
        per_token = np.log10(p)[pairs.place]
        base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
        _, docs, lengths, flags, _ = own
        codes, lengths = pairs.codes, lengths.astype(np.int64)
        start = np.cumsum(lengths) - lengths
        return pd.DataFrame({
            "doc_id": pd.array(np.where(flags & 2, 0, docs), dtype="Int64").copy() if not (flags & 2).any() else pd.array([None if f & 2 else int(d) for d, f in zip(docs, flags)], dtype="Int64"),
            "held_out": (flags & 1) == 1, "n_tokens": lengths, "n_known": np.add.reduceat((counts[codes] > 0).astype(np.int64), start), "train_tokens": np.full(len(docs), total),
            "base_score": np.add.reduceat(base[codes], start), "score": np.add.reduceat(per_token, start),
        })

    gathered = chunk_rows.drop("words").unionByName(word_rows.where(F.col("kind") == WORD_REPLY)).unionByName(pair_rows.where(F.col("kind") == PAIR_REPLY)).unionByName(alpha_rows.where(F.col("kind") == ALPHA_REPLY))
    return gathered.groupBy("chunk").applyInPandas(score, SCORED)


def _summed(rows: DataFrame, n: int) -> list[int]:
    got = rows.agg(*[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)) for i in range(n)]).first()
    return [int(x) for x in got]


def _count_of(word_rows: DataFrame, parts: int, word: int) -> int:
    """The training count of one word, from its part of the table."""
    part = int(_slots(np.array([word], np.uint64))[0] % np.uint64(parts))
    row = word_rows.where((F.col("kind") == WORD_TABLE) & (F.col("part") == part)).select("body").first()
    if row is None:
        return 0
    words, counts = unpack(row[0])
    at = np.flatnonzero(words == np.uint64(word))
    return int(counts[at[0]]) if len(at) else 0
