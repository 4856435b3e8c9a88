"""Byte-level BPE by ranks, merged in arrays of many words at once.

A text is cut into words (matches of the split pattern). The distinct new words of a batch lie behind one another in one array of tokens, first one per byte
(`Merges`): each round looks up every pair of neighbours in the sorted pairs, takes the lowest rank of each word and replaces that pair, from the left
wherever it stands, by the new token, whose id is the rank. A word without pairs leaves the array. Decoding joins the bytes of the ids.

A task keeps the ids of the words that it meets first (at most `known_words`), so a word that occurs often is encoded once a task; others are encoded
once a batch. Texts are not moved, and nothing is counted or collected.

Which pairs matter: a token can only arise from the two parts that its own bytes, encoded alone, have just before the last merge; so there is one pair
per token, and `Ranks` finds it. A token must have a higher rank than parts of it that are tokens of several bytes (files where that fails are refused):
then replacing all equal pairs at once gives what joining the leftmost one by one gives. Tokens that their own bytes never reach are taken when a whole
word equals them, as the tiktoken library does.

A null text is empty: no ids. Special tokens in a text are ordinary text. Rows are neither merged nor dropped; extra columns are kept where named.
White space in the pattern is that of Unicode; letters and digits are those of the regex module's Unicode.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import slices

NONE = 2**31 - 1  # no such token
KNOWN_WORDS = 1 << 17
SPACE = "".join(f"\\u{c:04x}" for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))  # White_Space


def spelt_out(pattern: str) -> str:
    """The split pattern with Unicode white space spelt out, for which `\\s` may stand or not."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


class Ranks:
    """A rank file: bytes of each token, the pair it comes from, and the tokens that no pair gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.ranks = ranks
        self.pieces = [b""] * self.size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.alone: list[bytes] = []
        for piece, rank in ranks.items():
            if len(piece) > 1:
                parts = self.last_parts(piece)
                if len(parts) == 2:
                    self.pairs[ranks[parts[0]], ranks[parts[1]]] = rank
                else:
                    self.alone.append(piece)
        if any(rank < max(r for r in pair if len(self.pieces[r]) > 1) for pair, rank in self.pairs.items() if max(len(self.pieces[r]) for r in pair) > 1):
            raise ValueError("a token ranks below a part of it")

    def last_parts(self, piece: bytes) -> list[bytes]:
        """Merge the leftmost pair of lowest rank until two parts are left or none can be merged."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


@lru_cache(maxsize=4)
def read(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


class Merges:
    """The ids of distinct words by a `Ranks`, for many words at once."""

    def __init__(self, ranks: Ranks):
        self.size = ranks.size
        self.bytes = np.array(ranks.bytes, np.int64)
        self.alone = {piece: ranks.ranks[piece] for piece in ranks.alone}
        keys = np.array([a * ranks.size + b for a, b in ranks.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], -1)  # the last one, which no pair has, is for keys behind all others
        self.news = np.append(np.array(list(ranks.pairs.values()), np.int64)[order], NONE)

    def pair_ranks(self, tokens: np.ndarray) -> np.ndarray:
        """Rank of each token with its right neighbour, NONE for the last."""
        keys = tokens[:-1] * self.size + tokens[1:]
        at = np.searchsorted(self.keys[:-1], keys)
        return np.append(np.where(self.keys[at] == keys, self.news[at], NONE), NONE)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids (uint32) of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        tokens = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        ends, ended = [], []
        while len(tokens):
            first = np.diff(word, prepend=-1) != 0
            start = np.flatnonzero(first)
            rank = self.pair_ranks(tokens)
            rank[start[1:] - 1] = NONE
            lengths = np.diff(np.append(start, len(tokens)))
            lowest = np.repeat(np.minimum.reduceat(rank, start), lengths)
            live = lowest != NONE
            ends.append(tokens[~live])
            ended.append(word[~live])
            if not live.any():
                break
            tokens, word, hit, rank = tokens[live], word[live], (rank == lowest)[live], rank[live]
            place = np.arange(len(tokens))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            joined = hit & ((place - run) % 2 == 0)  # of equal pairs that overlap, every other one from the left
            tokens = np.where(joined, rank, tokens)
            stays = ~np.append(False, joined[:-1])
            tokens, word = tokens[stays], word[stays]
        if not ends:
            return [b""] * len(words)
        word = np.concatenate(ended)
        order = np.argsort(word, kind="stable")
        raw = np.concatenate(ends)[order].astype("<u4").tobytes()
        stops = np.cumsum(4 * np.bincount(word, minlength=len(words))).tolist()
        found = [raw[a:z] for a, z in zip([0, *stops], stops)]
        if self.alone:
            found = [self.alone[w].to_bytes(4, "little") if w in self.alone else ids for w, ids in zip(words, found)]
        return found


class Encoder:
    """Ids of texts, with the ids of the first `known_words` distinct words kept."""

    def __init__(self, path: str, pattern: str, known_words: int):
        self.merges, self.most, compiled = Merges(read(path)), known_words, regex.compile(spelt_out(pattern))
        self.words = (lambda text: [m.group() for m in compiled.finditer(text)]) if compiled.groups else compiled.findall
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t) if t else [] for t in texts]
        known = self.known
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, self.merges([w.encode() for w in new])))
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in cut]
        for w in new[max(0, self.most - (len(known) - len(new))) :]:
            del known[w]
        return out


@lru_cache(maxsize=2)
def _encoder(name: str, pattern: str, known_words: int) -> Encoder:
    return Encoder(SparkFiles.get(name), pattern, known_words)


def over_ids(documents: DataFrame, path: str, keep: list[str], kinds: str, columns: Callable[[list[np.ndarray]], list[pa.Array]], pattern: str, known_words: int) -> DataFrame:
    """`keep` columns of `documents`, and the columns (types in `kinds`) that `columns` makes of the ids of some texts."""
    read(path)  # refuses a wrong file
    sc = documents.sparkSession.sparkContext
    sc.addFile(path)
    name = path.rsplit("/", 1)[-1]
    narrow = documents.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").cast("binary").alias("__text"))
    schema = narrow.select(*[F.col(f"`{c}`") for c in keep]).schema
    for field in documents.sparkSession.createDataFrame([], kinds).schema:
        schema = schema.add(field)
    names = schema.names

    def run(batches):
        encode = _encoder(name, pattern, known_words)
        for batch in batches:
            for part in slices(batch, batch.column(len(keep))):
                ids = encode([(t or b"").decode("utf-8", "replace") for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns(ids)], names=names)

    return narrow.mapInArrow(run, schema)


def encoded(documents: DataFrame, path: str, keep: list[str], into: str = "ids", pattern: str = PATTERN, known_words: int = KNOWN_WORDS) -> DataFrame:
    """`keep` columns of `documents` and the ids of `text` (array of int) as column `into`, which must not be one of `keep`."""
    if into in keep:
        raise ValueError(f"column {into} is kept and cannot take the ids")

    def columns(ids: list[np.ndarray]) -> list[pa.Array]:
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))]

    return over_ids(documents, path, keep, f"`{into}` array<int>", columns, pattern, known_words)


def decoded(ids: list[int], pieces: list[bytes]) -> bytes:
    """The bytes of ids."""
    return b"".join(map(pieces.__getitem__, ids))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with single spaces) and decoded_sha256 per document."""
    name = path.rsplit("/", 1)[-1]

    def columns(ids: list[np.ndarray]) -> list[pa.Array]:
        pieces, lists = read(SparkFiles.get(name)).pieces, [x.tolist() for x in ids]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return [pa.array(map(len, lists), pa.int64()), pa.array([sha(" ".join(map(str, x)).encode()) for x in lists], pa.string()), pa.array([sha(decoded(x, pieces)) for x in lists], pa.string())]

    return over_ids(documents, path, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", columns, PATTERN, KNOWN_WORDS)
