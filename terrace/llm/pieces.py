"""SentencePiece models run by the tokenizers library.

The model protobuf is read field by field (no protobuf package), and its parts are rebuilt: normaliser (character map, extra white space, dummy
prefix), the metaspace marker, unigram scores or merges in order of piece score, and byte fallback. `Pieces.encode` hands the distinct words
of a batch to the library's model; `Pieces.parity` compares with the sentencepiece library, and rows that differ take its ids, flagged.

A null text is encoded as empty: no ids, decoded "". Control pieces in a text are ordinary text. Extra columns are kept by `encoded`.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import WordIds, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
WORD = f"{MARK}+[^{MARK}]*|[^{MARK}]+"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


class Model:
    """Pieces and settings of a serialised SentencePiece model."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normal = {}, {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        self.kind, self.byte_fallback, self.suffix = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with a leading marker")


def normaliser(m: Model) -> normalizers.Normalizer:
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


def merges(m: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best piece first."""
    usable = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, score in usable.items():
        found += [(-score, len(piece[:i]), piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
    return [(left, right) for _, _, left, right in sorted(found, key=lambda x: x[0])]


class Pieces:
    """A SentencePiece model behind the tokenizers library."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = m = Model(data)
        ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        if m.kind == BPE:
            core = models.BPE(vocab=ids, merges=merges(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback)
        self.tokenizer, self.words = Tokenizer(core), None
        self.tokenizer.normalizer = normaliser(m)
        if not any(MARK in p.lstrip(MARK) for p, _, _ in m.pieces):  # no piece crosses the start of a word: words are independent, and the library's memo helps
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
            self.words = WordIds(core, re.compile(WORD).findall)
        self.reference = SentencePieceProcessor(model_proto=data)
        self.is_byte = np.array([kind == BYTE for _, _, kind in m.pieces])
        self.bytes_of = {i: int(p[3:5], 16) for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self.shown = [b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
        for i, b in self.bytes_of.items():
            self.shown[i] = bytes([b])
        self.letters = np.frombuffer(b"".join(self.shown), np.uint8)
        self.width = np.array([len(s) for s in self.shown], np.int64)
        self.place = np.cumsum(self.width) - self.width

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text. Where words are independent, each distinct word of the batch goes to the library's model once; a memo of bounded size keeps the words seen first."""
        if self.words is None:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self.words([self.marked(t) if t else "" for t in texts])

    def decode(self, encoded: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of the texts of a batch of ids: the letters of all pieces are gathered at once, then cut."""
        ids = np.concatenate([*encoded, np.zeros(0, np.uint32)]).astype(np.int64)
        width = self.width[ids]
        ends = np.cumsum(width)
        letters = self.letters[np.arange(int(width.sum())) + np.repeat(self.place[ids] - (ends - width), width)].tobytes()
        stops = np.append(np.zeros(1, np.int64), ends)[np.cumsum([len(a) for a in encoded], dtype=np.int64)].tolist()
        out = [letters[a:z] for a, z in zip([0, *stops], stops)]
        return [t[1:] if self.model.dummy_prefix and t[:1] == b" " else t for t in out]

    def parity(self, texts: list[str], encoded: list[np.ndarray]) -> list[bool]:
        return [a.tolist() == b for a, b in zip(encoded, self.reference.encode(texts, num_threads=1))]

    def marked(self, text: str) -> str:
        """A text that is not empty, normalised. Without a character map the rest of the normaliser is plain replacement."""
        m = self.model
        if m.charsmap:
            return self.tokenizer.normalizer.normalize_str(text)
        text = re.sub(" {2,}", " ", text.strip(" ")) if m.squeeze else text
        return (f" {text}" if m.dummy_prefix and text else text).replace(" ", MARK)

    def normalised(self, text: str) -> str:
        """What decoding gives back, if no piece is unknown."""
        whole = self.marked(text).replace(MARK, " ") if text else ""
        return whole[1:] if self.model.dummy_prefix and whole[:1] == " " else whole


@lru_cache(maxsize=2)
def _pieces(name: str) -> Pieces:
    with open(SparkFiles.get(name), "rb") as f:  # Spark's own distribution of the model file
        return Pieces(f.read())


ENCODED = "ids array<int>, n_tokens int, n_byte_pieces int, ids_crc32 long, parity boolean, round_trip boolean"


def encoded(documents: DataFrame, model_path: str, keep: list[str], check: bool = True, with_ids: bool = True) -> DataFrame:
    """`keep` columns of `documents` with ids (null unless `with_ids`), n_tokens, n_byte_pieces (byte-fallback ids), ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), parity (the reference library gives the same ids; null unless `check`) and round_trip (decoding
    gives the normalised text). No shuffle: the model is read once per worker, texts pass in parts of bounded size."""
    sc = documents.sparkSession.sparkContext
    sc.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]
    ddl = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        pieces = _pieces(name)
        yield from of(pieces, batches)
        if pieces.words is not None:  # workers are used again, by other stages too
            pieces.words.memo.clear()

    def of(pieces, batches):
        for whole in batches:
            for batch in slices(whole, whole.column("__text")):
                texts = [t.as_py() or "" for t in batch.column("__text")]
                ids = pieces.encode(texts)
                same = [None] * len(ids)
                if check:
                    same = pieces.parity(texts, ids)
                    ids = [a if ok else np.array(pieces.reference.encode(t), np.uint32) for a, ok, t in zip(ids, same, texts)]
                back = [a == pieces.normalised(t).encode() for a, t in zip(pieces.decode(ids), texts)]
                columns = [batch.column(c) for c in keep]
                columns += [pa.array([a.astype(np.int32) for a in ids] if with_ids else [None] * len(ids), pa.list_(pa.int32())), pa.array([len(a) for a in ids], pa.int32()), pa.array([int(pieces.is_byte[a].sum()) for a in ids], pa.int32())]
                columns += [pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in ids], pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *ENCODED_NAMES])

    picked = documents.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    return picked.mapInArrow(run, f"{ddl}, {ENCODED}")


ENCODED_NAMES = [part.split()[0] for part in ENCODED.split(", ")]
