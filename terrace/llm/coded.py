"""Token ids in a compressed binary format: adaptive context mixing in front of an arithmetic coder.

Each id is one step of an arithmetic coder. Its probability mixes three predictions: order 0 (the segment's frequencies of ids), order 1 and order 2
(the id last seen after the same one or two ids); the weights of the mixture adapt. Nothing goes
past the coder but the frequencies and a directory. Blocks of `BLOCK` ids start from a reset model and carry a CRC-32 of their ids and bytes, so any block
can be read alone (with its segment's frequencies). All blocks of a segment run in step, one lane each, so the model costs some array operations
per id and not a loop.

A segment row holds whole documents and its own directory (doc ids and lengths); it is written as one binary column of a columnar file, in
ascending doc_id order over files and rows. A null text is empty: only its end id. A null doc_id comes first. Rows of equal doc_id are ordered by length and CRC of
the text. An empty table writes no segment. Extra columns take no part.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import WordIds
from terrace.session import scratch_path

BLOCK = 4096
SEGMENT_IDS = 8_000_000
MAGIC = b"TCM3"
CELLS = 2048
END = 2
AGAIN, BEFORE, SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(21)  # hashes of one and two ids to CELLS cells
SPLIT_BITS, DIGIT, BOTTOM, LOW = np.uint64(16), np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
RIGHT = ((0.0, 0.1, 0.4, 0.6, 0.8), (0.0, 0.3, 0.7, 0.85, 0.92), (0.0, 0.6, 0.8, 0.9, 0.95))  # by run of right order-2 predictions, then by state
WEIGHTS = (0.3, 0.5)  # of order 1 and order 2 at first; order 0 has the rest
ROWS = 150  # 3 runs, 5 states of order 1, 5 of order 2, and whether both expect the same id
PACE, KEPT = np.uint32(5), np.uint32(0x07FF07FF)
PULL = np.uint32(2037 << 16), np.uint32(2037)  # to order 2, to order 1


def _bits(distinct: int) -> int:
    """The sum of a segment's frequencies is two to this power."""
    if distinct > 1 << 23:
        raise ValueError("more than 8 million distinct ids in a segment")
    return min(max(20, distinct.bit_length() + 2), 24)


def _cumulated(rounded: np.ndarray) -> np.ndarray:
    """Order 0 of a segment: cumulated frequencies of its ids with the sum of `_bits`, each at least 1, from the counts' three leading bits."""
    weights = ((4 + (rounded & 3).astype(np.int64)) << (rounded >> 2).astype(np.int64)) >> 2
    n, total = len(weights), max(int(weights.sum()), 1)
    ends = np.cumsum(weights) * ((1 << _bits(n)) - n) // total + np.arange(1, n + 1)
    return np.append(np.zeros(1, np.int64), ends).astype(np.uint64)


def _masses() -> np.ndarray:
    """First masses of order 2 (high half) and order 1 (low half) by row; an order that expects nothing keeps mass 0, and an id that both expect is order 2's."""
    out = np.zeros(ROWS, np.uint32)
    for row in range(ROWS):
        run, one, two, same = row // 50, row // 10 % 5, row // 2 % 5, row % 2
        masses = [int(w * RIGHT[run][s] * 65000) for w, s in zip(WEIGHTS, (one, two))]
        if same:
            masses = [0, sum(masses) if one and two else 0]
        out[row] = masses[1] << 16 | masses[0]
    return out


def _rounded(counts: np.ndarray) -> np.ndarray:
    exponent = np.frexp(counts.astype(np.float64))[1].astype(np.int64) - 1
    return (exponent << 2 | ((counts.astype(np.int64) << 2) >> exponent) & 3).astype(np.uint8)


class _Lanes:
    """Model and coder of blocks that run in step, one lane each; only the last of the ids' blocks may be shorter.

    An id's probability is a mixture of three predictions: order 1 and order 2 expect the id last seen after the same one or two ids, order 0 has the segment's
    frequencies. The weights of order 1 and order 2 are masses of 2**16, order 0 has the rest. They stand by row (how often order 2 was just
    right, how often each entry was, whether both agree) and follow in each lane what came. A range coder takes the whole id in one step: order 2's
    mass, order 1's, then the rest by frequencies. All of it is integers, so both directions agree on any machine.

    A writer knows all ids, so it finds rows and hits with sorts and goes through the ids only for masses and ranges; a reader keeps the entries in cells."""

    def __init__(self, cumulated: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        self.sizes, self.bits = sizes, np.uint64(_bits(len(cumulated) - 1))
        self.spans = cumulated[:-1] | np.diff(cumulated) << DIGIT  # a symbol's first place in order 0, and its frequency
        self.range, self.masses = np.full(n, (1 << 64) - 1, np.uint64), np.tile(_masses(), n)

    def steps(self) -> Iterator[tuple[int, int]]:
        """Places of the blocks, and how many lanes still run there."""
        for t in range(int(self.sizes.max(initial=0))):
            yield t, len(self.sizes) - int(self.sizes[-1] <= t)

    def written(self, ids: np.ndarray) -> list[bytes]:
        """The streams of the symbol numbers `ids` (lane, place)."""
        n = len(self.sizes)
        rows, order = np.empty((BLOCK, n), np.uint8), np.empty((BLOCK, n), np.uint8)
        for a in range(0, n, 64):
            rows[:, a : a + 64], order[:, a : a + 64] = (x.T for x in _foreseen(ids[a : a + 64]))
        ids = np.ascontiguousarray(ids.T)
        low, digits = np.zeros(n, np.uint64), np.zeros((BLOCK + 4) * n, np.uint64)  # digit, lane
        at, base = np.arange(n), np.arange(n) * ROWS
        for t, m in self.steps():
            row = base[:m] + rows[t, :m]
            mass, by, own = self.masses.take(row), order[t, :m], ids[t, :m]
            two, one = mass >> np.uint32(16), mass & np.uint32(0xFFFF)
            unit = self.range[:m] >> SPLIT_BITS
            left = unit * two
            both = left + unit * one
            rest = (self.range[:m] - both) >> self.bits
            span = self.spans.take(own)
            start, size = both + rest * (span & LOW), rest * (span >> DIGIT)
            mass -= (mass >> PACE) & KEPT
            hits = by.nonzero()[0]  # few, so the common case runs on all lanes and these are put right
            far, left, both = by[hits] == 2, left[hits], both[hits]
            start[hits], size[hits] = np.where(far, np.uint64(0), left), np.where(far, left, both - left)
            mass[hits] += np.where(far, *PULL)
            self.masses[row] = mass
            start += low[:m]
            carried = (start < low[:m]).nonzero()[0]
            if len(carried):
                digits[at[carried] - n] += np.uint64(1)
            low[:m], self.range[:m] = start, size
            ready = (size < BOTTOM).nonzero()[0]
            place = at[ready]
            digits[place] = start[ready] >> DIGIT
            at[ready] = place + n
            low[ready], self.range[ready] = start[ready] << DIGIT, size[ready] << DIGIT
        for shift in (DIGIT, np.uint64(0)):
            digits[at] = (low >> shift) & LOW
            at += n
        stops = at // max(n, 1)
        digits = digits.reshape(BLOCK + 4, n)[: stops.max(initial=0)]
        for t in range(len(digits) - 1, 0, -1):
            digits[t - 1] += digits[t] >> DIGIT
        return [x[:stop].tobytes() for x, stop in zip(np.ascontiguousarray(digits.astype(">u4").T), stops.tolist())]

    def read(self, streams: list[bytes]) -> np.ndarray:
        """The symbol numbers (place, lane) of `streams`."""
        n = len(self.sizes)
        digits = np.append(np.frombuffer(b"".join(streams), ">u4").astype(np.uint32), np.zeros(BLOCK + 4, np.uint32))  # a damaged stream may ask for more
        at = np.cumsum([0, *(len(x) // 4 for x in streams)])[:n]
        value = digits[at].astype(np.uint64) << DIGIT | digits[at + 1]
        at, lane, base = at + 2, np.arange(n) * CELLS, np.arange(n) * ROWS
        # an entry: its id and one, over six bits with its state in the order's unit of a row
        cells = [np.zeros(n * CELLS, np.uint32), np.zeros(n * CELLS, np.uint32)]
        runs, hashed, before = base.copy(), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        symbols = np.arange(len(self.spans), dtype=np.uint16 if len(self.spans) <= 1 << 16 else np.uint32)
        symbol_at = np.repeat(symbols, (self.spans >> DIGIT).astype(np.int64))
        six, state = np.uint32(6), np.uint32(63)
        out = np.zeros((BLOCK, n), np.uint32)
        for t, m in self.steps():
            one_at, two_at = lane[:m] + (hashed[:m] >> SHIFT), lane[:m] + ((hashed[:m] ^ before[:m] * BEFORE) >> SHIFT)
            one_cell, two_cell = cells[0].take(one_at), cells[1].take(two_at)
            one_id, two_id = one_cell >> six, two_cell >> six
            row = runs[:m] + ((one_cell & state) + (two_cell & state) + (one_id == two_id))
            mass = self.masses.take(row)
            two, one = mass >> np.uint32(16), mass & np.uint32(0xFFFF)
            unit = self.range[:m] >> SPLIT_BITS
            left = unit * two
            both = left + unit * one
            rest = (self.range[:m] - both) >> self.bits
            now = value[:m]
            own = symbol_at.take(((now - both) // rest).view(np.int64), mode="clip").astype(np.int64)
            span = self.spans.take(own)
            start, size, found = both + rest * (span & LOW), rest * (span >> DIGIT), own.astype(np.uint32) + np.uint32(1)
            mass -= (mass >> PACE) & KEPT
            hits = (now < both).nonzero()[0]  # few, so the common case runs on all lanes and these are put right
            left, both = left[hits], both[hits]
            far = now[hits] < left
            start[hits], size[hits] = np.where(far, np.uint64(0), left), np.where(far, left, both - left)
            found[hits] = np.where(far, two_id[hits], one_id[hits])
            mass[hits] += np.where(far, *PULL)
            self.masses[row] = mass
            now -= start
            self.range[:m] = size
            ready = (size < BOTTOM).nonzero()[0]
            place = at[ready]
            value[ready] = value[ready] << DIGIT | digits[place]
            at[ready] = place + 1
            self.range[ready] = size[ready] << DIGIT
            entry = found << six
            proven = (one_id == found).nonzero()[0]
            one, two = entry + np.uint32(10), entry + np.uint32(2)
            one[proven] = entry[proven] + np.minimum((one_cell[proven] & state) + np.uint32(10), np.uint32(40))
            far = hits[far]
            two[far] = entry[far] + np.minimum((two_cell[far] & state) + np.uint32(2), np.uint32(8))
            cells[0][one_at], cells[1][two_at] = one, two
            run = np.minimum(runs[far] + 50, base[far] + 100)
            runs[:m] = base[:m]
            runs[far] = run
            before[:m] = hashed[:m]
            hashed[:m] = found * AGAIN
            out[t, :m] = found
        return out - np.uint32(1)


def _foreseen(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all ids (lane, place) at once what a reader finds in its cells: the row of masses, and the order that is right (2, 1, or 0 for neither)."""
    n, width = ids.shape
    hashed = np.zeros((n, width + 2), np.uint32)
    hashed[:, 2:] = (ids.astype(np.uint32) + np.uint32(1)) * AGAIN
    places = hashed[:, 1:-1] >> SHIFT, (hashed[:, 1:-1] ^ hashed[:, :-2] * BEFORE) >> SHIFT
    states, expected = [], []
    lane = np.arange(n, dtype=np.int64)[:, None] * width
    for place in places:
        keys = np.sort(place << np.uint32(12) | np.arange(width, dtype=np.uint32), axis=1)  # BLOCK places need 12 bits
        by, sorted_place = lane + (keys & np.uint32(BLOCK - 1)), keys >> np.uint32(12)
        sorted_ids = ids.reshape(-1).take(by)
        seen = np.zeros((n, width + 3), np.int8)  # right predictions, three places on
        known = sorted_place[:, 1:] == sorted_place[:, :-1]
        seen[:, 4:] = known & (sorted_ids[:, 1:] == sorted_ids[:, :-1])
        a, b, c = seen[:, 2:-1], seen[:, 1:-2], seen[:, :-3]
        state = 1 + a * (1 + b * (1 + c))
        state[:, 0] = 0
        state[:, 1:] *= known
        before = np.full((n, width), -1, np.int32)
        np.copyto(before[:, 1:], sorted_ids[:, :-1], where=known)
        states.append(np.empty((n, width), np.int8))
        expected.append(np.empty((n, width), np.int32))
        states[-1].reshape(-1)[by] = state
        expected[-1].reshape(-1)[by] = before
    hit = [e == ids for e in expected]
    runs = np.zeros((n, width + 2), np.uint8)
    runs[:, 2:] = hit[1]
    run = runs[:, 1:-1] * (1 + runs[:, :-2])
    rows = run * np.uint8(50) + states[0].astype(np.uint8) * np.uint8(10) + states[1].astype(np.uint8) * np.uint8(2) + (expected[0] == expected[1])
    return rows, np.where(hit[1], 2, hit[0]).astype(np.uint8)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in ascending order, each id's place among them, and their counts; without a sort where ids are small, as a vocabulary's are."""
    if len(ids) == 0 or ids.max() >= 1 << 20:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = counts.nonzero()[0]
    number = np.zeros(len(counts), np.int32)
    number[symbols] = np.arange(len(symbols))
    return symbols, number.take(ids), counts[symbols]


def packed(ids: np.ndarray) -> bytes:
    """The blocks of `ids` (uint32), behind their rounded counts and a directory of sizes, checksums and stream lengths."""
    n, starts = len(ids), np.arange(0, len(ids), BLOCK)
    lanes = len(starts)
    symbols, numbers, counts = _numbered(ids)
    rounded = _rounded(counts)
    sizes = np.diff(np.append(starts, n))
    grid = np.zeros(lanes * BLOCK, np.int32)
    grid[:n] = numbers
    streams = _Lanes(_cumulated(rounded), sizes).written(grid.reshape(lanes, BLOCK))
    heads = [struct.pack("<III", int(z), zlib.crc32(s, zlib.crc32(ids[a : a + z].astype("<u4").tobytes())), len(s)) for a, z, s in zip(starts.tolist(), sizes, streams)]
    head = zlib.compress(np.diff(symbols.astype("<u4"), prepend=np.uint32(0)).tobytes() + rounded.tobytes(), 6)
    return MAGIC + struct.pack("<IIIQ", len(symbols), len(head), lanes, n) + head + b"".join(heads) + b"".join(streams)


def unpacked(data: bytes, blocks: list[int] | None = None) -> np.ndarray:
    """The ids of `packed`, of all blocks or of the given ones in ascending order; a block whose checksum differs raises."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    distinct, head, lanes, _ = struct.unpack_from("<IIIQ", data, 4)
    table = zlib.decompress(data[24 : 24 + head])
    symbols = np.cumsum(np.frombuffer(table, "<u4", distinct), dtype=np.int64).astype("<u4")
    heads = np.frombuffer(data, "<u4", 3 * lanes, 24 + head).reshape(lanes, 3).astype(np.int64)
    stops = 24 + head + 12 * lanes + np.cumsum(heads[:, 2])
    chosen = list(range(lanes)) if blocks is None else sorted(set(blocks))
    streams = [data[stops[i] - heads[i, 2] : stops[i]] for i in chosen]
    grid = _Lanes(_cumulated(np.frombuffer(table, np.uint8, distinct, 4 * distinct)), heads[chosen, 0]).read(streams)
    out = []
    for lane, i in enumerate(chosen):
        own = symbols[np.minimum(grid[: heads[i, 0], lane], distinct - 1)]
        if zlib.crc32(streams[lane], zlib.crc32(own.tobytes())) != heads[i, 1]:
            raise ValueError(f"block {i} is damaged")
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


# The letters and numbers of U+0000 to U+017F in the library's byte-level pattern, which cuts a text into
# 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before a word|white space
LETTER, NUMBER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PLAIN = "\\t\\n\\r\\x20-\\x7e\u00a1-\u017f"
BLANK, OTHER, LEAD, NEXT, HARD = 0, 3, 4, 5, 6  # kinds of a byte; 1 and 2: of a letter, of a number
KINDS = np.array([HARD if not re.match(f"[{PLAIN}]", c) else BLANK if c.isspace() else 1 if re.match(f"[{LETTER}]", c) else 2 if re.match(f"[{NUMBER}]", c) else OTHER for c in map(chr, range(0x180))], np.uint8)
BYTE_KINDS = np.concatenate([KINDS[:0x80], np.full(0x40, NEXT, np.uint8), np.full(2, HARD, np.uint8), np.full(4, LEAD, np.uint8), np.full(0x3A, HARD, np.uint8)]).tobytes()
QUOTED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """Each byte's kind; the two bytes of a character beyond ASCII have its kind. LEAD and above: not of a plain text."""
    kinds = np.frombuffer(bytearray(data).translate(BYTE_KINDS), np.uint8)
    lead = (kinds[:-1] == LEAD).nonzero()[0]
    lead = lead[kinds[lead + 1] == NEXT]
    kinds[lead] = kinds[lead + 1] = KINDS[(data[lead] & 31).astype(np.int64) << 6 | data[lead + 1] & 63]
    return kinds


def word_starts(data: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of the words of the byte-level pattern, for plain texts in one array of bytes that start at `starts` (of texts that are not empty)."""
    first = np.ones(len(data) + 1, bool)  # and one place for the end
    first[1:-1] = kinds[1:] != kinds[:-1]
    first[starts] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[-1] = True
    # the last white space before a word is cut off, and a space goes with that word
    blank = kinds == BLANK
    ends = (blank[:-1] & ~blank[1:] & ~edge[1:-1]).nonzero()[0]
    first[ends] = True
    first[ends[data[ends] == 0x20] + 1] = False
    # an apostrophe that begins a word takes the letters of a contraction
    quotes = ((data == 0x27) & first[:-1]).nonzero()[0]
    for letters in QUOTED:
        fits, at = quotes, quotes
        for letter in letters:
            at = at + 1
            inside = ~edge[at]
            fits, at = fits[inside], at[inside]
            inside = data[at] == letter
            fits, at = fits[inside], at[inside]
        first[fits + 1] = False
        first[at + 1] = True
    return first[:-1].nonzero()[0]


class JoinedWords:
    """Ids of distinct words in Arrow arrays. New words go to the library's model in one call, joined by NUL, which is in no plain text; a memo of bounded size keeps the
    words seen first, over all tasks of a worker."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = tokenizer.model
        self.joined = Tokenizer(self.model)
        self.joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: spell(chr(c))[0][0] for c in range(1, 0x180)}  # the library's letters for the bytes of a character
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.memo, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One array of ids, and where in it each word's begin and end."""
        looked = min(len(self.memo), 8 * len(words))  # a lookup hashes the memo, so few words look at its first entries only
        known = pc.index_in(words, value_set=self.memo.slice(0, looked))
        new = words.filter(known.is_null())
        found, sizes = self.encoded(new)
        ids, ends = np.concatenate([self.ids, found]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = known.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.memo) + np.arange(len(new))
        kept = min(len(self.memo) + len(new), 5 * WordIds.LIMIT)  # an entry takes a fifth of the memory of one in a dict
        if looked == len(self.memo) < kept:
            self.memo = pa.concat_arrays([self.memo, new.slice(0, kept - len(self.memo))])
            self.ids, self.ends = ids[: ends[kept]], ends[: kept + 1]
        return ids, ends.take(at), ends.take(at + 1)

    def encoded(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has: a word ends with the id whose bytes end with its bytes."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        spelt = "\0".join(words.to_numpy(zero_copy_only=False)).translate(self.letters)
        ids = np.array(self.joined.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, np.uint32)
        ends, stops = np.cumsum(self.n_bytes.take(ids)), np.cumsum(pc.binary_length(words).to_numpy())
        last = np.searchsorted(ends, stops)
        if len(ids) and ends[-1] == stops[-1] and (ends.take(last) == stops).all():
            return ids, np.diff(last, prepend=-1)
        each = [[t.id for t in self.model.tokenize(w)] for w in spelt.split("\0")]  # a vocabulary without some bytes
        return np.array([i for found in each for i in found], np.uint32), np.array([len(found) for found in each], np.int64)


class ByteTokenizer:
    """A byte-level BPE file of the tokenizers library. Texts of Latin letters are cut into the words of the library's own pattern, all texts of a batch
    at once, and each distinct word is encoded once; all other texts, and those with a special token's string, go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = JoinedWords(self.tokenizer)

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        data, bounds = _bytes(texts)
        kinds = byte_kinds(data)
        hard = np.zeros(len(texts), bool)
        hard[np.searchsorted(bounds, (kinds >= LEAD).nonzero()[0], "right") - 1] = True
        for s in self.special:
            hard |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not hard.any():
            return self.plain(data, kinds, bounds)
        data, bounds = _bytes(texts.filter(pa.array(~hard)))
        easy, whole = iter(self.plain(data, byte_kinds(data), bounds)), iter(self.tokenizer.encode_batch_fast(texts.filter(pa.array(hard)).to_pylist(), add_special_tokens=False))
        return [np.array(next(whole).ids, np.uint32) if h else next(easy) for h in hard]

    def plain(self, data: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        if not len(data):
            return [np.zeros(0, "<u4")] * (len(bounds) - 1)
        starts = word_starts(data, kinds, bounds[:-1][bounds[:-1] < bounds[1:]])
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        ids, begins, stops = self.words(words.dictionary)
        code = words.indices.to_numpy()
        sizes = (stops - begins).take(code)
        ends = np.append(0, np.cumsum(sizes))
        out = ids.take(np.repeat(begins.take(code) - ends[:-1], sizes) + np.arange(ends[-1]))
        stops = ends[np.searchsorted(starts, bounds)].tolist()
        return [out[a:b] for a, b in zip(stops, stops[1:])]


def _bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


@lru_cache(maxsize=2)
def _tokenizer(name: str) -> ByteTokenizer:
    return ByteTokenizer(SparkFiles.get(name))


SEGMENT = "part int, seq int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
TEXT_BYTES = 8 << 20


def write_ids(documents: DataFrame, tokenizer_path: str, path: str, partitions: int) -> None:
    """Segments of all documents under `path`, ascending by doc_id. One shuffle, of the texts by range of doc_id."""
    sc = documents.sparkSession.sparkContext
    sc.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        encode, part = _tokenizer(name), TaskContext.get().partitionId()
        docs, ids, held, seq, before = [], [], 0, 0, 0

        def segment():
            nonlocal docs, ids, held, seq, before
            row = {"part": part, "seq": seq, "before": before, "n_ids": held, "doc_ids": docs, "lengths": [len(x) for x in ids], "payload": packed(np.concatenate(ids))}
            docs, ids, seq, before, held = [], [], seq + 1, before + held, 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        end = np.array([END], np.uint32)
        for batch in batches:
            for start, stop in portions(batch.column("text")):
                own = batch.slice(start, stop - start)
                for doc, found in zip(own.column("doc_id").to_pylist(), encode(own.column("text"))):
                    docs.append(doc)
                    ids.append(np.concatenate([found, end]))
                    held += len(found) + 1
                    if held >= SEGMENT_IDS:
                        yield segment()
        if docs:
            yield segment()

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.octet_length("text"), F.crc32(F.col("text").cast("binary"))]
    ranged = narrow.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    ranged.mapInArrow(run, SEGMENT).write.parquet(path)


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about TEXT_BYTES of text each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t.as_buffer()) if t.is_valid else 0
        if size >= TEXT_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files. Starts need one sum per written part only."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = dict(sorted((r[0], r[1]) for r in segments.groupBy("part").agg(F.sum("n_ids")).collect()))  # bounded by the number of files
    offsets, total = {}, 0
    for part, n in totals.items():
        offsets[part] = total
        total += n

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in ("part", "before", "doc_ids", "lengths", "payload")}
                ids, sizes = unpacked(row["payload"].as_py()), row["lengths"].as_py()
                stops = np.cumsum(sizes)
                starts = stops - sizes
                raw = ids.tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                base = offsets[row["part"].as_py()] + row["before"].as_py()
                columns = [pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(starts + base, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, stops)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return segments.select("part", "before", "doc_ids", "lengths", "payload").mapInArrow(run, DOCUMENT + (", ids array<int>" if with_ids else ""))


def coded_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids of all documents to the shared folder and return what the files give back."""
    spark = documents.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(documents, tokenizer_path, path, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return read_ids(spark, path)
