"""Cheapest repair of the turn structure of conversations, with Four-Russians block tables.

A conversation is a string of symbols, one per row: the initial of its role (s, u, a or other) with or without a missing end, or "must be deleted" (blank or
seen before). A repair keeps, re-roles, deletes and inserts so that the initials read `(s?(ua)+)?`. For every place, a vector holds what the rest costs from
each of the four states of that pattern. Vectors less their least entry are few, so `Tables` computes for every vector and every block of BLOCK symbols the
vector in front of the block and the cost in between; a conversation is processed from its end by one lookup per block. The audit is then read from the
start: each block is expanded backward from the vector behind it, and of the cheapest edits the ASCII-least is taken at every step, which gives the least
string because the costs to go are exact. An expanded block is kept for the next one like it.

On Spark: rows seen before are found by a window over (conversation, digest of role and text); rows are range-partitioned and sorted by conversation and turn.
A conversation inside one partition is finished where it lies. The first and last of a partition, and those of more than PIECE_ROWS rows or PIECE_BYTES bytes,
become pieces of that size, which are then streamed conversation by conversation, backward for the vectors and forward for the texts, with one piece in
memory. (A SHA-256 of a conversation can only be computed in one sequence; nothing else of a long conversation is held.)

Nulls: a null role or text is one space; a null turn comes first; the rows without conv_id are one conversation. Rows with the same turn go by role and then
by the MD5 of role and text; repeated rows stay, as duplicates. Extra columns take no part. Without rows the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import stored

BLOCK = 4
PIECE_ROWS = 4096  # a multiple of BLOCK
PIECE_BYTES = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # state: the last initial
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEXT = [USER, USER, ASSISTANT, USER]  # what may be inserted, or re-roled to, from each state
GONE = 8  # symbol of a row that must be deleted; others are 2 * initial (s, u, a, other) + truncated
KEPT = [{NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {}]
DELETE, INSERT, REROLE = 3, 2, 2
END = (0, 4, 2, 0)  # what is missing behind the last row
EXPANDED = 100_000


def in_front(symbol: int, behind: tuple) -> tuple:
    """Costs from each state in front of a row, given those behind it."""
    here = []
    for state in range(4):
        cost = DELETE + behind[state]
        if symbol != GONE:
            cut = symbol & 1
            cost = min(cost, REROLE + cut + behind[NEXT[state]])
            if state in KEPT[symbol >> 1]:
                cost = min(cost, cut + behind[KEPT[symbol >> 1][state]])
        here.append(cost)
    once = [min(here[q], INSERT + here[NEXT[q]]) for q in range(4)]
    return tuple(min(once[q], INSERT + once[NEXT[q]]) for q in range(4))


def edit(symbol: int, here: tuple, behind: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least edit in front of or at a row that is on a cheapest way, and the state after it."""
    if here[state] == DELETE + behind[state]:
        return "D", state
    if here[state] == INSERT + here[NEXT[state]]:
        return "I", NEXT[state]
    cut, kept = symbol & 1, KEPT[symbol >> 1].get(state)
    if kept is not None and here[state] == cut + behind[kept]:
        return "K", kept
    return "R", NEXT[state]


class Tables:
    """Transitions of normalised cost vectors over blocks of BLOCK symbols."""

    def __init__(self):
        self.vectors, number = [END], {END: 0}
        step, cost = [], []
        for v in self.vectors:  # grows while it is read, until no new vector comes
            row = []
            for symbol in range(GONE + 1):
                front = in_front(symbol, v)
                least = min(front)
                plain = tuple(x - least for x in front)
                if plain not in number:
                    number[plain] = len(self.vectors)
                    self.vectors.append(plain)
                row.append((number[plain], least))
            step.append([n for n, _ in row])
            cost.append([c for _, c in row])
        self.step, self.cost = step, cost
        after, paid = np.array(step), np.array(cost)
        for _ in range(BLOCK.bit_length() - 1):  # twice the length: first the right half, then the left one
            n, width = after.shape
            left = after[after]  # vector, symbols of the right half, symbols of the left half
            total = paid[:, :, None] + paid[after]
            after, paid = left.transpose(0, 2, 1).reshape(n, width * width), total.transpose(0, 2, 1).reshape(n, width * width)
        self.after, self.paid = after.tolist(), paid.tolist()
        self.memo: dict[tuple, tuple[str, int]] = {}

    def backward(self, symbols: bytes, vector: int) -> tuple[list[int], int, int]:
        """(vector behind each block of `symbols` from the left, vector in front of all, cost in between), given the vector behind them."""
        whole = len(symbols) - len(symbols) % BLOCK
        behind, cost = [], 0
        if whole < len(symbols):
            behind.append(vector)
            for s in reversed(symbols[whole:]):
                cost += self.cost[vector][s]
                vector = self.step[vector][s]
        for at in range(whole - BLOCK, -1, -BLOCK):
            behind.append(vector)
            code = 0
            for s in symbols[at : at + BLOCK]:
                code = code * (GONE + 1) + s
            cost += self.paid[vector][code]
            vector = self.after[vector][code]
        return behind[::-1], vector, cost

    def expand(self, block: bytes, vector: int, state: int) -> tuple[str, int]:
        """(edits of a block, state behind it), from the vector behind it and the state in front of it."""
        key = (block, vector, state)
        found = self.memo.get(key)
        if found is None:
            costs = [self.vectors[vector]]
            for s in reversed(block):
                costs.append(in_front(s, costs[-1]))
            costs.reverse()
            edits = []
            for i, s in enumerate(block):
                op = "I"
                while op == "I":
                    op, state = edit(s, costs[i], costs[i + 1], state)
                    edits.append(op)
            if len(self.memo) >= EXPANDED:
                self.memo.clear()
            found = self.memo[key] = ("".join(edits), state)
        return found

    def forward(self, symbols: bytes, behind: list[int], state: int) -> tuple[str, int]:
        out = []
        for i, vector in enumerate(behind):
            edits, state = self.expand(symbols[i * BLOCK : (i + 1) * BLOCK], vector, state)
            out.append(edits)
        return "".join(out), state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


class Repair:
    """One conversation, read piece by piece from its start."""

    def __init__(self, conv_id, lines: bool):
        self.conv_id, self.lines = conv_id, lines
        self.state, self.audit, self.hash, self.any, self.cost, self.line = NOTHING, [], hashlib.sha256(), False, 0, 0
        self.least = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def write(self, op: str, role: str, text: str) -> Iterator[tuple]:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True
        if self.lines:
            yield self.conv_id, self.line, op, role, text
            self.line += 1

    def read(self, piece: Piece, behind: list[int]) -> Iterator[tuple]:
        """Count and repair the rows of a piece; gives the lines, if wanted."""
        for turn, symbol, fault, role in zip(piece.turns, piece.symbols, piece.faults, piece.roles):
            if turn is not None:
                if self.turn is None or turn != self.turn:
                    self.turns += 1
                self.least, self.turn = turn if self.least is None else self.least, turn
            self.blank += fault == 1
            self.duplicate += fault == 2
            self.truncated += fault == 3
            initial = role[:1]
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = initial
        edits, _ = tables().forward(bytes(piece.symbols), behind, self.state)
        self.audit.append(edits)
        at = 0
        for op in edits:
            if op == "I":
                self.state, self.cost = NEXT[self.state], self.cost + INSERT
                yield from self.write(op, ROLES[self.state], "")
                continue
            symbol, role, text = piece.symbols[at], piece.roles[at], piece.texts[at]
            at += 1
            if op == "D":
                self.cost += DELETE
            elif op == "K":
                self.state, self.cost = KEPT[symbol >> 1][self.state], self.cost + (symbol & 1)
                yield from self.write(op, role, text)
            else:
                self.state, self.cost = NEXT[self.state], self.cost + REROLE + (symbol & 1)
                yield from self.write(op, ROLES[self.state], text)

    def close(self) -> Iterator[tuple]:
        """The inserts behind the last row, then the result unless lines are wanted."""
        while END[self.state]:
            self.state, self.cost = NEXT[self.state], self.cost + INSERT
            self.audit.append("I")
            yield from self.write("I", ROLES[self.state], "")
        if not self.lines:
            gaps = 0 if self.least is None else self.turn - self.least + 1 - self.turns
            yield self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


class Piece:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.turns, self.faults, self.roles, self.texts, self.symbols, self.bytes = [], [], [], [], bytearray(), 0

    def add(self, turn, symbol: int, fault: int, role: str, text: str) -> None:
        self.turns.append(turn)
        self.symbols.append(symbol)
        self.faults.append(fault)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def full(self, most: int) -> bool:
        return len(self.symbols) % BLOCK == 0 and (len(self.symbols) >= most or self.bytes >= PIECE_BYTES)


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINES = "conv_id long, line long, edit string, role string, text string"
PIECES = "piece_conv long, part int, seq int, turns array<long>, symbols binary, faults array<int>, roles array<string>, texts array<string>"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
AT_ONCE = 4 << 20


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def in_batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Batches of about AT_ONCE bytes of strings."""
    schema, held, size = arrow_schema(ddl), [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str | bytes)) + (sum(map(len, row[-1])) if isinstance(row[-1], list) else 0)
        if size >= AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def records(batches, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            yield from zip(*(some.column(n).to_pylist() for n in names))


def symbols_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with fault (0 none, 1 blank, 2 seen earlier, 3 truncated), symbol and key (of role and text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    keyed = plain.withColumn("key", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    seen = F.row_number().over(Window.partitionBy("conv_id", "key").orderBy(F.asc_nulls_first("turn")))
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    cut = ~F.substring(body, -1, 1).isin(".", "!", "?")
    fault = F.when(body == "", 1).when(F.col("seen") > 1, 2).when(cut, 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    found = keyed.withColumn("seen", seen).withColumn("fault", fault).drop("seen")
    return found.withColumn("symbol", F.when(F.col("fault").isin(1, 2), GONE).otherwise(place * 2 + (F.col("fault") == 3).cast("int")))


def repaired(rows: DataFrame, lines: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Per conversation of `rows` (conv_id, turn, role, text): gaps in its turns, counts of faults and of illegal neighbours, the cost and the audit of the
    cheapest repair, and the SHA-256 of the repaired `role:text` lines. With `lines`, those lines instead: conv_id, line, edit, role, text."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("key")]
    laid = symbols_of(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("key").withColumn("part", F.spark_partition_id())
    ddl = LINES if lines else AUDITS
    none = (None,) * len(ddl.split(", ")), (None,) * len(PIECES.split(", "))

    def lay(batches):
        def rows_of() -> Iterator[tuple]:
            piece, seq, conv, first, many, part = Piece(), 0, None, True, False, 0

            def put() -> tuple:
                nonlocal seq
                seq += 1
                return *none[0], conv, part, seq, piece.turns, bytes(piece.symbols), piece.faults, piece.roles, piece.texts

            for c, turn, role, text, fault, symbol, part in records(batches, ["conv_id", "turn", "role", "text", "fault", "symbol", "part"]):
                if c != conv and piece.symbols:
                    if first or many:  # it may have begun in the partition before
                        yield put()
                    else:
                        one = Repair(conv, lines)
                        behind, _, _ = tables().backward(bytes(piece.symbols), 0)
                        for row in one.read(piece, behind):
                            yield *row, *none[1]
                        for row in one.close():
                            yield *row, *none[1]
                    piece, first, many = Piece(), False, False
                elif c != conv:
                    first, many = first and not seq, False
                conv = c
                piece.add(turn, symbol, fault, role, text)
                if piece.full(piece_rows):
                    yield put()
                    piece, many = Piece(), True
            if piece.symbols:
                yield put()

        yield from in_batches(rows_of(), f"{ddl}, {PIECES}")

    done = stored(laid.mapInArrow(lay, f"{ddl}, {PIECES}"), "repair-laid")
    results = [part.split()[0] for part in ddl.split(", ")]
    pieces = done.where("part is not null").select(*[part.split()[0] for part in PIECES.split(", ")])

    def trace_back(batches):
        def rows_of() -> Iterator[tuple]:
            conv, vector, begun = None, 0, False
            for c, part, seq, symbols in records(batches, ["piece_conv", "part", "seq", "symbols"]):
                if not begun or c != conv:
                    conv, vector, begun = c, 0, True
                yield part, seq, vector
                _, vector, _ = tables().backward(symbols, vector)

        yield from in_batches(rows_of(), "part int, seq int, vector int")

    ends = pieces.select("piece_conv", "part", "seq", "symbols").repartition("piece_conv").sortWithinPartitions("piece_conv", F.desc("part"), F.desc("seq"))
    ends = stored(ends.mapInArrow(trace_back, "part int, seq int, vector int"), "repair-ends")

    def follow(batches):
        def rows_of() -> Iterator[tuple]:
            one = None
            for c, turns, symbols, faults, roles, texts, vector in records(batches, ["piece_conv", "turns", "symbols", "faults", "roles", "texts", "vector"]):
                if one is None or c != one.conv_id:
                    if one is not None:
                        yield from one.close()
                    one = Repair(c, lines)
                piece = Piece()
                piece.turns, piece.symbols, piece.faults, piece.roles, piece.texts = turns, symbols, faults, roles, texts
                yield from one.read(piece, tables().backward(symbols, vector)[0])
            if one is not None:
                yield from one.close()

        yield from in_batches(rows_of(), ddl)

    streamed = pieces.join(ends, ["part", "seq"]).repartition("piece_conv").sortWithinPartitions("piece_conv", "part", "seq").mapInArrow(follow, ddl)
    return done.where("part is null").select(*results).unionByName(streamed)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with faults set by the CRC-32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of
    it, 3 repeats it, 4 makes its role user. Nulls are one space in that text, in role and in text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("__what"))
    what = F.col("__what")
    text = F.when(what == 1, "").when(what == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(what == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(what != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")
