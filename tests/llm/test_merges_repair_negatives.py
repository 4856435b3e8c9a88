"""Byte-level merges, turn repair and hard negatives against plain versions, on small fixtures with awkward rows."""

import base64
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pyspark.sql import functions as F
from terrace.llm import byte_merges, hard_negatives, repair
from terrace.llm.common import shipped

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(autouse=True)
def package(spark):
    shipped(spark)


# ---- byte-level merges ----------------------------------------------------------------------------


def library(path=RANKS):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "a", "The quick brown fox, don't they'll  jump!\n\n", "a" * 3000 + " " * 2000 + "x", "中文" * 300 + "é  x 'll'S <|endoftext|>\r\n\n  y", "=-" * 800 + "🙂🙃" * 40,
    "\x00\x01\x02 the\x01the\x02 \x1c\x85  　 z", "naïve café Привет мир ١٢٣ ½", "The quick brown fox", "The quick brown fox", "�\U0010ffff",
]


@pytest.mark.parametrize("known", [0, 5, 1 << 17])
def test_ids_are_those_of_the_library(spark, known):
    frame = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = byte_merges.encoded(frame, RANKS, ["doc_id", "ids"], into="tokens", known_words=known).collect()
    want = {i: library().encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["tokens"] for r in got} == want
    assert {r["ids"] for r in got} == {"kept"}


def test_digests_of_ids_and_of_decoded_bytes(spark):
    frame = spark.createDataFrame([*enumerate(TEXTS), (0, "repeated id")], "doc_id long, text string")
    got = sorted(map(tuple, byte_merges.digests(frame, RANKS).collect()))
    want = []
    for i, text in [*enumerate(TEXTS), (0, "repeated id")]:
        ids = library().encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_merges.digests(frame.limit(0), RANKS).collect() == []


def test_another_rank_file(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in byte_merges.encoded(frame, path, ["doc_id"]).collect()}
    assert got == {i: library(path).encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_ids_must_not_replace_a_kept_column(spark):
    with pytest.raises(ValueError):
        byte_merges.encoded(spark.createDataFrame([(1, "x")], "ids long, text string"), RANKS, ["ids"])


def test_tokens_that_their_bytes_do_not_reach(spark, tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257, b" q": 258}  # abcd: no pair gives it
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    read = byte_merges.Ranks(ranks)
    assert read.alone == [b"abcd"] and read.pairs == {(97, 98): 256, (32, 113): 258}
    frame = spark.createDataFrame([(1, "abcd abcd q abab")], "doc_id long, text string")
    got = byte_merges.encoded(frame, str(path), ["doc_id"]).first()["ids"]
    assert got == tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("abcd abcd q abab")
    with pytest.raises(ValueError):
        byte_merges.Ranks({bytes([b]): b + 10 for b in range(256)} | {b"ab": 5, b"abc": 3})


# ---- turn repair ----------------------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Rows (turn, role, text) of one conversation, by plain dynamic programming over (cost, audit, lines)."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest())
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @functools.lru_cache(None)
    def rest(i, state, inserts):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, s, lines = rest(i + 1, state, 3)
            options.append((c + 3, "D" + s, lines))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role[:1] == after[state] or (role[:1] == "s" and state == ""):
                    c, s, lines = rest(i + 1, role[:1], 3)
                    options.append((c + cut, "K" + s, (f"{role}:{text}", *lines)))
                c, s, lines = rest(i + 1, after[state], 3)
                options.append((c + cut + 2, "R" + s, (f"{names[after[state]]}:{text}", *lines)))
        if inserts:
            c, s, lines = rest(i, after[state], inserts - 1)
            options.append((c + 2, "I" + s, (names[after[state]] + ":", *lines)))
        return min(options) if options else (10**9, "", ())

    cost, audit, lines = rest(0, "", 3)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def conversations(n, seed):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for i in range(rng.choice([1, 2, 3, 5, 8, 13, 40])):
            turn = rng.choice([None, i, i, i, i, i + 1, 2 * i])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "umpire"])
            out.append((conv, turn, role, rng.choice([f"Text {i}.", f"Text {i}.", "Same!", "cut off", f"cut {i}\n", "", " \x0b", None, "é。", "Fine? "])))
    return out


@pytest.mark.parametrize("piece_rows, partitions", [(4096, 4), (4096, 23), (4, 4), (8, 1)])
def test_repairs_are_the_cheapest_and_least(spark, piece_rows, partitions):
    data = conversations(60, piece_rows + partitions)
    frame = spark.createDataFrame([(*r, 1, 2) for r in data], "conv_id long, turn long, role string, text string, fault int, key int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r[0]: tuple(r)[1:] for r in repair.repaired(frame, piece_rows=piece_rows).collect()}
        lines = repair.repaired(frame, lines=True, piece_rows=piece_rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {c: plain_repair([r[1:] for r in data if r[0] == c]) for c in {r[0] for r in data}}
    assert got == {c: w[:-1] for c, w in want.items()}
    for c, w in want.items():
        mine = sorted((r["line"], f"{r['role']}:{r['text']}") for r in lines if r["conv_id"] == c)
        assert [x for _, x in mine] == list(w[-1])


def test_a_long_conversation_and_long_texts(spark):
    roles = ["user", "assistant", "assistant", "system", "user"]
    frame = spark.range(30_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, roles)), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")).alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    long = spark.createDataFrame([(8, 0, "user", "x" * 3_000_000), (8, 1, "assistant", "y " * 1_000_000 + "!")], "conv_id long, turn long, role string, text string")
    data = frame.unionByName(long)
    got = {r["conv_id"]: r for r in repair.repaired(data).collect()}
    order = [(r["role"], r["text"]) for r in frame.orderBy("turn").collect()]
    back, states, symbols = [repair.END], repair.NOTHING, [2 * "sua".index(r[0]) for r, _ in order]
    for s in reversed(symbols):
        back.append(repair.in_front(s, back[-1]))
    assert got[7]["cost"] == back[-1][states] and got[7]["gaps"] == 0
    assert got[8]["truncated"] == 1 and got[8]["audit"] == "KK" and got[8]["cost"] == 1


def test_no_rows_no_result(spark):
    assert repair.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_block_tables_are_the_single_steps():
    t, rng = repair.tables(), random.Random(5)
    for _ in range(300):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randint(0, 30)))
        vector = rng.randrange(len(t.vectors))
        costs = [t.vectors[vector]]
        for s in reversed(symbols):
            costs.append(repair.in_front(s, costs[-1]))
        behind, front, paid = t.backward(symbols, vector)
        assert tuple(x + paid for x in t.vectors[front]) == costs[-1]
        assert len(behind) == -(-len(symbols) // repair.BLOCK)


# ---- hard negatives -------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 300, 2**20, 2**40, 1e200])
def test_scores_by_residues_are_exact(size):
    rng = np.random.default_rng(2)
    for dims in (1, 3, 64, 1500):
        rows, anchors = (np.floor(rng.normal(size=(n, dims)) * size) for n in (6, 4))
        got = hard_negatives.scores(rows, anchors)
        want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in anchors] for x in rows]
        assert got.tolist() == want


def test_keys_sort_as_scores():
    values = [0, 1, -1, 9, 10, -9, -10, 99, 100, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 10**300, -(10**300)]
    keys = sorted(map(hard_negatives.sortable, values))
    assert [hard_negatives.value_of(k) for k in keys] == sorted(values)


def plain_negatives(rows, positives=5, negatives=3):
    rows = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, label, v) in enumerate(rows):
        if i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, lab, n) for n, (j, lab, w) in enumerate(rows) if n != at and len(w) == len(v)), key=lambda x: (x[0], x[1], x[3]))
        for p, pid, _, _ in [x for x in scored if x[2] == label][:positives]:
            found = [x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
            out += [(i, pid, rank + 1, x[1], *(s if -(2**63) <= s < 2**63 else None for s in (-p, -x[0]))) for rank, x in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [1.0, 1e30])
def test_negatives_against_all_pairs(spark, scale):
    rng = random.Random(4)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    data = []
    for i in range(260):
        c = rng.choice(centre)
        data.append((i, rng.choice([0, 1, 1, 2]), [scale * (x + rng.gauss(0, 0.4)) for x in c]))
    data += [(50, 1, data[50][2]), (50, 1, data[50][2]), (3, 2, data[50][2])]  # repeated rows and ids
    data += [(100, None, [1.0] * 6), (150, 1, None), (None, 1, [1.0] * 6), (200, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (250, 1, [float("nan")] * 6), (0, 1, [float("inf")] * 6)]
    data += [(300, 1, [1.0, 2.0]), (301, 1, [2.0, 1.0]), (302, 2, [1.0, 1.0]), (350, 1, []), (351, 1, []), (352, 2, []), (400, 1, [5.0] * 3)]
    frame = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, label int, embedding array<double>, row string")
    rows = hard_negatives.taking_part(frame, F.col("label"))
    got = hard_negatives.hard_negatives(rows, rows.where("vec_id % 50 = 0"), 5, 3, 50, 95).collect()
    assert sorted(map(tuple, got), key=str) == plain_negatives(data)


def test_no_vectors(spark):
    rows = hard_negatives.taking_part(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), F.col("label"))
    assert hard_negatives.hard_negatives(rows, rows, 5, 3, 50, 95).collect() == []


# ---- pipeline stages ------------------------------------------------------------------------------


def test_stages_keep_columns_that_are_called_as_those_of_operators(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    own = {"keep": F.lit("mine"), "tail": F.lit(-5), "expected_grade": F.lit("x"), "item_id": F.col("doc_id") * 2, "coverage": F.lit("c"), "n_items": F.lit("n"), "contaminated": F.lit("no"), "least": F.lit("l"), "component_rows": F.lit("r")}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    clashing = docs.withColumns(own)
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        plain, got = stage(spark, docs, sf), stage(spark, clashing, sf)
        assert got.columns == clashing.columns
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in plain.collect())
        assert {(r["keep"], r["tail"], r["expected_grade"], r["contaminated"], r["least"], r["item_id"] - 2 * r["doc_id"]) for r in got.collect()} <= {("mine", -5, "x", "no", "l", 0)}
    assert corpus_pipeline.token_ids(spark, docs.select("doc_id", "text"), sf).columns[0] == "doc_id"


def test_merges_of_many_words_at_once_are_those_of_the_library():
    """Overlapping equal pairs, an empty word and words that end in different rounds, and each distinct word merged once whatever is kept."""
    merges = byte_merges.Merges(byte_merges.read(RANKS))
    words = [b"", b"a", b"a" * 7, b" the", b"abababab", "naïveté".encode(), bytes(range(256)), b" internationalisation", b"=" * 1001]
    bpe = library()._core_bpe
    assert [np.frombuffer(x, "<u4").tolist() for x in merges(words)] == [bpe.encode_single_piece(w) if w else [] for w in words]
    for kept in (0, 3, 100):  # of "one", " one", "two", " two"
        encode = byte_merges.Encoder(RANKS, byte_merges.PATTERN, kept)
        seen, inner = [], encode.merges
        encode.merges = lambda new: seen.append(sorted(new)) or inner(new)
        for _ in range(2):
            assert [x.tolist() for x in encode(["one two one", "two", ""])] == [library().encode_ordinary(t) for t in ("one two one", "two", "")]
        assert len(encode.known) == min(kept, 4) and len(seen[0]) == 4 and len(seen[1]) == 4 - min(kept, 4)
