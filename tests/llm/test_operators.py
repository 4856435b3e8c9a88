"""The dealt operators against brute force, exact round trips and held-out accuracy, on small fixtures with awkward rows."""

import collections
import itertools
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from terrace.llm import coded, katz, nearjoin, ordinal, pieces, queries, shards, tiling, topk, url_filter, warc
from terrace.llm.common import components, shipped

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def package(spark):
    shipped(spark)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n string, sid string, kind string")  # names that operators use inside


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    out = [None, "", " \n\t ", "one", "two words", "Two  WORDS", "a b c d e"]
    for _ in range(n):
        text = [word() for _ in range(rng.randint(5, 80))]
        out.append(" ".join(text))
        for _ in range(rng.randint(0, 3)):
            near = list(text)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near))
    out.append("very " * 30_000 + "long")
    out += ["exact copy of a text that stands many times"] * 12
    return [(i, t, "x", None, "k") for i, t in enumerate(out)]


def test_permutation_is_a_bijection_and_goes_back():
    for n in (1, 2, 3, 16, 17, 1000, 4097):
        at = shards.permuted(np.arange(n), n)
        assert sorted(at.tolist()) == list(range(n))
        assert shards.permuted(at, n, back=True).tolist() == list(range(n))
    at = shards.permuted(np.arange(1000), 1000)
    assert shards.row_of(int(at[77]) % 16, int(at[77]) // 16, 1000, 16) == 77


def test_shards_hold_every_row_evenly_without_gaps(spark):
    rows = [*corpus(), (None, "no id", None, None, None), (5, "two words", None, None, None)]
    got = shards.shard_rows(docs(spark, rows), 16).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    expect = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2]))
    place = shards.permuted(np.arange(len(rows)), len(rows)).tolist()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=repr) == sorted(((*e, p % 16, p // 16) for e, p in zip(expect, place)), key=repr)
    assert shards.shard_rows(docs(spark, []), 16).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(150)]
    vectors += [(200 + i, vectors[0][1]) for i in range(10)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, []), (None, vectors[1][1]), (50, vectors[50][1]), (400, [0.5, 0.25]), (450, [0.0] * 6), (500, [-0.5, 3.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    clean = topk.quantised(table)
    got = sorted(map(tuple, topk.top_k(clean, clean.where("vec_id % 50 = 0"), 5).collect()))
    whole = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    expect = []
    for q in (i for i in whole if i % 50 == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        expect += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert got == sorted(expect)
    none = topk.quantised(table.limit(0))
    assert topk.top_k(none, none, 5).count() == 0


def test_top_k_keeps_large_components_and_repeated_ids_as_the_sql_does(spark):
    import duckdb
    import pyarrow as pa

    rng = np.random.default_rng(11)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 4)]) for i in range(120)]
    vectors += [(130, [5000.0, 1.0, -1.0, 0.5]), (131, [-9e3, 0.0, 2.0, 1.0]), (150, [1e5, -1e4, 3.0, 0.0]), (200, [-4097.0, 0.25, 0.0, 0.0]), (132, [float("nan")] * 4), (133, [float("inf"), 0.0, 0.0, 0.0])]
    vectors += [(7, [0.9, 0.9, 0.9, 0.9]), (7, [-0.9, 0.1, 0.0, 2.0]), (50, [0.7, -0.7, 0.7, -0.7]), (50, [6e3, 0.0, 1.0, 0.0])]  # repeated ids, also of a query
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    clean = topk.quantised(table)
    got = sorted(map(tuple, topk.top_k(clean, clean.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()))
    duck = duckdb.connect()
    duck.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in vectors], pa.int64()), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32()))}))
    assert got == sorted(duck.execute(queries.SQL["op4_bit_sliced_topk"]).fetchall())
    assert {q for q, *_ in got} == {0, 50, 100, 150, 200} and {130, 131} <= {i for _, _, i, _ in got}


def test_scores_beyond_64_bits_are_not_wrapped(spark):
    values, query = np.array([[1 << 40, 3], [1 << 62, 1 << 62], [2, 1]]), np.array([1 << 30, -(1 << 40)])
    assert topk.exact(values, query).tolist() == [(1 << 70) - 3 * (1 << 40), (1 << 92) - (1 << 102), (1 << 31) - (1 << 40)]
    assert topk.Block(np.array([1, 2, 3]), values).top(3, query, 2)[1].tolist() == [(1 << 70) - 3 * (1 << 40), (1 << 92) - (1 << 102)]
    with pytest.raises(Exception, match="no 64-bit integer"):
        topk.quantised(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_katz_sums_to_one_and_equals_a_plain_version(spark):
    rows = [*corpus(4, 40), (None, "a b", None, None, None)]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows}
    words = {d: (t or "").encode().lower().split() + [b" "] for d, t, *_ in rows}
    uni, pair = collections.Counter(), collections.defaultdict(collections.Counter)
    for d, w in words.items():
        if not held[d]:
            uni.update(w)
            for h, x in zip([None, *w[:-1]], w):
                pair[h][x] += 1
    total, of = sum(uni.values()), lambda counts: [sum(c == r for c in counts) for r in range(1, katz.LIMIT + 2)]
    unigrams, d = katz.Unigrams(total, len(uni), of(uni.values())), katz.Discounts(of([c for f in pair.values() for c in f.values()])).table
    p1 = lambda w: float(unigrams.p(np.array([uni.get(w, 0)]))[0])
    top = katz.LIMIT + 1

    def p(w, h):
        follow = pair.get(h)
        if not follow:
            return p1(w)
        count = sum(follow.values())
        over = count if any(c < top for c in follow.values()) else count + 1
        if follow[w]:
            return d[min(follow[w], top)] * follow[w] / over
        left = 1 - sum(d[min(c, top)] * c for c in follow.values()) / over
        return left / (1 - sum(p1(x) for x in follow if follow[x])) * p1(w)

    assert sum(map(p1, uni)) + p1("never") == pytest.approx(1)
    for h in list(pair)[:20]:
        assert sum(p(w, h) for w in uni) + p("never", h) == pytest.approx(1)
    table = docs(spark, rows).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)))
    for r in katz.scored(table).collect():
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in uni for x in w), total)
        assert r.score == pytest.approx(sum(math.log10(p(x, h)) for h, x in zip([None, *w[:-1]], w)))
        assert r.base_score == pytest.approx(sum(math.log10((uni.get(x, 0) + 0.1) / (total + 0.1 * (len(uni) + 1))) for x in w))
    assert katz.scored(table.limit(0)).count() == 0
    assert [r.score for r in katz.scored(table.where("doc_id < 3").withColumn("held_out", F.lit(True))).collect()] == [0.0] * 3


def brute_components(rows):
    sets = {}
    for i, (d, t, *_) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 62), rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), least.get(r)) for i, r in enumerate(root)), key=repr)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_similar_documents_get_their_component(spark, monkeypatch, chunk):
    monkeypatch.setattr(nearjoin, "CHUNK", chunk)
    rows = [*corpus(5, 40), (None, "exact copy of a text that stands many times", None, None, None), (None, "alone here with no partner at all", None, None, None)]
    got = nearjoin.components_of(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_no_bound_of_the_tree_loses_a_pair():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in rng.integers(1, 3000, 60)]
    sets = base + [np.unique(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(0, 1 << 62, len(s) // 20).astype(np.uint64)])) for s in base]
    label = nearjoin.joined([nearjoin.count_vector(s) for s in sets], np.array([len(s) for s in sets]), nearjoin.verified(sets))
    linked = nearjoin.verified(sets)
    for i, j in itertools.combinations(range(len(sets)), 2):
        if linked(i, j):
            assert label[i] == label[j]


def test_count_vectors_come_back_from_their_bytes():
    for n in (0, 1, 200, 5000):
        own = np.arange(1, n + 1, dtype=np.uint64)
        assert (nearjoin.unpacked_vector(nearjoin.packed_vector(own)) == nearjoin.count_vector(own)).all()
    one = np.full(300, 7, np.uint64)  # not a set, but one group with a count that needs two bytes
    assert nearjoin.packed_vector(one)[:1] == b"2" and nearjoin.unpacked_vector(nearjoin.packed_vector(one)).max() == 300


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", "t").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(9)}}


def test_ids_come_back_from_blocks_and_damage_is_seen():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0), np.array([5]), rng.integers(0, 50257, 9000), np.tile([7, 9, 11], 5000), rng.integers(0, 1 << 24, 5000)):
        ids = ids.astype(np.uint32)
        assert coded.unpacked(coded.packed(ids)).tolist() == ids.tolist()
    data = bytearray(coded.packed(np.tile(np.arange(900, dtype=np.uint32), 9)))
    data[-3] ^= 1
    with pytest.raises(ValueError):
        coded.unpacked(bytes(data))


def test_coder_reads_single_blocks_and_beats_order_zero():
    rng = np.random.default_rng(4)
    p = 1.0 / np.arange(1, 2001)
    words = rng.choice(50_000, 2000, replace=False)
    ids = words[rng.choice(2000, 40_000, p=p / p.sum())].astype(np.uint32)
    for at in range(0, 40_000, 2000):  # passages that come again
        ids[at : at + 1500] = np.tile(ids[at : at + 250], 6)
    data = coded.packed(ids)
    assert coded.unpacked(data, [7, 2]).tolist() == ids[2 * coded.BLOCK : 3 * coded.BLOCK].tolist() + ids[7 * coded.BLOCK : 8 * coded.BLOCK].tolist()
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    order_zero = -(share * np.log2(share)).sum() / 8 * len(ids)
    assert len(data) < order_zero * 2 / 3
    for extreme in ([0], [2**32 - 1, 0, 2**32 - 1], rng.integers(0, 2**32, 5000), np.zeros(20_000), rng.choice([3, 9], 10_000)):
        extreme = np.array(extreme, np.uint32)
        assert coded.unpacked(coded.packed(extreme)).tolist() == extreme.tolist()


def test_coded_documents_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(6, 20), (900, "é ü ñ Ça! 12³ ½\xa0x\u2003 日本 <|endoftext|> I'll  \n\n we", None, None, None), (None, "none", None, None, None)]
    plain, start, expect = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE)), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        expect.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = coded.coded_documents(docs(spark, rows), public_tokenizers.path(queries.BYTE_BPE)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expect, key=repr)
    assert coded.coded_documents(docs(spark, []), public_tokenizers.path(queries.BYTE_BPE)).count() == 0


def test_pieces_agree_with_the_reference_library(spark):
    rows = [*corpus(7, 20), (900, "  é <s> 日本🙂 ▁ \x00 a  b ", None, None, None), (None, "none", None, None, None)]
    got = pieces.encoded(docs(spark, rows), public_tokenizers.path(queries.PIECES), ["doc_id", "n", "sid"]).collect()
    assert len(got) == len(rows) and all(r.parity and r.round_trip for r in got)


def test_unigram_model_is_rebuilt():
    def field(number, value):
        if isinstance(value, bytes):
            return bytes([number << 3 & 0xFF | 2]) + bytes([len(value)]) + value
        return bytes([number << 3 | (5 if isinstance(value, float) else 0)]) + (struct.pack("<f", value) if isinstance(value, float) else bytes([value]))

    scores = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁a", -1.0, 1), ("▁ab", -1.5, 1), ("b", -2.0, 1), ("a", -2.5, 1), ("bb", -2.2, 1), ("▁", -3.0, 1), ("c", -4.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in scores) + field(2, field(3, 1)) + field(3, b"")
    own = pieces.Pieces(data)
    texts = ["", "ab  abb", " a b c", "cab", "xyz a", "aaaabbbb"]
    assert all(own.parity(texts, own.encode(texts)))


def test_tiles_catch_a_passage_in_another_order():
    item = list(range(40))
    text = [*range(900, 920), *item[25:40], 77, *item[0:12], 78, *item[12:25], *item[0:12]]
    found = tiling.tiles(item, text)
    assert sum(n for *_, n in found) == 40
    assert len({i + k for i, _, n in found for k in range(n)}) == 40 == len({j + k for _, j, n in found for k in range(n)})
    assert tiling.tiles(item, list(range(100, 140))) == [] == tiling.tiles([], [])


def test_contaminated_documents_and_no_others(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)] + [(50, "too short"), (51, None), (None, "no id here at all")]
    first = items[0][1].split()
    moved = " ".join([*first[15:], "zz", *first[:15]])
    rows = [(0, f"before {items[3][1].upper()}, after", "", "", ""), (1, moved, "", "", ""), (2, " ".join(first[:14]), "", "", ""), (3, None, "", "", ""), (4, " ".join(rng.choice(words) for _ in range(3000)), "", "", ""), (5, "too short", "", "", "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in tiling.covered(docs(spark, rows), bench).collect()}
    assert {d for d, r in got.items() if r.contaminated} == {0, 1} and len(got) == len(rows)
    assert (got[0].item_id, got[0].coverage, got[1].item_id, got[1].coverage) == (3, 1.0, 0, 1.0)
    assert got[2].coverage == pytest.approx(14 / 30)
    assert tiling.covered(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_archives_come_back_with_revisits(spark):
    long = "x\r\n\r\nWARC/1.1 y" * 100
    rows = [(1, "http://a/", long, "c"), (2, "http://b/", long, "c"), (3, None, long, None), (3, "http://again/", long, None), (4, "u", None, None), (5, "u", "", None), (6, "u\r\nx", "short", None), (7, "u", "short", None), (None, "n", long, None), (None, "m", "only null " * 200, None), (None, "m", "only null " * 200, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, original string")
    got = sorted(map(tuple, warc.archive_pages(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    n = len(long)
    assert got == sorted([(1, n, "revisit", 3), (2, n, "revisit", 3), (3, n, "response", None), (3, n, "response", None), (4, 0, "response", None), (5, 0, "response", None), (6, 5, "response", None), (7, 5, "response", None), (None, n, "revisit", 3), (None, 2000, "response", None), (None, 2000, "response", None)], key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_a_changed_payload_is_seen_when_read_back(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "a payload of some bytes"), (2, "http://b/", "")], "page_id long, url string, html string")
    values = [r.value for r in warc.records(warc.resolved(pages)).collect()]
    for name, old, new in (("same", "", ""), ("bytes", "of some bytes", "of SOME bytes"), ("length", "X-Payload-Length: 23", "X-Payload-Length: 24")):
        data = "".join(v.replace(old, new) + warc.RECORD_END for v in values)
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.gz").write_bytes(gzip.compress(data.encode()))
        back = warc.read_archives(spark, f"file://{tmp_path / name}")
        if name == "same":
            assert sorted((r.page_id, r.payload_bytes) for r in back.collect()) == [(1, 23), (2, 0)]
        else:
            with pytest.raises(Exception, match="its header says"):
                back.collect()


def test_quality_is_learned_and_held_out_rows_agree(spark):
    rng = random.Random(2)
    common, bad = [f"w{i}" for i in range(300)], ["awful", "vile"]
    rows, labels = [], []
    for i in range(900):
        g = rng.choice([0, 1, 2, 2, 2])
        words = [rng.choice(common) for _ in range(rng.randint(8, 60))]
        if g == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        text = " ".join(words)
        rows.append((i, text.upper() + "!!" if g == 1 else text, "", "", ""))
        if i < 600:
            labels.append((i, g))
        else:
            rows[-1] += (g,)
    truth = {r[0]: r[5] for r in rows[600:]}
    table = docs(spark, [*[r[:5] for r in rows], (None, None, "", "", "")])
    graded = spark.createDataFrame([*labels, (0, 2), (5000, 1), (1, None), (None, 0)], "doc_id long, grade int")
    got = {r.doc_id: r.keep for r in ordinal.selected(table, graded).collect()}
    assert len(got) == 901
    assert sum(got[d] == (g == 2) for d, g in truth.items()) >= 0.97 * len(truth)
    assert ordinal.selected(table, graded.limit(0)).where("keep").count() == 901
    assert ordinal.selected(table, graded.where("grade = 0")).where("keep").count() == 0
    assert ordinal.selected(table.limit(0), graded).count() == 0


def test_urls_are_cut_and_ruled(spark):
    urls = ["https://A.Example.org/en/12?x=1#y", "http://example.org/es/", "http://notexample.org/x", "http://m.site.com/fr/1", "http://site.com/de", "http://site.com/de/2", "no scheme", None, "http://", "x://h#f/://", "http://cheappills.net/a/1", "http://niceshop.net/a/1", "http://..-./%%"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, "http://spampills.net/", None)], "page_id long, url string, host string")
    text = spark.createDataFrame([(0, "cheap pills spam nice shop nice site cheap pills example"), (1, None)], "doc_id long, text string")
    got = url_filter.judged(pages, text).collect()
    assert len(got) == len(urls) + 2
    by = {r.page_id: r for r in got}
    assert [(by[i].host, by[i].path, by[i].rule) for i in range(10)] == [("a.example.org", "/en/12", "example.org/en/1"), ("example.org", "/es/", "example.org/es/"), ("notexample.org", "/x", "org/"), ("m.site.com", "/fr/1", "com/fr/"), ("site.com", "/de", None), ("site.com", "/de/2", "com/de/"), ("", "", None), ("", "", None), ("", "", None), ("h", "", None)]
    assert list(by[10].host_words) == ["cheap", "pills", "net"] and by[10].verdict == "block" and by[6].verdict == "allow"
    assert url_filter.judged(pages.limit(0), text).count() == 0


def test_viterbi_finds_the_best_cut():
    rng = random.Random(8)
    for _ in range(40):
        label = "".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))
        known = {label[i:j]: -rng.random() * 6 for i in range(len(label)) for j in range(i + 2, len(label) + 1) if rng.random() < 0.4}
        listed = [{"start": i + 1, "size": len(w), "score": s} for w, s in known.items() for i in range(len(label)) if label.startswith(w, i)]
        cost = lambda cut: sum(known.get(w, 2 * url_filter.UNKNOWN_LOG10 if len(w) == 1 else -1e9) for w in cut)
        cuts = [[label[a:b] for a, b in zip((0, *c), (*c, len(label)))] for k in range(len(label)) for c in itertools.combinations(range(1, len(label)), k)]
        assert cost(url_filter.viterbi(label, listed)) == pytest.approx(max(map(cost, cuts)))


def test_pipeline_equals_a_plain_version(spark):
    import corpus_pipeline
    from sentencepiece import SentencePieceProcessor
    from terrace.llm.common import table

    documents = table(spark, SF, "documents")
    kept = {r.doc_id for r in ordinal.selected(documents, queries.graded(spark, SF)).where("keep").collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect() if r.doc_id in kept]
    left = {d for d, _, c in brute_components(rows) if d == c}
    items = [tiling.WORD(r.text.lower()) for r in table(spark, SF, "benchmark").collect()]
    model = SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    expect = {}
    for d, t in rows:
        if d in left:
            words = tiling.WORD(t.lower())
            at = {tuple(words[i : i + 5]): i for i in range(len(words) - 4)}
            share = max(len({i + k for i in range(len(x) - 4) if tuple(x[i : i + 5]) in at for k in range(5)}) / len(x) for x in items)
            if share < tiling.THRESHOLD:
                expect[d] = model.encode(t)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expect


def test_near_duplicates_go_by_row_and_not_by_doc_id(spark):
    import corpus_pipeline

    copy, near = "exact copy of a text that stands many times in this corpus", "exact copy of a text that stands many times in this corpus here"
    other, alone = "a wholly different text about rivers and boats and bridges", "nothing like any other of these short documents at all"
    rows = [(1, copy, "a"), (2, copy, "a"), (2, other, "a"), (3, near, "a"), (3, alone, "a"), (None, copy, "a"), (None, "only rows without an id say this sentence twice", "b"), (None, "only rows without an id say this sentence twice", "a"), (4, "", "a"), (4, None, "a"), (None, " ", "a"), (5, "the very same row stands here two times over", "d"), (5, "the very same row stands here two times over", "c")]
    gone = [(2, copy, "a"), (3, near, "a"), (None, copy, "a"), rows[6], rows[11]]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string, source string")
        got = corpus_pipeline.near_duplicates(spark, table, SF)
        assert got.columns == table.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted((r for r in rows if r not in gone), key=repr)


def test_the_join_ships_few_bytes(spark):
    """Half a byte for a small count, KEY_BYTES for a prefix shingle, and one copy of a full set for all teams of a call."""
    own = np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert len(nearjoin.packed_vector(own)) == 1 + len(nearjoin.count_vector(own)) // 2
    assert (nearjoin.long_keys(nearjoin.short_keys(own)) == own & np.uint64((1 << 48) - 1)).all()
    texts = [" ".join(f"w{k}" for k in range(i, i + 60)) for i in range(4)] + ["other words that link with no text of these"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = nearjoin.read_sets(table, np.zeros(0, np.uint64))
    assert {r.n: len(r.prefix) for r in read.where("prefix is not null").collect()} == {56: 15 * nearjoin.KEY_BYTES, 5: 2 * nearjoin.KEY_BYTES}
    sid = {r.doc_id: r.sid for r in read.collect()}
    points = read.select("sid", "n", F.xxhash64("doc_id").alias("h"))
    teams = [(team, 9, bytes(sid[d]), 56) for team, docs_ in ((1, (0, 1, 2)), (2, (1, 2, 3)), (3, (0, 3))) for d in docs_]
    found = nearjoin.confirmed(table, spark.createDataFrame(teams, "team long, lead long, sid binary, n long"), points)
    assert {frozenset((bytes(a), bytes(b))) for a, b in found.collect()} <= {frozenset((bytes(sid[a]), bytes(sid[b]))) for a in range(4) for b in range(a)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(team" in plan  # (call, set) is one row


def test_only_rows_a_bitmap_hits_are_told_apart(spark):
    rows = spark.range(3000).withColumn("text", F.concat(F.lit("t"), F.col("id")))
    wanted = rows.where("id % 100 = 0").select(F.xxhash64("id").alias("h"))
    some, rest = nearjoin.parted(rows, F.xxhash64("id"), wanted)
    hit, other = {r.id for r in some.collect()}, {r.id for r in rest.collect()}
    assert {i for i in range(0, 3000, 100)} <= hit and len(hit) < 35 and hit | other == set(range(3000)) and not hit & other
    assert "Exchange hashpartitioning" not in rest._jdf.queryExecution().executedPlan().toString()


def test_a_distinct_word_goes_to_the_model_once(monkeypatch):
    """The memo and the words of a batch beside it give the whole tokenizer's ids, and no word of a batch is encoded twice."""
    from terrace.llm import common

    class Counted:
        def __init__(self, model):
            self.model, self.seen = model, []

        def tokenize(self, word):
            self.seen.append(word)
            return self.model.tokenize(word)

    monkeypatch.setattr(common.WordIds, "LIMIT", 3)
    encode = coded.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    encode.words.model = counted = Counted(encode.words.model)
    batches = [["a cat, a cat and été's 12½", "", "a cat's  end\n\n x"], ["more words here, more words", "a cat łódź"], ["more words"], ["中文 a cat <|endoftext|>"]]
    for texts in batches:
        counted.seen = []
        whole = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert [x.tolist() for x in encode(texts)] == [e.ids for e in whole]
        assert len(counted.seen) == len(set(counted.seen))
    assert counted.seen == [] and len(encode.words.memo) < 20


def test_new_words_of_a_batch_go_to_the_library_in_one_call(monkeypatch):
    from terrace.llm import common

    class Counted:
        def __init__(self, joined):
            self.joined, self.seen = joined, []

        def encode_batch_fast(self, texts, **options):
            self.seen.append(texts)
            return self.joined.encode_batch_fast(texts, **options)

    encode = coded.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    encode.words.joined = counted = Counted(encode.words.joined)
    rng = random.Random(8)
    letters = "aab sStTrReEvVmMlLdD''' \n\t\r  12².,!-½éñÇſ¡µªß×÷ÿ"
    for part in (letters, "' strevmld\n", letters + "\x00\x0b\x85\xa0ƀ日🙂"):
        texts = ["".join(rng.choice(part) for _ in range(rng.randrange(14))) for _ in range(2000)] + ["", None, " <|endoftext|>"]
        whole = encode.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        counted.seen = []
        for own in (texts, pa.array(["cut off", *texts])[1:]):
            assert [x.tolist() for x in encode(own)] == [e.ids for e in whole]
        assert len(counted.seen) == 1 and len(counted.seen[0]) == 1  # the second time all words are known
        words = counted.seen[0][0].split("\0")
        assert len(words) == len(set(words))
    assert encode([]) == []
    monkeypatch.setattr(common.WordIds, "LIMIT", 2)
    small = coded.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in (["a b c d e f g h i j k l m n o p"], ["q r a b s t u v"], ["p q r"]):
        assert [x.tolist() for x in small(texts)] == [e.ids for e in small.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(small.words.memo) == 10 == len(small.words.ends) - 1


def test_words_with_bytes_that_a_vocabulary_lacks():
    from tokenizers import Tokenizer, models

    words = coded.JoinedWords(Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "Ġ": 3}, [("a", "b")])))
    ids, begins, stops = words(pa.array(["ab", "xa", "x", " b"], pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(begins, stops)] == [[2], [0], [], [3, 1]]


def test_rows_and_hits_of_all_ids_are_found_at_once():
    """Sorts find what a reader finds in its cells id by id."""
    rng = np.random.default_rng(2)
    ids = np.tile(rng.integers(0, 40, 500), 3)[:1400].reshape(2, 700).astype(np.int32)
    rows, right = coded._foreseen(ids)
    for lane in range(2):
        cells, run, last, before = ({}, {}), 0, 0, 0
        for t, own in enumerate(ids[lane].tolist()):
            hashed = [(x + 1) * int(coded.AGAIN) % 2**32 if x >= 0 else 0 for x in (last - 1, before - 1)]
            places = hashed[0] >> int(coded.SHIFT), (hashed[0] ^ hashed[1] * int(coded.BEFORE) % 2**32) >> int(coded.SHIFT)
            (one, s1), (two, s2) = (c.get(at, (-1, 0)) for c, at in zip(cells, places))
            assert rows[lane, t] == run * 50 + s1 * 10 + s2 * 2 + (one == two)
            assert right[lane, t] == (2 if two == own else 1 if one == own else 0)
            for c, at, expected, state in ((cells[0], places[0], one, s1), (cells[1], places[1], two, s2)):
                c[at] = own, min(state + 1, 4) if expected == own else 1
            run = min(run + 1, 2) if two == own else 0
            before, last = last, own + 1


def test_a_batch_of_ids_is_decoded_at_once():
    with open(public_tokenizers.path(queries.PIECES), "rb") as f:
        own = pieces.Pieces(f.read())
    texts = ["", "a cat", "  two  spaces ", "Füße 中文 \U0001f600 ▁ mark", "\n\t\x00", "", "end"]
    ids = own.encode(texts)
    assert [t.decode() for t in own.decode(ids)] == [own.normalised(t) for t in texts]
    assert own.decode([]) == [] and own.decode(ids[:1]) == [b""]
    assert own.decode([np.array([own.model.unknown], np.uint32)]) == ["⁇ ".encode()]  # " ⁇ " without the prefix


def test_only_rows_that_the_bitmap_hits_are_joined_with_the_removed(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(30))
    table = spark.createDataFrame([(1, text), (2, text), (2, text), (1, text), (3, "another one"), (4, None)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, table, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    plan = kept._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [(i, min(line.find(c) for c in "JU" if c in line)) for i, line in enumerate(plan) if "Join " in line]
    bitmap = [(i, depth) for i, depth in joins if "__hit_row" in plan[i]]
    assert bitmap
    for i, depth in bitmap:  # no join with the marks below one with the bitmap: it would shuffle every text
        below = next((k for k in range(i + 1, len(plan)) if len(plan[k]) - len(plan[k].lstrip(" :+-")) <= depth), len(plan))
        assert not any("__doc" in line and "Join " in line for line in plan[i + 1 : below])
