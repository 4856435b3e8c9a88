"""One query per operator, and the pipeline, over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import byte_merges, coded, hard_negatives, katz, nearjoin, ordinal, pieces, repair, shards, tiling, topk, url_filter, warc
from terrace.llm.common import table

PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"), table(spark, folder, "documents"))


def op2_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = shards.shard_rows(table(spark, folder, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pieces.encoded(docs, public_tokenizers.path(PIECES), ["doc_id"], with_ids=False).drop("ids")


def op4_bit_sliced_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op5_katz_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    return katz.scored(docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")))


def graded(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))


def op6_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ordinal.selected(docs, graded(spark, folder)).select("doc_id", "expected_grade", "tail", "keep")


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return nearjoin.components_of(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_coded_ids(spark: SparkSession, folder: str) -> DataFrame:
    return coded.coded_documents(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.covered(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_merges.digests(table(spark, folder, "documents"), public_tokenizers.path(BYTE_RANKS))


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    found = repair.repaired(repair.damaged(rows)).withColumnRenamed("conv_id", "found")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.taking_part(table(spark, folder, "embeddings"), moved)
    return hard_negatives.hard_negatives(rows, rows.where("vec_id % 50 = 0"), positives=5, negatives=3, low=50, high=95)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_feistel_shards, op3_sentencepiece, op4_bit_sliced_topk, op5_katz_lm, op6_ordinal_quality, op7_ngram_jaccard, op8_coded_ids, op9_string_tiling, op10_warc_revisits, op11_byte_bpe, op12_turn_repair, op13_hard_negatives, pipeline)}

SQL = {
    "op4_bit_sliced_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
               ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1, 2""",
    "op10_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(encode(h)) AS payload_digest FROM p),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM o""",
    "op12_turn_repair": r"""
        WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                 FROM (SELECT unnest(range(256)) AS i))),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
        o AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS w FROM k, crc),
        d AS (SELECT conv_id, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role, CASE w WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(CASE WHEN w = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE w <> 0),
        m AS (SELECT *, md5(octet_length(encode(role)) || ':' || role || text) AS same, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, same, copy) AS i, row_number() OVER (PARTITION BY conv_id, same ORDER BY turn NULLS FIRST, copy) AS seen FROM m),
        f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, left(role, 1) AS initial,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                     count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM f GROUP BY conv_id),
        v AS (SELECT conv_id, rows AS i, {'c': 0, 's': '', 't': ''} AS f0, {'c': 4, 's': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS f1,
                     {'c': 2, 's': 'I', 't': chr(10) || 'assistant:'} AS f2, {'c': 0, 's': '', 't': ''} AS f3 FROM g
              UNION ALL
              SELECT conv_id, i - 1,
                     least(m0, {'c': m2.c + 2, 's': 'I' || m2.s, 't': chr(10) || 'user:' || m2.t}, {'c': m3.c + 4, 's': 'II' || m3.s, 't': chr(10) || 'user:' || chr(10) || 'assistant:' || m3.t}),
                     least(m1, {'c': m2.c + 2, 's': 'I' || m2.s, 't': chr(10) || 'user:' || m2.t}, {'c': m3.c + 4, 's': 'II' || m3.s, 't': chr(10) || 'user:' || chr(10) || 'assistant:' || m3.t}),
                     least(m2, {'c': m3.c + 2, 's': 'I' || m3.s, 't': chr(10) || 'assistant:' || m3.t}),
                     least(m3, {'c': m2.c + 2, 's': 'I' || m2.s, 't': chr(10) || 'user:' || m2.t})
              FROM (SELECT v.conv_id, v.i,
                           least({'c': f0.c + 3, 's': 'D' || f0.s, 't': f0.t}, CASE WHEN live AND initial = 's' THEN {'c': f1.c + cut, 's': 'K' || f1.s, 't': own || f1.t} END,
                                 CASE WHEN live AND initial = 'u' THEN {'c': f2.c + cut, 's': 'K' || f2.s, 't': own || f2.t} END, CASE WHEN live THEN {'c': f2.c + cut + 2, 's': 'R' || f2.s, 't': chr(10) || 'user:' || text || f2.t} END) AS m0,
                           least({'c': f1.c + 3, 's': 'D' || f1.s, 't': f1.t}, CASE WHEN live AND initial = 'u' THEN {'c': f2.c + cut, 's': 'K' || f2.s, 't': own || f2.t} END,
                                 CASE WHEN live THEN {'c': f2.c + cut + 2, 's': 'R' || f2.s, 't': chr(10) || 'user:' || text || f2.t} END) AS m1,
                           least({'c': f2.c + 3, 's': 'D' || f2.s, 't': f2.t}, CASE WHEN live AND initial = 'a' THEN {'c': f3.c + cut, 's': 'K' || f3.s, 't': own || f3.t} END,
                                 CASE WHEN live THEN {'c': f3.c + cut + 2, 's': 'R' || f3.s, 't': chr(10) || 'assistant:' || text || f3.t} END) AS m2,
                           least({'c': f3.c + 3, 's': 'D' || f3.s, 't': f3.t}, CASE WHEN live AND initial = 'u' THEN {'c': f2.c + cut, 's': 'K' || f2.s, 't': own || f2.t} END,
                                 CASE WHEN live THEN {'c': f2.c + cut + 2, 's': 'R' || f2.s, 't': chr(10) || 'user:' || text || f2.t} END) AS m3
                    FROM v JOIN (SELECT conv_id, i, text, initial, fault NOT IN (1, 2) AS live, (fault = 3)::INTEGER AS cut, chr(10) || role || ':' || text AS own FROM f) r
                      ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i)),
        e AS (SELECT conv_id, f0 FROM v WHERE i = 0)
        SELECT a.conv_id, coalesce(g.gaps, 0) AS gaps, coalesce(g.blank, 0) AS blank, coalesce(g.duplicate, 0) AS duplicate, coalesce(g.truncated, 0) AS truncated, coalesce(g.illegal, 0) AS illegal,
               coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.s, '') AS audit, sha256(coalesce(substr(f0.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.row <> c.row AND len(a.v) = len(c.v)),
        p AS (SELECT anchor, anchor_id, row AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5)
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id, row))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
}
