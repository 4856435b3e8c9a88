"""Cleaning a corpus: quality, near duplicates, benchmark leaks, then token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import nearjoin, ordinal, pieces, tiling
from terrace.llm.common import stored, table
from terrace.llm.queries import PIECES, graded


def aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """`docs` with all columns but doc_id and text under names no operator uses, and the selection that brings the names back: a user's column may be
    called as one that an operator adds."""
    kept = {c: c if c in ("doc_id", "text") else f"__user_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(name) for c, name in kept.items()]), [F.col(name).alias(c) for c, name in kept.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likely enough; the others (toxic, poor) go."""
    safe, back = aside(docs)
    return ordinal.selected(safe, graded(spark, sf_dir)).where("keep").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents stays: the least by doc_id (null last) and then by the MD5 of its text; of rows equal in both, the least by all columns. Rows that share a
    doc_id are separate documents, and a document without words stays."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__text", F.md5(F.col("text").cast("string").cast("binary")))
    found = nearjoin.components_of(keyed, "__text")
    linked = stored(found.where("component_rows > 1").select(F.col("doc_id").alias("__doc"), F.col("__text").alias("__key"), "least"), "pipeline-linked")
    # False: goes; True: stays once. Rows equal in both have the same part in their group, so each pair comes once.
    marked = linked.groupBy("__doc", "__key").agg(F.first("least").alias("__stays"), F.count(F.lit(1)).alias("n")).where("not __stays or n > 1")
    marks = stored(marked.select("__doc", "__key", "__stays"), "pipeline-marks")
    # Only rows that may be concerned are shuffled. An outer join, since Spark moves semi and anti joins below the bitmap's and so would shuffle all texts.
    some, rest = nearjoin.parted(keyed, F.xxhash64(F.col("doc_id").cast("long"), "__text"), marks.select(F.xxhash64("__doc", "__key").alias("h")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__key"))
    told = some.join(marks, same, "left")
    left = rest.unionByName(told.where("__stays is null").select(*rest.columns)).select(*names)
    if marks.where("__stays").isEmpty():
        return left
    once = told.where("__stays").groupBy("__doc", "__key").agg(F.min(F.struct(*names)).alias("row"))
    return left.unionByName(once.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    safe, back = aside(docs)
    return tiling.marked(safe, table(spark, sf_dir, "benchmark"), safe.columns).where("not contaminated").select(*back)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (where there are such columns) and the SentencePiece ids of each text, with the parity and round-trip checks."""
    return pieces.encoded(docs, public_tokenizers.path(PIECES), [c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [("ordinal quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("SentencePiece encoding", token_ids)]
ORACLE_SQL = None  # a fitted classifier and a tokenizer: compared with a plain Python version in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
