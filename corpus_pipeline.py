"""The corpus pipeline: documents to packed token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs. All but the last return the columns of documents. Every stage works on all that the one before kept: a
null text counts as empty, an empty table gives an empty result, and columns beyond those of documents are
passed over. The identity of a row is its doc_id with its text; rows that repeat both are one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, read
from graphloom.llm.cotraining import classify_quality
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.ngram_join import bitmap, in_bitmap, shingle_components
from graphloom.llm.packing import pack_documents, word_tokenizer
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.secret_scan import find_secrets, redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _recounted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return docs.withColumn("n_chars", length.cast("long")).select(*COLUMNS)


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key"))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs (with __key) whose (id, key) is in kept; only kept, which is narrow, is hashed."""
    small = kept.select(F.col("id").alias("__id"), F.col("key").alias("__kept_key")).hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(small["__id"]) & (docs["__key"] == small["__kept_key"])
    return docs.join(small, same, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; the texts of the others go."""
    keyed = _with_key(docs)
    scored = classify_quality(keyed, read(spark, sf_dir, "labels"), extra=("__key",))
    kept = scored.filter("kept").select(F.col("doc_id").alias("id"), F.col("__key").alias("key")).distinct()
    return _only(keyed, kept).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines, to each run's last line; one that has no line left goes."""
    cleaned = dedup_lines(docs.select(*COLUMNS), whole_runs=True)
    return _recounted(cleaned.filter("n_deleted = 0 or n_deleted < n_lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component of the n-gram join; documents that link with nothing stay.

    Texts aren't shuffled but for those that go or repeat, and a few others: a bitmap of fixed size tells the rest.
    """
    keyed = _with_key(docs)
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = shingle_components(keyed, extra=("__key",)).groupBy("doc_id", "__key").agg(F.count("*").alias("many"), F.max(least).alias("stays"))
    rows = cut(rows.select(F.col("doc_id").alias("id"), F.col("__key").alias("node"), "many", "stays"))
    marks = spark.sparkContext.broadcast(bitmap(rows.filter("not stays or many > 1")))
    marked = in_bitmap(marks, F.col("__key"), F.col("doc_id"))
    # Equality by columns that are never null, so that rows that repeat lie together after the join already.
    key = ["__key", "__id", "__none"]
    own = [F.coalesce(F.col("id"), F.lit(0)).alias("__id"), F.col("id").isNull().alias("__none")]
    kept = rows.filter("stays").select(F.col("node").alias("__key"), *own).hint("shuffle_hash")
    looked_at = keyed.filter(marked).withColumn("id", F.col("doc_id").cast("long")).select("*", *own)
    return keyed.filter(~marked).select(*COLUMNS).union(looked_at.join(kept, key, "left_semi").dropDuplicates(key).select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret found."""
    return _recounted(redact(find_secrets(docs.select(*COLUMNS))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack_documents(docs.select("doc_id", "text"), word_tokenizer(spark, tokenizer_path("word_bpe_49k.json")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("packing", packing),
]

#: SQL can't express the fitted classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the table documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
