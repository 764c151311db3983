"""Source files as a DataFrame, with the files left out that no analysis is for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.globs import fits, normalize_path, to_regex
from graphloom.sources.languages import Language, base_name, is_test, language_of

# Marks of generated files, looked for in their first bytes.
GENERATED_MARKS = (
    "DO NOT EDIT", "Code generated by", "@generated", "/* Generated by", "// Generated by", "AUTO-GENERATED", "This file is automatically generated",
)
HEADER_BYTES = 8 * 1024
#: A comment that keeps a file out of all analyses.
IGNORE_MARK = "// graphloom:ignore"


def scan_roots(paths: Sequence[str]) -> list[str]:
    """Normalised roots in order, without repeats and without those inside another."""
    clean = list(dict.fromkeys(normalize_path(p) or "." for p in paths))
    return [p for p in clean if not any(p != q and (q == "." or p.startswith(q.rstrip("/") + "/")) for q in clean)]


def is_generated(content: Column, ignore_mark: str = IGNORE_MARK) -> Column:
    """Whether the first 8 KiB have a mark of generated files, in any case, or the ignore mark."""
    header = F.decode(F.substring(content.cast("binary"), 1, HEADER_BYTES), "UTF-8")
    out = header.contains(ignore_mark)
    for mark in GENERATED_MARKS:
        out = out | F.upper(header).contains(mark.upper())
    return out


def read_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, content) of all files below the roots, by Spark's own reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(scan_roots(roots)))
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def source_files(
    files: DataFrame, languages: Mapping[str, Language], exclude_dirs: Sequence[str] = (), exclude_files: Sequence[str] = (), keep_tests: bool = False
) -> DataFrame:
    """(path, language, content as text) of files of a known language that no rule leaves out.

    Directory globs are held against each directory's own name, file globs against the file's.
    """
    parts = F.split("path", "/")
    kept = files.withColumn("language", language_of(F.col("path"), languages)).filter("language <> ''")
    for g in exclude_dirs:
        kept = kept.filter(~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), fits(to_regex(g, "flat"))))
    for g in exclude_files:
        kept = kept.filter(~base_name(F.col("path")).rlike(to_regex(g, "flat")))
    if not keep_tests:
        kept = kept.filter(~is_test(F.col("path"), languages))
    text = F.decode(F.col("content").cast("binary"), "UTF-8")
    return kept.filter(~is_generated(F.col("content"))).select("path", "language", text.alias("content"))


def verify_artifacts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, issue) of a manifest (path, sha256): missing, mismatch, or not in the manifest."""
    hashed = files.select("path", F.sha2("content", 256).alias("_h"), F.lit(True).alias("_there"))
    both = manifest.withColumn("_listed", F.lit(True)).join(hashed, "path", "full")
    issue = F.when(F.col("_there").isNull(), "missing").when(F.col("_listed").isNull(), "unlisted").when(F.lower("sha256") != F.col("_h"), "mismatch")
    return both.select("path", issue.alias("issue")).filter("issue is not null")
