"""Secret findings in source files: patterns, assignments and high-entropy strings, line by line.

No built-in pattern spans lines, so files are cut into lines and each line is scanned by itself. Lines and columns
count from 1, columns in bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import entropy, has_letter_and_digit, is_placeholder, mask

# Built-in patterns (word boundaries are spelled out, as they differ between engines), words of
# sensitive names, quoted values, and extensions of files that are searched for high entropy.
BEFORE, AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    severity: str = "medium"


PATTERNS = (
    Pattern("aws-access-key-id", f"{BEFORE}AKIA[0-9A-Z]{{16}}{AFTER}", "high"),
    Pattern("github-pat", f"{BEFORE}ghp_[A-Za-z0-9]{{36}}{AFTER}", "high"),
    Pattern("github-fine-grained-pat", f"{BEFORE}github_pat_[A-Za-z0-9_]{{82}}{AFTER}", "high"),
    Pattern("stripe-live-secret", f"{BEFORE}sk_live_[A-Za-z0-9]{{16,}}{AFTER}", "high"),
    Pattern("slack-token", f"{BEFORE}xox[baprs]-[A-Za-z0-9-]{{10,}}{AFTER}", "high"),
    Pattern("private-key-block", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", "critical"),
)
SENSITIVE = (
    f"(?i){BEFORE}(?:password|passwd|pwd|secret|api[_-]?key|token|auth[_-]?token|access[_-]?key|private[_-]?key|client[_-]?secret){AFTER}"
)
QUOTED_VALUE = r""""[^"\r\n]{4,}"|'[^'\r\n]{4,}'"""
QUOTED_TOKEN = r""""[A-Za-z0-9_\-+=:/.]{12,}"|'[A-Za-z0-9_\-+=:/.]{12,}'"""
ENTROPY_EXTENSIONS = (".env", ".ini", ".json", ".key", ".pem", ".p12", ".pfx", ".crt", ".cer", ".yaml", ".yml", ".toml", ".conf", ".properties")


@dataclass(frozen=True)
class Settings:
    """A threshold or length of 0 or less means the default."""

    entropy_threshold: float = 4.0
    min_token_length: int = 20
    patterns: tuple[Pattern, ...] = ()

    @property
    def threshold(self) -> float:
        return self.entropy_threshold if self.entropy_threshold > 0 else 4.0

    @property
    def least_length(self) -> int:
        return self.min_token_length if self.min_token_length > 0 else 20


def file_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, line, text) of each line between line feeds."""
    return files.select("path", F.posexplode(F.split(F.coalesce(content, F.lit("")), "\n", -1)).alias("_i", "text")).select(
        "path", (F.col("_i") + 1).alias("line"), "text"
    )


def matches_in(text: Column, regex: str) -> Column:
    """Each match with the bytes before it: array of (value, before)."""
    parts, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    steps = F.aggregate(
        F.zip_with(parts, found, lambda p, m: F.struct(F.octet_length(p).alias("gap"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,before:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(F.octet_length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(x["m"].alias("value"), (a["at"] + x["gap"]).alias("before"))))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(regex), steps).otherwise(F.array().cast("array<struct<value:string,before:int>>"))


def _found(lines: DataFrame, regex: str, quoted: bool) -> DataFrame:
    hits = lines.filter(F.col("text").rlike(regex)).select("path", "line", F.explode(matches_in(F.col("text"), regex)).alias("m"))
    value = F.substring("m.value", 2, F.length("m.value") - 2) if quoted else F.col("m.value")
    return hits.select(F.col("path").alias("file"), "line", (F.col("m.before") + (2 if quoted else 1)).alias("col"), value.alias("value"))


def _finding(rows: DataFrame, kind: str, severity: str, confidence: Column, rank: int) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "value", "entropy", confidence.cast("double").alias("confidence"), "file", "line", "col", F.lit(rank).alias("_r")
    )


def pattern_findings(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The matches of all patterns, found in one pass over the lines."""
    every = (*PATTERNS, *settings.patterns)
    text = F.col("text")

    def ranked(i: int, regex: str) -> Column:
        return F.transform(matches_in(text, regex), lambda m: F.struct(F.lit(i).alias("r"), m["value"].alias("value"), m["before"].alias("before")))

    some = lines.filter(reduce(lambda a, b: a | b, [text.rlike(p.regex) for p in every]))
    each = some.select("path", "line", F.explode(F.concat(*[ranked(i, p.regex) for i, p in enumerate(every)])).alias("m"))
    kinds, severities = (F.array(*map(F.lit, x)) for x in ([p.name for p in every], [p.severity.strip().lower() or "medium" for p in every]))
    found = each.filter(~is_placeholder(F.col("m.value"))).select(
        F.get(kinds, F.col("m.r")).alias("kind"), F.get(severities, F.col("m.r")).alias("severity"), F.col("m.value").alias("value"), F.lit(0.99).alias("confidence"),
        F.col("path").alias("file"), "line", (F.col("m.before") + 1).alias("col"), F.col("m.r").alias("_r"),
    )
    return found.withColumn("entropy", entropy(F.col("value"))).select("kind", "severity", "value", "entropy", "confidence", "file", "line", "col", "_r")


def context_findings(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    rows = _found(lines.filter(F.col("text").rlike(SENSITIVE)), QUOTED_VALUE, True)
    kept = rows.filter((F.octet_length("value") >= settings.least_length) & ~is_placeholder(F.col("value"))).withColumn("entropy", entropy(F.col("value")))
    confidence = F.when(F.col("entropy") >= settings.threshold, 0.85).otherwise(0.70)
    return _finding(kept.filter(F.col("entropy") >= settings.threshold * 0.8), "sensitive-assignment", "medium", confidence, 1000)


def entropy_findings(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = _found(lines.filter(extension.isin(*ENTROPY_EXTENSIONS)), QUOTED_TOKEN, True)
    kept = rows.filter((F.octet_length("value") >= settings.least_length) & ~is_placeholder(F.col("value")) & has_letter_and_digit(F.col("value")))
    return _finding(kept.withColumn("entropy", entropy(F.col("value"))).filter(F.col("entropy") >= settings.threshold), "high-entropy-string", "low", F.lit(0.6), 2000)


def detect(files: DataFrame, settings: Settings = Settings(), ranges: DataFrame | None = None, content: str = "content") -> DataFrame:
    """The findings of files (path, content): kind, severity, value, entropy, confidence, file, line, col.

    Of findings with one place and value the most confident stays; of equals patterns come first. With ranges
    (path, start, end) only lines inside one of their file's are scanned.
    """
    lines = file_lines(files, content)
    if ranges is not None:
        inside = ranges.select(F.col("path").alias("_p"), "start", "end")
        lines = lines.join(inside, (F.col("path") == F.col("_p")) & F.col("line").between(F.col("start"), F.col("end")), "left_semi")
    every = pattern_findings(lines, settings).union(context_findings(lines, settings)).union(entropy_findings(lines, settings))
    best = W.partitionBy("file", "line", "col", "value").orderBy(F.col("confidence").desc(), "_r")
    return every.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_r")


def masked(findings: DataFrame) -> DataFrame:
    """Findings in the order file, line, col, kind with masked values."""
    return findings.withColumn("value", mask(F.col("value"))).orderBy("file", "line", "col", "kind")


def changed_ranges(versions: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(path, start, end): the lines of ``after`` between what it has in common with ``before`` at its beginning and end; none if equal."""
    old, new = F.split(before, "\n", -1), F.split(after, "\n", -1)
    least = F.least(F.size("_o"), F.size("_n"))
    head = F.aggregate(F.zip_with("_o", "_n", lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                       lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])
    tail = F.aggregate(F.zip_with(F.reverse("_o"), F.reverse("_n"), lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                       lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])
    cut = versions.filter(~F.col(before).eqNullSafe(F.col(after))).withColumn("_o", old).withColumn("_n", new)
    sized = cut.withColumn("_h", F.least(head, least)).withColumn("_t", F.least(tail, least - F.col("_h")))
    start = F.least(F.col("_h") + 1, F.size("_n"))
    return sized.select("path", start.alias("start"), F.greatest(F.size("_n") - F.col("_t"), start).alias("end"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(path, start, end): ranges of a path that overlap or touch, as one."""
    order = W.partitionBy("path").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    return marked.withColumn("_g", F.sum("_new").over(order)).groupBy("path", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def skipped_paths(files: DataFrame, exclude_files: Sequence[str], exclude_dirs: Sequence[str]) -> DataFrame:
    """Files that are scanned: whose base name no file glob fits and of whose directories no directory glob does."""
    from graphloom.functions.globs import fits, to_regex

    parts = F.split("path", "/")
    out = files
    for g in exclude_files:
        out = out.filter(~F.element_at(parts, -1).rlike(to_regex(g, "flat")))
    for g in exclude_dirs:
        out = out.filter(~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), fits(to_regex(g, "flat"))))
    return out
