"""Added lines of a git history, from the text of ``git log -p``."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.secrets import Settings, detect

MAX_DEPTH = 1000
MARK = "commit "


def read_log(repository: str, depth: int) -> str:
    """The log with patches of the last commits, MAX_DEPTH at most."""
    n = min(max(depth, 1), MAX_DEPTH)
    return subprocess.run(
        ["git", "-C", repository, "log", "-p", "-U0", "--no-color", "-n", str(n)], capture_output=True, check=True, encoding="utf-8", errors="replace"
    ).stdout


def head(repository: str) -> tuple[str, datetime | None]:
    """The 12-digit hash and time of HEAD; empty and None outside a repository."""
    try:
        out = subprocess.run(["git", "-C", repository, "log", "-1", "--format=%H %ct"], capture_output=True, check=True, encoding="utf-8").stdout.split()
    except (OSError, subprocess.CalledProcessError):
        return "", None
    return (out[0][:12], datetime.fromtimestamp(int(out[1]), UTC)) if len(out) == 2 else ("", None)


def _hunks(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in texts:
        rows = []
        for order, text in zip(frame["n"], frame["text"], strict=True):
            commit, path, start, hunk, added = "", "", 0, 0, []

            def close() -> None:
                nonlocal hunk
                if added and path:
                    rows.append((order, commit[:7], path, hunk, start, "\n".join(added)))
                hunk += bool(added)
                added.clear()

            for line in text.split("\n"):
                if line.startswith(MARK):
                    close()
                    commit, path = line[len(MARK) :].split()[0], ""
                elif line.startswith("diff --git "):
                    close()
                    path = line.split(" b/", 1)[1] if " b/" in line else ""
                elif line.startswith("@@"):
                    close()
                    at = line.split("+", 1)[1].split(" ")[0].split(",")[0] if "+" in line else "1"
                    start = int(at) if at.isdigit() else 1
                elif line.startswith("+") and not line.startswith("+++"):
                    added.append(line[1:])
            close()
        yield pd.DataFrame(rows, columns=["n", "commit", "path", "hunk", "start", "content"])


def added_hunks(spark: SparkSession, log: str) -> DataFrame:
    """(n, commit, path, hunk, start, content): the added lines of each hunk; commits are parsed side by side."""
    parts = log.split("\n" + MARK)
    commits = [(i, (MARK if i else "") + p) for i, p in enumerate(parts)]
    table = spark.createDataFrame(commits, "n long, text string").repartition(max(1, min(len(commits), spark.sparkContext.defaultParallelism)))
    return table.mapInPandas(_hunks, "n long, commit string, path string, hunk long, start long, content string")


def history_secrets(spark: SparkSession, log: str, settings: Settings = Settings()) -> DataFrame:
    """Findings in added lines, once for each place and value: file, commit, line (in the hunk), abs_line (in the file)."""
    hunks = added_hunks(spark, log).withColumn("key", F.concat_ws("\0", "n", "hunk", "path"))
    found = detect(hunks.select(F.col("key").alias("path"), "content"), settings)
    placed = found.withColumnRenamed("file", "key").join(hunks.drop("content"), "key").withColumn("abs_line", F.col("start") + F.col("line") - 1)
    once = placed.groupBy("path", "abs_line", "col", "value").agg(F.min_by(F.struct("commit", "kind", "severity", "entropy", "confidence", "line"), "n").alias("f"))
    return once.select(F.col("path").alias("file"), "abs_line", "col", "value", "f.*")


def exists(repository: str) -> bool:
    return (Path(repository) / ".git").exists()
