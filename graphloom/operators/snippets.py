"""Lines around the uses of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_symbol(line: Column, symbol: str) -> Column:
    """Whether the first occurrence of symbol stands between characters that no name has."""
    at = F.instr(line, symbol)
    before = F.substring(line, at - 1, F.lit(1))
    after = F.substring(line, at + len(symbol), F.lit(1))
    name = "[A-Za-z0-9_]"
    return (at > 0) & ((at == 1) | ~before.rlike(name)) & ~after.rlike(name)


def symbol_context(files: DataFrame, symbol: str, radius: int = 5, tags: DataFrame | None = None, content: str = "content") -> DataFrame:
    """(path, line, text, context): each line with the symbol, and it with up to radius lines on each side; with tags (path, line, tag).

    Only files that contain the symbol are cut into lines, and context is a slice of them, so nothing is shuffled.
    """
    if not symbol:
        files = files.limit(0)
    cut = files.filter(F.contains(F.col(content), F.lit(symbol))).select("path", F.split(content, "\n", -1).alias("_l"))
    each = cut.select("path", "_l", F.posexplode("_l").alias("_i", "text")).filter(contains_symbol(F.col("text"), symbol))
    first = F.greatest(F.col("_i") - radius, F.lit(0))
    context = F.slice("_l", first + 1, F.col("_i") + radius + 1 - first)
    hits = each.select("path", (F.col("_i") + 1).alias("line"), "text", context.alias("context"))
    return hits if tags is None else hits.join(tags, ["path", "line"], "left")
