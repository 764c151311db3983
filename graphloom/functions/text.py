"""Small functions over text and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a placeholder.
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "notasecret", "test")


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty string."""
    n = F.length(value)
    shares = F.transform(F.array_distinct(F.split(value, "")), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    total = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n == 0, F.lit(0.0)).otherwise(total)


def mask(value: Column) -> Column:
    """Stars for up to 8 bytes; else the first and last four characters."""
    short = F.octet_length(value) <= 8
    return F.when(short, F.repeat(F.lit("*"), F.octet_length(value))).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))


def is_placeholder(value: Column) -> Column:
    return F.lower(value).rlike("|".join(PLACEHOLDERS))


def has_letter_and_digit(value: Column) -> Column:
    return value.rlike(r"\p{L}") & value.rlike(r"\p{Nd}")


def round2(value: Column) -> Column:
    """Two digits, half away from zero, by the value times 100 in floating point."""
    return F.signum(value) * F.floor(F.abs(value) * 100 + 0.5) / 100


def backoff_ms(base: int, attempts: Column, limit: int) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1), F.lit(float(limit))).cast("bigint")


def sanitized_id(name: Column) -> Column:
    """Letters, digits and underscores, not beginning with a digit."""
    plain = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(plain == "", "node").when(plain.rlike("^[0-9]"), F.concat(F.lit("n_"), plain)).otherwise(plain)


def relative_path(root: str, path: Column) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), path.substr(F.lit(len(base) + 1), F.length(path))).otherwise(path)
