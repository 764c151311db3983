"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and the five control characters from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Stands in for a null identifier inside the operators; it sorts after every real one.
NULL_ID = 9223372036854775807


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir, which all executors share, and go on from there.

    Where the session names none, a temporary folder serves a local master, whose executors are the driver; on a
    cluster that is an error. What df shuffled goes as soon as it is written, not when the driver happens to collect
    its garbage.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    with _without_shuffle_files(spark):
        return df.select("*").checkpoint()  # a plan of its own, which is made with this setting


#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def words(text: Column | str) -> Column:
    """The words of a text; null gives none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key of more than one in so many rows is dealt out.
HEAVY = 1024


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str) -> DataFrame:
    """left joined with right by keys, with the rows of a common key dealt to many tasks.

    right has a row for each key, and in ``many`` the number of rows that left has with it. A key of more than
    one in HEAVY of these rows stands for several keys, each of that share at most: left's rows choose one by a
    hash of the columns named in ``by``, and right has the row for each. There are fewer than HEAVY such keys, so
    they can be broadcast. No key may be null. right is read three times and should be a written table.
    """
    total = right.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    share = max(1, total // HEAVY)
    salts = F.ceil(F.col("many") / share).cast("int")
    heavy = right.filter(F.col("many") > share).select(*keys, salts.alias("__salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts")).cast("int"), F.lit(0))
    salted = left.join(F.broadcast(heavy), keys, "left").withColumn("__salt", salt).drop("__salts")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("many")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def bounded_sample(df: DataFrame, order: str, limit: int) -> list:
    """About ``limit`` rows of df at most, on the driver; all rows where there are no more.

    ``order`` is a column of random 64-bit hashes. Of more rows, those below the quantile of the hash that
    leaves limit are taken, so no task sends more than its share.
    """
    many = df.count()
    if many > limit:
        df = df.filter(F.col(order) < -(1 << 63) + (limit << 64) // many)
    return df.collect()
