"""A Spark session for this engine, and ways to cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "graphloom", **conf: str) -> SparkSession:
    """The running session or a new one: UTC, adaptive plans, Arrow; further settings by keyword with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder of spark.checkpoint.dir, so that loops have short plans and survive lost executors.

    Where the session names none, a temporary folder serves a local master; on a cluster that is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return df.checkpoint()
