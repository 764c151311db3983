"""What the pipeline's join leaves on disk."""

import random
import time
from pathlib import Path

import corpus_pipeline
from graphloom.llm.common import CLEANUP, cut
from pyspark.sql import functions as F


def shuffled(spark):
    """Bytes of the shuffle files that there are."""
    time.sleep(1)  # they go a little later
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return {p: p.stat().st_size for d in env.blockManager().diskBlockManager().localDirs() for p in Path(str(d)).rglob("shuffle_*.data")}


def test_cut_leaves_no_shuffle_files(spark):
    start = shuffled(spark)
    rows = cut(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
    assert not shuffled(spark).keys() - start.keys()
    assert rows.count() == 1000 and spark.conf.get(CLEANUP, None) is None


def test_near_duplicates_shuffle_only_texts_that_go_or_repeat(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(600)) for _ in range(200)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    rows += [(1000 + k, texts[k] + " more", "en", "s", 0) for k in range(3)]
    rows += [rows[7], (None, texts[8], "en", "s", 0), (None, "alone", "en", "s", 5), (None, "alone", "en", "s", 5), (None, None, "en", "s", None), (2000, "", "en", "s", 0), (2001, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).checkpoint()
    start = shuffled(spark)
    corpus_pipeline.near_duplicates(spark, docs, "").write.parquet(f"{tmp_path}/out")
    written = sum(n for p, n in shuffled(spark).items() if p not in start)
    assert written < 0.5 * sum(map(len, texts))
    found = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(found, key=str) == sorted([*enumerate(texts), (None, "alone"), (None, None), (2000, ""), (2001, None)], key=str)
