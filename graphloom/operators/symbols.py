"""The universal symbol table, and the symbol rows that are stored for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.names import ancestry, canonical, is_service_definition, service_key, usage_confidence, usage_tag
from graphloom.operators.model import best_definitions


def _service(d: str = "") -> Column:
    c = [F.col(d + x) for x in ("name", "full_name", "signature", "type_hint", "decorators", "kind")]
    return is_service_definition(*c)


def symbol_table(definitions: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each best definition: name, full_name, module, language, path, kind, exported, visibility, is_service, and lookup keys."""
    best = best_definitions(definitions).join(files.select("path", "language"), "path")
    return best.select(
        "name", "full_name", "module", "language", "path", "kind", "exported", "visibility", "line",
        _service().alias("is_service"), canonical(F.col("name")).alias("canonical_name"), canonical(F.col("full_name")).alias("canonical_full"),
        service_key(F.col("name")).alias("service_key"),
    )


def lookup_keys(symbols: DataFrame) -> DataFrame:
    """symbols with ``key`` and ``by``: each is found by its canonical name, by its full one if that differs, and if it is a service by its key."""
    names = F.array(
        F.when(F.col("canonical_name") != "", F.struct(F.col("canonical_name").alias("key"), F.lit("name").alias("by"))),
        F.when((F.col("canonical_full") != "") & (F.col("canonical_full") != F.col("canonical_name")), F.struct(F.col("canonical_full").alias("key"), F.lit("name").alias("by"))),
        F.when(F.col("is_service") & (F.col("service_key") != ""), F.struct(F.col("service_key").alias("key"), F.lit("service").alias("by"))),
    )
    return symbols.withColumn("_k", F.explode(F.filter(names, lambda x: x.isNotNull()))).select("*", "_k.key", "_k.by").drop("_k")


def lookup(symbols: DataFrame, name: str) -> DataFrame:
    """The symbols with a canonical name, or full name, like name's."""
    return lookup_keys(symbols).filter((F.col("by") == "name") & (F.col("key") == canonical(F.lit(name)))).drop("key", "by")


def lookup_service(symbols: DataFrame, name: str) -> DataFrame:
    return lookup_keys(symbols).filter((F.col("by") == "service") & (F.col("key") == service_key(F.lit(name)))).drop("key", "by")


def symbol_rows(definitions: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """What is stored for each file: one row for each name and line, of greatest confidence; of equals the first, definitions first."""
    nested = F.col("scope").contains("->")
    lang = files.select("path", "language")
    text = F.lit("")
    defs = definitions.join(lang, "path").select(
        "path", "module", "language", "name", "full_name", "line", "kind", "exported", F.when(nested, "global").otherwise(F.col("scope")).alias("scope"),
        F.lit("SYM_DEF").alias("usage_tag"), F.when(nested, F.col("scope")).otherwise("").alias("ancestry"), F.lit(1.0).alias("confidence"),
        _service().alias("is_service"), service_key(F.col("name")).alias("service_key"), F.lit(0).alias("_o"), "seq",
    )
    refs = references.select(
        "path", "module", "language", "name", F.col("name").alias("full_name"), "line", F.lit(0).alias("kind"), F.lit(False).alias("exported"), text.alias("scope"),
        usage_tag(F.col("context")).alias("usage_tag"), ancestry(F.col("context")).alias("ancestry"), usage_confidence(F.col("context")).alias("confidence"),
        F.lit(False).alias("is_service"), text.alias("service_key"), F.lit(1).alias("_o"), "seq",
    )
    first = W.partitionBy("path", "name", "line").orderBy(F.col("confidence").desc(), "_o", "seq")
    rows = defs.unionByName(refs).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_o", "seq")
    return rows.withColumn("canonical_name", canonical(F.col("name")))
