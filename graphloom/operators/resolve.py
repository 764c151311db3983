"""Resolution of references: the cascade, explicit and probable bridges, and unused imports.

Each step is a semi-join or an expression that gives a boolean for each reference; the outcome is one ordered
conditional over them. Nested searches (a symbol among a module's definitions) become equi-joins over exploded
dotted prefixes and suffixes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.globs import to_regex
from graphloom.functions.names import (
    SCRIPT_LANGUAGES, canonical, import_name, is_bridge_context, is_bridge_import, is_bridge_reference, leaf, module_base, prefix, service_key,
)
from graphloom.operators.stdlib import builtins, stdlib
from graphloom.operators.symbols import lookup_keys
from graphloom.schemas import FFI, PROCESS, SERVICE
from graphloom.session import cut


@dataclass(frozen=True)
class BridgeScores:
    """Thresholds and weights of bridge scores; the defaults are those of the data model."""

    confirmed: int = 8
    probable: int = 5
    explicit: int = 10
    context: int = 4
    name_prefix: int = 1
    import_evidence: int = 3
    unique: int = 2
    ambiguous: int = -2
    local_conflict: int = -4
    stdlib_conflict: int = -3


@dataclass(frozen=True)
class Bridge:
    """A declared bridge: references of a module in one language that a module in another answers."""

    from_language: str
    from_module: str
    to_language: str = ""
    to_module: str = ""
    reason: str = ""
    references: tuple[str, ...] = ()


@dataclass(frozen=True)
class Options:
    excluded_symbols: tuple[str, ...] = ()
    excluded_imports: tuple[str, ...] = ()
    bridges: tuple[Bridge, ...] = ()
    scores: BridgeScores = field(default_factory=BridgeScores)


def parse_endpoint(text: str) -> tuple[str, str]:
    """(language, module) of ``language:module``; the language may be missing."""
    lang, colon, module = text.strip().partition(":")
    if not colon:
        lang, module = "", lang
    if not module.strip():
        raise ValueError(f"no module in {text!r}")
    return lang.strip().lower(), module.strip()


def _star(pattern: str, value: Column) -> Column:
    pattern, v = pattern.strip(), F.trim(value)
    if not pattern:
        return F.lit(False)
    return (v != "") & (F.lit(pattern == "*") | (F.lower(v) == pattern.lower()) | v.rlike(to_regex(pattern, "star")))


def matches_bridge(bridges: Sequence[Bridge]) -> Column:
    """Whether a reference (language, module, name, context) meets a declared bridge."""
    out = F.lit(False)
    name = F.trim("name")
    for b in bridges:
        source = _star(b.from_module, F.col("module"))
        if b.from_language:
            source &= F.lower(F.trim("language")) == b.from_language.lower()
        named = is_bridge_context(F.col("context"))
        for r in b.references:
            named |= _star(r, name) | (name.startswith(r[:-1]) if r.endswith(".*") else F.lit(False))
        out |= source & named
    return out


def definition_keys(definitions: DataFrame) -> DataFrame:
    """(module, key, exported): each name with its dotted prefixes and suffixes, by which a symbol finds it."""
    parts = F.split("name", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    keyed = definitions.select("module", "exported", F.explode(F.array_distinct(F.concat(heads, tails))).alias("key"))
    return keyed.groupBy("module", "key").agg(F.max("exported").alias("exported"))


def _imports_of_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, imps): the imports of each file in order, with the names by which it may use them."""
    lang = files.select("path", "language")
    one = F.struct("seq", "target", "alias", "items", module_base(F.col("language"), F.col("target")).alias("base"), import_name(F.col("language"), F.col("target"), F.col("alias")).alias("name"))
    return imports.join(lang, "path").groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("imps"))


def _after(name: Column, head: Column) -> Column:
    """What follows ``head.`` in name; null if name doesn't begin so, empty if it is head."""
    return F.when(name == head, F.lit("")).when((head != "") & name.startswith(F.concat(head, F.lit("."))), F.substring(name, F.length(head) + 2, F.length(name)))


def with_context(references: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """references with ``rid``, their file's local_symbols and imports."""
    keyed = references.withColumn("rid", F.struct("path", "seq"))
    own = files.select("path", "local_symbols")
    return keyed.join(own, "path").join(_imports_of_files(imports, files), "path", "left").withColumn("imps", F.coalesce("imps", F.array()))


def is_local(excluded: Sequence[str]) -> Column:
    name, head = F.col("name"), prefix(F.col("name"))
    first = F.substring_index("name", ".", 1)
    known = F.lit(False)
    for x in excluded:
        known |= (first == x) | (F.concat(first, F.lit(".")) == x)
    own = F.array_contains("local_symbols", name) | F.array_contains("local_symbols", head)
    return own | known | ((F.col("language") == "python") & (head == "self"))


def _qualified_ids(rows: DataFrame, definitions: DataFrame, files: DataFrame) -> DataFrame:
    """(rid) of references that their own module or an import answers."""
    keys = definition_keys(definitions)
    own = rows.join(keys.select("module", F.col("key").alias("name")), ["module", "name"], "left_semi").select("rid")
    each = rows.select("rid", "name", F.explode("imps").alias("i")).select("rid", "name", "i.*", F.col("name").alias("ref"), F.col("i.name").alias("import_name"))
    ref = F.col("ref")
    by_alias = F.when(F.col("alias") != "", _after(ref, F.col("alias")))
    symbol = F.coalesce(by_alias, _after(ref, F.col("base")))
    item = F.filter("items", lambda x: (ref == x) | ref.startswith(F.concat(x, F.lit("."))))
    chained = ref.startswith(F.concat(F.col("base"), F.lit("()."))) | ((F.col("alias") != "") & ref.startswith(F.concat(F.col("alias"), F.lit("()."))))
    tried = each.select("rid", "target", symbol.alias("symbol"), item.alias("item"), chained.alias("chained"))
    plain = tried.filter(F.col("chained") | (F.col("symbol") == "")).select("rid")
    asked = tried.select("rid", "target", F.explode(F.concat(F.when(F.col("symbol") != "", F.array("symbol")).otherwise(F.array()), "item")).alias("key"))
    known = files.select(F.col("module").alias("target")).distinct()
    outside = asked.join(known, "target", "left_anti").select("rid")
    inside = asked.join(keys.filter("exported").select(F.col("module").alias("target"), "key"), ["target", "key"], "left_semi").select("rid")
    return own.union(plain).union(outside).union(inside).distinct()


def symbol_profiles(symbols: DataFrame) -> DataFrame:
    """(by, key, m, f, profiles): what scores ask of the symbols of a lookup key, counted.

    A profile is all that a score takes from a symbol but for its module and its full name: how many symbols have
    it, and the first and last of them. The row with m and f empty counts all symbols of the key, one with m
    those of a module, one with f those of a full name, one with both those of both. A key that a third of all
    symbols have is a few rows with a few profiles each.
    """
    short = F.when((F.col("by") == "service") | F.col("key").endswith(F.col("canonical_name")), F.col("canonical_name")).otherwise("")
    m, f = F.concat(F.lit("m"), "module"), F.concat(F.lit("f"), "canonical_full")
    classes = F.array(*[F.struct(a.alias("m"), b.alias("f")) for a in (F.lit(""), m) for b in (F.lit(""), f)])
    profile = F.struct(short.alias("short"), "language", (F.col("exported") | (F.col("visibility") == "public")).alias("open"), "is_service")
    keyed = lookup_keys(symbols).select("by", "key", profile.alias("p"), F.struct("language", "module", "full_name", "name").alias("w"), F.explode(classes).alias("c"))
    counted = keyed.groupBy("by", "key", "c.m", "c.f", "p").agg(F.count("*").alias("n"), F.min("w").alias("low"), F.max("w").alias("high"))
    return counted.groupBy("by", "key", "m", "f").agg(F.collect_list(F.struct("p.*", "n", "low", "high")).alias("profiles"))


def _asked(rows: DataFrame) -> DataFrame:
    """A row for each class of symbols that a reference asks for, with what the score takes from the reference."""
    name, context = F.col("name"), F.col("context")

    def used(i: Column) -> Column:
        by_name = (i["name"] != "") & name.startswith(F.concat(i["name"], F.lit(".")))
        by_alias = (i["alias"] != "") & name.startswith(F.concat(i["alias"], F.lit(".")))
        return (i["target"] != "") & (by_name | by_alias)

    told = rows.select(
        "rid", "language", "module", "context", is_bridge_reference(F.col("language"), name, context).alias("bridge"), canonical(name).alias("own"), canonical(leaf(name)).alias("leaf"),
        F.array_distinct(F.transform(F.filter("imps", used), lambda i: i["target"])).alias("used"),
        F.when(context == SERVICE, F.array(service_key(name), service_key(leaf(name)))).otherwise(F.array().cast("array<string>")).alias("service"),
    )

    def tiers(by: str, keys: Column) -> Column:
        """The whole name's key before that of its last part."""
        return F.transform(F.array_distinct(keys), lambda k, i: F.struct(F.lit(by).alias("by"), k.alias("key"), i.alias("tier")))

    def classes(mark: str, values: Column) -> Column:
        some = F.filter(F.array_distinct(values), lambda v: v != "")
        return F.concat(F.array(F.lit("")), F.transform(some, lambda v: F.concat(F.lit(mark), v)))

    keys = F.filter(F.concat(tiers("name", F.array("own", "leaf")), tiers("service", F.col("service"))), lambda x: x["key"] != "")
    by_module, by_full = classes("m", F.concat(F.array("module"), F.col("used"))), classes("f", F.array("own", "leaf"))
    spread = told.select("*", F.explode(keys).alias("k")).select("*", F.explode(by_module).alias("m")).select("*", F.explode(by_full).alias("f"))
    return spread.select(*told.drop("service").columns, "k.*", "m", "f")


def _points(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


def _score(p: Column, m: Column, f: Column) -> Column:
    """The score of a symbol with profile p, in the module and with the full name that m and f say, if any."""
    own, last, context = F.col("own"), F.col("leaf"), F.col("context")
    module, full = F.substring(m, 2, 1 << 30), F.substring(f, 2, 1 << 30)
    return (
        _points((own != "") & (own == p["short"]), 8)
        + _points((last != "") & (last == p["short"]), 6)
        + _points((own != "") & (own == full), 6)
        + _points((last != "") & (last == full), 4)
        + _points((F.col("module") != "") & (module == F.col("module")), 5)
        + _points(F.col("language") == p["language"], 2)
        + _points(p["open"], 1)
        + _points((module != "") & F.array_contains("used", module), 4)
        + _points((context == SERVICE) & p["is_service"], 5)
        + _points(context.isin(FFI, PROCESS) & ~p["is_service"], 1)
        + _points(F.col("bridge") & (F.col("language") != p["language"]), 2)
    )


def candidate_scores(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rid, best, second, resolved, abroad) of references that have candidates among the symbols.

    Candidates are found by canonical name, else by that of the leaf; and by service key for service contexts. A
    symbol that is found in two ways stands twice: then best and second best are equal, and nothing is resolved.
    resolved says that the best score is high enough and 2 ahead; abroad counts distinct candidates of other
    languages, up to 2 for each profile. No pair of a reference and a symbol is ever made: a symbol's score
    follows from its class and profile, classes of a reference's own modules and names are counted apart, and
    what they count is taken off the wider classes that hold them.
    """
    found = _asked(rows).join(symbol_profiles(symbols), ["by", "key", "m", "f"])
    facts = ["language", "module", "context", "bridge", "own", "leaf", "used"]
    row = F.struct("by", "tier", "m", "f", "profiles")
    each = found.groupBy("rid").agg(*[F.first(c).alias(c) for c in facts], F.collect_list(row).alias("_all"))
    kept = each.withColumn("_all", F.filter("_all", lambda x: ~F.exists("_all", lambda y: (y["by"] == x["by"]) & (y["tier"] < x["tier"]))))

    def counts(x: Column) -> Column:
        """(score, count) of each profile of a class, and of the wider classes that it is to be taken off."""

        def one(p: Column) -> Column:
            none, m, f, n = F.lit(""), x["m"], x["f"], p["n"]
            both, empty = (m != "") & (f != ""), F.array().cast("array<struct<score:int,n:bigint>>")

            def entry(m: Column, f: Column, n: Column) -> Column:
                return F.struct(_score(p, m, f).alias("score"), n.alias("n"))

            wide = F.when((m != "") | (f != ""), F.array(entry(none, none, F.when(both, n).otherwise(-n)))).otherwise(empty)
            partly = F.when(both, F.array(entry(m, none, -n), entry(none, f, -n))).otherwise(empty)
            return F.concat(F.array(entry(m, f, n)), wide, partly)

        return F.flatten(F.transform(x["profiles"], one))

    scored = kept.withColumn("_s", F.flatten(F.transform("_all", counts)))
    values = F.sort_array(F.array_distinct(F.transform("_s", lambda e: e["score"])), False)

    def total(v: Column) -> Column:
        n = F.aggregate(F.filter("_s", lambda e: e["score"] == v), F.lit(0).cast("long"), lambda a, e: a + e["n"])
        return F.struct(v.alias("score"), n.alias("n"))

    ranked = scored.withColumn("_r", F.filter(F.transform(values, total), lambda t: t["n"] > 0))
    best, next_ = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    second = F.when(best["n"] > 1, best["score"]).otherwise(F.coalesce(next_["score"], F.lit(0)))
    least = F.when(F.col("context") == SERVICE, 6).when(F.col("context").isin(FFI, PROCESS), 7).otherwise(8)
    wide = F.flatten(F.transform(F.filter("_all", lambda x: (x["m"] == "") & (x["f"] == "")), lambda x: x["profiles"]))
    other = F.filter(wide, lambda p: (p["language"] != "") & (p["language"] != F.col("language")))
    abroad = F.size(F.array_distinct(F.flatten(F.transform(other, lambda p: F.array(p["low"], p["high"])))))
    return ranked.select("rid", best["score"].alias("best"), second.alias("second"), ((best["score"] >= least) & (best["score"] - second >= 2)).alias("resolved"), abroad.alias("abroad"))


def assess(references: DataFrame, files: DataFrame, imports: DataFrame, definitions: DataFrame, symbols: DataFrame, options: Options = Options()) -> DataFrame:
    """references with ``status`` (resolved, probable, unresolved), ``score``, ``confidence``, ``reasons`` and ``likely`` (worth a report)."""
    spark = references.sparkSession
    rows = cut(with_context(references, files, imports))  # the searches below join it ten times
    lib = F.broadcast(stdlib(spark))
    name, head = F.col("name"), prefix(F.col("name"))
    asked = rows.select("rid", "language", "name", F.substring_index("name", ".", 1).alias("first"), head.alias("head"))

    def named_in(table: DataFrame, column: str) -> DataFrame:
        return asked.join(table.withColumnRenamed("name", column), ["language", column], "left_semi").select("rid")

    in_lib = named_in(lib, "name").union(named_in(lib, "first")).distinct()
    clash = named_in(lib, "head").distinct()
    built_in = named_in(F.broadcast(builtins(spark)), "name").distinct()
    scores = candidate_scores(rows, symbols).select("rid", F.col("resolved").alias("guessed"), "abroad")
    marks = {"in_lib": in_lib, "clash": clash, "built_in": built_in, "qualified": _qualified_ids(rows, definitions, files)}
    every = reduce(DataFrame.union, [ids.select("rid", F.lit(mark).alias("mark")) for mark, ids in marks.items()])
    told = every.groupBy("rid").agg(*[F.max(F.col("mark") == mark).alias(mark) for mark in marks])
    marked = rows.join(told, "rid", "left").withColumns({mark: F.coalesce(mark, F.lit(False)) for mark in marks})
    marked = marked.join(scores, "rid", "left").withColumns({"guessed": F.coalesce("guessed", F.lit(False)), "abroad": F.coalesce("abroad", F.lit(0))})

    def evidence(i: Column) -> Column:
        hint = is_bridge_import(F.col("language"), i["target"], i["name"])
        by_name = (i["name"] != "") & F.trim(name).startswith(F.concat(i["name"], F.lit(".")))
        by_module = (F.trim(i["target"]) != "") & F.trim(name).contains(F.concat(F.trim(i["target"]), F.lit(".")))
        return hint & (by_name | by_module)

    w = options.scores
    explicit = matches_bridge(options.bridges)
    conflict = (head != "") & (
        F.array_contains("local_symbols", head)
        | ((F.col("module") != "") & (module_base(F.col("language"), F.col("module")) == head))
        | F.exists("imps", lambda i: i["name"] == head)
    )
    parts = [
        (explicit, w.explicit, "explicit_bridge_match"),
        (is_bridge_context(F.col("context")), w.context, "bridge_context"),
        (is_bridge_reference(F.col("language"), name, F.col("context")), w.name_prefix, "bridge_prefix_heuristic"),
        (F.exists("imps", evidence), w.import_evidence, "bridge_import_evidence"),
        (F.col("abroad") == 1, w.unique, "unique_cross_language_candidate"),
        (F.col("abroad") > 1, w.ambiguous, "ambiguous_cross_language_candidates"),
        (conflict, w.local_conflict, "local_or_module_conflict"),
        (F.col("clash"), w.stdlib_conflict, "stdlib_conflict"),
    ]
    hits = F.filter(F.array(*[F.when(t, F.struct(F.lit(n).alias("n"), F.lit(r).alias("r"))) for t, n, r in parts]), lambda x: x.isNotNull())
    scored = marked.withColumn("_hits", hits).withColumns(
        {"score": F.aggregate("_hits", F.lit(0), lambda a, x: a + x["n"]), "reasons": F.transform("_hits", lambda x: x["r"]), "_explicit": explicit, "_local": is_local(options.excluded_symbols)}
    )
    confidence = F.when(F.col("score") >= w.confirmed, "high").when(F.col("score") >= w.probable, "medium").otherwise("low")
    resolved = F.col("_local") | F.col("_explicit") | F.col("in_lib") | F.col("qualified") | F.col("built_in") | F.col("guessed")
    by_import = F.exists("imps", lambda i: name.startswith(F.concat(i["base"], F.lit("."))) | ((i["alias"] != "") & name.startswith(F.concat(i["alias"], F.lit(".")))))
    dotted = (F.size(F.split(name, r"\.")) > 1) & (F.substring_index(name, ".", 1) != "")
    status = F.when(resolved | (confidence == "high"), "resolved").when(confidence == "medium", "probable").otherwise("unresolved")
    return scored.select("path", "module", "language", "seq", "name", "context", "line", "col", "score", confidence.alias("confidence"), "reasons", status.alias("status"), (by_import | dotted).alias("likely"))


def unresolved(assessed: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """References that nothing answers and that look like errors, in a set of paths if one is given."""
    kept = assessed.filter("status = 'unresolved' and likely")
    return kept if paths is None else kept.join(paths.select("path"), "path", "left_semi")


def probable_bridges(assessed: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    kept = assessed.filter("status = 'probable'")
    return kept if paths is None else kept.join(paths.select("path"), "path", "left_semi")


def uses(ref: Column, symbol: Column) -> Column:
    """Whether a reference uses a symbol: it is the symbol, calls it, ends with it after a dot, or has it before a dot."""
    return (ref == symbol) | ref.startswith(F.concat(symbol, F.lit("("))) | ref.endswith(F.concat(F.lit("."), symbol)) | ref.contains(F.concat(symbol, F.lit(".")))


def reference_hits(references: DataFrame) -> DataFrame:
    """(path, name, hits): how often each file has a reference."""
    return references.groupBy("path", "name").agg(F.count("*").alias("hits"))


# Languages whose imports are checked.
IMPORT_LANGUAGES = ("go", "python", "javascript", "typescript", "tsx", "java", "rust")


def unused_imports(imports: DataFrame, references: DataFrame, files: DataFrame, options: Options = Options(), paths: DataFrame | None = None) -> DataFrame:
    """(path, language, target, alias, item, line, col, confidence) of imports, or imported items, without a use in their file."""
    kept = files.filter(F.col("language").isin(*IMPORT_LANGUAGES)).select("path", "language")
    if paths is not None:
        kept = kept.join(paths.select("path"), "path", "left_semi")
    named = imports.join(kept, "path").withColumn("name", import_name(F.col("language"), F.col("target"), F.col("alias")))
    quiet = (F.col("language") == "go") & (F.col("alias").isin("_", ".") | F.col("target").isin("C", "unsafe"))
    excluded = F.col("target").isin(*options.excluded_imports) | F.col("name").isin(*options.excluded_imports) if options.excluded_imports else F.lit(False)
    bare = F.col("language").isin(*SCRIPT_LANGUAGES) & (F.size("items") == 0) & (F.col("alias") == "")
    asked = named.filter((F.col("name") != "") & ~quiet & ~excluded & ~bare)
    each = asked.withColumn("item", F.explode(F.when(F.size("items") > 0, F.filter("items", lambda x: x != "")).otherwise(F.array(F.lit("")))))
    refs = references.select("path", F.col("name").alias("ref")).distinct()
    item_used = uses(F.col("ref"), F.col("item")) | uses(F.col("ref"), F.concat_ws(".", "name", "item"))
    used = F.when(F.col("item") == "", uses(F.col("ref"), F.col("name"))).otherwise(item_used)
    left = each.alias("e").join(refs.alias("r"), (F.col("e.path") == F.col("r.path")) & used, "left_anti")
    return left.select("path", "language", "target", "alias", "item", "line", "col", F.when(F.col("item") == "", "medium").otherwise("high").alias("confidence"))
