from datetime import datetime, timedelta

import pytest
from graphloom.functions import globs, names, text
from graphloom.operators import history, metrics, model, rules, secrets
from graphloom.schemas import LAYER_RULES, LAYERS, PACKAGE_RULES, SNAPSHOTS
from pyspark.sql import functions as F
from tables import definitions, files, graph, imports, table


def test_layers(spark):
    _, modules, edges = graph(spark, ("internal/api", "internal/core"), ("internal/core", "internal/api"))
    layers = table(spark, LAYERS, {"name": "api", "pattern": "internal/api"}, {"name": "core", "pattern": "internal/core"})
    allow = table(spark, LAYER_RULES, {"name": "api-to-core", "from_layer": "api", "allow": ["core"]}, {"name": "core-to-core-only", "from_layer": "core", "allow": ["core"]})
    bad = rules.layer_violations(edges, modules, rules.layer_assignment(modules, layers), allow).collect()
    assert [(r["rule"], r["from_layer"], r["to_layer"]) for r in bad] == [("core-to-core-only", "core", "api")]


def test_package_rules(spark):
    f = files(spark, *[{"path": p, "module": p.rsplit("/", 1)[0]} for p in ("internal/api/a.go", "internal/api/b.go", "internal/infra/c.go", "internal/core/d.go")])
    edges = model.edges(imports(spark, {"path": "internal/api/a.go", "module": "internal/api", "target": "internal/infra", "line": 3, "col": 1}))
    rule = table(spark, PACKAGE_RULES, {"name": "api", "modules": ["internal/api"], "max_files": 1, "allow": ["internal/core"]})
    modules = model.modules(f)
    found = {r["type"]: r for r in rules.package_violations(f, edges, modules, rule).collect()}
    assert (found["file_count"]["actual"], found["file_count"]["limit"]) == (2, 1)
    assert (found["import"]["target"], found["import"]["line"]) == ("internal/infra", 3)
    assert rules.rule_summary(modules, rule, rules.package_violations(f, edges, modules, rule)).first()["evaluated_modules"] == 1


def test_globs():
    import re

    def fits(p, v, d="path"):
        return bool(re.search(globs.to_regex(p, d), v))

    assert fits("a/*", "a/b") and not fits("a/*", "a/b/c") and fits("a/**", "a/b/c") and fits("{a,b}/c", "b/c") and fits("*.go", "x/y.go", "flat")
    assert not fits("a*", "a/b", "segment") and fits("[!a]b", "cb") and fits("grpc.*", "grpc.x.y", "star") and not fits("a.b", "axb")
    assert globs.normalize_path("./a//b/../c/") == "a/c"


@pytest.mark.parametrize(("fan_in", "fan_out", "score", "name", "want"), [(4, 2, 0, "core", 10), (0, 0, 20, "internal/algo", 10), (2, 1, 0, "internal/api/v1", 15), (10, 5, 40, "gateway", 55)])
def test_importance(spark, fan_in, fan_out, score, name, want):
    row = spark.createDataFrame([(fan_in, fan_out, score, name)], "i int, o int, c int, n string")
    assert row.select(metrics.importance(F.col("i"), F.col("o"), F.col("c"), F.col("n"))).first()[0] == want


def test_hotspots(spark):
    d = definitions(spark, {"path": "a", "module": "m", "name": "Small", "complexity_score": 2}, {"path": "a", "module": "m", "name": "Large", "complexity_score": 9, "loc": 30}, {"path": "a", "module": "m", "name": "Ghost", "complexity_score": 20}, {"path": "a", "module": "m", "name": "Real", "complexity_score": 8, "loc": 20})
    assert [r["definition"] for r in metrics.top_complexity(d, 5).collect()] == ["Large", "Real"]
    assert metrics.top_complexity(d, 0).count() == 0


def _snapshot(hours, modules, cycles, unresolved, fan_in):
    return {"project_key": "p", "ts": datetime(2026, 1, 1) + timedelta(hours=hours), "commit_hash": "c", "commit_ts": None, "module_count": modules, "cycle_count": cycles, "unresolved_count": unresolved, "avg_fan_in": fan_in}


def test_trend(spark):
    names_ = [c.split()[0] for c in SNAPSHOTS.split(", ")]
    rows = [_snapshot(0, 4, 2, 4, 1.0), _snapshot(2, 6, 1, 2, 2.0), _snapshot(25, 7, 3, 1, 2.5)]
    blank = {c.split()[0]: (0.0 if "double" in c else 0 if " int" in c else "") for c in SNAPSHOTS.split(", ")}
    snapshots = spark.createDataFrame([tuple((blank | r)[n] for n in names_) for r in rows], SNAPSHOTS)
    points = history.trend_report(snapshots).orderBy("ts").collect()
    assert points[1]["delta_modules"] == 2 and points[1]["module_growth_pct"] == 50 and points[1]["delta_fan_in"] == 1 and points[2]["delta_cycles"] == 2
    assert points[0]["delta_modules"] == 0 and [p["avg_cycles"] for p in points] == [2.0, 1.5, 2.0]
    again = history.upsert_snapshots(snapshots, snapshots.filter("module_count = 4").withColumn("file_count", F.lit(9)))
    assert again.count() == 3 and again.filter("file_count = 9").count() == 1
    with pytest.raises(ValueError):
        history.trend_report(snapshots.limit(0))


def _detect(spark, path, content, **more):
    return secrets.detect(spark.createDataFrame([(path, content)], "path string, content string"), secrets.Settings(**more)).collect()


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    assert [r["kind"] for r in _detect(spark, "main.go", f"x\nkey := {key}\n")] == ["aws-access-key-id"]
    row = _detect(spark, "m.go", 'password = "P4s$w0rdVeryLongToken99"', entropy_threshold=3.5, min_token_length=16)[0]
    assert row["kind"] == "sensitive-assignment" and (row["line"], row["col"]) == (1, 13)
    assert _detect(spark, "m.go", 'api_key = "example_test_token_123456"') == []
    value = 'value = "A1b2C3d4E5f6G7h8I9j0"'
    assert _detect(spark, "main.go", value, min_token_length=12) == []
    assert [r["kind"] for r in _detect(spark, "a/.env", value, min_token_length=12)] == ["high-entropy-string"]
    files_ = spark.createDataFrame([("m.go", f"é\né {key}")], "path string, content string")
    ranges = spark.createDataFrame([("m.go", 1, 1)], "path string, start int, end int")
    assert secrets.detect(files_, ranges=ranges).count() == 0
    assert secrets.detect(files_, ranges=ranges.selectExpr("path", "2 start", "2 end")).first()["col"] == 4


def test_masks_and_ranges(spark):
    frame = spark.createDataFrame([("ABCDEFGH",), ("ABCDEFGHIJKLMNOP",)], "v string")
    assert [r[0] for r in frame.select(text.mask(F.col("v"))).collect()] == ["********", "ABCD...MNOP"]
    changed = secrets.changed_ranges(spark.createDataFrame([("p", "a\nb\nc", "a\nbx\nc"), ("q", "a", "a")], "path string, before string, after string"))
    assert [tuple(r) for r in changed.collect()] == [("p", 2, 2)]
    merged = secrets.merged_ranges(spark.createDataFrame([("p", 1, 3), ("p", 4, 5), ("p", 8, 9)], "path string, start int, end int"))
    assert {tuple(r) for r in merged.collect()} == {("p", 1, 5), ("p", 8, 9)}
    assert spark.range(1).select(text.entropy(F.lit("aabbc"))).first()[0] == pytest.approx(1.52193, abs=1e-5)


def test_names(spark):
    frame = spark.createDataFrame([("GreeterServiceClient",), ("Api",), ("",)], "n string")
    assert [r[0] for r in frame.select(names.service_key(F.col("n"))).collect()] == ["greeter", "api", ""]
    one = spark.createDataFrame([("go", "a/b-c", "x.y(z).w[0]", "*p.q")], "l string, m string, r string, h string")
    row = one.select(names.module_base(F.col("l"), F.col("m")), names.leaf(F.col("r")), names.prefix(F.col("h")), names.call_context(F.lit("python"), F.lit("ctypes.CDLL"))).first()
    assert tuple(row) == ("b-c", "0", "p", "ffi_bridge")
