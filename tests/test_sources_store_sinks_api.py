import json
from datetime import datetime, timedelta

import pytest
from graphloom import api
from graphloom.operators import diagrams, graph, metrics, snippets, store, symbols
from graphloom.schemas import OVERLAYS, SPOOL
from graphloom.sinks import diagrams as draw
from graphloom.sinks import reports, tsv
from graphloom.sources import config, extract, gitlog, languages, naming, scan
from graphloom.streaming import watch
from tables import definitions, files, graph as make, references, table

GO = 'package main\n\nimport (\n\t"fmt"\n\talias "example.com/p/pkg1"\n)\n\nfunc main(a int, b string) {\n\tif a > 1 {\n\t\talias.Run(a)\n\t}\n\tfmt.Println(b)\n}\n\ntype Server interface{}\n'
PYTHON = "import os.path as p\nfrom ..a import b, c\nX = 1\n\nclass K:\n    @route('/')\n    def m(self, q):\n        for i in q:\n            if i:\n                p.join(i)\n"


def named(rows, row):
    return [r["name"] for r in rows if r["row"] == row]


def test_extractors():
    rows = list(extract.go(GO))
    assert named(rows, "import") == ["fmt", "example.com/p/pkg1"] and named(rows, "definition") == ["main", "Server"] and named(rows, "reference") == ["alias.Run", "fmt.Println"]
    main = next(r for r in rows if r["name"] == "main" and r["row"] == "definition")
    assert (main["params"], main["branches"], main["nesting"], main["loc"]) == (2, 1, 2, 6)
    rows = list(extract.python(PYTHON))
    assert [(r["name"], r["alias"], r["items"]) for r in rows if r["row"] == "import"] == [("os.path", "p", []), ("..a", "", ["b", "c"])]
    method = next(r for r in rows if r["name"] == "m")
    assert (method["kind"], method["branches"], method["params"], method["decorators"]) == (2, 2, 2, ["route('/')"])
    assert list(extract.python("def broken(")) == []
    js = list(extract.script("import x, {a, b as c} from './m.js'\nexport function f(a, b) { g(a) }\nclass Q {}\ninterface I {}\n"))
    assert named(js, "import") == ["./m.js"] and named(js, "definition") == ["f", "Q", "I"] and "g" in named(js, "reference")
    assert named(extract.rust("use a::{b, c as d};\npub fn f(x: i32) { g(x) }\npub struct S;\n"), "import") == ["a::b", "a::c"]
    assert named(extract.java("package p;\nimport java.util.List;\npublic class A {\n  public int f(int x) { return g(x); }\n}\n"), "definition") == ["A", "f"]
    page = list(extract.html('<script src="a.js"></script><link href="b.css"><div id="x" class="c d">'))
    assert named(page, "import") == ["a.js", "b.css"] and named(page, "definition") == ["x"] and named(page, "reference") == ["c", "d"]
    assert named(extract.css("@import url('a.css');\n.b, #c p { }"), "definition") == [".b", "#c", "p"]
    assert named(extract.gomod("module m\nrequire a v1\nrequire (\n b v1\n)"), "import") == ["a"] and named(extract.gosum("a v1 h\na v1/go.mod h\nb v2 h"), "import") == ["a", "b"]
    own = extract.dynamic(languages.Dynamic("namespace", ("uses",), ("struct_item",)))
    assert [(r["row"], r["name"]) for r in own("namespace n;\nuses m;\nstruct_item S {")] == [("package", "n"), ("import", "m"), ("definition", "S")]
    assert extract.usage_tag("function_declaration") == "SYM_DEF" and extract.usage_tag("call_expression") == "REF_CALL" and extract.usage_tag("x") == ""


def test_registry_and_scan(spark, tmp_path):
    with pytest.raises(ValueError):
        languages.registry({"cobol": {}})
    with pytest.raises(ValueError):
        languages.registry({"css": {"enabled": True, "extensions": [".go"]}})
    (tmp_path / "pkg1").mkdir()
    (tmp_path / "go.mod").write_text("module test-project\n")
    (tmp_path / "main.go").write_text('package main\nimport "test-project/pkg1"\nfunc main() { pkg1.Run() }\n')
    (tmp_path / "pkg1/pkg1.go").write_text("package pkg1\nfunc Run() {}\n")
    (tmp_path / "pkg1/pkg1_test.go").write_text("package pkg1\n")
    (tmp_path / "pkg1/gen.go").write_text("// Code generated by x. DO NOT EDIT.\npackage pkg1\n")
    project = api.Project.scanned(spark, [str(tmp_path)])
    assert sorted(r["name"] for r in project.modules.collect()) == ["test-project", "test-project/pkg1"]
    assert project.cycles().count() == 0 and project.unused_imports().count() == 0 and project.unresolved().count() == 0
    assert api.call(project, "query.trace", {"from_module": "test-project", "to_module": "test-project/pkg1"})["result"]["depth"] == 1
    assert api.call(project, "query.modules", {"filter": "pkg1"})["result"]["modules"][0]["export_count"] == 1
    assert "## Cycles (0)" in api.call(project, "report.generate_markdown")["result"]["markdown"]
    assert "test_project_pkg1" in api.call(project, "system.sync_outputs", {"formats": ["mermaid"]})["result"]["texts"]["mermaid"]
    for name, params, code in (("query.trace", {"from_module": "a", "to_module": "b"}, "not_found"), ("nothing", {}, "invalid_argument"), ("query.modules", {"limit": -1}, "invalid_argument"), ("query.module_details", {}, "invalid_argument")):
        with pytest.raises(api.OperationError) as e:
            api.call(project, name, params)
        assert e.value.code == code
    assert scan.scan_roots(["a/b", "./a", "c", "c/"]) == ["a", "c"]
    listed = scan.read_files(spark, [str(tmp_path)])
    manifest = spark.createDataFrame([(f"{tmp_path}/main.go", "00"), ("gone", "00")], "path string, sha256 string")
    assert {r["issue"] for r in scan.verify_artifacts(listed, manifest).collect()} == {"mismatch", "missing", "unlisted"}


def test_python_names(spark):
    rows = [("src/app/__init__.py",), ("src/app/core/__init__.py",), ("src/app/core/x.py",), ("tool.py",)]
    found = {r["path"]: r["module"] for r in naming.python_modules(spark.createDataFrame(rows, "path string")).collect()}
    assert found == {"src/app/__init__.py": "app", "src/app/core/__init__.py": "app.core", "src/app/core/x.py": "app.core.x", "tool.py": "tool"}


def test_git_history(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    log = f"commit 1234567890\nAuthor: x\n\ndiff --git a/m.go b/m.go\n--- a/m.go\n+++ b/m.go\n@@ -0,0 +5,2 @@\n+x\n+{key}\ncommit abcdef01\ndiff --git a/m.go b/m.go\n@@ -1 +6 @@\n+{key}\n"
    rows = gitlog.history_secrets(spark, log).collect()
    assert [(r["file"], r["abs_line"], r["line"], r["commit"], r["kind"]) for r in rows] == [("m.go", 6, 2, "1234567", "aws-access-key-id")]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('roots = ["a"]\ntop_complexity = 3\n')
    found = config.load(str(tmp_path / "c.toml"), {"GRAPHLOOM_TOP_COMPLEXITY": "7", "GRAPHLOOM_EXCLUDE_DIRS": "x, y"})
    assert (found.roots, found.top_complexity, found.exclude_dirs) == (["a"], 7, ["x", "y"])
    (tmp_path / "b.toml").write_text('[[bridges]]\nfrom = "go:a"\nto = "python:pkg.worker"\n')
    assert config.load_bridges(str(tmp_path / "b.toml"))[0].references == ("worker.*",)
    bad = config.Config(layers=[{"name": "a", "paths": ["x"]}, {"name": "b", "paths": ["x/y"]}])
    with pytest.raises(ValueError):
        config.check(bad)
    assert config.parse_window("") == timedelta(hours=24) and config.parse_window("1h30m") == timedelta(minutes=90) and config.parse_trace("a:b") == ("a", "b")
    assert config.parse_since("2026-01-02").year == 2026 and config.parse_since(" ") is None
    with pytest.raises(ValueError):
        config.parse_window("-1h")


def test_store(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int")
    changes = spark.createDataFrame([(1, "upsert_file", "b"), (2, "delete_file", "a"), (3, "prune_to_paths", "b"), (4, "upsert_file", "d")], "seq int, operation string, path string")
    rows = spark.createDataFrame([("b", 2), ("d", 2), ("x", 2)], "path string, v int")
    assert {tuple(r) for r in store.apply_changes(stored, changes, rows).collect()} == {("b", 2), ("d", 2)}
    blobs = store.file_blobs(stored)
    assert store.load_blobs(blobs, "path string, v int").count() == 3
    t = datetime(2026, 1, 1)
    overlays = table(spark, OVERLAYS.replace(", created_at timestamp", ""), *[{"id": i, "project_key": "p", "symbol": "s", "file_path": f, "overlay_type": "EXCLUSION", "source_hash": "h1"} for i, f in enumerate(("", "f"))])
    from pyspark.sql import functions as F

    overlays = store.add_overlay(overlays.limit(0).withColumn("created_at", F.lit(t)), overlays.withColumn("created_at", F.timestamp_seconds(F.col("id"))))
    asked = spark.createDataFrame([("p", "s", "f"), ("p", "s", "g"), ("q", "s", "f")], "project_key string, symbol string, file_path string")
    assert {(r["file_path"], r["id"]) for r in store.check_overlays(overlays, asked).collect()} == {("f", 1), ("g", 0)}
    stale = store.mark_stale(overlays, spark.createDataFrame([("f", "h2")], "path string, hash string"))
    assert [r["status"] for r in stale.orderBy("id").collect()] == ["ACTIVE", "RE-VERIFICATION"]
    assert [r["id"] for r in store.list_overlays(overlays, "p", limit=1).collect()] == [1]
    with pytest.raises(ValueError):
        store.add_overlay(overlays, overlays.withColumn("overlay_type", F.lit("OTHER")))
    spool = table(spark, SPOOL.replace(", next_attempt_at timestamp, created_at timestamp", ""), {"id": 1}, {"id": 2}).withColumns({"next_attempt_at": F.lit(t), "created_at": F.lit(t)})
    later = store.spool_nack(spool, spool.filter("id = 2"), t, "locked")
    assert [r["id"] for r in store.spool_due(later, t, 9).collect()] == [1] and later.filter("id = 2").first()["attempts"] == 1
    assert store.spool_ack(later, spool.filter("id = 1")).count() == 1


def test_symbols_snippets_and_diagram_tables(spark):
    f = files(spark, {"path": "a.py", "module": "m", "language": "python"})
    d = definitions(spark, {"path": "a.py", "module": "m", "name": "GreetService", "full_name": "m.GreetService", "kind": 1, "line": 1, "exported": True})
    found = symbols.symbol_table(d, f)
    assert symbols.lookup(found, "greet_service").count() == 1 and symbols.lookup_service(found, "GreetClient").count() == 1
    r = references(spark, {"path": "a.py", "module": "m", "language": "python", "name": "GreetService", "line": 1, "context": "REF_CALL|a->b"})
    rows = symbols.symbol_rows(d, r, f).collect()
    assert [(x["usage_tag"], x["confidence"]) for x in rows] == [("SYM_DEF", 1.0)]
    text = spark.createDataFrame([("p", "a\nfoo bar\nfoobar\nb")], "path string, content string")
    hit = snippets.symbol_context(text, "foo", 1).collect()
    assert [(x["line"], list(x["context"])) for x in hit] == [(2, ["a", "foo bar", "foobar"])]
    calls = references(spark, {"path": "x", "module": "n", "name": "m.GreetService"})
    assert [tuple(x) for x in diagrams.call_sequence(calls, d, "n").collect()] == [("n", "m", "GreetService")]


def test_texts(spark):
    _, modules, edges = make(spark, ("a", "b"), ("b", "a"), ("b", "ext"), modules="ab")
    cycles = graph.detect_cycles(edges.filter("dst <> 'ext'"))
    diagram = draw.dependency(modules, edges, graph.cycle_edges(cycles))
    assert "|CYCLE|" in draw.mermaid(diagram) and "color=red" in draw.dot(diagram) and "@enduml" in draw.plantuml(diagram)
    assert draw.node_ids(["a.b", "a/b", "1"]) == {"1": "n_1", "a.b": "a_b", "a/b": "a_b_2"}
    assert draw.output_paths("d.mmd", ["flow", "component"])["flow"] == "d-flow.mmd"
    lines = [r["line"] for r in tsv.edges_block(edges).collect()]
    assert lines[0] == "From\tTo\tFile\tLine\tColumn" and lines[1].startswith("a\tb\ta.go")
    log = json.loads(reports.sarif({"cycles": cycles}))
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["ruleId"] == "import-cycle"
    assert "High" in reports.cycle_lines([["a", "b", "c", "d"]])[0]
    assert reports.replace_between("x<!-- m:start -->old<!-- m:end -->y", "m", "new") == "x<!-- m:start -->\nnew\n<!-- m:end -->y"
    with pytest.raises(ValueError):
        reports.replace_between("x", "m", "new")
    tree = diagrams.treemap(metrics.module_metrics(edges, modules, None, ("importance",)), files(spark, {"path": "a", "module": "a"}))
    assert json.loads(reports.treemap_json(tree))["children"][0]["children"][0]["value"] == 1


def test_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def land(name, *events):
        (landing / name).write_text("\n".join(json.dumps({"path": p, "content": c, "ts": f"2026-01-01T00:00:0{s}Z"}) for p, c, s in events))

    land("1.json", ("a.go", "one", 1), ("a.go", "two", 2), ("b.go", "x", 1), ("b_test.go", "t", 1))
    seen = []
    events = watch.watched(watch.change_events(spark, str(landing)), languages.registry())
    run = lambda: watch.start(events, str(tmp_path / "state"), str(tmp_path / "ck"), lambda s, c, n: seen.append({r["path"] for r in c.collect()}), available_now=True).awaitTermination()
    run()
    land("2.json", ("a.go", "two", 5), ("b.go", None, 6), ("c.go", "new", 6))
    run()
    assert seen == [{"a.go", "b.go"}, {"b.go", "c.go"}]
    assert {(r["path"], r["content"]) for r in store.read_current(spark, str(tmp_path / "state")).collect()} == {("a.go", "two"), ("c.go", "new")}
    bursts = spark.createDataFrame([("a", datetime(2026, 1, 1, 0, 0, 0)), ("b", datetime(2026, 1, 1, 0, 0, 0, 300000)), ("c", datetime(2026, 1, 1, 0, 0, 5))], "path string, ts timestamp")
    assert sorted(list(r["paths"]) for r in watch.debounced(bursts).collect()) == [["a", "b"], ["c"]]


def test_entry_without_the_training_data_parts():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    code = "import sys; sys.modules['graphloom.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport importlib.util as u; f = u.find_spec\nu.find_spec = lambda n, *a: None if n in ('graphloom.llm', 'corpus_pipeline') else f(n, *a)\nimport __spark_entry__ as e; assert 'cql_modules' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
