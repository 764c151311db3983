import json
import os

import pytest
from graphloom import api
from graphloom.operators import resolve
from graphloom.sinks import outputs
from graphloom.sources import languages
from graphloom.streaming import analysis, watch


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


A = 'package a\n\nimport "m/b"\n\nfunc Use() {\n\tb.Do()\n\tb.Gone()\n}\n'
B = "package b\n\nfunc Do() {\n}\n\nfunc Gone() {\n}\n"
KEY = 'password = "Zx9Qw8Er7Ty6Ui5Op4As3Df2"'


def test_reanalysis_on_change(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def land(name, *events):
        (landing / name).write_text("\n".join(json.dumps({"path": p, "content": c, "ts": f"2026-01-01T00:00:{s:02d}Z"}) for p, c, s in events))

    kept = analysis.Analysis(str(tmp_path / "state"))
    seen = []

    def note(u):
        seen.append((rows(u.affected, "path"), rows(u.new_secrets, "file", "line")))

    def run():
        kept.start(watch.change_events(spark, str(landing)), str(tmp_path / "ck"), note, available_now=True).awaitTermination()

    land("1.json", ("go.mod", "module m\n", 1), ("a/a.go", A, 1), ("b/b.go", B, 1), ("c/c.py", "import os\nx = 1\n" + KEY + "\n", 1), ("d/d.py", "import os\n", 1), ("a/a_test.go", A, 1))
    run()
    table = lambda name: kept.table(spark, name)
    assert rows(table("files"), "path", "module") == [("a/a.go", "m/a"), ("b/b.go", "m/b"), ("c/c.py", "c"), ("d/d.py", "d")]
    assert rows(kept.unresolved(spark), "path", "name") == [] and rows(table("unused"), "path", "target") == [("c/c.py", "os"), ("d/d.py", "os")]
    assert rows(table("secrets"), "file", "line") == [("c/c.py", 3)]
    # b loses a function: a, which imports it, is affected and not extracted again. c has a changed line, d goes.
    land("2.json", ("b/b.go", B.split("\n\nfunc Gone")[0] + "\n", 5), ("c/c.py", "import os\nx = os.getcwd()\n" + KEY + "\n", 6), ("d/d.py", None, 9), ("a/a.go", A, 9))
    run()
    assert rows(kept.unresolved(spark), "path", "name") == [("a/a.go", "b.Gone")]
    assert rows(table("files"), "path") == [("a/a.go",), ("b/b.go",), ("c/c.py",)] and rows(table("unused"), "path", "target") == []
    assert seen[1] == ([("a/a.go",), ("b/b.go",), ("c/c.py",), ("d/d.py",)], []) and seen[0][1] == [("c/c.py", 3)]
    assert rows(table("secrets"), "file", "line") == [("c/c.py", 3)]
    events = spark.read.schema(watch.EVENTS).json(str(landing / "2.json"))
    assert kept.apply(events, 1 + max(watch.versions_below(spark, str(tmp_path / "state" / "sources"), 99))) is None


def test_reanalysis_equals_a_scan_of_everything(spark, tmp_path):
    """After two batches unresolved references and unused imports are those of one batch with the last contents."""
    texts = {f"p{k}/f.go": f'package p{k}\n\nimport "m/p{(k + 1) % 4}"\n\nfunc F{k}() {{\n\tp{(k + 1) % 4}.F{(k + 1) % 4}()\n\tp{(k + 1) % 4}.G()\n}}\n' for k in range(4)}
    change = {"p2/f.go": texts["p2/f.go"] + "\nfunc G() {\n}\n"}
    schema = watch.EVENTS.replace("ts timestamp", "ts string")

    def batch(some, second):
        return spark.createDataFrame([(p, c, f"2026-01-01 00:00:{second:02d}") for p, c in some.items()], schema).selectExpr("path", "content", "cast(ts as timestamp) ts")

    step, whole = analysis.Analysis(str(tmp_path / "a")), analysis.Analysis(str(tmp_path / "b"))
    step.apply(batch({"go.mod": "module m\n", **texts}, 1), 0)
    for k, (p, c) in enumerate(change.items(), 1):
        step.apply(batch({p: c}, k + 1), k)
    whole.apply(batch({"go.mod": "module m\n", **texts, **change}, 1), 0)
    for name, columns in (("assessed", ("path", "name", "status", "score")), ("unused", ("path", "target")), ("files", ("path", "module")), ("imports", ("path", "target"))):
        assert rows(step.table(spark, name), *columns) == rows(whole.table(spark, name), *columns), name


def test_bursts_settle(spark):
    events = spark.createDataFrame([("a", "1", 0.0), ("a", "2", 0.3), ("b", "x", 0.1), ("a", "3", 5.0)], "path string, content string, s double").selectExpr("path", "content", "timestamp_seconds(s) ts")
    assert rows(analysis.settled(events), "path", "content") == [("a", "2"), ("a", "3"), ("b", "x")]


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in {"go.mod": "module m\n", "a/a.go": A, "b/b.go": B, "c/c.py": KEY + "\n"}.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    found = api.Project.scanned(spark, [str(root)])
    found.config.roots, found.config.projects = [str(root)], [{"name": "other", "root": "x"}]
    found.targets = outputs.Targets(str(root / "out"), dot="graph.dot", mermaid="maps/g.mmd", tsv="t.tsv", markdown="r.md", sarif="s.json", treemap="/" + str(root / "tree.json").lstrip("/"), modes=("dependency", "flow"))
    return found, root


def test_outputs_are_written_in_one_go(project):
    found, root = project
    written = outputs.write_outputs(found, found.targets)
    names = ["out/docs/diagrams/graph-dependency.dot", "out/maps/g-dependency.mmd", "out/docs/diagrams/graph-flow.dot", "out/maps/g-flow.mmd", "out/t.tsv", "out/r.md", "out/s.json", "tree.json"]
    assert written == [str(root / n) for n in names] and all(os.path.getsize(w) for w in written)
    lines = (root / "out/t.tsv").read_text().split("\n")
    assert lines[0].startswith("From\tTo") and any(x.startswith("secret\t") for x in lines)
    assert json.loads((root / "out/s.json").read_text())["version"] == "2.1.0"
    with pytest.raises(ValueError):
        outputs.write_outputs(found, found.targets, ["png"])
    assert outputs.Targets("r").diagram("x.dot") == "r/docs/diagrams/x.dot" and outputs.Targets("r").diagram("") == ""


def test_operations_that_change_something(project):
    found, root = project
    for name, params in (("graph.sync_diagrams", {"write": True}), ("report.generate_markdown", {"path": "x.md"}), ("system.watch", {}), ("system.select_project", {"name": "other"})):
        with pytest.raises(api.OperationError) as e:
            api.call(found, name, params)
        assert e.value.code == "forbidden"
    ask = lambda operation, **params: api.call(found, operation, params, mutations=True)["result"]
    assert len(ask("system.sync_outputs", write=True, formats=["dot"])["written"]) == 2
    assert (root / "out/x.md").exists() == bool(0) and ask("report.generate_markdown", path="x.md")["written"] == str(root / "out/x.md")
    started = []

    class Running:
        isActive = True

    found.watcher = lambda: started.append(1) or Running()
    assert [ask("system.watch")["status"] for _ in range(2)] == ["watching", "already_watching"] and started == [1]
    assert ask("system.health") == {"status": "up", "components": {"graph": "ok (3 files, 3 modules)", "sources": "ok", "watch": "ok"}}
    with pytest.raises(api.OperationError):
        ask("system.select_project", name="none")
    assert ask("system.select_project", name="other") == {"project": "other"}


def test_scan_again(project):
    found, root = project
    (root / "b/b.go").write_text(B + "\nfunc More() {\n}\n")
    (root / "c/c.py").unlink()
    assert api.call(found, "scan.run", {"paths": [str(root / "b")]})["result"]["files"] == 3
    assert {(r["module"], r["name"]) for r in found.definitions.filter("path like '%/b.go'").collect()} == {("m/b", "Do"), ("m/b", "Gone"), ("m/b", "More")}
    assert api.call(found, "scan.run", {"again": True})["result"]["files"] == 2
    found.lock.acquire()
    with pytest.raises(api.OperationError) as e:
        api.call(found, "scan.run", {"again": True})
    found.lock.release()
    assert e.value.code == "unavailable"


def test_older_schemas_are_migrated(spark):
    from graphloom.operators import store

    old = spark.createDataFrame([("2026-01-01", 3)], "ts string, module_count int")
    assert rows(store.migrated(old, "snapshots", 1), "ts", "module_count", "project_key") == [("2026-01-01", 3, "default")]
    assert store.migrated(old, "snapshots", 2).columns == old.columns and store.migrated(old, "blobs", 1).columns == old.columns
    with pytest.raises(ValueError):
        store.migrated(old, "symbols", 8)


def test_globs_leave_directories_out(spark):
    from graphloom.operators import secrets
    from graphloom.sources import scan

    files = spark.createDataFrame([("vendor/x/a.go", "package a"), ("src/a.go", "package a"), ("src/a.gen.go", "package a")], "path string, content string")
    kept = scan.source_files(files, languages.registry(), exclude_dirs=["vend*"], exclude_files=["*.gen.go"])
    assert rows(kept, "path") == [("src/a.go",)]
    assert rows(secrets.skipped_paths(files, ["*.gen.go"], ["vendor"]), "path") == [("src/a.go",)]


def test_scores_do_not_depend_on_how_symbols_are_counted(spark):
    """Best and second score of each reference against a plain pass over all pairs, with hot names, services and imports."""
    import random

    from graphloom.operators import symbols
    from tables import definitions, files, imports, references

    rng = random.Random(5)
    langs = ("go", "python", "javascript")
    f = [{"path": f"f{k}", "module": f"m{k % 6}", "language": langs[k % 3]} for k in range(12)]
    names = ["Do", "Get", "GreetServer", "GreetClient", "Pkg.Do", "Get.Do", "do"]
    d = [{"path": f"f{k % 12}", "module": f"m{k % 6}", "seq": k, "name": rng.choice(names), "exported": rng.random() < 0.5, "visibility": rng.choice(("", "public"))} for k in range(60)]
    for x in d:
        x["full_name"] = rng.choice(("", f"{x['module']}.{x['name']}", f"pkg.{x['name']}", "Do"))
    i = [{"path": f"f{k}", "module": f"m{k % 6}", "target": f"m{(k + 1) % 6}", "alias": rng.choice(("", "al"))} for k in range(12)]
    contexts = ("", "service_bridge", "ffi_bridge", "process_bridge")
    asked = ["Do", "pkg.Do", "m1.Do", "al.Get", "x.GreetStub", "GreetClient", "m2.GreetServer", "Get.Do", "none", "(", "grpc.Do", "m3.Pkg.Do"]
    r = [{"path": f"f{k % 12}", "module": f"m{k % 6}", "language": langs[k % 12 % 3], "seq": k, "name": asked[k % len(asked)], "context": contexts[k // 7 % 4]} for k in range(96)]
    ff, dd = files(spark, *f), definitions(spark, *d)
    table = symbols.symbol_table(dd, ff)
    told = resolve.with_context(references(spark, *r), ff, imports(spark, *i))
    found = {(x["rid"]["path"], x["rid"]["seq"]): x for x in resolve.candidate_scores(told, table).collect()}
    keys = symbols.lookup_keys(table).collect()
    plain = told.select("rid", "name", "language", "module", "context", "imps", *[c.alias(n) for n, c in (("own", resolve.canonical(told["name"])), ("leaf", resolve.canonical(resolve.leaf(told["name"]))),
        ("skey", resolve.service_key(told["name"])), ("sleaf", resolve.service_key(resolve.leaf(told["name"]))), ("bridge", resolve.is_bridge_reference(told["language"], told["name"], told["context"])))]).collect()
    hot = 0
    for x in plain:
        cs = []
        for by, whole, last in (("name", x["own"], x["leaf"]), *([("service", x["skey"], x["sleaf"])] if x["context"] == "service_bridge" else [])):
            first = [k for k in keys if k["by"] == by and k["key"] == whole]
            cs += first or [k for k in keys if k["by"] == by and k["key"] == last]
        scores = []
        for c in cs:
            s = 8 * (x["own"] != "" and x["own"] == c["canonical_name"]) + 6 * (x["leaf"] != "" and x["leaf"] == c["canonical_name"])
            s += 6 * (c["full_name"] != "" and x["own"] != "" and x["own"] == c["canonical_full"]) + 4 * (c["full_name"] != "" and x["leaf"] != "" and x["leaf"] == c["canonical_full"])
            s += 5 * (x["module"] != "" and c["module"] == x["module"]) + 2 * (x["language"] == c["language"]) + (c["exported"] or c["visibility"] == "public")
            s += 4 * any(i["target"] == c["module"] and (i["name"] and x["name"].startswith(i["name"] + ".") or i["alias"] and x["name"].startswith(i["alias"] + ".")) for i in x["imps"])
            s += 5 * (x["context"] == "service_bridge" and c["is_service"]) + (x["context"] in ("ffi_bridge", "process_bridge") and not c["is_service"]) + 2 * (x["bridge"] and x["language"] != c["language"])
            scores.append(s)
        got = found.get((x["rid"]["path"], x["rid"]["seq"]))
        assert (got is None) == (not scores)
        if scores:
            hot += 1
            abroad = {(c["language"], c["module"], c["full_name"], c["name"]) for c in cs if c["language"] not in ("", x["language"])}
            assert (got["best"], got["second"]) == tuple(sorted([*scores, 0, *([0] * (len(scores) < 2))], reverse=True)[:2]) and min(got["abroad"], 2) == min(len(abroad), 2), (x, scores)
    assert hot > 50
