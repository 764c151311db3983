import pytest
from graphloom.operators import resolve, symbols
from tables import definitions, files, imports, references


def statuses(spark, f, i, d, r, options=resolve.Options()):
    ff, dd = files(spark, *f), definitions(spark, *d)
    found = resolve.assess(references(spark, *r), ff, imports(spark, *i), dd, symbols.symbol_table(dd, ff), options)
    return {x["name"]: x for x in found.collect()}, resolve.unresolved(found)


def test_unresolved(spark):
    f = [{"path": "a.go", "module": "modA", "language": "go"}, {"path": "b.go", "module": "modB", "language": "go"}]
    d = [{"path": "a.go", "module": "modA", "name": "FuncA", "full_name": "modA.FuncA", "exported": True}]
    r = [{"path": "b.go", "module": "modB", "language": "go", "seq": k, "name": n} for k, n in enumerate(("modA.FuncA", "modA.FuncMissing", "len"))]
    _, bad = statuses(spark, f, [{"path": "b.go", "module": "modB", "target": "modA"}], d, r)
    assert [x["name"] for x in bad.collect()] == ["modA.FuncMissing"]


def test_locals(spark):
    f = [{"path": "a.go", "module": "m", "language": "go", "local_symbols": ["p", "ctx", "items"]}]
    r = [{"path": "a.go", "module": "m", "language": "go", "seq": k, "name": n} for k, n in enumerate(("p.Register", "ctx.Done", "missing.Call", "items[i].Field"))]
    _, bad = statuses(spark, f, [], [], r)
    assert [x["name"] for x in bad.collect()] == ["missing.Call"]


def test_bridges(spark):
    f = [{"path": "a.py", "module": "m", "language": "python"}]
    names = [("ctypes.CDLL", "ffi_bridge"), ("subprocess.run", "process_bridge"), ("grpc.insecure_channel", "service_bridge"), ("unknown.bridgeCall", "")]
    r = [{"path": "a.py", "module": "m", "language": "python", "seq": k, "name": n, "context": c} for k, (n, c) in enumerate(names)]
    rows, bad = statuses(spark, f, [{"path": "a.py", "module": "m", "target": "grpc"}], [], r)
    assert [x["name"] for x in bad.collect()] == ["unknown.bridgeCall"]
    assert rows["ctypes.CDLL"]["status"] == rows["subprocess.run"]["status"] == "resolved"
    rows, _ = statuses(spark, f, [], [], r[2:3], resolve.Options(scores=resolve.BridgeScores(confirmed=10, probable=5)))
    assert rows["grpc.insecure_channel"]["status"] == "probable" and rows["grpc.insecure_channel"]["confidence"] == "medium"


def test_service_link_and_ambiguity(spark):
    f = [{"path": "s.py", "module": "svc", "language": "python"}, {"path": "c.go", "module": "client", "language": "go"}]
    d = [{"path": "s.py", "module": "svc", "name": "GreeterServicer", "full_name": "svc.GreeterServicer", "kind": 1, "exported": True, "decorators": ["grpc.service"]}]
    r = [{"path": "c.go", "module": "client", "language": "go", "name": "GreeterClient", "context": "service_bridge"}]
    assert statuses(spark, f, [], d, r)[0]["GreeterClient"]["status"] == "resolved"
    f = [{"path": "a.py", "module": "a", "language": "python"}, {"path": "b.go", "module": "b", "language": "go"}, {"path": "c.ts", "module": "c", "language": "typescript"}]
    d = [{"path": p, "module": p[0], "name": "Handle", "full_name": f"{p[0]}.Handle", "exported": True} for p in ("a.py", "b.go")]
    r = [{"path": "c.ts", "module": "c", "language": "typescript", "name": "api.Handle"}]
    assert statuses(spark, f, [], d, r)[0]["api.Handle"]["status"] == "unresolved"


def test_explicit_bridge(spark):
    f = [{"path": "a.go", "module": "internal/rt", "language": "go"}]
    r = [{"path": "a.go", "module": "internal/rt", "language": "go", "name": "worker.run"}]
    bridge = resolve.Bridge("go", "internal/rt", "python", "worker", references=("worker.*",))
    assert statuses(spark, f, [], [], r, resolve.Options(bridges=(bridge,)))[0]["worker.run"]["status"] == "resolved"
    assert resolve.parse_endpoint("go: a/b") == ("go", "a/b")
    with pytest.raises(ValueError):
        resolve.parse_endpoint("go:")


def test_unused_imports(spark):
    f = files(spark, {"path": "a.go", "module": "m", "language": "go"}, {"path": "b.js", "module": "", "language": "javascript"})
    i = imports(
        spark, {"path": "a.go", "module": "m", "target": "x/ports"}, {"path": "a.go", "module": "m", "target": "x/version", "seq": 1}, {"path": "a.go", "module": "m", "target": "x/gone", "seq": 2},
        {"path": "a.go", "module": "m", "target": "x/side", "alias": "_", "seq": 3}, {"path": "b.js", "target": "style"}, {"path": "b.js", "target": "lib", "items": ["used", "idle"], "seq": 1},
    )
    r = references(spark, {"path": "a.go", "name": "ports.AnalysisService"}, {"path": "a.go", "name": "version.Version"}, {"path": "b.js", "name": "used"})
    assert {(x["target"], x["item"], x["confidence"]) for x in resolve.unused_imports(i, r, f).collect()} == {("x/gone", "", "medium"), ("lib", "idle", "high")}
