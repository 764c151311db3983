import random

import pytest
from graphloom.operators import graph, metrics, query
from tables import definitions, graph as make

PAIRS = [("A", "B"), ("B", "C"), ("C", "A"), ("D", "B")]


def test_metrics_of_a_cycle(spark):
    _, modules, edges = make(spark, *PAIRS, modules="ABCDE")
    rows = {r["name"]: r for r in metrics.module_metrics(edges, modules, None).collect()}
    assert rows["A"]["depth"] == rows["B"]["depth"] == rows["C"]["depth"] == rows["D"]["depth"] - 1
    assert rows["B"]["fan_in"] == 2 and rows["A"]["fan_out"] == rows["B"]["fan_out"] == 1
    assert (rows["E"]["fan_in"], rows["E"]["fan_out"], rows["E"]["depth"]) == (0, 0, 0)


def test_chain(spark):
    _, modules, edges = make(spark, ("A", "B"), ("B", "D"), ("A", "C"), ("C", "D"), modules="ABCDE")
    assert graph.import_chain(edges, modules, "A", "D") == ["A", "B", "D"]
    assert graph.import_chain(edges, modules, "A", "A") == ["A"]
    assert graph.import_chain(edges, modules, "D", "A") == []
    assert graph.import_chain(edges, modules, "A", "missing") == []
    with pytest.raises(LookupError):
        query.dependency_trace(edges, modules, "A", "D", 1)


def test_cycles(spark):
    _, modules, edges = make(spark, *PAIRS)
    assert [sorted(r["cycle"]) for r in graph.detect_cycles(edges).collect()] == [["A", "B", "C"]]
    assert {r["node"] for r in graph.modules_in_cycles(edges).collect()} == {"A", "B", "C"}
    assert {(r["src"], r["dst"]) for r in graph.cycle_edges(graph.detect_cycles(edges)).collect()} == {("A", "B"), ("B", "C"), ("C", "A")}


def test_long_cycle_without_recursion():
    ring = {str(i): [str((i + 1) % 5000)] for i in range(5000)}
    assert [len(c) for c in graph.back_edge_cycles(ring)] == [5000]
    assert len(set(graph.strong_components(ring).values())) == 1


def test_impact(spark):
    _, modules, edges = make(spark, ("A", "B"), ("C", "A"), ("D", "A"))
    defs = definitions(spark, {"path": "b.go", "module": "B", "name": "Run", "exported": True})
    found = {}
    for r in graph.impact(edges, defs, "B").collect():
        found.setdefault(r["kind"], set()).add(r["name"])
    assert found == {"direct": {"A"}, "transitive": {"C", "D"}, "symbol": {"Run"}}
    assert graph.impact(edges, defs, "D").collect() == []


def test_flow_and_invalidation(spark):
    files, modules, edges = make(spark, ("A", "B"), ("B", "C"), ("C", "D"))
    entry = graph.entry_modules(files, edges, modules, [])
    nodes, steps = graph.flow(edges, modules, entry, 2)
    assert {(r["name"], r["depth"], r["entry"]) for r in nodes.collect()} == {("A", 0, True), ("B", 1, False), ("C", 2, False)}
    assert {tuple(r) for r in steps.collect()} == {("A", "B"), ("B", "C")}
    assert {r["path"] for r in graph.invalidated_files(edges, files, "C.go").collect()} == {"A.go", "B.go", "C.go"}


def _model(pairs):
    """Reachability in plain Python."""
    nodes = sorted({x for p in pairs for x in p})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    comp = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    depth = dict.fromkeys(comp.values(), 0)
    for _ in nodes:
        for a, b in pairs:
            if comp[a] != comp[b]:
                depth[comp[a]] = max(depth[comp[a]], depth[comp[b]] + 1)
    return {(n, comp[n], depth[comp[n]]) for n in nodes}


def test_components_in_one_task_match_a_model(spark):
    rng = random.Random(3)
    for _ in range(40):
        pairs = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(rng.randrange(1, 16))]
        next_of = graph._adjacency(pairs)
        number = graph.strong_components(next_of)
        depth = graph.depths(next_of, number)
        least = {}
        for n in sorted(number):
            least.setdefault(number[n], n)
        assert {(n, least[number[n]], depth[n]) for n in number} == _model(pairs)


def test_components_in_rounds_match_a_model(spark):
    rng = random.Random(5)
    for _ in range(2):
        pairs = [(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}") for _ in range(12)]
        edges = spark.createDataFrame(pairs, "src string, dst string")
        found = {(r["node"], r["component"], r["depth"]) for r in graph._distributed_components(edges).collect()}
        assert found == _model(pairs)


def test_weak_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in graph.weak_components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_cycles_of_a_large_graph_are_numbered_as_those_of_a_small_one(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(f"{p}{rng.randint(0, 5)}", f"{p}{rng.randint(0, 5)}") for p in "abcdef" for _ in range(9)]
    pairs += [("k1", "k0"), ("k5", "k1"), ("k5", "k6"), ("k6", "k5"), ("k1", "k1"), ("k3", "l4"), ("l4", "k3")]
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(4)
    small = sorted(map(tuple, graph.detect_cycles(edges).collect()))
    monkeypatch.setattr(graph, "LOCAL_EDGES", 3)
    assert sorted(map(tuple, graph.detect_cycles(edges).collect())) == small and len(small) > 6
