import pytest
from graphloom.operators import query
from tables import definitions, files, imports


@pytest.fixture(scope="module")
def chain(spark):
    from graphloom.operators import model

    f = files(spark, *[{"path": f"{x}.go", "module": f"app/{x}", "language": "go"} for x in "abc"])
    i = imports(spark, {"path": "a.go", "module": "app/a", "target": "app/b", "line": 3, "col": 1}, {"path": "b.go", "module": "app/b", "target": "app/c", "line": 4, "col": 1})
    d = definitions(spark, *[{"path": f"{x}.go", "module": f"app/{x}", "name": f"Exported{x.upper()}", "exported": True} for x in "ab"])
    return f, model.modules(f), model.edges(i), d


def test_language(chain):
    _, modules, edges, d = chain
    run = lambda text: [r["name"] for r in query.run_cql(text, modules, edges, d).collect()]
    assert run("SELECT modules WHERE dependency_count >= 1 AND fan_out >= 1") == ["app/a", "app/b"]
    assert run("select modules") == ["app/a", "app/b", "app/c"]
    assert run("SELECT modules WHERE depth = 2") == ["app/a"]
    assert run("SELECT modules WHERE name = 'APP/B'") == ["app/b"]
    assert run("SELECT modules WHERE name = 3") == run("SELECT modules WHERE nothing > 0") == []
    assert run("SELECT modules WHERE export_count != 1") == ["app/c"]


def test_parse():
    assert [c.op for c in query.parse('SELECT modules WHERE fan_in > 0 AND name CONTAINS "app/"')] == [">", "contains"]
    for bad in ("DELETE FROM modules", "SELECT files", "SELECT modules WHERE fan_in", "SELECT modules WHERE name = ''", "SELECT modules WHERE a > 1 OR b > 1"):
        with pytest.raises(ValueError):
            query.parse(bad)


def test_details_and_list(chain):
    f, modules, edges, d = chain
    row = query.module_details("app/b", f, edges, d).first()
    assert [x["to"] for x in row["dependencies"]] == ["app/c"] and list(row["reverse_dependencies"]) == ["app/a"] and list(row["exports"]) == ["ExportedB"]
    assert query.module_details("none", f, edges, d).count() == 0
    assert [r["name"] for r in query.list_modules(query.module_summaries(modules, edges, d), "APP/", 2).collect()] == ["app/a", "app/b"]
    assert query.dependency_trace(edges, modules, "app/a", "app/c").depth == 2


def test_clamp():
    assert [query.clamp_limit(v, 5) for v in (0, -1, 3, 9)] == [5, 5, 3, 5]
