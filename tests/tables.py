"""Small model tables for tests."""

from graphloom.schemas import DEFINITIONS, FILES, IMPORTS, REFERENCES


def _rows(schema, rows):
    names = [c.split()[0] for c in schema.split(", ")]
    zero = {"string": "", "int": 0, "bigint": 0, "boolean": False, "double": 0.0}
    blank = {n: ([] if t.startswith("array") else zero[t]) for n, t in (c.split() for c in schema.split(", "))}
    return [tuple((blank | r)[n] for n in names) for r in rows]


def table(spark, schema, *rows):
    return spark.createDataFrame(_rows(schema, rows), schema)


def files(spark, *rows):
    return table(spark, FILES, *rows)


def imports(spark, *rows):
    return table(spark, IMPORTS, *rows)


def definitions(spark, *rows):
    return table(spark, DEFINITIONS, *rows)


def references(spark, *rows):
    return table(spark, REFERENCES, *rows)


def graph(spark, *pairs, modules=None):
    """modules and edges; each module has one file, named after it."""
    from graphloom.operators import model

    names = sorted(modules if modules is not None else {x for p in pairs for x in p})
    f = files(spark, *[{"path": f"{n}.go", "module": n, "language": "go"} for n in names])
    i = imports(spark, *[{"path": f"{a}.go", "module": a, "target": b, "seq": k} for k, (a, b) in enumerate(pairs)])
    return f, model.modules(f), model.edges(i)
