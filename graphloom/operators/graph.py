"""Graph operators over an edge table (src, dst).

Searches are frontier loops: each round joins the frontier with the edges, keeps the nodes that are new and cuts
the lineage. Components, depths and cycles of a graph within LOCAL_EDGES edges are found by one task with linear
algorithms; a larger one is worked on in rounds over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Edges up to which one task holds the whole graph: about 200 MB.
LOCAL_EDGES = 1_000_000


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): the fewest edges from any seed (column node) to each node that can be reached."""
    pairs = edges.select(F.col("src").alias("node"), F.col("dst")).distinct()
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        ahead = frontier.join(pairs, "node").select(F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if depth % 16 == 0:
            seen = cut(seen.coalesce(max(1, frontier.rdd.getNumPartitions())))
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def import_chain(edges: DataFrame, modules: DataFrame, start: str, end: str) -> list[str]:
    """A shortest chain of modules; of several the one that is least when read name by name; empty if there is none.

    Distances to the end are found first; then each step takes the least neighbour that is one nearer. Both
    ends must be modules; equal ends are a chain of one.
    """
    known = {r["name"] for r in modules.filter(F.col("name").isin(start, end)).select("name").collect()}
    if start not in known or end not in known:
        return []
    if start == end:
        return [start]
    spark = edges.sparkSession
    inner = edges.join(modules.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")
    pairs = reversed_edges(inner).withColumnRenamed("src", "node")
    seen = cut(spark.createDataFrame([(end, 0)], "node string, depth int"))
    frontier, depth = seen, 0
    while True:
        depth += 1
        ahead = frontier.join(pairs, "node").select(F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return []
        seen = seen.union(frontier)
        if not frontier.filter(F.col("node") == start).isEmpty():
            break
    nearer = inner.join(seen.withColumnRenamed("node", "dst"), "dst")
    chain = [start]
    for left in range(depth - 1, -1, -1):
        step = nearer.filter((F.col("src") == chain[-1]) & (F.col("depth") == left)).agg(F.min("dst")).first()[0]
        chain.append(step)
    return chain


def impact(edges: DataFrame, definitions: DataFrame, module: str) -> DataFrame:
    """(name, kind): direct importers of a module, transitive ones, and its exported symbols if anything imports it.

    A module in a cycle is a transitive importer of itself.
    """
    spark = edges.sparkSession
    direct = edges.filter(F.col("dst") == module).select(F.col("src").alias("node")).distinct()
    onward = levels(reversed_edges(edges), direct).select("node").join(direct, "node", "left_anti")
    found = direct.withColumn("kind", F.lit("direct")).union(onward.withColumn("kind", F.lit("transitive")))
    if direct.isEmpty():
        return spark.createDataFrame([], "name string, kind string")
    symbols = definitions.filter((F.col("module") == module) & F.col("exported")).select(F.col("name").alias("node")).distinct()
    return found.union(symbols.withColumn("kind", F.lit("symbol"))).withColumnRenamed("node", "name")


def invalidated_files(edges: DataFrame, files: DataFrame, changed: str) -> DataFrame:
    """(path): a changed file, with all files of the modules that reach its module by imports."""
    own = files.filter(F.col("path") == changed).select(F.col("module").alias("node"))
    above = levels(reversed_edges(edges), own).filter("depth > 0").select(F.col("node").alias("module"))
    spark = files.sparkSession
    return files.join(above, "module", "left_semi").select("path").union(spark.createDataFrame([(changed,)], "path string")).distinct()


def entry_modules(files: DataFrame, edges: DataFrame, modules: DataFrame, entries: list[str]) -> DataFrame:
    """Modules of the entry files (by path, path suffix or base name); without any those that none imports; else the first."""
    names = modules.select("name")
    match = F.lit(False)
    for e in (x.strip() for x in entries):
        if e:
            match = match | (F.col("path") == e) | F.col("path").endswith("/" + e) | (F.substring_index("path", "/", -1) == e) | (F.col("module") == e)
    found = files.filter(match).select(F.col("module").alias("node")).join(names.withColumnRenamed("name", "node"), "node", "left_semi").distinct()
    if entries and not found.isEmpty():
        return found
    inner = edges.join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").join(names.withColumnRenamed("name", "src"), "src", "left_semi")
    roots = names.withColumnRenamed("name", "node").join(inner.select(F.col("dst").alias("node")), "node", "left_anti")
    return roots if not roots.isEmpty() else names.agg(F.min("name").alias("node"))


def flow(edges: DataFrame, modules: DataFrame, entries: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, depth, entry) and edges (src, dst) within max_depth of the entries."""
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    inner = edges.join(modules.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    nodes = levels(inner, entries, max_depth)
    steps = inner.join(nodes.filter(F.col("depth") < max_depth).select(F.col("node").alias("src")), "src", "left_semi")
    named = nodes.join(entries.distinct().withColumn("entry", F.lit(True)), "node", "left")
    return named.select(F.col("node").alias("name"), "depth", F.coalesce("entry", F.lit(False)).alias("entry")), steps.select("src", "dst")


def _adjacency(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, set[str]] = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    return {k: sorted(v) for k, v in out.items()}


def strong_components(next_of: dict[str, list[str]]) -> dict[str, int]:
    """Component numbers by Tarjan's algorithm with its own stack; a component's number is above those it points to."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    component: dict[str, int] = {}
    open_nodes: list[str] = []
    done = 0
    for root in sorted(next_of):
        if root in number:
            continue
        work: list[tuple[str, Iterator[str]]] = [(root, iter(next_of[root]))]
        number[root] = low[root] = len(number)
        open_nodes.append(root)
        while work:
            node, ahead = work[-1]
            step = next(ahead, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    while True:
                        member = open_nodes.pop()
                        component[member] = done
                        if member == node:
                            break
                    done += 1
            elif step not in number:
                number[step] = low[step] = len(number)
                open_nodes.append(step)
                work.append((step, iter(next_of[step])))
            elif step not in component:
                low[node] = min(low[node], number[step])
    return component


def depths(next_of: dict[str, list[str]], component: dict[str, int]) -> dict[str, int]:
    """The longest way over components from each node to one that points nowhere else."""
    by_component: dict[int, int] = {}
    members: dict[int, list[str]] = {}
    for node, c in component.items():
        members.setdefault(c, []).append(node)
    for c in sorted(members):
        below = [by_component[component[t]] + 1 for n in members[c] for t in next_of[n] if component[t] != c]
        by_component[c] = max(below, default=0)
    return {n: by_component[c] for n, c in component.items()}


def back_edge_cycles(next_of: dict[str, list[str]]) -> list[list[str]]:
    """A cycle for each back edge of a depth-first search over sorted roots and neighbours."""
    return [cycle for _, cycle in rooted_cycles(next_of)]


def rooted_cycles(next_of: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """The same, each with the root from which the search found it."""
    state: dict[str, int] = {}
    cycles: list[tuple[str, list[str]]] = []
    for root in sorted(next_of):
        if root in state:
            continue
        path, place = [root], {root: 0}
        state[root] = 1
        work = [iter(next_of[root])]
        while work:
            step = next(work[-1], None)
            if step is None:
                work.pop()
                node = path.pop()
                state[node] = 2
                del place[node]
            elif step not in state:
                state[step] = 1
                place[step] = len(path)
                path.append(step)
                work.append(iter(next_of[step]))
            elif state[step] == 1:
                cycles.append((root, path[place[step] :]))
    return cycles


def _in_one_task(edges: DataFrame, run, schema: str) -> DataFrame:
    """run(pairs) over all edges in one task; the caller has checked their number."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [p for b in batches for p in zip(b["src"].tolist(), b["dst"].tolist(), strict=True)]
        yield pd.DataFrame(run(pairs), columns=[c.split()[0] for c in schema.split(", ")])

    return edges.select("src", "dst").distinct().coalesce(1).mapInPandas(whole, schema)


def _is_small(edges: DataFrame) -> bool:
    return edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


def components_and_depths(edges: DataFrame) -> DataFrame:
    """(node, component, size, depth) for each node of an edge; component is its least node."""
    if _is_small(edges):

        def run(pairs: list[tuple[str, str]]) -> list[tuple]:
            next_of = _adjacency(pairs)
            number = strong_components(next_of)
            depth = depths(next_of, number)
            least: dict[int, str] = {}
            size: dict[int, int] = {}
            for n in sorted(number):
                least.setdefault(number[n], n)
                size[number[n]] = size.get(number[n], 0) + 1
            return [(n, least[number[n]], size[number[n]], depth[n]) for n in number]

        return _in_one_task(edges, run, "node string, component string, size long, depth long")
    return _distributed_components(edges)


def _distributed_components(edges: DataFrame) -> DataFrame:
    """The same in rounds: nodes without a way in or out are components of their own; of the others, those that
    the greatest node above them reaches and is reached by, over edges that stay within a colour."""
    pairs = cut(edges.select("src", "dst").distinct())
    nodes = cut(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct())
    left, found = nodes, None
    while not left.isEmpty():
        inner = cut(pairs.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi").filter("src <> dst"))
        busy = inner.select(F.col("src").alias("node")).intersect(inner.select(F.col("dst").alias("node")))
        single = cut(left.join(busy, "node", "left_anti").select("node", F.col("node").alias("component")))
        if not single.isEmpty():
            found = single if found is None else found.union(single)
            left = cut(left.join(single, "node", "left_anti"))
            continue
        colour = cut(left.withColumn("colour", F.col("node")))
        while True:
            higher = inner.join(colour.toDF("src", "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("c"))
            moved = cut(colour.join(higher, "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("new"), "colour"))
            colour, same = moved.select("node", F.col("new").alias("colour")), moved.filter("new <> colour").isEmpty()
            if same:
                break
        own = (
            inner.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        back = levels(own, colour.filter("node = colour").select("node")).select("node")
        whole = cut(colour.join(back, "node", "left_semi"))
        names = whole.groupBy("colour").agg(F.min("node").alias("component"))
        part = cut(whole.join(names, "colour").select("node", "component"))
        found = part if found is None else found.union(part)
        left = cut(left.join(part, "node", "left_anti"))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("depth"))
    sized = cut(found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component"))
    between = cut(
        pairs.join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct()
    )
    depth = cut(sized.select("component").distinct().withColumn("depth", F.lit(0).cast("long")))
    while True:
        above = between.join(depth.toDF("b", "d"), "b").groupBy(F.col("a").alias("component")).agg((F.max("d") + 1).alias("d"))
        moved = cut(depth.join(above, "component", "left").select("component", F.greatest("depth", F.coalesce("d", "depth")).alias("new"), "depth"))
        depth, same = moved.select("component", F.col("new").alias("depth")), moved.filter("new <> depth").isEmpty()
        if same:
            break
    return sized.join(depth, "component").select("node", "component", "size", "depth")


def modules_in_cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes of a component of two or more, or with an edge to themselves."""
    many = components_and_depths(edges).filter("size > 1").select("node")
    return many.union(edges.filter("src = dst").select(F.col("src").alias("node"))).distinct()


def detect_cycles(edges: DataFrame) -> DataFrame:
    """(cycle_id, cycle): one cycle for each back edge, in the order in which a sorted depth-first search finds them.

    Nodes that aren't in a component of two or more can't be on a cycle but their own, yet they decide where a
    search enters, so the search is over whole weakly connected parts. A graph beyond LOCAL_EDGES edges is
    searched part by part, each part in one task.
    """
    if _is_small(edges):
        return _in_one_task(edges, lambda pairs: list(enumerate(back_edge_cycles(_adjacency(pairs)))), "cycle_id long, cycle array<string>")
    pairs = edges.select("src", "dst").distinct()
    part = weak_components(pairs)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = rooted_cycles(_adjacency(list(zip(group["src"], group["dst"], strict=True))))
        return pd.DataFrame([(r, n, c) for n, (r, c) in enumerate(found)], columns=["root", "n", "cycle"], dtype=object)

    cycles = cut(pairs.join(part.toDF("src", "part"), "src").groupBy("part").applyInPandas(run, "root string, n long, cycle array<string>"))
    # One search over all parts takes the roots in order, and enters a part anew at each of its roots.
    numbered = cycles.orderBy("root", "n").rdd.zipWithIndex().map(lambda x: (x[1], x[0]["cycle"]))
    return edges.sparkSession.createDataFrame(numbered, "cycle_id long, cycle array<string>")


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, part): the least node that each node is connected with, in either direction."""
    both = cut(edges.select("src", "dst").union(reversed_edges(edges)).filter("src <> dst").distinct())
    now = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("part", F.col("node")))
    while True:
        near = both.join(now.toDF("dst", "p"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("p").alias("p"))
        least = now.join(near, "node", "left").select("node", F.least("part", F.coalesce("p", "part")).alias("new"), "part")
        hopped = least.join(now.toDF("new", "p2"), "new").select("node", F.least("new", "p2").alias("new"), "part")
        moved = cut(hopped)
        now, same = moved.select("node", F.col("new").alias("part")), moved.filter("new <> part").isEmpty()
        if same:
            return now


def cycle_edges(cycles: DataFrame) -> DataFrame:
    """(src, dst): the edges of each cycle, the last node back to the first."""
    steps = cycles.select("cycle", F.posexplode("cycle").alias("i", "src"))
    return steps.select("src", F.get("cycle", (F.col("i") + 1) % F.size("cycle")).alias("dst")).distinct()
