"""N-gram Jaccard self-join: documents whose word-shingle sets overlap by ``percent`` or more, as components.

1. Every whole text becomes its set of distinct shingles. Equal sets are one node from here on.
2. A count sketch of fixed size over all sets gives the shingles one global order, rare first. The order only
   steers the work: prefix filtering is exact under any order that all sets share.
3. Sets that link share a shingle among the first ``n - ceil(percent * n / 100) + 1`` of each. These prefixes
   are matched by shingle. A shingle's place in a set bounds the size of a larger partner that it may be the
   first common shingle with. A shingle of up to FEW sets gives the pairs that these bounds allow. Within any
   other, sets are merged in order of size into runs that the bounds connect, before the shuffle and again after
   it, so a shingle that a third of all documents have sends a few runs for each task and never pairs. A pair
   goes where the parities of both sets, a bit for each shingle, differ in more bits than sets that link can in
   shingles. The order can't tell rare shingles of a large corpus apart, so without this, chance pairs would tie
   ever more sets together. Runs and the pairs that stay give candidate components.
4. A second look at the texts makes the sets of the candidates alone: a bitmap of fixed size passes over most
   other texts before the shuffle, and the join with the candidates over the rest.
5. A candidate component goes to one task, which joins its sets in a prefix tree. One that is too large is
   dealt by size band and hash into blocks, and each pair of blocks that can hold a link is one task.
6. The links' components, with the copies of each set, are the result.

Texts, sets and links stay on the executors; only the sketch and the bitmap, which have fixed sizes, pass the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_width
from .components import connected_components
from .text_hash import SHINGLE, mix, shingle_sets, signature
from .trie_join import link_components

PERCENT = 75
#: Cells of the count sketch; 4 bytes each, so 32 MB whatever the corpus.
CELLS = 1 << 23
PARTS = 32
#: Bits of the bitmap of candidates: 4 MB. Where it is too full to hold any text back, the join does all of it.
BITS = 1 << 25
#: Prefix entries that a task gathers before it merges and sends them.
ENTRIES = 1_000_000
#: Sets with one shingle that are compared by pairs; those of a shingle with more are merged in runs.
FEW = 32
#: Weight of a block of a candidate component: a set weighs its shingles and SET_WEIGHT.
BLOCK_WEIGHT = 2_000_000
SET_WEIGHT = 250
#: Ratio of two neighbouring size bands; over 100 / PERCENT, so that links stay within neighbouring bands.
BAND_SLACK = 1.01


def _parity(hashes: np.ndarray) -> bytes:
    """For each of the values of a hash of shingles whether an odd number has it; as many bits as shingles, up to a power of two."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_link(n: int, odd: bytes, m: int, other: bytes, percent: int) -> bool:
    """False only if sets of n and m shingles with these parities can't link; the longer one is folded to the shorter.

    A shingle of one set alone turns one bit, so the parities differ in no more bits than the sets do in shingles.
    """
    if len(odd) < len(other):
        odd, other = other, odd
    x, bits = int.from_bytes(odd, "little"), 8 * len(odd)
    while bits > 8 * len(other):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(other, "little")).bit_count() <= n + m - 2 * -(-percent * (n + m) // (100 + percent))


def _near(percent: int):
    """The pairs (a, b) that may link, of those with the sizes and parities of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n", "odd", "m", "other"))
            keep = pa.array([_may_link(*row, percent) for row in zip(*columns, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _features(width: int, extra: int):
    names = ["id", "n", "sig", "parity", "part", "cells", *[f"x{i}" for i in range(extra)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, waiting, size = np.zeros(CELLS, np.uint32), [], 0

        def add() -> None:
            nonlocal size
            if size:
                cell, counts = np.unique(np.concatenate(waiting), return_counts=True)
                sketch[cell] += counts.astype(np.uint32)
                waiting.clear()
                size = 0

        for batch in batches:
            ns, signs, odd = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                ns.append(len(s))
                signs.append(signature(s) if len(s) else None)
                odd.append(_parity(s) if len(s) else None)
                waiting.append((s % np.uint64(CELLS)).astype(np.int64))
                size += len(s)
                if size > 2 * ENTRIES:
                    add()
            nothing = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column("id"), pa.array(ns, pa.int64()), pa.array(signs, pa.binary()), pa.array(odd, pa.binary())),
                    *(nothing.cast(pa.int32()), nothing.cast(pa.binary()), *batch.columns[2:]),
                ],
                names=names,
            )
        add()
        step = CELLS // PARTS
        for p in range(PARTS):
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([p], pa.int32())),
                    *(pa.array([zlib.compress(sketch[p * step : (p + 1) * step].tobytes(), 1)], pa.binary()), *[pa.nulls(1, pa.int64())] * extra),
                ],
                names=names,
            )

    return run


def _merge(how: str):
    """Adds up, or unites, what tasks have for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells"), strict=True):
                more = np.frombuffer(zlib.decompress(cells.as_buffer()), np.uint32)
                if part not in sums:
                    sums[part] = more
                elif how == "sum":
                    sums[part] = np.minimum(sums[part].astype(np.uint64) + more, 0xFFFFFFFF).astype(np.uint32)
                else:
                    sums[part] = sums[part] | more
        for part, total in sums.items():
            yield _part(part, total)

    return run


def _part(part: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], names=["part", "cells"])


def _gathered(cells: DataFrame, how: str, size: int) -> np.ndarray:
    """The cells of all tasks in one array on the driver: first those of a few tasks each, then by part alone."""
    salted = cells.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    partial = salted.repartition(PARTS, "part", "salt").select("part", "cells").mapInArrow(_merge(how), "part int, cells binary")
    rows = partial.repartition(PARTS, "part").mapInArrow(_merge(how), "part int, cells binary").collect()
    out = np.zeros(size, np.uint32)
    step = size // PARTS
    for row in rows:
        out[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(zlib.decompress(row["cells"]), np.uint32)
    return out


def _bit(node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(node.view(np.uint64) + mix(doc.view(np.uint64) + np.uint64(1))) % np.uint64(BITS)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(BITS // 32, np.uint32)
    for batch in batches:
        bit = _bit(*(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "id")))
        np.bitwise_or.at(cells, bit >> 5, np.uint32(1) << (bit & 31).astype(np.uint32))
    step = len(cells) // PARTS
    for p in range(PARTS):
        if cells[p * step : (p + 1) * step].any():
            yield _part(p, cells[p * step : (p + 1) * step])


def bitmap(marked: DataFrame) -> np.ndarray:
    """The bitmap of the pairs (node, id) of marked, two longs of which id may be null."""
    return _gathered(marked.select("node", "id").mapInArrow(_mark, "part int, cells binary"), "or", BITS // 32)


def in_bitmap(shared, node: Column, doc_id: Column) -> Column:
    """True for the pairs of a bitmap that is broadcast, and by chance for others."""

    @F.arrow_udf("boolean")
    def found(nodes: pa.Array, ids: pa.Array) -> pa.Array:
        bit = _bit(*(c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (nodes, ids)))
        return pa.array((shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1)).astype(bool))

    return found(node, doc_id.cast("long"))


def _bound(size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The largest size of a partner, not below size, with which a set's shingle at place may be the first common one.

    Then at most size - place shingles are common, and a link asks for percent * (size + partner) / (100 + percent).
    """
    return np.minimum((size - place) * (100 + percent) // percent - size, 100 * size // percent)


def _runs(token: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge what one token connects: (token, node, low, high) of runs, and edges (a, b).

    low is the least size in a run and high the largest size that one of its sets may link with. If two sets may
    link through the token, the larger one's size is at most the smaller one's bound, so both are in one run.
    """
    order = np.lexsort((low, token))
    token, node, low, high = token[order], node[order], low[order], high[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    lift = np.cumsum(new) * (int(high.max()) + 1)
    so_far = np.maximum.accumulate(high + lift) - lift
    new[1:] |= so_far[:-1] < low[1:]
    starts = np.flatnonzero(new)
    head = np.minimum.reduceat(node, starts)
    own = np.repeat(head, np.diff(np.append(starts, len(token))))
    edges = np.unique(np.stack([node, own], 1)[node != own], axis=0)
    return token[starts], head, low[starts], np.maximum.reduceat(high, starts), edges[:, 0], edges[:, 1]


def _groups(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of equal neighbours start, and how many each has."""
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(token)))


def _pairs(token: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets, of groups of FEW at most that are sorted by token and size, that may link through the token."""
    found = [np.zeros((0, 2), np.int64)]
    for d in range(1, FEW):
        i = np.flatnonzero(token[d:] == token[:-d])
        if not len(i):
            break
        i = i[low[i + d] <= high[i]]
        found.append(np.unique(np.sort(np.stack([node[i], node[i + d]], 1), axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge for each node but the least."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(names))], np.int64)
    moved = roots != np.arange(len(names))
    return names[moved], names[roots[moved]]


_POSTING = "bucket int, kind int, count int, payload binary"
#: Kinds of postings: sets by token, edges, and runs of sets by token.
_SINGLE, _EDGE, _RUN = 0, 1, 2


def _posting(bucket: int, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    payload = b"".join(c.tobytes() for c in columns)
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([len(columns[0])], pa.int32()), pa.array([payload], pa.binary())],
        names=["bucket", "kind", "count", "payload"],
    )


def _node(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _prefixes(shared, percent: int, width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        tokens, nodes, sizes, waiting, known = [], [], [], 0, set()

        def send() -> Iterator[pa.RecordBatch]:
            token = np.concatenate(tokens)
            counts = [len(t) for t in tokens]
            size = np.repeat(np.array(sizes, np.int64), counts)
            place = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
            order = np.argsort(token, kind="stable")
            every = token[order], np.repeat(np.array(nodes, np.int64), counts)[order], size[order], _bound(size, place, percent)[order]
            group = _groups(every[0])[1]
            many = np.repeat(group > FEW, group)
            yield from sorted_out(_SINGLE, *(c[~many] for c in every))
            if many.any():
                *runs, a, b = _runs(*(c[many] for c in every))
                if len(a):
                    a, b = _forest(a, b)
                    yield _posting(int(abs(a[0]) % buckets), _EDGE, a, b)
                yield from sorted_out(_RUN, *runs)

        def sorted_out(kind: int, token: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = (token >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                pick = order[at[k] : at[k + 1]]
                if len(pick):
                    yield _posting(k, kind, token[pick], node[pick], low[pick].astype(np.int32), high[pick].astype(np.int32))

        for batch in batches:
            for s in shingle_sets(batch.column("text"), width):
                n = len(s)
                if not n:
                    continue
                node = _node(signature(s))
                if node in known:
                    continue
                known.add(node)
                keep = n - -(-percent * n // 100) + 1
                seen = sketch[(s % np.uint64(CELLS)).astype(np.int64)]
                tokens.append(s[np.lexsort((s, seen))[:keep]])
                nodes.append(node)
                sizes.append(n)
                waiting += keep
                if waiting >= ENTRIES:
                    yield from send()
                    tokens, nodes, sizes, waiting, known = [], [], [], 0, set()
        if tokens:
            yield from send()

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b): sure ones of runs, and pairs that are to be looked at."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    near, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for kind, n, payload in zip(*(batch.column(c) for c in ("kind", "count", "payload")), strict=True):
            kind, n, raw = kind.as_py(), n.as_py(), payload.as_buffer()
            if kind == _EDGE:
                near.append(np.frombuffer(raw, np.int64, n))
                far.append(np.frombuffer(raw, np.int64, n, 8 * n))
            else:
                columns[0].append(np.frombuffer(raw, np.uint64, n))
                columns[1].append(np.frombuffer(raw, np.int64, n, 8 * n))
                columns[2].append(np.frombuffer(raw, np.int32, n, 16 * n).astype(np.int64))
                columns[3].append(np.frombuffer(raw, np.int32, n, 20 * n).astype(np.int64))
                columns[4].append(np.full(n, kind == _RUN))
    if columns[0]:
        *every, run = (np.concatenate(c) for c in columns)
        order = np.lexsort((every[1], every[2], every[0]))
        every, run = [c[order] for c in every], run[order]
        new = np.ones(len(run), bool)  # a set that several tasks had counts once
        new[1:] = run[1:] | run[:-1] | (every[0][1:] != every[0][:-1]) | (every[1][1:] != every[1][:-1])
        every, run = [c[new] for c in every], run[new]
        starts, group = _groups(every[0])
        many = np.repeat((group > FEW) | np.logical_or.reduceat(run, starts), group)
        yield _edges(False, *_pairs(*(c[~many] for c in every)))
        if many.any():
            *_, a, b = _runs(*(c[many] for c in every))
            near.append(a)
            far.append(b)
    yield _edges(True, *_forest(np.concatenate(near), np.concatenate(far)))


def _edges(sure: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), sure))], names=["a", "b", "sure"])


def _sets(shared, width: int):
    """(id, sig, grams) of the texts that the bitmap lets through, all candidates among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids = batch.column("id").cast(pa.int64()).to_pylist()
            keep: list[tuple] = []
            size = 0
            for doc, s in zip(ids, shingle_sets(batch.column("text"), width), strict=True):
                if not len(s):
                    continue
                sig = signature(s)
                bit = int(_bit(np.array([_node(sig)]), np.array([doc or 0]))[0])
                if bits[bit >> 5] >> np.uint32(bit & 31) & np.uint32(1):
                    keep.append((doc, sig, s.tobytes()))
                    size += len(s)
                    if size > ENTRIES:
                        yield _gram_rows(keep)
                        keep, size = [], 0
            if keep:
                yield _gram_rows(keep)

    return run


def _gram_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.binary())
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "sig", "grams"])


def _join_units(percent: int):
    """The links of each unit, as edges from its sets to the first set of their component."""

    def join(sides: list[int], many: bool, signs: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        once: dict[bytes, int] = {}
        for i, s in enumerate(signs):
            once.setdefault(s, i)
        pick = list(once.values())
        side = np.array([sides[i] for i in pick])
        label = link_components([sets[i] for i in pick], percent, side if many and side.min() != side.max() else None)
        names = [signs[i] for i in pick]
        pairs = [(names[i], names[int(k)]) for i, k in enumerate(label) if i != k]
        return pa.RecordBatch.from_arrays(
            [pa.array([many] * len(pairs), pa.bool_()), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())],
            names=["many", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides, many, signs, sets = None, [], False, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("unit", "side", "many", "sig", "grams"))
            for u, side, m, sig, grams in zip(*columns, strict=True):
                if u != unit:
                    if len(signs) > 1:
                        yield join(sides, many, signs, sets)
                    unit, sides, many, signs, sets = u, [], m, [], []
                sides.append(side)
                signs.append(sig)
                sets.append(np.frombuffer(grams, np.uint64))
        if len(signs) > 1:
            yield join(sides, many, signs, sets)

    return run


def _units(candidates: DataFrame, percent: int) -> DataFrame:
    """candidates (sig, id, n, comp) with ``units``: the tasks that each set goes to.

    A component within BLOCK_WEIGHT is one unit. Others are dealt into blocks by size band and hash; a unit is
    a pair of blocks of one band or of neighbouring bands.
    """
    ratio = math.log(100 / percent * BAND_SLACK)
    sized = candidates.withColumn("band", F.floor(F.log(F.col("n")) / ratio).cast("int"))
    bands = sized.groupBy("comp", "band").agg(F.sum(F.col("n") + SET_WEIGHT).alias("weight"))
    bands = bands.withColumn("blocks", F.ceil(F.col("weight") / BLOCK_WEIGHT).cast("int"))
    beside = F.array(*[F.struct((F.col("band") + d).alias("band"), F.lit(-d).alias("of"), "blocks") for d in (-1, 0, 1)])
    around = (
        bands.select("comp", F.explode(beside).alias("x"))
        .groupBy("comp", F.col("x.band").alias("band"))
        .agg(*[F.coalesce(F.max(F.when(F.col("x.of") == d, F.col("x.blocks"))), F.lit(0)).alias(name) for d, name in ((-1, "under"), (0, "same"), (1, "over"))])
        .filter("same > 0")
    )
    total = bands.groupBy("comp").agg(F.sum("weight").alias("total"))
    dealt = sized.join(around, ["comp", "band"]).join(total, "comp").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("same")).cast("int"))
    single = F.array(F.struct(F.col("comp").cast("string").alias("unit"), F.lit(0).alias("side"), F.lit(False).alias("many")))
    unit = "named_struct('unit', concat_ws(':', comp, {low}, {a}, {high}, {b}), 'side', {side}, 'many', true)"
    pairs = F.expr(
        f"""concat(
          transform(sequence(0, same - 1), k -> {unit.format(low="band", a="least(own, k)", high="band", b="greatest(own, k)", side="own")}),
          transform(filter(sequence(0, over), k -> k < over), k -> {unit.format(low="band", a="own", high="band + 1", b="k", side="0")}),
          transform(filter(sequence(0, under), k -> k < under), k -> {unit.format(low="band - 1", a="k", high="band", b="own", side="1")}))"""
    )
    return dealt.select("sig", "id", F.when(F.col("total") <= BLOCK_WEIGHT, single).otherwise(pairs).alias("units"))


def shingle_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, width: int = SHINGLE, extra: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs, and the columns named in extra (longs).

    Two documents link if ``100 * shared >= percent * united`` over their sets of distinct width-word
    shingles; a text of fewer words has its whole sequence as its one shingle. component_id is the smallest
    doc_id that links reach, the row's own included. A null or empty text, or one without words, has an empty
    set and links with nothing; a null doc_id counts as none, so it is a component_id only where a component
    has no other. Rows that repeat a doc_id are compared one by one. An empty table gives an empty result, and
    other columns of docs are passed over.
    """
    spark = docs.sparkSession
    more = [F.col(c).cast("long").alias(f"x{i}") for i, c in enumerate(extra)]
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, n long, sig binary, parity binary, part int, cells binary" + "".join(f", x{i} long" for i in range(len(extra)))
    features = cut(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), *more).mapInArrow(_features(width, len(extra)), schema))
    rows = features.filter("part is null").drop("part", "cells")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast(_gathered(features.filter("part is not null").select("part", "cells"), "sum", CELLS))
    buckets = max(shuffle_width(spark), total // (4 * ENTRIES) + 1)

    postings = texts.mapInArrow(_prefixes(shared, percent, width, buckets), _POSTING).repartition(buckets, "bucket")
    found = postings.mapInArrow(_match, "a long, b long, sure boolean")
    edges = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").groupBy("a", "b").agg(F.max("sure").alias("sure")))

    to_node = "cast(conv(concat(" + ",".join(f"substring(hex(sig), {2 * i + 1}, 2)" for i in reversed(range(8))) + "), 16, -10) as bigint)"
    known = rows.filter("n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    sets = cut(known.withColumn("node", F.expr(to_node)))
    ends = sets.select(F.col("node").alias("a"), "n", F.col("parity").alias("odd")), sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parity").alias("other"))
    pairs = edges.filter("not sure").select("a", "b").join(ends[0], "a").join(ends[1], "b")
    stay = pairs.select("a", "b", "n", "odd", "m", "other").mapInArrow(_near(percent), "a long, b long")
    near = connected_components(edges.filter("sure").select("a", "b").union(stay)).withColumnRenamed("component", "comp")
    candidates = cut(sets.join(near, "node").select("sig", "id", "n", "comp", "node"))
    marks = spark.sparkContext.broadcast(bitmap(candidates))
    units = _units(candidates, percent)
    sets_again = texts.mapInArrow(_sets(marks, width), "id long, sig binary, grams binary").withColumnRenamed("id", "__id")
    wanted = sets_again.join(units, "sig").filter(F.col("__id").eqNullSafe(F.col("id")))
    grams = wanted.select(F.explode("units").alias("u"), "sig", "grams").select("u.unit", "u.side", "u.many", "sig", "grams")
    links = cut(
        grams.repartition(buckets, "unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_join_units(percent), "many boolean, a binary, b binary")
    )
    heads = links.filter("not many").select(F.col("a").alias("sig"), F.col("b").alias("head"))
    across = links.filter("many").select("a", "b")
    if not across.isEmpty():
        heads = heads.union(connected_components(across).toDF("sig", "head"))

    own = sets.join(heads, "sig", "left").select("sig", "id", F.coalesce("head", "sig").alias("head"))
    least = own.groupBy("head").agg(F.min("id").alias("component_id"))
    classes = own.join(least, "head").select("sig", "component_id")
    return rows.join(classes, "sig", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        *[F.col(f"x{i}").alias(c) for i, c in enumerate(extra)],
    )


def shingle_components_sql(relation: str, percent: int = PERCENT, width: int = SHINGLE) -> str:
    """DuckDB SQL over a unique doc_id: overlaps by an inverted index, then reachability by recursion."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM {relation}),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END AS s
  FROM tokens),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM grams),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM grams UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM grams"""
