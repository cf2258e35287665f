"""Embedding near-duplicates by sorted projection passes.

Equal vectors of one label become one class first. In each pass every class gets a key, the concatenated signs of its
products with random directions of that pass; classes are sorted by label, key and id, and every class is compared
with the next WINDOW ones in that order, across partition borders too. Pairs at or above the threshold (in double
precision, over the vectors as they are) tie classes together; a task returns a tree over the classes that its pairs
tie, not the pairs. The ties of all passes give components.

Links are then counted within each component, all of it: its classes are dealt to blocks of BLOCK, and each pair of
blocks is one task that multiplies them and returns a number per class, so no pair leaves a task and none inside a
component is missed, however dense it is. The work for a component still grows with the square of its size.

Vectors below the threshold are never linked. A pair at a cosine of 0.98 stays next to each other in a pass with a
fair chance only, so the passes are many; recall against brute force is tested.

Defined cases: vectors that are null, empty or zero, or that hold null or non-finite components, and rows with a null
label or id link with nothing; vectors of different lengths do not link; repeated rows are copies; rows
of one id with different vectors are one node of the components, each with the links of its own vector; an empty table gives an empty result; very large and very small components are
scaled before they are squared. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from coursemill.llm.common import binary_column, kind, spread_join, staged
from coursemill.llm.components import components

PASSES, WINDOW = 24, 128
#: Passes that are sorted together: so many times the vectors' size is on disk at once.
TOGETHER = 6
#: Border rows of partitions, in sorted order, that are compared in one task.
BORDERS = 8192
#: Classes of a block when the links of a component are counted.
BLOCK = 4096


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Per row: id, label, and for sound vectors their double values (`v`) and a key of them (h1, h2)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    sound = F.expr("id is not null and label is not null and coalesce(size(v), 0) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x != 0)")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("v", F.when(sound, F.col("v")))
    return rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(17), "label")))


def links_of_pass(rows: DataFrame, threshold: float, window: int) -> DataFrame:
    """One table with ties (a, b) of the links found inside partitions of rows (pass, label, dims, key, rep, v) in sorted order,
    and with each partition's first and last rows as borders (pid, idx, and their columns)."""
    names = rows.columns
    types = ", ".join(f"`{c}` {kind(rows, c)}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, idx, tail, head = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, pid)), pa.array(np.arange(idx, idx + batch.num_rows)), *batch.columns], ["pid", "idx", *names])
            idx += batch.num_rows
            if head < window:  # the first rows
                first = batch.slice(0, window - head)
                head += first.num_rows
                yield _out(None, None, first)
            both = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            a, b = _compare(both, 0 if tail is None else tail.num_rows, threshold, window)
            a, b = _tree(a, b, both.num_rows)
            if len(a):
                yield _out(both.column("rep").take(pa.array(a)), both.column("rep").take(pa.array(b)), None)
            tail = both.slice(max(0, both.num_rows - window))
        if tail is not None:  # the last rows, but for those that went out as the first
            at = np.asarray(tail.column("idx"))
            last = tail.filter(pa.array(at >= window))
            if last.num_rows:
                yield _out(None, None, last)

    def _out(a, b, rest) -> pa.RecordBatch:
        n = len(a) if rest is None else rest.num_rows
        nulls = lambda t: pa.nulls(n, t)
        schema = [("pid", pa.int64()), ("idx", pa.int64()), *((f.name, f.type) for f in arrow)]
        rep = dict(schema)["rep"]
        ends = [nulls(rep) if a is None else a, nulls(rep) if b is None else b]
        return pa.RecordBatch.from_arrays([*ends, *(nulls(t) if rest is None else rest.column(c) for c, t in schema)], ["a", "b", *(c for c, _ in schema)])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(rows.schema))
    rep = kind(rows, "rep")
    return rows.mapInArrow(run, f"a {rep}, b {rep}, pid long, idx long, {types}")


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length from their bytes, scaled to unit length."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tree(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (i, j) of n rows: each row that another one is tied to, with the least row of its component."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    while (root != root[root]).any():
        root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _compare(batch: pa.RecordBatch, old: int, threshold: float, window: int, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs at most `window` apart; pairs among the first `old` rows are known already."""
    n = batch.num_rows
    dims = np.asarray(batch.column("dims"))
    group = np.cumsum(np.r_[True, np.asarray(_changes(batch))]) if n else np.zeros(0)
    pid = np.asarray(batch.column("pid"))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        x = _units(batch.column("v").take(pa.array(rows)), int(d))
        for t in range(1, min(window, len(rows) - 1) + 1):
            i, j = rows[:-t], rows[t:]
            ask = (group[i] == group[j]) & (j >= old) & (j - i <= window)
            if apart:
                ask &= pid[i] != pid[j]
            p = np.flatnonzero(ask)
            good = np.einsum("ij,ij->i", x[p], x[p + t]) >= threshold
            found.append((i[p[good]], j[p[good]]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """For each row but the first whether its (pass, label, dims) differs from the row before."""
    out = np.zeros(batch.num_rows - 1, dtype=bool)
    for c in ("pass", "label", "dims"):
        codes = np.asarray(batch.column(c).dictionary_encode().indices)
        out |= codes[1:] != codes[:-1]
    return out


def _keys(classes: DataFrame, passes: range, seed: int) -> DataFrame:
    """Each class once for every pass, with its key in that pass and its values as bytes."""
    rest = ["label", "rep"]
    types = ", ".join(f"`{c}` {kind(classes, c)}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = np.asarray(lists.flatten())
            off = np.r_[0, np.cumsum(size)]
            data = binary_column(flat.astype("<f8").tobytes(), off * 8)
            for p in passes:
                key = np.zeros(batch.num_rows, dtype=np.uint64)
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    directions = np.random.default_rng([seed, p, int(d)]).standard_normal((int(d), 63))
                    x = flat[(off[at, None] + np.arange(int(d)))].reshape(len(at), int(d))
                    key[at] = ((x @ directions) >= 0).astype(np.uint64) @ (np.uint64(1) << np.arange(62, -1, -1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, p)), batch.column(0), pa.array(size), pa.array(key.astype(np.int64)), batch.column(1), data], ["pass", "label", "dims", "key", "rep", "v"])

    return classes.select(*rest, "v").mapInArrow(run, f"pass long, label {kind(classes, 'label')}, dims long, key long, rep {kind(classes, 'rep')}, v binary")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, passes: int = PASSES, window: int = WINDOW, seed: int = 9,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per vector: the key, n_links (other vectors linked directly), component_id (the smallest id reachable by
    links) and kept. Copies are linked with each other and with all that their vector is linked with."""
    rows = staged(_classes(vectors, id_col, vector_col, label_col), "vectors")
    sound = rows.filter("v is not null")
    classes = staged(sound.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")
    found = None
    for start in range(0, passes, TOGETHER):
        keyed = _keys(classes, range(start, min(passes, start + TOGETHER)), seed)
        order = ["pass", "label", "dims", "key", "rep"]
        ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        step = staged(links_of_pass(ordered, threshold, window), "passes")
        inner = step.filter("a is not null").select("a", "b")
        border = step.filter("a is null").drop("a", "b")
        # border rows in sorted order, BORDERS in a task and with them the window that follows
        sizes = border.groupBy("pid").agg((F.max("idx") + 1).alias("size"))  # one row a partition
        before = sizes.select("pid", (F.sum("size").over(W.orderBy("pid")) - F.col("size")).alias("before"))
        border = border.join(F.broadcast(before), "pid").withColumn("rank", F.col("before") + F.col("idx")).drop("before")
        group = F.floor(F.col("rank") / BORDERS)
        border = border.withColumn("group", F.explode(F.when(F.pmod("rank", F.lit(BORDERS)) < window, F.array(group, group - 1)).otherwise(F.array(group))))
        outer = border.groupBy("group").applyInArrow(_across(threshold, window), f"a {kind(classes, 'rep')}, b {kind(classes, 'rep')}")
        links = inner.union(outer).filter("a != b").distinct()
        found = links if found is None else found.union(links)
    roots = staged(components(found), "roots")
    near = _counts(classes, roots, threshold)
    facts = classes.select("h1", "h2", "rep", "copies").join(near, ["h1", "h2"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("h1", "h2", F.coalesce("near", F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    rows = rows.select("id", "h1", "h2")
    out = spread_join(rows.filter("h1 is not null"), facts, ["h1", "h2"], "id").select("id", "n_links", "root")
    out = out.union(rows.filter("h1 is null").select("id", F.lit(0).cast("long"), F.col("id")))
    own = F.col("root").cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def _counts(classes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(h1, h2, near): the number of other vectors that a vector with ties links with, its own copies included."""
    vectors = classes.select("h1", "h2", "rep", "copies", "v").join(roots.withColumnRenamed("node", "rep"), "rep")
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    vectors = spread_join(vectors, sizes, ["root"], "rep", roots)
    vectors = vectors.withColumn("own", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    vectors = vectors.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "h1", "h2", "copies", "v")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, copies = (table.column(c).to_numpy().astype(np.int64) for c in ("own", "copies"))
        lists = table.column("v").combine_chunks()
        dims, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
        off = np.r_[0, np.cumsum(dims)]
        near = np.zeros(len(own), dtype=np.int64)
        two = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        for d in np.unique(dims):  # one id may hold vectors of several lengths
            at = np.flatnonzero(dims == d)
            x = flat[off[at, None] + np.arange(int(d))]
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            first = at[own[at] == own.min()] if two else at
            second = at[own[at] != own.min()] if two else at
            where = np.zeros(len(own), dtype=np.int64)
            where[at] = np.arange(len(at))
            y = x[where[second]]
            for k in range(0, len(first), 512):
                part = first[k : k + 512]
                dots = x[where[part]] @ y.T
                close = np.argwhere(np.abs(dots - threshold) < 1e-9)  # on the edge: summed as in the passes
                dots[close[:, 0], close[:, 1]] = np.einsum("ij,ij->i", x[where[part[close[:, 0]]]], y[close[:, 1]])
                linked = dots >= threshold
                near[part] += linked @ copies[second]
                if two:
                    near[second] += copies[part] @ linked
        if not two:
            near -= 1  # a vector is no link of its own
        return pa.table({"h1": table.column("h1"), "h2": table.column("h2"), "near": pa.array(near)})

    each = vectors.groupBy("root", "lo", "hi").applyInArrow(run, "h1 long, h2 long, near long")
    return each.groupBy("h1", "h2").agg(F.sum("near").alias("near"))


def _across(threshold: float, window: int):
    """Ties of the links between border rows of different partitions."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pid", "ascending"), ("idx", "ascending")]).combine_chunks()
        if not table.num_rows:
            return pa.table({"a": table["rep"], "b": table["rep"]})
        batch = table.to_batches()[0]
        a, b = map(pa.array, _tree(*_compare(batch, 0, threshold, window, apart=True), batch.num_rows))
        return pa.table({"a": batch.column("rep").take(a), "b": batch.column("rep").take(b)})

    return run
