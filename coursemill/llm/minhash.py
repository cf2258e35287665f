"""MinHash near-duplicates: universal hash minima, banding, signature checks, exact checks, components.

1. Every document's shingle set is hashed to a key of the set and a sketch of HASHES minima. Documents with equal sets
   become one class (its smallest id stands for it), so copies cost one row from here on.
2. Classes meet in a bucket for each band of the sketch. A bucket of up to SMALL classes compares all of them. In a larger
   one all are first compared with its smallest class and with its middle one, the class that shares most bands with
   others. A large bucket that then holds more than one component is open: all its pairs that are not in one component
   yet are compared, in tasks of two blocks of about BLOCK classes each. The largest component of a bucket meets only
   the blocks of the others, a pair is compared only in the first band that it shares, and a task returns classes and
   a spanning set of links instead of pairs.
3. Pairs whose sketches agree far too little go. The rest are confirmed on full shingle sets, which are made anew from
   the texts of just the classes in question.
4. Confirmed links give components.

Defined cases: null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle is
one shingle; repeated rows are copies; rows of one id but different texts count as one node; a row with a null id
takes no part and has a null component; an empty table gives an empty result. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from coursemill.llm.common import binary_column, filter_bits, kind, packed, small_batches, spread_join, staged
from coursemill.llm.components import components
from coursemill.llm.spans import LOWER, mix, row_chunks, shingle_hashes, span_hashes, text_buffer, word_spans

#: Words of a shingle where near copies differ by single words all over, as the corpus pipeline has them.
PAIR_WORDS = 2
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8**5) ** 30 = 7e-6.
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
#: Share of equal minima below which a pair is dropped; at similarity 0.8 that is 4.3 standard deviations off.
LEAST_EQUAL = 0.66
#: A bucket of at most so many classes compares all of them.
SMALL = 16
#: Classes in a block of an open bucket.
BLOCK = 512
#: Bits of the filter that picks the texts to read again; fuller filters only let more texts pass.
FILTER_BITS = 1 << 23
_RNG = np.random.default_rng(811)
_A = _RNG.integers(1, 2**31, size=(HASHES, 1), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, size=(HASHES, 1), dtype=np.int64).astype(np.uint32)
_STEP = 512


def sketch(shingles: np.ndarray) -> bytes:
    """The low halves of scrambled minima of HASHES universal hashes over a set of 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), _STEP):
        np.minimum(least, (x[i : i + _STEP] * _A + _B).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of k-word shingle hashes of each row."""
    raw, off = text_buffer(column)
    for a, b in row_chunks(off, 1_000_000):
        part, own = LOWER[raw[off[a] : off[b]]], off[a : b + 1] - off[a]
        starts, lengths, upto = word_spans(part, own)
        words = span_hashes(part, starts, lengths)[0]
        for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            yield np.unique(shingle_hashes(words[i:j], k))


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, h1 and h2 (128 bits for the set), sketch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, s = [], [], [], []
            for x in shingle_sets(batch.column(1), k):
                n.append(len(x))
                m = mix(x)
                h1.append(int(np.add.reduce(m).view(np.int64)) if len(x) else 0)
                h2.append(int(np.bitwise_xor.reduce(mix(m ^ np.uint64(77))).view(np.int64)) if len(x) else 0)
                s.append(sketch(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(s, pa.binary())], ["id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind(docs, id_col)}, n_shingles long, h1 long, h2 long, sketch binary")


def _alike(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of which enough minima are equal; takes a, b, sa, sb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, HASHES) for c in (2, 3))
            good = pa.array((x == y).mean(axis=1) >= LEAST_EQUAL)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind(pairs, 'a')}, b {kind(pairs, 'b')}")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles array<long>) of the documents whose id is in `ids`, and of a few more.

    A bit filter of fixed size goes to the tasks that read the texts, so that other texts are not shuffled.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    sent = spark.sparkContext.broadcast(packed(filter_bits(ids, bit), FILTER_BITS).tobytes())
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, dtype=np.uint64)
        for batch in batches:
            at = np.asarray(batch.column(1)).astype(np.int64)
            batch = batch.filter(pa.array((held[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1))
            held_rows, size, first = [], 0, 0
            for i, x in enumerate(shingle_sets(batch.column(2), k)):
                held_rows.append(x)
                size += len(x)
                if size > 500_000 or i + 1 == batch.num_rows:
                    off = np.r_[0, np.cumsum([len(r) for r in held_rows])].astype(np.int32)
                    sets = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(held_rows).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held_rows)), sets], ["id", "shingles"])
                    held_rows, size, first = [], 0, i + 1

    return docs.select("id", bit.alias("bit"), "text").mapInArrow(run, f"id {kind(docs, 'id')}, shingles array<bigint>")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the key, n_shingles, component_id (the smallest id reachable by links) and kept.

    Documents link when 100 * shared shingles >= threshold * all shingles of the two. LEAST_EQUAL and the bands are set
    for a threshold of 80 or more.
    """
    docs = docs.select(id_col, text_col)
    rows = staged(signatures(docs, k, id_col, text_col), "signatures")
    classes = staged(rows.filter("n_shingles > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    links = _links(docs, classes, k, threshold, id_col, text_col)
    roots = components(links)
    found = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    # empty texts and null ids stay out of the join
    full = F.expr("n_shingles > 0 and id is not null")
    rows = rows.select("id", "n_shingles", "h1", "h2")
    linked = rows.filter(full).join(found, ["h1", "h2"]).select("id", "n_shingles", F.col("root").alias("own"))
    linked = linked.union(rows.filter(~full).select("id", "n_shingles", F.col("id")))
    return linked.select(F.col("id").alias(id_col), "n_shingles", F.col("own").alias("component_id"), F.coalesce(F.col("id") == F.col("own"), F.lit(True)).alias("kept"))


def unnamed_firsts(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with a null id whose set of shingles no row with an id has, one of each set; those without a word all stay."""
    unnamed = docs.filter(F.col(id_col).isNull())
    if unnamed.isEmpty():
        return unnamed
    rows = staged(unnamed.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("n")), "unnamed")
    signed = staged(signatures(rows, k, "n", "text"), "signatures")
    seen = signatures(docs.filter(F.col(id_col).isNotNull()), k, id_col, text_col).filter("n_shingles > 0").select("h1", "h2").distinct()
    first = signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("n")).join(seen, ["h1", "h2"], "left_anti").select("n")
    return rows.join(first.union(signed.filter("n_shingles = 0").select("id")), "n").select("row.*")


def _band_key(band: F.Column) -> F.Column:
    return F.xxhash64(band, F.expr(f"substring(sketch, cast(band as int) * {2 * ROWS} + 1, {2 * ROWS})"))


def _links(docs: DataFrame, classes: DataFrame, k: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) between representatives of classes."""
    reps = classes.select("rep", "n", "sketch")
    members = reps.select("rep", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("rep", "band", _band_key(F.col("band")).alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("first")).filter("size > 1")
    seated = staged(members.join(buckets, "key"), "buckets")
    small, large = seated.filter(f"size <= {SMALL}").select("key", "rep"), seated.filter(f"size > {SMALL}").select("key", "band", "rep", "size", "first")
    # a class that shares many bands with many others lies in the middle of its group: the best one to compare with
    shared = large.select("key", "rep", F.sum("size").over(W.partitionBy("rep")).alias("shared"))
    middle = shared.groupBy("key").agg(F.max(F.struct("shared", "rep")).alias("m")).select("key", F.col("m.rep").alias("middle"))
    spokes = large.join(middle, "key")
    pairs = small.select("key", F.col("rep").alias("a")).join(small.select("key", F.col("rep").alias("b")), "key").filter("a < b").select("a", "b")
    for center in ("first", "middle"):
        pairs = pairs.union(spokes.filter(f"rep != {center}").select(F.least(center, "rep").alias("a"), F.greatest(center, "rep").alias("b")))
    links = staged(_confirmed(docs, reps, pairs.distinct(), k, threshold, id_col, text_col), "links")
    return links.union(_settled(docs, reps, large.select("key", "band", "rep"), links, k, threshold, id_col, text_col))


def _settled(docs: DataFrame, reps: DataFrame, large: DataFrame, links: DataFrame, k: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) across the components that `links` leave in large buckets (key, band, rep)."""
    seats = large.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    parts = seats.groupBy("key", "root").agg(F.count("*").alias("size"))
    opened = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("main")).filter("parts > 1")
    # blocks 0 to m - 1 hold the largest component, blocks m to m + r - 1 the others
    blocks = opened.select("key", F.col("main.root").alias("main"), F.ceil(F.col("main.size") / BLOCK).alias("m"), F.ceil((F.col("size") - F.col("main.size")) / BLOCK).alias("r"))
    seats = seats.join(blocks, "key").withColumn("own", F.expr("if(root = main, pmod(xxhash64(rep, key), m), m + pmod(xxhash64(rep, key), r))"))
    seats = seats.join(reps, "rep").withColumn("other", F.explode(F.expr("sequence(if(root = main, m, 0L), m + r - 1)")))
    seats = seats.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "band", "rep", "root", "n", "sketch")
    near = staged(seats.groupBy("key", "lo", "hi").applyInArrow(_members(threshold), ", ".join(f"{c} {kind(seats, c)}" for c in seats.columns)), "open")
    ids = near.select(F.col("rep").alias("id")).distinct()
    sets = staged(_sets_of(docs, ids, k, id_col, text_col).join(ids, "id", "left_semi"), "sets")
    both = near.join(sets.withColumnRenamed("id", "rep"), "rep")
    return staged(both.groupBy("key", "lo", "hi").applyInArrow(_spanning(threshold), f"a {kind(reps, 'rep')}, b {kind(reps, 'rep')}"), "settled")


def _likely(table: pa.Table, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers i and, of those that come with it, the others of which enough minima are equal.

    Each pair of different roots comes once, in the first band that it shares. In a table of two blocks only pairs
    across these come.
    """
    n, own, band = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "own", "band"))
    root = np.unique(np.asarray(table.column("root")), return_inverse=True)[1].astype(np.int64)
    x = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype="<u2").reshape(-1, HASHES)
    bands = x.reshape(len(x), BANDS, ROWS)
    two = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
    rank = np.bincount(root)[root] * (len(x) + 1) + root  # a large component comes last and is compared with few
    for i in (np.flatnonzero(own == own.min()) if two else np.arange(len(x))).tolist():
        at = np.flatnonzero((own != own[i]) & (root != root[i]) if two else rank > rank[i])
        at = at[100 * np.minimum(n[i], n[at]) >= threshold * np.maximum(n[i], n[at])]
        at = at[(x[at] == x[i]).mean(axis=1) >= LEAST_EQUAL]
        at = at[(bands[at] == bands[i]).all(axis=2).argmax(axis=1) == band[i]]
        if len(at):
            yield i, at


def _members(threshold: int):
    """The rows of a pair of blocks that have a likely partner."""

    def run(table: pa.Table) -> pa.Table:
        good = np.zeros(table.num_rows, dtype=bool)
        for i, at in _likely(table, threshold):
            good[i] = good[at] = True
        return table.filter(pa.array(good))

    return run


def _spanning(threshold: int):
    """Links of a pair of blocks that hold on full sets; pairs that others have joined already are left out."""

    def run(table: pa.Table) -> pa.Table:
        sets = table.column("shingles").combine_chunks()
        off = np.r_[0, np.cumsum(np.asarray(sets.value_lengths()).astype(np.int64))]
        number = np.unique(np.asarray(sets.flatten()), return_inverse=True)[1]
        held = np.zeros(number.max() + 1, dtype=bool)
        # two rows of one id but different texts are one node
        node = np.unique(np.asarray(table.column("root")), return_inverse=True)[1].astype(np.int64)
        found: list[tuple[int, int]] = []
        for i, at in _likely(table, threshold):
            mine = number[off[i] : off[i + 1]]
            held[mine] = True
            for j in at.tolist():
                if node[i] != node[j]:
                    shared = int(held[number[off[j] : off[j + 1]]].sum())
                    if 100 * shared >= threshold * (len(mine) + off[j + 1] - off[j] - shared):
                        found.append((i, j))
                        node[node == node[j]] = node[i]
            held[mine] = False
        a, b = (pa.array([f[t] for f in found], pa.int64()) for t in (0, 1))
        return pa.table({"a": table.column("rep").take(a), "b": table.column("rep").take(b)})

    return run


def _confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that hold on their signatures and then on their full sets."""
    sketches = reps.select("rep", "n", "sketch")
    one, two = (sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    # the smaller set must be large enough for the threshold at all
    sized = pairs.join(one, "a").join(two, "b").filter(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)")
    likely = staged(_alike(sized).distinct(), "likely")
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    sets = staged(_sets_of(docs, ids, k, id_col, text_col).join(ids, "id", "left_semi"), "sets")
    # whole sets meet both ends of the pairs; a class in very many pairs is dealt over tasks
    one, two = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = spread_join(spread_join(likely, two, ["b"], "a"), one, ["a"], "b", likely)
    shared = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return shared.filter(f"100 * shared >= {threshold} * (na + nb - shared)").select("a", "b").distinct()
