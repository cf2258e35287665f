"""Best-fit packing of token pieces into sequences by hierarchical residual packing.

Every partition encodes its documents, cuts those longer than a sequence and packs the pieces best-fit in decreasing
order. Bins that are nearly full are final. Underfull bins go on as items of their own to a round of fewer partitions
(a merge tree), where best-fit puts whole bins together, until one partition has held all that are left or a round
brings nothing more. Only (bin, load) rows move between rounds; texts and ids never do.

Defined cases: a null or empty text is a piece of one end token; repeated rows are packed each for itself; an empty
table gives an empty result; columns other than the key are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from coursemill.llm.bpe_codec import encoder
from coursemill.llm.common import kind, small_batches, staged
from coursemill.llm.spans import row_chunks, text_buffer

CAPACITY = 1024
#: Items that one best-fit call holds.
HELD = 200_000
#: A bin with at most this much room is nearly full and leaves the tree.
SLACK = 8
#: A round that merges less than this share of the bins away is the last.
LEAST_GAIN = 0.02


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each item, and the load of each bin."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, loads = 0, []  # bit r of open_rooms: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = open_rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        where[i], offset[i] = b, loads[b]
        loads[b] += size
        if (left := room - size) > 0:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return where, offset, np.array(loads, dtype=np.int64)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and `end_id`. One longer than `capacity` is cut into pieces of `capacity` of which the first
    may be shorter, so that only one piece of a document leaves room beside it.
    """
    small_batches(docs.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, made, held, n = encoder(tokenizer), 0, [], 0
        task = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal made, held, n
            cols = [np.concatenate([h[k] for h in held]) for k in range(1, 5)]
            keys = pa.concat_arrays([h[0] for h in held])
            where, offset, load = best_fit(cols[2], capacity)
            bins = (task << 32) + made + where
            made, held, n = made + len(load), [], 0
            return pa.RecordBatch.from_arrays([keys, *map(pa.array, (*cols, bins, offset, load[where]))], names)

        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for a, b in row_chunks(off, 3_000_000):
                ids, upto = enc.texts(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                data = ids.astype("<u4").tobytes()
                total = np.diff(upto) + 1
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (total - (pieces - 1) * capacity)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                ends = start + length == total[row]
                begin = upto[row] + start
                crc = np.fromiter((zlib.crc32(end, c) if e else c for e, c in ((e, zlib.crc32(data[4 * i : 4 * (i + k - e)])) for i, k, e in zip(begin.tolist(), length.tolist(), ends.tolist(), strict=True))), dtype=np.int64, count=len(row))
                held.append((batch.column(0).slice(a, b - a).take(pa.array(row)), piece, start, length, crc))
                n += len(row)
                if n >= HELD:
                    yield flush()
        if n:
            yield flush()

    names = [id_col, "piece", "start", "length", "ids_crc32", "bin", "in_bin", "load"]
    schema = f"`{id_col}` {kind(docs, id_col)}, piece long, start long, length long, ids_crc32 long, bin long, in_bin long, load long"
    pieces = staged(docs.select(id_col, text_col).mapInArrow(local, schema), "pieces")
    placed = pieces.select(id_col, F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("in_bin").alias("offset"))
    # a bin's first piece stands for the bin
    bins = pieces.filter("in_bin = 0").select("bin", "load")
    for k, moved in enumerate(merge_rounds(bins, capacity)):
        m = moved.select(F.col("bin").alias(f"__bin{k}"), F.col("parent").alias(f"__parent{k}"), F.col("at").alias(f"__at{k}"))
        placed = placed.join(m, F.col("sequence_id") == F.col(f"__bin{k}"), "left").select(
            *(c for c in placed.columns if c not in ("sequence_id", "offset")),
            F.coalesce(f"__parent{k}", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce(f"__at{k}", F.lit(0))).alias("offset"),
        )
    return placed


def merge_rounds(bins: DataFrame, capacity: int) -> list[DataFrame]:
    """Rounds of best-fit over underfull bins (bin, load): for each round a table of bin, parent, at (its place there)."""
    rounds: list[DataFrame] = []
    under = bins.filter(F.col("load") < capacity - SLACK)
    n = under.count()
    while n > 1:
        parts, level = -(-n // HELD), len(rounds) + 1

        def merge(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            made, task = 0, TaskContext.get().partitionId()
            for pdf in _held(batches):
                where, at, load = best_fit(pdf["load"].to_numpy(), capacity)
                yield pd.DataFrame({"bin": pdf["bin"], "parent": (level << 56) + (task << 32) + made + where, "at": at, "load": load[where]})
                made += len(load)

        moved = staged(under.repartition(parts).mapInPandas(merge, "bin long, parent long, at long, load long"), f"bins{level}")
        rounds.append(moved)
        under = moved.filter(f"at = 0 and load < {capacity - SLACK}").select(F.col("parent").alias("bin"), "load")
        left = under.count()
        if parts == 1 or left > (1 - LEAST_GAIN) * n:
            break
        n = left
    return rounds


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together up to 2 * HELD rows."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= 2 * HELD:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)
