"""Line dedup: overlapping windows of three lines, hashed, found again anywhere, and their later occurrences removed.

A line is a line of the text; blank lines belong to the line before them. Every window of three consecutive lines has a
128-bit hash, however short its lines are. A window is a later occurrence if an earlier place of its document or a
document with a smaller id holds it; the lines of all later occurrences, merged, leave the text. Two things are off by
default: `sentences` takes sentences (a mark of . ! ? and a space end one) inside a line as lines too, `least_words`
leaves out windows of fewer words.

Two numbers a window are shuffled to find repeated windows, of which the aggregation combines copies before the
shuffle. The texts are then read again, and just windows that may be repeated (a bit filter of fixed size) go on to the
exact join; windows that hold more than a thousandth of all occurrences are joined by broadcast. Only documents that
lose lines are shuffled with their texts.

Defined cases: null and empty texts, and texts of fewer than three lines, stay as they are (null stays null); a run of
equal lines shrinks to its first line; repeated rows of one id do not remove each other; rows with a null id come after
all others and do not remove each other; an empty table gives an empty result; extra columns stay (n_lines and
n_removed are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coursemill.llm.common import HOT_KEYS, filter_bits, kind, packed, small_batches, staged
from coursemill.llm.spans import mix, ragged, row_chunks, span_hashes, text_buffer, word_spans

#: Bits of the filters of repeated windows and of documents to change: 4 MB each that go to every executor.
FILTER_BITS = 1 << 25
#: A window with at most so many occurrences is never a hot one.
HOT_ROWS = 10_000


def lines(raw: np.ndarray, offsets: np.ndarray, sentences: bool = False) -> tuple[np.ndarray, ...]:
    """Of all lines with a word: tile start, first and last word's ends, number of words; and lines before each row."""
    starts, lengths, _ = word_spans(raw, offsets)
    border = raw[:-1] == 10
    if sentences and len(raw) > 1:
        border |= (raw[:-1] == 32) & np.r_[False, np.isin(raw[:-2], [33, 46, 63])]
    after = np.flatnonzero(border) + 1
    border = np.unique(np.r_[offsets[:-1], after])
    line = np.searchsorted(border, starts, side="right") - 1
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(starts) else np.zeros(0, np.int64)
    last = np.r_[head[1:], len(starts)] - 1
    words = last - head + 1
    if not len(starts):
        last = last[:0]
        words = words[:0]
    upto = np.searchsorted(starts[head], offsets)
    tile = border[line[head]]
    first = upto[:-1][upto[:-1] < upto[1:]]
    tile[first] = offsets[:-1][upto[:-1] < upto[1:]]  # blank lines at the start go with the first line
    return tile, starts[head], starts[last] + lengths[last], words, upto


def windows(raw: np.ndarray, offsets: np.ndarray, sentences: bool = False, least_words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: two hashes, row, place (line number in its row), and whether the row holds it earlier."""
    _, begin, end, words, upto = lines(raw, offsets, sentences)
    n = len(begin) - 2
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none.astype(bool)
    row = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    a, b = span_hashes(raw, begin, end - begin, both=True)
    good = np.flatnonzero((row[:-2] == row[2:]) & (words[:-2] + words[1:-1] + words[2:] >= least_words))
    h = []
    for x, odd in ((a, 0x9E3779B97F4A7C15), (b, 0xC2B2AE3D27D4EB4F)):
        y = mix(x[:-2] + np.uint64(1))
        for k in (1, 2):
            y = mix(y * np.uint64(odd) + x[k : n + k])
        h.append(y[good])
    own = row[good]
    order = np.lexsort((good, h[0], own))
    again = np.zeros(len(good), dtype=bool)
    again[order[1:]] = (own[order][1:] == own[order][:-1]) & (h[0][order][1:] == h[0][order][:-1]) & (h[1][order][1:] == h[1][order][:-1])
    return h[0], h[1], own, good - upto[own], again


def _occurrences(docs: DataFrame, how: tuple[bool, int], sent=None) -> DataFrame:
    """First occurrences in each row (id, k1, k2, text): h1, h2, id and, with a filter, k1, k2 and place."""
    types = f"h1 long, h2 long, id {kind(docs, 'id')}"
    if sent is not None:
        types += ", k1 long, k2 long, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, dtype=np.uint64) if sent is not None else None
        for batch in batches:
            raw, off = text_buffer(batch.column(3))
            for a, b in row_chunks(off, 1_000_000):
                h1, h2, row, place, again = windows(raw[off[a] : off[b]], off[a : b + 1] - off[a], *how)
                keep = ~again
                if held is not None:
                    bit = h1 % np.uint64(FILTER_BITS)
                    keep &= (held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                at = pa.array(row[keep] + a)
                out = [pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), batch.column(0).take(at)]
                names = ["h1", "h2", "id"]
                if held is not None:
                    out += [batch.column(1).take(at), batch.column(2).take(at), pa.array(place[keep].astype(np.int32))]
                    names += ["k1", "k2", "place"]
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.mapInArrow(run, types)


def _later(named: DataFrame, how: tuple[bool, int]) -> DataFrame:
    """Places of later occurrences: (k1, k2, __places) of each row that has any."""
    counts = _occurrences(named, how).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    repeated = staged(counts.filter("n > 1"), "windows")
    # a bit for each repeated window (unsigned remainder of h1)
    held = packed(filter_bits(repeated, F.expr(f"h1 & {FILTER_BITS - 1}L")), FILTER_BITS)
    again = _occurrences(named, how, named.sparkSession.sparkContext.broadcast(held.tobytes()))
    # at most HOT_KEYS windows hold more than this share of all occurrences: their occurrences are not shuffled to one key
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(repeated.filter(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select("h1", "h2", F.col("first").alias("first_hot"), F.lit(True).alias("hot")))
    again = again.join(hot, ["h1", "h2"], "left").withColumn("h1", F.when(F.col("hot"), F.xxhash64("k1", "place")).otherwise(F.col("h1")))
    cold = repeated.select("h1", "h2", F.col("first").alias("first_cold"), F.lit(True).alias("cold"))
    again = again.join(cold, ["h1", "h2"], "left").filter("hot or cold").withColumn("first", F.when(F.col("hot"), F.col("first_hot")).otherwise(F.col("first_cold")))
    later = again.filter("id > first or (id is null and first is not null)").groupBy("k1", "k2").agg(F.collect_set("place").alias("__places"))
    return staged(later, "later")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: bool = False, least_words: int = 0) -> DataFrame:
    """The documents with later occurrences removed from their text, and n_lines and n_removed (lines with a word)."""
    small_batches(docs.sparkSession)
    how = (sentences, least_words)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "__k1", "__k2", "__places", "__w", "__bits", "__set")]
    k1, k2 = F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.col(text_col), F.lit(7), F.col(id_col))
    later = _later(docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text")), how)
    # only documents whose bit is set go through the join with their texts; the table has FILTER_BITS / 64 rows at most
    bit = lambda c: F.col(c).bitwiseAND(FILTER_BITS - 1)
    words = F.broadcast(staged(filter_bits(later, bit("k1")), "bits").select(F.col("w").alias("__w"), F.col("bits").alias("__bits")))
    keyed = docs.select(*columns, k1.alias("__k1"), k2.alias("__k2"))
    keyed = keyed.join(words, F.shiftright(bit("__k1"), 6) == F.col("__w"), "left").withColumn("__set", F.expr("coalesce(shiftrightunsigned(__bits, cast(__k1 & 63 as int)) & 1 = 1, false)"))
    touched = keyed.filter("__set").join(later.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__places"), ["__k1", "__k2"], "left").select(*columns, "__places")
    both = touched.union(keyed.filter("not __set").select(*columns, F.lit(None).cast("array<int>")))
    at, types = columns.index(text_col), ", ".join(f"`{c}` {kind(docs, c)}" for c in columns)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(at))
            null = np.asarray(batch.column(at).is_null())
            for a, b in row_chunks(off, 1_000_000):
                part, own = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                tile, _, _, _, upto = lines(part, own, sentences)
                _, _, row, place, repeat = windows(part, own, *how)
                given = batch.column(len(columns)).slice(a, b - a)
                sizes = np.asarray(given.value_lengths().fill_null(0)).astype(np.int64)
                first = np.r_[upto[row[repeat]] + place[repeat], np.repeat(upto[:-1], sizes) + np.asarray(given.flatten()).astype(np.int64)]
                gone = np.zeros(len(tile), dtype=bool)
                for k in range(3):
                    gone[first + k] = True
                ends = np.r_[tile[1:], len(part)]
                stop = own[1:][upto[:-1] < upto[1:]]
                ends[upto[1:][upto[:-1] < upto[1:]] - 1] = stop
                keep = np.ones(len(part), dtype=bool)
                keep[ragged(tile[gone], (ends - tile)[gone])] = False
                data = part[keep].tobytes()
                cut = np.r_[0, np.cumsum(keep)][own]
                text = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.string())
                if null[a:b].any():
                    text = pa.array([None if e else t for e, t in zip(null[a:b], text.to_pylist(), strict=True)], pa.string())
                removed = np.diff(np.r_[0, np.cumsum(gone)][upto])
                out = [text if i == at else batch.column(i).slice(a, b - a) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(upto)), pa.array(removed)], [*columns, "n_lines", "n_removed"])

    return both.mapInArrow(remove, f"{types}, n_lines long, n_removed long")


ORACLE = """
WITH u AS (SELECT doc_id, text, unnest(us) AS unit, generate_subscripts(us, 1) AS i
    FROM (SELECT doc_id, text, string_split(replace(text, chr(10), chr(10) || chr(1)), chr(1)) AS us FROM documents)),
v AS (SELECT *, regexp_matches(unit, '[^\\x20\\x09-\\x0D]') AS solid, trim(unit, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM u),
p AS (SELECT *, greatest(1, sum(solid::INT) OVER (PARTITION BY doc_id ORDER BY i)) AS pos FROM v),
l AS (SELECT doc_id, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM p WHERE solid WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY a, b, c) AS first, row_number() OVER (PARTITION BY doc_id, a, b, c ORDER BY pos) AS k FROM l WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE doc_id > first OR k > 1),
t AS (SELECT p.doc_id, string_agg(unit, '' ORDER BY i) FILTER (g.pos IS NULL) AS text, count(*) FILTER (solid) AS n_lines, count(*) FILTER (solid AND g.pos IS NOT NULL) AS n_removed
    FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN t USING (doc_id)"""
