"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

N-grams are taken over words (one and two), over the last two bytes of words, and over the shapes of words (one to
three), where a shape tells letters, case, digits and marks and whether a word repeats the one before. A document is
the set of its n-grams. Each indicator is scaled by the log ratio of its smoothed class counts, rows are scaled to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent. Platt's curve, fitted to rows that the
model has not seen, turns margins into scores.

The fit uses at most SAMPLE labelled rows, picked by a hash of their ids; scoring reads every whole text.

Defined cases: a null or empty text has no n-gram and scores as the offset alone; one class or no labels at all give
every text the smoothed share of label 1; a null id is never held out; repeated rows score alike; an empty table gives
an empty result. Only key, held_out, score and predicted are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coursemill.llm.common import binary_column, kind, small_batches
from coursemill.llm.spans import LOWER, mix, ragged, row_chunks, span_hashes, text_buffer, word_spans
from coursemill.llm.training import fold, labelled_sample, platt

BITS = 18
#: Labelled rows used to fit, at most.
SAMPLE = 8_000
THRESHOLD = 0.3
COST, EPOCHS, SMOOTH = 1.0, 12, 1.0

#: Byte kinds: 1 lower, 2 upper, 3 digit, 4 beyond ASCII, others by mark.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
for _k, _marks in enumerate((".,;:", "!?", "'\"()-", "#*$%&", "|<>[]{}/\\")):
    _KIND[[ord(c) for c in _marks]] = 5 + _k


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of all rows, row by row, and the n + 1 offsets of the rows in them."""
    starts, lengths, upto = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    words = span_hashes(LOWER[raw], starts, lengths)[0]
    row = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    ends = starts + lengths - 1
    tail = raw[ends].astype(np.uint64) << np.uint64(8) | raw[np.maximum(ends - 1, starts)]
    # which kinds of bytes a word holds, as bits
    inside = np.bitwise_or.reduceat(np.uint32(1) << _KIND[raw].astype(np.uint32), np.stack([starts, np.minimum(ends + 1, len(raw) - 1)], axis=1).ravel())[::2]
    inside = np.where(ends + 1 >= len(raw), inside | (np.uint32(1) << _KIND[raw[ends]].astype(np.uint32)), inside)
    same = np.r_[False, (words[1:] == words[:-1]) & (row[1:] == row[:-1])]
    shape = inside.astype(np.uint64) | same.astype(np.uint64) << np.uint64(20) | _KIND[raw[ends]].astype(np.uint64) << np.uint64(12)
    own = [mix(words ^ np.uint64(11)), mix(tail + np.uint64(2 << 32)), mix(shape + np.uint64(3 << 32))]
    rows = [row, row, row]
    for gram, base, times in ((words, 4, 2), (shape, 5, 2), (shape, 6, 3)):
        n = len(gram) - times + 1
        if n <= 0:
            continue
        h = np.full(n, np.uint64(base), dtype=np.uint64)
        for j in range(times):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + gram[j : n + j])
        ok = row[:n] == row[times - 1 :]
        own.append(h[ok])
        rows.append(row[:n][ok])
    key = np.concatenate(rows) << BITS | (np.concatenate(own) >> np.uint64(64 - BITS)).astype(np.int64)
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(offsets), dtype=np.int64) << BITS)


def fit(flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, part: np.ndarray, seed: int = 5) -> dict:
    """The model from rows of features: weight by feature, bias, and Platt's slope and offset."""
    model = {"weight": np.zeros(1 << BITS), "bias": 0.0, "slope": 0.0, "offset": float(np.log((y.sum() + 1) / ((y == 0).sum() + 1)))}
    learn = part < 80
    if len({*y[learn].tolist()}) < 2 or len({*y[~learn].tolist()}) < 2:
        return model
    rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(offsets))
    counts = [np.bincount(flat[(y[rows] == c) & learn[rows]], minlength=1 << BITS) + SMOOTH for c in (1, 0)]
    ratio = np.log(counts[0] / (learn & (y == 1)).sum()) - np.log(counts[1] / (learn & (y == 0)).sum())
    held = (counts[0] + counts[1]) > 2 * SMOOTH + 1  # seen in at least two rows
    ratio = np.where(held, ratio, 0.0)
    value = ratio[flat]
    norm = np.sqrt(np.bincount(rows, value * value, minlength=len(y)))
    value = value / np.maximum(norm, 1e-12)[rows]
    w, bias = np.zeros(1 << BITS), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(learn)).tolist():
            a, b = offsets[i], offsets[i + 1]
            f, v = flat[a:b], value[a:b]
            gradient = sign[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), COST)  # unit rows and a bias of one: the diagonal is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    margin = np.bincount(rows, w[flat] * value, minlength=len(y)) + bias
    model["slope"], model["offset"] = platt(margin[~learn], y[~learn])
    return model | {"weight": w * ratio, "ratio": ratio, "bias": bias}


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model fitted on the driver to at most SAMPLE labelled rows."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, learn, SAMPLE, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            for a, b in row_chunks(off, 1_000_000):
                flat, upto = features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a).cast(pa.int32()), batch.column(2).slice(a, b - a), binary_column(flat.astype("<i4").tobytes(), upto * 4)], ["y", "part", "features"])

    got = sample.mapInArrow(run, "y int, part int, features binary").toArrow()
    y, part = np.asarray(got["y"]).astype(np.int64), np.asarray(got["part"]).astype(np.int64)
    lists = got["features"].to_pylist()
    flat = np.frombuffer(b"".join(lists), dtype="<i4")
    # in a fixed order, so that the fit does not depend on how rows arrived
    offsets = np.r_[0, np.cumsum([len(x) // 4 for x in lists])].astype(np.int64)
    order = np.array(sorted(range(len(y)), key=lambda i: (part[i], lists[i], y[i])), dtype=np.int64)
    sizes = np.diff(offsets)[order]
    del got, lists
    return fit(flat[ragged(offsets[:-1][order], sizes)], np.r_[0, np.cumsum(sizes)], y[order], part[order])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The key and any columns to keep, with `score` for every whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers
    rest = [id_col] if keep is None else keep
    columns = [*rest, *([] if text_col in rest else [text_col])]
    at = columns.index(text_col)
    types = ", ".join(f"`{c}` {kind(docs, c)}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        square = m.get("ratio", m["weight"]) ** 2
        for batch in batches:
            raw, off = text_buffer(batch.column(at))
            out = []
            for a, b in row_chunks(off, 1_000_000):
                flat, upto = features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                rows = np.repeat(np.arange(b - a), np.diff(upto))
                norm = np.sqrt(np.bincount(rows, square[flat], minlength=b - a))
                margin = np.bincount(rows, m["weight"][flat], minlength=b - a) / np.maximum(norm, 1e-12) + m["bias"]
                out.append(1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(np.concatenate(out) if out else np.zeros(0))], [*rest, "score"])

    return docs.select(*columns).mapInArrow(run, f"{types}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the key, held_out, score and predicted; learns from rows that are not held out."""
    model = train(docs, labels, fold("id", 5) != 0, id_col=id_col, text_col=text_col)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, F.coalesce(fold(id_col, 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
