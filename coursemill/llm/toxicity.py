"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A part of the labelled sample gives a lexicon: words, and beginnings of words, that toxic texts hold far more often than
others. On a second part trees are boosted over densities of lexicon words, their closeness to words of the second
person, and rates of capitals, marks and obfuscated words. The last part calibrates the scores.

The fit uses at most SAMPLE labelled rows, picked by a hash of their ids, and at most LEXICON entries; scoring reads
every whole text.

Defined cases: a null or empty text has features of zero; no labels or one class alone give every text the smoothed
share of label 1; a null id is never held out; repeated rows score alike; an empty table gives an empty result. Only
key, held_out, score, predicted and margin are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coursemill.llm.common import kind, small_batches, staged
from coursemill.llm.spans import LOWER, mix, row_chunks, span_hashes, text_buffer
from coursemill.llm.training import fold, isotonic, labelled_sample

SAMPLE, LEXICON = 15_000, 20_000
THRESHOLD = 0.3
#: Of 100 parts of the sample, those below the first give the lexicon, those up to the second the trees, the rest calibrates.
LEXICON_PART, TREES_PART = 60, 85
#: A lexicon entry is in at least so many toxic rows, with a log odds ratio of at least this.
LEAST_ROWS, LEAST_ODDS = 3, 2.0
#: Lengths in bytes of the beginnings of words that may be entries.
BEGINNINGS = (4, 5, 6)
#: Words from a lexicon word within which a word of the second person is close.
NEAR = 4
#: Words of the second person (fixed values; English, French, German, Spanish).
SECOND_PERSON = "you your yours yourself tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr euch eure usted ustedes tú ti tus vosotros vuestro".split()
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = ~(_LETTER | _DIGIT)
_MARK[[9, 10, 11, 12, 13, 32]] = False


def _second_person() -> np.ndarray:
    data = [w.encode() for w in SECOND_PERSON]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    lengths = np.array([len(w) for w in data])
    return np.sort(span_hashes(raw, np.cumsum(lengths) - lengths, lengths)[0])


def _runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of runs of letters and digits, and the row of each."""
    ink = _LETTER[raw] | _DIGIT[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, ink, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # a run over a border of rows is two runs
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = np.unique(cut[ink[cut] & ink[cut - 1]]) if len(cut) else cut
    starts, ends = np.sort(np.r_[starts, cut]), np.sort(np.r_[ends, cut])
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def keys(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """For each word: its hash, and the hashes of its beginnings (0 where the word is no longer than that)."""
    out = [span_hashes(raw, starts, lengths)[0]]
    for n in BEGINNINGS:
        key = np.zeros(len(starts), dtype=np.uint64)
        long = np.flatnonzero(lengths > n)
        at = starts[long]
        h = np.full(len(long), np.uint64(n + 90), dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(1099511628211) + raw[at + j]
        key[long] = mix(h) | np.uint64(1)
        out.append(key)
    return out


FEATURES = ["log_words", "hit_rate", "log_hits", "log_kinds", "top_odds", "odds_rate", "near_rate", "person_rate", "capital_rate", "capital_words", "mark_rate", "loud_rate", "mixed_rate", "inner_rate", "long_run_rate"]


def dense(raw: np.ndarray, offsets: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], person: np.ndarray) -> np.ndarray:
    """The dense features of each row; lexicon: sorted keys and their odds."""
    n = len(offsets) - 1
    low = LOWER[raw]
    starts, lengths, row = _runs(raw, offsets)
    sums = lambda x, r: np.bincount(r, x, minlength=n).astype(float)
    words = np.maximum(np.bincount(row, minlength=n), 1).astype(float)
    chars = np.maximum(np.diff(offsets), 1).astype(float)
    odds, which = np.zeros(len(starts)), np.zeros(len(starts), dtype=np.uint64)
    entries, weight = lexicon
    all_keys = keys(low, starts, lengths) if len(starts) else [np.zeros(0, np.uint64)]
    for key in all_keys if len(entries) else []:
        at = np.minimum(np.searchsorted(entries, key), len(entries) - 1)
        better = (entries[at] == key) & (weight[at] > odds)
        odds[better], which[better] = weight[at[better]], key[better]
    hit = odds > 0
    at = np.minimum(np.searchsorted(person, all_keys[0]), len(person) - 1)
    you = person[at] == all_keys[0]
    hits, yous = np.flatnonzero(hit), np.flatnonzero(you)
    near = np.zeros(len(hits), dtype=bool)
    if len(yous) and len(hits):
        for side in (0, -1):
            p = np.clip(np.searchsorted(yous, hits) + side, 0, len(yous) - 1)
            near |= (np.abs(yous[p] - hits) <= NEAR) & (row[yous[p]] == row[hits])
    kinds = np.unique(np.stack([row[hits].astype(np.uint64), which[hits]]), axis=1)[0].astype(np.int64) if len(hits) else np.zeros(0, np.int64)
    top = np.zeros(n)
    np.maximum.at(top, row[hits], odds[hits])
    # byte rates by row
    mass = lambda flag: np.diff(np.r_[0, np.cumsum(flag)][offsets]).astype(float)
    upper = (raw >= 65) & (raw <= 90)
    letters = np.maximum(mass(_LETTER[raw]), 1)
    upto = np.r_[0, np.cumsum(upper)]
    shout = (upto[starts + lengths] - upto[starts] == lengths) & (lengths > 1)
    digits = np.r_[0, np.cumsum(_DIGIT[raw])]
    of_digits = digits[starts + lengths] - digits[starts]
    mixed = (of_digits > 0) & (of_digits < lengths)
    before, after = np.r_[32, raw[:-1]], np.r_[raw[1:], 32]
    inner = _MARK[raw] & _LETTER[before] & _LETTER[after]
    triple = np.zeros(len(raw), dtype=bool)
    if len(raw) > 2:
        triple[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & _LETTER[low[2:]]
    number = np.bincount(row, minlength=n).astype(float)
    return np.stack([
        np.log1p(number), sums(hit, row) / words, np.log1p(sums(hit, row)), np.log1p(np.bincount(kinds, minlength=n)), top, sums(odds, row) / words,
        sums(near, row[hits]) / np.maximum(sums(hit, row), 1), sums(you, row) / words, mass(upper) / letters, sums(shout, row) / words,
        mass(_MARK[raw]) / chars, mass((raw == 33) | (raw == 63)) / chars, sums(mixed, row) / words, mass(inner) / words, mass(triple) / letters,
    ], axis=1)


class Trees:
    """Boosted regression trees for the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = self._bins(x)
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees: list[np.ndarray] = []
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(bins, y - p, p * (1 - p) + 1e-6)
            self.trees.append(tree)
            margin += RATE * self._walk(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Node rows (feature, bin, leaf value); children of node i are 2i + 1 and 2i + 2; feature -1 marks a leaf."""
        tree = np.full((2 ** (DEPTH + 1) - 1, 3), -1.0)
        node = np.zeros(len(g), dtype=np.int64)
        for i in range(len(tree)):
            mine = np.flatnonzero(node == i)
            if not len(mine):
                continue
            G, H = g[mine].sum(), h[mine].sum()
            tree[i] = (-1, 0, G / (H + 1))
            if i >= 2**DEPTH - 1 or len(mine) < 20:
                continue
            best = (1e-3, -1, 0)
            for f in range(bins.shape[1]):
                gl = np.cumsum(np.bincount(bins[mine, f], g[mine], minlength=BINS))[:-1]
                hl = np.cumsum(np.bincount(bins[mine, f], h[mine], minlength=BINS))[:-1]
                gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                gain[(hl < 1) | (H - hl < 1)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                tree[i, :2] = best[1:]
                node[mine] = 2 * i + 1 + (bins[mine, best[1]] > best[2])
        return tree

    def _walk(self, tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int64)
        for _ in range(DEPTH):
            f = tree[node, 0].astype(np.int64)
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > tree[node, 1]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return tree[node, 2]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return self.start + RATE * sum((self._walk(t, bins) for t in self.trees), np.zeros(len(x)))


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and odds of the entries, from rows (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            y = np.asarray(batch.column(1)).astype(np.int64)
            for a, b in row_chunks(off, 500_000):
                own = off[a : b + 1] - off[a]
                part = LOWER[raw[off[a] : off[b]]]
                starts, lengths, row = _runs(part, own)
                if not len(starts):
                    continue
                every = np.concatenate(keys(part, starts, lengths))
                rows = np.tile(row, 1 + len(BEGINNINGS))[every != 0]
                both = np.unique(np.stack([every[every != 0], rows.astype(np.uint64)]), axis=1)
                toxic = y[a + both[1].astype(np.int64)]
                unique, at = np.unique(both[0], return_inverse=True)
                n1 = np.bincount(at, toxic, minlength=len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n1), pa.array(np.bincount(at, minlength=len(unique)) - n1)], ["key", "n1", "n0"])

    n1, n0 = sample.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "key long, n1 long, n0 long").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0))
    top = counts.filter(f"n1 >= {LEAST_ROWS}").withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "key").limit(LEXICON).toArrow()
    key, weight = np.asarray(top["key"]).astype(np.int64).view(np.uint64), np.asarray(top["odds"]).astype(float)
    order = np.argsort(key)
    return key[order], weight[order]


def _dense_rows(df: DataFrame, lexicon: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    person = _second_person()
    n = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            for a, b in row_chunks(off, 1_000_000):
                x = dense(raw[off[a] : off[b]], off[a : b + 1] - off[a], lexicon, person)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * n), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a).cast(pa.int32()), batch.column(2).slice(a, b - a), lists], ["y", "part", "x"])

    return df.select("text", "y", "part").mapInArrow(run, "y int, part int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model fitted to at most SAMPLE labelled rows: lexicon, trees and calibration."""
    small_batches(docs.sparkSession)
    sample = staged(labelled_sample(docs, labels, label, learn, SAMPLE, id_col, text_col), "sample")
    lexicon = _lexicon(sample.filter(f"part < {LEXICON_PART}"))
    got = _dense_rows(sample.filter(f"part >= {LEXICON_PART}"), lexicon).toArrow()
    y, part = np.asarray(got["y"]).astype(np.int64), np.asarray(got["part"]).astype(np.int64)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y, part])  # a fixed order, so that the fit does not depend on how rows arrived
    x, y, part = x[order], y[order], part[order]
    grow, rest = part < TREES_PART, part >= TREES_PART
    if len({*y[grow].tolist()}) < 2 or len({*y[rest].tolist()}) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return {"lexicon": lexicon, "trees": None, "x": np.zeros(1), "p": np.array([float(share)])}
    trees = Trees(x[grow], y[grow])
    knots, p = isotonic(trees.margin(x[rest]), y[rest].astype(float))
    return {"lexicon": lexicon, "trees": trees, "x": knots, "p": p}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key, `score` and `margin` (of the trees, before calibration: it orders equal scores) of every whole text."""
    small_batches(docs.sparkSession)
    person = _second_person()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON entries and TREES trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            margins = [np.zeros(0)]
            for a, b in row_chunks(off, 1_000_000):
                x = dense(raw[off[a] : off[b]], off[a : b + 1] - off[a], m["lexicon"], person)
                margins.append(m["trees"].margin(x) if m["trees"] is not None else np.zeros(b - a))
            margin = np.concatenate(margins)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(margin, m["x"], m["p"])), pa.array(margin)], [id_col, "score", "margin"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind(docs, id_col)}, score double, margin double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the key, held_out, score and predicted; learns from rows that are not held out."""
    model = train(docs, labels, fold("id", 4) != 2, id_col=id_col, text_col=text_col)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, F.coalesce(fold(id_col, 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "margin")
