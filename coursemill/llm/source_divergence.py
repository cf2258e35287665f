"""Audit of how far the sources of a language differ in their use of terms.

Terms of short length are packed into machine words and counted by radix sort (`packed_terms`), per source and with the
number of documents that hold them. Spark sums the counts, keeps the terms that enough documents of a language hold, and
compares sources by smoothed rates in whole numbers. Every pair of a language's sources is compared over all kept terms:
blocks of terms by blocks of sources are small dense matrices, of which the part that neither source uses is left out and
added by its number.

Defined cases: a null text, lang or source reads as ''; repeated rows are documents of their own; a group whose texts hold
no term takes part with counts of 0; a language without a kept term gives its pairs the value 0 and no terms; ties rank
by the item's UTF-8 bytes; an empty table gives no rows; columns besides text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from coursemill.llm.common import small_batches, staged
from coursemill.llm.packed_terms import sorted_buckets, spans_of, strings
from coursemill.llm.spans import LOWER, row_chunks, text_buffer

#: Documents of a language that a kept term is in; pseudo-counts of a term; the unit of rates; ranks of terms.
LEAST_DOCS, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Sources and (about) terms of one matrix.
SOURCES, TERMS = 128, 512
#: Bytes of text counted at once.
CHUNK = 8_000_000

#: Bytes of terms: ASCII letters and all of non-ASCII characters.
INK = np.zeros(256, dtype=bool)
INK[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents that hold it); each group has a row of the term '' with 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch.column(k).fill_null("") for k in (1, 2))
            code, _ = pd.factorize(pd.MultiIndex.from_arrays([lang.to_numpy(zero_copy_only=False), source.to_numpy(zero_copy_only=False)]))
            raw, off = text_buffer(batch.column(0))
            for a, b in row_chunks(off, CHUNK):
                yield _counted(LOWER[raw[off[a] : off[b]]], off[a : b + 1] - off[a], code[a:b], lang.slice(a, b - a), source.slice(a, b - a))

    found = docs.select(*(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source"))).mapInArrow(run, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _counted(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    starts, lengths, row = spans_of(INK[raw], offsets)
    by_group = np.argsort(group[row], kind="stable")  # so that equal terms of a group lie together, row by row
    starts, lengths, row = starts[by_group], lengths[by_group], row[by_group]
    first, n, d = [], [], []
    for order, new in sorted_buckets(raw, starts, lengths):
        rows = row[order]
        other = np.r_[True, rows[1:] != rows[:-1]]
        new[1:] |= group[rows[1:]] != group[rows[:-1]]
        heads = np.flatnonzero(new)
        first.append(order[heads])
        n.append(np.diff(np.r_[heads, len(order)]))
        d.append(np.add.reduceat((other | new).astype(np.int64), heads))
    first, n, d = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, n, d))
    alone = np.unique(group, return_index=True)[1]  # a row of every group
    terms = pa.concat_arrays([strings(raw, starts[first], lengths[first]), pa.array([""] * len(alone))])
    of = pa.array(np.concatenate([row[first], alone]))
    zero = np.zeros(len(alone), np.int64)
    return pa.RecordBatch.from_arrays([lang.take(of), source.take(of), terms, pa.array(np.r_[n, zero]), pa.array(np.r_[d, zero])], ["lang", "source", "term", "n", "d"])


def _rate(count: str, total: str, terms: str = "v") -> F.Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exact for any count; null where there are no terms."""
    whole = f"cast({UNIT} as decimal(10, 0)) * cast({count} + {PRIOR} as decimal(19, 0))"
    return F.expr(f"1 + ({whole} div cast(nullif({total} + {PRIOR} * {terms}, 0) as decimal(20, 0)))")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part `pair`: the sum over the kept terms of the absolute difference of a source's rate and another's, all of them;
    part `term`: the `top` terms that a source uses more than its language does, by the difference.
    """
    counts = staged(term_counts(docs), "term-counts")
    used = counts.filter("term <> ''")
    kept = staged(used.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("d")).filter(F.col("d") >= least_docs).select("lang", "term", "all_n"), "kept-terms")
    uses = staged(used.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "uses")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    sums = uses.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["group_n", "v", "lang_n"])
    at = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = staged(groups.withColumn("at", at).withColumn("size", F.count("*").over(W.partitionBy("lang"))), "groups")
    rated = uses.join(groups, ["lang", "source"]).withColumn("p", _rate("n", "group_n"))
    return _pairs(rated, groups).unionByName(_terms(rated, top))


def _terms(rated: DataFrame, top: int) -> DataFrame:
    more = rated.withColumn("value", F.col("p") - _rate("all_n", "lang_n")).filter("value > 0")
    ranked = more.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of sources by matrices of a block of terms and two blocks of sources.

    `zero` is the rate of a term that a source does not use. A matrix sums, over the terms that one of its sources uses,
    what the pair differs by beyond the difference of its zeros; that difference times all kept terms is added at the end.
    """
    zero = groups.filter("size > 1 and v > 0").withColumn("zero", _rate("0", "group_n")).withColumn("blocks", F.ceil(F.col("v") / TERMS))
    sides = F.ceil(F.col("size") / SOURCES)
    mine = F.floor(F.col("at") / SOURCES)
    # a block of sources meets itself and every other block once: (low, high) with low <= high
    meets = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), sides - 1), lambda k: F.struct(F.least(k, mine).alias("low"), F.greatest(k, mine).alias("high"))))
    held = rated.filter("size > 1").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / TERMS)))
    cells = held.select("lang", "block", meets.alias("m"), "at", "term", "p")
    rows = zero.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("lang", "block", meets.alias("m"), "at", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"))
    every = cells.union(rows).select("lang", "block", "m.low", "m.high", "at", "term", "p")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        at, p = table["at"].to_numpy(), table["p"].to_numpy()
        term = table["term"].combine_chunks().dictionary_encode()
        is_zero = np.asarray(table["term"].is_null())
        sources, row = np.unique(at, return_inverse=True)
        base = np.zeros(len(sources), dtype=np.int64)
        base[row[is_zero]] = p[is_zero]
        rates = np.repeat(base[:, None], len(term.dictionary), axis=1)
        rates[row[~is_zero], np.asarray(term.indices.filter(pa.array(~is_zero)))] = p[~is_zero]
        side = sources // SOURCES
        out: list[np.ndarray] = []
        for i in np.flatnonzero(side == low):
            js = np.flatnonzero((side == high) & (sources > sources[i]))
            beyond = np.abs(rates[js] - rates[i]).sum(axis=1) - np.abs(base[js] - base[i]) * rates.shape[1]
            out.append(np.stack([np.full(len(js), sources[i]), sources[js], beyond]))
        a, b, beyond = np.concatenate([np.zeros((3, 0), np.int64), *out], axis=1)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": a, "b": b, "beyond": beyond})

    sums = every.groupBy("lang", "block", "low", "high").applyInArrow(compare, "lang string, a long, b long, beyond long").groupBy("lang", "a", "b").agg(F.sum("beyond").alias("beyond"))
    one = groups.select("lang", F.col("at").alias("a"), F.col("source").alias("source_a"), "v", "size", _rate("0", "group_n").alias("zero_a"))
    two = groups.select("lang", F.col("at").alias("b"), F.col("source").alias("source_b"), _rate("0", "group_n").alias("zero_b"))
    worth = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source_a", "source_b", (F.col("beyond") + F.abs(F.col("zero_a") - F.col("zero_b")) * F.col("v")).alias("value"))
    # a language without kept terms: its sources do not differ
    later = F.expr("case when at + 1 < size then sequence(at + 1, size - 1) else array() end")
    bare = groups.filter("v = 0 and size > 1").select("lang", F.col("source").alias("source_a"), F.explode(later.cast("array<long>")).alias("b")).join(two, ["lang", "b"])
    both = worth.union(bare.select("lang", "source_a", "source_b", F.lit(0).cast("long").alias("value")))
    both = both.union(both.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "value"))
    rank = F.row_number().over(W.partitionBy("lang", "source_a").orderBy(F.desc("value"), "source_b"))
    return both.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value", rank.alias("rank"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS q_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(q_n) AS lang_n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS group_n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (s.group_n + {PRIOR} * l.v) AS p,
        1 + ({UNIT}::HUGEINT * (k.q_n + {PRIOR})) // (l.lang_n + {PRIOR} * l.v) AS q
      FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
