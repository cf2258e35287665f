"""Groups of spelling variants: the frequent words of all documents, their near words at one edit and the form they stand for.

`word_counts` reads the runs of letters of whole texts and counts them. `near_words` finds, for every word, the words that
one inserted, deleted or replaced code point makes of it: of two such words the first or the second half is equal, so
words meet by the hash of a half, and tasks search a bidirectional FM-index over the words of their halves (`fm_index`):
one half exactly, then on across the other with one edit. A half that very many words have is cut again, so that they
meet by three quarters, and so on: no task holds more than a bounded part of the vocabulary and no pair is made that is
not near. `variants` picks forms and follows them to their roots by pointer doubling.

Defined cases: a null text holds no words; a null id reads as an empty one; repeated rows count each; long runs are words
like any others; ties of a form's count go to the first word in code-point order; an empty table gives no rows; columns
besides the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coursemill.llm.common import small_batches, spread_join, staged
from coursemill.llm.fm_index import FmIndex
from coursemill.llm.packed_terms import counted, spans_of, strings
from coursemill.llm.spans import LOWER, ragged, row_chunks, text_buffer

#: Code points and occurrences that a word has at least; times that a form must be as frequent; one run of so many is altered.
LEAST_LETTERS, LEAST_COUNT, FORM_TIMES, ALTERED = 6, 5, 5, 199
#: Words that one index holds (and the words of one half beside them); words of one half that are not cut again.
INDEX_WORDS, GROUP_WORDS = 40_000, 10_000
#: Bytes of text read at once.
CHUNK = 8_000_000

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
#: Bytes up to which checksums are taken over all runs at once.
TOGETHER = 64


def letters(raw: np.ndarray) -> np.ndarray:
    """The bytes of A-Z, a-z and U+00C0 to U+00FF (C3 and the byte behind it)."""
    ink = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw == 0xC3)
    ink[1:] |= raw[:-1] == 0xC3
    return ink


def checksums(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The crc32 of each span behind what its seed is the crc32 of."""
    order = np.argsort(-np.minimum(lengths, TOGETHER), kind="stable")
    begin, state = starts[order], seeds[order] ^ np.uint32(0xFFFFFFFF)
    upto = np.searchsorted(-lengths[order], -np.arange(TOGETHER), side="left") if lengths.max(initial=0) <= TOGETHER else None
    for k in range(int(min(lengths.max(initial=0), TOGETHER))):
        n = int(upto[k]) if upto is not None else int((lengths > k).sum())
        state[:n] = _CRC[(state[:n] ^ raw[begin[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(starts), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > TOGETHER).tolist():
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + lengths[i]].tobytes(), int(seeds[i]))
    return out


def word_counts(docs: DataFrame, least: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least LEAST_LETTERS code points with at least `least` occurrences."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            seeds = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in batch.column(0).to_pylist()], dtype=np.uint32)
            for a, b in row_chunks(off, CHUNK):
                yield _counted(LOWER[raw[off[a] : off[b]]], off[a : b + 1] - off[a], seeds[a:b])

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _counted(raw: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> pa.RecordBatch:
    starts, lengths, row = spans_of(letters(raw), offsets)
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    size = points[starts + lengths] - points[starts]
    long = size >= LEAST_LETTERS
    starts, lengths, row, size = starts[long], lengths[long], row[long], size[long]
    crc = checksums(raw, starts, lengths, seeds[row]).astype(np.int64)
    hit = crc % ALTERED == 0
    altered: dict[str, int] = {}
    for s, k, place in zip(starts[hit].tolist(), lengths[hit].tolist(), (crc[hit] % size[hit]).tolist(), strict=True):
        run = raw[s : s + k].tobytes().decode()
        if len(run) > LEAST_LETTERS:
            word = run[:place] + run[place + 1 :]
            altered[word] = altered.get(word, 0) + 1
    starts, lengths = starts[~hit], lengths[~hit]
    first, n = counted(raw, starts, lengths)
    words = pa.concat_arrays([strings(raw, starts[first], lengths[first]), pa.array(list(altered), pa.string())])
    return pa.RecordBatch.from_arrays([words, pa.array(np.r_[n, np.array(list(altered.values()), dtype=np.int64)])], ["word", "n"])


def _key() -> F.Column:
    """The hash of what the words of one search have in common: the shorter word's length and the equal ends."""
    return F.xxhash64("short", "head", "tail", "apart", F.expr("substring(word, 1, head)"), F.expr("substring(word, char_length(word) - tail + 1, tail)"))


def halves(words: DataFrame, group: int = GROUP_WORDS) -> DataFrame:
    """The searches that each word takes part in: word, n, short, longer, head, tail, apart, key.

    Words of `short` code points and of one more meet where the first `head` and the last `tail` are equal; the edit lies
    between. A pair is found in one search only: where its ends meet in the first half, or else, `apart` of the words
    being the code points in which it then must differ, in the second. What more than `group` words share is cut again.
    """
    size = F.char_length("word")
    roles = F.explode(F.expr("filter(array(named_struct('short', char_length(word), 'longer', false), named_struct('short', char_length(word) - 1, 'longer', true)), r -> r.short > 0)"))
    open_ = words.select("word", "n", roles.alias("r")).select("word", "n", "r.*", *(F.lit(0).alias(c) for c in ("head", "tail", "apart")))
    done = None
    while True:
        half = F.expr("(short - head - tail) div 2").cast("int")
        first = F.struct((F.col("head") + half).alias("head"), F.col("tail"), F.col("apart"))
        second = F.struct(F.col("head"), (F.col("short") - F.col("head") - half).cast("int").alias("tail"), (F.col("head") + half).alias("apart"))
        cut = open_.withColumn("h", F.explode(F.array(first, second))).select("word", "n", "short", "longer", "h.*")
        met = staged(cut.withColumn("key", _key()), "halves")
        hot = staged(met.filter("short - head - tail > 1").groupBy("key").count().filter(F.col("count") > group).select("key"), "hot-halves")
        last = hot.isEmpty()
        whole = met if last else met.join(hot, "key", "left_anti").select(met.columns)
        done = whole if done is None else done.union(whole)
        if last:
            return done
        open_ = met.join(hot, "key", "left_semi").drop("key")


def near_words(words: DataFrame, group: int = GROUP_WORDS, index_words: int = INDEX_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) for each word (word, n) with near words: their number, and the one of largest n."""
    small_batches(words.sparkSession)
    schema = "word string, n_near long, best_n long, best string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            done = 0
            # an index is made where a key ends, once enough words are there
            for end in (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist():
                if rows + end - done >= index_words:
                    yield _searched([*held, batch.slice(done, end - done)])
                    held, rows, done = [], 0, end
            if done < len(key):
                held.append(batch.slice(done))
                rows += len(key) - done
        if held:
            yield _searched(held)

    met = halves(words, group).select("key", "word", "n", "longer", "short", "head", "tail", "apart").repartition("key").sortWithinPartitions("key")
    found = met.mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _searched(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The near words of the searches in one index over all their words."""
    table = pa.Table.from_batches(held)
    spelled = table["word"].to_pylist()
    n_of = dict(zip(spelled, table["n"].to_pylist(), strict=True))
    words = sorted(n_of)
    at = {w: i for i, w in enumerate(words)}
    index, count = FmIndex(words), np.array([n_of[w] for w in words], dtype=np.int64)
    word = np.array([at[w] for w in spelled], dtype=np.int64)
    longer, short, head, tail, apart = (table[c].to_numpy() for c in ("longer", "short", "head", "tail", "apart"))
    ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for to_left in (False, True):
        of = np.flatnonzero((tail > head) == to_left)  # from the longer of the equal ends
        if not len(of):
            continue
        exact = (tail if to_left else head)[of].astype(np.int64)
        middle = (short - head - tail)[of].astype(np.int64) + longer[of]
        q, other = index.near(word[of], exact, middle, longer[of], to_left)
        differ = _differ(index, word[of][q], other, apart[of][q].astype(np.int64))
        ones.append(word[of][q][differ])
        twos.append(other[differ])
    one, two = np.concatenate(ones), np.concatenate(twos)
    order = np.lexsort((two, -count[two], one))
    one, two = one[order], two[order]
    heads = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.zeros(0, np.int64)
    many = np.diff(np.r_[heads, len(one)])
    columns = [pa.array([words[i] for i in one[heads]], pa.string()), pa.array(many), pa.array(count[two[heads]]), pa.array([words[i] for i in two[heads]], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def _differ(index: FmIndex, one: np.ndarray, two: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether two words differ in their first `apart` symbols; true where that is 0."""
    out = np.ones(len(one), dtype=bool)
    asked = np.flatnonzero(apart > 0)
    if len(asked):
        apart = apart[asked]
        same = index.text[ragged(index.place[one[asked]], apart)] == index.text[ragged(index.place[two[asked]], apart)]
        out[asked] = ~np.logical_and.reduceat(same, np.cumsum(apart) - apart)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): forms followed to the last, by doubling steps.

    A form has more occurrences than its word, so chains end. Many words may share a form; its rows are dealt.
    """
    known = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(spread_join(known, ahead, ["root"], "word", how="left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        known = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return known


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = FORM_TIMES, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP_WORDS, index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    The form is the near word of largest count, if that is at least `times` the word's own; the root is the last form of
    the chain, the word itself where it has none.
    """
    words = staged(word_counts(docs, least, id_col, text_col), "vocabulary")
    near = words.join(near_words(words, group, index_words), "word", "left")
    found = F.col("best_n") >= times * F.col("n")
    formed = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(found, F.col("best")).alias("form"), F.when(found, F.col("best_n")).alias("form_n")), "forms")
    followed = roots(formed.filter("form is not null"))
    return formed.join(followed, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


ORACLE = rf"""
WITH RECURSIVE t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS name, count(*) AS k FROM t WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(name), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a & 255, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))), 4294967295) AS h FROM r),
w AS (SELECT CASE WHEN h % {ALTERED} = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
m AS (SELECT word, n, i, word[1:i - 1] AS a, word[i + 1:] AS z FROM p),
e AS (SELECT x.word, y.word AS other, y.n AS other_n FROM m x JOIN m y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT m.word, v.word, v.n FROM m JOIN v ON v.word = m.a || m.z
  UNION SELECT v.word, m.word, m.n FROM m JOIN v ON v.word = m.a || m.z),
b AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM e GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {FORM_TIMES} * n THEN best END AS form, CASE WHEN best_n >= {FORM_TIMES} * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
o AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, coalesce(root, f.word) AS root FROM f LEFT JOIN o USING (word)
"""
