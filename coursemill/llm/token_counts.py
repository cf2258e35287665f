"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

A word's bytes are its first symbols, linked in a row. A heap holds the adjacent pairs that the vocabulary merges, by rank
and then place; the lowest is popped and merged until none is left. The count is the number of first symbols less the
number of merges; ids are never put together. Equal words of a chunk are counted once, and a worker remembers the counts
of the words that it has met, up to a bound.

Defined cases: a null text counts as an empty one, with no bytes and no tokens; white space alone is text like any other;
the string of a special token inside a text is one token; repeated rows each give their own row; an empty table gives an
empty result; a null key stays null; a very long text is cut into words in pieces, at places where a word ends in any
case. Columns other than the key are not returned, so they may bear any name. Words are known by 128 bits of hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coursemill.llm.bpe import CHUNK, NONE, Encoder, Vocabulary, pretokens
from coursemill.llm.bpe_codec import vocabulary
from coursemill.llm.common import kind, small_batches
from coursemill.llm.spans import Memo, ragged, row_chunks, span_hashes, text_buffer

#: Tokens that a document may have before it is over the limit.
LIMIT = 1024
#: A worker remembers up to 0.6 * 2 ** MEMO_BITS words.
MEMO_BITS = 20
#: Bytes of text in one batch of results.
OUT_BYTES = 4_000_000


def merges(symbols: list[int], ranks: list[int], vocab: Vocabulary) -> int:
    """How many merges a word of `symbols` takes; `ranks` are those of its adjacent pairs, NONE where there is no merge.

    `after` and `before` link the places that are left; `held` is the rank of the pair that starts at a place. A popped
    pair that is no longer there, because one of its symbols was merged with another, has another rank at its place.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    held = [*ranks, NONE]
    heap = [r * n + i for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(heap)
    pair, size, made = vocab.pair, vocab.size, 0
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        if held[i] != rank:
            continue
        made += 1
        j = after[i]
        k = after[i] = after[j]
        held[j] = NONE
        symbols[i] = pair[symbols[i] * size + symbols[j]][1]
        if k < n:
            before[k] = i
            if found := pair.get(symbols[i] * size + symbols[k]):
                held[i] = found[0]
                heapq.heappush(heap, found[0] * n + i)
            else:
                held[i] = NONE
        else:
            held[i] = NONE
        if (h := before[i]) >= 0:
            if found := pair.get(symbols[h] * size + symbols[i]):
                held[h] = found[0]
                heapq.heappush(heap, found[0] * n + h)
            else:
                held[h] = NONE
    return made


class Counter(Encoder):
    """Token counts for one worker, with a bounded memo of the words it has met."""

    def _forget(self) -> None:
        self.memo = Memo(MEMO_BITS)
        self.count = np.zeros(self.memo.room, dtype=np.int32)

    def _merged(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The token counts of distinct words: symbols less merges."""
        symbols = self.vocabulary.of_byte[raw[ragged(starts, lengths)]]
        ends = np.cumsum(lengths)
        rank = np.full(len(symbols), NONE, dtype=np.int32)  # of the pair that starts at each symbol
        if len(symbols) > 1:
            rank[:-1] = self.vocabulary.ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = NONE
        count = lengths.astype(np.int64)
        some = np.flatnonzero(np.minimum.reduceat(rank, ends - lengths) != NONE)
        for w in some.tolist():
            a, b = int(ends[w] - lengths[w]), int(ends[w])
            count[w] -= merges(symbols[a:b].tolist(), rank[a : b - 1].tolist(), self.vocabulary)
        return count

    def _counts(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The token count of each word, in order."""
        if not len(starts):
            return np.zeros(0, np.int64)
        a, b = span_hashes(raw, starts, lengths, both=True)
        place = self.memo.find(a, b)
        if (place < 0).any():
            new = np.flatnonzero(place < 0)
            new = new[np.unique(a[new] ^ (b[new] * np.uint64(3)), return_index=True)[1]]
            if self.memo.size + len(new) > self.memo.room:
                self._forget()
                new = np.unique(a ^ (b * np.uint64(3)), return_index=True)[1]
            n = self.memo.size
            while n + len(new) > len(self.count):
                self.count = np.r_[self.count, np.zeros_like(self.count)]
            self.count[n : n + len(new)] = self._merged(raw, starts[new], lengths[new])
            self.memo.add(a[new], b[new])
            place = self.memo.find(a, b)
        return self.count[place].astype(np.int64)

    def texts_counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The token count of each row."""
        cuts, fixed = self._cuts(raw, offsets)
        of_part = np.zeros(max(len(cuts) - 1, 0), dtype=np.int64)  # a part is a row, a piece of one, or a special token
        i = 0
        while i < len(of_part):
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK, side="right")) - 1)
            part, own = raw[cuts[i] : cuts[j]], cuts[i + 1 : j + 1] - cuts[i]
            starts, lengths = pretokens(part, own)
            which = np.searchsorted(own, starts, side="right")
            if fixed:
                plain = ~np.isin(which + i, list(fixed))
                starts, lengths, which = starts[plain], lengths[plain], which[plain]
            of_part[i:j] += np.bincount(which, self._counts(part, starts, lengths), minlength=j - i).astype(np.int64)
            i = j
        of_part[list(fixed)] = 1
        upto = np.r_[0, np.cumsum(of_part)]
        return np.diff(upto[np.searchsorted(cuts, offsets)])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """A worker's counter; it lives as long as the worker, with its memo of words."""
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the key, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    `tokenizer` is a byte-level BPE file; counts are those of its library without added special tokens. Texts are not
    shuffled and nothing is collected.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer)
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for a, b in row_chunks(off, OUT_BYTES):
                n = known.texts_counts(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(off[a : b + 1])), pa.array(n)], [id_col, "n_bytes", "n_tokens"])

    found = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind(docs, id_col)}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
