"""Array helpers over Arrow string columns: chunks of whole texts, word spans and their hashes.

A text column arrives as one byte buffer with offsets, so words are found and hashed with array operations, never
row by row. A null text counts as an empty one. Texts are never cut for good: where a text is larger than a chunk,
callers that can work on parts ask for safe cuts, the others get the text alone in its chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte and an odd multiplier for each place in a word.
BYTE_VALUES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = _RNG.integers(1, 2**62, size=2, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(3)
PLACES = 256
_POW = np.ones((2, PLACES), dtype=np.uint64)
for _k in range(1, PLACES):
    _POW[:, _k] = _POW[:, _k - 1] * _BASES

#: The white space of the word contracts, [\x20\x09-\x0D].
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together; a larger row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans (start, length), one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, both: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of byte spans (all non-empty, in order); with `both` a second, independent hash of each too."""
    many = 2 if both else 1
    if not len(starts):
        return (np.zeros(0, np.uint64),) * many
    heads = np.cumsum(lengths) - lengths
    total = int(heads[-1] + lengths[-1])
    whole = total == len(raw) and starts[0] == 0
    data = raw if whole else raw[ragged(starts, lengths)]  # adjoining spans need no gathering
    place = np.arange(total, dtype=np.int64)
    place -= np.repeat(heads, lengths)
    far = np.flatnonzero(place >= PLACES) if lengths.max() > PLACES else place[:0]
    distant = place[far].astype(np.uint64)
    place[far] = 0
    out = []
    for k in range(many):
        weight = _POW[k][place]
        weight[far] = mix(distant * _BASES[k]) | np.uint64(1)  # places beyond the table: a scrambled multiplier of their own
        weight *= BYTE_VALUES[k][data]
        out.append(mix(np.add.reduceat(weight, heads) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return tuple(out)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words [^\\x20\\x09-\\x0D]+, and for each row the number of words before it."""
    ink = ~WHITE[raw]
    edge = ink.copy()
    edge[1:] &= ~ink[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[first] = ink[first]
    starts = np.flatnonzero(edge)
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[last] = ink[last]
    lengths = np.flatnonzero(stop) - starts + 1
    return starts, lengths, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text's word hashes; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    return out


class Memo:
    """An open-addressing table from pairs of 64-bit hashes to numbers 0, 1, 2, ... in order of insertion."""

    def __init__(self, bits: int = 20):
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.number = np.full(1 << bits, -1, dtype=np.int32)
        self.first = np.zeros(1 << bits, dtype=np.uint64)
        self.second = np.zeros(1 << bits, dtype=np.uint64)
        self.size, self.room = 0, (1 << bits) * 6 // 10

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 where it is absent."""
        slot = (a >> self.shift).astype(np.int64)
        out = self.number[slot]
        todo = np.flatnonzero((out >= 0) & ((self.first[slot] != a) | (self.second[slot] != b)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            held = self.number[slot]
            out[todo] = held
            on = (held >= 0) & ((self.first[slot] != a[todo]) | (self.second[slot] != b[todo]))
            todo, slot = todo[on], slot[on]
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """New, distinct pairs get the next numbers."""
        number = np.arange(self.size, self.size + len(a), dtype=np.int32)
        self.size += len(a)
        slot = (a >> self.shift).astype(np.int64)
        todo = np.arange(len(a))
        while len(todo):
            free = np.flatnonzero(self.number[slot] < 0)
            self.number[slot[free]] = number[todo[free]]
            won = self.number[slot] == number[todo]
            self.first[slot[won]], self.second[slot[won]] = a[todo[won]], b[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask
