"""Runs of equal terms in a buffer of text, found by packing terms into machine words by length.

Terms of up to 8 bytes are one uint64, terms of up to 16 are two; both are radix-sorted by 16-bit digits. Longer terms lie
in buckets of doubling width that are sorted by their bytes. Terms hold no zero byte, so padding with zeros is no loss:
equality is exact, no hash takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from coursemill.llm.common import binary_column
from coursemill.llm.spans import ragged

#: Of a length from 0 to 8, the mask that keeps so many leading bytes of a big-endian word.
MASK = np.array([(~0 << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(9)], dtype=np.uint64)


def radix_order(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """`order` (places in `words`) sorted by word, ties as they were: stable passes over 16-bit digits, least first."""
    for shift in (0, 16, 32, 48):
        digit = ((words >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def sorted_buckets(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of lengths: the places of its terms, equal ones side by side in their old order, and where one starts."""
    room = np.r_[raw, np.zeros(16, np.uint8)]
    at = np.ndarray((len(raw) + 9,), dtype=">u8", buffer=room.data, strides=(1,))  # the eight bytes from each place on
    for low, high in ((1, 8), (9, 16)):
        of = np.flatnonzero((lengths >= low) & (lengths <= high))
        if not len(of):
            continue
        words = [at[starts[of] + 8 * k].astype(np.uint64) & MASK[np.clip(lengths[of] - 8 * k, 0, 8)] for k in range(high // 8)]
        order = np.arange(len(of))
        for w in reversed(words):
            order = radix_order(w, order)
        new = np.ones(len(of), dtype=bool)
        new[1:] = np.logical_or.reduce([w[order[1:]] != w[order[:-1]] for w in words])
        yield of[order], new
    width, longest = 32, int(lengths.max(initial=0))
    while width // 2 < longest:
        of = np.flatnonzero((lengths > width // 2) & (lengths <= width))
        if len(of):
            cells = np.zeros(len(of) * width, dtype=np.uint8)
            cells[ragged(np.arange(len(of)) * width, lengths[of])] = raw[ragged(starts[of], lengths[of])]
            cells = cells.view(f"S{width}")
            order = np.argsort(cells, kind="stable")
            new = np.ones(len(of), dtype=bool)
            new[1:] = cells[order[1:]] != cells[order[:-1]]
            yield of[order], new
        width *= 2


def counted(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct term and how often it occurs."""
    firsts, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for order, new in sorted_buckets(raw, starts, lengths):
        heads = np.flatnonzero(new)
        firsts.append(order[heads])
        counts.append(np.diff(np.r_[heads, len(order)]))
    return np.concatenate(firsts), np.concatenate(counts)


def strings(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The spans as a string column."""
    return binary_column(raw[ragged(starts, lengths)].tobytes(), np.r_[0, np.cumsum(lengths)]).cast(pa.string())


def spans_of(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of the maximal runs of marked bytes that lie inside one row each."""
    edge = np.zeros(len(ink) + 1, dtype=bool)
    edge[:-1] = ink
    edge[1:-1] &= ~ink[:-1]
    edge[-1] = False
    inner = offsets[1:-1][offsets[1:-1] < len(ink)]
    edge[inner] |= ink[inner]
    starts = np.flatnonzero(edge)
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    inner = inner[inner > 0] - 1
    stop[inner] |= ink[inner]
    return starts, np.flatnonzero(stop) + 1 - starts, np.searchsorted(offsets, starts, side="right") - 1
