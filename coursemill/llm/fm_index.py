"""A bidirectional FM-index over a delimited vocabulary, searched for many patterns at once with array operations.

The text is `$w0$w1$...$` with the words in code-point order, so the suffix that starts with `$w$` has the rank of w in the
vocabulary, and a pattern's interval of suffix ranks names the words without a table of places. The text and its reverse
are indexed each by a wavelet matrix of its Burrows-Wheeler transform; a step to either side narrows both intervals.
"""

from __future__ import annotations

import numpy as np

from coursemill.llm.spans import ragged


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of the suffixes in order (a suffix before what it begins), by doubling; `bits` bits hold a symbol."""
    n, step = len(text), max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for k in range(min(step, n)):  # the first key holds as many symbols as fit; beyond the end stand zeros, as the delimiter is
        key <<= bits
        key[: n - k] |= text[k:]
    rank = np.unique(key, return_inverse=True)[1]
    if n > 1:  # suffixes that end inside the first key: the shorter one first
        key = rank.astype(np.int64) * (step + 1) + np.minimum(n - np.arange(n), step)
        rank = np.unique(key, return_inverse=True)[1]
    while rank.max(initial=0) < n - 1:
        behind = np.zeros(n, dtype=np.int64)
        behind[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1]
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


class Side:
    """The index of one direction: intervals of suffix ranks and their extension by a symbol in front."""

    def __init__(self, text: np.ndarray, bits: int):
        self.bits = bits
        self.bwt = text[suffix_order(text, bits) - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=1 << bits))]
        self.ones, self.zeros, row = [], [], self.bwt
        for b in range(bits - 1, -1, -1):
            bit = (row >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.begin = self._walk(np.arange(1 << bits), np.zeros(1 << bits, np.int64))[0]

    def _walk(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ends of intervals on the matrix's last level, and how many smaller symbols lay between."""
        high = low if high is None else high
        smaller = np.zeros(len(low), dtype=np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            smaller += np.where(bit, (high - low) - (b - a), 0)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return low, high, smaller

    def extend(self, symbol: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals with `symbol` in front: low end, size, and how many smaller symbols stand in front of the old."""
        a, b, smaller = self._walk(symbol, low, low + size)
        return self.first[symbol] + a - self.begin[symbol], b - a, smaller


class FmIndex:
    """Both directions over distinct words in code-point order; the symbols of `text` are 0 for the delimiter, then code points by rank."""

    def __init__(self, words: list[str]):
        code = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)
        symbols, text = np.unique(code, return_inverse=True)
        self.text = text.astype(np.int64)
        bits = max(1, (len(symbols) - 1).bit_length())
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.place = np.cumsum(self.length + 1) - self.length  # where each word starts, its delimiter one before
        self.left, self.right = Side(self.text, bits), Side(self.text[::-1].copy(), bits)

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n states of the empty pattern: low ends in the text's and the reverse's order, and sizes."""
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.text))

    def extend(self, to_left: bool, symbol: np.ndarray, fore: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states with `symbol` put before (to_left) or behind their patterns."""
        if to_left:
            fore, new, smaller = self.left.extend(symbol, fore, size)
            return fore, back + smaller, new
        back, new, smaller = self.right.extend(symbol, back, size)
        return fore + smaller, back, new

    def followers(self, to_left: bool, fore: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol): the symbols but the delimiter that each pattern is followed by on that side. Equal states are read once."""
        side, low = (self.left, fore) if to_left else (self.right, back)
        pair, inverse = np.unique(low * (len(self.text) + 1) + size, return_inverse=True)
        low, size = pair // (len(self.text) + 1), pair % (len(self.text) + 1)
        seen = np.unique((np.repeat(np.arange(len(pair)), size) << side.bits) | side.bwt[ragged(low, size)])
        seen = seen[(seen & ((1 << side.bits) - 1)) > 0]
        of, symbol = seen >> side.bits, seen & ((1 << side.bits) - 1)
        many = np.bincount(of, minlength=len(pair))
        take = ragged((np.cumsum(many) - many)[inverse], many[inverse])
        return np.repeat(np.arange(len(inverse)), many[inverse]), symbol[take]

    def near(self, word: np.ndarray, exact: np.ndarray, middle: np.ndarray, longer: np.ndarray, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs at one edit: each query matches `exact` symbols of its `word`, delimiter first, and then goes
        on over the rest to the other delimiter with one edit among the next `middle` symbols.

        A query that is `longer` leaves one symbol out; others replace one or take one more. `to_left`: the exact part is the
        word's end. Returns each pair once.
        """
        sign = -1 if to_left else 1
        edge = self.place[word] + self.length[word] if to_left else self.place[word] - 1  # of the delimiter that comes first
        symbol = lambda q, k: self.text[edge[q] + sign * k]  # noqa: E731  k = 1 is the first symbol of the word, from that side
        rest = self.length[word] - exact
        # the exact part, once for queries with the same one
        q, state, k = np.arange(len(word)), self.whole(len(word)), 0
        zero = np.zeros((3, len(word)), dtype=np.int64)
        while len(q):
            state = self.extend(to_left, symbol(q, k), *state)
            ended = exact[q] == k
            zero[:, q[ended]] = np.stack(state)[:, ended]
            q, state, k = q[~ended], tuple(s[~ended] for s in state), k + 1
        q, state, j = np.arange(len(word)), tuple(zero), 0
        live: list[np.ndarray] = []  # states after the edit: query, symbols of the rest behind it, and the state
        found: list[np.ndarray] = []
        pool = np.zeros((5, 0), dtype=np.int64)
        while len(q) or pool.shape[1]:
            live = [pool]
            if len(q):
                own = np.flatnonzero(~longer[q])
                s, c = self.followers(to_left, *(x[own] for x in state))
                s = own[s]
                new = np.stack(self.extend(to_left, c, *(x[s] for x in state))) if len(s) else np.zeros((3, 0), np.int64)
                here = symbol(q[s], exact[q[s]] + 1 + j)
                swap = (j < middle[q[s]]) & (c != here)
                more = (c != here) | (j == middle[q[s]])
                live += [np.vstack([q[s][swap], np.full(int(swap.sum()), j + 1), new[:, swap]]), np.vstack([q[s][more], np.full(int(more.sum()), j), new[:, more]])]
                out = np.flatnonzero(longer[q] & (j < middle[q]))
                live.append(np.vstack([q[out], np.full(len(out), j + 1), np.stack(state)[:, out]]))
                on = j < middle[q]
                q, state = q[on], tuple(x[on] for x in state)
                state = self.extend(to_left, symbol(q, exact[q] + 1 + j), *state)
                j += 1
            pool = np.concatenate(live, axis=1)
            # every state after its edit goes one symbol on; behind the last one stands the delimiter
            of, k = pool[0], pool[1]
            state_1 = np.stack(self.extend(to_left, symbol(of, exact[of] + 1 + k), *pool[2:])) if len(of) else pool[2:]
            pool = np.vstack([of, k + 1, state_1])
            pool = pool[:, pool[4] > 0]
            done = pool[1] > rest[pool[0]]
            found.append(pool[:3][:, done])
            pool = pool[:, ~done]
        hits = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        every = np.unique(hits[0] * len(self.length) + hits[2] - 1) if hits.shape[1] else np.zeros(0, np.int64)
        return every // len(self.length), every % len(self.length)
