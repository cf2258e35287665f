"""Byte-level BPE on arrays of words: a vocabulary file, the pre-tokenizer, a lexicon transducer and exact merges.

The vocabulary is a public tokenizer file (a parameter, never trained here). A chunk of texts is cut into words with
array operations over code points, equal words are merged into one, and each distinct word gets its ids from
1. the lexicon, a minimal acyclic transducer of frequent words (`Lexicon`), memory-mapped by every worker,
2. the memo of words that this worker has merged before (bounded), or
3. exact merging by rank.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import regex

from coursemill.llm.spans import Memo, ragged, span_hashes

#: Words above this many bytes are merged one at a time with a heap.
LONG_WORD = 96
#: Bytes of text worked on at once.
CHUNK = 700_000
NONE = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100."""
    plain = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    out = np.zeros(0x110000, dtype=np.uint8)
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = value  # the run skips surrogates, which no text holds
    return out


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        token = [b""] * size
        for text, i in ids.items():
            token[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            token[i] = text.encode()
        self.token_data = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.token_len = np.fromiter(map(len, token), dtype=np.int64, count=size)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = size
        keys = np.array([ids[a] * size + ids[b] for a, b in merges], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.pair = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys, made, strict=True))}
        # open addressing: a slot holds a pair's key and rank
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.made = made
        seat = _seat(keys, self.bits)
        self.slot_key[seat], self.slot_rank[seat] = keys, np.arange(len(keys))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of the pairs, NONE where there is no merge."""
        keys = left * self.size + right
        slot = _slots(keys, self.bits)
        held = self.slot_key[slot]
        out = np.where(held == keys, self.slot_rank[slot], NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.slot_rank[slot[hit]]
            on = ~hit & (held >= 0)
            todo, slot = todo[on], slot[on]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merges of one word by a heap of pairs (rank, place) over linked tokens."""
        tokens = [int(self.of_byte[b]) for b in word]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i: self.pair.get(tokens[i] * self.size + tokens[after[i]]) if after[i] < n else None
        heap = [(p[0], i) for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if tokens[i] < 0 or not (p := pair(i)) or p[0] != rank:
                continue
            j = after[i]
            tokens[i], tokens[j], after[i] = p[1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, (p[0], k))
        return [t for t in tokens if t >= 0]

    def merge(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words by exact merges, all words a step at a time: flat ids and the number of each word."""
        n = len(starts)
        counts = np.zeros(n, dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        short = np.flatnonzero(lengths <= LONG_WORD)
        word = np.repeat(short, lengths[short])
        token = self.of_byte[raw[ragged(starts[short], lengths[short])]]
        while len(token):
            rank = np.full(len(token), NONE, dtype=np.int32)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.ranks(token[same], token[same + 1])
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(word)])
            least_all = np.repeat(least, sizes)
            ended = least_all == NONE
            if ended.any():
                done.append((word[ended], token[ended]))
            best = np.flatnonzero((rank == least_all) & ~ended)
            best = best[np.r_[True, word[best][1:] != word[best][:-1]]] if len(best) else best  # the leftmost of each word
            token[best] = self.made[rank[best]]
            keep = ~ended
            keep[best + 1] = False
            word, token = word[keep], token[keep]
        for i in np.flatnonzero(lengths > LONG_WORD):
            ids = self.merge_long(raw[starts[i] : starts[i] + lengths[i]].tobytes())
            done.append((np.full(len(ids), i), np.array(ids, dtype=np.int64)))
        if not done:
            return np.zeros(0, np.int64), counts
        word = np.concatenate([w for w, _ in done])
        token = np.concatenate([t for _, t in done])
        order = np.argsort(word, kind="stable")
        np.add.at(counts, word, 1)
        return token[order], counts

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        return self.token_data[ragged(self.token_start[ids], self.token_len[ids])]


def pretokens(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and lengths of the words of texts that lie one after the other and end at `ends` (byte offsets).

    The rule is the public one of byte-level BPE: contractions ('s 't 're 've 'm 'll 'd), letters, numbers or other
    marks with one space before them, and white space; of white space before a word the last character stands apart.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte where each character starts
    cls = char_classes()[code]
    n = len(code)
    first = np.zeros(n + 1, dtype=bool)  # a text starts here (or all end)
    first[0] = first[n] = True
    first[np.searchsorted(at, ends[ends < len(raw)])] = True
    start = first[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    white = cls == 3
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])  # white space right before a word of the same text
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    # contractions: a lone apostrophe that starts a word, with letters behind it
    q = np.flatnonzero((code == 0x27) & start)
    q = q[q + 1 < n]
    q = q[(cls[q + 1] == 1) & ~first[q + 1]]
    if len(q):
        a = code[q + 1]
        b = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], code[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, k in ((one, 2), (two, 3)):
            p = q[hit]
            start[p + 1] = False
            p = p[p + k < n]
            start[p + k] = True
    heads = at[np.flatnonzero(start)]
    return heads, np.diff(np.r_[heads, len(raw)])


def distinct(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words as one (by 128 bits of hash and the length): the first of each, and how often it occurs."""
    a, b = span_hashes(raw, starts, lengths, both=True)
    codes, unique = pd.factorize(a ^ (b * np.uint64(3)))
    first = np.empty(len(unique), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first, np.bincount(codes)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first slot of each key in an open-addressing table of 2 ** bits slots."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _seat(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slot that each of the distinct keys gets by linear probing."""
    held, seat = np.full(1 << bits, -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    todo, slot = np.arange(len(keys)), _slots(keys, bits)
    while len(todo):
        free = held[slot] < 0
        held[slot[free]] = keys[todo[free]]
        won = held[slot] == keys[todo]
        seat[todo[won]] = slot[won]
        todo, slot = todo[~won], (slot[~won] + 1) & ((1 << bits) - 1)
    return seat


class Lexicon:
    """A minimal acyclic transducer from words to ids, in one flat int32 file.

    `compile` adds the words in byte order and shares equal suffix states as it goes. Each state counts the words
    that lead from it to an end, each transition outputs how many words sort before it among its siblings, so the sum
    of outputs along a path is the word's number, which points at its ids. Transitions lie in an open-addressing
    table by (state, byte); the rows of the file are key, next state and output, then the states' accepting flags.
    """

    HEAD = 5

    def __init__(self, flat: np.ndarray):
        self.bits, states, words, n_ids, self.root = (int(x) for x in flat[: self.HEAD])
        size = 1 << self.bits
        ends = np.cumsum([self.HEAD, size, size, size, states, words + 1, n_ids])
        self.key, self.next, self.out, self.accept, self.id_start, self.ids = (flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.load(path, mmap_mode="r"))

    @staticmethod
    def compile(words: Iterable[bytes], vocabulary: Vocabulary) -> np.ndarray:
        """The flat array for the words; an empty list gives a lexicon that knows no word."""
        words = sorted(set(words) - {b""})
        # minimal automaton by sorted insertion: a state is (accepting, ((byte, state), ...)), registered once
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        counts: list[int] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(int(node[0]) + sum(counts[t] for _, t in node[1]))
            return register[key]

        path: list[list] = [[False, []]]  # the open states of the latest word
        latest = b""
        for w in words:
            k = 0
            while k < min(len(w), len(latest)) and w[k] == latest[k]:
                k += 1
            for i in range(len(latest), k, -1):
                child = freeze(path.pop())
                path[-1][1].append((latest[i - 1], child))
            path += [[False, []] for _ in w[k:]]
            path[-1][0] = True
            latest = w
        for i in range(len(latest), 0, -1):
            child = freeze(path.pop())
            path[-1][1].append((latest[i - 1], child))
        root = freeze(path.pop())
        moves = [(s * 256 + x, t, n) for s, (final, arcs) in enumerate(states) for (x, t), n in zip(arcs, accumulate([int(final), *(counts[t] for _, t in arcs[:-1])]), strict=False)]
        bits = max(4, (2 * len(moves)).bit_length())
        table = np.zeros((3, 1 << bits), dtype=np.int64)
        table[0] = -1
        if moves:
            rows = np.array(moves, dtype=np.int64).T
            table[:, _seat(rows[0], bits)] = rows
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids, each = vocabulary.merge(raw, np.cumsum(lengths) - lengths, lengths)
        head = [bits, len(states), len(words), len(ids), root]
        return np.concatenate([np.array(head), *table, np.array([f for f, _ in states]), np.r_[0, np.cumsum(each)], ids]).astype(np.int32)

    def numbers(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it: all words walk the automaton a byte at a time."""
        n = len(starts)
        out = np.full(n, -1, dtype=np.int64)
        live, state = np.arange(n), np.full(n, self.root, dtype=np.int64)
        total = np.zeros(n, dtype=np.int64)
        k = 0
        while len(live):
            ended = lengths[live] == k
            if ended.any():
                good = ended & (self.accept[state] == 1)
                out[live[good]] = total[good]
                live, state, total = live[~ended], state[~ended], total[~ended]
            key = state * 256 + raw[starts[live] + k]
            slot = _slots(key, self.bits)
            while (away := np.flatnonzero((self.key[slot] != key) & (self.key[slot] >= 0))).size:
                slot[away] = (slot[away] + 1) & ((1 << self.bits) - 1)
            on = self.key[slot] == key
            live, slot = live[on], slot[on]
            state, total = self.next[slot].astype(np.int64), total[on] + self.out[slot]
            k += 1
        return out


#: A worker remembers up to 0.6 * 2 ** MEMO_BITS merged words.
MEMO_BITS = 18


class Encoder:
    """Texts to ids for one worker; keeps a bounded memo of the words it has met."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._forget()

    def _forget(self) -> None:
        self.memo = Memo(MEMO_BITS)
        self.store, self.fill = np.zeros(1 << 20, dtype=np.int32), 0
        self.start, self.count = (np.zeros(self.memo.room, dtype=np.int64) for _ in range(2))

    def _ids(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their numbers for distinct words: from the lexicon, or merged."""
        if self.lexicon is None:
            return self.vocabulary.merge(raw, starts, lengths)
        number = self.lexicon.numbers(raw, starts, lengths)
        hit, miss = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        merged, each = self.vocabulary.merge(raw, starts[miss], lengths[miss])
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begin[hit] = self.lexicon.id_start[number[hit]] + len(merged)
        count[hit] = self.lexicon.id_start[number[hit] + 1] - self.lexicon.id_start[number[hit]]
        begin[miss], count[miss] = np.cumsum(each) - each, each
        return np.concatenate([merged, self.lexicon.ids])[ragged(begin, count)], count

    def words(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words in order and the number of ids of each word."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        a, b = span_hashes(raw, starts, lengths, both=True)
        place = self.memo.find(a, b)
        if (place < 0).any():
            new = np.flatnonzero(place < 0)
            new = new[np.unique(a[new] ^ (b[new] * np.uint64(3)), return_index=True)[1]]
            if self.memo.size + len(new) > self.memo.room:
                self._forget()
                new = np.unique(a ^ (b * np.uint64(3)), return_index=True)[1]
            ids, count = self._ids(raw, starts[new], lengths[new])
            while self.fill + len(ids) > len(self.store):
                self.store = np.r_[self.store, np.zeros_like(self.store)]
            n = self.memo.size
            while n + len(new) > len(self.start):
                self.start, self.count = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.count))
            self.store[self.fill : self.fill + len(ids)] = ids
            self.start[n : n + len(new)] = self.fill + np.cumsum(count) - count
            self.count[n : n + len(new)] = count
            self.fill += len(ids)
            self.memo.add(a[new], b[new])
            place = self.memo.find(a, b)
        count = self.count[place]
        return self.store[ragged(self.start[place], count)], count

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows and the n + 1 offsets of the rows in them; special tokens' strings become their ids."""
        cuts, fixed = self._cuts(raw, offsets)
        ids, ends = [], []
        total, i = 0, 0
        while i < len(cuts) - 1:
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK, side="right")) - 1)
            part = raw[cuts[i] : cuts[j]]
            own = cuts[i + 1 : j + 1] - cuts[i]
            starts, lengths = pretokens(part, own)
            if fixed:  # a special token's string is a part of its own
                which = np.searchsorted(own, starts, side="right")
                plain = ~np.isin(which + i, list(fixed))
                starts, lengths = starts[plain], lengths[plain]
            flat, count = self.words(part, starts, lengths)
            upto = np.r_[0, np.cumsum(count)][np.searchsorted(starts, own)]
            for k in sorted(k for k in fixed if i <= k < j):
                p = upto[k - i]
                flat = np.insert(flat, p, fixed[k])
                upto[k - i :] += 1
            ids.append(flat)
            ends.append(upto + total)
            total += len(flat)
            i = j
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        upto = np.r_[0, *ends].astype(np.int64)
        return flat, upto[np.searchsorted(cuts, offsets, side="right") - 1] if len(cuts) > 1 else np.zeros(len(offsets), np.int64)

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Where parts begin that can be cut into words on their own: rows, special tokens, and pieces of huge rows.

        A huge row is cut between a letter and the space behind it, where a word ends whatever stands around it.
        """
        cuts, special = [offsets], {}
        data = None
        for text, i in self.vocabulary.special.items():
            data = raw.tobytes() if data is None else data
            p = data.find(text.encode())
            while p >= 0:
                if offsets[np.searchsorted(offsets, p, side="right")] >= p + len(text.encode()):
                    special[p] = i
                    cuts.append(np.array([p, p + len(text.encode())]))
                p = data.find(text.encode(), p + len(text.encode()))
        for row in np.flatnonzero(np.diff(offsets) > 2 * CHUNK):
            a, b = int(offsets[row]), int(offsets[row + 1])
            body = raw[a:b]
            letter = ((body | 32) >= 97) & ((body | 32) <= 122)
            safe = np.flatnonzero(letter[:-1] & (body[1:] == 32)) + 1 + a
            taken = safe[np.unique(np.searchsorted(safe, np.arange(a + CHUNK, b, CHUNK))[:, None].clip(max=max(len(safe) - 1, 0)))] if len(safe) else safe
            inside = [p for p in special if a <= p < b]
            cuts.append(taken if not inside else np.array([t for t in taken.tolist() if not any(p < t < p + 64 for p in inside)], dtype=np.int64))
        every = np.unique(np.concatenate(cuts))
        return every, {int(np.searchsorted(every, p)): i for p, i in special.items()}


def chunked_words(raw: np.ndarray, offsets: np.ndarray, encoder: Encoder) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of the rows and how often each occurs; special tokens' strings do not count."""
    cuts, fixed = encoder._cuts(raw, offsets)
    words: dict[bytes, int] = {}
    i = 0
    while i < len(cuts) - 1:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK, side="right")) - 1)
        part, own = raw[cuts[i] : cuts[j]], cuts[i + 1 : j + 1] - cuts[i]
        starts, lengths = pretokens(part, own)
        if fixed:
            plain = ~np.isin(np.searchsorted(own, starts, side="right") + i, list(fixed))
            starts, lengths = starts[plain], lengths[plain]
        if len(starts):
            first, count = distinct(part, starts, lengths)
            data = part.tobytes()
            for s, k, c in zip(starts[first].tolist(), lengths[first].tolist(), count.tolist(), strict=True):
                w = data[s : s + k]
                words[w] = words.get(w, 0) + c
        i = j
    return list(words), np.fromiter(words.values(), dtype=np.int64, count=len(words))
