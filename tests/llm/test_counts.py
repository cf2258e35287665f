"""Token counts, spelling variants and source divergence against their libraries and brute force."""

import random
import re
import string
import zlib
from collections import Counter as Bag
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from coursemill.llm import packed_terms, source_divergence, spelling_variants, token_counts
from coursemill.llm.bpe import Vocabulary
from coursemill.llm.fm_index import FmIndex
from coursemill.llm.spans import text_buffer
from tests.llm.test_operators import ODD, frame, path


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path())


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = [*string.ascii_letters, " ", "  ", "\n", "'", "s", "re", "ll", "1", "é", "!", "<|endoftext|>", "ü", "_", "the ", "worthless", "aaaa", "anan", "　", "中文", "🙂"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_token_counts_equal_library(tokenizer, monkeypatch):
    texts = [*ODD, *random_texts(600, 5), "ab" * 3000, "<|endoftext|>" * 3, "a<|endoftext|><|endoftext|", "e" * 4001]
    raw, off = text_buffer(pa.array(texts))
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    known = token_counts.Counter(Vocabulary(path()))
    assert known.texts_counts(raw, off).tolist() == want
    assert known.texts_counts(raw, off).tolist() == want  # all words from the memo
    monkeypatch.setattr(token_counts, "MEMO_BITS", 10)  # the memo overflows again and again
    monkeypatch.setattr(token_counts, "CHUNK", 500)
    assert token_counts.Counter(Vocabulary(path())).texts_counts(raw, off).tolist() == want


def test_token_counts_table(spark, tokenizer):
    texts = [*ODD, "dup dup", "dup dup", "word " * 1100]
    df = frame(spark, texts, ids=[*range(len(ODD)), 70, 70, None]).selectExpr("*", "1 as n_tokens", "'x' as over_limit", "2 as n_bytes")
    got = Bag((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, path()).collect())
    counts = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got == Bag((i, len((t or "").encode()), n, n > 1024) for i, t, n in zip([*range(len(ODD)), 70, 70, None], texts, counts, strict=True))
    none = token_counts.count_tokens(df.limit(0), path())
    assert none.count() == 0 and none.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def variants_by_hand(rows, least):
    """word -> (n, n_near, form, form_n, root), by comparing all pairs of words."""
    counts = Bag()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    counts = {w: n for w, n in counts.items() if n >= least}
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near = lambda a, b: a != b and (sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else (a in cut(b) or b in cut(a)))
    found = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in found.items() if vs}
    form = {w: b for w, b in best.items() if counts[b] >= 5 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n, len(found[w]), form.get(w), counts[form[w]] if w in form else None, root(w)) for w, n in counts.items()}


def variant_words(seed):
    rng = random.Random(seed)
    stems = ["aaaaaa", "ababab", "letters", "straße", "éééééé", "abcdefghij", "x" * 40]
    words = list(stems)
    for _ in range(260):
        w = list(rng.choice(words))
        k = rng.randint(0, len(w) - 1)
        edit = rng.choice("idr")
        w[k : k + (edit != "i")] = [] if edit == "d" else [rng.choice("abcéß÷")]
        words.append("".join(w))
    return [w for w in words if len(w) >= 4]


@pytest.mark.parametrize("group, index_words", [(10_000, 40_000), (4, 40)])
def test_spelling_variants(spark, group, index_words):
    rng = random.Random(group)
    words = variant_words(9)
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + rng.choice([" ", "1", "-"]).join(["Letters"] * 9)) for i in range(120)]
    rows += [(None, None), (None, "Letters étters" * 2), (7, ""), (7, "ÀÀÀÀÀÀ1àààààà"), (500, "aaaaaab " * 700), (501, "aaaaaac " * 120), (502, "y" * 900 + " " + "y" * 901)] + [(503, "y" * 900)] * 6 + [(504, "y" * 899)] * 5
    rows += [(505, "chainaa " * 6 + "chainab " * 40 + "chainbb " * 300)]
    got = spelling_variants.variants(frame(spark, [t for _, t in rows], ids=[i for i, _ in rows]), group=group, index_words=index_words).collect()
    want = variants_by_hand(rows, 5)
    assert len(got) == len(want) and any(r.root not in (r.word, r.form) for r in got)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want


def test_halves_are_cut_until_they_are_small(spark):
    words = sorted({"commonbeginning" + a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"})
    met = spelling_variants.halves(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), group=20)
    wide = met.groupBy("key").count().join(met.filter("short - head - tail > 1").select("key").distinct(), "key")
    assert wide.filter("count > 20").isEmpty()
    got = {r.word: r.n_near for r in spelling_variants.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 20, 50).collect()}
    assert got == {w: 7 + 7 + 3 for w in words}


def test_spelling_variants_empty(spark):
    got = spelling_variants.variants(frame(spark, [None, "", "short words"]).selectExpr("*", "'x' as word", "1 as n", "1 as key"))
    assert got.count() == 0 and got.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_fm_index_intervals():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(90)})
    index, text = FmIndex(words), "\0" + "\0".join(words) + "\0"
    symbols = sorted(set(text))
    suffixes = sorted(text[i:] for i in range(len(text)))
    for _ in range(200):  # a pattern grows to both sides; its interval is that of all suffixes that start with it
        i = rng.randint(0, len(text) - 1)
        a, b, state = i, i, index.whole(1)
        while b - a < 5:
            left = rng.random() < 0.5
            if (a == 0) if left else (b == len(text)):
                break
            c = text[a - 1] if left else text[b]
            a, b = (a - 1, b) if left else (a, b + 1)
            state = index.extend(left, np.array([symbols.index(c)]), *state)
            hits = [k for k, s in enumerate(suffixes) if s.startswith(text[a:b])]
            assert (int(state[0][0]), int(state[2][0])) == (hits[0], len(hits))


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergence_by_hand(rows, least):
    """The rows of the audit in exact fractions."""
    langs = {}
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        langs.setdefault(lang or "", []).append((source or "", terms))
    out = set()
    for lang, docs in langs.items():
        held = Bag(t for _, terms in docs for t in set(terms))
        kept = sorted((t for t, d in held.items() if d >= least), key=str.encode)
        count = {None: Bag(t for _, terms in docs for t in terms)}
        for source, terms in docs:
            count.setdefault(source, Bag()).update(terms)
        total = {s: sum(c[t] for t in kept) for s, c in count.items()}
        rate = {s: {t: 1 + int(Fraction(10**9 * (c[t] + 5), total[s] + 5 * len(kept))) for t in kept} for s, c in count.items()}
        for s in count:
            if s is None:
                continue
            pairs = [(sum(abs(rate[s][t] - rate[o][t]) for t in kept), o) for o in count if o not in (s, None)]
            terms = [(rate[s][t] - rate[None][t], t) for t in kept if count[s][t] and rate[s][t] > rate[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else 50]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("sources, terms", [(128, 4096), (2, 7)])
def test_source_divergence(spark, monkeypatch, sources, terms):
    monkeypatch.setattr(source_divergence, "SOURCES", sources)
    monkeypatch.setattr(source_divergence, "TERMS", terms)
    rng = random.Random(3)
    vocab = [w * k for w in ("a", "Bc", "é", "ß中", "zzz") for k in (1, 2, 4, 8, 9, 16, 17, 33)] + [f"{c}x" for c in string.ascii_letters]
    rows = [(rng.choice([" ", "1", "_"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 40))), lang, f"s{rng.randint(0, 6)}" if lang != "b" else rng.choice(["t", None])) for lang in ("a", "b", None) for _ in range(60)]
    rows += [("", "none", "u"), (None, "none", "v"), ("qq", "none", "w"), ("zzz", "alone", None), (None, None, "empty"), ("12 34", "a", "digits"), ("word " * 9, "a", "s0"), ("word " * 9, "a", "s0"), ("é" * 4000, "a", "s1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").selectExpr("*", "1 as term", "'x' as item", "2 as p")
    got = [tuple(r) for r in source_divergence.divergence(df, least_docs=5).collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_by_hand(rows, 5)


def test_source_divergence_empty(spark):
    got = source_divergence.divergence(frame(spark, []))
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_packed_terms_sort_by_bytes():
    rng = random.Random(8)
    terms = [("".join(rng.choice("abÿ") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 40, 200]))))[:200].encode() for _ in range(900)] * 2
    raw = np.frombuffer(b" ".join(terms), dtype=np.uint8)
    lengths = np.array([len(t) for t in terms])
    starts = np.cumsum(lengths + 1) - lengths - 1
    first, n = packed_terms.counted(raw, starts, lengths)
    assert {terms[i]: k for i, k in zip(first.tolist(), n.tolist(), strict=True)} == Bag(terms)
    for order, new in packed_terms.sorted_buckets(raw, starts, lengths):
        inside = [terms[i] for i in order.tolist()]
        assert inside == sorted(inside) and all(a < b for a, b, n in zip(order[:-1], order[1:], new[1:], strict=True) if not n)
