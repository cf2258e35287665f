"""The ten operators on small fixtures, against brute force, round trips and held-out rows, with odd input."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from coursemill.llm import bpe_codec, components, embedding_dedup, line_dedup, minhash, packing, quality_classifier, quality_rules, sharding, toxicity, url_filters
from coursemill.llm.bpe import Encoder, Lexicon, Vocabulary
from coursemill.llm.spans import text_buffer
from coursemill.llm.training import isotonic, platt

DDL = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "don't<|endoftext|>  ok", "x" * 5000, "a b c " * 400, "日本語 テキスト ½", "é ñ 🙂", "it's 'll 's\t x\r\n", "1's 2't"]


def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def frame(spark, texts, ids=None, source="s"):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", source if not callable(source) else source(i), 0) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path())


def test_encoder_equals_library(tokenizer):
    vocabulary = Vocabulary(path())
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "re", "ll", "1", "é", "!", "<|endoftext|>", "ü", "_", "I", "the ", "worthless"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800))]
    words = [w.encode() for w in (" the", "the", " worthless", "a", "ab", "\n", "é")]
    for lexicon in (None, Lexicon(Lexicon.compile(words, vocabulary)), Lexicon(Lexicon.compile([], vocabulary))):
        raw, off = text_buffer(pa.array(texts))
        ids, upto = Encoder(vocabulary, lexicon).texts(raw, off)
        for i, t in enumerate(texts):
            assert ids[upto[i] : upto[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_codec_round_trip(spark, tokenizer):
    df = frame(spark, ODD + ["a", "a"])
    both = bpe_codec.decode(bpe_codec.encode(df, path()), path())
    for r in both.collect():
        t = (ODD + ["a", "a"])[r.doc_id]
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), struct.pack(f"<{len(ids)}I", *ids))
        assert r.decoded == (t or "")
    assert bpe_codec.encode(df.limit(0), path()).count() == 0


def test_lexicon_is_minimal():
    vocabulary = Vocabulary(path())
    lexicon = Lexicon(Lexicon.compile([b"walking", b"talking", b"walked", b"talked"], vocabulary))
    assert len(lexicon.accept) == 9  # one state each behind w or t, a, l, k, i, n, e, the start and one shared end
    raw = np.frombuffer(b"walkingtalkedwalk", dtype=np.uint8)
    got = lexicon.numbers(raw, np.array([0, 7, 13]), np.array([7, 6, 4]))
    assert got.tolist() == [3, 0, -1]


def test_packing(spark, tokenizer):
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choice(["alpha", "beta", "gamma", "x"]) for _ in range(rng.randint(1, 900))) for _ in range(150)), "word " * 5000, "dup", "dup"]
    rows = packing.pack(frame(spark, texts), path(), end_id=2).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    alone = packing.best_fit(np.array([r.length for r in rows]), 1024)[2]
    assert -(-total // 1024) <= len(by_seq) <= len(alone) * 1.1 + 1
    assert packing.pack(frame(spark, ["a"]).limit(0), path(), 2).count() == 0


def test_best_fit():
    where, offset, load = packing.best_fit(np.array([5, 3, 7, 2, 3]), 10)
    assert load.max() <= 10 and load.sum() == 20 and len(load) == 2
    assert sorted(zip(where.tolist(), offset.tolist(), strict=True)) == sorted(set(zip(where.tolist(), offset.tolist(), strict=True)))


def test_sharding(spark):
    texts = [*ODD, *("t" * (i % 90) for i in range(300)), *["same"] * 60]
    df = frame(spark, texts, ids=[*range(312), *[999] * 60])
    for limit in (100, 400, 10**9):
        rows = sharding.shard(df, limit).collect()
        assert len(rows) == len(texts)
        size, n, depth = {}, {}, {}
        for r in rows:
            size[r.shard] = size.get(r.shard, 0) + r.n_bytes
            n[r.shard] = n.get(r.shard, 0) + 1
            depth[r.shard] = r.shard_depth
        assert all(v <= limit or n[k] == 1 for k, v in size.items())
        names = sorted(k for k in size if "." not in k)
        assert not any(b.startswith(a) and a != b for a in names for b in names)  # prefixes do not overlap
    assert {r.shard for r in sharding.shard(df, 10**9).collect()} == {""}
    assert sharding.shard(df.limit(0), 10).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(None, "x" * 30), (None, "x" * 30), (None, None), *[(7, "same")] * 40, *((i, "t" * (i % 50)) for i in range(100))]
    df = spark.createDataFrame([(*r, "s", "d") for r in rows], "doc_id long, text string, shard string, depth string")
    sharding.write_shards(df.repartition(3), 100, f"{tmp_path}/a")
    back = spark.read.parquet(f"{tmp_path}/a")
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in (tmp_path / "a").glob("shard=*"))
    assert sorted(map(str, back.select("doc_id", "text", "depth").collect())) == sorted(map(str, df.select("doc_id", "text", "depth").collect()))
    size = {r.shard: r.n for r in back.selectExpr("shard", "coalesce(octet_length(text), 0) as n").groupBy("shard").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert max(size.values()) <= 100
    names = lambda n: sorted(r.shard for r in sharding.shard(df.repartition(n), 100).collect())
    assert names(1) == names(5)


def lines_of(t, sentences=False):
    units = re.sub(r"([.!?] |\n)" if sentences else r"(\n)", "\\1\x01", t or "").split("\x01")
    out = []  # tiles of lines with a word; blank lines go with the line before
    for u in units:
        if re.search(r"[^\x20\x09-\x0D]", u) or not out:
            if out and not out[-1].strip(" \t\n\x0b\x0c\r"):
                out[-1] += u
            else:
                out.append(u)
        else:
            out[-1] += u
    return [u for u in out if u.strip(" \t\n\x0b\x0c\r")] or out


def without_windows(texts, sentences=False, least_words=0):
    """Brute force: (text, lines removed) of each text, by its place."""
    first, out = {}, []
    for i, t in enumerate(texts):
        tiles = lines_of(t, sentences)
        keys = [u.strip(" \t\n\x0b\x0c\r") for u in tiles]
        gone, own = set(), set()
        for j in range(len(keys) - 2):
            w = tuple(keys[j : j + 3])
            if sum(len(k.split()) for k in w) < least_words:
                continue
            if w in own or first.get(w, i) < i:
                gone |= {j, j + 1, j + 2}
            own.add(w)
        for w in own:
            first.setdefault(w, i)
        out.append((None if t is None else "".join(u for j, u in enumerate(tiles) if j not in gone), len(gone)))
    return out


PASSAGE = "one two three four five.\nsix seven eight nine ten. eleven twelve thirteen.\nsixteen seventeen"


@pytest.mark.parametrize(("sentences", "least_words"), [(False, 0), (True, 0), (True, 10)])
def test_line_dedup(spark, sentences, least_words):
    texts = [f"Intro a b c.\n{PASSAGE}\nend of one", f"Other d e f.\n\n{PASSAGE}\nend of two", "short. text", None, "", "same line of words here now\n" * 5, PASSAGE, "a.\nb.\nc.", "x\n a.\nb.\nc.", "a. b. c.", "d. a. b. c. e."]
    df = frame(spark, [*texts, PASSAGE], ids=[*range(len(texts)), None]).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "__w")
    got = {r.doc_id: r for r in line_dedup.dedup(df, sentences=sentences, least_words=least_words).collect()}
    for i, want in enumerate(without_windows(texts, sentences, least_words)):
        assert (got[i].text, got[i].n_removed) == want, i
    assert got[1].text == "Other d e f.\n\nend of two" and got[6].text == "" and got[None].text == "" and got[0].text == texts[0]
    assert got[8].text == ("x\n a.\nb.\nc." if least_words else "x\n") and got[10].text == ("d. e." if sentences and not least_words else texts[10])
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_line_dedup_of_short_and_common_lines(spark, monkeypatch):
    poem = "".join(f"row {n}.\n" for n in range(60))  # a passage of 120 words in lines of two
    texts = [f"{poem}end of one", f"start\n{poem}end of two", *(f"head {i}\nhome\nabout\nlogin\ntail {i}" for i in range(40)), "home\nabout\nlogin"]
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 10)  # the window of the menu is a hot one
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert got == dict(enumerate(without_windows(texts)))
    assert got[1] == ("start\nend of two", 60) and got[3] == ("head 1\ntail 1", 3) and got[42] == ("", 3)


def test_quality_rules(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [*ODD, *(" ".join(rng.choice(words[: rng.randint(1, 40)]) for _ in range(rng.randint(0, 60))) for _ in range(60)), "a b c d e f g h i j " * 5, "l1 x\nl1 x\n\n\nl2\nl1 x"]
    rows = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts, source=lambda i: None if i % 7 == 0 else f"s{i % 3}")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        covered = {q for j, g in enumerate(grams) if grams.count(g) > 1 for q in range(j, j + 8)}
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def host_rates(rows):
    """Brute force over (host, failures by rule): hosts whose shrunk rate of a rule is above its limit."""
    hosts, bad = {}, set()
    for h, failed in rows:
        if h is not None:
            hosts.setdefault(h, []).append(failed)
    for rule in quality_rules.RULES:
        n = {h: len(v) for h, v in hosts.items()}
        k = {h: sum(f[rule] for f in v) for h, v in hosts.items()}
        total = sum(n.values())
        mean = sum(k.values()) / total
        between = sum(n[h] * (k[h] / n[h] - mean) ** 2 for h in hosts)
        room = total - sum(x * x for x in n.values()) / total - (len(hosts) - 1)
        own = (between / (mean * (1 - mean)) - (len(hosts) - 1)) / room if 0 < mean < 1 and room > 0 else 0
        weight = min(total, max(1, 1 / own - 1)) if own > 0 else total
        for h in hosts:
            rate = (k[h] + mean * weight) / (n[h] + weight)
            if rate - quality_rules.LEVEL * (rate * (1 - rate) / (n[h] + weight + 1)) ** 0.5 > max(quality_rules.LEAST_RATE, quality_rules.TIMES * mean):
                bad.add(h)
    return bad


def test_hosts_decide(spark):
    rng = random.Random(8)
    plain = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(99)) for _ in range(30))
    kinds = {"marks": lambda: plain() + " #### $$$$", "menus": lambda: "\n".join([plain(), "top", "top", "end", "end"]), "runs": lambda: "x" * 900 + " " + plain(), "fine": plain, "tiny": plain}
    texts, sources = [], []
    for host, size in [("marks", 30), ("menus", 25), ("runs", 20), ("fine", 60), *((f"h{i}", 4) for i in range(12))]:
        for i in range(size):
            odd = kinds[host] if host in kinds and i % 5 else rng.choice([plain, plain, plain, kinds["marks"]])
            texts.append(odd())
            sources.append(host)
    texts += [plain() + " ####", plain()]
    sources += ["tiny", None]
    rows = quality_rules.judge(frame(spark, texts, source=lambda i: sources[i])).collect()
    facts = []
    for t, h in zip(texts, sources, strict=True):
        w, ls = t.split(), [x for x in t.split("\n") if x.strip()]
        n, mean = len(w), sum(map(len, w)) / len(w)
        facts.append((h, {"short": n < 20, "repeats": False, "symbols": 10 * len(re.findall(r"[#*$%&|<>]", t)) > n, "lines": 100 * (len(ls) - len(set(ls))) > 30 * len(ls), "word_length": not 3 <= mean <= 12}))
    bad = host_rates(facts)
    assert {"marks", "menus", "runs"} <= bad and "fine" not in bad and "h0" not in bad
    assert {r.doc_id for r in rows if not r.kept} == {i for i, h in enumerate(sources) if h in bad} and not any(r.base_failed for r in rows)
    assert quality_rules.judge(frame(spark, ["a"]).limit(0)).count() == 0
    clash = frame(spark, ["a"]).withColumnsRenamed({"lang": "n_words", "n_chars": "host_rate"})
    assert quality_rules.judge(clash).count() == 1 and quality_rules.kept_documents(clash).columns == clash.columns


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i % 10 else "x", "en", "good", 0) for i in range(200)] + [(1000 + i, "x" if i % 10 else good, "en", "bad", 0) for i in range(200)] + [(2000, good, "en", "new", 0), (2001, good, "en", None, 0)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, DDL)).collect()}
    assert got[1] and not got[0] and not got[1000] and got[2000] and got[2001]
    kept = quality_rules.kept_documents(spark.createDataFrame(rows, DDL))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v}


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_minhash(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # one large group of near copies
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    for _ in range(30):  # pairs near the threshold
        t = [rng.choice(words) for _ in range(60)]
        u = list(t)
        for _ in range(rng.randint(1, 5)):
            u[rng.randrange(len(u))] = rng.choice(words)
        texts += [" ".join(t), " ".join(u).upper()]
    texts += ["only one"] * 30 + ["One", "one"]
    for k in (2, 5):
        sets = [shingles(t, k) for t in texts]
        links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        want = roots(range(len(texts)), links)
        got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), k=k).collect()}
        assert {i: got[i].component_id for i in got} == want
        assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in got)
    odd = minhash.near_duplicates(frame(spark, ["a b c", "a b c", None], ids=[3, None, None]).withColumnRenamed("lang", "rep"), k=2)
    assert sorted(map(tuple, odd.collect()), key=str) == sorted([(3, 2, 3, True), (None, 2, None, True), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0


def test_minhash_without_the_template(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for n in range(150):  # edited independently; the template itself is not a row, and two texts link only by chance
        t = list(base)
        for q in rng.sample(range(200), 6 + n % 2):
            t[q] = f"e{n}x{q}"
        texts.append(" ".join(t))
    sets = [shingles(t, 2) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    monkeypatch.setattr(minhash, "BLOCK", 40, raising=False)  # several blocks
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), k=2).collect()}
    assert got == want
    assert 1 < len(set(want.values())) < len(texts)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(300, 500)] + [(i, i + 1) for i in range(600, 640)] + [(None, 1), (5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    want = roots({x for p in links for x in p if x is not None}, [p for p in links if None not in p])
    touched = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert {r.node: r.root for r in components.components(df).collect()} == {k: v for k, v in want.items() if k in touched}
    assert components.components(df.limit(0)).count() == 0


def test_dense_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(8)
    center = rng.standard_normal(24)
    rows = [(i, (center * 10.0 ** (i % 3) + rng.standard_normal(24) * 0.14 * 10.0 ** (i % 3)).tolist(), 1) for i in range(900)]
    rows += [(900 + i, v, 1) for i, v in enumerate([rows[0][1]] * 5)] + [(950, [1e200] * 24, 2), (951, [2e200] * 24, 2), (952, [1e-200] * 24, 2), (953, [1.0] * 23, 2)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)  # many pairs of blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(40)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df.withColumn("rep", df.label), window=8, passes=6).collect()}
    x = np.array([v for _, v, c in rows if c == 1])
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = x @ x.T >= 0.98
    assert 0.2 < linked.mean() < 1
    want = linked.sum(axis=1) - 1
    assert np.mean([got[r[0]].n_links == n for r, n in zip(rows, want, strict=False)]) > 0.99  # whole, though the window is small
    assert got[950].n_links == 2 and got[952].component_id == 950 and got[953].n_links == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(150):
            v = rng.standard_normal(32)
            rows.append((i, v.astype(np.float32).tolist(), label))
            i += 1
            if rng.random() < 0.4:
                rows.append((i, (v + rng.standard_normal(32) * rng.uniform(0.05, 0.25)).astype(np.float32).tolist(), label))
                i += 1
    same = rng.standard_normal(32).astype(np.float32).tolist()
    rows += [(i + k, same, 1) for k in range(40)]
    i += 40
    rows += [(i, None, 1), (i + 1, [0.0] * 32, 1), (i + 2, [float("nan")] * 32, 1), (i + 3, [None] * 32, 1), (i + 4, same, None), (i + 5, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    sound = [(n, np.array(v, dtype=float), c) for n, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = set()
    for a in range(len(sound)):
        for b in range(a):
            (n, v, c), (m, w, d) = sound[a], sound[b]
            if c == d and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links.add((m, n))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    want = roots([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert all(got[n].n_links <= count[n] for n in count)
    assert sum(got[n].n_links for n in count) >= 0.99 * sum(count.values())
    assert sum(got[n].component_id == want[n] for n in want) >= 0.99 * len(want)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


URLS = ["https://WWW.Example.com/en/1?x=/fr/", "http://a.example.com/en/", "http://b.net/es/1", "http://net/fr/", "http://xnet/fr/", "ftp://q.com", "http://q.com/", "no url", None, "http://a.org?u=http://b.com/", "http://a.example.com/de/#x", "://c.com/p", ""]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("path", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, labels).collect()}
    for i, u in enumerate(URLS):
        host, p = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            p = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + q), h + q, v) for v, h, q in url_filters.RULES if (host == h or host.endswith("." + h)) and p.startswith(q)]
        best = max(fits) if fits else None
        assert got[i] == (host, p, best[1] if best else None, best[2] if best else "allow"), u
    assert url_filters.judge(pages.limit(0), labels).count() == 0


def brute_rules(rows, least, sure):
    """All minimal token sets of at most four tokens that go with bad pages often enough."""
    from itertools import combinations

    found = []
    every = sorted({t for ts, _ in rows for t in ts})
    for n in range(1, 5):
        for c in combinations(every, n):
            hit = [bad for ts, bad in rows if set(c) <= set(ts)]
            if sum(hit) >= least and sum(hit) >= sure * len(hit) and not any(set(f) < set(c) for f in found):
                found.append(c)
    return found


def test_url_rules_are_the_minimal_ones(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(300):
        ts = sorted(set(rng.choices("abcdefgh", k=rng.randint(1, 5))))
        rows.append((ts, {"a", "b"} <= set(ts) and rng.random() < 0.9 or {"c", "d", "e"} <= set(ts) or rng.random() < 0.1))
    df = spark.createDataFrame([(ts, bool(b)) for ts, b in rows], "tokens array<string>, bad boolean")
    share = sum(b for _, b in rows) / len(rows)
    want = brute_rules(rows, 5, max(0.6, 1.5 * share))
    got = {tuple(sorted(r.tokens)) for r in url_filters.mine(df, support=0.0).collect()}
    # of tokens in just the same pages one stands for all; here no two are
    assert got == {c for c in want} and ("a", "b") in got
    blocked = {r.url for r in url_filters.matched(spark.createDataFrame([("".join(ts), ts) for ts, _ in rows], "url string, tokens array<string>").distinct(), url_filters.mine(df, support=0.0)).collect()}
    assert blocked == {"".join(ts) for ts, _ in rows if any(set(c) <= set(ts) for c in want)}


def test_long_urls(spark):
    long = "http://spam.example.biz/" + "/".join(f"{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(5)) + "?" + "&".join(f"q{i}=1" for i in range(20))
    rows = [(i, long) for i in range(12)] + [(100 + i, f"http://site{i}.org/news/{i}") for i in range(40)]
    labels = [(i, 0, 0) for i in range(12)] + [(100 + i, 1, 0) for i in range(40)]
    pages = spark.createDataFrame([*rows, (900, long + "&more=1"), (901, long), (902, None), (None, long)], "page_id long, url string")
    got = [(r.page_id, r.verdict) for r in url_filters.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    assert len(got) == 56 and dict(got)[900] == dict(got)[0] == dict(got)[None] == "block" and dict(got)[902] == dict(got)[100] == "allow"
    few = url_filters.judge(pages.filter("page_id < 2"), spark.createDataFrame(labels[:2], "doc_id long, quality int, toxic int")).collect()
    assert {r.verdict for r in few} == {"allow"}  # two labelled pages are no rule


def test_url_mining(spark):
    rows, bad = [], []
    for i in range(400):
        spam = i % 4 == 0
        rows.append((i, f"http://{'buy' if spam else 'read'}.site{i % 5}.org/{'promo' if spam else 'news'}/{i}"))
        if i % 2 == 0 or i % 4 == 0:
            bad.append((i, 0 if spam else 1, 0))
    pages = spark.createDataFrame([*rows, (900, "http://buy.other.org/promo/x"), (901, "http://buy.other.org/promo/x"), (902, "http://read.site1.org/news/z")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, spark.createDataFrame(bad, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 403 and got[900] == got[901] == got[0] == "block" and got[902] == got[1] == "allow"


def test_calibration():
    x, p = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.all(np.diff(p) >= 0) and p[0] == 0 and p[-1] == 1
    rng = np.random.default_rng(0)
    m = rng.standard_normal(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 1)))).astype(int)
    a, b = platt(m, y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.3


def test_dual_solver_reaches_the_optimum():
    rng = np.random.default_rng(3)
    n = 60
    sets = [np.unique(rng.integers(0, 40, rng.integers(4, 12))) for _ in range(n)]
    y = np.array([int((s < 15).sum() * 2 > len(s)) if rng.random() < 0.9 else int(rng.random() < 0.5) for s in sets])
    flat, off = np.concatenate(sets).astype(np.int32), np.r_[0, np.cumsum([len(s) for s in sets])]
    part = np.arange(n) * 100 // n
    m = quality_classifier.fit(flat, off, y, part)
    learn = part < 80
    x = np.zeros((n, 40))
    for i, s in enumerate(sets):
        x[i, s] = m["ratio"][s]
    x = np.c_[x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12), np.ones(n)][learn]
    sign = np.where(y[learn] == 1, 1.0, -1.0)
    alpha, q = np.zeros(len(x)), (sign[:, None] * x) @ (sign[:, None] * x).T
    for _ in range(20_000):  # plain projected gradient on the dual
        alpha = np.clip(alpha - 0.02 * (q @ alpha - 1), 0, quality_classifier.COST)
    best = 0.5 * alpha @ q @ alpha - alpha.sum()
    w = np.r_[np.divide(m["weight"], m["ratio"], out=np.zeros_like(m["weight"]), where=m["ratio"] != 0)[:40], m["bias"]]
    primal = 0.5 * w @ w + quality_classifier.COST * np.maximum(0, 1 - sign * (x @ w)).sum()
    assert primal <= -best * 1.02 + 1e-6  # within 2 % of the optimum, by duality
    counts = [np.bincount(np.concatenate([s for s, c, k in zip(sets, y, learn, strict=True) if c == v and k]), minlength=40) + 1.0 for v in (1, 0)]
    ratio = np.log(counts[0] / (learn & (y == 1)).sum()) - np.log(counts[1] / (learn & (y == 0)).sum())
    assert np.allclose(np.where(counts[0] + counts[1] > 3, ratio, 0), m["ratio"][:40])


def test_trees_split_as_a_naive_search():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 4))
    y = (x[:, 1] + 0.5 * (x[:, 2] > 0) + 0.3 * rng.standard_normal(300) > 0.4).astype(float)
    trees = toxicity.Trees(x, y)
    bins = trees._bins(x)
    p = 1 / (1 + np.exp(-trees.start))
    g, h = y - p, np.full(300, p * (1 - p) + 1e-6)
    best = (0.0, -1, 0)
    for f in range(4):
        for k in range(toxicity.BINS - 1):
            left = bins[:, f] <= k
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, f, k))
    assert tuple(trees.trees[0][0, :2].astype(int)) == best[1:]
    value = trees.trees[0]
    for row in range(300):  # a walk by hand ends in the leaf whose value is the Newton step of its rows
        node = 0
        while value[node, 0] >= 0:
            node = 2 * node + 1 + int(bins[row, int(value[node, 0])] > value[node, 1])
        assert trees._walk(value, bins[row : row + 1])[0] == value[node, 2]
    loss = lambda m: np.mean(np.log1p(np.exp(-np.where(y == 1, m, -m))))
    assert loss(trees.margin(x)) < 0.6 * loss(np.full(300, trees.start))


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1.0
    score = np.asarray(score)
    for v in np.unique(score):
        order[score == v] = order[score == v].mean()
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(rows, labels, held):
    s = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([v for _, _, v in s])
    rare = int(y.mean() < 0.5)
    assert auc([v for v, _, _ in s], y) > 0.95 and np.mean([p == v for _, p, v in s if v == rare]) > 0.8
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    return sum(p == y for _, p, y in s) / len(s)


def test_quality_classifier(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == 1000
    assert held_out(rows, {r.doc_id: r.quality for r in labels.collect()}, lambda i: zlib.crc32(str(i).encode()) % 5 == 0) > 0.95
    empty = quality_classifier.classify(frame(spark, ODD), labels.limit(0)).collect()
    assert len(empty) == len(ODD) and all(0 <= r.score <= 1 for r in empty)
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = toxicity.classify(docs, labels).collect()
    assert held_out(rows, {r.doc_id: r.toxic for r in labels.collect()}, lambda i: zlib.crc32(str(i).encode()) % 4 == 2) > 0.95
    odd = toxicity.classify(frame(spark, ODD, ids=[None, *range(1, len(ODD))]), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and not odd[0].held_out


def test_digest_of_ids(spark, tokenizer):
    from coursemill.llm import queries

    rows = queries.op3_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
