"""Each stage of the pipeline against a brute-force version on what the stage before kept."""

import re

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from coursemill.llm import quality_classifier  # noqa: E402
from tests.llm.test_operators import DDL, ODD, frame, roots, shingles, without_windows  # noqa: E402


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(k.columns == docs.columns for k in kept[1:-1])
    start, quality, rules, lines, near = map(rows_of, kept[:-1])
    scored = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, labels).collect()}
    assert set(quality) == {i for i, p in scored.items() if p}
    failed = set()
    for i, r in quality.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        seen = {}
        for j, g in enumerate(grams):
            seen.setdefault(g, []).append(j)
        covered = {q for at in seen.values() if len(at) > 1 for j in at for q in range(j, j + 8)}
        if len(w) < 20 or 100 * len(covered) > 30 * len(w):
            failed.add(i)
    assert set(rules) == set(quality) - failed  # no host fails as a whole here
    order = sorted(rules)
    for i, (text, _) in zip(order, without_windows([rules[i].text for i in order]), strict=True):
        assert lines[i].text == text and lines[i].n_chars == len(text) and lines[i].source == start[i].source
    assert set(lines) == set(rules)
    sets = {i: shingles(r.text, 2) for i, r in lines.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(list(sets), links)
    assert set(near) == {i for i in sets if want[i] == i} and all(near[i] == lines[i] for i in near)
    packed = kept[-1].collect()
    assert {r.doc_id for r in packed} == set(near)
    load = {}
    for r in packed:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
    assert max(load.values()) <= 1024


def test_odd_documents(spark, sf):
    odd = frame(spark, [*ODD, *ODD], ids=[*range(len(ODD)), *[None] * len(ODD)], source=lambda i: None)
    for table in (odd, spark.createDataFrame([], DDL)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= max(docs.count() * 20, 1)
            docs = out if out.columns == docs.columns else docs


def test_odd_rows_of_the_near_duplicate_stage(spark, sf):
    rows = [(1, "a b c"), (1, "a b c"), (1, "x y z"), (None, "a b c"), (None, "p q r"), (None, "p q r"), (None, ""), (None, None), (3, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DDL)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()), key=str)
    assert got == sorted([(1, "a b c"), (None, "p q r"), (None, ""), (None, None), (3, ""), (4, None)], key=str)
