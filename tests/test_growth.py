"""Steps whose cost must grow with the input and no faster, and cases that larger tables brought up."""

import datetime as dt
import random
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from coursemill.functions import html, text
from coursemill.operators import progress, taxonomy, timeline


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_keep_unfinished_references(spark):
    pages = [(1, "http://a.b", "<title>A &amp; B &lt;c&gt; &amp</title><p>x &amp y"), (2, "http://a.b", "<title>T&amp;amp; & &copy</title>"), (3, "http://a.b", "<title>open &amp; &amp")]
    r = {x.page_id: x for x in html.page_blocks(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert r[1].title == "A & B <c> &amp" and r[2].title == "T&amp; & &copy"


def test_signal_terms_split_words_once(spark):
    df = spark.createDataFrame([("Aula de álgebra",)], "t string").select(text.signal_terms("t").alias("s"))
    assert df.first().s == ["aula de algebra", "aula", "de", "algebra", "aula de", "de algebra"]
    assert plan_of(df).count("regexp_replace") <= 1


def test_cards_do_not_reach_over_signals(spark):
    rows = [("c", 0, 0, "Aula: to ineare eronhe in eron", "", None), ("c", 0, 1, "Card: In inea", "", None), ("c", 0, 2, "Card: to ineare", "", None)]
    df = spark.createDataFrame(rows, "course_id string, block_no int, row_index int, content string, date_text string, date_dt date")
    df = df.withColumns({"content": F.concat(F.when(F.col("row_index") == 0, "atividade assíncrona: to ineare eronhe in eron").otherwise(F.col("content"))), "ignored": F.lit(False)}).withColumn("content_norm", text.match_text("content"))
    sessions = timeline.block_attributes(df).first().sessions
    assert [[c.normalized_title for c in s.card_evidence] for s in sessions if s.kind == "async"] == [["to ineare"]]


def test_assessments_are_not_broadcast(spark):
    plans = spark.createDataFrame([("c", "Avaliação\nP1: unidades 1 e 2\nBibliografia")], "course_id string, plan string")
    rows = spark.createDataFrame([("c", 1, "prova 1", dt.date(2026, 4, 1))], "course_id string, row_index int, content_norm string, date_dt date")
    periods = spark.createDataFrame([("c", 2, dt.date(2026, 5, 1))], "course_id string, unit_number int, start date")
    dated = timeline.assessment_rows(timeline.assessments(plans), rows)
    early = timeline.assessment_conflicts(dated, periods)
    assert "Broadcast" not in plan_of(dated) and len(plan_of(early)) < 60_000
    assert [(r.label_slug, r.unit_number) for r in early.collect()] == [("p1", 2)]


def test_aliases_count_once_of_equal_terms(spark):
    n = 2500
    topics = spark.range(n).select(F.lit("c").alias("course_id"), F.concat(F.lit("t"), "id").alias("topic_slug"), F.lit("grafos dirigidos").alias("topic_label"), F.lit("u").alias("unit_slug"))
    terms = spark.range(n).select(F.lit("c").alias("course_id"), F.lit("Grafos").alias("term"), F.lit(None).cast("string").alias("unit_hint"), F.array(F.lit("rede"), F.lit("Rede")).alias("synonyms"))
    began = time.time()
    got = taxonomy.glossary_aliases(topics, terms).collect()
    assert len(got) == n and all(r.aliases == ["Grafos", "Rede"] for r in got) and time.time() - began < 25


def test_tags_are_named_as_by_each_tag(spark):
    rng = random.Random(3)
    words = ["grafo", "arvore", "rede", "busca", "de", "c", "fila", "pilha", "hash"]
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    tags = [f"{rng.choice(['topico', 'ferramenta', 'tipo'])}:{text(3).replace(' ', '-')}" for _ in range(60)]
    texts = [text(9) for _ in range(120)]

    def names(tag, t):
        kind, phrase = tag.split(":")[0], tag.split(":")[1].replace("-", " ")
        long, held = [w for w in phrase.split() if len(w) >= 4], [w for w in t.split() if len(w) >= 4]
        one = len(long) == 1 and len(long[0]) >= 5 and long[0] in held
        loose = phrase in t or one or (len(long) >= 2 and all(w in held for w in long))
        return phrase != "" and kind != "tipo" and (one if kind == "topico" and len(long) == 1 else loose)

    want = {t: [*dict.fromkeys(g for g in tags if names(g, t))][:6] for t in texts}
    entries = spark.createDataFrame([("c", i, t, "", "x") for i, t in enumerate(texts)] + [("d", 900, "grafo", "", "x"), (None, 901, "grafo", "", "x")], "course_id string, entry_id int, title string, head_text string, category string")
    got = {r.entry_id: r.auto_tags for r in taxonomy.auto_tags(entries, spark.createDataFrame([("c", tags)], "course_id string, tags array<string>")).collect()}
    assert len(got) == 122 and got[900] == got[901] == [] and all(got[i] == want[t] for i, t in enumerate(texts)) and any(want.values())


def test_outline_labels_sort_once(spark):
    rows = [("a", i, d) for i, d in enumerate([1, 0, 1, 1, 2, 0, 2, 1, 3, 3, 0])] + [("b", 0, 0)]
    df = progress.outline_labels(spark.createDataFrame(rows, "course_id string, topic_ord int, depth int"), ["course_id"])
    assert plan_of(df).count("Sort [") == 1
    got = [r.label for r in df.filter("course_id = 'a'").orderBy("topic_ord").collect()]
    assert got == ["1.1", "1", "1.1", "1.2", "1.2.1", "2", "2.1.1", "2.1", "2.1.1.1", "2.1.1.2", "3"]


def test_schedule_rows_come_in_parts(spark, monkeypatch):
    seen = []
    frame = spark.createDataFrame([("c", "")], "course_id string, html string")
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, run, schema: seen.append(run) or self)
    html.schedule_rows(frame)
    line = '<tr><td><span id="x_lblData">01/03/2026</span></td><td><span id="x_lblDescricao">Aula</span></td></tr>'
    pages = pd.DataFrame({"course_id": ["c"], "html": [f'<table id="dgAulas"><tr><th>x</th></tr>{line * 9000}</table>']})
    parts = list(seen[0](iter([pages])))
    assert sum(map(len, parts)) == 9000 and max(map(len, parts)) <= html.ROWS_AT_ONCE and parts[-1]["row_index"].max() == 8999


def test_topics_meet_by_few_and_by_many_anchors(spark, monkeypatch):
    from coursemill.operators import scoring

    docs = spark.createDataFrame([("c", 1, "Um texto sobre logica de hoare e p 1"), ("c", 2, "# Conjuntos\nindutivos e mais"), ("c", 3, "xlogica dex"), ("c", 4, None)], "course_id string, doc_id int, markdown string").selectExpr("*", "'' title", "'' category")
    topics = spark.createDataFrame([("c", 1, "topic-1", "logica de", "u", "topic", ["p 1"]), ("c", 2, "conjuntos-indutivos", "Conjuntos indutivos", "u", "subtopic", []), ("c", 3, "outro", "nada disso", "u", "topic", [])], "course_id string, topic_ord int, topic_slug string, topic_label string, unit_slug string, kind string, aliases array<string>")
    best = lambda: {r.doc_id: (r.topic_slug, round(r.best, 6)) for r in scoring.best_topic(scoring.topic_candidates(scoring.signals(docs), topics)).collect()}
    few = best()
    monkeypatch.setattr(scoring, "FEW_ANCHORS", 0)
    assert few == best() and few[1][0] == few[3][0] == "topic-1" and few[2][0] == "conjuntos-indutivos"


def test_lead_and_headings_of_long_texts(spark):
    from coursemill.functions import text as X

    texts = ["a b" * 4000, " \n" * 9000 + "word " * 3000, "---\nk: v\n---\n" + "um dois  tres " * 900, "# A\n\nx\n## B #\n", "short", None]
    whole = lambda s: " ".join(re.sub(r"^---\r?\n.*?\r?\n---\r?\n?", "", s or "", flags=re.S).split())
    want = [w if len(w := whole(s)) <= 2600 else re.sub(r"\s+\S*$", "", w[:2600]) for s in texts]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", X.lead_text("s").alias("lead"), X.headings("s").alias("h")).orderBy("i").collect()
    assert [r.lead for r in got] == want and [r.h for r in got][3] == ["A", "B #"]


def test_pairs_of_entries_and_blocks_are_worked_out_once(spark, monkeypatch):
    from coursemill.plans import jobs, registry

    names, held = [], jobs.staged
    monkeypatch.setattr(jobs, "staged", lambda df, name: (names.append(name), held(df, name))[1])
    registry.QUERIES["file_map"](spark, "/root/testdata/sf0.001")
    assert names.count("pairs") == 1


def test_tool_names_are_counted_without_sorting_words(spark):
    s = spark.createDataFrame([("c", 1, "use o Foo aqui\nplugin Foo e x2"), ("c", 2, "o plugin foo, IsaBelle\nfoo")], "course_id string, source int, text string")
    df = taxonomy.tool_candidates(s)
    got = {(r.name, r.sources, r.context) for r in df.collect()}
    assert {("x2", 1), ("isabelle", 1)} <= {x[:2] for x in got} and plan_of(df).count("SortAggregate") == 0


def test_headings_of_one_long_line_meet_topics(spark):
    long = " ".join(f"palavra{i}" for i in range(20_000))
    h = spark.createDataFrame([("c", f"{long} grafos dirigidos", 1), ("c", "Outra coisa", 2)], "course_id string, heading string, ord int")
    t = spark.createDataFrame([("c", "grafos", 1, "topic", "Grafos dirigidos")], "course_id string, topic_slug string, topic_ord int, kind string, topic_label string")
    start = time.time()
    assert [(r.ord, r.topic_slug, r.points) for r in taxonomy.heading_support(h, t).collect()] == [(1, "grafos", 8.0)]
    assert time.time() - start < 60
    key = spark.createDataFrame([("c", "k", "norma", ["norma"])], "course_id string, key string, norm string, stems array<string>")
    assert taxonomy.near_texts(key, key).columns == ["course_id", "l_key", "r_key"]


def test_texts_are_handed_on_in_small_parts(spark):
    from pyspark.sql.types import StringType

    from coursemill.functions import batches
    from coursemill.operators import documents

    t = spark.range(0, 300, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("a ≤ b "), F.lit(3000))).alias("t"))
    got = t.select("id", documents.unicode_math(F.col("t")).alias("m")).collect()
    assert all(r.m == (r"a $\leq$ b " * 3000 if r.id % 7 else None) for r in got) and len(got) == 300
    assert spark.range(5).select(batches.by_parts(F.col("id").cast("string"), lambda s: s + "!", StringType()).alias("x")).count() == 5


def test_latex_signs_are_read_once(spark):
    rows = [(1, "a $ b { c"), (3, "```$```"), (4, "{x} y := {z}"), (5, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", text.latex_corruption("t").alias("x")).select("i", "x.score", "x.detected")
    assert plan_of(df).count("```.*?```") == 1
    assert {r.i: (r.score, r.detected) for r in df.collect()} == {1: (35, True), 3: (0, False), 4: (8, False), 5: (0, False)}


def test_texts_of_cards_are_cut_into_words_once(spark):
    from coursemill.operators import scoring

    texts = spark.createDataFrame([("c", 1, "um texto de logica"), ("c", 2, "um de"), ("c", 3, "xlogica formalx")], "course_id string, doc_id int, text_norm string")
    cards = spark.createDataFrame([("c", "logica formal", "card")], "course_id string, card_norm string, kind string")
    df = scoring.card_hits(texts, cards, ["doc_id"])
    assert {r.doc_id: r.hits[0].points for r in df.collect()} == {1: 0.19, 3: 0.53} and plan_of(df).count("split(text_norm") <= 4


def test_descriptions_are_moved_once_for_both_steps(spark):
    from coursemill.plans import registry

    df = registry.QUERIES["near_descriptions"](spark, "/root/testdata/sf0.001")
    assert plan_of(df).split("Initial Plan")[-1].count("Exchange") == 1


def test_headings_of_courses_are_neither_moved_nor_written(spark, monkeypatch):
    from coursemill.operators import profiles

    rng = random.Random(5)
    words = ["grafos", "arvores", "arv", "redes", "redesenho", "busca", "para", "1", "unidade 2", "fila", "pilha", "Lógica", "é"]
    texts = lambda k: [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(k)]
    frame = lambda rows: spark.createDataFrame(rows, "course_id string, text string")
    c = frame([(x, t) for x in "ab" for t in texts(12)])
    h = frame([(x, t) for x in "abn" for t in [*texts(150), *(f"xyz{i} wvu{i}" for i in range(1500))]] + [("n", None), (None, "grafos soltos"), ("a", "Uso de Gephi redes")])
    own = spark.createDataFrame([("a", "tool", "gephi"), ("b", "cue", "busca"), ("b", "whole", "fila pilha"), ("a", "slug", "grafos-redes")], "course_id string, kind string, word string")
    vocabulary = profiles.course_vocabulary(h.select("course_id"), overrides=own)
    rows, write = [], profiles.staged
    monkeypatch.setattr(profiles, "staged", lambda df, *a: (out := write(df, *a), rows.append(out.count()))[0])
    tags = lambda: {r.course_id: r.tags for r in profiles.course_tags(c, h.filter("coalesce(course_id, '') != 'n'"), vocabulary).collect()}
    got = tags()
    assert max(rows) < 500 and "ferramenta:gephi" in got["a"] and len(got["a"]) > 10
    assert "Exchange" not in plan_of(profiles.scan(h, vocabulary))
    alone = {r.course_id: r.tags for r in profiles.course_tags(c, h, vocabulary).collect()}
    assert {k: alone[k] for k in "ab"} == got and len(alone["n"]) > 1300
    hits = lambda: sorted((r.course_id or "", r.text, [tuple(x) for x in r.hits]) for r in profiles.scan(h, vocabulary).collect())
    few = hits()
    # the ways for many words and many candidates give the same
    monkeypatch.setattr(profiles, "MOST_WORDS", 0)
    assert few == hits() and got == tags()
    monkeypatch.setattr(taxonomy, "MOST_BASES", 0)
    assert got == tags()
    monkeypatch.undo()
    assert got == tags()


def test_stems_of_prefixed_texts(spark):
    texts = ["1.2. Grafos dirigidos", "Unidade 3 — Árvores e grafos", "TEMA 4: busca", "Especificação de sistemas", "unidades 3 e 4", "- tópicos 5 -", "tópico 5 redes", "  7 filas", None, "para os grafos"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.filter(text.tokens(text.match_text(taxonomy.strip_topic_prefix(F.col("t")), "c")), lambda x: ~x.isin("sobre", "para", "entre"))
    got = df.select(taxonomy.stems("t").alias("a"), F.array_distinct(F.transform(plain, lambda x: F.substring(x, 1, 5))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and got[0].a == ["grafo", "dirig"]


def test_rare_words_of_lines_are_not_moved(spark, monkeypatch):
    rng = random.Random(7)
    often = [f"{a}{b}word" for a in "abcdefgh" for b in "abcde"]
    rows = [(c, f"{' '.join(rng.choices(often, range(1, 41), k=6))} rare{c}{i} seldom{i % 900}") for c in ("x", "y", "z") for i in range(1500)]
    rows += [("x", "crowded " * 900), ("y", "beside " * 40 + "tied " * 40), ("few", "eins zwei drei zwei vier vier"), (None, "null null"), ("none", "")]
    lines = spark.createDataFrame(rows, "course_id string, line string").repartition(4)
    want = {(r.course_id, r.token): (r.n, r["rank"]) for r in taxonomy.heading_cues(lines).collect() if r.course_id}
    counted, write = {}, taxonomy.staged
    monkeypatch.setattr(taxonomy, "staged", lambda df, name: (out := write(df, name), counted.update({name: out.count()}))[0])
    got = lambda: {(r.course_id, r.token): (r.n, r["rank"]) for r in taxonomy.staged_cues(lines).collect()}
    for buckets in (200, 4096, 1):
        monkeypatch.setattr(taxonomy, "BUCKETS", buckets)
        assert got() == want and ("x", "crowded") in want and ("few", "drei") in want
        assert counted["counted"] < 8 * 24 * 4 + 4 * buckets
    monkeypatch.setattr(taxonomy, "MOST_LIKELY", 0)
    assert {k: v for k, v in got().items() if k[0]} == want
