"""Small literal cases of the operators, ties and empty input included."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from coursemill.functions import html, text
from coursemill.functions.text import match_text, parse_date
from coursemill.operators import catalog, documents, progress, scoring, taxonomy, timeline
from coursemill.sources import readers
from coursemill.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_slugs(spark):
    cases = {"Lógica de Hoare": "logica-de-hoare", "": "untitled", None: "untitled", "  A__b -- c!": "a-b-c", "Unidade 1 — Métodos": "unidade-1-metodos"}
    for a, b in cases.items():
        assert one(spark, text.slugify, a) == b
    assert one(spark, text.unit_slug, "Unidade 1 — Métodos") == "unidade-01-metodos"


def test_match_text_variants(spark):
    assert one(spark, text.match_text, "Lógica Propocional: C++ / v1.2") == "logica proposicional c v1 2"
    assert one(spark, lambda c: text.match_text(c, "c"), "propocional") == "propocional"
    assert one(spark, lambda c: text.match_text(c, "b"), "A–B/c.d") == "a-b/c.d"
    assert one(spark, lambda c: text.match_text(c, "d"), "C# v1.2") == "c# v1.2"


def test_dates(spark):
    assert str(one(spark, text.parse_date, "2026-04-22 19h")) == "2026-04-22"
    assert str(one(spark, text.parse_date, "30/03/2026")) == "2026-03-30"
    assert one(spark, text.parse_date, "31/02/2026") is None
    b = one(spark, text.period_bounds, "de 03/04/2026 a 30/03/2026")
    assert (str(b.start), str(b.end)) == ("2026-03-30", "2026-04-03")
    w = one(spark, text.date_range_signal, "Semana 30/03/2026 a 03/04/2026")
    assert (str(w.start), str(w.end)) == ("2026-03-30", "2026-04-03")


def test_kind_marker(spark):
    r = one(spark, text.kind_marker, "Feriado {kind=suspension}")
    assert (r.kind, r.content, r.ignored) == ("suspension", "Feriado", True)


def test_page_names(spark):
    cases = {"x_page_22_fig.png": 23, "page-7.png": 7, "banner-2026.png": None, "doc-p12.png": 12, "img.png": None}
    for a, b in cases.items():
        assert one(spark, text.page_from_name, a) == b, a


def test_latex(spark):
    assert one(spark, text.latex_corruption, "a $x$ b").detected is False
    bad = one(spark, text.latex_corruption, r"a $x and \begin{a} ∀x")
    assert bad.detected and "odd_dollars" in bad.signals and "environments" in bad.signals
    assert one(spark, text.latex_corruption, "```\n$\n```").score == 0


def test_page_ranges(spark):
    cases = {"": None, "1": [0], "1,3": [0, 2], "0-2": [0, 1, 2], "3-1, 2": [0, 1, 2], "2,2": [1], "x": None}
    for a, b in cases.items():
        assert one(spark, catalog.page_list, a) == b, a
    assert one(spark, catalog.page_list_valid, "1-x") is False and one(spark, catalog.page_list_valid, "") is True


def test_categories(spark):
    cases = {"P1.pdf": "provas", "cap1.pdf": "material-de-aula", "lista.pdf": "listas", "x.py": "codigo-professor", "foo": "outros", "gabarito.pdf": "gabaritos", "projeto.pdf": "trabalhos"}
    for a, b in cases.items():
        assert one(spark, catalog.category_of_name, a) == b, a
    assert one(spark, catalog.title_of_name, "a/b/lista-de_exercicios.pdf") == "Lista De Exercicios"


def test_winners(spark):
    rows = [("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 3.0), ("b", 2, 1.0), ("c", 1, 1.0), ("d", 1, 0.0)]
    df = spark.createDataFrame(rows, "k string, ord int, score double")
    for f in (scoring.winner,):
        for n in (1, 7):
            got = {r.k: r for r in f(df.repartition(n), ["k"], "topic", "ord", ["ord"]).collect()}
            assert got["a"].ord == 1 and got["a"].ambiguous and got["a"].confidence <= 0.45
            assert got["b"].ord == 1 and not got["b"].ambiguous and got["b"].confidence == 1.0
            assert got["c"].confidence == 1.0 and not got["c"].ambiguous
            assert got["d"].ambiguous


def test_topics_and_units(spark):
    e = spark.createDataFrame([("c", "1", "Aula", "# Lógica de Hoare\ntexto sobre pré e pós condições")], "course_id string, doc_id string, title string, markdown string")
    t = spark.createDataFrame([("c", 1, "logica-de-hoare", "Lógica de Hoare", "u2", "topic", []), ("c", 2, "conjuntos", "Conjuntos indutivos", "u1", "topic", ["Isabelle"])], "course_id string, topic_ord int, topic_slug string, topic_label string, unit_slug string, kind string, aliases array<string>")
    r = scoring.best_topic(scoring.topic_candidates(scoring.signals(e), t)).first()
    assert r.topic_slug == "logica-de-hoare" and r.topic_unit == "u2" and not r.ambiguous
    u = spark.createDataFrame([("c", 1, "u1", "Unidade 1", ["lógica"]), ("c", 2, "u2", "Unidade 2", ["lógica"])], "course_id string, unit_ord int, unit_slug string, unit_title string, topics array<string>")
    body = spark.createDataFrame([("c", "1", "", "Revisão geral de lógica.")], e.schema)
    r = scoring.best_unit(scoring.unit_candidates(scoring.signals(body), scoring.unit_index(u))).first()
    assert r.unit_ambiguous and r.unit_confidence < 0.5


PLAN = """### Unidade 1 - Métodos formais
1.1. Lógica de Hoare
1.1.1. Pré e pós condições
Unidade 2: Verificação
- Provas assistidas
## Bibliografia
- fim
Básica
SILVA, J. Um livro. 2020.
segunda linha
Complementar
SOUZA, A. Outro. 2019.
"""


def test_plans(spark):
    df = spark.createDataFrame([("c", PLAN)], "course_id string, plan string")
    rows = taxonomy.plan_units(df).orderBy("unit_ord", "topic_ord").collect()
    assert [(r.unit_slug, r.topic_code, r.topic_text, r.depth) for r in rows] == [("unidade-01-metodos-formais", "1.1", "Lógica de Hoare", 0), ("unidade-01-metodos-formais", "1.1.1", "Pré e pós condições", 1), ("unidade-02-verificacao", None, "Provas assistidas", 0)]
    refs = {(r.section, r.reference) for r in taxonomy.bibliography(df).collect()}
    assert ("basic", "SILVA, J. Um livro. 2020. segunda linha") in refs and ("complementary", "SOUZA, A. Outro. 2019.") in refs


def test_glossary(spark):
    g = spark.createDataFrame([("c", "## Assistente de prova\n**Sinônimos:** Isabelle; theorem proving\nUnidade: 1\nDefinição: um programa.\n## Outro\n")], "course_id string, glossary string")
    rows = taxonomy.glossary(g).orderBy("n").collect()
    assert rows[0].synonyms == ["Isabelle", "theorem proving"] and rows[0].definition == "um programa." and rows[1].synonyms == []
    t = spark.createDataFrame([("c", "assistente-de-prova", "Assistente de Prova", "unidade-1")], "course_id string, topic_slug string, topic_label string, unit_slug string")
    assert taxonomy.glossary_aliases(t, taxonomy.glossary(g)).first().aliases == ["Isabelle", "theorem proving"]


SCHEDULE = """| # | Data | Conteúdo |
|---|---|---|
| 1 | 02/03/2026 | Lógica de Hoare: regras |
| 2 | 04/03/2026 | Lógica de Hoare: exemplos |
| 3 | 09/03/2026 | Exercícios |
| 4 | 11/03/2026 | P1 |
| 5 | 16/03/2026 | Conjuntos indutivos e funções recursivas |
| 6 | 18/03/2026 |
"""


def test_schedules(spark):
    rows = timeline.candidate_rows(timeline.read_schedule(spark.createDataFrame([("c", SCHEDULE), ("d", None)], "course_id string, schedule string")))
    got = rows.orderBy("row_index").collect()
    assert len(got) == 6 and got[5].content == "" and str(got[0].date_dt) == "2026-03-02"
    blocks = timeline.block_attributes(timeline.segment_blocks(rows)).orderBy("block_ord").collect()
    assert [b.source_rows for b in blocks] == [[0, 1, 2], [3], [4]]
    assert blocks[0].block_id == "bloco-01" and blocks[0].period_label == "02/03/2026 a 09/03/2026"


def test_inherit(spark):
    rows = [("c", i, u, 0.1, s) for i, (u, s) in enumerate([("", True), ("", True), ("u1", False), ("", True), ("", True), ("", False), ("", True), ("u2", False)])]
    df = spark.createDataFrame(rows, "course_id string, block_ord int, unit_slug string, unit_confidence double, soft boolean")
    units = [r.unit_slug for r in timeline.inherit_unit(df).orderBy("block_ord").collect()]
    want = [r[2] for r in rows]
    for i, r in enumerate(rows):  # in place, as the rule says
        if not want[i] and r[4]:
            want[i] = (want[i - 1] if i else "") or (rows[i + 1][2] if i + 1 < len(rows) else "")
    assert units == want


def test_session_signals(spark):
    s = one(spark, text.session_signals, "30/03/2026: aula\nAtividade assíncrona\n01/04/2026: lab")
    assert {(x.kind, str(x.date)) for x in s} == {("class", "2026-03-30"), ("async", "None"), ("class", "2026-04-01")}
    assert one(spark, text.session_signals, "30/03/2026 ⊘") == []


def test_assessments(spark):
    plan = "P1: unidades 9\n## Avalia\u00e7\u00e3o\n- **P1: unidades 1 a 3**\nP2: prova sobre conteudos\n2 e 4\n\nProva 3 - prova 3 com 3, 5 e 40\nG1: nada\nexame final abrange tudo de 02\nP 01: repete 7\nBibliografia\nP3: unidade 5"
    plans = spark.createDataFrame([("c", plan), ("d", "P1: unidade 1"), ("e", None), ("f", "AVALIACAO\nP1: 1 2 1\nConteudo\nAvalia\u00e7\u00e3o\nP2: 3")], "course_id string, plan string")
    got = [(r.course_id, r.label, r.label_slug, r.description, r.declared_unit_numbers) for r in timeline.assessments(plans).orderBy("course_id", "ord").collect()]
    assert got == [
        ("c", "P1", "p1", "unidades 1 a 3", [1, 3]),
        ("c", "P2", "p2", "prova sobre conteudos 2 e 4", [2, 4]),
        ("c", "PROVA 3", "prova 3", "prova 3 com 3, 5 e 40 G1: nada", [3, 5]),  # of its own number only the first goes
        ("c", "PF", "pf", "abrange tudo de 02", [2]),
        ("c", "P1", "p1", "repete 7", [7]),
        ("f", "P1", "p1", "1 2 1", [2, 1]),
    ]


def test_manual_blocks(spark):
    blocks = spark.createDataFrame([("c", "bloco-01", 1, "u", False), ("c", "bloco-03", 3, "v", False), ("c", "bloco-04", 4, "u", True), ("c", "x", 5, "u", None), ("d", "bloco-09", 1, "u", False)], "course_id string, block_id string, block_ord int, unit_slug string, administrative boolean")
    rows = [(1, "bloco-01", "v", "bloco-01"), (2, "BLOCO-2", "u", "x"), (3, "bloco-02", "", "bloco-03"), (4, "bloco-2", None, "bloco-03"), (5, "bloco-03", "u", "bloco-03"), (6, "bloco-2", "v", None), (7, "2", "u", None), (8, " x ", "", "x"), (9, "bloco-0", "", None), (10, "bloco-09", "", None), (11, None, "", None)]
    entries = spark.createDataFrame([("c", i, b, u) for i, b, u, _ in rows], "course_id string, entry_id int, manual_block string, manual_unit string")
    got = {r.entry_id: r.block_id for r in scoring.manual_blocks(entries, blocks, ["entry_id"]).collect()}
    assert got == {i: want for i, *_, want in rows}


def test_write_index_keeps_other_courses(spark, tmp_path):
    index = lambda *courses: spark.createDataFrame([(c, [1, 2]) for c in courses], "course_id string, items array<int>")
    readers.write_index(index("a", "b"), f"{tmp_path}/index")
    readers.write_index(index("b", "c").withColumn("items", F.array(F.lit(7))), f"{tmp_path}/index")
    got = {r.course_id: r["items"] for r in spark.read.json(f"{tmp_path}/index").collect()}
    assert got == {"a": [1, 2], "b": [7], "c": [7]}


def test_unit_anchors(spark):
    units = spark.createDataFrame([("c", 1, "u1", "Unidade 01: Logica formal", ["Provas por tabelas"]), ("c", 2, "u2", "Unidade 2 - Conjuntos", []), ("c", 3, "u3", "Outra", ["grafos"]), ("d", 1, "u1", "Unidade 1: x", None)], "course_id string, unit_ord int, unit_slug string, unit_title string, topics array<string>")
    texts = ["aula de abertura", "logica formal", "unidade 1 e unidade 11", "grafos e provas por tabelas", "unidade 02", "conjuntos finitos", "un 2 fim", "", "tabelas"]
    rows = spark.createDataFrame([("c", i, t, f"d{i // 2}" if i != 5 else " ") for i, t in enumerate(texts)], "course_id string, row_index int, content_norm string, date_text string")
    scored = timeline.unit_anchor_scores(rows, timeline.unit_descriptors(units))
    assert {(r.unit_ord, r.row_index): r.score for r in scored.collect()} == {(1, 1): 8 + 4 + 6, (1, 2): 10, (1, 3): 8 + 6, (2, 5): 8 + 4 + 3, (2, 6): 10, (3, 3): 8 + 3}
    starts = timeline.unit_start_anchors(scored.withColumn("row_index", F.col("row_index").cast("long")))
    got = {r.unit_slug: (r.start_row, r.end_row, r.period, r.dates) for r in timeline.unit_row_periods(starts, rows).collect()}
    # the third unit starts before the second: the second ends at its last anchor
    assert got == {"u1": (1, 4, "d0 a d2", "d0, d1, d2"), "u2": (5, 6, "d3", "d3"), "u3": (3, 3, "d1", "d1")}


def test_sessions_and_cards(spark):
    rows = [
        (1, 0, "02/03/2026", "Card: Lógica de Hoare; Tópico: triplas"), (1, 1, "04/03/2026", "Aula 04/03/2026: triplas e provas; atividade assíncrona: ler Hoare"), (1, 2, "04/03/2026", "Aula 04/03/2026: triplas e provas"),
        (1, 3, "", "async - vídeo {kind=g2}; 31/02/2026: data que não há"), (2, 4, "09/03/2026", "suspensa ⊘"), (2, 5, "nada", "texto solto"),
    ]
    df = spark.createDataFrame([("c", b, i, t, d) for b, i, d, t in rows], "course_id string, block_no int, row_index int, content string, date_text string")
    df = df.withColumns({"content_norm": match_text("content"), "date_dt": parse_date("date_text"), "ignored": F.lit(False)})
    got = {r.block_id: r for r in timeline.block_attributes(df).collect()}
    one = got["bloco-01"]
    assert [(c.source_kind, c.normalized_title, c.title) for c in one.card_evidence] == [("card-title", "logica de hoare", "Lógica de Hoare"), ("topic-title", "triplas", "triplas")]
    said = [(s.session_id, str(s.date), s.kind, s.label, [c.title for c in s.card_evidence]) for s in one.sessions]
    assert said == [
        ("bloco-01-sessao-2026-03-02", "2026-03-02", "class", "card logica de hoare", ["Lógica de Hoare"]),
        ("bloco-01-sessao-2026-03-04", "2026-03-04", "class", "triplas e provas", ["triplas"]),
        ("bloco-01-sessao-2026-03-04", "2026-03-04", "class", "aula 04 03 2026 triplas e provas", ["triplas"]),
        ("bloco-01-sessao-async-01", "None", "async", "ler hoare", []),
        ("bloco-01-sessao-04", "None", "class", "data que nao ha", []),
    ]
    assert one.sessions[1].signals[:4] == ["2026-03-04", "aula", "triplas e provas", "triplas"] and "e provas" in one.sessions[1].signals
    assert got["bloco-02"].sessions == [] and got["bloco-02"].card_evidence == []


def test_documents(spark):
    pages = spark.createDataFrame([("a", p) for p in (1, 2, 3, 7, 3, -1)], "doc string, page int")
    assert documents.collapse_pages(pages, ["doc"]).first().pages == "1-3,7"
    md = "# A\n12\n---\ntexto\n\n\n\n\nfim\n```\n12\n```\n$$\n3\n$$"
    d = spark.createDataFrame([("1", md)], "doc_id string, markdown string")
    assert documents.clean_noise(d, ["doc_id"]).first().markdown == "# A\ntexto\n\n\nfim\n```\n12\n```\n$$\n3\n$$"
    s = spark.createDataFrame([("1", "## A\nx\n```\n## no\n```\n## B\ny"), ("2", "## A")], "doc_id string, markdown string")
    once = documents.executive_summary(s, ["doc_id"])
    twice = documents.executive_summary(once, ["doc_id"])
    assert once.orderBy("doc_id").collect() == twice.orderBy("doc_id").collect()
    first = once.orderBy("doc_id").first().markdown
    assert "- A\n- B" in first and "- no" not in first
    marked = spark.createDataFrame([("1", "3\n" + "-" * 48 + "\n![](a/b.png)\n4\n" + "-" * 48 + "\n![](b.png) ![](c.png)")], "doc_id string, markdown string")
    assert {(r.fname, r.page) for r in documents.image_page_map(marked, ["doc_id"], offset=20).collect()} == {("b.png", 23), ("c.png", 24)}


def test_rescue_and_repair(spark):
    df = spark.createDataFrame([("1", "logica formal\n$x$ logica", "lógica formal\noutra")], "doc_id string, advanced string, base string")
    r = documents.line_rescue(df, ["doc_id"], "doc_id string").first()
    assert r.markdown == "lógica formal\n$x$ logica" and r.n_rescued == 1
    assert one(spark, documents.repair_mojibake, "LÃ³gica") == "Lógica"
    assert one(spark, documents.unicode_math, "se ∀x e $a ≤ b$") == "se $\\forall$x e $a \\leq  b$"


def test_images(spark):
    i = spark.createDataFrame([("e", "a", 23, "h"), ("e", "b", 24, "h"), ("e", "c", 25, "k")], "doc_id string, fname string, page int, sha1 string")
    assert {(r.fname, tuple(r.other_pages)) for r in documents.duplicate_images(i).collect()} == {("a", (24,)), ("b", (23,))}
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (300).to_bytes(4, "big") + (200).to_bytes(4, "big") + b"\x08\x06"
    f = readers.image_facts(spark.createDataFrame([("a", bytearray(png)), ("b", bytearray(b"x"))], "fname string, content binary")).orderBy("fname").collect()
    assert (f[0].width, f[0].height, f[1].width) == (300, 200, None)


def test_orphans(spark):
    docs = spark.createDataFrame([(1, "intro\n## Grafos\nbusca em grafos\n\n## Logica\nhoare\n"), (2, "nada"), (3, None)], "doc_id int, markdown string")
    orphans = spark.createDataFrame([(1, "a.png", "Busca em grafos dirigidos"), (1, "b.png", "sem assunto"), (2, "c.png", "outro")], "doc_id int, fname string, description string")
    got = {r.doc_id: r.markdown for r in documents.append_orphans(docs, documents.place_orphans(orphans, documents.split_sections(docs, ["doc_id"]))).collect()}
    assert got[1] == "intro\n## Grafos\nbusca em grafos\n\n> **Image (a.png):** Busca em grafos dirigidos\n\n## Logica\nhoare\n\n## Other images\n\n> **Image (b.png):** sem assunto\n"
    assert got[2] == "nada\n\n## Other images\n\n> **Image (c.png):** outro\n" and got[3] in (None, "")


def test_html(spark):
    page = "<html><head><title>T &amp; x</title><meta name=description content=d></head><body><nav><p>menu</p></nav><div class=sidebar><p>side</p></div><article><h1>Head</h1><p>One<p>Two<ul><li>a</li></ul><script>x</script><table><tr><td>1<td>2</tr></table></article><footer><p>foot</p></footer></body></html>"
    df = spark.createDataFrame([(1, "https://Ex.org/a", page), (2, None, None)], "page_id long, url string, html string")
    r = html.page_blocks(df).orderBy("page_id").collect()
    assert r[0].title == "T & x" and r[0].host == "ex.org" and r[0].blocks == ["# Head", "One", "Two", "- a", "1 | 2"]
    assert r[1].blocks == []


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"course": {"course_slug": "c"}, "entries": [{"id": "1", "title": "A", "tags": "x; y", "category": "exams", "document_profile": "math_light", "unknown": 1}, {"id": "2"}], "logs": ["a", "b"]}))
    rows = readers.read_manifest(spark, str(tmp_path / "m.json")).orderBy("entry_ord").collect()
    assert rows[0].manual_tags == ["x", "y"] and rows[0].category == "provas" and rows[0].document_profile == "math_heavy" and rows[1].enabled
    code = tmp_path / "code"
    for name in ("a.py", "node_modules/b.js", ".git/c.py", "d.txt", "src/e.hpp"):
        (code / name).parent.mkdir(parents=True, exist_ok=True)
        (code / name).write_text("x")
    assert {(r.path, r.language) for r in readers.read_code(spark, str(code)).collect()} == {("a.py", "python"), ("src/e.hpp", "cpp")}
    (tmp_path / "md").mkdir()
    (tmp_path / "md/x.md").write_text("# A")
    assert readers.read_markdown(spark, str(tmp_path / "md")).first().markdown == "# A"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.py", "print(1)")
        z.writestr("build/b.py", "x")
    zips = spark.createDataFrame([("z", bytearray(data.getvalue())), ("bad", bytearray(b"no"))], "path string, content binary")
    got = {(r.archive, r.path, r.error is None) for r in readers.expand_zip(zips).collect()}
    assert got == {("z", "a.py", True), ("bad", None, False)}
    book = json.dumps({"metadata": {"kernelspec": {"language": "julia"}}, "cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"text": "2"}]}]})
    n = one(spark, readers.compact_notebook, book)
    assert n.language == "julia" and n.markdown == "# t\n\n```julia\n1+1\n```\n\n```text\n2\n```"
    assert one(spark, readers.compact_notebook, "no json").markdown == "no json"


def test_progress(spark):
    outline = spark.createDataFrame([("u", t, i) for i, t in enumerate("abcd")], "unit string, topic_slug string, ord int")
    states = spark.createDataFrame([("a", "compreendido", 2), ("c", "em_progresso", 1)], "topic_slug string, status string, n_sessions long")
    board = progress.board(outline, states, ["topic_slug"])
    assert [r.status for r in board.orderBy("ord").collect()] == ["compreendido", "pendente", "em_progresso", "pendente"]
    gate = progress.unit_gate(board, ["unit"]).first()
    assert not gate.may_close and gate.open_topics == ["b", "c", "d"]
    assert progress.unit_gate(board, ["unit"], force=True).first().may_close
    i = spark.createDataFrame([("---\nunit: u\nstatus: novo\n---\nbody",)], "text string")
    r = progress.read_imports(i).first()
    assert r.errors == ["topic_slug", "status"] and r.body == "body" and len(r.date) == 10
    t = spark.createDataFrame([("c", i, d) for i, d in enumerate([0, 1, 1, 2, 0, 1])], "course_id string, topic_ord int, depth int")
    assert [r.label for r in progress.outline_labels(t, ["course_id"]).orderBy("topic_ord").collect()] == ["1", "1.1", "1.2", "1.2.1", "2", "2.1"]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("u", f"t{i % 3}", i, "s" + str(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "unit string, topic string, ord int, status string")
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.stream_study_sessions(stream, ["unit", "topic"], str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    got = jobs.current_states(spark.read.parquet(str(tmp_path / "t")), ["unit", "topic"])
    want = jobs.study_states(df, ["unit", "topic"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, catalog.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    tags = spark.createDataFrame([(["a", " b "], ["b", "c"], "d, a; e")], "m array<string>, a array<string>, l string")
    assert tags.select(catalog.effective_tags(F.col("m"), F.col("a"), F.col("l"), 3).alias("t")).first().t == "a; b; c"
