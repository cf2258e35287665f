"""Rules of scores, tags and tools against plain Python versions on small fixtures, and the whole jobs on literal courses."""

import datetime as dt
import random
import re
import unicodedata

from pyspark.sql import functions as F

from coursemill.functions import vocab
from coursemill.operators import dealing, profiles, scoring, taxonomy, timeline
from coursemill.plans import jobs


def norm(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower().replace("propocional", "proposicional")
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t)).strip()


def words(t, least=4):
    return [w for w in t.split() if len(w) >= least]


PIECES = ["grafo", "grafos", "arvore", "logica", "hoare", "de", "para", "busca", "em", "largura", "conjunto", "indutivo", "formal", "x1", "sobre", "lista", "passo"]
ENTRY_DDL = "course_id string, entry_id long, title string, markdown string, category string, manual_tags array<string>, auto_tags array<string>, tags string, raw_target string"


def fixture(seed, n=40):
    rng = random.Random(seed)
    some = lambda a, b: " ".join(rng.choice(PIECES) for _ in range(rng.randint(a, b)))
    entries = []
    for i in range(n):
        md = f"{'# ' + some(1, 4) if rng.random() < 0.5 else ''}\n{some(0, 25)}\n{'## ' + some(1, 3) if rng.random() < 0.4 else ''}\n{some(0, 20)}"
        entries.append((f"c{i % 2}", i, some(0, 4), md, rng.choice(["listas", "provas", "outros"]), [some(1, 2)] if rng.random() < 0.3 else [], [some(1, 2)] if rng.random() < 0.3 else None, some(1, 2) if rng.random() < 0.2 else None, some(1, 2) if rng.random() < 0.2 else None))
    topics = []
    for i in range(14):
        label = some(1, 3) if i else "formal logica"  # one of general words alone
        topics.append((f"c{i % 2}", i, norm(label).replace(" ", "-") if rng.random() < 0.7 else "", label, f"u{i % 3}", i % 3, rng.choice(["topic", "subtopic"]), [some(1, 2) for _ in range(rng.randint(0, 2))]))
    return entries, topics


TOPIC_DDL = "course_id string, topic_ord long, topic_slug string, topic_label string, unit_slug string, unit_ord int, kind string, aliases array<string>"


def signals(e):
    _, _, title, md, category, manual, auto, legacy, raw = e
    heads = [re.sub(r"\s+", " ", m[1]).strip() for line in md.splitlines() if (m := re.match(r"^#{1,6}\s+(.+?)\s*$", line))][:8]
    s = {"title": norm(title), "headings": norm(" ".join(heads)), "lead": norm(md), "category": norm(category), "manual_tags": norm("; ".join(manual or [])), "auto_tags": norm("; ".join(auto or [])), "legacy_tags": norm(legacy), "raw": norm(raw), "body": norm(md)}
    s["tags"] = " ".join(x for x in (s["manual_tags"], s["auto_tags"], s["legacy_tags"]) if x)
    return s


def topic_score(s, t):
    _, _, slug, label, _, _, kind, aliases = t
    phrases = [(norm(label), 1.0), (norm(slug.replace("-", " ")), 0.65), *((norm(a), 0.82) for a in aliases)]
    hold = lambda text, p: bool(p) and (p in text if " " in p else p in words(text))
    score = sum(w * share for f, w in scoring.TOPIC_WEIGHTS.items() for p, share in phrases if hold(s[f], p))
    exact = score > 0
    mine = {w for p, _ in phrases for w in words(p) if w not in vocab.UNIT_GENERIC}
    k = len(mine & {w for f in scoring.TOPIC_WEIGHTS for w in words(s[f])})
    score += (0.9 if k else 0) if len(mine) == 1 else 1.4 + 0.22 * k if k >= len(mine) else 0.9 + 0.18 * k if k >= 2 else 0.25 if k else 0
    score += 0.08 * (s["category"] in ("listas", "gabaritos") and k > 0) + 0.04 * (kind == "subtopic")
    if not exact:
        score *= 0.72 * (0.68 if k <= 1 else 1) * (0.88 if s["auto_tags"] and k <= 1 else 1) * (0.9 if s["legacy_tags"] else 1)
    return score


def test_topic_scores_equal_all_pairs(spark):
    entries, topics = fixture(5)
    got = {}
    frame = scoring.topic_candidates(scoring.signals(spark.createDataFrame(entries, ENTRY_DDL)), spark.createDataFrame(topics, TOPIC_DDL), rest=3)
    for r in scoring.best_topic(frame).collect():
        got[r.entry_id] = ([(t.topic_ord, -t.neg) for t in r.topics], r.topic_slug, r.best, r.second)
    for e in entries:
        want = sorted(((-topic_score(signals(e), t), t[1]) for t in topics if t[0] == e[0]))
        mine, _, best, second = got[e[1]]
        assert abs(best + want[0][0]) < 1e-9 and abs(second + want[1][0]) < 1e-9, e
        assert [o for o, _ in mine[:3]] == [o for _, o in want[:3]] and all(abs(a + b) < 1e-9 for (_, a), (b, _) in zip(mine[:3], want[:3], strict=True))


def unit_facts(topics):
    units = {}
    for c, o, _, label, slug, u, _, _ in topics:
        units.setdefault((c, u), {"slug": slug, "phrases": []})["phrases"].append((o, norm(label)))
    for (c, _), x in units.items():
        x["phrases"] = [p for _, p in sorted(x["phrases"]) if p]
        x["title"] = x["phrases"][0] if x["phrases"] else ""
        good = lambda p: [w for w in words(p) if w not in vocab.UNIT_GENERIC]
        x["words"] = {p for p in x["phrases"] if " " not in p} | {w for p in x["phrases"] for w in good(p)}
        x["counted"] = {w for p in [x["title"], *x["phrases"]] for w in good(p) if not w.isdigit()}
    for (c, _), x in units.items():
        df = {w: sum(w in y["counted"] for (d, _), y in units.items() if d == c) for w in x["counted"]}
        x["weight"] = {w: 1 / n for w, n in df.items()}
        x["rare"] = [w for w, n in df.items() if n == 1 and len(w) >= 5]
    return units


def phrase_points(text, p, weight):
    if p in text:
        return 3.8
    own = [w for w in words(p) if w not in vocab.UNIT_NEUTRAL]
    hits = [weight.get(w, 1.0) for w in own if w in words(text)]
    return 0 if not hits else 1.15 * hits[0] if len(own) == 1 else 1.15 + 0.95 * sum(hits) if len(hits) == len(own) else 0.85 * sum(hits) if len(hits) >= 2 else 0


def unit_score(s, x):
    score, exact, matched = 0.0, 0, set()
    if len([w for w in x["title"].split() if len(w) >= 5]) >= 3:
        score += sum(p for f, p in (("body", 1.1), ("lead", 1.6), ("headings", 1.8), ("title", 1.0)) if x["title"] in s[f])
    for p in x["phrases"]:
        rung = next((w for f, w in scoring.PHRASE_LADDER if p in s[f]), None)
        exact += rung is not None
        score += rung if rung is not None else sum(w * phrase_points(s[f], p, x["weight"]) for f, w in scoring.PHRASE_SHARES.items())
    for t in x["words"]:
        for f, w in scoring.TOKEN_WEIGHTS.items():
            if t in words(s[f]):
                score += w * x["weight"].get(t, 1.0) * (0.2 if t in vocab.UNIT_NEUTRAL else 1)
                matched |= {t} - set(vocab.UNIT_NEUTRAL)
    for t in x["rare"]:
        for f, again, first in scoring.DISTINCT_POINTS:
            if t in words(s[f]):
                score += again if t in matched else first
                matched.add(t)
    score += 0.15 * (s["category"] in ("listas", "gabaritos")) + (0.06 if s["manual_tags"] else 0.01 if s["auto_tags"] or s["legacy_tags"] else 0)
    return score * (0.55 if not exact and not matched and score > 0 else 0.45 if not exact and len(matched) == 1 else 1)


def test_unit_scores_and_winners(spark):
    entries, topics = fixture(6)
    facts = unit_facts(topics)
    t = spark.createDataFrame(topics, TOPIC_DDL)
    u = t.groupBy("course_id", "unit_ord", "unit_slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic_label"))), lambda x: x["topic_label"]).alias("topics")).withColumn("unit_title", F.get("topics", F.lit(0)))
    e = scoring.signals(spark.createDataFrame(entries, ENTRY_DDL))
    got = {(r.entry_id, r.unit_ord): r.score for r in scoring.unit_scores(e, scoring.unit_index(u)).collect()}
    boosted = {r.entry_id: r for r in scoring.best_unit(scoring.unit_candidates(scoring.topic_candidates(e, t), scoring.unit_index(u))).collect()}
    for row in entries:
        s, ranked = signals(row), []
        for (c, o), x in facts.items():
            if c == row[0]:
                score = unit_score(s, x)
                assert abs(got[row[1], o] - score) < 1e-9, (row, o)
                best = max([topic_score(s, y) for y in topics if y[0] == c and y[5] == o] + [0.0])
                ranked.append((-(score + (0.85 * best if best >= 0.25 else 0)), o, best))
        ranked.sort()
        first, second = ranked[0], ranked[1]
        lead, conf = second[0] - first[0], min(1, max(0, second[0] - first[0] - 0.18 * first[0]))
        amb = first[0] >= 0 or lead < 0.8
        if first[2] >= 0.55 and first[2] - second[2] >= 0.01:
            amb, conf = False, max(conf, min(0.95, first[2]))
        r = boosted[row[1]]
        assert (r.unit_slug, r.unit_ambiguous) == (f"u{first[1]}", amb) and abs(r.unit_confidence - (min(conf, 0.4) if amb else conf)) < 1e-6


def test_courses_beyond_broadcast(spark, monkeypatch):
    entries, topics = fixture(7)
    e, t = scoring.signals(spark.createDataFrame(entries, ENTRY_DDL)), spark.createDataFrame(topics, TOPIC_DDL)
    rows = lambda: sorted(map(str, scoring.topic_scores(e, t).select("entry_id", "topic_ord", "score").collect()))
    want = rows()
    monkeypatch.setattr(scoring, "MOST_BROADCAST", 3)
    assert rows() == want


def test_row_scores_equal_all_pairs(spark):
    rng = random.Random(3)
    entries, _ = fixture(8, 20)
    rows = [(f"c{i % 2}", i, norm(" ".join(rng.choice([*PIECES, "listas", "buscas", "ar"]) for _ in range(rng.randint(1, 5))))) for i in range(20)]
    got = {(r.entry_id, r.row_index): r.score for r in scoring.row_scores(scoring.signals(spark.createDataFrame(entries, ENTRY_DDL)), spark.createDataFrame(rows, "course_id string, row_index long, content_norm string"), ["entry_id"]).collect()}
    for e in entries:
        s = {f"s_{k}": v for k, v in signals(e).items()}
        for c, i, x in rows:
            if c == e[0]:
                score = 0.0
                for f, w in scoring.ROW_WEIGHTS.items():
                    for a in words(s[f]):
                        for b in words(x):
                            score += w * (1 if a == b else 0.45 if a in b or b in a else 0.2 if len(a) >= 5 and len(b) >= 5 and a[:5] == b[:5] else 0)
                    if s[f] and s[f] in x:
                        score += min(1.5, max(0.35, len(s[f]) / 18)) * w
                assert abs(got.get((e[1], i), 0.0) - score) < 1e-9, (e, x)


def test_periods(spark):
    blocks = spark.createDataFrame([("c", "b1", 1, "09/03/2026", "u", 0.9, "t1", 0.5, ["t1"], "mesmo texto"), ("c", "b2", 2, "23/03/2026 a 25/03/2026", "u", 0.9, "t2", 0.5, ["t2", "t3"], "mesmo texto"), ("c", "b3", 3, "30/03/2026", "", 0.0, "", 0.0, [], "outro")], "course_id string, block_id string, block_ord int, period_label string, unit_slug string, unit_confidence double, primary_topic_slug string, primary_topic_confidence double, topic_slugs array<string>, topic_text string")
    rows = spark.createDataFrame([("c", "b1", 1, "mesmo texto aqui", False), ("c", "b2", 2, "mesmo texto aqui", False), ("c", "b2", 3, "lista de exercicios", False), ("c", "b3", 4, "mesmo texto aqui", True)], "course_id string, block_id string, row_index int, content_norm string, ignored boolean")
    entry = scoring.signals(spark.createDataFrame([("c", 1, "Mesmo texto", "nada", "provas", [], [], None, None), ("c", 2, "Aula", "entrega em 11/03/2026: aula", "provas", [], [], None, None), ("c", 3, "Vazio", "", "provas", [], [], None, None)], ENTRY_DDL))
    base = {"whole_course": F.lit(False), "match_ambiguous": F.lit(False), "match_slug": F.lit("u"), "match_confidence": F.lit(0.9)}
    prefer = lambda t: entry.withColumns({**base, "preferred_topic": F.lit(t)})
    got = {r.entry_id: (r.period, r.block_id) for r in jobs.entry_periods(prefer("t3"), blocks, rows).collect()}
    assert got[1] == ("23/03/2026 a 25/03/2026", "b2")  # only the block with the topic competes
    assert 1 not in {r.entry_id for r in jobs.entry_periods(prefer(""), blocks, rows.filter("row_index < 3")).collect()}  # two equal blocks
    sessions = spark.createDataFrame([("c", "b1", "s1", 1, "09/03/2026", "class", "aula"), ("c", "b2", "s2", 1, "11/03/2026", "class", "")], "course_id string, block_id string, session_id string, ord int, d string, kind string, text_norm string").withColumn("date", F.to_date("d", "dd/MM/yyyy")).drop("d")
    by_day = {r.entry_id: r.block_id for r in jobs.entry_periods(prefer(""), blocks, rows, sessions).collect()}
    assert by_day[2] == "b2"  # the session's date decides
    pairs = spark.createDataFrame([("c", 9, "b3", True, "u", "")], "course_id string, entry_id long, block_id string, exercise boolean, preferred_unit string, preferred_topic string")
    facts = blocks.withColumnRenamed("unit_slug", "block_unit")
    none = spark.createDataFrame([], "course_id string, entry_id long, row_index int, score double")
    assert scoring.block_scores(pairs, facts, rows, none, ["entry_id"]).first().score == 0.0  # only an ignored row
    two = scoring.block_scores(pairs.withColumn("block_id", F.lit("b2")), facts, rows, none, ["entry_id"]).first().score
    assert abs(two - (1.15 * -0.2 + 0.18 * 1.5 + 0.22 + 0.35 + 0.25 * 0.9)) < 1e-9


def test_topic_candidates_and_tools(spark):
    cases = {"Grafos e árvores": True, "pdf": False, "Introdução": False, "Prove que x": False, "Uso do Isabelle": False, "Atlas geral": False, "Livro da Springer": False, "Em 1998": False, "a b c notação": False, "Entender conjuntos": False, "Termos": False, "Revisão": False, "um dois tres quatro cinco seis sete": False, "Lógica proposicional": True}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert {r.t: r.ok for r in df.select("t", taxonomy.is_topic_candidate(F.col("t")).alias("ok")).collect()} == cases
    other = taxonomy.Profile(known_tools=["grafos"])
    assert not df.filter("t = 'Grafos e árvores'").select(taxonomy.is_topic_candidate(F.col("t"), other).alias("ok")).first().ok
    lines = spark.createDataFrame([("c", "# x\n## 1.2. Lógica proposicional\n- [ ] Conjuntos indutivos\n- Revisão\ntexto solto\nUnidade 3 - Grafos dirigidos\n2. Busca")], "course_id string, text string")
    assert {r.text for r in taxonomy.topic_lines(lines).collect()} == {"Lógica proposicional", "Conjuntos indutivos", "Grafos dirigidos", "Busca"}
    sources = [("c", 1, "usa o solver Minisat\nC++ e aula"), ("c", 2, "o minisat resolve"), ("c", 3, "Isabelle prova; FooBar\nparser palavra"), ("c", 4, "palavra sem contexto"), ("c", 5, "sozinho com solver unico")]
    got = {r.name: (r.sources, r.context) for r in taxonomy.tool_candidates(spark.createDataFrame(sources, "course_id string, source int, text string")).collect()}
    assert got["minisat"] == (2, 1) and got["isabelle"][0] == 1 and "foobar" in got and "palavra" in got and "unico" not in got and "aula" not in got


def test_tags(spark):
    flags = {"revisao para a prova": True, "prova 1": False, "revisao de conteudo": False, "simulado da p2": True, "simulado da p20": False}
    df = spark.createDataFrame(list(flags.items()), "t string, want boolean")
    assert {r.t: r.ok for r in df.select("t", taxonomy.exam_review(F.col("t")).alias("ok")).collect()} == flags
    c = spark.createDataFrame([("c", "Funções recursivas"), ("c", "Conjuntos indutivos")], "course_id string, text string")
    h = spark.createDataFrame([("c", "Introdução ao Isabelle"), ("c", "Conjuntos indutivos finitos"), ("c", "Nada disso")], "course_id string, text string")
    tags = taxonomy.tag_catalog(c, h).first().tags
    assert tags == ["ferramenta:isabelle", "topico:conjuntos-indutivos", "topico:conjuntos-indutivos-finitos", "topico:funcoes-recursivas"]
    rows = [("c", 1, "Funções muito recursivas", "", "listas"), ("c", 2, "x", "uso de Isabelle", "provas"), ("c", 3, "revisão para P1", "", "outros"), ("c", 4, "funções", "", "material-de-aula")]
    entries = spark.createDataFrame(rows, "course_id string, entry_id int, title string, head_text string, category string")
    got = {r.entry_id: r.auto_tags for r in taxonomy.auto_tags(entries, taxonomy.tag_catalog(c, h)).collect()}
    assert got == {1: ["topico:funcoes-recursivas", "tipo:lista"], 2: ["ferramenta:isabelle", "tipo:prova"], 3: ["uso:revisao-prova"], 4: ["tipo:material-base"]}


PLAN = "### Unidade 1 - Lógica\n1.1. Lógica de Hoare\n1.1.1. Pré e pós condições\n### Unidade 2 - Conjuntos\n2.1. Conjuntos indutivos\n2.2. Funções recursivas"
SCHEDULE = "| Data | Conteúdo |\n|---|---|\n| 02/03/2026 | Lógica de Hoare: regras |\n| 04/03/2026 | Lógica de Hoare: exemplos |\n| 09/03/2026 | Exercícios |\n| 11/03/2026 | Feriado |\n| 16/03/2026 | Conjuntos indutivos |\n| 18/03/2026 | Atividade assíncrona |"


def test_whole_course(spark):
    plans = spark.createDataFrame([("c", PLAN)], "course_id string, plan string")
    words_ = spark.createDataFrame([("c", "## Lógica de Hoare\n**Sinônimos:** triplas\nDefinição: uma lógica.\n")], "course_id string, glossary string")
    heads = spark.createDataFrame([("c", "Conjuntos indutivos e provas"), ("c", "Sem relação")], "course_id string, heading string")
    topics = jobs.content_taxonomy(plans, words_, heads)
    got = {r.topic_slug: (r.unit_slug, r.kind, r.aliases) for r in topics.collect()}
    assert got["logica-de-hoare"] == ("unidade-01-logica", "topic", ["triplas"]) and got["pre-e-pos-condicoes"][1] == "subtopic"
    assert got["conjuntos-indutivos"] == ("unidade-02-conjuntos", "topic", ["Conjuntos indutivos e provas"])
    units = topics.groupBy("course_id", "unit_ord", "unit_slug", "unit_title").agg(F.collect_list("topic_label").alias("topics"))
    blocks, rows = jobs.timeline_index(spark.createDataFrame([("c", SCHEDULE)], "course_id string, schedule string"), topics, units)
    b = {r.block_id: r for r in blocks.collect()}
    assert b["bloco-01"].source_rows == [0, 1, 2] and b["bloco-01"].unit_slug == "unidade-01-logica" and b["bloco-01"].primary_topic_slug == "logica-de-hoare"
    conj = next(r for r in b.values() if "conjuntos" in r.topic_text)
    assert conj.unit_slug == "unidade-02-conjuntos" and any(r.administrative for r in b.values())
    entries = spark.createDataFrame([("c", 1, 1, "Aula de Hoare", "# Lógica de Hoare\ntexto\n## Regras\n## Exemplos", "material-de-aula", "content/a.md"), ("c", 2, 2, "Plano", "x", "cronograma", None), ("d", 3, 1, "Outro curso", "x", "outros", None), ("c", 4, 3, "Aula 18/03/2026: conjuntos", "conjuntos indutivos e a atividade assíncrona", "material-de-aula", None)], "course_id string, entry_id long, entry_ord int, title string, markdown string, category string, approved_markdown string")
    table = jobs.file_map(entries, topics, units, blocks, rows)
    m = {r.entry_id: r for r in table.collect()}
    assert (m[1].unit, m[1].confidence, m[1].usage, m[1].markdown, m[1].sections) == ("unidade-01-logica", "Alta", "teoria base", "`content/a.md`", "Regras  Exemplos") and m[1].period == b["bloco-01"].period_label
    of_day = [r for r in b.values() if any(str(x.date) == "2026-03-18" for x in r.sessions)]
    assert len(of_day) == 1 and m[4].unit == of_day[0].unit_slug == "unidade-02-conjuntos" and m[4].period == of_day[0].period_label  # by its session
    assert (m[2].unit, m[2].confidence, m[2].period) == ("curso-inteiro", "Alta", "") and (m[3].unit, m[3].confidence) == ("", "Baixa")
    text = {r.course_id: r.markdown for r in jobs.file_map_markdown(table).collect()}
    assert text["c"].startswith("| # | Título") and "| 1 | Aula de Hoare |" in text["c"]
    page = jobs.course_map(plans, blocks).first().markdown
    assert "### Unidade 1 - Lógica\n- [ ] Lógica de Hoare\n  - [ ] Pré e pós condições" in page and "| Unidade 1 - Lógica | 02/03/2026" in page
    exam = plans.withColumn("plan", F.concat("plan", F.lit("\n## Avaliação\nP1: prova escrita\nsobre as unidades 1 e 2\nP2: unidade 2"))).union(spark.createDataFrame([("e", "nada")], "course_id string, plan string"))
    said = rows.union(rows.filter("row_index = 1").withColumns({"content_norm": F.lit("prova p1"), "row_index": F.lit(9)}).select(*rows.columns))
    maps = {r.course_id: r.markdown for r in jobs.course_map(exam, blocks, jobs.assessment_context(exam, said, blocks)).collect()}
    assert "## Conflitos de avaliação x cronograma\n\n**Resumo das inconsistências detectadas**\n\n- P1 (2026-03-04) -> U1, U2: P1 em 2026-03-04 antecede Unidade 2 - Conjuntos (previsto para " in maps["c"] and maps["c"].count("antecede") == 1
    assert maps["e"] == f"## Estrutura do curso\n\n{jobs.NO_UNITS}\n"
    bare = jobs.course_map(plans.limit(0), blocks).first().markdown
    assert "### Unidade 01 Logica\n- [ ] Lógica de Hoare" in bare
    docs = spark.createDataFrame([("c", 1, "A lógica de Hoare é um formalismo para verificar programas com triplas.")], "course_id string, doc_ord long, markdown string")
    g = jobs.glossary(topics, docs, [("indutiv", "Definidos por regras.", "indução", "recursão")]).first().markdown
    assert "## Conjuntos indutivos\n**Definição:** Definidos por regras.\n**Sinônimos aceitos:** indução" in g and "**Definição:** A lógica de Hoare é um formalismo" in g


def test_assessment_forms(spark):
    found = spark.createDataFrame([("c", "P2", "p2"), ("c", "PF", "pf")], "course_id string, label string, label_slug string")
    rows = spark.createDataFrame([("c", 1, "prova 20", None), ("c", 2, "aula e prova 02", None), ("c", 3, "prova 2 final", "2026-04-01"), ("c", 4, "exame final", "2026-07-01")], "course_id string, row_index int, content_norm string, d string").withColumn("date_dt", F.to_date("d"))
    got = {r.label: (r.row_index, str(r.assessment_date)) for r in timeline.assessment_rows(found, rows).collect()}
    assert got == {"P2": (2, "2026-04-01"), "PF": (4, "2026-07-01")}


def test_course_vocabularies(spark):
    frame = lambda rows: spark.createDataFrame(rows, "course_id string, text string")
    c = frame([("a", "Grafos dirigidos"), ("a", "Busca em Gephi"), ("b", "Grafos dirigidos"), ("b", "Busca em Gephi"), ("b", "b longo")])
    h = frame([("a", "Aula de Gephi"), ("b", "Aula de Gephi"), ("a", "Notas soltas grafos"), ("b", "Notas soltas grafos"), ("a", "Seja x"), ("b", None), ("b", "Uso de Isabelle"), ("n", "Sozinho aqui"), ("n", "Notas")])
    own = spark.createDataFrame([("a", "tool", "gephi"), ("b", "whole", "grafos dirigidos"), ("a", "cue", "soltas"), ("n", "start", "so"), ("z", "tool", "aula")], "course_id string, kind string, word string")
    words = profiles.course_vocabulary(c.select("course_id"), overrides=own)
    got = {r.course_id: r.tags for r in profiles.course_tags(c, h, words).collect()}
    # Gephi is a tool of course a alone; the stop heading is one of course b alone; the cue lets a heading in
    assert got == {
        "a": ["ferramenta:gephi", "topico:grafos-dirigidos", "topico:notas-soltas-grafos"],
        "b": ["ferramenta:isabelle", "topico:b-longo", "topico:busca-em-gephi"],
        "n": ["topico:notas"],
    }
    texts = frame([("a", f"texto {i} com gephi") for i in range(40)] + [("b", "x")])
    hits = profiles.scan(texts, words, together=5).collect()  # course a is dealt over parts
    assert len(hits) == 41 and all([tuple(x) for x in r.hits] == ([("named", "gephi"), ("tool", "gephi")] if r.course_id == "a" else []) for r in hits)


def test_courses_are_dealt_by_weight(spark):
    rows = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5000)).alias("course_id"), F.col("id").cast("string").alias("text"))
    side = rows.select("course_id").distinct()
    dealt, sent = dealing.deal(rows, side, "text", together=200)
    parts = {r.course_id: r.n for r in dealt.groupBy("course_id").agg(F.countDistinct("__part").alias("n")).collect()}
    assert parts["hot"] >= 100 and all(n == 1 for c, n in parts.items() if c != "hot")
    assert dealt.join(sent, ["course_id", "__part"]).count() == 300_000


def test_period_blocks_by_months(spark):
    rng = random.Random(6)
    day = lambda: (dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 900))) if rng.random() > 0.05 else None
    blocks = [("c" if i % 9 else "d", i, day(), day(), f"p{i % 40}" if i % 7 else None) for i in range(160)]
    docs = [(i, rng.choice("cde"), day(), day(), rng.choice([None, "p1", "p39", "zz", "zz"])) for i in range(120)]
    want = set()
    for i, c, s, e, label in docs:
        mine = [b for b in blocks if b[0] == c]
        tiers = [[b[1] for b in mine if label is not None and b[4] == label], [b[1] for b in mine if None not in (s, e, b[2], b[3]) and s <= b[3] and b[2] <= e], [b[1] for b in mine]]
        k = next((k for k, t in enumerate(tiers) if t), 2)
        want |= {(i, b, k) for b in tiers[k]}
    d = spark.createDataFrame(docs, "doc int, course_id string, start date, end date, period_label string")
    b = spark.createDataFrame(blocks, "course_id string, block_id int, period_start date, period_end date, period_label string")
    got = [(r.doc, r.block_id, r.tier) for r in scoring.period_blocks(d, b, ["doc"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_glossary_aliases_meet_by_rare_letters(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))).strip()
    norm = lambda x: " ".join(x.split())
    topics = [(rng.choice("cd"), f"t{i}", text(), rng.choice(["u1", "u2"])) for i in range(60)]
    terms = [(rng.choice("cd"), text(), rng.choice(["", "u1"]), rng.choice([None, ["syn"]])) for _ in range(60)]
    want = {}
    for c, slug, label, unit in topics:
        a = norm(label)
        for c2, term, hint, synonyms in terms:
            t = norm(term)
            if c == c2 and t and (a == t or (len(t) >= 4 and t in a) or (len(a) >= 4 and a in t)) and (not hint or hint in unit):
                for alias in [term, *(synonyms or [])]:
                    s = "-".join(alias.split()) or "untitled"
                    if s != ("-".join(label.split()) or "untitled"):
                        forms = want.setdefault((c, slug), {})
                        forms[s] = min(forms.get(s, alias), alias)
    t = spark.createDataFrame(topics, "course_id string, topic_slug string, topic_label string, unit_slug string")
    g = spark.createDataFrame(terms, "course_id string, term string, unit_hint string, synonyms array<string>")
    got = {(r.course_id, r.topic_slug): r.aliases for r in taxonomy.glossary_aliases(t, g).collect()}
    assert len(want) > 10 and got == {k: sorted(set(v.values())) for k, v in want.items()}
