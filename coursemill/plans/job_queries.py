"""Queries of the whole jobs over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from coursemill.functions import text as X
from coursemill.operators import taxonomy
from coursemill.plans import incremental, jobs
from coursemill.plans.tables import documents, query, sql_norm, table, topics
from coursemill.plans.text_queries import RULES, SQL_ENTRIES, SQL_MATCH, SQL_UNIT_SCORES, SQL_UNIT_WORDS, sql_rows
from coursemill.sources import readers
from coursemill.sources.staging import scratch, staged

_CATEGORY = "case doc_id % 6 when 0 then 'provas' when 1 then 'material-de-aula' when 2 then 'cronograma' when 3 then 'outros' when 4 then 'trabalhos' else 'codigo-professor' end"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topics(spark, sf_dir).groupBy("course_id", "unit_ord", "unit_slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic_label"))), lambda x: x["topic_label"]).alias("topics"))
    return t.withColumn("unit_title", F.get("topics", F.lit(0)))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every topic as a block of one row: some without a unit, some ignored."""
    t = topics(spark, sf_dir)
    n = F.row_number().over(W.partitionBy("course_id").orderBy("topic_ord"))
    label = F.date_format(F.date_add(F.lit("2026-03-02").cast("date"), F.col("topic_ord").cast("int") * 2), "dd/MM/yyyy")
    blocks = t.withColumn("block_ord", n).select(
        "course_id", F.format_string("bloco-%02d", "block_ord").alias("block_id"), "block_ord", label.alias("period_label"), F.when(F.col("topic_ord") % 7 == 0, "").otherwise(F.col("unit_slug")).alias("unit_slug"), F.lit(0.6).alias("unit_confidence"),
        F.col("topic_slug").alias("primary_topic_slug"), F.lit(0.5).alias("primary_topic_confidence"), F.array("topic_slug").alias("topic_slugs"), X.match_text("topic_label").alias("topic_text"), F.lit(False).alias("administrative"), "topic_ord",
    )
    rows = blocks.select("course_id", "block_id", F.col("topic_ord").alias("row_index"), F.col("topic_text").alias("content_norm"), (F.col("topic_ord") % 10 == 9).alias("ignored"))
    return blocks.drop("topic_ord"), rows


_SQL_CELL = "CASE WHEN amb THEN slug || ' _(ambíguo)_' WHEN conf < 0.45 THEN slug || ' _(baixa confiança)_' ELSE slug END"


@query("file_map", rf"""
WITH {SQL_UNIT_WORDS}, {SQL_ENTRIES.replace("AS body FROM documents)", f"AS body, {sql_norm(_CATEGORY)} AS category FROM documents)")}, {SQL_MATCH}, {SQL_UNIT_SCORES}, {sql_rows({"title": 1.25, "body": 1.0, "category": 0.2})},
tb AS (SELECT course_id, doc_id, unit_slug, greatest(0, max(score)) AS ts FROM scored GROUP BY ALL),
ub AS (SELECT s.course_id, s.doc_id, s.unit_ord, s.unit_slug, ts, score + CASE WHEN ts >= 0.25 THEN 0.85 * ts ELSE 0 END AS total FROM uscored s JOIN tb USING (course_id, doc_id, unit_slug)),
ur AS (SELECT *, row_number() OVER w AS k, coalesce(lead(total) OVER w, 0) AS second, ts - coalesce(lead(ts) OVER w, 0) AS ahead, count(*) OVER (PARTITION BY course_id, doc_id) AS units FROM ub WINDOW w AS (PARTITION BY course_id, doc_id ORDER BY total DESC, unit_ord)),
uv AS (SELECT *, least(1.0, greatest(0.0, total - second + 0.18 * total)) AS c0, total <= 0 OR (units > 1 AND abs(total - second) < 0.8) AS a0, units > 1 AND ts >= 0.55 AND ahead >= 0.01 AS settled FROM ur WHERE k = 1),
uu AS (SELECT course_id, doc_id, unit_slug, NOT settled AND a0 AS amb, CASE WHEN settled THEN greatest(c0, least(0.95, ts)) WHEN a0 THEN least(c0, 0.4) WHEN units = 1 THEN greatest(c0, 0.7) ELSE c0 END AS conf FROM uv),
e2 AS (SELECT d.doc_id, source AS course_id, {_CATEGORY} AS category, CASE doc_id % 11 WHEN 0 THEN 'unit-1' WHEN 1 THEN 'nope' END AS mu, CASE WHEN doc_id % 13 = 0 THEN 'bloco-02' END AS mb, CASE doc_id % 4 WHEN 0 THEN 'staging/' || doc_id || '.md' WHEN 1 THEN 'content/x.md' END AS md, text FROM documents d),
m0 AS (SELECT e2.*, f.topic_slug, f.unit_slug AS tu, f.confidence AS tc, NOT f.ambiguous AND f.confidence >= 0.45 AS sure, uu.unit_slug AS us, uu.amb AS ua, uu.conf AS uc, category = 'cronograma' AS whole, coalesce(mu IN (SELECT unit_slug FROM u WHERE u.course_id = e2.course_id), false) AS hand
    FROM e2 LEFT JOIN final f ON f.course_id = e2.course_id AND f.doc_id = e2.doc_id LEFT JOIN uu ON uu.course_id = e2.course_id AND uu.doc_id = e2.doc_id),
m AS (SELECT *, CASE WHEN NOT whole AND coalesce(sure, false) THEN topic_slug ELSE '' END AS pref, CASE WHEN whole THEN '' WHEN hand THEN mu WHEN sure THEN tu ELSE coalesce(us, '') END AS slug,
    CASE WHEN whole THEN 0 WHEN hand THEN 1 WHEN sure THEN tc ELSE coalesce(uc, 0) END AS conf, CASE WHEN whole THEN true WHEN hand OR sure THEN false ELSE coalesce(ua, true) END AS amb FROM m0),
bl AS (SELECT course_id, topic_ord, topic_slug AS bt, row_number() OVER (PARTITION BY course_id ORDER BY topic_ord) AS bo, CASE WHEN topic_ord % 7 = 0 THEN '' ELSE unit_slug END AS bu, strftime((DATE '2026-03-02' + (topic_ord * 2)::INT)::DATE, '%d/%m/%Y') AS per, topic_ord % 10 = 9 AS ign, {sql_norm('topic_label')} AS x FROM topics),
ca AS (SELECT m.course_id, m.doc_id, m.slug, m.pref, t.tier, bl.*EXCLUDE (course_id), bool_or(pref <> '' AND bt = pref) OVER (PARTITION BY m.doc_id, t.tier) AS matched FROM m JOIN (SELECT unnest([0, 1]) AS tier) t ON NOT amb AND slug <> '' AND conf >= CASE tier WHEN 0 THEN 0.45 ELSE 0.55 END JOIN bl ON bl.course_id = m.course_id AND bu = CASE tier WHEN 0 THEN slug ELSE '' END),
cs AS (SELECT ca.*, CASE WHEN ign THEN 0 ELSE 1.15 * (coalesce(rs.s, 0) + CASE WHEN regexp_matches(x, 'exercicio|lista|gabarito|respostas') THEN 0.25 + CASE WHEN ex THEN 1.25 ELSE 0 END WHEN ex THEN -0.2 ELSE 0 END) + CASE WHEN bu = ca.slug THEN 0.5 WHEN bu <> '' THEN -0.45 ELSE 0 END + CASE WHEN pref = '' THEN 0 WHEN bt = pref THEN 0.975 ELSE -0.18 END END AS score
    FROM ca LEFT JOIN rs ON rs.course_id = ca.course_id AND rs.doc_id = ca.doc_id AND rs.row_index = ca.topic_ord JOIN (SELECT doc_id, regexp_matches(title || ' ' || body || ' ' || category, 'exercicio|lista|gabarito|respostas') AS ex FROM entries) ex ON ex.doc_id = ca.doc_id WHERE NOT matched OR bt = pref),
cr AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM cs WINDOW w AS (PARTITION BY doc_id, tier ORDER BY score DESC, bo)),
pe AS (SELECT doc_id, min_by(per, tier) AS per FROM cr WHERE k = 1 AND score >= 1 AND abs(score - second) >= 0.35 AND least(1.0, score - second + 0.18 * score) >= 0.5 GROUP BY doc_id),
o AS (SELECT m.*, CASE WHEN whole THEN '' ELSE coalesce(pe.per, mbl.per, '') END AS period FROM m LEFT JOIN pe USING (doc_id) LEFT JOIN bl mbl ON mbl.course_id = m.course_id AND mb IS NOT NULL AND CASE WHEN length(mbl.bo::VARCHAR) < 2 THEN '0' || mbl.bo ELSE mbl.bo::VARCHAR END = '02')
SELECT course_id, doc_id AS entry_id, category, CASE category WHEN 'provas' THEN 'provas e revisão' WHEN 'material-de-aula' THEN 'teoria base' WHEN 'cronograma' THEN 'referência geral' WHEN 'trabalhos' THEN 'trabalhos' WHEN 'codigo-professor' THEN 'exemplos de código' ELSE 'consulta pontual' END AS usage,
  CASE WHEN category = 'provas' THEN 'alta' WHEN category IN ('material-de-aula', 'codigo-professor') THEN 'media' ELSE 'normal' END AS priority, CASE WHEN md IS NULL THEN '—' WHEN md LIKE 'staging/%' THEN 'A revisar' ELSE '`' || md || '`' END AS markdown,
  array_to_string(regexp_extract_all(coalesce(text, ''), '(?m)^##[ \t]+([^\s].*?)[ \t\r]*$', 1)[1:4], '  ') AS sections, CASE WHEN whole THEN 'curso-inteiro' WHEN slug = '' THEN '' ELSE {_SQL_CELL} END AS unit,
  CASE WHEN mu IS NOT NULL THEN 'Alta' WHEN whole THEN 'Alta' WHEN slug = '' THEN 'Baixa' WHEN amb OR conf < 0.45 THEN 'Baixa' WHEN conf >= 0.85 OR (pref <> '')::INT + (period <> '')::INT + (mb IS NOT NULL)::INT >= 2 THEN 'Alta' ELSE 'Média' END AS confidence, period,
  array_to_string(list_filter(['unidade-manual: `' || mu || '`', 'bloco-manual: `' || mb || '`', CASE WHEN md LIKE 'staging/%' THEN 'markdown-base: `' || md || '`' END], lambda x: x IS NOT NULL), '; ') AS trace FROM o""")
def file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing table of all courses. Job file_map: J4, J5, J7, J8, J12, J21, W1, P8, P9, P10, P11, F9, U1"""
    md = F.expr("case doc_id % 4 when 0 then concat('staging/', doc_id, '.md') when 1 then 'content/x.md' end")
    entries = documents(spark, sf_dir).withColumns({
        "entry_id": F.col("doc_id"), "entry_ord": F.col("doc_id"), "category": F.expr(_CATEGORY), "manual_unit_slug": F.expr("case doc_id % 11 when 0 then 'unit-1' when 1 then 'nope' end"),
        "manual_timeline_block_id": F.expr("case when doc_id % 13 = 0 then 'bloco-02' end"), "base_markdown": md,
    })
    blocks, rows = _blocks(spark, sf_dir)
    out = jobs.file_map(entries, topics(spark, sf_dir), _units(spark, sf_dir), blocks, rows)
    return out.select("course_id", "entry_id", "category", "usage", "priority", "markdown", "sections", "unit", "confidence", "period", "trace")


def _courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses' schedules of benchmark texts: two rows an item, with whole sentences."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.pmod("item_id", F.lit(20))).alias("course_id"), "item_id", F.posexplode(F.split(X.collapse_ws(F.regexp_replace("text", r"[|]", " ")), r"(?<=[.!?])\s+")).alias("pos", "s"))
    day = F.date_format(F.date_add(F.lit("2026-03-02").cast("date"), (F.col("item_id") / 20).cast("int") * 2), "dd/MM/yyyy")
    row = F.struct("item_id", "pos", F.concat(F.lit("| "), day, F.lit(" | "), "s", F.lit(" |")).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"])
    return b.filter("s != ''").groupBy("course_id").agg(F.array_join(F.concat(F.array(F.lit("| Data | Conteúdo |"), F.lit("|---|---|")), lines), "\n").alias("schedule"))


@query("timeline_index")
def timeline_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every course's schedule with their topics and units. Job timeline_index: S7, F7, F8, W5, W6, W2, J6, W3, W4"""
    blocks, _ = jobs.timeline_index(_courses(spark, sf_dir), topics(spark, sf_dir), _units(spark, sf_dir))
    return blocks.select("course_id", "block_id", "period_start", "period_end", "period_label", "unit_slug", F.round("unit_confidence", 6).alias("unit_confidence"), "primary_topic_slug", F.round("primary_topic_confidence", 6).alias("primary_topic_confidence"), "topic_ambiguous", F.size("source_rows").alias("n_rows"))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teaching plans of parts: a course a size, a unit a brand, a topic a part."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("course_id"), "p_brand", "p_partkey", "p_name", "p_type")
    n = F.dense_rank().over(W.partitionBy("course_id").orderBy("p_brand"))
    line = F.struct("n", "p_partkey", F.format_string("%d.%d. %s", "n", "p_partkey", "p_name").alias("t"))
    units = p.withColumn("n", n).groupBy("course_id", "n", "p_brand").agg(F.array_sort(F.collect_list(line)).alias("l"))
    unit = F.struct("n", F.concat(F.format_string("### Unidade %d - ", "n"), "p_brand", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("t"))
    return units.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["t"]), "\n").alias("plan"))


def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("course_id", F.col("p_size").cast("string"))
    entry = F.concat(F.lit("## "), F.element_at(F.split("p_name", " "), 1), F.lit("\nSinônimos: "), F.lower("p_type"), F.lit("\n"))
    glossaries = p.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("t")))), lambda x: x["t"]), "\n").alias("glossary"))
    heads = p.select("course_id", F.substring_index("p_name", " ", 2).alias("heading"))
    return jobs.content_taxonomy(_plans(spark, sf_dir), glossaries, heads)


@query("content_taxonomy")
def content_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of every course's plan with their aliases. Job taxonomy_and_tags: F21, F24, J15, J16, W13"""
    return _taxonomy(spark, sf_dir).select("course_id", "unit_slug", "topic_slug", "topic_code", "topic_label", "kind", F.array_join("aliases", "; ").alias("aliases"))


@query("tagged_entries")
def tagged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with automatic tags from their course's topics. Job taxonomy_and_tags: A5, A6"""
    d = documents(spark, sf_dir)
    head = X.collapse_ws(F.get(X.text_lines("markdown"), F.lit(0)))
    entries = d.select("course_id", F.col("doc_id").alias("entry_id"), "title", head.alias("head_text"), F.expr(_CATEGORY).alias("category"))
    heads = d.select("course_id", F.array_join(F.slice(F.split(head, " "), 1, 4), " ").alias("text")).distinct()
    return jobs.tagged_entries(entries, topics(spark, sf_dir), heads).select("course_id", "entry_id", F.array_join("auto_tags", "; ").alias("auto_tags"))


def _course_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the courses that have schedules: their units and topics, and a first assessment over two units."""
    t = topics(spark, sf_dir)
    line = F.struct("topic_ord", F.format_string("%d.%d. %s", F.col("unit_ord") + 1, F.col("topic_ord") + 1, F.col("topic_label")).alias("t"))
    units = t.filter("topic_label != ''").groupBy("course_id", "unit_ord").agg(F.min_by("topic_label", "topic_ord").alias("first"), F.array_sort(F.collect_list(line)).alias("l"))
    unit = F.struct("unit_ord", F.concat(F.format_string("### Unidade %d - ", F.col("unit_ord") + 1), "first", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["t"]), "\n")
    return units.groupBy("course_id").agg(F.concat(body, F.lit("\n## Avaliação\nP1: prova das unidades 2 e 3\nBibliografia\n")).alias("plan"))


def _timeline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(plans, topics, units, blocks, rows) of the courses that have both a plan and a schedule; the schedule has an exam and
    a card of each course's first topic."""
    plans = staged(_course_plans(spark, sf_dir), "plans")
    none = plans.select("course_id", F.lit(None).cast("string").alias("glossary"), F.lit(None).cast("string").alias("heading"))
    named = staged(jobs.content_taxonomy(plans, none.drop("heading"), none.drop("glossary")), "taxonomy")
    units = named.groupBy("course_id", "unit_ord", "unit_slug", "unit_title").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic_label"))), lambda x: x["topic_label"]).alias("topics"))
    card = named.groupBy("course_id").agg(F.min_by("topic_label", "topic_ord").alias("card"))
    more = F.concat(F.lit("\n| 02/03/2026 | Prova P1 |\n| 04/03/2026 | Card: "), "card", F.lit("; atividade assíncrona: "), "card", F.lit(" |"))
    exam = _courses(spark, sf_dir).join(card, "course_id").select("course_id", F.concat("schedule", more).alias("schedule"))
    return plans, named, units, *jobs.timeline_index(exam, named, units)


@query("course_maps")
def course_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of courses with plans and schedules, with periods and early assessments, and of courses with plans alone (parts).
    Job course_map: F21, F23, A8, J13, J14, T4"""
    plans, _, _, blocks, rows = _timeline(spark, sf_dir)
    every = plans.union(_plans(spark, sf_dir))
    return jobs.course_map(every, blocks, jobs.assessment_context(every, rows, blocks))


@query("course_file_map")
def course_file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing table of all documents over the timelines of their courses: plans, schedules, sessions and cards.
    Jobs taxonomy_and_tags, timeline_index and file_map in one chain: W7, J9, J22"""
    _, named, units, blocks, rows = _timeline(spark, sf_dir)
    entries = documents(spark, sf_dir).withColumns({"entry_id": F.col("doc_id"), "entry_ord": F.col("doc_id"), "category": F.expr(_CATEGORY), "manual_timeline_block_id": F.expr("case when doc_id % 13 = 0 then 'bloco-02' end")})
    out = jobs.file_map(entries, named, units, blocks, rows)
    return out.select("course_id", "entry_id", "category", "unit", "confidence", "period", "trace")


@query("glossaries")
def glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossaries of courses with evidence from their documents. Job glossary: J17, F25, F26, T4"""
    docs = documents(spark, sf_dir).select("course_id", F.col("doc_id").alias("doc_ord"), "markdown")
    return jobs.glossary(topics(spark, sf_dir).withColumn("unit_title", F.col("unit_slug")), docs, RULES)


@query("markdown_files", "SELECT item_id, md5(coalesce(text, '') || chr(10)) AS markdown_md5 FROM benchmark")
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts written as files, one each, and read again whole. S2"""
    root = f"{scratch(spark)}/coursemill/files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("value")).repartition("item_id").write.partitionBy("item_id").text(root)
    found = readers.read_markdown(spark, root, "*.txt")
    return found.select(F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), F.md5("markdown").alias("markdown_md5"))


@query("image_facts", """
WITH p AS (SELECT p_partkey, p_size * 7 AS w, p_partkey % 900 + 1 AS h, p_partkey % 3 = 0 AS jpg FROM part),
b AS (SELECT *, unhex(CASE WHEN jpg THEN 'FFD8FFE000104A46' ELSE '89504E470D0A1A0A' END || '0000000D49484452' || printf('%08X', w::BIGINT) || printf('%08X', h::BIGINT) || '0802000000' || hex(p_partkey::VARCHAR)) AS c FROM p)
SELECT p_partkey, octet_length(c)::INT AS bytes, sha1(c) AS sha1, CASE WHEN NOT jpg THEN w::INT END AS width, CASE WHEN NOT jpg THEN h::INT END AS height FROM b""")
def image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, digest and dimensions of images whose heads are made of parts. S8"""
    head = F.when(F.col("p_partkey") % 3 == 0, "FFD8FFE000104A46").otherwise("89504E470D0A1A0A")
    size = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    content = F.unhex(F.concat(head, F.lit("0000000D49484452"), size(F.col("p_size") * 7), size(F.col("p_partkey") % 900 + 1), F.lit("0802000000"), F.hex(F.col("p_partkey").cast("string"))))
    facts = readers.image_facts(table(spark, sf_dir, "part").select("p_partkey", content.alias("content")))
    return facts.select("p_partkey", "bytes", "sha1", "width", "height")


@query("vocabulary_lines")
def vocabulary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of teaching plans that may be topics. A5, P14"""
    return taxonomy.topic_lines(_plans(spark, sf_dir).withColumnRenamed("plan", "text"))


@query("incremental_build", """
WITH d AS (SELECT source AS course_id, doc_id, lang, md5(coalesce(text, '')) AS m FROM documents WHERE source IS NOT NULL), n AS (SELECT course_id, max(doc_id) AS newest FROM d GROUP BY course_id)
SELECT course_id, count(*) AS n_entries, md5(string_agg(doc_id || ' ' || coalesce(lang, '') || ' ' || m, ',' ORDER BY doc_id, coalesce(lang, ''), m)) AS index_md5, CASE WHEN max(newest) % 2 = 0 THEN 2 ELSE 1 END AS version FROM d JOIN n USING (course_id) GROUP BY course_id""")
def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every course, built without the newest entry of some courses and then with it: only these are built twice.
    X1, J1, S9, job incremental"""
    d = table(spark, sf_dir, "documents").filter("source is not null").select(F.col("source").alias("course_id"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    newest = d.groupBy("course_id").agg(F.max("doc_id").alias("doc_id")).filter("doc_id % 2 = 0")
    root = f"{scratch(spark)}/coursemill/build-{uuid.uuid4().hex}"

    def index(parts: dict[str, DataFrame]) -> DataFrame:
        line = F.struct("doc_id", "lang", "m", F.concat_ws(" ", "doc_id", "lang", "m").alias("t"))
        return parts["entries"].groupBy("course_id").agg(F.count("*").alias("n_entries"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), ",")).alias("index_md5"))

    incremental.run(spark, root, {"entries": d.join(newest, ["course_id", "doc_id"], "left_anti").select(d.columns)}, index)
    incremental.run(spark, root, {"entries": d}, index)
    return incremental.read(spark, root).select("course_id", "n_entries", "index_md5", "version")
