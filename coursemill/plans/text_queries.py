"""Queries over text functions, topics, tags and glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemill.functions import text as X, vocab
from coursemill.operators import catalog, documents as D, profiles, scoring, taxonomy
from coursemill.plans.tables import SQL_LINES, SQL_TOPICS, SQL_WS, documents, query, sql_any, sql_candidate, sql_norm, sql_slug, sql_stems, sql_tokens, table, topics
from coursemill.sources.staging import staged

_LEAD = SQL_WS.format("coalesce(text, '')")


@query("text_normal", rf"""
WITH s AS (SELECT doc_id, text, trim(lower(strip_accents(substr(text, 1, 80)))) AS a FROM documents),
t AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(a, '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-') AS b, {sql_norm('text')} AS n FROM s)
SELECT doc_id, CASE WHEN b = '' THEN 'untitled' ELSE b END AS slug, md5(n) AS norm_md5, len({sql_tokens('n')})::INT AS n_tokens, len(list_distinct({sql_tokens('n')}))::INT AS n_distinct FROM t""")
def text_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and match texts of every document. P1, P3, F1"""
    d = table(spark, sf_dir, "documents").withColumn("n", X.match_text("text"))
    return d.select("doc_id", X.slugify(F.substring("text", 1, 80)).alias("slug"), F.md5("n").alias("norm_md5"), F.size(X.tokens("n")).alias("n_tokens"), F.size(F.array_distinct(X.tokens("n"))).alias("n_distinct"))


@query("text_leads", rf"""
WITH s AS (SELECT doc_id, {_LEAD} AS c FROM documents),
t AS (SELECT *, regexp_extract(c, '^(.+?[.!?])(?:\s|$)', 1) AS f FROM s),
u AS (SELECT *, CASE WHEN length(f) >= 40 THEN f ELSE c END AS d FROM t)
SELECT doc_id, CASE WHEN length(c) <= 200 THEN c ELSE trim(regexp_replace(left(c, 200), '\s+\S*$', '')) END AS lead,
    CASE WHEN length(d) <= 220 THEN d ELSE regexp_replace(regexp_replace(left(d, 220), '\s+\S*$', ''), '[\s.,;:]+$', '') || '...' END AS compact FROM u""")
def text_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead texts and compact descriptions. F10, F18"""
    return table(spark, sf_dir, "documents").select("doc_id", X.lead_text("text", 200).alias("lead"), X.compact_description("text").alias("compact"))


@query("signal_terms", rf"""
WITH s AS (SELECT item_id, {sql_norm('text')} AS n FROM benchmark), w AS (SELECT *, list_filter(string_split(n, ' '), lambda x: x <> '') AS w FROM s),
t AS (SELECT item_id, list_concat([n], w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')), list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS l FROM w)
SELECT item_id, len(list_distinct(l))::INT AS n_terms, md5(array_to_string(list_sort(list_distinct(l)), '|')) AS terms_md5 FROM t""")
def signal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word runs of every benchmark text. F6"""
    terms = table(spark, sf_dir, "benchmark").select("item_id", X.signal_terms("text").alias("t"))
    return terms.select("item_id", F.size("t").alias("n_terms"), F.md5(F.array_join(F.array_sort("t"), "|")).alias("terms_md5"))


def _sql_holds(field: str, phrase: str) -> str:
    return f"CASE WHEN {phrase} = '' THEN 0 WHEN contains({phrase}, ' ') THEN contains({field}, {phrase})::INT ELSE list_contains(t_{field}, {phrase})::INT END"


_FIELDS = {"title": 3.8, "lead": 2.8, "body": 1.1}
SQL_ENTRIES = rf"""entries AS (SELECT source AS course_id, doc_id, {sql_norm('left(text, 60)')} AS title, {sql_norm(f"CASE WHEN length({_LEAD}) <= 2600 THEN {_LEAD} ELSE regexp_replace(left({_LEAD}, 2600), chr(92) || 's+' || chr(92) || 'S*$', '') END")} AS lead, {sql_norm('text')} AS body FROM documents),
tokened AS (SELECT *, {sql_tokens('title')} AS t_title, {sql_tokens('lead')} AS t_lead, list_distinct({sql_tokens('body')}) AS t_body FROM entries)"""
SQL_MATCH = rf"""phrases AS (SELECT *, {sql_norm('topic_label')} AS p_label, {sql_norm("replace(topic_slug, '-', ' ')")} AS p_slug, {sql_norm('alias')} AS p_alias FROM topics),
ptok AS (SELECT *, list_distinct(list_filter({sql_tokens("p_label || ' ' || p_slug || ' ' || p_alias")}, lambda x: NOT list_contains({vocab.UNIT_GENERIC}, x))) AS p_tokens FROM phrases),
pairs AS (SELECT t.course_id, doc_id, topic_ord, topic_slug, topic_label, unit_slug, kind, len(p_tokens) AS n_tokens, len(list_filter(p_tokens, lambda x: list_contains(t_body, x) OR list_contains(t_title, x) OR list_contains(t_lead, x))) AS shared,
    {' + '.join(f"({_sql_holds(f, 'p_label')}) * {w} + ({_sql_holds(f, 'p_slug')}) * {w * 0.65} + ({_sql_holds(f, 'p_alias')}) * {w * 0.82}" for f, w in _FIELDS.items())} AS exact,
    {' + '.join(f"({_sql_holds(f, p)})" for f in _FIELDS for p in ('p_label', 'p_slug', 'p_alias'))} AS hits
    FROM tokened t JOIN ptok p ON t.course_id = p.course_id),
raw AS (SELECT *, exact + CASE WHEN n_tokens = 1 THEN (CASE WHEN shared > 0 THEN 0.9 ELSE 0 END) WHEN shared >= n_tokens THEN 1.4 + 0.22 * shared WHEN shared >= 2 THEN 0.9 + 0.18 * shared WHEN shared = 1 THEN 0.25 ELSE 0 END + CASE WHEN kind = 'subtopic' THEN 0.04 ELSE 0 END AS raw FROM pairs),
scored AS (SELECT *, raw::DOUBLE * CASE WHEN hits = 0 AND raw > 0 THEN 0.72 ELSE 1 END * CASE WHEN hits = 0 AND shared <= 1 THEN 0.68 ELSE 1 END AS score FROM raw),
ranked AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next, count(*) OVER (PARTITION BY course_id, doc_id) AS n FROM scored WINDOW w AS (PARTITION BY course_id, doc_id ORDER BY score DESC, topic_ord)),
won AS (SELECT *, score AS best, coalesce(next, 0) AS second, score <= 0 OR (n > 1 AND abs(score - coalesce(next, 0)) < 0.65) AS ambiguous FROM ranked WHERE r = 1),
conf AS (SELECT *, least(1.0, greatest(0.0, best - second + 0.2 * best)) AS c FROM won),
final AS (SELECT *, CASE WHEN ambiguous THEN least(0.45, c) WHEN n = 1 THEN greatest(c, 0.72) ELSE c END AS confidence FROM conf)"""
SQL_SCORED = f"{SQL_TOPICS}, {SQL_ENTRIES}, {SQL_MATCH}"


def topic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best topic; texts stay in their row and go with it."""
    found = scoring.best_topic(scoring.topic_candidates(scoring.signals(documents(spark, sf_dir)), topics(spark, sf_dir)).filter("n_topics is not null"))
    return found.select("course_id", "doc_id", "topic_slug", "topic_label", F.col("topic_unit").alias("unit_slug"), "best", "second", "confidence", "ambiguous")


@query("file_map_topics", f"""
WITH {SQL_SCORED}
SELECT course_id, doc_id, topic_slug, unit_slug, round(best, 6) AS best, round(confidence, 6) AS confidence, ambiguous,
    CASE WHEN ambiguous OR confidence < 0.45 THEN 'Baixa' WHEN confidence >= 0.85 THEN 'Alta' ELSE 'Média' END AS label,
    CASE WHEN ambiguous THEN unit_slug || ' _(ambíguo)_' WHEN confidence < 0.45 THEN unit_slug || ' _(baixa confiança)_' ELSE unit_slug END AS unit_cell FROM final""")
def file_map_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of every document with confidence and labels. J4, W1, P9, P10"""
    m = topic_matches(spark, sf_dir)
    label = catalog.confidence_label(F.lit(""), F.col("unit_slug"), F.col("confidence"), F.col("ambiguous"), F.lit(0))
    return m.select("course_id", "doc_id", "topic_slug", "unit_slug", F.round("best", 6).alias("best"), F.round("confidence", 6).alias("confidence"), "ambiguous", label.alias("label"), catalog.unit_cell(F.col("unit_slug"), F.col("confidence"), F.col("ambiguous")).alias("unit_cell"))


def course_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topics(spark, sf_dir).groupBy("course_id", "unit_ord", "unit_slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic_label"))), lambda x: x["topic_label"]).alias("topics"))
    return scoring.unit_index(t.withColumn("unit_title", F.get("topics", F.lit(0))))


SQL_UNIT_WORDS = f"""{SQL_TOPICS}, labels3 AS (SELECT course_id, unit_ord, unit_slug, topic_ord, {sql_norm('topic_label')} AS p FROM topics),
kept AS (SELECT DISTINCT course_id, unit_ord, unit_slug, token FROM (SELECT course_id, unit_ord, unit_slug, unnest({sql_tokens('p')}) AS token FROM labels3) WHERE NOT regexp_matches(token, '^\\d+$') AND NOT list_contains({vocab.UNIT_GENERIC}, token)),
dfs AS (SELECT *, count(*) OVER (PARTITION BY course_id, token) AS df FROM kept)"""


@query("unit_token_weights", f"""WITH {SQL_UNIT_WORDS}
SELECT course_id, unit_slug, token, 1.0::DOUBLE / df AS weight, df = 1 AND length(token) >= 5 AS is_distinctive FROM dfs""")
def unit_token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every unit with weight and whether they are distinctive. A1"""
    u = course_units(spark, sf_dir)
    return u.select("course_id", "unit_slug", "distinctive", F.explode("token_weights").alias("token", "weight")).select("course_id", "unit_slug", "token", "weight", F.array_contains("distinctive", F.col("token")).alias("is_distinctive"))


_LADDER = "CASE WHEN contains(lead, p) THEN 2.8 WHEN contains(title, p) THEN 2.7 WHEN contains(body, p) THEN 1.4 END"
_SHARES = {"lead": 0.48, "body": 0.18, "title": 0.45}
_PARTS = " + ".join(f"{w} * CASE WHEN coalesce(h_{f}, 0) = 0 THEN 0 WHEN words = 1 THEN 1.15 * s_{f} WHEN h_{f} = words THEN 1.15 + 0.95 * s_{f} WHEN h_{f} >= 2 THEN 0.85 * s_{f} ELSE 0 END" for f, w in _SHARES.items())
SQL_UNIT_SCORES = f"""u AS (SELECT DISTINCT course_id, unit_ord, unit_slug FROM labels3),
ph AS (SELECT * FROM labels3 WHERE p <> ''),
first AS (SELECT course_id, unit_ord, min_by(p, topic_ord) AS title_norm FROM labels3 GROUP BY ALL),
pw AS (SELECT x.course_id, x.unit_ord, topic_ord, x.token, coalesce(1.0 / df, 1.0)::DOUBLE AS w FROM (SELECT course_id, unit_ord, topic_ord, unnest(list_filter({sql_tokens('p')}, lambda x: NOT list_contains({vocab.UNIT_NEUTRAL}, x))) AS token FROM ph) x LEFT JOIN dfs ON dfs.course_id = x.course_id AND dfs.unit_ord = x.unit_ord AND dfs.token = x.token),
fall AS (SELECT e.doc_id, pw.course_id, pw.unit_ord, pw.topic_ord, count(*) AS words, {", ".join(f"count(*) FILTER (list_contains(t_{f}, token)) AS h_{f}, sum(w) FILTER (list_contains(t_{f}, token)) AS s_{f}" for f in _SHARES)} FROM tokened e JOIN pw USING (course_id) GROUP BY ALL),
s_phrase AS (SELECT e.doc_id, ph.course_id, ph.unit_ord, sum(coalesce(({_LADDER})::DOUBLE, {_PARTS})) AS s, count({_LADDER}) AS exact FROM tokened e JOIN ph USING (course_id) LEFT JOIN fall USING (doc_id, course_id, unit_ord, topic_ord) GROUP BY ALL),
s_title AS (SELECT e.doc_id, f.course_id, f.unit_ord, CASE WHEN len(list_filter(string_split(title_norm, ' '), lambda x: length(x) >= 5)) >= 3 THEN 1.1 * contains(body, title_norm)::INT + 1.6 * contains(lead, title_norm)::INT + contains(title, title_norm)::INT ELSE 0 END AS s FROM tokened e JOIN first f USING (course_id)),
uw AS (SELECT DISTINCT course_id, unit_ord, unnest(list_concat(list_filter({sql_tokens('p')}, lambda x: NOT list_contains({vocab.UNIT_GENERIC}, x)), CASE WHEN contains(p, ' ') THEN [] ELSE [p] END)) AS token FROM ph),
tok AS (SELECT e.doc_id, uw.course_id, uw.unit_ord, uw.token, coalesce(1.0 / df, 1.0)::DOUBLE * CASE WHEN neutral THEN 0.2 ELSE 1 END AS w, neutral, coalesce(df = 1 AND length(uw.token) >= 5, false) AS rare, list_contains(t_body, uw.token) AS b, list_contains(t_lead, uw.token) AS l, list_contains(t_title, uw.token) AS t
    FROM tokened e JOIN (SELECT *, list_contains({vocab.UNIT_NEUTRAL}, token) AS neutral FROM uw) uw USING (course_id) LEFT JOIN dfs ON dfs.course_id = uw.course_id AND dfs.unit_ord = uw.unit_ord AND dfs.token = uw.token),
s_tok AS (SELECT doc_id, course_id, unit_ord, sum((0.32 * b::INT + 0.7 * l::INT + 0.55 * t::INT) * w) AS s, count(*) FILTER (((b OR l OR t) AND NOT neutral) OR (rare AND (b OR t))) AS matched,
    sum(CASE WHEN rare THEN CASE WHEN b THEN CASE WHEN neutral THEN 0.7 ELSE 0.25 END ELSE 0 END + CASE WHEN t THEN CASE WHEN neutral AND NOT b THEN 0.35 ELSE 0.15 END ELSE 0 END ELSE 0 END) AS d FROM tok GROUP BY ALL),
uscored AS (SELECT u.course_id, doc_id, u.unit_ord, u.unit_slug, (st.s + sp.s + coalesce(sk.s + sk.d, 0)) * CASE WHEN exact = 0 AND coalesce(matched, 0) = 0 THEN 0.55 WHEN exact = 0 AND matched = 1 THEN 0.45 ELSE 1 END AS score
FROM u JOIN s_phrase sp USING (course_id, unit_ord) JOIN s_title st USING (course_id, unit_ord, doc_id) LEFT JOIN s_tok sk USING (course_id, unit_ord, doc_id))"""


@query("unit_scores", f"""WITH {SQL_UNIT_WORDS}, {SQL_ENTRIES}, {SQL_UNIT_SCORES} SELECT course_id, doc_id, unit_slug, round(score, 6)::DOUBLE AS score FROM uscored""")
def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document against the units of its course. J5, A1"""
    scored = scoring.unit_scores(scoring.signals(documents(spark, sf_dir)), course_units(spark, sf_dir))
    return scored.select("course_id", "doc_id", "unit_slug", F.round("score", 6).alias("score"))


@query("topic_units", f"""WITH {SQL_SCORED}, firsts AS (SELECT course_id, topic_slug, min_by(unit_slug, unit_ord * 1000000 + topic_ord) AS u FROM topics GROUP BY ALL)
SELECT f.course_id, doc_id, f.topic_slug, CASE WHEN f.unit_slug = 'unit-0' THEN f.unit_slug ELSE firsts.u END AS derived_unit FROM final f LEFT JOIN firsts USING (course_id, topic_slug)""")
def topic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit of each document's topic, where only first units are listed. J21"""
    t = topics(spark, sf_dir)
    units = t.filter("unit_ord = 0").select("course_id", "unit_slug").distinct()
    return scoring.topic_unit(topic_matches(spark, sf_dir).select("course_id", "doc_id", "topic_slug", "unit_slug"), t, units).select("course_id", "doc_id", "topic_slug", "derived_unit")


def sql_rows(fields: dict[str, float]) -> str:
    """Points of entries' texts for the schedule rows of their course, topics as rows, in DuckDB."""
    each = " UNION ALL ".join(f"SELECT course_id, doc_id, unnest({sql_tokens(f)}) AS a, {w}::DOUBLE AS w FROM entries" for f, w in fields.items())
    whole = " UNION ALL ".join(f"SELECT course_id, doc_id, {f} AS t, {w}::DOUBLE AS w FROM entries" for f, w in fields.items())
    return f"""r AS (SELECT course_id, topic_ord AS row_index, unit_slug, topic_slug, topic_ord = min(topic_ord) OVER (PARTITION BY course_id, unit_slug) AS anchor, {sql_norm('topic_label')} AS x FROM topics),
rt AS (SELECT course_id, row_index, unnest({sql_tokens('x')}) AS b FROM r),
et AS (SELECT course_id, doc_id, a, sum(w) AS w FROM ({each}) GROUP BY ALL),
op AS (SELECT et.course_id, doc_id, row_index, sum(w * CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.45 WHEN length(a) >= 5 AND length(b) >= 5 AND left(a, 5) = left(b, 5) THEN 0.2 ELSE 0 END) AS s FROM et JOIN rt USING (course_id) GROUP BY ALL HAVING s > 0),
ins AS (SELECT e.course_id, doc_id, row_index, sum(least(1.5, greatest(0.35, length(t) / 18.0)) * w) AS s FROM ({whole}) e JOIN r ON r.course_id = e.course_id AND t <> '' AND contains(x, t) GROUP BY ALL),
rs AS (SELECT course_id, doc_id, row_index, sum(s)::DOUBLE AS s FROM (SELECT * FROM op UNION ALL SELECT * FROM ins) GROUP BY ALL)"""


_SQL_ROWS = sql_rows({"title": 1.25, "body": 1.0})


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics as schedule rows; the rows of a unit are a block."""
    t = topics(spark, sf_dir)
    return t.select("course_id", F.col("topic_ord").alias("row_index"), X.match_text("topic_label").alias("content_norm"), F.col("unit_slug").alias("block_id"), F.lit(False).alias("ignored"), "topic_slug")


def _entry_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = scoring.signals(documents(spark, sf_dir)).select("course_id", "doc_id", "s_title", "s_body", scoring.is_exercise().alias("exercise"))
    e = staged(e, "entries")  # the texts are read several times
    return e, scoring.row_scores(e, _rows(spark, sf_dir), ["doc_id"], {"s_title": 1.25, "s_body": 1.0})


@query("row_overlap", f"""WITH {SQL_TOPICS}, {SQL_ENTRIES}, {_SQL_ROWS} SELECT course_id, doc_id, row_index, round(s, 6)::DOUBLE AS score FROM rs""")
def row_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and whole texts of documents against the schedule rows of their course. J7"""
    return _entry_rows(spark, sf_dir)[1].select("course_id", "doc_id", "row_index", F.round("score", 6).alias("score"))


@query("block_scores", f"""WITH {SQL_TOPICS}, {SQL_ENTRIES}, {_SQL_ROWS},
m AS (SELECT course_id, doc_id, unit_slug, coalesce(sum(s) FILTER (anchor), 0) AS a, coalesce(sum(s) FILTER (NOT anchor), 0) AS o FROM rs JOIN r USING (course_id, row_index) GROUP BY ALL),
k AS (SELECT course_id, unit_slug, unit_slug = 'unit-0' AS preferred, min_by(topic_slug, row_index) AS topic, list(topic_slug) AS listed FROM r GROUP BY ALL)
SELECT e.course_id, e.doc_id, k.unit_slug AS block_id, round(1.15 * coalesce(a, 0) + least(2.25, 0.18 * coalesce(o, 0)) + CASE WHEN preferred THEN 0.35 + 0.25 * 0.6 ELSE -0.45 END
  + CASE e.doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN preferred THEN 0.8 + 0.35 * 0.5 ELSE -0.18 END ELSE CASE WHEN k.topic = x.topic THEN 0.8 + 0.35 * 0.5 WHEN list_contains(listed, x.topic) THEN 0.48 ELSE -0.18 END END, 6)::DOUBLE AS score
FROM entries e JOIN k USING (course_id) JOIN (SELECT course_id, min_by(topic_slug, row_index) FILTER (unit_slug = 'unit-0') AS topic0, max_by(topic_slug, row_index) AS topic FROM r GROUP BY ALL) x USING (course_id) LEFT JOIN m USING (course_id, doc_id, unit_slug)""")
def block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all blocks of their course; unit-0 is preferred, and for some a topic of it or of the last row. J8"""
    entries, scored = _entry_rows(spark, sf_dir)
    rows = _rows(spark, sf_dir)
    blocks = rows.groupBy("course_id", "block_id").agg(F.col("block_id").alias("block_unit"), F.lit(0.6).alias("unit_confidence"), F.min_by("topic_slug", "row_index").alias("primary_topic_slug"), F.lit(0.5).alias("primary_topic_confidence"), F.collect_list("topic_slug").alias("topic_slugs"))
    chosen = rows.groupBy("course_id").agg(F.min_by("topic_slug", F.when(F.col("block_id") == "unit-0", F.col("row_index"))).alias("t1"), F.max_by("topic_slug", "row_index").alias("t2"))
    topic = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("t1")).otherwise(F.col("t2"))
    pairs = entries.select("course_id", "doc_id", "exercise").join(chosen, "course_id").join(blocks.select("course_id", "block_id"), "course_id")
    pairs = pairs.select("course_id", "doc_id", "block_id", "exercise", F.lit("unit-0").alias("preferred_unit"), topic.alias("preferred_topic"))
    return scoring.block_scores(pairs, blocks, rows, scored, ["doc_id"]).select("course_id", "doc_id", "block_id", F.round("score", 6).alias("score"))


@query("card_scores", f"""
WITH {SQL_TOPICS}, e AS (SELECT source AS course_id, doc_id, {sql_norm('text')} AS x FROM documents), c AS (SELECT course_id, {sql_norm('topic_label')} AS k, kind FROM topics),
t AS (SELECT *, list_distinct({sql_tokens('x')}) AS w FROM e), d AS (SELECT *, list_distinct({sql_tokens('k')}) AS kw FROM c),
h AS (SELECT doc_id, kind, CASE WHEN len(kw) = 0 OR len(w) = 0 THEN 0 WHEN contains(x, k) THEN 0.5 ELSE (CASE len(list_filter(kw, lambda y: list_contains(w, y))) WHEN 0 THEN 0 WHEN 1 THEN 0.16 ELSE 0.34 END) END AS p FROM t JOIN d USING (course_id))
SELECT doc_id, round(least(0.7, sum(CASE WHEN p > 0 THEN p + CASE WHEN kind = 'topic' THEN 0.05 ELSE 0.03 END ELSE 0 END)), 6)::DOUBLE AS card_score FROM h GROUP BY doc_id""")
def card_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of cards in whole documents. J22"""
    texts = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), "doc_id", X.match_text("text").alias("text_norm"))
    cards = topics(spark, sf_dir).select("course_id", X.match_text("topic_label").alias("card_norm"), "kind")
    return scoring.card_scores(texts, cards, ["doc_id"]).select("doc_id", F.round("card_score", 6).alias("card_score"))


@query("heading_cues", f"""
WITH t AS (SELECT source AS course_id, unnest({sql_tokens(sql_norm('text'))}) AS token FROM documents), n AS (SELECT course_id, token, count(*) AS n FROM t GROUP BY ALL)
SELECT course_id, token, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY n DESC, token) AS rank FROM n) WHERE rank <= 24""")
def heading_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 most frequent words of each course's texts. A3"""
    return taxonomy.heading_cues(table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.col("text").alias("line")))


@query("tool_candidates")
def tool_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that may be tools in the documents of a course. A4"""
    return taxonomy.tool_candidates(table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.col("doc_id").alias("source"), "text"))


@query("glossary_evidence", f"""
WITH {SQL_TOPICS}, d AS (SELECT source AS course_id, doc_id, {sql_norm('left(text, 4000)')} AS h FROM documents), t AS (SELECT course_id, topic_label AS term, {sql_norm('topic_label')} AS n FROM topics),
p AS (SELECT course_id, term, doc_id, 8 * (n <> '' AND contains(h, n))::INT + len(list_filter(list_distinct({sql_tokens('n')}), lambda x: contains(h, x))) AS points FROM t JOIN d USING (course_id))
SELECT course_id, term, points::INT AS points, doc_id AS doc_ord FROM (SELECT *, row_number() OVER (PARTITION BY course_id, term ORDER BY points DESC, doc_id) AS r FROM p WHERE points >= 3) WHERE r = 1""")
def glossary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document for each glossary term of its course. J17"""
    terms = topics(spark, sf_dir).select("course_id", F.col("topic_label").alias("term"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.col("doc_id").alias("doc_ord"), X.match_text(F.substring("text", 1, 4000)).alias("haystack"))
    return profiles.glossary_evidence(terms, docs)


#: Seed rules of the query, as data: needle, definition, synonyms, what it is not.
RULES = [("inthe", "Regra um.", "um", "dois"), ("ther", "Regra dois.", "", "um"), ("estand", "Regra tres.", "tres", "")]


@query("best_sentences", rf"""
WITH {SQL_TOPICS}, d AS (SELECT source AS course_id, doc_id, text, {sql_norm('left(text, 4000)')} AS h FROM documents), t AS (SELECT DISTINCT course_id, topic_label AS term, {sql_norm('topic_label')} AS n FROM topics),
p AS (SELECT t.course_id, term, n, doc_id, text, 8 * (n <> '' AND contains(h, n))::INT + len(list_filter(list_distinct({sql_tokens('n')}), lambda x: contains(h, x))) AS points FROM t JOIN d USING (course_id)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id, term ORDER BY points DESC, doc_id) AS r FROM p WHERE points >= 3) WHERE r = 1),
s AS (SELECT course_id, term, n, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(regexp_replace({SQL_WS.format("coalesce(text, '')")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM f)),
q AS (SELECT *, {sql_norm('s')} AS sn FROM s WHERE length(s) BETWEEN 40 AND 220 AND NOT regexp_matches(s, 'https?://|\||^[^\w]*\d+[^\w]*$')),
k AS (SELECT *, 6 * (n <> '' AND contains(sn, n))::INT + len(list_filter(list_distinct({sql_tokens('n')}), lambda x: list_contains({sql_tokens('sn')}, x))) AS points FROM q),
w AS (SELECT course_id, term, CASE WHEN length(s) <= 180 THEN s ELSE regexp_replace(left(s, 177), '\s+\S*$', '') || '...' END AS s FROM (SELECT *, row_number() OVER (PARTITION BY course_id, term ORDER BY points DESC, i) AS r FROM k WHERE points > 0) WHERE r = 1)
SELECT t.course_id, t.term, coalesce({"CASE " + " ".join(f"WHEN contains(n, '{r[0]}') THEN '{r[1]}'" for r in RULES) + " END"}, s, '') AS definition, {", ".join("coalesce(CASE " + " ".join(f"WHEN contains(n, '{r[0]}') THEN '{r[k]}'" for r in RULES) + f" END, '') AS {name}" for k, name in ((2, "synonyms"), (3, "not_confuse")))}
FROM t LEFT JOIN w USING (course_id, term)""")
def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentence for each term in its best document, and the fields that rules give or it fills. F25, F26"""
    terms = topics(spark, sf_dir).select("course_id", F.col("topic_label").alias("term")).distinct()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), "text")
    found = glossary_evidence(spark, sf_dir).join(docs, "doc_ord").select("course_id", "term", "text", F.col("term").alias("term_key"))
    evidence = taxonomy.best_sentence(found, ["course_id", "term_key"]).select("course_id", F.col("term_key").alias("term"), "sentence")
    return taxonomy.seeded_fields(terms, RULES, evidence)


_FIRST_LINE = SQL_WS.format(SQL_LINES.format("coalesce(text, '')") + "[1]")


def _first_line() -> F.Column:
    return X.collapse_ws(F.get(X.text_lines("text"), F.lit(0)))


@query("heading_support", f"""
WITH {SQL_TOPICS}, h AS (SELECT source AS course_id, {_FIRST_LINE} AS heading, doc_id AS ord FROM documents),
hs AS (SELECT *, {sql_norm('heading')} AS hn, {sql_stems('heading')} AS hs FROM h), ts AS (SELECT course_id, topic_slug, topic_ord, kind, {sql_norm('topic_label')} AS tn, {sql_stems('topic_label')} AS ts FROM topics),
p AS (SELECT hs.*, topic_slug, topic_ord, kind, tn, len(list_intersect(hs, ts)) AS n FROM hs JOIN ts USING (course_id) WHERE len(hs) > 0 AND len(ts) > 0),
b AS (SELECT *, CASE WHEN hn = tn THEN 10 WHEN contains(hn, tn) OR contains(tn, hn) THEN 8 WHEN n >= 2 THEN 5.5 + 0.4 * n WHEN n = 1 AND len(hs) BETWEEN 2 AND 6 THEN CASE WHEN {sql_any('hn', vocab.OVERLAP_CUES)} THEN 3.4 WHEN {sql_any('hn', vocab.WEAK_CUES)} THEN 2.8 ELSE 0 END ELSE 0 END + CASE WHEN kind = 'subtopic' THEN 0.08 ELSE 0 END AS points FROM p)
SELECT course_id, heading, ord, topic_slug, round(points, 6)::DOUBLE AS points FROM (SELECT *, row_number() OVER (PARTITION BY course_id, heading, ord ORDER BY points DESC, topic_ord) AS r FROM b WHERE points >= 2.8) WHERE r = 1""")
def heading_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic that supports each document's heading (its first line). J16"""
    heads = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), _first_line().alias("heading"), F.col("doc_id").alias("ord"))
    return taxonomy.heading_support(heads, topics(spark, sf_dir)).withColumn("points", F.round("points", 6))


@query("tag_catalog", f"""
WITH {SQL_TOPICS}, c AS (SELECT course_id, topic_label AS t FROM topics UNION SELECT course_id, alias FROM topics), base AS (SELECT * FROM c WHERE {sql_candidate('t')}),
h AS (SELECT DISTINCT source AS course_id, array_to_string(string_split({_FIRST_LINE}, ' ')[1:4], ' ') AS t FROM documents), hg AS (SELECT * FROM h WHERE {sql_candidate('t')}),
bs AS (SELECT course_id, {sql_norm('t')} AS n, {sql_stems('t')} AS s FROM base), hs AS (SELECT course_id, t, {sql_norm('t')} AS n, {sql_stems('t')} AS s FROM hg),
j AS (SELECT hs.course_id, t, hs.n AS hn, bs.n AS bn, len(hs.s) AS mine, len(bs.s) AS other, len(list_intersect(hs.s, bs.s)) AS k FROM hs JOIN bs USING (course_id) WHERE len(hs.s) > 0 AND len(bs.s) > 0),
ok AS (SELECT DISTINCT course_id, t FROM j WHERE contains(hn, bn) OR contains(bn, hn) OR (k = 1 AND mine BETWEEN 2 AND 4 AND {sql_any('hn', vocab.OVERLAP_CUES)}) OR (k >= 2 AND ((k = other AND mine - k <= 1) OR (k = mine AND other - k <= 1)))),
tags AS (SELECT course_id, 'topico:' || {sql_slug('t')} AS tag FROM (SELECT * FROM base UNION SELECT * FROM ok UNION SELECT * FROM hg WHERE course_id NOT IN (SELECT course_id FROM base))
  UNION SELECT course_id, 'ferramenta:' || {sql_slug('tool')} FROM (SELECT course_id, {sql_norm('t')} AS n FROM h) h JOIN (SELECT unnest({vocab.KNOWN_TOOLS}) AS tool) k ON contains(n, trim(regexp_replace(tool, '[^a-z0-9 ]', ' ', 'g'))))
SELECT course_id, array_to_string(list_sort(list_distinct(list(tag))), ' ') AS tags FROM tags WHERE tag NOT LIKE '%:untitled' GROUP BY course_id""")
def tag_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each course from labels and aliases of its topics and from the beginnings of its documents. A5, P14"""
    t = topics(spark, sf_dir)
    c = t.select("course_id", F.col("topic_label").alias("text")).union(t.select("course_id", F.get("aliases", F.lit(0))))
    heads = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.array_join(F.slice(F.split(_first_line(), " "), 1, 4), " ").alias("text")).distinct()
    return taxonomy.tag_catalog(c, heads).select("course_id", F.array_join("tags", " ").alias("tags"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct parts of whole texts between marks, as headings of their course."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.explode(F.split(F.coalesce("text", F.lit("")), r"[.!?;:,\n]")).alias("text"))
    return d.select("course_id", F.trim("text").alias("text")).filter("text != '' and course_id is not null").distinct()


_SQL_OWN = f"{sql_candidate('t')} AND NOT coalesce(contains(n, tool), false) AND n IS DISTINCT FROM stop AND g <> {sql_slug('course_id')}"


@query("course_tag_catalogs", rf"""
WITH {SQL_TOPICS}, v0 AS (SELECT course_id, arg_min(text, topic_ord) AS a, arg_max(alias, topic_ord) AS stop0 FROM topics GROUP BY course_id),
v AS (SELECT course_id, (SELECT arg_min(x, (-length(x), x)) FROM (SELECT unnest(string_split({sql_norm('a')}, ' ')) AS x)) AS tool, {sql_norm('stop0')} AS stop FROM v0),
c AS (SELECT course_id, topic_label AS t FROM topics UNION SELECT course_id, alias FROM topics),
h AS (SELECT DISTINCT source AS course_id, trim(unnest(string_split_regex(coalesce(text, ''), '[.!?;:,\n]'))) AS t FROM documents WHERE source IS NOT NULL), h1 AS (SELECT * FROM h WHERE t <> ''),
q0 AS (SELECT course_id, w, count(*) AS k FROM (SELECT course_id, unnest({sql_tokens(sql_norm('t'))}) AS w FROM h1) GROUP BY ALL), q AS (SELECT course_id, w, row_number() OVER (PARTITION BY course_id ORDER BY k DESC, w) AS k FROM q0), cues AS (SELECT course_id, list(w) AS ws FROM q WHERE k <= 24 GROUP BY course_id),
cn AS (SELECT c.*, tool, stop, {sql_norm('t')} AS n, {sql_slug('t')} AS g FROM c JOIN v USING (course_id)), hn0 AS (SELECT h1.*, tool, stop, {sql_norm('t')} AS n, {sql_slug('t')} AS g FROM h1 LEFT JOIN v USING (course_id)),
base AS (SELECT course_id, t, n FROM cn WHERE {_SQL_OWN}),
hg AS (SELECT course_id, t, n FROM hn0 WHERE {_SQL_OWN}),
bs AS (SELECT DISTINCT course_id, n, {sql_stems('t')} AS s FROM base), hs AS (SELECT course_id, t, n, {sql_stems('t')} AS s FROM hg),
j AS (SELECT hs.course_id, t, hs.n AS hn, bs.n AS bn, len(hs.s) AS mine, len(bs.s) AS other, len(list_intersect(hs.s, bs.s)) AS k FROM hs JOIN bs USING (course_id) WHERE len(hs.s) > 0 AND len(bs.s) > 0),
ok AS (SELECT DISTINCT j.course_id, t FROM j LEFT JOIN cues USING (course_id) WHERE contains(hn, bn) OR contains(bn, hn) OR (k = 1 AND mine BETWEEN 2 AND 4 AND ({sql_any('hn', vocab.OVERLAP_CUES)} OR len(list_filter(ws, lambda x: contains(hn, x))) > 0)) OR (k >= 2 AND ((k = other AND mine - k <= 1) OR (k = mine AND other - k <= 1)))),
tags AS (SELECT course_id, 'topico:' || {sql_slug('t')} AS tag FROM (SELECT course_id, t FROM base UNION SELECT * FROM ok UNION SELECT course_id, t FROM hg WHERE course_id NOT IN (SELECT course_id FROM base))
  UNION SELECT course_id, 'ferramenta:' || {sql_slug('tool')} FROM hn0 WHERE contains(n, tool)
  UNION SELECT course_id, 'ferramenta:' || {sql_slug('k.tool')} FROM hn0 JOIN (SELECT unnest({vocab.KNOWN_TOOLS}) AS tool) k ON contains(n, trim(regexp_replace(k.tool, '[^a-z0-9 ]', ' ', 'g'))))
SELECT course_id, len(list_distinct(list(tag)))::INT AS n_tags, array_to_string(list_sort(list_distinct(list(tag))), ' ') AS tags FROM tags WHERE tag NOT LIKE '%:untitled' GROUP BY course_id""")
def course_tag_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each course by vocabularies of its own: a tool and a stop heading of its topics, cues of all its texts. A3, A5, P14, U4"""
    t = topics(spark, sf_dir)
    c = t.select("course_id", F.col("topic_label").alias("text")).union(t.select("course_id", F.get("aliases", F.lit(0))))
    heads = staged(_pieces(spark, sf_dir), "pieces", "zstd")  # read for cues and for tags
    of = t.groupBy("course_id").agg(F.min_by("text", "topic_ord").alias("a"), F.max_by(F.get("aliases", F.lit(0)), "topic_ord").alias("stop"))
    longest = F.array_min(F.transform(F.split(X.match_text("a"), " "), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]
    own = of.select("course_id", F.inline(F.array(F.struct(F.lit("tool").alias("kind"), longest.alias("word")), F.struct(F.lit("whole").alias("kind"), X.match_text("stop").alias("word")))))
    vocabulary = profiles.course_vocabulary(t.select("course_id").union(heads.select("course_id")), heads=heads.select("course_id", F.col("text").alias("line")), overrides=own, again=True)
    return profiles.course_tags(c, heads, vocabulary).select("course_id", F.size("tags").alias("n_tags"), F.array_join("tags", " ").alias("tags"))


_SQL_PHRASE = f"{sql_norm("replace(regexp_extract(tag, '^[^:]*:(.*)$', 1), '-', ' ')")}"
_SQL_REVIEW = f"{sql_any('{0}', vocab.REVIEW_CUES)} AND regexp_matches({{0}}, '(?:^|[^a-z0-9])(?:{'|'.join(vocab.EXAM_CUES)})(?:$|[^a-z0-9])')"


@query("auto_tags", rf"""
WITH {SQL_TOPICS}, c AS (SELECT DISTINCT course_id, array_to_string(string_split(topic_label, ' ')[1:k], ' ') AS t FROM topics, (SELECT unnest([1, 2]) AS k)),
g AS (SELECT DISTINCT course_id, 'topico:' || {sql_slug('t')} AS tag FROM c WHERE {sql_candidate('t')}), cat AS (SELECT *, {_SQL_PHRASE} AS ph, row_number() OVER (PARTITION BY course_id ORDER BY tag) AS o FROM g WHERE tag NOT LIKE '%:untitled'),
l AS (SELECT source AS course_id, doc_id, left(text, 60) AS title, CASE doc_id % 4 WHEN 0 THEN 'listas' WHEN 1 THEN 'provas' WHEN 2 THEN 'material-de-aula' ELSE 'outros' END AS category, CASE WHEN doc_id % 3 = 0 THEN 'Simulado ' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN 'P2 ' ELSE '' END AS said, {SQL_LINES.format("'# ' || coalesce(text, '')")} AS l FROM documents),
e AS (SELECT *, {sql_norm("title")} AS tn, {sql_norm(r"array_to_string(list_filter(list_transform(list_filter(l, lambda x: regexp_matches(x, '^#{1,6}\s+(.+?)\s*$')), lambda x: trim(regexp_replace(regexp_extract(x, '^#{1,6}\s+(.+?)\s*$', 1), '\s+', ' ', 'g'))), lambda x: x <> '')[1:8], ' ')")} AS hn, {sql_norm("said")} AS rn FROM l),
s AS (SELECT *, trim(tn || ' ' || hn) AS n, trim(tn || ' ' || rn || ' ' || hn) AS r FROM e), w AS (SELECT *, list_distinct({sql_tokens('n')}) AS w FROM s),
m AS (SELECT course_id, doc_id, tag, o FROM w JOIN cat USING (course_id) WHERE ph <> '' AND CASE WHEN len({sql_tokens('ph')}) = 1 THEN length({sql_tokens('ph')}[1]) >= 5 AND list_contains(w, {sql_tokens('ph')}[1]) ELSE contains(n, ph) OR (len({sql_tokens('ph')}) >= 2 AND len(list_filter({sql_tokens('ph')}, lambda y: NOT list_contains(w, y))) = 0) END),
a AS (SELECT course_id, doc_id, list(tag ORDER BY o) AS tags FROM m GROUP BY ALL)
SELECT w.course_id, w.doc_id AS entry_id, array_to_string(list_concat(coalesce(a.tags, []), CASE category WHEN 'listas' THEN ['tipo:lista'] WHEN 'provas' THEN ['tipo:prova'] WHEN 'material-de-aula' THEN ['tipo:material-base'] ELSE [] END, CASE WHEN {_SQL_REVIEW.format('r')} THEN ['uso:revisao-prova'] ELSE [] END)[1:6], '; ') AS auto_tags
FROM w LEFT JOIN a ON a.course_id = w.course_id AND a.doc_id = w.doc_id""")
def auto_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic tags of every document from its course's catalogue, with its first line as a heading. A6, F32"""
    t = topics(spark, sf_dir)
    words = F.split("topic_label", " ")
    catalog_ = taxonomy.tag_catalog(t.select("course_id", F.explode(F.array(*(F.array_join(F.slice(words, 1, k), " ") for k in (1, 2)))).alias("text")))
    d = documents(spark, sf_dir)
    category = F.expr("case doc_id % 4 when 0 then 'listas' when 1 then 'provas' when 2 then 'material-de-aula' else 'outros' end")
    said = F.expr("concat(if(doc_id % 3 = 0, 'Simulado ', ''), if(doc_id % 7 = 0, 'P2 ', ''))")
    e = d.select("course_id", F.col("doc_id").alias("entry_id"), "title", F.array_join(X.headings(F.concat(F.lit("# "), "markdown")), " ").alias("head_text"), category.alias("category"), said.alias("raw_target"))
    return taxonomy.auto_tags(e, catalog_).select("course_id", "entry_id", F.array_join("auto_tags", "; ").alias("auto_tags"))


@query("taxonomy_merge", """
WITH t AS (SELECT p_size::VARCHAR AS course_id, p_brand AS topic_slug, p_partkey AS o, p_name AS label, p_type AS alias FROM part)
SELECT course_id, topic_slug, min_by(label, o) AS topic_label, min_by('unit-' || (o % 5), o % 5 * 100000000 + o) AS unit_slug, len(list_distinct(list(lower(alias))))::INT AS n_aliases FROM t GROUP BY ALL""")
def taxonomy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of one slug merged: parts by brand. W13"""
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_size").cast("string").alias("course_id"), F.col("p_brand").alias("topic_slug"), F.lit(0).alias("unit_ord"), F.col("p_partkey").alias("topic_ord"), F.lit("").alias("topic_code"), F.col("p_name").alias("topic_label"), F.lit("topic").alias("kind"), F.concat(F.lit("unit-"), F.col("p_partkey") % 5).alias("unit_slug"), F.array("p_type").alias("aliases"))
    merged = taxonomy.merge_topics(t.withColumn("unit_ord", (F.col("topic_ord") % 5).cast("int")))
    first = t.groupBy("course_id", "topic_slug").agg(F.min_by("topic_label", "topic_ord").alias("topic_label"))
    return merged.drop("topic_label").join(first, ["course_id", "topic_slug"]).select("course_id", "topic_slug", "topic_label", "unit_slug", F.size("aliases").alias("n_aliases"))


@query("glossary_aliases", f"""
WITH t AS (SELECT DISTINCT p_size::VARCHAR AS course_id, {sql_slug('p_type')} AS topic_slug, p_type AS label, {sql_norm('p_type')} AS ln FROM part),
g AS (SELECT DISTINCT p_size::VARCHAR AS course_id, string_split(p_type, ' ')[-1] AS term, p_brand AS synonym FROM part),
m AS (SELECT t.course_id, topic_slug, label, unnest([term, synonym]) AS alias FROM t JOIN g USING (course_id) WHERE ln = {sql_norm('term')} OR (length({sql_norm('term')}) >= 4 AND contains(ln, {sql_norm('term')})) OR (length(ln) >= 4 AND contains({sql_norm('term')}, ln))),
o AS (SELECT course_id, topic_slug, {sql_slug('alias')} AS s, min(alias) AS alias FROM m WHERE {sql_slug('alias')} <> {sql_slug('label')} GROUP BY ALL)
SELECT course_id, topic_slug, array_to_string(list_sort(list_distinct(list(alias))), '; ') AS aliases FROM o GROUP BY ALL""")
def glossary_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of part types from the names of parts as glossary terms. J15"""
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_size").cast("string").alias("course_id"), X.slugify("p_type").alias("topic_slug"), F.col("p_type").alias("topic_label"), F.lit("unit").alias("unit_slug")).distinct()
    terms = p.select(F.col("p_size").cast("string").alias("course_id"), F.element_at(F.split("p_type", " "), -1).alias("term"), F.lit("").alias("unit_hint"), F.array("p_brand").alias("synonyms")).distinct()
    return taxonomy.glossary_aliases(t, terms).withColumn("aliases", F.array_join("aliases", "; "))


@query("mojibake", "SELECT doc_id, md5(coalesce(text, '')) AS repaired_md5, 0 AS left_over FROM documents")
def mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts decoded wrongly on purpose and repaired. F12"""
    broken = table(spark, sf_dir, "documents").select("doc_id", F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "ISO-8859-1").alias("t"))
    fixed = broken.select("doc_id", D.repair_mojibake(F.col("t")).alias("t"))
    return fixed.select("doc_id", F.md5("t").alias("repaired_md5"), X.mojibake_score("t").alias("left_over"))


@query("math_symbols", r"""SELECT doc_id, md5(replace(replace(coalesce(text, ''), '$', ''), ' the ', ' $\leq$ ')) AS math_md5 FROM documents""")
def math_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of texts as LaTeX (a sign stands for a frequent word). F14"""
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("$"), F.lit("")), F.lit(" the "), F.lit(" ≤ "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(D.unicode_math(t)).alias("math_md5"))


@query("latex_scores", r"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS s FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(s, '\$')) AS d, len(regexp_extract_all(s, '\{')) - len(regexp_extract_all(s, '\}')) AS b FROM c)
SELECT doc_id, least(100, CASE WHEN d % 2 = 1 THEN 30 ELSE 0 END + least(25, 5 * abs(b)))::INT AS score, d % 2 = 1 OR abs(b) >= 5 AS detected FROM n""")
def latex_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of broken LaTeX in every text. F15"""
    return table(spark, sf_dir, "documents").select("doc_id", X.latex_corruption("text").alias("x")).select("doc_id", "x.score", "x.detected")


@query("line_rescue")
def line_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without accents replaced by the accented ones of another extraction. J20"""
    pairs = table(spark, sf_dir, "documents").select("doc_id", X.fold("text").alias("advanced"), F.col("text").alias("base"))
    out = D.line_rescue(pairs, ["doc_id"], "doc_id long")
    return out.select("doc_id", F.md5("markdown").alias("markdown_md5"), "n_rescued")


@query("page_list", """
WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 7 + 1)::INT AS a, (o_custkey % 9 + 1)::INT AS b FROM orders)
SELECT k AS order_id, array_to_string(list_sort(list_distinct(list_concat(range(least(a, b) - 1, greatest(a, b)), [a + 9]))), ',') AS pages FROM o""")
def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of orders as lists of pages. P18"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%d-%d, %d", F.col("o_orderkey") % 7 + 1, F.col("o_custkey") % 9 + 1, F.col("o_orderkey") % 7 + 11).alias("t"))
    return o.select(F.col("o_orderkey").alias("order_id"), F.array_join(catalog.page_list(F.col("t")), ",").alias("pages"))


