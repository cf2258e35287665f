"""Queries over schedules, periods, pages, images, study progress and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemill.functions import html as H, text as X, vocab
from coursemill.operators import documents as D, progress as P, scoring as S, timeline as T
from coursemill.plans.tables import SQL_TOPICS, SQL_WS, documents, query, sql_any, sql_norm, sql_tokens, table, topics
from coursemill.plans.text_queries import SQL_ENTRIES, SQL_SCORED, SQL_UNIT_WORDS, course_units, sql_rows
from coursemill.sources.staging import scratch, staged
from coursemill.streaming import jobs, study


# schedules

def _schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a schedule: a row per turn with a date and its whole text."""
    c = table(spark, sf_dir, "conversations")
    day = F.date_format(F.date_add(F.lit("2026-03-02").cast("date"), F.col("turn").cast("int") * 2), "dd/MM/yyyy")
    words = X.collapse_ws(F.regexp_replace("text", r"[|]", " "))
    row = F.struct("turn", F.concat(F.lit("| "), day, F.lit(" | "), words, F.when(F.col("turn") % 5 == 4, " {kind=event}").otherwise(""), F.lit(" |")).alias("t"))
    text = F.array_join(F.concat(F.array(F.lit("# Cronograma"), F.lit("| Data | Conteúdo |"), F.lit("|---|---|")), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"])), "\n")
    return c.groupBy("conv_id").agg(text.alias("schedule")).withColumnRenamed("conv_id", "course_id")


@query("schedule_rows", r"""
WITH r AS (SELECT conv_id AS course_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row_index, turn, trim(regexp_replace(replace(text, '|', ' '), '\s+', ' ', 'g')) AS w FROM conversations)
SELECT course_id, row_index::INT AS row_index, trim(w) AS content, (DATE '2026-03-02' + (turn * 2)::INT)::DATE AS date_dt, CASE WHEN turn % 5 = 4 THEN 'event' ELSE 'class' END AS kind, turn % 5 = 4 AS ignored FROM r""")
def schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of Markdown schedules with dates, kinds and content. S7, F2, F7, F8"""
    return T.candidate_rows(T.read_schedule(_schedules(spark, sf_dir))).select("course_id", "row_index", "content", "date_dt", "kind", "ignored")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.block_attributes(T.segment_blocks(T.candidate_rows(T.read_schedule(_schedules(spark, sf_dir)))))


_SQL_GENERIC = f"{vocab.SCHEDULE_GENERIC}"
SQL_SEGMENTS = rf"""sr AS (SELECT conv_id AS course_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, trim(trim(regexp_replace(replace(text, '|', ' '), '\s+', ' ', 'g'))) AS content FROM conversations),
sn AS (SELECT *, {sql_norm('content')} AS n, string_split_regex(content, '\s*:\s*') AS colon, string_split_regex(content, '\s+[—–-]\s+') AS dash FROM sr WHERE content <> ''),
sc AS (SELECT *, CASE WHEN len(colon) > 1 AND len(list_filter({sql_tokens(sql_norm('colon[1]'))}, lambda x: NOT list_contains({_SQL_GENERIC}, x))) >= 2 THEN {sql_norm('colon[1]')} WHEN len(dash) > 1 AND len(list_filter({sql_tokens(sql_norm('dash[1]'))}, lambda x: NOT list_contains({_SQL_GENERIC}, x))) >= 2 THEN {sql_norm('dash[1]')} ELSE n END AS core FROM sn),
sf AS (SELECT course_id, row_number() OVER (PARTITION BY course_id ORDER BY i) AS i, turn, content, n, core, list_filter({sql_tokens('n')}, lambda x: NOT list_contains({_SQL_GENERIC}, x)) AS words, list_filter({sql_tokens('core')}, lambda x: NOT list_contains({_SQL_GENERIC}, x)) AS cw,
    n IN ('p1', 'p2', 'p3', 'pf') OR regexp_matches(n, '{"|".join(vocab.REVIEW_WORDS)}') AS review, regexp_matches(n, '{"|".join(vocab.CONTINUATION_WORDS)}') AS cont, regexp_matches(n, '{"|".join(vocab.ADMIN_PHRASES)}') AS admin FROM sc),
st AS (SELECT *, contains(n, 'unidade') AND len(words) <= 2 AS anchor FROM sf),
seg AS (SELECT course_id, i, 1 AS no, words AS seen, anchor AS anchors, core, cw FROM st WHERE i = 1
UNION ALL SELECT s.course_id, s.i, CASE WHEN s.j THEN s.no ELSE s.no + 1 END, CASE WHEN s.j THEN list_concat(s.seen, s.words) ELSE s.words END, s.anchor AND (s.anchors OR NOT s.j), s.core, s.cw FROM (
  SELECT t.*, g.no, g.seen, g.anchors, CASE WHEN t.review THEN false WHEN t.cont THEN len(g.seen) > 0 AND NOT g.anchors WHEN len(t.cw) = 0 THEN true
    ELSE (g.core <> '' AND t.core <> '' AND (g.core = t.core OR ((contains(g.core, t.core) OR contains(t.core, g.core)) AND CASE WHEN length(t.core) <= length(g.core) THEN len(list_distinct(t.cw)) ELSE len(list_distinct(g.cw)) END >= 2))) OR len(list_intersect(list_distinct(t.cw), list_distinct(g.seen))) >= 2 END AS j
  FROM seg g JOIN st t ON t.course_id = g.course_id AND t.i = g.i + 1) s)"""


@query("schedule_blocks", rf"""WITH RECURSIVE {SQL_SEGMENTS},
b AS (SELECT course_id, no, min(i) AS a, max(i) AS z, count(*) AS n_rows FROM seg GROUP BY ALL),
tp AS (SELECT course_id, no, list(core ORDER BY f)[1:6] AS topics FROM (SELECT seg.course_id, no, array_to_string(st.cw, ' ') AS core, min(st.i) AS f FROM seg JOIN st USING (course_id, i) WHERE len(st.cw) > 0 GROUP BY ALL) GROUP BY ALL),
al AS (SELECT course_id, no, list(w ORDER BY f)[1:6] AS aliases FROM (SELECT course_id, no, w, min(f) AS f FROM (SELECT seg.course_id, no, unnest(st.cw) AS w, st.i * 10000000 + generate_subscripts(st.cw, 1) AS f FROM seg JOIN st USING (course_id, i)) WHERE length(w) >= 5 GROUP BY ALL) GROUP BY ALL),
d AS (SELECT course_id, i, (DATE '2026-03-02' + (turn * 2)::INT)::DATE AS d FROM st)
SELECT b.course_id, 'bloco-' || CASE WHEN b.no < 10 THEN '0' ELSE '' END || b.no AS block_id, x.d AS period_start, y.d AS period_end, strftime(x.d, '%d/%m/%Y') || CASE WHEN x.d = y.d THEN '' ELSE ' a ' || strftime(y.d, '%d/%m/%Y') END AS period_label,
  coalesce(array_to_string(topics, '; '), '') AS topics, coalesce(array_to_string(aliases, '; '), '') AS aliases, n_rows::INT AS n_rows
FROM b JOIN d x ON x.course_id = b.course_id AND x.i = a JOIN d y ON y.course_id = b.course_id AND y.i = z LEFT JOIN tp ON tp.course_id = b.course_id AND tp.no = b.no LEFT JOIN al ON al.course_id = b.course_id AND al.no = b.no""")
def schedule_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules cut into blocks by theme. W5, W6"""
    return _blocks(spark, sf_dir).select("course_id", "block_id", "period_start", "period_end", "period_label", F.array_join("topics", "; ").alias("topics"), F.array_join("aliases", "; ").alias("aliases"), F.size("source_rows").alias("n_rows"))


_SQL_CLASSED = "CASE turn % 6 WHEN 0 THEN 'Suspensão de aulas ' WHEN 1 THEN 'Prova 1 ' WHEN 2 THEN 'Lista de exercícios ' WHEN 3 THEN 'Unidade 2 ' ELSE '' END || coalesce(text, '')"


@query("row_classes", f"""
WITH n AS (SELECT conv_id, turn, {sql_norm(_SQL_CLASSED)} AS x FROM conversations)
SELECT conv_id, turn, {sql_any('x', vocab.ADMIN_PHRASES)} AS administrative, x IN ('p1', 'p2', 'p3', 'pf') OR {sql_any('x', vocab.REVIEW_WORDS)} AS review, {sql_any('x', vocab.CONTINUATION_WORDS)} AS continuation, len(list_filter({sql_tokens('x')}, lambda t: NOT list_contains({vocab.SCHEDULE_GENERIC}, t)))::INT AS n_specific FROM n""")
def row_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of whole texts as schedule texts and their specific words. P15"""
    n = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.match_text(F.expr(_SQL_CLASSED)).alias("x"))
    return n.select("conv_id", "turn", T.row_class(F.col("x")).alias("c"), F.size(T.specific_tokens("x")).alias("n_specific")).select("conv_id", "turn", "c.administrative", "c.review", "c.continuation", "n_specific")


def _line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as blocks: some without a unit, of which some are soft."""
    li = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    return li.select(F.col("l_orderkey").alias("course_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("block_ord"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("unit-"), F.col("l_suppkey") % 4)).alias("unit_slug"), F.lit(0.2).alias("unit_confidence"), (F.col("l_linestatus") == "O").alias("soft"), day.alias("period_start"), F.date_add(day, 3).alias("period_end"), day.cast("string").alias("period_label"))


_SQL_BLOCKS = """b AS (SELECT l_orderkey AS course_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS o, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN '' ELSE 'unit-' || (l_suppkey % 4) END AS unit, l_linestatus = 'O' AS soft, l_shipdate::DATE AS d FROM lineitem)"""


@query("inherited_units", f"""WITH RECURSIVE {_SQL_BLOCKS},
n AS (SELECT *, coalesce(lead(unit) OVER (PARTITION BY course_id ORDER BY o), '') AS next FROM b),
r AS (SELECT course_id, o, l_linenumber, l_partkey, CASE WHEN unit = '' AND soft THEN next ELSE unit END AS u, unit = '' AND soft AS open FROM n WHERE o = 1
UNION ALL SELECT n.course_id, n.o, n.l_linenumber, n.l_partkey, CASE WHEN n.unit = '' AND n.soft THEN CASE WHEN r.u <> '' THEN r.u ELSE n.next END ELSE n.unit END, n.unit = '' AND n.soft FROM r JOIN n ON n.course_id = r.course_id AND n.o = r.o + 1)
SELECT course_id, l_linenumber AS line, l_partkey AS part, u AS unit_slug, CASE WHEN open AND u <> '' THEN 0.51 ELSE 0.2 END::DOUBLE AS unit_confidence FROM r""")
def inherited_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft blocks without a unit take a neighbour's. W4"""
    return T.inherit_unit(_line_blocks(spark, sf_dir)).select("course_id", F.col("block_ord.l_linenumber").alias("line"), F.col("block_ord.l_partkey").alias("part"), "unit_slug", "unit_confidence")


@query("unit_periods", f"""WITH {_SQL_BLOCKS} SELECT course_id, unit AS unit_slug, min(d) AS start, max(d + 3)::DATE AS "end", count(*) AS n_blocks FROM b WHERE unit <> '' GROUP BY ALL""")
def unit_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of units from their blocks. A8"""
    return T.unit_periods(_line_blocks(spark, sf_dir)).select("course_id", "unit_slug", "start", "end", "n_blocks")


@query("block_topics", f"""WITH {SQL_SCORED}, p AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS second2, first_value(score) OVER w AS best, count(*) OVER (PARTITION BY course_id, doc_id) AS n, len({sql_tokens(sql_norm('topic_label'))}) AS k FROM scored WHERE score > 0 WINDOW w AS (PARTITION BY course_id, doc_id ORDER BY score DESC, topic_ord)),
q AS (SELECT *, greatest(CASE WHEN n = 1 THEN 0.72 ELSE 0 END, least(1.0, greatest(0.0, score - second2 + 0.2 * score))) AS c FROM p WHERE r = 1),
v AS (SELECT *, CASE WHEN k <= 1 THEN score < 1.85 OR c < 0.8 WHEN k = 2 THEN score < 1.75 OR c < 0.9 ELSE score < 1.35 OR c < 0.72 END AS weak FROM q), a AS (SELECT *, weak OR (n > 1 AND score - second2 < 0.7) AS amb FROM v)
SELECT a.course_id, a.doc_id AS block_id, CASE WHEN weak THEN '' ELSE a.topic_slug END AS primary_topic, l.candidates, amb AS ambiguous, round(CASE WHEN amb THEN least(c, 0.45) ELSE c END, 6)::DOUBLE AS confidence
FROM a JOIN (SELECT course_id, doc_id, array_to_string(list(topic_slug ORDER BY r), ',') AS candidates FROM p WHERE r <= 5 GROUP BY ALL) l USING (course_id, doc_id)""")
def block_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic candidates of documents as blocks. W2"""
    scored = S.topic_scores(S.signals(documents(spark, sf_dir)), topics(spark, sf_dir), rest=5).select("course_id", F.col("doc_id").alias("block_id"), "topic_ord", "topic_slug", "topic_label", "unit_slug", "score")
    out = T.block_topic_candidates(scored)
    return out.select("course_id", "block_id", F.col("primary_topic_slug").alias("primary_topic"), F.array_join(F.transform("topic_candidates", lambda x: x["topic_slug"]), ",").alias("candidates"), F.col("topic_ambiguous").alias("ambiguous"), F.round("primary_topic_confidence", 6).alias("confidence"))


@query("block_units", """
WITH s AS (SELECT l_orderkey AS course_id, l_suppkey % 3 AS u, sum(l_quantity) / 20 AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM s WHERE score > 0 WINDOW w AS (PARTITION BY course_id ORDER BY score DESC, u)),
b AS (SELECT * FROM r WHERE k = 1 AND score >= 1 AND score - second >= 0.35)
SELECT o_orderkey AS course_id, CASE WHEN o_orderkey % 4 = 0 THEN 'unit-t' WHEN o_orderstatus = 'P' THEN '' ELSE coalesce('unit-' || u, '') END AS unit_slug,
  round(CASE WHEN o_orderkey % 4 = 0 THEN 0.7 WHEN o_orderstatus = 'P' THEN 0 WHEN u IS NULL THEN 0 ELSE least(1.0, score - second + 0.18 * score) END, 6)::DOUBLE AS unit_confidence FROM orders LEFT JOIN b ON course_id = o_orderkey""")
def block_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of blocks from sure topics, else from scores. W3"""
    o = table(spark, sf_dir, "orders")
    sure = F.col("o_orderkey") % 4 == 0
    blocks = o.select(F.col("o_orderkey").alias("course_id"), F.lit("b").alias("block_id"), (F.col("o_orderstatus") != "P").alias("taught"), F.when(sure, "unit-t").otherwise("").alias("topic_unit"), F.lit(False).alias("topic_ambiguous"), F.lit(0.7).alias("topic_confidence"))
    u = F.col("l_suppkey") % 3
    scored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("course_id"), u.alias("unit_ord")).agg((F.sum("l_quantity") / 20).alias("score")).select("course_id", F.lit("b").alias("block_id"), "unit_ord", F.concat(F.lit("unit-"), "unit_ord").alias("unit_slug"), "score")
    return T.block_units(blocks, scored).select("course_id", "unit_slug", F.round("unit_confidence", 6).alias("unit_confidence"))


_SQL_SAID = "CASE WHEN doc_id % 5 = 0 THEN 'Unidade 1 ' WHEN doc_id % 5 = 1 THEN 'Feriado ' ELSE '' END || coalesce(text, '')"


@query("row_units", f"""WITH {SQL_UNIT_WORDS}, d AS (SELECT source AS course_id, doc_id, {sql_norm(_SQL_SAID)} AS x FROM documents), t AS (SELECT *, list_distinct({sql_tokens('x')}) AS held FROM d),
u AS (SELECT course_id, unit_ord, unit_slug, min_by(p, topic_ord) AS title FROM labels3 GROUP BY ALL),
ph AS (SELECT course_id, unit_ord, p, 1.0 AS share, false AS is_title, topic_ord AS o FROM labels3 WHERE p <> '' UNION ALL SELECT course_id, unit_ord, title, 0.55, true, -1 FROM u WHERE title <> ''),
pw AS (SELECT y.course_id, y.unit_ord, y.o, y.token, coalesce(1.0 / df, 1.0)::DOUBLE AS w FROM (SELECT course_id, unit_ord, o, unnest(list_filter({sql_tokens('p')}, lambda z: NOT list_contains({vocab.UNIT_NEUTRAL}, z))) AS token FROM ph) y LEFT JOIN dfs ON dfs.course_id = y.course_id AND dfs.unit_ord = y.unit_ord AND dfs.token = y.token),
fall AS (SELECT doc_id, pw.course_id, pw.unit_ord, o, count(*) AS words, count(*) FILTER (list_contains(held, token)) AS h, sum(w) FILTER (list_contains(held, token)) AS s FROM t JOIN pw USING (course_id) GROUP BY ALL),
sp AS (SELECT t.doc_id, ph.course_id, ph.unit_ord, sum(CASE WHEN contains(x, p) THEN CASE WHEN is_title THEN 2.6 ELSE 3.8 END ELSE share * CASE WHEN coalesce(h, 0) = 0 THEN 0 WHEN words = 1 THEN 1.15 * s WHEN h = words THEN 1.15 + 0.95 * s WHEN h >= 2 THEN 0.85 * s ELSE 0 END END)::DOUBLE AS s, count(*) FILTER (contains(x, p)) AS exact FROM t JOIN ph USING (course_id) LEFT JOIN fall USING (doc_id, course_id, unit_ord, o) GROUP BY ALL),
uw AS (SELECT DISTINCT course_id, unit_ord, token, list_contains({vocab.UNIT_NEUTRAL}, token) AS neutral FROM (SELECT course_id, unit_ord, unnest(list_concat(list_filter({sql_tokens('p')}, lambda z: NOT list_contains({vocab.UNIT_GENERIC}, z)), CASE WHEN contains(p, ' ') THEN [] ELSE [p] END)) AS token FROM labels3 WHERE p <> '')),
sk AS (SELECT doc_id, uw.course_id, uw.unit_ord, sum(0.95 * coalesce(1.0 / df, 1.0) * CASE WHEN neutral THEN 0.2 ELSE 1 END + CASE WHEN coalesce(df = 1 AND length(uw.token) >= 5, false) THEN CASE WHEN neutral THEN 0.8 ELSE 0.25 END ELSE 0 END)::DOUBLE AS s, count(*) FILTER (NOT neutral OR coalesce(df = 1 AND length(uw.token) >= 5, false)) AS n
    FROM t JOIN uw USING (course_id) LEFT JOIN dfs ON dfs.course_id = uw.course_id AND dfs.unit_ord = uw.unit_ord AND dfs.token = uw.token WHERE list_contains(held, uw.token) GROUP BY ALL)
SELECT t.course_id, t.doc_id, u.unit_slug, round(CASE WHEN t.doc_id % 5 = 1 OR (t.doc_id % 5 = 0 AND u.unit_ord <> 1) THEN 0 WHEN t.doc_id % 5 = 0 THEN 6.0 + coalesce(sp.s, 0) + coalesce(sk.s, 0)
    WHEN coalesce(exact, 0) = 0 AND coalesce(n, 0) = 0 THEN 0 ELSE (coalesce(sp.s, 0) + coalesce(sk.s, 0)) * CASE WHEN coalesce(exact, 0) = 0 AND n = 1 THEN 0.35 ELSE 1 END END, 6)::DOUBLE AS score
FROM t JOIN u USING (course_id) LEFT JOIN sp ON sp.doc_id = t.doc_id AND sp.course_id = t.course_id AND sp.unit_ord = u.unit_ord LEFT JOIN sk ON sk.doc_id = t.doc_id AND sk.course_id = t.course_id AND sk.unit_ord = u.unit_ord""")
def row_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against the units of their course: some name a unit by number, some are administrative. J6"""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.expr("case when doc_id % 5 = 0 then 'Unidade 1 ' when doc_id % 5 = 1 then 'Feriado ' else '' end"), F.coalesce("text", F.lit("")))
    rows = d.select(F.col("source").alias("course_id"), F.col("doc_id").alias("row_index"), X.match_text(text).alias("content_norm"))
    units = course_units(spark, sf_dir).withColumn("unit_slug", F.concat(F.lit("unidade-"), "unit_ord"))
    scored = T.row_unit_scores(rows, units)
    return scored.select("course_id", F.col("row_index").alias("doc_id"), F.concat(F.lit("unit-"), "unit_ord").alias("unit_slug"), F.round("score", 6).alias("score"))


@query("distinct_tokens", f"""WITH {SQL_TOPICS}, w AS (SELECT DISTINCT course_id, unit_slug, unnest({sql_tokens(sql_norm('text'))}) AS token FROM topics), d AS (SELECT *, count(*) OVER (PARTITION BY course_id, token) AS df FROM w)
SELECT course_id, unit_slug, token, df FROM d WHERE df = 1 OR (df <= 2 AND length(token) >= 6)""")
def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that tell the units of a schedule apart. A2"""
    t = topics(spark, sf_dir).select("course_id", "unit_slug", X.tokens(X.match_text("text")).alias("tokens"))
    return T.token_weights(t, ["course_id"], "unit_slug", "tokens").select("course_id", "unit_slug", "token", "df")


@query("assessments", """
WITH o AS (SELECT o_orderkey AS course_id, o_custkey % 5 AS k, (o_custkey % 4 + 1)::INT AS a, o_orderdate::DATE AS d, o_orderpriority AS c, left(o_orderpriority, 1)::INT AS p FROM orders),
f AS (SELECT course_id, d, unnest(CASE k WHEN 0 THEN [{'ord': 1, 'l': 'P1', 'x': 'prova das unidades ' || a || ' a ' || (a + 2) || ' ' || c, 'n': [a, a + 2, p]}] WHEN 1 THEN [{'ord': 1, 'l': 'P2', 'x': 'prova 2 com ' || a || ' ' || c, 'n': [a, p]}]
  WHEN 2 THEN [{'ord': 1, 'l': 'PROVA ' || a, 'x': c || ' conteudos ' || a || ', 30 e 2', 'n': [a, 2]}] ELSE [] END, recursive := true) FROM o)
SELECT course_id, ord, lower(l) AS label_slug, x AS description, array_to_string(list_sort(list_distinct(n)), ',') AS units, d AS assessment_date, len(list_filter(list_distinct(n), lambda u: u BETWEEN 3 AND 5))::INT AS n_conflicts FROM f WHERE l IN ('P1', 'P2', 'PROVA 1', 'PROVA 2')""")
def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments of plans with sections, wrapped lines and scopes, their dates in schedules and conflicts with unit
    periods. F23, J13, J14"""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("course_id"), (F.col("o_custkey") % 5).alias("k"), (F.col("o_custkey") % 4 + 1).cast("int").alias("a"), F.to_date("o_orderdate").alias("d"), X.collapse_ws("o_orderpriority").alias("c"))
    sections = F.expr("""case k when 0 then concat('## **Avaliação**\n- P1: prova das unidades ', a, ' a ', a + 2, '\n  ', c, '\n\nPROVA FINAL - abrange tudo\nBIBLIOGRAFIA\nP3: unidade 5')
      when 1 then concat('P9: unidades 4\nAVALIACAO\nnada\n* P 2 prova 2 com ', a, '\n', c) when 2 then concat('Avaliação do curso\nProva ', a, ': ', c, '\nconteudos ', a, ', 30 e 2\nCronograma\nP2: 1') else concat('P1: unidade ', a, '\nBibliografia') end""")
    plans = o.select("course_id", F.concat(F.lit("Unidade 1\nP1: unidade 7\n"), sections).alias("plan"))
    said = F.explode(F.array(F.struct(F.lit(3).alias("row_index"), F.lit("aula com a p1 e a prova 02 da turma").alias("content_norm")), F.struct(F.lit(1).alias("row_index"), F.lit("p10 sem relacao").alias("content_norm"))))
    rows = o.select("course_id", F.col("d").alias("date_dt"), said.alias("r")).select("course_id", "r.*", "date_dt")
    periods = o.select("course_id", "d", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("unit_number")).select("course_id", "unit_number", F.expr("date_add(d, unit_number - 2)").alias("start"))
    dated = staged(T.assessment_rows(T.assessments(plans), rows), "assessments")
    conflicts = T.assessment_conflicts(dated, periods).groupBy("course_id", "label_slug").agg(F.count("*").cast("int").alias("n_conflicts"))
    return dated.join(conflicts, ["course_id", "label_slug"], "left").select("course_id", "ord", "label_slug", "description", F.array_join(F.array_sort("declared_unit_numbers"), ",").alias("units"), "assessment_date", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))


@query("unit_starts", """
WITH RECURSIVE g AS (SELECT l_orderkey AS course_id, l_suppkey % 3 AS u, list_sort(list(l_linenumber::BIGINT)) AS rows FROM lineitem GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY u) AS i FROM g),
f AS (SELECT course_id, u, i, rows, rows[1] AS s FROM a WHERE i = 1
UNION ALL SELECT a.course_id, a.u, a.i, a.rows, coalesce(list_filter(a.rows, lambda r: r > f.s)[1], a.rows[1]) FROM f JOIN a ON a.course_id = f.course_id AND a.i = f.i + 1),
n AS (SELECT *, lead(s) OVER (PARTITION BY course_id ORDER BY i) - 1 AS e FROM f)
SELECT course_id, u AS unit_ord, s AS start_row, CASE WHEN e >= s THEN e ELSE rows[len(rows)] END AS end_row FROM n""")
def unit_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the units of every schedule start and end. W8"""
    li = table(spark, sf_dir, "lineitem")
    anchors = li.select(F.col("l_orderkey").alias("course_id"), (F.col("l_suppkey") % 3).alias("unit_ord"), F.concat(F.lit("unit-"), F.col("l_suppkey") % 3).alias("unit_slug"), F.col("l_linenumber").alias("row_index"))
    return T.unit_start_anchors(anchors).select("course_id", "unit_ord", "start_row", "end_row")


def _unit_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units of courses titled by their topics, and the whole benchmark texts as schedule rows that may name a unit."""
    t = topics(spark, sf_dir)
    of_unit = t.groupBy("course_id", "unit_ord", "unit_slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic_label"))), lambda x: x["topic_label"]).alias("topics"))
    titled = of_unit.withColumn("unit_title", F.concat(F.lit("Unidade 0"), F.col("unit_ord") + 1, F.when(F.col("unit_ord") == 0, ": ").otherwise(" "), F.get("topics", F.lit(0))))
    named = F.concat(F.when(F.col("topic_ord") % 5 == 0, F.concat(F.lit("unidade "), F.pmod("topic_ord", F.lit(4)), F.lit(" "))).otherwise(""), F.coalesce("text", F.lit("")))
    rows = t.select("course_id", F.col("topic_ord").alias("row_index"), X.match_text(named).alias("content_norm"), F.date_format(F.date_add(F.lit("2026-03-02").cast("date"), (F.col("topic_ord") / 40).cast("int")), "dd/MM/yyyy").alias("date_text"))
    return titled.select("course_id", "unit_ord", "unit_slug", "unit_title", F.slice("topics", 1, 2).alias("topics")), rows


@query("unit_row_periods", rf"""
WITH RECURSIVE {SQL_TOPICS}, g AS (SELECT course_id, unit_ord, unit_slug, list(topic_label ORDER BY topic_ord) AS t FROM topics GROUP BY ALL),
u AS (SELECT course_id, unit_ord, unit_slug, (unit_ord + 1)::VARCHAR AS num, 'Unidade 0' || (unit_ord + 1) || CASE WHEN unit_ord = 0 THEN ': ' ELSE ' ' END || t[1] AS title, list_filter(list_transform(t[1:2], lambda x: {sql_norm("x")}), lambda x: x <> '') AS phrases FROM g),
u1 AS (SELECT *, {sql_norm(r"coalesce(nullif(regexp_extract(title, '[â€”“:-]\s*(.+)', 1), ''), title)")} AS about FROM u),
u2 AS (SELECT *, list_distinct(list_filter(string_split(about, ' '), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^\d+$'))) AS tw,
    list_distinct(list_concat(list_filter(string_split(about, ' '), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^\d+$')), flatten(list_transform(phrases, lambda p: list_filter(string_split(p, ' '), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^\d+$')))))) AS aw FROM u1),
df AS (SELECT course_id, w, count(*) AS k FROM (SELECT course_id, unnest(aw) AS w FROM u2) GROUP BY ALL),
u3 AS (SELECT u2.*, coalesce((SELECT list(w) FROM df WHERE df.course_id = u2.course_id AND list_contains(u2.aw, w) AND (k = 1 OR (k <= 2 AND length(w) >= 6))), []) AS dw FROM u2),
r AS (SELECT course_id, topic_ord AS i, {sql_norm("CASE WHEN topic_ord % 5 = 0 THEN 'unidade ' || (topic_ord % 4) || ' ' ELSE '' END || coalesce(text, '')")} AS x, strftime((DATE '2026-03-02' + (topic_ord // 40)::INT)::DATE, '%d/%m/%Y') AS d FROM topics),
s AS (SELECT u3.course_id, unit_ord, unit_slug, i, list_distinct(string_split(x, ' ')) AS ws, CASE WHEN regexp_matches(x, '\b(unidade|unid|un)\s*' || num || '\b') OR regexp_matches(x, '\bunidade\s*0' || num || '\b') THEN 10 ELSE 0 END
    + CASE WHEN about <> '' AND contains(x, about) THEN 8 ELSE 0 END + CASE WHEN len(list_intersect(tw, string_split(x, ' '))) >= greatest(1, least(2, len(tw))) THEN 4 ELSE 0 END
    + CASE WHEN len(list_filter(phrases, lambda p: contains(x, p))) > 0 THEN 8 ELSE 0 END + least(6, 3 * len(list_intersect(dw, string_split(x, ' ')))) AS score FROM u3 JOIN r ON r.course_id = u3.course_id WHERE x <> ''),
a0 AS (SELECT course_id, unit_ord, unit_slug, list(i ORDER BY i) AS rows FROM s WHERE score >= 4 GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY unit_ord) AS n FROM a0),
f AS (SELECT *, rows[1] AS st FROM a WHERE n = 1 UNION ALL SELECT a.*, coalesce(list_filter(a.rows, lambda q: q > f.st)[1], a.rows[1]) FROM f JOIN a ON a.course_id = f.course_id AND a.n = f.n + 1),
e AS (SELECT *, lead(st) OVER (PARTITION BY course_id ORDER BY n) - 1 AS nx FROM f), z AS (SELECT *, CASE WHEN nx >= st THEN nx ELSE rows[len(rows)] END AS en FROM e),
p AS (SELECT z.course_id, unit_slug, st, en, list(d ORDER BY i) FILTER (i IS NOT NULL) AS ds FROM z LEFT JOIN r ON r.course_id = z.course_id AND r.i BETWEEN st AND en GROUP BY ALL)
SELECT course_id, unit_slug, st AS start_row, en AS end_row, CASE WHEN ds IS NULL THEN '' WHEN ds[1] = ds[len(ds)] THEN ds[1] ELSE ds[1] || ' a ' || ds[len(ds)] END AS period, len(list_distinct(coalesce(ds, [])))::INT AS n_dates FROM p""")
def unit_row_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the rows of every schedule to the periods of its units: scores, starts, ends and dates. W8"""
    units, rows = _unit_rows(spark, sf_dir)
    starts = T.unit_start_anchors(T.unit_anchor_scores(rows, T.unit_descriptors(units)))
    found = T.unit_row_periods(starts, rows)
    return found.select("course_id", "unit_slug", "start_row", "end_row", "period", F.when(F.col("dates") == "", 0).otherwise(F.size(F.split("dates", ", "))).alias("n_dates"))


_SESSION_TEXT = "CASE turn % 4 WHEN 0 THEN 'Aula ' || d || ': ' || x WHEN 1 THEN 'atividade assíncrona: ' || x WHEN 2 THEN 'Card: ' || w || '; encontro ' || d || ' ' || x ELSE 'Tópico: ' || w || '; async - ' || x END"


@query("block_sessions", rf"""
WITH c AS (SELECT conv_id, turn, strftime((DATE '2026-03-02' + turn::INT)::DATE, '%d/%m/%Y') AS d, (DATE '2026-03-02' + turn::INT)::DATE AS dt, replace({SQL_WS.format("regexp_replace(coalesce(text, ''), '[;:⊘{}|]', ' ', 'g')")}, chr(9), ' ') AS x FROM conversations),
w AS (SELECT *, array_to_string(string_split(x, ' ')[1:2], ' ') AS w, {sql_norm("x")} AS n FROM c),
t AS (SELECT conv_id, turn // 3 AS block_no, turn, dt, w, {sql_norm("w")} AS wn, n, x FROM w),
-- the date of the row starts a session of its own, whose text is all up to the next semicolon
s AS (SELECT conv_id, block_no, turn, 1 AS k, 'class' AS kind, dt AS date, CASE turn % 4 WHEN 0 THEN 'aula ' || {sql_norm("strftime(dt, '%d/%m/%Y')")} || ' ' || n WHEN 1 THEN 'atividade assincrona ' || n WHEN 2 THEN 'card ' || wn ELSE 'topico ' || wn END AS label FROM t
  UNION ALL SELECT conv_id, block_no, turn, 0, 'class', dt, CASE WHEN n <> '' THEN n WHEN turn % 4 = 0 THEN 'aula' ELSE 'encontro' END FROM t WHERE turn % 4 IN (0, 2)
  UNION ALL SELECT conv_id, block_no, turn, 2, 'async', NULL, CASE WHEN n <> '' THEN n ELSE 'async' END FROM t WHERE turn % 4 = 3),
l AS (SELECT conv_id, block_no, turn, k, kind, date, trim(label) AS label FROM s),
m AS (SELECT *, count(*) FILTER (kind = 'async') OVER z AS na, count(*) FILTER (kind = 'class') OVER z AS nc FROM l WINDOW z AS (PARTITION BY conv_id, block_no ORDER BY turn, k))
SELECT conv_id, block_no, kind, date, label, 'bloco-' || CASE WHEN block_no < 10 THEN '0' ELSE '' END || block_no || '-sessao-' || CASE WHEN kind = 'async' THEN 'async-' || CASE WHEN na < 10 THEN '0' ELSE '' END || na ELSE date::VARCHAR END AS session_id,
  (SELECT count(DISTINCT (t.turn % 4, t.wn, t.w)) FROM t WHERE t.conv_id = m.conv_id AND t.block_no = m.block_no AND t.turn % 4 IN (2, 3) AND t.wn <> '' AND len(list_filter(string_split(t.wn, ' '), lambda y: length(y) >= 4)) > 0
    AND (contains(m.label, t.wn) OR (len(list_distinct(list_filter(string_split(t.wn, ' '), lambda y: length(y) >= 4))) = 1 AND len(list_filter(string_split(t.wn, ' '), lambda y: length(y) >= 4)) = 1 AND list_contains(string_split(m.label, ' '), list_filter(string_split(t.wn, ' '), lambda y: length(y) >= 4)[1]))
      OR len(list_intersect(list_filter(string_split(t.wn, ' '), lambda y: length(y) >= 4), string_split(m.label, ' '))) >= 2))::INT AS n_cards FROM m""")
def block_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the blocks of every conversation's schedule (three turns a block, whole texts), with the cards that they
    hold. W7, J22, F5, F6, F27"""
    c = table(spark, sf_dir, "conversations").withColumn("x", X.collapse_ws(F.regexp_replace(F.coalesce("text", F.lit("")), "[;:⊘{}|]", " ")))
    day = F.expr("date_add(date'2026-03-02', cast(turn as int))")
    c = c.withColumns({"date_text": F.date_format(day, "dd/MM/yyyy"), "w": F.array_join(F.slice(F.split("x", " "), 1, 2), " ")}).withColumn("d", F.col("date_text"))
    content = F.expr(_SESSION_TEXT)
    rows = c.select(F.col("conv_id").alias("course_id"), F.expr("cast(turn div 3 as int)").alias("block_no"), F.col("turn").alias("row_index"), content.alias("content"), X.match_text(content).alias("content_norm"), "date_text", day.alias("date_dt"), F.lit(False).alias("ignored"))
    blocks = T.block_attributes(rows)
    each = blocks.select("course_id", "block_ord", F.inline("sessions"))
    return each.select(F.col("course_id").alias("conv_id"), F.col("block_ord").alias("block_no"), "kind", "date", "label", "session_id", F.size("card_evidence").alias("n_cards"))


@query("session_numbers", """
WITH s AS (SELECT user_id, event_type, ts::DATE AS d, min(event_id) AS o FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, CASE WHEN event_type = 'error' THEN 'async' ELSE 'class' END ORDER BY o) AS k FROM s)
SELECT user_id, event_type AS label, d AS date, CASE WHEN event_type = 'error' THEN user_id || '-async-' || k ELSE user_id || '-class-' || d END AS session_id FROM n""")
def session_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered distinct sessions of every user. W7"""
    e = table(spark, sf_dir, "events")
    s = e.select(F.lit("c").alias("course_id"), F.col("user_id").cast("string").alias("block_id"), F.when(F.col("event_type") == "error", "async").otherwise("class").alias("kind"), F.to_date("ts").alias("date"), F.col("event_type").alias("label"), F.col("event_id").alias("ord"))
    return T.number_sessions(s).select(F.col("block_id").cast("long").alias("user_id"), "label", "date", "session_id")


_SAID = "regexp_replace(coalesce(text, ''), '[;0-9{}]', ' '{flag})"


@query("session_signals", rf"""
WITH c AS (SELECT conv_id, turn, DATE '2026-03-02' + (turn * 2 + conv_id % 90)::INT AS d, {_SAID.replace("{flag}", ", 'g'")} AS t FROM conversations),
x AS (SELECT *, strftime(d, '%d/%m/%Y') || ': ' || t || chr(10) || CASE turn % 3 WHEN 0 THEN 'Atividade assíncrona: leitura' WHEN 1 THEN strftime(d + 2, '%Y-%m-%d') || ' lab assíncrono' ELSE 'livre' END || CASE WHEN turn % 4 = 3 THEN ' {{kind=event}}' ELSE '' END AS s FROM c),
l AS (SELECT *, list_filter(string_split(s, chr(10)), lambda y: contains({sql_norm('y')}, 'assincron') AND NOT regexp_matches(y, '\d{{2}}/\d{{2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}')) AS loose FROM x)
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 0 ELSE 1 + (turn % 3 = 1)::INT + len(list_distinct(list_transform(loose, lambda y: trim(regexp_replace(y, '\s+', ' ', 'g'))))) END::INT AS n_signals, CASE WHEN turn % 4 = 3 THEN NULL ELSE d::DATE END AS first_date,
  CASE WHEN turn % 4 = 3 THEN NULL ELSE trim(regexp_replace(string_split(t, chr(10))[1], '\s+', ' ', 'g')) END AS label FROM l""")
def session_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated and asynchronous sessions told by whole texts. F5"""
    day = F.expr("date_add(date'2026-03-02', cast(turn * 2 + conv_id % 90 as int))")
    second = F.expr("case turn % 3 when 0 then 'Atividade assíncrona: leitura' when 1 then concat(date_format(date_add(date'2026-03-02', cast(turn * 2 + conv_id % 90 + 2 as int)), 'yyyy-MM-dd'), ' lab assíncrono') else 'livre' end")
    text = F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(": "), F.expr(_SAID.replace("{flag}", "")), F.lit("\n"), second, F.when(F.col("turn") % 4 == 3, " {kind=event}").otherwise(""))
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.session_signals(text).alias("s"))
    first = F.get("s", F.lit(0))
    return s.select("conv_id", "turn", F.size("s").alias("n_signals"), first["date"].alias("first_date"), first["label"].alias("label"))


@query("html_schedules", """
WITH o AS (SELECT o_custkey AS c, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus AS s FROM orders)
SELECT c AS course_id, CASE s WHEN 'F' THEN 'suspension' WHEN 'O' THEN 'exam' ELSE 'class' END AS kind, s = 'F' AS ignored,
  '- (' || strftime(o_orderdate, '%d/%m/%Y') || ') ' || ['SEG', 'TER', 'QUA'][o_orderkey % 3 + 1] || ' — ' || o_orderpriority || ' [Aula]' || CASE s WHEN 'F' THEN ' {kind=suspension} ⊘' WHEN 'O' THEN ' {kind=exam}' ELSE '' END AS line FROM o""")
def html_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule rows from portal pages, one of each customer with all its orders as rows. S6"""
    o = table(spark, sf_dir, "orders")
    colour = F.expr("case o_orderstatus when 'F' then ' style=\"Background-Color: Red;\"' when 'O' then ' style=\"background-color:orange\"' else '' end")
    cell = lambda name, value: F.concat(F.lit(f'<td><span id="x_lbl{name}">'), value, F.lit("</span></td>"))
    day = F.element_at(F.array(*(F.lit(d) for d in ("SEG", "TER", "QUA"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    row = F.concat(F.lit("<tr"), colour, F.lit(">"), cell("Data", F.date_format("o_orderdate", "dd/MM/yyyy")), cell("Dia", day), cell("Descricao", F.col("o_orderpriority")), F.lit("</tr>"))
    pages = o.groupBy(F.col("o_custkey").alias("course_id")).agg(F.concat(F.lit('<table id="dgAulas"><tr><th>x</th></tr>'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "\n"), F.lit("</table>")).alias("html"))
    rows = H.schedule_rows(pages)
    return rows.select("course_id", "kind", "ignored", H.schedule_line(F.col("cells"), F.col("kind"), F.col("ignored")).alias("line"))


# dates and periods

@query("dates", """
SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS dmy, NULL::DATE AS bad, o_orderdate::DATE AS start, (o_orderdate::DATE + 5)::DATE AS "end", strftime(o_orderdate, '%d/%m/%Y') || ' a ' || strftime(o_orderdate + INTERVAL 5 DAY, '%d/%m/%Y') AS shown FROM orders""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and periods read from and written as text. F2, F3, F4, F33"""
    d = F.to_date("o_orderdate")
    dmy = lambda x: F.date_format(x, "dd/MM/yyyy")
    label = F.concat(dmy(F.date_add(d, 5)), F.lit(" - "), F.date_format(d, "yyyy-MM-dd"))
    o = table(spark, sf_dir, "orders")
    week = X.date_range_signal(F.concat(F.lit("Semana "), dmy(d), F.lit(" até "), dmy(F.date_add(d, 5))))
    df = o.select("o_orderkey", X.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("iso"), X.parse_date(dmy(d)).alias("dmy"), X.parse_date(F.lit("31/02/2026")).alias("bad"), X.period_bounds(label).alias("b"), week.alias("w"), X.display_period(F.concat(dmy(d), F.lit(" – "), F.date_format(F.date_add(d, 5), "yyyy-MM-dd"))).alias("shown"))
    return df.select("o_orderkey", "iso", "dmy", "bad", "b.start", F.col("w.end").alias("end"), "shown")


_ORDERS = "o AS (SELECT o_custkey AS course_id, o_orderkey, o_orderdate::DATE AS d FROM orders), l AS (SELECT DISTINCT o_custkey AS course_id, l_shipdate::DATE AS date, CASE WHEN l_returnflag = 'R' THEN 'async' ELSE 'class' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


_SQL_SESSIONS = """o AS (SELECT o_custkey AS course_id, o_orderkey, o_orderdate::DATE AS d, o_orderpriority < '3' AS sa, o_orderstatus = 'F' AS sc FROM orders),
l AS (SELECT DISTINCT o_custkey AS course_id, l_shipdate::DATE AS date, CASE l_returnflag WHEN 'R' THEN 'async' ELSE 'class' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("session_matches", f"""WITH {_SQL_SESSIONS}
SELECT o.course_id, o_orderkey, date || '-' || kind AS session_id, (CASE WHEN date = d THEN 3.0 WHEN date BETWEEN d AND d + 30 THEN 2.2 ELSE 0 END + CASE WHEN kind = 'async' AND sa THEN 0.9 WHEN kind = 'class' AND sc THEN 0.15 ELSE 0 END)::DOUBLE AS score
FROM o JOIN l ON o.course_id = l.course_id AND date_trunc('month', date) BETWEEN date_trunc('month', d) AND date_trunc('month', d + 30)""")
def session_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the months (blocks) of an order's thirty days: on its date, inside them, or neither. J9"""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    d = F.to_date("o_orderdate")
    months = F.explode(F.sequence(F.trunc(d, "month"), F.trunc(F.date_add(d, 30), "month"), F.expr("interval 1 month")))
    pairs = o.select(F.col("o_custkey").alias("course_id"), "o_orderkey", months.alias("block_id"), F.array(d).alias("dates"), d.alias("start"), F.date_add(d, 30).alias("end"), (F.col("o_orderpriority") < "3").alias("says_async"), (F.col("o_orderstatus") == "F").alias("says_class"))
    s = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("course_id"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "R", "async").otherwise("class").alias("kind")).distinct()
    s = s.withColumns({"block_id": F.trunc("date", "month"), "session_id": F.concat_ws("-", F.col("date").cast("string"), "kind"), "ord": F.lit(1)})
    return S.session_scores(pairs, s, ["o_orderkey"]).select("course_id", "o_orderkey", "session_id", "score")


@query("period_blocks", """
WITH b AS (SELECT o_custkey AS c, date_trunc('year', o_orderdate)::DATE AS y, min(o_orderdate::DATE) AS s, max(o_orderdate::DATE) AS e FROM orders GROUP BY ALL),
p AS (SELECT o_orderkey, y, CASE WHEN o_orderdate::DATE BETWEEN s AND e THEN 1 WHEN false THEN 0 ELSE 2 END AS tier FROM orders JOIN b ON o_custkey = c),
t AS (SELECT *, min(tier) OVER (PARTITION BY o_orderkey) AS m FROM p)
SELECT o_orderkey, year(y)::INT AS block, tier FROM t WHERE tier = m""")
def period_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (a customer's years) that overlap an order's period. J24"""
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    blocks = o.groupBy(F.col("o_custkey").alias("course_id"), F.year("o_orderdate").alias("block_id")).agg(F.min(d).alias("period_start"), F.max(d).alias("period_end")).withColumn("period_label", F.concat(F.lit("y"), "block_id"))
    docs = o.select(F.col("o_custkey").alias("course_id"), "o_orderkey", d.alias("start"), d.alias("end"), F.lit("none").alias("period_label"))
    return S.period_blocks(docs, blocks, ["o_orderkey"]).select("o_orderkey", F.col("block_id").alias("block"), "tier")


@query("reconciled", """
WITH p AS (SELECT l_orderkey, l_linenumber AS b, l_partkey AS k, CASE WHEN l_returnflag = 'N' THEN 1.25 WHEN l_returnflag = 'R' THEN -0.35 ELSE 0 END + CASE l_linestatus WHEN 'O' THEN 0.85 ELSE 0.45 END + l_discount * 5 + 0.25 * l_tax + 0.1 * 0.5 AS s FROM lineitem),
r AS (SELECT *, row_number() OVER w AS n, lead(s) OVER w AS next FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY s DESC, b, k))
SELECT l_orderkey, round(s, 6)::DOUBLE AS score, round(s - coalesce(next, -1e9), 9) < 0.2 AS review FROM r WHERE n = 1""")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best block of a mapped document and whether it needs review. J25"""
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select("l_orderkey", F.col("l_linenumber").alias("block_id"), F.struct("l_linenumber", "l_partkey").alias("block_ord"), F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "R", False).alias("same_unit"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("tier"), (F.col("l_discount") * 5).alias("text_score"), F.col("l_tax").alias("unit_confidence"), F.lit(0.5).alias("topic_confidence"))
    return S.reconcile(pairs, ["l_orderkey"]).select("l_orderkey", F.round("score", 6).alias("score"), "review")


@query("reconciled_texts", f"""WITH {SQL_TOPICS}, {SQL_ENTRIES}, {sql_rows({"title": 1.25, "lead": 0.75, "body": 0.18})} SELECT course_id, doc_id, row_index AS block_ord, round(s, 6)::DOUBLE AS text_score FROM op""")
def reconciled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of documents against the texts of their course's blocks. J25"""
    blocks = topics(spark, sf_dir).select("course_id", F.col("topic_ord").alias("block_id"), X.match_text("topic_label").alias("text_norm"))
    scored = S.reconcile_texts(S.signals(documents(spark, sf_dir)), blocks, ["doc_id"])
    return scored.select("course_id", "doc_id", F.col("block_id").alias("block_ord"), F.round("text_score", 6).alias("text_score"))


@query("manual_blocks", """
WITH b AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS u, o_orderpriority = '1-URGENT' AS adm FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY c, u ORDER BY k) AS nu, row_number() OVER (PARTITION BY c ORDER BY k) AS nc FROM b WHERE NOT adm),
m AS (SELECT c_custkey, c_custkey % 3 + 1 AS o, c_custkey % 4 = 0 AS any_unit FROM customer)
SELECT m.c_custkey, CASE WHEN m.c_custkey % 5 = 0 THEN (SELECT max(k) FROM b WHERE b.c = m.c_custkey) ELSE n.k END AS block_id FROM m LEFT JOIN n ON n.c = m.c_custkey AND CASE WHEN any_unit THEN n.nc ELSE n.nu END = m.o AND (any_unit OR n.u = 'F')""")
def manual_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks named by hand: by id, or as the n-th teaching block of a unit or of the course. J12, W18"""
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), F.concat(F.lit("b"), "o_orderkey").alias("block_id"), F.col("o_orderkey").alias("block_ord"), F.col("o_orderstatus").alias("unit_slug"), (F.col("o_orderpriority") == "1-URGENT").alias("administrative"))
    last = blocks.groupBy("course_id").agg(F.max_by("block_id", "block_ord").alias("last"))
    ordinal = F.concat(F.when(F.col("c_custkey") % 2 == 0, "bloco-0").otherwise("BLOCO-"), F.col("c_custkey") % 3 + 1)
    e = table(spark, sf_dir, "customer").withColumn("course_id", F.col("c_custkey")).join(last, "course_id", "left")
    e = e.select("c_custkey", "course_id", F.when(F.col("c_custkey") % 5 == 0, F.col("last")).otherwise(ordinal).alias("manual_block"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("F").alias("manual_unit"))
    return S.manual_blocks(e, blocks, ["c_custkey"]).select("c_custkey", F.substring("block_id", 2, 20).cast("long").alias("block_id"))


# pages, chunks, images

@query("page_runs", """
WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS p FROM lineitem), g AS (SELECT *, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM p), r AS (SELECT k, g, min(p) AS a, max(p) AS b FROM g GROUP BY ALL)
SELECT k AS order_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM r GROUP BY k""")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every order as ranges. W10"""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("page"))
    return D.collapse_pages(li, ["order_id"])


@query("page_chunks", """
WITH p AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS p FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS r FROM p)
SELECT k AS doc, p AS page, CASE WHEN n >= 50 THEN floor(r / CASE WHEN k % 2 = 0 THEN 10 WHEN n >= 150 THEN 20 ELSE 25 END) ELSE 0 END::INT AS chunk FROM n""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of long documents (suppliers, with their orders as pages). W11"""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page")).distinct()
    return D.page_chunks(li.withColumn("profile", F.when(F.col("doc") % 2 == 0, "scanned").otherwise("auto")), ["doc"]).select("doc", "page", "chunk")


@query("document_profiles", """
WITH g AS (SELECT l_orderkey AS doc, count(*) AS n, sum(l_quantity * 4)::BIGINT AS c, sum(l_linenumber % 3) AS i, sum((l_returnflag = 'R')::INT) AS t, count(*) FILTER (l_quantity * 4 < 60 AND l_linenumber % 3 > 0) AS bare FROM lineitem GROUP BY ALL)
SELECT doc, n AS page_count, c AS text_chars, i::BIGINT AS images_count, t::BIGINT AS table_candidates, round(c / n, 2) AS text_density, bare * 2 >= n AS suspected_scan, CASE WHEN bare * 2 >= n THEN 'scanned' WHEN i >= 2 * n OR t >= n THEN 'diagram_heavy' ELSE 'auto' END AS suggested_profile FROM g""")
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and profiles of documents (orders, with lines as pages). A7"""
    li = table(spark, sf_dir, "lineitem")
    pages = li.select(F.col("l_orderkey").alias("doc"), (F.col("l_quantity") * 4).cast("long").alias("text_chars"), (F.col("l_linenumber") % 3).cast("long").alias("images"), (F.col("l_returnflag") == "R").cast("long").alias("tables"))
    return D.document_profile(pages, ["doc"])


@query("merged_chunks", """
WITH c AS (SELECT l_suppkey AS doc, l_linenumber AS chunk, sum(l_quantity)::BIGINT AS pages, round(avg(l_discount), 6) AS q, sum(l_tax) AS cost FROM lineitem GROUP BY ALL)
SELECT doc, string_agg('<!-- page ' || chunk * 10 || ' -->' || chr(10) || 'body ' || chunk, chr(10) || chr(10) ORDER BY chunk) AS body, sum(pages)::BIGINT AS pages, round(avg(q), 4) AS quality, round(sum(cost), 4)::DOUBLE AS cost, max(chunk) AS image_page FROM c GROUP BY doc""")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of extraction put together. A13"""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("chunk")).agg(F.sum("l_quantity").cast("long").alias("pages"), F.round(F.avg("l_discount"), 6).alias("quality"), F.sum("l_tax").alias("cost"))
    c = li.select("doc", "chunk", (F.col("chunk") * 10).alias("first_page"), F.concat(F.lit("body "), "chunk").alias("body"), "pages", "quality", F.create_map(F.lit("usd"), "cost").alias("costs"), F.create_map(F.lit("a.png"), "chunk").alias("image_pages"))
    return D.merge_chunks(c, ["doc"]).select("doc", "body", "pages", "quality", F.round(F.col("costs")["usd"], 4).alias("cost"), F.col("image_pages")["a.png"].alias("image_page"))


@query("duplicate_images", """
WITH d AS (SELECT source, sha256(coalesce(text, '')) AS h, doc_id FROM documents), g AS (SELECT source, h, count(*) AS copies, list_sort(list(doc_id)) AS pages FROM d GROUP BY ALL HAVING count(*) >= 2)
SELECT d.source, d.doc_id, copies, array_to_string(list_filter(pages, lambda x: x <> d.doc_id), ',') AS others FROM d JOIN g USING (source, h)""")
def duplicate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with equal bytes in a course and where the others are. A12"""
    d = table(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha1"), F.col("doc_id").alias("page"))
    return D.duplicate_images(d, "source").select("source", F.col("page").alias("doc_id"), "copies", F.array_join("other_pages", ",").alias("others"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.concat(F.lit("img_page_"), "l_linenumber", F.lit("_"), "l_partkey", F.lit(".png")).alias("fname"), (F.col("l_extendedprice") / 10).cast("int").alias("bytes"), (F.col("l_quantity") * 8).cast("int").alias("width"), (F.col("l_linenumber") * 40).alias("height"), (F.col("l_partkey") % 40).cast("int").alias("colours"), F.when(F.col("l_returnflag") == "R", "scanned").otherwise("auto").alias("profile"))


_IMAGES = "i AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, 'img_page_' || l_linenumber || '_' || l_partkey || '.png' AS fname, trunc(l_extendedprice / 10)::INT AS bytes, (l_quantity * 8)::INT AS w, l_linenumber * 40 AS h, l_partkey % 40 AS colours, l_returnflag = 'R' AS scan FROM lineitem)"


@query("kept_images", f"""WITH {_IMAGES}, r AS (SELECT *, greatest(w, h) / least(w, h) AS ratio FROM i)
SELECT doc_id, fname, CASE WHEN bytes < 5000 OR least(w, h) < 50 OR ratio > 6 OR colours <= 8 THEN 'decorative' ELSE 'generic' END AS class FROM r WHERE CASE WHEN scan THEN bytes >= 512 AND least(w, h) >= 8 AND ratio <= 20 AND colours > 0 ELSE bytes >= 2000 AND least(w, h) >= 20 AND ratio <= 8 AND colours > 4 END""")
def kept_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that their policy keeps, with their class. P16, P17"""
    return D.keep_images(_images(spark, sf_dir)).select("doc_id", "fname", D.image_class(F.col("bytes"), F.col("width"), F.col("height"), F.col("colours")).alias("class"))


@query("images_by_page", f"""WITH {_IMAGES} SELECT doc_id, CASE WHEN colours = 7 THEN 99 ELSE l_linenumber + 1 END::INT AS page, array_to_string(list_sort(list(fname)), ',') AS fnames FROM i GROUP BY ALL""")
def images_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of every document by page, some pages set by hand. A15, F13, P25"""
    i = _images(spark, sf_dir)
    hand = i.filter("colours = 7").select("doc_id", "fname", F.lit(99).alias("page")).distinct()
    return D.images_by_page(i, hand).select("doc_id", "page", F.array_join("fnames", ",").alias("fnames"))


@query("near_descriptions", """
WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page, l_linenumber || '-' || l_partkey || '.png' AS fname, l_partkey % 3 AS t FROM lineitem), f AS (SELECT *, first_value(page) OVER w AS lp, first_value(fname) OVER w AS lf FROM d WINDOW w AS (PARTITION BY doc_id, t ORDER BY page, fname))
SELECT doc_id, page, fname, CASE WHEN fname <> lf AND abs(page - lp) <= 1 THEN lf END AS refers_to FROM f""")
def near_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of one text near each other refer to the first. W9"""
    li = table(spark, sf_dir, "lineitem")
    d = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat_ws("-", "l_linenumber", F.concat("l_partkey", F.lit(".png"))).alias("fname"), F.concat(F.lit("Diagrama "), F.element_at(F.array(F.lit("de Classes."), F.lit("de estados!"), F.lit("geral")), (F.col("l_partkey") % 3 + 1).cast("int"))).alias("description"))
    d = d.repartition("doc_id").distinct()  # a document's rows meet once, for both steps
    return D.near_duplicate_descriptions(d).select("doc_id", "page", "fname", "refers_to")


@query("described_images", r"""
WITH d AS (SELECT doc_id, lang, doc_id % 4 AS k, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT *, 'A figure of ' || array_to_string(string_split(t, ' ')[1:6], ' ') AS s FROM d)
SELECT doc_id, md5('Intro' || chr(10) || CASE k WHEN 3 THEN '![fig](x/p1-' || lang || '.png)' ELSE '> **Image:** ' || CASE k WHEN 2 THEN 'Other page' ELSE trim(s) END END || chr(10) || '![other](x/none.png)' || chr(10) || 'End') AS markdown_md5, CASE k WHEN 3 THEN NULL WHEN 2 THEN 'p1-' || lang ELSE lang END AS matched FROM w""")
def described_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references replaced by their descriptions: by the end of the name, by the whole name before that, by the page,
    or not at all. J18, F31, F17"""
    d = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 4)
    docs = d.select("doc_id", F.concat(F.lit("Intro\n![fig](x/p1-"), "lang", F.lit(".png)\n![other](x/none.png)\nEnd")).alias("markdown"), "lang")
    refs = docs.select("doc_id", F.posexplode(F.regexp_extract_all("markdown", F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("ref_ord", "r")).select("doc_id", "ref_ord", F.substring_index("r", "/", -1).alias("fname"), F.lit(1).alias("page"))
    said = F.concat(F.lit("A figure of "), F.array_join(F.slice(F.split(X.collapse_ws(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", " ")), " "), 1, 6), " "))
    one = F.struct(F.concat("lang", F.lit(".png")).alias("fname"), F.lit(1).alias("page"), F.trim(said).alias("description"))
    two = F.struct(F.concat(F.lit("p1-"), "lang", F.lit(".png")).alias("fname"), F.lit(2).alias("page"), F.lit("Other page").alias("description"))
    other = F.struct(F.concat(F.lit("1-"), "lang", F.lit(".png")).alias("fname"), F.lit(1).alias("page"), F.lit("No part of the name").alias("description"))
    given = F.when(F.col("k") == 2, F.array(one, two)).when(F.col("k") == 3, F.array(other)).otherwise(F.array(other, one))
    descriptions = d.select("doc_id", F.inline(given)).select("doc_id", "fname", "page", "description")
    matched = D.match_descriptions(refs, descriptions)
    out = D.inject_descriptions(docs, matched)
    return out.join(matched.select("doc_id", F.regexp_replace("d_fname", r"\.png$", "").alias("matched")), "doc_id", "left").select("doc_id", F.md5("markdown").alias("markdown_md5"), "matched")


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines but the first are under a heading of their first three words."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    head = lambda x: F.concat(F.lit("## "), F.array_join(F.slice(F.split(X.collapse_ws(x), " "), 1, 3), " "), F.lit("\n"), x)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.concat(F.array(F.lit("---\nentry_id: x\n---")), F.transform(F.filter(lines, lambda x: F.trim(x) != ""), head)), "\n").alias("markdown"))


_HEADS = r"h AS (SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS line, generate_subscripts(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), 1) AS i FROM documents), k AS (SELECT doc_id, i, array_to_string(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')[1:3], ' ') AS header FROM h)"


@query("section_headers", f"WITH {_HEADS} SELECT doc_id, (1 + 2 * i)::INT AS line_no, header FROM k")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section headers of Markdown with line numbers. F9"""
    return D.section_headers(_headed(spark, sf_dir), ["doc_id"]).select("doc_id", "line_no", "header")


@query("summaries", f"WITH {_HEADS}, g AS (SELECT doc_id, count(*) AS n, string_agg('- ' || header, chr(10) ORDER BY i) AS l FROM k GROUP BY ALL) SELECT d.doc_id, coalesce(n, 0) >= 2 AS has_summary, CASE WHEN n >= 2 THEN md5(l) END AS list_md5, true AS stable FROM documents d LEFT JOIN g USING (doc_id)")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section lists on top of Markdown, the same when made twice. F28"""
    once = D.executive_summary(_headed(spark, sf_dir), ["doc_id"])
    twice = D.executive_summary(once, ["doc_id"]).withColumnRenamed("markdown", "again")
    block = F.regexp_extract("markdown", rf"(?s){D.SUMMARY_START}\n(.*?)\n{D.SUMMARY_END}", 1)
    return once.join(twice, "doc_id").select("doc_id", F.col("markdown").contains(D.SUMMARY_START).alias("has_summary"), F.when(F.col("markdown").contains(D.SUMMARY_START), F.md5(block)).alias("list_md5"), (F.col("markdown") == F.col("again")).alias("stable"))


@query("sections", f"WITH {_HEADS} SELECT doc_id, count(*) AS n_sections, min(header) AS least FROM k GROUP BY doc_id")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of Markdown with their headings. F19, F11"""
    s = D.split_sections(_headed(spark, sf_dir), ["doc_id"]).filter("heading != ''")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.min("heading").alias("least"))


@query("clean_markdown", "SELECT doc_id, md5(replace(text, '$', '')) AS clean_md5 FROM documents WHERE text IS NOT NULL")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between page numbers, rules and blank runs, cleaned. W15, F16"""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat(F.lit("12\n---\n"), F.replace("text", F.lit("$"), F.lit("")), F.lit("\nPag. 3/9\n_____")).alias("markdown"))
    return D.clean_noise(d, ["doc_id"]).select("doc_id", F.md5("markdown").alias("clean_md5"))


@query("orphan_sections")
def orphan_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of each document that a stray description (its last words) fits. J19"""
    docs = _headed(spark, sf_dir)
    o = table(spark, sf_dir, "documents").select("doc_id", F.lit("x.png").alias("fname"), F.substring("text", -200, 200).alias("description"))
    return D.place_orphans(o, D.split_sections(docs, ["doc_id"])).select("doc_id", "section", "points")


# study progress

_STATUS = "CASE WHEN turn % 4 = 3 THEN 'compreendido' WHEN turn % 4 = 0 THEN 'pendente' ELSE 'em_progresso' END"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % 10).alias("unit"), F.col("conv_id").alias("topic_slug"), F.col("turn").alias("ord"), F.expr(_STATUS.lower()).alias("status"), "role", "text")


@query("progress_board", f"""
WITH s AS (SELECT conv_id, max_by({_STATUS}, turn) AS status, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT doc_id AS topic_slug, coalesce(status, 'pendente') AS status, coalesce(n, 0) AS n_sessions FROM documents LEFT JOIN s ON conv_id = doc_id""")
def progress_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an outline with the latest status of their sessions. J10"""
    states = P.latest(_sessions(spark, sf_dir), ["topic_slug"]).drop("last")
    outline = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("topic_slug"))
    return P.board(outline, states, ["topic_slug"]).select("topic_slug", "status", "n_sessions")


@query("unit_gates", f"""
WITH s AS (SELECT conv_id, conv_id % 10 AS unit, max_by({_STATUS}, turn) AS status FROM conversations GROUP BY conv_id)
SELECT unit, bool_and(status = 'compreendido') AS may_close, coalesce(array_to_string(list_sort(list(conv_id) FILTER (status <> 'compreendido')), ','), '') AS open_topics FROM s GROUP BY unit""")
def unit_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that may close and the topics still open. A11"""
    states = P.latest(_sessions(spark, sf_dir), ["unit", "topic_slug"])
    return P.unit_gate(states, ["unit"]).select("unit", "may_close", F.array_join("open_topics", ",").alias("open_topics"))


@query("unit_summaries", """
SELECT conv_id % 10 AS unit, count(*) AS n_sessions, sum((role = 'user')::INT)::BIGINT AS n_resolved, sum((turn % 3 <> 0)::INT)::BIGINT AS n_open, count(DISTINCT conv_id)::INT AS n_topics FROM conversations GROUP BY unit""")
def unit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, topics and doubts of every unit. A10"""
    s = _sessions(spark, sf_dir)
    body = F.concat(F.lit("### Dúvidas resolvidas\n"), F.when(F.col("role") == "user", "- uma\n").otherwise("- Nenhuma\n"), F.lit("### Em aberto\n"), F.when(F.col("ord") % 3 != 0, "- outra\n").otherwise("- nenhuma\n"))
    s = s.withColumns({"resolved": P.bullets(body, "Dúvidas resolvidas"), "open_doubts": P.bullets(body, "Em aberto"), "topic_ord": F.col("topic_slug")})
    return P.unit_summary(s, ["unit"]).select("unit", "n_sessions", "n_resolved", "n_open", F.size("topics").alias("n_topics"))


@query("imports", """
SELECT conv_id, turn, 'topic-' || conv_id AS topic_slug, CASE WHEN turn % 5 = 0 THEN 'status' WHEN conv_id % 4 = 0 THEN 'unit_slug' WHEN conv_id % 4 = 1 THEN 'topic_slug' ELSE '' END AS error, md5(trim(regexp_replace(text, '\n', ' ', 'g'))) AS body_md5 FROM conversations""")
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study sessions read from frontmatter and checked against an outline. F30, J11, F11"""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("---\ntopic_slug: topic-"), "conv_id", F.lit('\nunit: "unit-'), F.col("conv_id") % 4, F.lit('"\nstatus: '), F.when(F.col("turn") % 5 == 0, "novo").otherwise("revisao"), F.lit("\ndate: 2026-03-01\n---\n"), F.regexp_replace("text", "\n", " "))
    read = P.read_imports(c.select("conv_id", "turn", text.alias("text"))).withColumns({"course_id": F.lit("c"), "own": F.col("errors")})
    outline = c.filter("conv_id % 4 != 0").select(F.lit("c").alias("course_id"), F.concat(F.lit("unit-"), F.col("conv_id") % 4).alias("unit_slug"), F.when(F.col("conv_id") % 4 == 1, "other").otherwise(F.concat(F.lit("topic-"), "conv_id")).alias("topic_slug")).distinct()
    out = P.validate_imports(read, outline)
    return out.select("conv_id", "turn", "topic_slug", F.coalesce(F.get(F.concat("own", "errors"), F.lit(0)), F.lit("")).alias("error"), F.md5("body").alias("body_md5"))


@query("history", f"""
WITH r AS (SELECT conv_id % 10 AS course, turn, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS session FROM conversations)
SELECT course, 'topic-' || conv_id AS topic_slug, session::INT AS session, {_STATUS} AS status FROM r""")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old history tables as numbered sessions. A14"""
    s = _sessions(spark, sf_dir)
    line = F.concat(F.lit("| 2026-03-01 | Unidade 1 | Topic "), "topic_slug", F.lit(" | "), F.when(F.col("status") == "em_progresso", "Em progresso").otherwise(F.initcap("status")), F.lit(" |"))
    texts = s.withColumn("line", line).groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic_slug", "ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return P.migrate_history(texts.withColumnRenamed("unit", "course"), ["course"]).select("course", "topic_slug", "session", "status")


@query("outline_labels", """
WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, (l_linenumber % 2)::INT AS d FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
g AS (SELECT *, sum((d = 0)::INT) OVER (PARTITION BY k ORDER BY o) AS n0 FROM t), h AS (SELECT *, sum((d = 1)::INT) OVER (PARTITION BY k, n0 ORDER BY o) AS n1 FROM g)
SELECT k AS course_id, o::INT AS topic_ord, CASE WHEN d = 0 THEN greatest(n0, 1)::VARCHAR ELSE greatest(n0, 1) || '.' || n1 END AS label FROM h""")
def outline_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical numbers of outlines (lines of orders, odd ones deeper). W16"""
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    t = li.select(F.col("l_orderkey").alias("course_id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("topic_ord"), (F.col("l_linenumber") % 2).cast("int").alias("depth"))
    return P.outline_labels(t, ["course_id"]).select("course_id", "topic_ord", "label")


@query("reasoning_cleanup", """
SELECT conv_id, turn, md5(CASE turn % 4 WHEN 2 THEN '' ELSE trim(CASE turn % 4 WHEN 3 THEN 'Resposta ' ELSE '' END || coalesce(text, ''), ' ' || chr(10)) END) AS answer_md5 FROM conversations""")
def reasoning_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without thought blocks and preambles: one, two, an open one, none. F29"""
    c = table(spark, sf_dir, "conversations")
    text = F.expr("""case turn % 4 when 0 then concat('<think>a\nb</think>\nOkay, here it is:\n\n', coalesce(text, '')) when 1 then concat('<THINK>', role, '</THINK> <think>', coalesce(text, ''), '</think>\n\nHere is the text\n', coalesce(text, ''))
      when 2 then concat('<think>', coalesce(text, '')) else concat('Resposta ', coalesce(text, '')) end""")
    return c.select("conv_id", "turn", X.strip_reasoning(text).alias("t")).select("conv_id", "turn", F.md5(F.expr("trim(both concat(' ', char(10)) from t)")).alias("answer_md5"))


# streams

def _out(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{scratch(spark)}/coursemill/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern: the table may be one file or a folder


@query("stream_entries", "SELECT regexp_extract(url, 'example\\.(\\w+)', 1) AS course_id, lower(url) AS source_key, count(*) > 0 AS once FROM pages GROUP BY ALL")
def stream_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream of entries, each source once. X1"""
    pages = _stream(spark, sf_dir, "pages").select(F.regexp_extract("url", r"example\.(\w+)", 1).alias("course_id"), F.col("url").alias("source_path"), F.lit(True).alias("enabled"))
    out = _out(spark, "entries")
    jobs.stream_new_entries(pages, f"{out}/table", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/table").groupBy("course_id", "source_key").agg((F.count("*") == 1).alias("once"))


@query("stream_states", f"SELECT conv_id % 10 AS unit, conv_id AS topic_slug, count(*) AS n_sessions, max_by({_STATUS}, turn) AS status FROM conversations GROUP BY ALL")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of study sessions with the state of each topic. X2"""
    c = _stream(spark, sf_dir, "conversations")
    s = c.select((F.col("conv_id") % 10).alias("unit"), F.col("conv_id").alias("topic_slug"), F.col("turn").alias("ord"), F.expr(_STATUS.lower()).alias("status"))
    out = _out(spark, "states")
    jobs.stream_study_sessions(s, ["unit", "topic_slug"], f"{out}/table", f"{out}/state").awaitTermination()
    return jobs.current_states(spark.read.option("mergeSchema", False).parquet(f"{out}/table"), ["unit", "topic_slug"]).select("unit", "topic_slug", "n_sessions", "status")


_SQL_STUDY = f"""c AS (SELECT 'course-' || conv_id % 7 AS course_id, 'unit-' || conv_id % 3 AS unit_slug, 'topic-' || conv_id AS topic_slug, turn * 1000000000 + conv_id AS ord, {_STATUS} AS status,
  strftime((DATE '2026-03-01' + turn::INT)::DATE, '%Y-%m-%d') AS date, CASE WHEN turn % 4 = 1 THEN 'topic-' || (conv_id + 1) ELSE '' END AS next_topic FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY course_id, unit_slug, topic_slug ORDER BY ord) AS session FROM c)"""


def _study(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as a stream of study sessions, a turn a session; the folder of its tables."""
    c = _stream(spark, sf_dir, "conversations").filter("conv_id is not null")
    s = c.select(
        F.concat(F.lit("course-"), F.col("conv_id") % 7).alias("course_id"), F.concat(F.lit("unit-"), F.col("conv_id") % 3).alias("unit_slug"), F.concat(F.lit("topic-"), "conv_id").alias("topic_slug"), (F.col("turn").cast("long") * 1_000_000_000 + F.col("conv_id")).alias("ord"), F.expr(_STATUS.lower()).alias("status"),
        F.date_format(F.expr("date_add(date'2026-03-01', cast(turn as int))"), "yyyy-MM-dd").alias("date"), F.when(F.col("turn") % 4 == 1, F.concat(F.lit("topic-"), F.col("conv_id") + 1)).otherwise("").alias("next_topic"),
    )
    out = _out(spark, "study")
    study.stream_study(s, f"{out}/table", f"{out}/state").awaitTermination()
    return f"{out}/table"


@query("stream_study_sessions", f"WITH {_SQL_STUDY} SELECT course_id, topic_slug, ord, session, status FROM s")
def stream_study_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study sessions of a stream with their numbers. X2"""
    return study.read_sessions(spark, _study(spark, sf_dir)).select("course_id", "topic_slug", "ord", "session", "status")


@query("stream_student_states", f"""
WITH {_SQL_STUDY}, l AS (SELECT course_id, max(ord) AS ord FROM s GROUP BY course_id), r AS (SELECT course_id, list(topic_slug || ' ' || date ORDER BY ord DESC)[1:{study.RECENT}] AS recent, arg_max(next_topic, ord) FILTER (next_topic <> '') AS next_topic FROM s GROUP BY course_id)
SELECT course_id, unit_slug, topic_slug, status, session AS sessions, 'student/batteries/' || unit_slug || '/' || topic_slug || '.md' AS file, date AS updated, array_to_string(recent, ',') AS recent, r.next_topic AS next_topic FROM l JOIN s USING (course_id, ord) JOIN r USING (course_id)""")
def stream_student_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every student of a stream: active topic, newest sessions, next topic. X2"""
    s = study.read_students(spark, _study(spark, sf_dir))
    recent = F.array_join(F.transform("recent", lambda x: F.concat_ws(" ", x["topic_slug"], x["date"])), ",")
    return s.select("course_id", "active.unit_slug", "active.topic_slug", "active.status", "active.sessions", "active.file", "updated", recent.alias("recent"), "next_topic")
