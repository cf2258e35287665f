"""Queries over entries, tags, tasks, bundles, upserts and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemill.functions import html as H, text as X
from coursemill.operators import catalog as C, documents as D, taxonomy
from coursemill.plans.tables import query, sql_norm, table
from coursemill.sources import readers as R

_KEY = "CASE WHEN regexp_matches(url, '(?i)^https?://') THEN lower(url) ELSE lower(replace(url, chr(92), '/')) END"
_HOST_SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(strip_accents(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)))), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"


def _pages_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    return p.select(F.regexp_extract("url", r"example\.(\w+)", 1).alias("course_id"), "page_id", F.col("url").alias("source_path"), host.alias("title"), C.entry_id(F.lit("url"), host, F.col("url")).alias("entry_id"), F.lit(True).alias("enabled"))


@query("new_entries", f"""
WITH p AS (SELECT regexp_extract(url, 'example\\.(\\w+)', 1) AS course_id, page_id, url, {_KEY} AS source_key, {_HOST_SLUG} || '-' || left(md5(url), 6) AS entry_id FROM pages),
k AS (SELECT DISTINCT course_id, source_key FROM p JOIN labels ON page_id = doc_id)
SELECT course_id, source_key, page_id, entry_id FROM p ANTI JOIN k USING (course_id, source_key)""")
def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a manifest of all labelled pages lacks. J1, P2, P13, P20"""
    e = _pages_as_entries(spark, sf_dir)
    known = e.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return C.new_entries(e, known).select("course_id", "source_key", "page_id", "entry_id")



@query("file_names", """
WITH p AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'prova-' WHEN 1 THEN 'lista_' WHEN 2 THEN 'P1 ' WHEN 3 THEN 'cap1-' WHEN 4 THEN 'gabarito.' WHEN 5 THEN 'main.py' WHEN 6 THEN 'livro_' ELSE 'x-' END || CASE WHEN page_id % 8 = 5 THEN '' ELSE page_id || '.pdf' END AS name FROM pages),
s AS (SELECT *, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM p)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'provas' WHEN 1 THEN 'listas' WHEN 2 THEN 'provas' WHEN 3 THEN 'material-de-aula' WHEN 4 THEN 'gabaritos' WHEN 5 THEN 'codigo-professor' WHEN 6 THEN 'bibliografia' ELSE 'outros' END AS category,
  CASE page_id % 8 WHEN 0 THEN 'Prova ' || page_id WHEN 1 THEN 'Lista ' || page_id WHEN 2 THEN 'P1 ' || page_id WHEN 3 THEN 'Cap1 ' || page_id WHEN 4 THEN 'Gabarito ' || page_id WHEN 5 THEN 'Main' WHEN 6 THEN 'Livro ' || page_id ELSE 'X ' || page_id END AS title,
  CASE WHEN page_id % 3 = 0 OR page_id % 8 IN (0, 1, 2, 4) THEN 'alta' WHEN page_id % 8 IN (3, 5) THEN 'media' ELSE 'normal' END AS priority FROM s""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, title and priority of file names. P4, P5, P8"""
    prefix = F.expr("case page_id % 8 when 0 then 'prova-' when 1 then 'lista_' when 2 then 'P1 ' when 3 then 'cap1-' when 4 then 'gabarito.' when 5 then 'main.py' when 6 then 'livro_' else 'x-' end")
    name = F.when(F.col("page_id") % 8 == 5, prefix).otherwise(F.concat(prefix, "page_id", F.lit(".pdf")))
    p = table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    category = C.category_of_name(F.col("name"))
    return p.select("page_id", category.alias("category"), C.title_of_name(F.col("name")).alias("title"), C.priority_label(category, F.col("page_id") % 3 == 0).alias("priority"))


_LABELLED = "d AS (SELECT source AS course_id, doc_id, lang, left(text, 60) AS title, coalesce(quality, 0) = 1 AS relevant, coalesce(toxic, 0) = 0 AS in_bundle FROM documents LEFT JOIN labels USING (doc_id)), e AS (SELECT *, CASE lang WHEN 'en' THEN 'material-de-aula' WHEN 'fr' THEN 'provas' WHEN 'de' THEN 'listas' ELSE 'bibliografia' END AS category FROM d)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    e = d.join(l, "doc_id", "left").select(F.col("source").alias("course_id"), "doc_id", F.col("doc_id").alias("entry_ord"), F.substring("text", 1, 60).alias("title"), (F.coalesce("quality", F.lit(0)) == 1).alias("relevant_for_exam"), (F.coalesce("toxic", F.lit(0)) == 0).alias("include_in_bundle"), F.expr("case lang when 'en' then 'material-de-aula' when 'fr' then 'provas' when 'de' then 'listas' else 'bibliografia' end").alias("category"))
    return e


@query("bundle_seed", f"""
WITH {_LABELLED}, s AS (SELECT *, 30 * in_bundle::INT + 40 * relevant::INT + CASE category WHEN 'provas' THEN 45 WHEN 'listas' THEN 35 WHEN 'material-de-aula' THEN 20 ELSE 5 END + CASE WHEN regexp_matches(lower(strip_accents(title)), 'resumo|sintese|summary') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(strip_accents(title)), 'lista|exercicio') THEN 8 ELSE 0 END AS bundle_score FROM e)
SELECT course_id, doc_id, bundle_score::INT AS bundle_score, array_to_string(list_filter([CASE WHEN in_bundle THEN 'bundle' END, CASE WHEN relevant THEN 'exam-relevant' END, CASE WHEN category = 'provas' THEN 'exam' END, CASE WHEN category = 'listas' THEN 'exercise' END], lambda x: x IS NOT NULL), ',') AS reasons,
    row_number() OVER (PARTITION BY course_id ORDER BY bundle_score DESC, category, title, doc_id)::INT AS rank FROM s WHERE bundle_score >= 30""")
def bundle_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked for the study bundle of their course. P21, T1"""
    e = _entries(spark, sf_dir).withColumns({"markdown_path": F.col("title"), "profile": F.lit("auto")})
    c = (F.col("category"), F.col("profile"))
    e = e.withColumn("bundle_score", C.bundle_score(*c, F.col("title"), F.col("relevant_for_exam"), F.col("include_in_bundle"))).withColumn("reasons", F.array_join(C.bundle_reasons(*c, F.col("relevant_for_exam"), F.col("include_in_bundle")), ","))
    return C.bundle_seed(e).select("course_id", "doc_id", "bundle_score", "reasons", "rank")


@query("category_index", f"""WITH {_LABELLED}, t AS (SELECT *, lower(strip_accents(coalesce(title, ''))) AS t FROM e)
SELECT course_id, doc_id AS entry_ord, category, CASE WHEN regexp_matches(t, 'final|substitu') THEN 'final' WHEN regexp_matches(t, 'p[123]|av[12]') THEN 'parcial' ELSE 'geral' END AS kind, category = 'gabaritos' OR regexp_matches(t, 'gabarito|resol|soluc') AS has_solution,
  CASE WHEN category IN ('provas', 'listas') OR relevant THEN 'alta' WHEN category = 'material-de-aula' THEN 'media' ELSE 'normal' END AS priority, CASE category WHEN 'provas' THEN 'provas e revisão' WHEN 'listas' THEN 'exercícios' WHEN 'material-de-aula' THEN 'teoria base' ELSE 'referência geral' END AS usage FROM t""")
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of every course by category group. A16, P8"""
    return C.category_index(_entries(spark, sf_dir), ["provas", "listas", "material-de-aula", "bibliografia"]).drop("title")


@query("log_tail", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 200""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 events of every user. T2"""
    return C.log_tail(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END"


@query("dashboard", f"""
WITH t AS (SELECT user_id, event_id, ts, {_STATUS} AS status FROM events), r AS (SELECT *, CASE status WHEN 'completed' THEN 3 WHEN 'failed' THEN 2 ELSE 0 END AS k FROM t),
l AS (SELECT user_id, status || ' @ ' || strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS last_task FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, ts DESC, event_id DESC) AS n FROM r) WHERE n = 1),
o AS (SELECT user_id, count(*) FILTER (status IN ('pending', 'running')) AS n_open FROM t GROUP BY ALL),
e AS (SELECT o_custkey AS user_id, count(*) AS n_entries, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority < '3') AS n_reviews FROM orders GROUP BY ALL),
q AS (SELECT user_id, count(*) AS n_waiting FROM (SELECT user_id, event_id AS k FROM events) ev WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderkey = k) GROUP BY ALL)
SELECT o.user_id::VARCHAR AS subject_name, coalesce(n_waiting, 0) AS n_waiting, coalesce(n_entries, 0) AS n_entries, coalesce(n_reviews, 0) AS n_reviews, n_open, last_task FROM o LEFT JOIN l USING (user_id) LEFT JOIN e USING (user_id) LEFT JOIN q USING (user_id)""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: waiting items, entries, reviews, open tasks, last task. A9, W17"""
    ev = table(spark, sf_dir, "events")
    status = F.expr(f"case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'click' then 'running' else 'pending' end")
    at = F.date_trunc("second", "ts")
    name = F.col("user_id").cast("string").alias("subject_name")
    tasks = ev.select(name, F.col("event_id").alias("task_id"), status.alias("status"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    queue = ev.select(name, F.col("event_id").alias("source_key"))
    o = table(spark, sf_dir, "orders")
    entries = o.select(F.col("o_custkey").cast("string").alias("subject_name"), F.col("o_orderkey").alias("source_key"), F.when(F.col("o_orderstatus") == "P", "pdf").otherwise("code").alias("file_type"), (F.col("o_orderpriority") < "3").alias("manual_review"))
    out = C.dashboard(ev.select(name).distinct(), entries, queue, tasks)
    return out.withColumn("last_task", F.regexp_replace("last_task", r"\.\d+$", ""))


@query("effective_tags", """
WITH d AS (SELECT doc_id, [lang, source] AS m, [source, 'auto'] AS a, lang || ', ' || 'old; ' || source AS l FROM documents)
SELECT doc_id, lang || '; ' || source || '; auto' AS tags3, lang || '; ' || source || '; auto; old' AS tags6 FROM documents""")
def effective_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of documents from three origins, with both limits. U1"""
    m, a, l = F.array("lang", "source"), F.array("source", F.lit("auto")), F.concat("lang", F.lit(", old; "), "source")  # noqa: E741
    return table(spark, sf_dir, "documents").select("doc_id", C.effective_tags(m, a, l, 3).alias("tags3"), C.effective_tags(m, a, l, 6).alias("tags6"))


@query("catalog_tags", """
WITH c AS (SELECT source, list_sort(list_distinct(list(lang))) AS cat FROM documents GROUP BY source)
SELECT doc_id, array_to_string(list_filter(cat, lambda x: x = lang OR x = 'en'), ',') AS chosen FROM documents JOIN c USING (source)""")
def catalog_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen tags limited to the course's catalogue, in its order. U5"""
    d = table(spark, sf_dir, "documents")
    cat = d.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("cat"))
    return d.join(cat, "source").select("doc_id", F.array_join(C.catalog_tags(F.col("cat"), F.array("lang", F.lit("en"))), ",").alias("chosen"))


@query("merged_profiles", """
WITH v AS (SELECT n_regionkey AS course, 0 AS origin, n_nationkey AS o, n_name AS v FROM nation UNION ALL SELECT c_nationkey % 5, 1, c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_nationkey % 5, 2, c_custkey, lower(c_mktsegment) FROM customer),
f AS (SELECT course, lower(v) AS low, min_by(v, origin * 100000000 + o) AS v, min(origin * 100000000 + o) AS o FROM v GROUP BY ALL)
SELECT course, string_agg(v, ',' ORDER BY o) AS merged FROM f GROUP BY course""")
def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of three origins merged in order, without regard to case. U4, W12"""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    course = (F.col("c_nationkey") % 5).alias("course")
    v = n.select(F.col("n_regionkey").alias("course"), F.lit(0).alias("origin"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("value"))
    v = v.union(c.select(course, F.lit(1), "c_custkey", "c_mktsegment")).union(c.select(course, F.lit(2), "c_custkey", F.lower("c_mktsegment")))
    return C.merge_ranked(v, ["course"]).select("course", F.array_join("values", ",").alias("merged"))


@query("upserted", """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT DISTINCT l_orderkey, l_orderkey, 'R' FROM lineitem WHERE l_returnflag = 'R'""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with those that have returns replaced. U3"""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_orderkey").alias("o_custkey"), F.lit("R").alias("o_orderstatus")).distinct()
    return C.upsert(old, new, ["o_orderkey"])


@query("unreferenced", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large line refers to. U2"""
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return C.unreferenced(table(spark, sf_dir, "part"), used, ["p_partkey"]).select("p_partkey", "p_name")


@query("live_entries", """WITH e AS (SELECT o_custkey AS course_id, o_orderkey AS entry_id, CASE WHEN o_orderstatus = 'P' THEN [] ELSE [o_orderpriority, 'x' || (o_orderkey % 9)] END AS paths FROM orders), l AS (SELECT DISTINCT o_custkey AS course_id, o_orderpriority AS path FROM orders WHERE o_totalprice > 100000)
SELECT course_id, entry_id FROM e WHERE len(paths) = 0 OR EXISTS (SELECT 1 FROM l WHERE l.course_id = e.course_id AND list_contains(e.paths, l.path))""")
def live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a file that exists, or without any reference. J2"""
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("entry_id"), F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", F.concat(F.lit("x"), F.col("o_orderkey") % 9))).alias("paths"))
    listing = o.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("course_id"), F.col("o_orderpriority").alias("path"))
    return C.live_entries(e, listing, F.col("paths")).select("course_id", "entry_id")


@query("healed_paths", """WITH f AS (SELECT source AS course_id, doc_id::VARCHAR AS entry_id, 'f/' || doc_id || '.md' AS path FROM documents), e AS (SELECT source AS course_id, doc_id::VARCHAR AS entry_id, CASE WHEN lang = 'en' THEN 'f/' || doc_id || '.md' ELSE 'gone/' || doc_id END AS path FROM documents)
SELECT e.course_id, e.entry_id, f.path FROM e JOIN f USING (course_id, entry_id)""")
def healed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are gone found again by the frontmatter of files. J3"""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.col("doc_id").cast("string").alias("entry_id"), "lang", "text")
    good = F.concat(F.lit("f/"), "entry_id", F.lit(".md"))
    files = d.select("course_id", good.alias("path"), F.concat(F.lit('---\nentry_id: "'), "entry_id", F.lit('"\n---\n'), "text").alias("text"))
    e = d.select("course_id", "entry_id", F.when(F.col("lang") == "en", good).otherwise(F.concat(F.lit("gone/"), "entry_id")).alias("path"))
    return C.heal_paths(e, files)


@query("source_split", """SELECT o_orderkey, o_custkey AS course_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AS found FROM orders""")
def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with and without their source in a listing. P22"""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), "o_orderkey", F.col("o_orderkey").alias("source_path"))
    listing = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("path")).distinct().join(o.select("course_id", F.col("source_path").alias("path")), "path")
    found, missing = C.split_by_source(o, listing)
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False))).select("o_orderkey", "course_id", "found")


@query("filled_meta", """SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE '' END, ''), n_name) AS institution, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'none' END AS semester FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def filled_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank course fields filled from another table or defaults. P23, J23"""
    blank = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise(" ")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), blank.alias("institution"), blank.alias("semester"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("institution"), F.lit("").alias("semester"))
    return C.fill_blank(c, n, ["k"], ["institution", "semester"], {"semester": "none"}).drop("k")


@query("routed", """
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'quick' ELSE 'high_fidelity' END AS mode, CASE o_custkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'math_heavy' ELSE 'scanned' END AS profile, o_orderstatus = 'F' AS adv FROM orders)
SELECT o_orderkey, 'pymupdf4llm' AS base, CASE WHEN mode = 'quick' OR NOT adv THEN NULL WHEN profile = 'math_heavy' THEN 'marker' WHEN mode = 'high_fidelity' OR profile <> 'auto' THEN 'docling' END AS advanced,
    (CASE WHEN mode = 'quick' THEN 1 ELSE 0 END + CASE WHEN profile <> 'auto' THEN 1 ELSE 0 END + CASE WHEN (mode = 'high_fidelity' OR profile <> 'auto') AND NOT adv THEN 1 ELSE 0 END)::INT AS n_reasons FROM o""")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractors of entries by mode and profile. P6, P7"""
    o = table(spark, sf_dir, "orders")
    mode = F.expr("case o_orderkey % 3 when 0 then 'auto' when 1 then 'quick' else 'high_fidelity' end")
    old = F.expr("case o_custkey % 3 when 0 then 'general' when 1 then 'math_light' else 'scanned' end")
    r = C.route_extraction(mode, C.effective_profile(F.lit("auto"), old), F.lit("auto"), F.col("o_orderstatus") == "F", F.lit(False))
    return o.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.base", "r.advanced", F.size("r.reasons").alias("n_reasons"))


@query("markdown_states", """
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/tmp/x.md' WHEN 2 THEN 'exams/past-exams/x.md' WHEN 3 THEN 'content/curated/x.md' ELSE 'staging/x.md' END AS p, o_orderstatus = 'F' AS there FROM orders)
SELECT o_orderkey, CASE WHEN p = '' THEN 'none' WHEN starts_with(p, '/') THEN 'external' WHEN NOT there THEN 'broken' WHEN starts_with(p, 'exams') THEN 'approved' WHEN starts_with(p, 'content') THEN 'curated' ELSE 'staging' END AS status, p = '' OR (NOT there AND p <> '/tmp/x.md') AS needs_reprocess,
    CASE WHEN p = '' THEN 'b' ELSE p END AS routing_path, CASE WHEN p = '' THEN 'a' ELSE p END AS bundle_path, CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'applied' ELSE 'saved' END AS override, CASE WHEN o_orderkey % 5 = 2 THEN 'exams/past-exams/x' ELSE 'content/curated/x' END AS destination FROM o""")
def markdown_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, canonical paths, overrides and destinations of entries. P11, P12, P19, P24"""
    o = table(spark, sf_dir, "orders")
    path = F.expr("case o_orderkey % 5 when 0 then '' when 1 then '/tmp/x.md' when 2 then 'exams/past-exams/x.md' when 3 then 'content/curated/x.md' else 'staging/x.md' end")
    df = o.select("o_orderkey", path.alias("approved_markdown"), F.lit(" ").alias("curated_markdown"), F.lit("b").alias("base_markdown"), F.lit("a").alias("advanced_markdown"), (F.col("o_orderstatus") == "F").alias("there"))
    n = F.col("o_orderkey") % 5
    manual, applied = F.when(n == 0, "").otherwise("u1"), F.when(n == 0, "").when(n == 1, "u1").otherwise("u2")
    df = df.withColumn("s", C.markdown_status(F.col("approved_markdown"), F.col("there")))
    return df.select("o_orderkey", "s.status", "s.needs_reprocess", C.canonical_markdown(C.ROUTING_ORDER).alias("routing_path"), C.canonical_markdown(C.BUNDLE_ORDER).alias("bundle_path"), C.override_status(manual, applied).alias("override"), C.promote_destination(F.when(n == 2, "provas").otherwise("outros"), F.lit("x")).alias("destination"))


@query("page_titles", r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and host of every page. F20"""
    return H.page_blocks(table(spark, sf_dir, "pages")).select("page_id", "title", "host")


@query("page_markdown")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main content of every page as Markdown of at most 15 000 characters. F20, W14"""
    b = H.page_blocks(table(spark, sf_dir, "pages")).select("page_id", F.posexplode("blocks").alias("ord", "block"))
    kept = D.truncate_blocks(b, ["page_id"])
    return kept.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), "\n\n").alias("markdown"))


@query("truncated_blocks", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
s AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY ord) AS upto FROM l), t AS (SELECT *, upto <= 15000 AS fits, 15000 - (upto - length(block) - 2) AS room FROM s),
u AS (SELECT *, NOT fits AND coalesce(lag(fits) OVER (PARTITION BY doc_id ORDER BY ord), true) AS f FROM t)
SELECT doc_id, ord::INT AS ord, CASE WHEN fits THEN block WHEN room > 160 THEN rtrim(substr(block, 1, room::INT)) || chr(10) || chr(10) || '[...]' ELSE '[...]' END AS block FROM u WHERE fits OR f""")
def truncated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text while 15000 characters last. W14"""
    b = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "block"))
    return D.truncate_blocks(b, ["doc_id"], most=15_000)


@query("code_files", r"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' ELSE 'isabelle' END AS language, CASE WHEN page_id % 2 = 0 THEN 'codigo-aluno' ELSE 'codigo-professor' END AS category FROM pages WHERE page_id % 3 <> 3 AND strlen(html) <= 500000 AND NOT contains(url, '/de/')""")
def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files that the import keeps, by path and size. S3"""
    n = F.col("page_id")
    path = F.concat(F.when(F.col("url").contains("/de/"), "src/node_modules/").otherwise("src/"), n, F.when(n % 3 == 0, ".py").when(n % 3 == 1, ".hpp").otherwise(".thy"))
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").alias("length"))
    return p.filter(R._code_filter(F.col("path"), F.col("length"))).select("page_id", R.language(F.col("path")).alias("language"), R.branch_category(F.when(n % 2 == 0, "Main").otherwise("dev")).alias("category"))


@query("entry_defaults", """SELECT doc_id, CASE WHEN lang = 'en' THEN lang || '|' || source ELSE 'manual' END AS manual_tags, CASE WHEN lang = 'en' THEN '' ELSE lang || ';' || source END AS tags, 'provas' AS category, 'math_heavy' AS document_profile, true AS enabled FROM documents""")
def entry_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old forms of manifest entries brought up to date. S1"""
    d = table(spark, sf_dir, "documents")
    e = d.select("doc_id", F.lit("pdf").alias("file_type"), F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array(F.lit("manual"))).alias("manual_tags"), F.concat_ws(";", "lang", "source").alias("tags"), F.lit("exams").alias("category"), F.lit("math_light").alias("document_profile"), *(F.lit(None).cast("boolean").alias(c) for c in ("relevant_for_exam", "include_in_bundle", "enabled")))
    return R.entry_defaults(e).select("doc_id", F.array_join("manual_tags", "|").alias("manual_tags"), "tags", "category", "document_profile", "enabled")


@query("notebooks")
def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notebooks, compacted to Markdown. S5"""
    c = table(spark, sf_dir, "conversations")
    cell = F.struct("turn", F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"), F.array("text").alias("source"), F.array(F.struct(F.col("text").alias("text"))).alias("outputs"))
    books = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(cell)).alias("cells"))).alias("raw"))
    return books.select("conv_id", R.compact_notebook(F.col("raw")).alias("n")).select("conv_id", "n.language", F.md5("n.markdown").alias("markdown_md5"), F.length("n.markdown").alias("n_chars"))


@query("course_indexes", """SELECT source AS course_id, count(*)::INT AS n_items, md5(string_agg(doc_id || ':' || lang, ',' ORDER BY doc_id)) AS items_md5 FROM documents GROUP BY source""")
def course_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index row per course with its entries in order. S9"""
    index = R.index_documents(table(spark, sf_dir, "documents"), "source", ["doc_id"], ["doc_id", "lang"], "items")
    return index.select(F.col("source").alias("course_id"), F.size("items").alias("n_items"), F.md5(F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["doc_id"], x["lang"])), ",")).alias("items_md5"))


@query("region_tables", """
WITH r AS (SELECT n_regionkey AS region, n_nationkey AS row, CASE WHEN n_nationkey % 2 = 0 THEN '| ' || n_name || ' | ' || n_nationkey || ' |' ELSE '| ' || n_name || ' |  |' END AS line FROM nation),
n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY row) AS k FROM r)
SELECT region, string_agg(CASE WHEN k = 1 THEN line || chr(10) || '| --- | --- |' ELSE line END, chr(10) ORDER BY row) AS markdown FROM n GROUP BY region""")
def region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a Markdown table with short rows padded. S10"""
    n = table(spark, sf_dir, "nation")
    cells = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.col("n_nationkey").cast("string"))).otherwise(F.array("n_name"))
    return D.table_markdown(n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("row"), cells.alias("cells")), ["region"])


@query("derived_units", f"""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, lower(o_orderpriority) AS t, CASE o_orderstatus WHEN 'F' THEN '' ELSE 'unidade-0' || (o_orderkey % 3 + 1) || '-parte' END AS u FROM orders),
b AS (SELECT c, u, min(k) AS ord, string_agg(t, ' ' ORDER BY k, t) AS signals FROM o WHERE u <> '' GROUP BY ALL),
m AS (SELECT c_custkey AS c, unnest(range(1, c_custkey % 3 + 1)) AS i FROM customer)
SELECT m.c AS course_id, 'unidade-0' || i || '-parte' AS unit_slug, 'Unidade ' || i || ' - Parte' AS unit_title, signals FROM m LEFT JOIN b ON b.c = m.c AND b.u = 'unidade-0' || i || '-parte'
UNION ALL SELECT c, u, u, signals FROM b WHERE c % 3 = 0""")
def derived_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of course maps (customers), of those without any from their blocks (orders), with the blocks' words. J26"""
    part = F.transform(F.sequence(F.lit(1), F.col("c_custkey").cast("int") % 3), lambda i: F.concat(F.lit("###  Unidade "), i, F.lit(" - Parte \n#### nada\n- topico")))
    maps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_id"), F.concat(F.lit("# Mapa\n"), F.when(F.col("c_custkey") % 3 == 0, "###\nsem unidades").otherwise(F.array_join(part, "\n"))).alias("markdown"))
    unit = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("unidade-0"), F.col("o_orderkey") % 3 + 1, F.lit("-parte")))
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("block_ord"), unit.alias("unit_slug"), F.lower("o_orderpriority").alias("topic_text"))
    return taxonomy.derive_units(maps, blocks).select("course_id", "unit_slug", "unit_title", "signals")
