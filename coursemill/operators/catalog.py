"""The catalogue of entries: derived columns, incremental selection, tags, tasks, bundles, upserts.

Columns follow the entries schema of FIXTURES.md; each function names the columns it reads. IDs in brackets are those of
the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from coursemill.functions import vocab
from coursemill.functions.text import collapse_ws, fold, slugify


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def entry_id(file_type: Column, title: Column, source: Column) -> Column:
    """Slug of the file's stem; of a URL, slug of its title and six digits of its md5. [P2]"""
    return F.when(file_type == "url", F.concat(slugify(title), F.lit("-"), F.substring(F.md5(source), 1, 6))).otherwise(slugify(file_stem(source)))


def category_of_name(name: Column, is_image: Column | None = None) -> Column:
    """Category by the file's name, first rule that fits. [P4]"""
    low = F.lower(F.coalesce(name, F.lit("")))
    extension = F.regexp_extract(low, r"[^/\\]\.([^./\\]+)$", 1)
    out = F.when(F.coalesce(is_image, F.lit(False)) if is_image is not None else F.lit(False), "fotos-de-prova").when(extension.isin(vocab.CODE_EXTENSIONS), "codigo-professor")
    for category, parts, codes in vocab.CATEGORY_RULES:
        pattern = "|".join([*parts, *(rf"(?:^|[\W_]){c}(?:$|[\W_])" for c in codes)])
        out = out.when(low.rlike(f"(?U){pattern}"), category)
    return out.otherwise("outros")


def title_of_name(name: Column) -> Column:
    """A friendly title: stem, separators as spaces, each run of letters capitalised. [P5]"""
    words = F.split(collapse_ws(F.regexp_replace(file_stem(name), r"[-_.]", " ")), " ")
    return F.array_join(F.transform(words, F.initcap), " ")


def profile(name: Column) -> Column:
    """A document profile by its current name. [P6]"""
    return F.coalesce(F.element_at(_map(vocab.PROFILE_ALIASES), F.lower(F.trim(F.coalesce(name, F.lit(""))))), F.lit("auto"))


def effective_profile(manual: Column, suggested: Column) -> Column:
    """The manual profile unless it is `auto`, then the suggested one. [P6]"""
    return F.when(profile(manual) != "auto", profile(manual)).otherwise(profile(suggested))


def route_extraction(mode: Column, profile_: Column, preferred: Column, has_advanced: Column, formula: Column) -> Column:
    """struct(base, advanced, reasons) of the extractors for an entry. [P7]"""
    wants = (mode == "high_fidelity") | profile_.isin("math_heavy", "diagram_heavy", "scanned") | formula
    advanced = F.when((mode == "quick") | ~has_advanced, F.lit(None).cast("string")).when(~preferred.isin("auto", "pymupdf", "pymupdf4llm"), preferred).when(profile_ == "math_heavy", "marker").when(wants, "docling")
    base = F.when(preferred == "pymupdf", "pymupdf").otherwise("pymupdf4llm")
    reasons = F.array(
        F.when(mode == "quick", F.lit("quick mode: base only")),
        F.when(mode == "manual_assisted", F.lit("manual review follows")),
        F.when(profile_ != "auto", F.concat(F.lit("profile "), profile_)),
        F.when(formula, F.lit("formulas first")),
        F.when(preferred != "auto", F.concat(F.lit("preferred "), preferred)),
        F.when(wants & ~has_advanced, F.lit("no advanced extractor")),
    )
    return F.struct(base.alias("base"), advanced.alias("advanced"), F.filter(reasons, lambda x: x.isNotNull()).alias("reasons"))


def priority_label(category: Column, chosen: Column) -> Column:
    """alta, media or normal; `chosen` is relevant for exams or in the bundle. [P8]"""
    low = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return F.when(chosen | low.isin(*vocab.EXAM, *vocab.EXERCISE), "alta").when(low.isin("material-de-aula", "codigo-professor", "quadro-branco"), "media").otherwise("normal")


def usage_label(category: Column) -> Column:
    """When to open an entry, by category. [P8]"""
    low = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return F.coalesce(*(F.when(low.isin(kinds), use) for use, kinds in vocab.USES), F.lit("consulta pontual"))


def markdown_cell(path: Column) -> Column:
    """An entry's Markdown in the routing table: its path, or that it waits for review. [P11]"""
    p = F.trim(F.coalesce(path, F.lit("")))
    return F.when(p == "", "\u2014").when(F.replace(p, F.lit("\\"), F.lit("/")).startswith("staging/"), "A revisar").otherwise(F.concat(F.lit("`"), p, F.lit("`")))


def confidence_label(manual_unit: Column, unit: Column, confidence: Column, ambiguous: Column, evidence: Column) -> Column:
    """Alta, Média or Baixa for a routing row; evidence counts topic, period and manual block. [P9]"""
    return (
        F.when(F.coalesce(manual_unit, F.lit("")) != "", "Alta")
        .when(F.coalesce(unit, F.lit("")) == "", "Baixa")
        .when(unit == "curso-inteiro", "Alta")
        .when(ambiguous | (confidence < 0.45), "Baixa")
        .when((confidence >= 0.85) | (evidence >= 2), "Alta")
        .otherwise("Média")
    )


def unit_cell(unit: Column, confidence: Column, ambiguous: Column) -> Column:
    """A unit with its doubts. [P10]"""
    return F.when(F.coalesce(unit, F.lit("")) == "", "").when(ambiguous, F.concat(unit, F.lit(" _(ambíguo)_"))).when(confidence < 0.45, F.concat(unit, F.lit(" _(baixa confiança)_"))).otherwise(unit)


ROUTING_ORDER = ["approved_markdown", "curated_markdown", "base_markdown", "advanced_markdown"]
BUNDLE_ORDER = ["approved_markdown", "curated_markdown", "advanced_markdown", "base_markdown"]


def canonical_markdown(order: list[str]) -> Column:
    """The first path that is not empty, in one of the two orders. [P11]"""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in order))


def markdown_status(path: Column, exists: Column) -> Column:
    """struct(status, needs_reprocess) of an entry's Markdown path. [P12]"""
    p = F.coalesce(path, F.lit(""))
    status = F.when(p == "", "none").when(p.rlike("^(?:[a-zA-Z]:|/)"), "external").when(~exists, "broken").when(p.rlike("^(?:exams|exercises)/|^content/approved/"), "approved").when(p.startswith("content/curated/"), "curated").when(p.startswith("staging/"), "staging").otherwise("curated")
    return F.struct(status.alias("status"), status.isin("none", "broken").alias("needs_reprocess"))


def source_key(source: Column) -> Column:
    """One key for equal sources: URLs in lower case, paths with / and in lower case. [P13]"""
    return F.lower(F.when(source.rlike("(?i)^https?://"), source).otherwise(F.replace(source, F.lit("\\"), F.lit("/"))))


def page_list(text: Column) -> Column:
    """Pages of a range like `1-3,7`, from zero; numbers count from one unless a zero occurs; null for an empty text or
    one with a bad part (`page_list_valid` tells them apart). [P18]"""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda x, i: F.trim(F.get(F.split(x, "-", 2), F.lit(i))).try_cast("int")
    spans = F.transform(parts, lambda x: F.sequence(F.least(number(x, 0), F.coalesce(number(x, 1), number(x, 0))), F.greatest(number(x, 0), F.coalesce(number(x, 1), number(x, 0)))))
    pages = F.array_sort(F.array_distinct(F.flatten(spans)))
    pages = F.when(F.array_contains(pages, 0), pages).otherwise(F.transform(pages, lambda p: p - 1))
    return F.when((F.size(parts) > 0) & page_list_valid(text), pages)


def page_list_valid(text: Column) -> Column:
    """Whether every part of a page range is a number or a span of numbers; true for an empty one. [P18]"""
    return F.coalesce(text, F.lit("")).rlike(r"^\s*(?:(?:\d+\s*(?:-\s*\d+)?)?\s*,\s*)*(?:\d+\s*(?:-\s*\d+)?)?\s*$")


def promote_destination(category: Column, name: Column) -> Column:
    """Where a reviewed entry goes; it becomes both its approved and its curated path. [P19]"""
    folder = F.when(category.isin(vocab.EXAM), "exams/past-exams").when(category.isin(vocab.EXERCISE), "exercises/lists").otherwise("content/curated")
    return F.concat(folder, F.lit("/"), name)


def bundle_score(category: Column, profile_: Column, title: Column, relevant: Column, in_bundle: Column) -> Column:
    """Points of an entry for the study bundle. [P21]"""
    t = F.lower(fold(F.coalesce(title, F.lit(""))))
    points = [(in_bundle, 30), (relevant, 40), (category.isin(vocab.EXAM), 45), (category.isin(vocab.EXERCISE), 35), (category == "material-de-aula", 20), (category.isin("bibliografia", "referencias"), 5), (profile_.isin("math_heavy", "diagram_heavy"), 10), (t.rlike("resumo|sintese|summary"), 10), (t.rlike("lista|exercicio"), 8)]
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


def bundle_reasons(category: Column, profile_: Column, relevant: Column, in_bundle: Column) -> Column:
    """Why an entry is in the bundle, in a fixed order. [P21]"""
    given = F.array(F.when(in_bundle, F.lit("bundle")), F.when(relevant, F.lit("exam-relevant")), F.when(category.isin(vocab.EXAM), F.lit("exam")), F.when(category.isin(vocab.EXERCISE), F.lit("exercise")), F.when(profile_.isin("math_heavy", "diagram_heavy"), F.lit("visual")))
    return F.filter(given, lambda x: x.isNotNull())


def bundle_seed(entries: DataFrame, least: int = 30) -> DataFrame:
    """Entries with Markdown and enough points, ranked in their course by points, category and title. [T1]"""
    w = W.partitionBy("course_id").orderBy(F.desc("bundle_score"), "category", "title", "entry_ord")
    ready = entries.filter((F.col("bundle_score") >= least) & F.col("markdown_path").isNotNull())
    return ready.withColumn("rank", F.row_number().over(w))


def split_by_source(entries: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): entries with and without their source in a file listing (course_id, path). [P22]"""
    key = listing.select("course_id", F.col("path").alias("source_path")).distinct()
    return entries.join(key, ["course_id", "source_path"], "left_semi"), entries.join(key, ["course_id", "source_path"], "left_anti")


def fill_blank(df: DataFrame, other: DataFrame, key: list[str], columns: list[str], default: dict[str, str] | None = None) -> DataFrame:
    """Blank columns filled from another frame by key (one row a key), then from defaults. [P23, J23]"""
    side = other.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = df.join(side, key, "left")
    for c in columns:
        options = [F.nullif(F.trim(c), F.lit("")), F.nullif(F.trim(f"__{c}"), F.lit(""))]
        out = out.withColumn(c, F.coalesce(*options, *([F.lit(default[c])] if default and c in default else [])))
    return out.select(*df.columns)


def override_status(manual: Column, applied: Column) -> Column:
    """How a manual unit stands against the routing table's unit. [P24]"""
    has = F.coalesce(manual, F.lit("")) != ""
    return F.when(has & (manual == applied), "applied").when(has, "saved").when(F.coalesce(applied, F.lit("")) != "", "automatic").otherwise("none")


def migrate_page_keys(images: DataFrame) -> DataFrame:
    """Image curation rows (doc_id, page_key, fname) with pages of `_page_` names moved from 0- to 1-based, unless the row
    at the new key exists already. [P25]"""
    moved = images.filter(F.col("fname").contains("_page_")).withColumn("page_key", F.col("page_key") + 1)
    there = images.filter(~F.col("fname").contains("_page_"))
    clash = moved.join(there.select("doc_id", "page_key", "fname"), ["doc_id", "page_key", "fname"], "left_anti")
    return there.unionByName(clash)


def new_entries(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Enabled entries whose source the manifest lacks. [J1, P20]"""
    keys = known.select("course_id", source_key(F.col("source_path")).alias("source_key")).distinct()
    return entries.filter(F.coalesce("enabled", F.lit(True))).withColumn("source_key", source_key(F.col("source_path"))).join(keys, ["course_id", "source_key"], "left_anti")


def live_entries(entries: DataFrame, listing: DataFrame, paths: Column) -> DataFrame:
    """Entries with a referenced file that exists, or without any reference. [J2]"""
    refs = entries.select("course_id", "entry_id", F.explode(F.filter(paths, lambda p: p.isNotNull() & (p != ""))).alias("path"))
    alive = refs.join(listing.select("course_id", "path").distinct(), ["course_id", "path"], "left_semi").select("course_id", "entry_id")
    none = entries.filter(F.size(F.filter(paths, lambda p: p.isNotNull() & (p != ""))) == 0).select("course_id", "entry_id")
    return entries.join(alive.union(none).distinct(), ["course_id", "entry_id"], "left_semi")


def heal_paths(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (course_id, entry_id, path) whose path no file has get that of the file which names them in its
    frontmatter; files: course_id, path, text. [J3]"""
    named = files.select("course_id", "path", F.regexp_extract("text", r"(?m)^entry_id:\s*\"?([^\"\r\n]+?)\"?\s*$", 1).alias("entry_id")).filter("entry_id != ''")
    healed = named.groupBy("course_id", "entry_id").agg(F.min("path").alias("__healed"))
    there = files.select("course_id", "path", F.lit(True).alias("__there")).distinct()
    out = entries.join(there, ["course_id", "path"], "left").join(healed, ["course_id", "entry_id"], "left")
    return out.withColumn("path", F.when(F.col("__there"), F.col("path")).otherwise(F.coalesce("__healed", "path"))).select(*entries.columns)


def effective_tags(manual: Column, auto: Column, legacy: Column, limit: int) -> Column:
    """Distinct tags in order of origin, at most `limit`, joined. [U1]"""
    parts = F.filter(F.transform(F.split(F.coalesce(F.replace(legacy, F.lit(","), F.lit(";")), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(F.array_distinct(F.concat(clean(manual), clean(auto), parts)), 1, limit), "; ")


def catalog_tags(catalog: Column, chosen: Column) -> Column:
    """Chosen tags that the catalogue has, in its order. [U5]"""
    return F.array_intersect(catalog, chosen)


def unreferenced(files: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """Files that nothing refers to. [U2]"""
    return files.join(used.select(*key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows in place of old ones of the same key. [U3]"""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def merge_ranked(values: DataFrame, key: list[str], value: str = "value", order: list[str] | None = None) -> DataFrame:
    """Distinct values per key without regard to case, in order of origin; the first form stays. [U4, W12]"""
    order = order or ["origin", "ord"]
    first = values.groupBy(*key, F.lower(value).alias("__low")).agg(F.min(F.struct(*order, value)).alias("x"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x[value]).alias("values"))


def last_task(tasks: DataFrame) -> DataFrame:
    """Per subject the latest task by rank of status and time, without a window. [W17]"""
    rank = F.when(F.col("status") == "completed", 3).when(F.col("status") == "failed", 2).when(F.col("status") == "cancelled", 1).otherwise(0)
    at = F.coalesce("finished_at", "started_at", "created_at")
    best = F.max(F.struct(rank.alias("r"), at.alias("at"), F.col("task_id"), F.col("status"))).alias("b")
    return tasks.groupBy("subject_name").agg(best).select("subject_name", F.col("b.task_id").alias("task_id"), F.col("b.status").alias("status"), F.col("b.at").alias("at"))


def dashboard(subjects: DataFrame, entries: DataFrame, queue: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per subject: waiting queue entries, entries, manual reviews, open tasks and the last task. [A9]"""
    waiting = queue.join(entries.select("subject_name", "source_key"), ["subject_name", "source_key"], "left_anti").groupBy("subject_name").agg(F.count("*").alias("n_waiting"))
    held = entries.groupBy("subject_name").agg(F.count("*").alias("n_entries"), F.count_if(F.col("file_type").isin("pdf", "image") & F.col("manual_review")).alias("n_reviews"))
    open_ = tasks.groupBy("subject_name").agg(F.count_if(F.col("status").isin("pending", "running")).alias("n_open"))
    out = subjects
    for part in (waiting, held, open_, last_task(tasks).select("subject_name", F.concat_ws(" @ ", "status", F.col("at").cast("string")).alias("last_task"))):
        out = out.join(part, "subject_name", "left")
    return out.na.fill(0, ["n_waiting", "n_entries", "n_reviews", "n_open"])


def log_tail(rows: DataFrame, key: str, order: list[Column], most: int = 200) -> DataFrame:
    """The newest rows of each key, at most `most`. [T2]"""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def category_index(entries: DataFrame, categories: list[str]) -> DataFrame:
    """One index of a category group: kind, whether solved, priority and usage, in course order. [A16]"""
    t = F.lower(fold(F.coalesce("title", F.lit(""))))
    rows = entries.filter(F.col("category").isin(categories))
    return rows.select("course_id", "entry_ord", "title", "category", F.when(t.rlike("final|substitu"), "final").when(t.rlike("p[123]|av[12]"), "parcial").otherwise("geral").alias("kind"), ((F.col("category") == "gabaritos") | t.rlike("gabarito|resol|soluc")).alias("has_solution"), priority_label(F.col("category"), F.coalesce("relevant_for_exam", F.lit(False))).alias("priority"), usage_label(F.col("category")).alias("usage"))
