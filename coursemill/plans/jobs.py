"""The whole jobs: routing table, timeline, taxonomy with tags, course map and glossary of every course at once.

Each chains operators over frames keyed by course_id; nothing is collected. Texts stay in the row of their document until
its topic and unit are known; what follows moves light rows only. What a job reads more than once is staged. IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from coursemill.functions import vocab
from coursemill.functions.text import clamp, match_text, slugify, tokens, unit_slug
from coursemill.operators import catalog, documents, profiles, scoring, taxonomy, timeline
from coursemill.sources.staging import staged

_PATHS = ["approved_markdown", "curated_markdown", "base_markdown", "advanced_markdown"]


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _has(df: DataFrame, column: str, kind: str = "string") -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))


def matched_entries(entries: DataFrame, topics: DataFrame, units: DataFrame) -> DataFrame:
    """Entries with their signals, topic, unit and where it comes from: preferred_topic, match_slug, match_confidence,
    match_ambiguous, reason. [J4, J5, J12, J21, W1]

    entries: course_id, entry_id, title, category, markdown, and what `signals` and `file_map` read; topics: course_id,
    topic_ord, topic_slug, topic_label, unit_slug, unit_ord, kind, aliases; units: course_id, unit_ord, unit_slug,
    unit_title, topics. A valid manual unit wins, then the unit of a sure topic, then the best unit.
    """
    df = scoring.best_topic(scoring.topic_candidates(scoring.signals(entries), topics))
    df = scoring.best_unit(scoring.unit_candidates(df, scoring.unit_index(units)))
    first = topics.groupBy("course_id", "topic_slug").agg(F.min_by("unit_slug", F.struct("unit_ord", "topic_ord")).alias("__first"))
    df = df.join(first, ["course_id", "topic_slug"], "left")
    known = lambda c: F.coalesce(F.exists("units", lambda u: u["unit_slug"] == c), F.lit(False))
    sure = F.coalesce((_blank(F.col("topic_slug")) != "") & ~F.col("ambiguous") & (F.col("confidence") >= 0.45), F.lit(False))
    df = df.withColumns({"__manual": F.when((_blank(F.trim("manual_unit_slug")) != "") & known(unit_slug("manual_unit_slug")), unit_slug("manual_unit_slug")).otherwise(""), "__sure": sure, "__derived": F.when(known(F.col("topic_unit")), F.col("topic_unit")).otherwise(_blank(F.col("__first")))})
    whole, by_hand = _blank(F.col("category")).isin(*vocab.NO_TIMELINE, "references"), F.col("__manual") != ""
    by_topic = F.col("__sure") & (F.col("__derived") != "")
    return df.withColumns({
        "whole_course": whole, "preferred_topic": F.when(~whole & F.col("__sure"), F.col("topic_slug")).otherwise(""),
        "match_slug": F.when(whole, "").when(by_hand, F.col("__manual")).when(by_topic, F.col("__derived")).otherwise(_blank(F.col("unit_slug"))),
        "match_confidence": F.when(whole, 0.0).when(by_hand, 1.0).when(by_topic, F.col("confidence")).otherwise(F.coalesce("unit_confidence", F.lit(0.0))),
        "match_ambiguous": F.when(whole, True).when(by_hand, False).when(by_topic, F.col("ambiguous")).otherwise(F.coalesce("unit_ambiguous", F.lit(True))),
        "reason": F.when(whole, "").when(by_hand, "manual-unit").when(by_topic, F.concat(F.lit("topic="), "topic_slug")).otherwise(F.format_string("score=%.2f", F.coalesce("unit_best", F.lit(0.0)))),
    }).drop("__manual", "__sure", "__derived", "__first", "topics", "units", "n_topics", "topic_unit", "best", "second", "confidence", "ambiguous", "unit_best", "unit_confidence", "unit_ambiguous", "unit_slug")


def _cards(column: str) -> Column:
    """Cards of `card_evidence` as card_norm and kind (card or topic)."""
    return F.transform(column, lambda c: F.struct(c["normalized_title"].alias("card_norm"), F.replace(c["source_kind"], F.lit("-title"), F.lit("")).alias("kind")))


def block_sessions(blocks: DataFrame) -> DataFrame:
    """The sessions that lie in blocks as rows: course_id, block_id, session_id, ord, date, kind, text_norm, cards. [W7, J22]"""
    each = blocks.select("course_id", "block_id", F.posexplode("sessions").alias("ord", "s"))
    text = F.concat_ws(" ", F.col("s.label"), F.array_join(F.transform("s.signals", lambda x: match_text(x)), " "))
    # a session's id tells it within its block only if its date is its own: its place is added
    return each.select("course_id", "block_id", F.concat_ws("#", "s.session_id", "ord").alias("session_id"), "ord", "s.date", "s.kind", text.alias("text_norm"), _cards("s.card_evidence").alias("cards"))


def entry_periods(matched: DataFrame, blocks: DataFrame, rows: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The period of each entry that one holds for: course_id, entry_id, period, block_id. [J7, J8, J9, J22, W1]

    matched: `matched_entries`; blocks: course_id, block_id, block_ord, period_label, unit_slug, unit_confidence,
    primary_topic_slug, primary_topic_confidence, topic_slugs, topic_text; rows: course_id, block_id, row_index,
    content_norm, ignored; sessions: course_id, block_id, session_id, ord, date, kind, text_norm, and cards if there are any. Blocks
    as `timeline_index` returns them hold their sessions and cards themselves. The blocks of the entry's unit come first,
    then those without one; where a block has the entry's topic, only such blocks compete.
    """
    key = ["entry_id"]
    if sessions is None and "sessions" in blocks.columns:
        sessions = staged(block_sessions(blocks), "sessions")
    cards = {"block": None, "session": None}
    timed = matched.filter("not whole_course and not match_ambiguous and match_slug != '' and match_confidence >= 0.45")
    combined = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (F.col("s_title"), F.col("s_raw"), F.col("s_category"), match_text("tags"), F.col("s_body"))))
    raw = F.concat_ws("\n", "title", "raw_target", "category", "tags", "markdown")
    timed = timed.withColumns({"exercise": scoring.is_exercise(), "s_all": combined}).withColumns(scoring.temporal_signals(F.col("s_all"), raw))
    texts = timed.select("course_id", "entry_id", "s_title", "s_body", "s_raw", "s_tags", "s_category", "s_manual_tags", "s_auto_tags", "s_legacy_tags", "s_all")
    wanted = F.filter(F.array(F.struct(F.lit(0).alias("tier"), F.col("match_slug").alias("block_unit")), F.when(F.col("match_confidence") >= 0.55, F.struct(F.lit(1).alias("tier"), F.lit("").alias("block_unit")))), lambda x: x.isNotNull())
    light = timed.select("course_id", "entry_id", "exercise", "dates", "start", "end", "says_async", "says_class", F.col("match_slug").alias("preferred_unit"), "preferred_topic", F.inline(wanted))
    of_units = blocks.select("course_id", "block_id", _blank(F.col("unit_slug")).alias("block_unit"), "primary_topic_slug", "topic_slugs")
    pairs = light.join(of_units, ["course_id", "block_unit"])
    same = F.coalesce((F.col("preferred_topic") != "") & ((F.col("primary_topic_slug") == F.col("preferred_topic")) | F.array_contains("topic_slugs", F.col("preferred_topic"))), F.lit(False))
    pairs = pairs.withColumn("__same", same).withColumn("__any", F.max("__same").over(W.partitionBy("course_id", "entry_id", "tier"))).filter("__same or not __any")
    pairs = staged(pairs.drop("__same", "__any", "block_unit", "primary_topic_slug", "topic_slugs"), "pairs")  # their dates are read out of whole texts
    scored_rows = staged(scoring.row_scores(texts, rows.filter("not ignored"), key), "rows")
    topic_rows = blocks.select("course_id", F.col("block_id").alias("row_index"), tokens("topic_text").alias("row_tokens"))
    tag_scores = scoring.overlap_scores(texts, topic_rows, key, {"s_manual_tags": 0.35, "s_auto_tags": 0.12, "s_legacy_tags": 0.05}).select("course_id", "entry_id", F.col("row_index").alias("block_id"), F.col("score").alias("tag_score"))
    facts = blocks.select("course_id", "block_id", _blank(F.col("unit_slug")).alias("block_unit"), "unit_confidence", "primary_topic_slug", "primary_topic_confidence", "topic_slugs")
    if "card_evidence" in blocks.columns:
        holders = blocks.select("course_id", "block_id", _cards("card_evidence").alias("cards")).filter(F.size("cards") > 0)
        named = staged(holders.select("course_id", F.inline("cards")).distinct(), "cards")
        whole = lambda *columns: texts.select("course_id", "entry_id", F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in columns)).alias("text_norm"))
        hits = scoring.card_hits(whole("s_title", "s_body", "s_category", "s_tags", "s_raw"), named, key)
        cards["block"] = scoring.held_cards(hits, holders, key, "block_id")
        if sessions is not None and "cards" in sessions.columns:
            cards["session"] = scoring.held_cards(scoring.card_hits(whole("s_all"), named, key), sessions.filter(F.size("cards") > 0), key, "session_id")
    scored = scoring.block_scores(pairs, facts, rows, scored_rows, key, tag_scores, cards["block"]).join(blocks.select("course_id", "block_id", "block_ord", "period_label"), ["course_id", "block_id"])
    group = ["course_id", "entry_id", "tier"]
    if sessions is None:
        best = scored.select(*group, "block_id", F.lit(None).cast("double").alias("session_score"), F.lit(0.0).alias("session_card"))
    else:
        words = sessions.select("course_id", F.col("session_id").alias("row_index"), tokens("text_norm").alias("row_tokens"))
        said = scoring.overlap_scores(texts, words, key, {"s_all": 1.1}).withColumnRenamed("row_index", "session_id")
        each = scoring.session_scores(pairs, sessions.drop("text_norm", "cards"), key, said, cards["session"])
        best = each.groupBy(*group, "block_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "session_card")).alias("s")).select(*group, "block_id", F.col("s.score").alias("session_score"), F.col("s.session_card").alias("session_card"))
    won = scoring.period_winner(scored, best, group).filter("period != '' and not ambiguous and confidence >= 0.5")
    return won.groupBy("course_id", "entry_id").agg(F.min(F.struct("tier", "period", "block_id")).alias("w")).select("course_id", "entry_id", "w.period", "w.block_id")


def file_map(entries: DataFrame, topics: DataFrame, units: DataFrame, blocks: DataFrame, rows: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The routing table: per entry title, category, usage, priority, Markdown cell, sections, unit, confidence, period and
    trace. [job file_map]

    entries: course_id, entry_id, entry_ord, title, category, markdown, and as far as there: manual_tags, auto_tags, tags,
    raw_target, manual_unit_slug, manual_timeline_block_id, relevant_for_exam, include_in_bundle, the four Markdown paths.
    blocks, rows: as `timeline_index` returns them, or as for `entry_periods`, and administrative.
    """
    for c in ("tags", "raw_target", "manual_unit_slug", "manual_timeline_block_id", *_PATHS):
        entries = _has(entries, c)
    for c in ("relevant_for_exam", "include_in_bundle"):
        entries = _has(entries, c, "boolean")
    for c in ("manual_tags", "auto_tags"):
        entries = _has(entries, c, "array<string>")
    topics, units, blocks, rows = (staged(t, n) for t, n in ((topics, "topics"), (units, "units"), (blocks, "blocks"), (rows, "rows")))  # each is read many times
    matched = staged(matched_entries(entries, topics, units), "matched")
    periods = entry_periods(matched, blocks, rows, sessions).select("course_id", "entry_id", "period")
    by_hand = scoring.manual_blocks(entries.filter("manual_timeline_block_id != ''").select("course_id", "entry_id", F.col("manual_timeline_block_id").alias("manual_block"), _blank(F.col("manual_unit_slug")).alias("manual_unit")), blocks, ["course_id", "entry_id"])
    by_hand = by_hand.join(blocks.select("course_id", "block_id", F.col("period_label").alias("manual_period")), ["course_id", "block_id"]).drop("block_id")
    light = matched.select(
        "course_id", "entry_id", "entry_ord", "title", "category", "manual_tags", "auto_tags", "tags", "raw_target", "manual_unit_slug", "manual_timeline_block_id", "relevant_for_exam", "include_in_bundle",
        catalog.canonical_markdown(_PATHS).alias("md_path"), documents.section_list(F.col("markdown")).alias("sections"), "whole_course", "preferred_topic", "match_slug", "match_confidence", "match_ambiguous", "reason",
    )
    out = light.join(periods, ["course_id", "entry_id"], "left").join(by_hand, ["course_id", "entry_id"], "left")
    out = out.withColumn("period", F.when(F.col("whole_course"), "").otherwise(F.coalesce("period", "manual_period", F.lit(""))))
    unit = F.when(F.col("whole_course"), "curso-inteiro").otherwise(catalog.unit_cell(F.col("match_slug"), F.col("match_confidence"), F.col("match_ambiguous")))
    evidence = (F.col("preferred_topic") != "").cast("int") + (F.col("period") != "").cast("int") + (_blank(F.col("manual_timeline_block_id")) != "").cast("int")
    label = catalog.confidence_label(F.col("manual_unit_slug"), F.when(F.col("whole_course"), "curso-inteiro").otherwise(F.col("match_slug")), F.col("match_confidence"), F.col("match_ambiguous"), evidence)
    tags = catalog.effective_tags(F.col("manual_tags"), F.col("auto_tags"), F.col("tags"), 3)
    cited = lambda name, c: F.when(_blank(c) != "", F.concat(F.lit(f"{name}: `"), c, F.lit("`")))
    staging = F.when(_blank(F.col("md_path")).startswith("staging/"), F.col("md_path"))
    trace = F.concat_ws("; ", cited("raw", F.col("raw_target")), cited("tags", tags), cited("unidade-manual", F.col("manual_unit_slug")), cited("bloco-manual", F.col("manual_timeline_block_id")), cited("markdown-base", staging))
    return out.select(
        "course_id", "entry_ord", "entry_id", "title", "category", catalog.usage_label(F.col("category")).alias("usage"),
        catalog.priority_label(F.col("category"), F.coalesce("relevant_for_exam", F.lit(False)) | F.coalesce("include_in_bundle", F.lit(False))).alias("priority"),
        catalog.markdown_cell(F.col("md_path")).alias("markdown"), "sections", unit.alias("unit"), label.alias("confidence"), "period", trace.alias("trace"), "reason",
    )


def file_map_markdown(table: DataFrame, most: int = 12_000) -> DataFrame:
    """The routing table of each course as Markdown, clamped. [job file_map, T4]"""
    cells = ["entry_ord", "title", "category", "usage", "priority", "markdown", "sections", "unit", "confidence", "period"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(_blank(F.col(c).cast("string")) for c in cells)), F.lit(" |"), F.when(F.col("trace") != "", F.concat(F.lit("\n|  | ↳ rastreabilidade |  | "), "trace", F.lit(" |  |  |  |  |  |  |"))).otherwise(""))
    head = "| # | Título | Categoria | Quando abrir | Prioridade | Markdown | Seções | Unidade | Confiança | Período |\n|---|---|---|---|---|---|---|---|---|---|\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("entry_ord", "entry_id", row.alias("line")))), lambda x: x["line"])
    return table.groupBy("course_id").agg(clamp(F.concat(F.lit(head), F.array_join(lines, "\n")), most).alias("markdown"))


def timeline_index(courses: DataFrame, topics: DataFrame, units: DataFrame, text: str = "schedule") -> tuple[DataFrame, DataFrame]:
    """(blocks, rows) of every course's schedule: blocks with period, topics, unit and doubts, rows with their block.
    Sessions and cards are arrays inside their block.
    [job timeline_index: S7, F7, F8, W5, W6, W7, J22, J4, W2, J6, W3, W4]

    courses: course_id and the schedule's Markdown; topics, units: as for `matched_entries`.
    """
    topics, units = staged(topics, "topics"), staged(units, "units")
    cut = staged(timeline.segment_blocks(timeline.candidate_rows(timeline.read_schedule(courses, text))), "rows")
    rows = cut.select("course_id", F.format_string("bloco-%02d", "block_no").alias("block_id"), "row_index", "content", "content_norm", "date_text", "date_dt", "kind", "ignored")
    blocks = staged(timeline.block_attributes(cut), "blocks")
    empty = {c: F.lit("") for c in ("s_headings", "s_lead", "s_category", "s_manual_tags", "s_auto_tags", "s_legacy_tags")}
    seen = blocks.filter("taught").select("course_id", "block_id", F.col("topic_text").alias("s_title"), F.col("full_text").alias("s_body"), F.col("full_text").alias("s_raw")).withColumns(empty)
    scored = scoring.topic_scores(seen, topics, rest=5).join(topics.select("course_id", "topic_ord", "kind"), ["course_id", "topic_ord"])
    scored = scored.withColumn("score", F.col("score") + F.when(F.col("kind") == "subtopic", 0.18).otherwise(0.0))
    best = staged(timeline.block_topic_candidates(scored), "topics")
    df = blocks.join(best, ["course_id", "block_id"], "left").withColumns({"primary_topic_slug": _blank(F.col("primary_topic_slug")), "primary_topic_label": _blank(F.col("primary_topic_label")), "primary_topic_confidence": F.coalesce("primary_topic_confidence", F.lit(0.0)), "topic_ambiguous": F.coalesce("topic_ambiguous", F.lit(True))})
    named = scoring.topic_unit(df.withColumns({"topic_slug": F.col("primary_topic_slug"), "unit_slug": _blank(F.col("primary_topic_unit"))}), topics, units)
    ready = named.withColumns({"topic_unit": F.when(F.col("primary_topic_slug") != "", F.col("derived_unit")).otherwise(""), "topic_confidence": F.col("primary_topic_confidence")}).drop("derived_unit", "unit_slug", "topic_slug", "primary_topic_unit")
    placed = timeline.block_units(ready, timeline.block_unit_scores(blocks.select("course_id", "block_id", "full_text", "topic_text"), scoring.unit_index(units)))
    filled = timeline.inherit_unit(placed)
    slugs = F.transform(F.coalesce("topic_candidates", F.array().cast("array<struct<topic_slug:string,score:double,confidence:double>>")), lambda x: x["topic_slug"])
    return staged(filled.withColumn("topic_slugs", slugs).drop("topic_unit", "topic_confidence", "full_text"), "timeline"), rows


def content_taxonomy(plans: DataFrame, glossaries: DataFrame, heads: DataFrame) -> DataFrame:
    """Topics of every course: from its plan, with aliases from its glossary and from headings that support them.
    [job taxonomy_and_tags: F21, F24, J15, J16, W13]

    plans: course_id, plan; glossaries: course_id, glossary; heads: course_id, heading. Returns course_id, unit_ord,
    unit_slug, unit_title, topic_ord, topic_slug, topic_code, topic_label, kind, aliases.
    """
    found = taxonomy.plan_units(plans).filter("topic_text is not null")
    base = found.select("course_id", "unit_ord", "unit_slug", "unit_title", "topic_ord", slugify("topic_text").alias("topic_slug"), _blank(F.col("topic_code")).alias("topic_code"), F.col("topic_text").alias("topic_label"), F.when(F.col("depth") >= 1, "subtopic").otherwise("topic").alias("kind"))
    aliases = taxonomy.glossary_aliases(base.select("course_id", "topic_slug", "topic_label", "unit_slug"), taxonomy.glossary(glossaries))
    base = base.join(aliases, ["course_id", "topic_slug"], "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    once = base.groupBy("course_id", "unit_slug", "topic_slug").agg(*(F.min_by(c, F.struct("unit_ord", "topic_ord")).alias(c) for c in ("unit_ord", "unit_title", "topic_ord", "topic_code", "topic_label", "kind", "aliases")))
    once = once.withColumn("topic_ord", (F.col("unit_ord") * 10_000 + F.col("topic_ord")).cast("long"))
    named = heads.select("course_id", taxonomy.strip_topic_prefix(F.col("heading")).alias("heading")).filter("heading != ''").distinct().withColumn("ord", F.lit(0))
    owned = once.withColumn("topic_slug", F.concat_ws("\n", "unit_slug", "topic_slug"))  # one slug may stand in two units
    support = taxonomy.heading_support(named, owned).groupBy("course_id", F.col("topic_slug").alias("owned")).agg(F.array_sort(F.collect_set("heading")).alias("__heads"))
    out = once.withColumn("owned", F.concat_ws("\n", "unit_slug", "topic_slug")).join(support, ["course_id", "owned"], "left").drop("owned")
    more = F.filter(F.coalesce("__heads", F.array().cast("array<string>")), lambda h: slugify(h) != slugify("topic_label"))
    return out.withColumn("aliases", F.array_sort(F.array_distinct(F.concat("aliases", more)))).drop("__heads")


def tagged_entries(entries: DataFrame, topics: DataFrame, heads: DataFrame, sources: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Entries with their automatic tags from the catalogue of their course, by its own vocabulary.
    [job taxonomy_and_tags: A3, A4, U4, P14, A5, A6]

    entries: course_id, entry_id, title, head_text, category; topics: `content_taxonomy`; heads: course_id, text; sources:
    course_id, source, text (plan, map, glossary, headings); overrides: course_id, kind, word.
    """
    candidates = topics.select("course_id", F.col("topic_label").alias("text"))
    vocabulary = profiles.course_vocabulary(entries.select("course_id").union(topics.select("course_id")), sources, heads.select("course_id", F.col("text").alias("line")), overrides)
    return taxonomy.auto_tags(entries, profiles.course_tags(candidates, heads, vocabulary))


def assessment_context(plans: DataFrame, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Assessments of every course's plan with their date in its schedule and the units that they come too early for:
    course_id, ord, label, label_slug, declared_unit_numbers, assessment_date, conflicts array<string>. [F23, J13, J14, A8]

    plans: course_id, plan; rows, blocks: `timeline_index`.
    """
    found = timeline.assessments(plans)
    key = ["course_id", "ord"]
    dated = timeline.assessment_rows(found.select("course_id", "ord", "label", "label_slug", "declared_unit_numbers"), rows)
    number = F.nullif(F.regexp_extract("unit_slug", r"^unidade(?:-de-aprendizagem)?-(\d+)\b", 1), F.lit("")).try_cast("int")
    titles = taxonomy.plan_units(plans).groupBy("course_id", "unit_slug").agg(F.min_by("unit_title", "unit_ord").alias("unit_title"))
    spans = timeline.unit_periods(blocks.filter("unit_slug != ''")).withColumn("unit_number", number).filter("unit_number is not null").join(titles, ["course_id", "unit_slug"], "left")
    early = timeline.assessment_conflicts(dated, spans.select("course_id", "unit_number", "start"))
    said = F.concat(F.col("label"), F.lit(" em "), F.col("assessment_date").cast("string"), F.lit(" antecede "), F.coalesce("unit_title", "unit_slug"), F.lit(" (previsto para "), timeline.period_range(), F.lit(")."))
    lines = early.join(spans.drop("start"), ["course_id", "unit_number"]).join(found.select(*key, "label", "label_slug"), ["course_id", "label_slug"]).groupBy(*key).agg(F.transform(F.array_sort(F.collect_set(F.struct("unit_number", said.alias("line")))), lambda x: x["line"]).alias("conflicts"))
    out = found.drop("description").join(dated.select(*key, "assessment_date"), key, "left").join(lines, key, "left")
    return out.withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<string>")))


#: A course without units in its plan and its schedule (fixed text).
NO_UNITS = "### Unidade 1 — [Nome da unidade]\n- [ ] Tópico 1.1\n- [ ] Tópico 1.2\n\n### Unidade 2 — [Nome da unidade]\n- [ ] Tópico 2.1 -> requer: Tópico 1.2\n- [ ] Tópico 2.2"


def course_map(plans: DataFrame, blocks: DataFrame, assessed: DataFrame | None = None, most: int = 14_000) -> DataFrame:
    """The map of every course as Markdown: units with their topics, periods of units, conflicts of assessments; clamped.
    [job course_map: F21, A8, J14, T4]

    plans: course_id, plan; blocks: `timeline_index`; assessed: `assessment_context`. A course without units in its plan
    lists the units of its blocks with the labels of six topics each; one without either has a form to fill in.
    """
    found = taxonomy.plan_units(plans)
    item = F.struct("unit_ord", F.coalesce("topic_ord", F.lit(0)).alias("topic_ord"), F.when(F.col("topic_text").isNull(), "- [ ] [tópicos a preencher]").otherwise(F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0))), F.lit("- [ ] "), "topic_text")).alias("line"))
    lines = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"])
    of_plan = found.groupBy("course_id", "unit_ord", "unit_slug", "unit_title").agg(F.array_join(lines(item), "\n").alias("body"))
    labelled = blocks.filter("unit_slug != ''")
    label = F.when(F.col("primary_topic_label") != "", F.struct("block_ord", "primary_topic_label"))
    of_blocks = labelled.join(of_plan.select("course_id").distinct(), "course_id", "left_anti").groupBy("course_id", "unit_slug").agg(F.min("block_ord").alias("unit_ord"), F.transform(F.array_sort(F.collect_list(label)), lambda x: x["primary_topic_label"]).alias("t"))
    of_blocks = of_blocks.select("course_id", "unit_ord", "unit_slug", F.initcap(F.replace("unit_slug", F.lit("-"), F.lit(" "))).alias("unit_title"), F.coalesce(F.nullif(F.array_join(F.transform(F.slice(F.array_distinct("t"), 1, 6), lambda x: F.concat(F.lit("- [ ] "), x)), "\n"), F.lit("")), F.lit("- [ ] [tópicos a preencher]")).alias("body"))
    units = of_plan.unionByName(of_blocks)
    chapter = F.struct("unit_ord", "unit_slug", F.concat(F.lit("### "), "unit_title", F.lit("\n"), "body").alias("line"))
    structure = units.groupBy("course_id").agg(F.array_join(lines(chapter), "\n\n").alias("__units"))
    spans = timeline.unit_periods(labelled).select("course_id", "unit_slug", timeline.period_range().alias("period"))
    row = F.struct("unit_ord", F.concat(F.lit("| "), "unit_title", F.lit(" | "), "period", F.lit(" | `"), "unit_slug", F.lit("` |")).alias("line"))
    held = F.coalesce("period", F.lit("")) != ""
    table = of_plan.join(spans, ["course_id", "unit_slug"], "left").groupBy("course_id").agg(F.transform(F.array_sort(F.collect_list(F.when(held, row))), lambda x: x["line"]).alias("r"), F.count("*").alias("n")).filter(F.size("r") > 0)
    omitted = F.when(F.size("r") < F.col("n"), "\n\n> Unidades sem período explícito foram omitidas para manter o mapa enxuto.").otherwise("")
    table = table.select("course_id", F.concat(F.lit("\n\n## Timeline — Cronograma x Unidades\n\n| Unidade | Período | Slug |\n|---|---|---|\n"), F.array_join("r", "\n"), omitted).alias("__periods"))
    every = plans.select("course_id").union(blocks.select("course_id")).distinct()
    out = every.join(structure, "course_id", "left").join(table, "course_id", "left")
    if assessed is None:
        out = out.withColumn("__conflicts", F.lit(None).cast("string"))
    else:
        scope = F.when(F.size("declared_unit_numbers") > 0, F.array_join(F.transform("declared_unit_numbers", lambda n: F.concat(F.lit("U"), n)), ", ")).otherwise("escopo não explicitado")
        said = F.struct("ord", F.concat(F.lit("- "), "label", F.lit(" ("), F.coalesce(F.col("assessment_date").cast("string"), F.lit("data não localizada")), F.lit(") -> "), scope, F.lit(": "), F.array_join("conflicts", " ")).alias("line"))
        of_course = assessed.filter(F.size("conflicts") > 0).groupBy("course_id").agg(F.concat(F.lit("\n\n## Conflitos de avaliação x cronograma\n\n**Resumo das inconsistências detectadas**\n\n"), F.array_join(lines(said), "\n")).alias("__conflicts"))
        out = out.join(of_course, "course_id", "left")
    text = F.concat(F.lit("## Estrutura do curso\n\n"), F.coalesce("__units", F.lit(NO_UNITS)), _blank(F.col("__periods")), _blank(F.col("__conflicts")), F.lit("\n"))
    return out.select("course_id", clamp(text, most).alias("markdown"))


def glossary(topics: DataFrame, docs: DataFrame, rules: list[tuple[str, str, str, str]], most: int = 14_000, window: int = 4_000) -> DataFrame:
    """The glossary of every course as Markdown: one entry per topic of its plan, clamped. [job glossary: J17, F25, F26, T4]

    topics: course_id, unit_ord, topic_ord, topic_label, unit_title; docs: course_id, doc_ord, markdown, of which evidence is
    looked for in the first `window` characters.
    """
    terms = topics.select("course_id", F.col("topic_label").alias("term")).distinct()
    hay = docs.select("course_id", "doc_ord", match_text(F.substring("markdown", 1, window)).alias("haystack"))
    found = profiles.glossary_evidence(terms, hay).join(docs, ["course_id", "doc_ord"]).select("course_id", F.col("term").alias("term_key"), "term", F.substring("markdown", 1, window).alias("text"))
    evidence = taxonomy.best_sentence(found, ["course_id", "term_key"]).select("course_id", F.col("term_key").alias("term"), "sentence")
    seeded = taxonomy.seeded_fields(terms, rules, evidence)
    full = topics.select("course_id", "unit_ord", "topic_ord", "unit_title", F.col("topic_label").alias("term")).join(seeded, ["course_id", "term"])
    entry = F.concat(F.lit("## "), "term", *(x for name, c in (("Definição", "definition"), ("Sinônimos aceitos", "synonyms"), ("Não confundir com", "not_confuse"), ("Aparece em", "unit_title")) for x in (F.lit(f"\n**{name}:** "), _blank(F.col(c)))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", "topic_ord", "term", entry.alias("line")))), lambda x: x["line"])
    return full.groupBy("course_id").agg(clamp(F.array_join(lines, "\n\n"), most).alias("markdown"))
