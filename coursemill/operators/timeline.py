"""Course schedules: rows, blocks, sessions, units of blocks, periods, assessments.

A schedule is rows keyed by course_id and row_index. Where rows must be taken one after the other (blocks, starts of
units), a course's schedule is one short array that is folded in the JVM. Everything else is joins, windows and
aggregates. IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from coursemill.functions import vocab
from coursemill.functions.text import card_evidence, collapse_ws, kind_marker, match_text, once, parse_date, session_signals, slugify, strip, text_lines, timed_sessions, tokens
from coursemill.operators import scoring


def read_schedule(courses: DataFrame, text: str = "schedule") -> DataFrame:
    """Rows of the first Markdown table of each course: course_id, row_index, cells map<header, value>. [S7]

    Headers are lower-cased; short rows are padded, separator rows skipped.
    """
    lines = courses.select("course_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line")).filter(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select("course_id", "pos", cells.alias("cells")).filter(~F.forall("cells", lambda c: c.rlike("^:?-*:?$")))
    head = rows.groupBy("course_id").agg(F.min_by("cells", "pos").alias("names"), F.min("pos").alias("first"))
    body = rows.join(head, "course_id").filter("pos > first")
    names = F.transform("names", F.lower)
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.size("names"))), F.lit(1), F.size("names"))
    w = W.partitionBy("course_id").orderBy("pos")
    return body.select("course_id", (F.row_number().over(w) - 1).alias("row_index"), F.map_from_arrays(names, padded).alias("cells"))


CONTENT_WORDS, DATE_WORDS = ["conteudo", "descricao", "assunto", "topico", "tema", "atividade"], ["data", "dia", "semana", "periodo"]


def schedule_keys(rows: DataFrame) -> DataFrame:
    """Per course the content and date columns by their headers; else the longest on average and the first. [F8]"""
    cells = rows.select("course_id", F.posexplode("cells").alias("ord", "name", "value"))
    per = cells.groupBy("course_id", "name").agg(F.min("ord").alias("ord"), F.avg(F.length("value")).alias("size"))
    norm = match_text("name", "c")
    is_ = lambda words: norm.rlike("|".join(words))
    marked = per.withColumns({"c": is_(CONTENT_WORDS), "d": is_(DATE_WORDS)})
    agg = marked.groupBy("course_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("c"), F.struct("ord", "name")))), lambda x: x["name"]).alias("content"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("d"), F.struct("ord", "name")))), lambda x: x["name"]).alias("dates"),
        F.max_by("name", F.struct("size", -F.col("ord"))).alias("longest"),
        F.min_by("name", "ord").alias("first"),
    )
    return agg.select("course_id", F.when(F.size("content") > 0, F.col("content")).otherwise(F.array("longest")).alias("content_keys"), F.when(F.size("dates") > 0, F.col("dates")).otherwise(F.array("first")).alias("date_keys"))


def candidate_rows(rows: DataFrame) -> DataFrame:
    """Schedule rows with content, date_text, date_dt, kind and ignored. [F7, F8]"""
    df = rows.join(schedule_keys(rows), "course_id")
    values = lambda keys: F.filter(F.transform(keys, lambda k: F.coalesce(F.element_at("cells", k), F.lit(""))), lambda x: x != "")
    marked = kind_marker(F.array_join(values("content_keys"), " "))
    return df.select("course_id", "row_index", marked.alias("m"), F.array_join(values("date_keys"), " / ").alias("date_text")).select(
        "course_id", "row_index", "m.content", match_text("m.content").alias("content_norm"), "date_text", parse_date("date_text").alias("date_dt"), "m.kind", "m.ignored")


def specific_tokens(c: Column | str) -> Column:
    """Words of a match text that tell a topic, in order. [P15]"""
    return F.filter(tokens(c), lambda x: ~x.isin(vocab.SCHEDULE_GENERIC))


def row_class(norm: Column) -> Column:
    """struct(administrative, review, continuation, anchor_only) of a schedule row's match text. [P15]"""
    holds = lambda words: norm.rlike("|".join(words))
    return F.struct(
        holds(vocab.ADMIN_PHRASES).alias("administrative"),
        (norm.isin("p1", "p2", "p3", "pf") | holds(vocab.REVIEW_WORDS)).alias("review"),
        holds(vocab.CONTINUATION_WORDS).alias("continuation"),
        (norm.contains("unidade") & (F.size(specific_tokens(norm)) <= 2)).alias("anchor_only"),
    )


def core_text(content: Column) -> Column:
    """What stands before a colon or a spaced dash if it has two specific words, else all; as match text. [W5]"""
    raw = collapse_ws(content)
    head = lambda pattern: match_text(F.get(F.split(raw, pattern, 2), F.lit(0)))
    options = [F.when(raw.rlike(p) & (F.size(specific_tokens(head(p))) >= 2), head(p)) for p in (r"\s*:\s*", "\\s+[\u2014\u2013-]\\s+")]
    return F.coalesce(*options, match_text(raw))


def segment_blocks(rows: DataFrame) -> DataFrame:
    """Rows with content and their block_no: a row joins the block before it if it goes on with its theme. [W5]

    All tests on single rows are columns; the fold over a course's rows only keeps the words of the block so far.
    """
    norm = F.col("content_norm")
    cls = row_class(norm)
    core = core_text(F.col("content"))
    facts = rows.filter(F.trim(F.coalesce("content", F.lit(""))) != "").withColumns({"__c": cls, "__core": core, "__words": specific_tokens(norm)}).withColumn("__core_words", specific_tokens("__core"))
    facts = facts.select(*rows.columns, "__c.review", "__c.continuation", "__c.anchor_only", "__core", "__words", "__core_words")
    row = F.struct("row_index", F.struct(*rows.columns).alias("row"), "review", "continuation", "anchor_only", F.col("__core").alias("core"), F.array_distinct("__words").alias("words"), F.array_distinct("__core_words").alias("core_words"))
    course = facts.groupBy("course_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.expr("named_struct('no', 0, 'words', cast(array() as array<string>), 'anchors', true, 'core', '', 'core_words', cast(array() as array<string>), 'out', cast(array() as array<int>))")

    def step(acc: Column, r: Column) -> Column:
        a, b = acc["core"], r["core"]
        shorter = F.when(F.length(b) <= F.length(a), F.size(r["core_words"])).otherwise(F.size(acc["core_words"]))
        inside = (a != "") & (b != "") & ((a == b) | ((a.contains(b) | b.contains(a)) & (shorter >= 2)))
        shared = F.size(F.array_intersect(r["core_words"], acc["words"])) >= 2
        joins = F.when((acc["no"] == 0) | r["review"], False).when(r["continuation"], (F.size(acc["words"]) > 0) & ~acc["anchors"]).when(F.size(r["core_words"]) == 0, True).otherwise(inside | shared)
        no = acc["no"] + F.when(joins, 0).otherwise(1)
        words = F.when(joins, F.array_union(acc["words"], r["words"])).otherwise(r["words"])
        return F.struct(no.alias("no"), words.alias("words"), (r["anchor_only"] & (acc["anchors"] | ~joins)).alias("anchors"), b.alias("core"), r["core_words"].alias("core_words"), F.concat(acc["out"], F.array(no)).alias("out"))

    numbered = course.select("rows", F.aggregate("rows", start, step, lambda acc: acc["out"]).alias("numbers"))
    pairs = numbered.select(F.explode(F.zip_with("rows", "numbers", lambda r, n: F.struct(r["row"].alias("row"), n.alias("block_no")))).alias("x"))
    return pairs.select("x.row.*", "x.block_no")


def block_attributes(rows: DataFrame) -> DataFrame:
    """One row per block: ids, period, topics and aliases (at most 6 each), topic_text (its own words), full_text, source rows, and
    what its rows are as a whole: administrative, taught (some row teaches), soft (goes on with what came before). [W6]"""
    first = lambda c: F.min_by(c, "row_index")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("row_index", c))), lambda x: x[c])
    df = rows.withColumns({"core": specific_tokens(core_text(F.col("content"))), "__c": row_class(F.col("content_norm")), "__cards": card_evidence("content")})
    df = df.withColumn("__sessions", timed_sessions(F.concat_ws(": ", F.nullif(collapse_ws("date_text"), F.lit("")), F.nullif(collapse_ws("content"), F.lit("")))))
    quiet = F.col("__c.administrative") | F.col("__c.review") | (F.col("__c.continuation") & (F.size(specific_tokens("content_norm")) <= 1))
    goes_on = ~F.col("__c.review") & (F.col("__c.continuation") | F.col("content_norm").rlike("|".join(vocab.SOFT_WORDS)))
    out = df.groupBy("course_id", "block_no").agg(
        first("date_text").alias("start_text"), F.max_by("date_text", "row_index").alias("end_text"),
        first("date_dt").alias("period_start"), F.max_by("date_dt", "row_index").alias("period_end"),
        ordered("core").alias("cores"), ordered("content_norm").alias("norms"), F.sort_array(F.collect_list("row_index")).alias("source_rows"),
        F.bool_and(F.col("ignored") | F.col("__c.administrative")).alias("administrative"), (~F.bool_and(quiet)).alias("taught"), F.bool_and(goes_on).alias("soft"),
        F.bool_or(~F.col("ignored")).alias("scored"), F.flatten(ordered("__sessions")).alias("__sessions"), F.flatten(ordered("__cards")).alias("__cards"),
    )
    out = out.withColumn("block_id", F.format_string("bloco-%02d", "block_no")).withColumn("card_evidence", F.filter(F.array_distinct("__cards"), lambda c: c["normalized_title"] != ""))
    topics = F.slice(F.array_distinct(F.filter(F.transform("cores", lambda x: F.array_join(x, " ")), lambda x: x != "")), 1, 6)
    aliases = F.slice(F.array_distinct(F.filter(F.flatten("cores"), lambda x: F.length(x) >= 5)), 1, 6)
    words = F.array_distinct(F.flatten(F.transform("norms", specific_tokens)))
    label = F.when(F.col("start_text") == "", F.col("end_text")).when((F.col("end_text") == "") | (F.col("end_text") == F.col("start_text")), F.col("start_text")).otherwise(F.concat_ws(" a ", "start_text", "end_text"))
    return out.select("course_id", "block_id", F.col("block_no").alias("block_ord"), "period_start", "period_end", label.alias("period_label"), topics.alias("topics"), aliases.alias("aliases"), F.array_join(words, " ").alias("topic_text"), F.array_join("norms", " ").alias("full_text"), "source_rows", "administrative", "taught", "soft", "scored", "card_evidence", block_sessions(F.col("block_id"), F.col("__sessions"), F.col("card_evidence")).alias("sessions"))


def session_cards(session: Column, cards: Column) -> Column:
    """The cards whose whole title stands in a session's label or in one of its signals, or its one word of four letters, or
    two of its words. [J22] Signals are match texts or dates; no title reaches over the end of one into the next."""

    def chosen(x: Column) -> Column:
        def fits(card: Column) -> Column:
            named = tokens(card["normalized_title"])
            shared = F.size(F.array_intersect(named, x["held"]))
            return (F.size(named) > 0) & (x["text"].contains(card["normalized_title"]) | (shared >= 2) | ((F.size(named) == 1) & (shared == 1)))

        return F.filter(cards, fits)

    text = F.replace(F.concat_ws("\n", session["label"], session["signals"]), F.lit("-"), F.lit(" "))
    said = lambda t: F.struct(t.alias("text"), F.array_distinct(F.filter(F.split(t, "[ \n]"), lambda w: F.length(w) >= 4)).alias("held"))
    return once(once(text, said), chosen)


def block_sessions(block_id: Column, found: Column, cards: Column) -> Column:
    """A block's sessions as an array: session_id, date, kind, label, signals, card_evidence. [W7, J22]

    found: the sessions of its rows in order, of which equal ones count once. Asynchronous sessions count up; others take
    their date, or count up among their kind. All inside the block's row.
    """
    distinct = F.array_distinct(found)
    nth = lambda kind, i: F.format_string("%02d", F.size(F.filter(F.slice(distinct, F.lit(1), i + 1), kind)))
    is_async = lambda x: x["kind"] == "async"

    def named(x: Column, i: Column) -> Column:
        dated = F.coalesce(x["date"].cast("string"), nth(lambda y: ~is_async(y), i))
        name = F.concat(block_id, F.lit("-sessao-"), F.when(is_async(x), F.concat(F.lit("async-"), nth(is_async, i))).otherwise(dated))
        return F.struct(name.alias("session_id"), x["date"].alias("date"), x["kind"].alias("kind"), x["label"].alias("label"), x["signals"].alias("signals"), session_cards(x, cards).alias("card_evidence"))

    return F.transform(distinct, named)


def number_sessions(sessions: DataFrame) -> DataFrame:
    """Distinct sessions of each block with ids: async ones count up, others take their date or count up. [W7]"""
    each = sessions.groupBy("course_id", "block_id", "kind", "date", "label").agg(F.min("ord").alias("ord"))
    n = F.row_number().over(W.partitionBy("course_id", "block_id", "kind").orderBy("ord"))
    sid = F.when(F.col("kind") == "async", F.concat_ws("-", "block_id", F.lit("async"), n.cast("string"))).otherwise(F.concat_ws("-", "block_id", "kind", F.coalesce(F.col("date").cast("string"), n.cast("string"))))
    return each.withColumn("session_id", sid)


def token_weights(rows: DataFrame, key: list[str], unit: str, token_array: str) -> DataFrame:
    """Tokens that tell units apart: in one unit, or in two at most and six letters long. [A2]"""
    each = rows.select(*key, unit, F.explode(F.array_distinct(token_array)).alias("token")).distinct()
    df = each.groupBy(*key, "token").agg(F.count("*").alias("df"))
    return each.join(df, [*key, "token"]).filter("df = 1 or (df <= 2 and length(token) >= 6)")


def row_unit_scores(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Schedule texts with the units of their course and `score`; administrative texts score 0. [J6]

    rows: course_id, row_index, content_norm; units: `scoring.unit_index`. A text that names a unit by number scores for
    that unit alone.
    """
    said = F.nullif(F.regexp_extract("content_norm", r"\bunidade(?: de aprendizagem)?\s*0*(\d+)\b", 1), F.lit("")).cast("int")
    df = scoring.with_course(rows.withColumn("__said", said), units, scoring.unit_arrays(units), "content_norm")
    df = df.withColumns({"__held": F.array_intersect(tokens("content_norm"), "__keys"), "__admin": row_class(F.col("content_norm"))["administrative"]})
    text, held, said = F.col("content_norm"), F.col("__held"), F.col("__said")

    def score(u: Column) -> Column:
        title, number = u["title"]["p"], F.nullif(F.regexp_extract(u["unit_slug"], r"^unidade(?:-de-aprendizagem)?-(\d+)\b", 1), F.lit("")).cast("int")
        named = (title != "") & text.contains(title)
        total = F.when(said.isNotNull(), 6.0).otherwise(0.0) + F.when(named, 2.6).otherwise(0.55 * scoring.phrase_points(text, held, u, u["title"]))
        total = total + F.aggregate(u["phrases"], F.lit(0.0), lambda a, p: a + scoring.phrase_points(text, held, u, p))
        exact = named.cast("int") + F.size(F.filter(u["phrases"], lambda p: text.contains(p["p"])))
        words = F.array_intersect(u["words"], held)
        neutral = lambda t: t.isin(vocab.UNIT_NEUTRAL)
        total = total + F.aggregate(words, F.lit(0.0), lambda a, t: a + 0.95 * scoring.weight_of(u, t) * F.when(neutral(t), 0.2).otherwise(1.0))
        matched, rare = F.filter(words, lambda t: ~neutral(t)), F.array_intersect(u["distinctive"], held)
        total = total + F.aggregate(rare, F.lit(0.0), lambda a, t: a + F.when(F.array_contains(matched, t), 0.25).otherwise(0.8))
        of_title, of_topics = F.array_intersect(u["title_anchors"], held), F.array_intersect(u["topic_anchors"], held)
        both = (u["n_extra"] > 0) & (F.size(of_title) > 0) & (F.size(of_topics) > 0)
        total = total + F.when(both, 0.95 + 0.2 * F.size(F.array_union(of_title, of_topics)) + 0.12 * F.size(F.array_intersect(of_title, of_topics))).otherwise(0.0)
        n = F.size(F.array_union(matched, rare))
        none = said.isNull() & (exact == 0) & (n == 0) & ~both
        lone = said.isNull() & (exact == 0) & (n == 1)
        out = F.when(F.col("__admin") | none | (said.isNotNull() & ~F.equal_null(said, number)), 0.0).otherwise(total * F.when(lone, 0.35).otherwise(1.0))
        return F.struct(u["unit_ord"].alias("unit_ord"), u["unit_slug"].alias("unit_slug"), out.alias("score"))

    return df.select("course_id", "row_index", F.inline(F.transform("__units", score)))


#: Least score and confidence of a topic by the number of its label's words: one at most, two, more (fixed values).
WEAK_TOPIC = "case when label_tokens <= 1 then score < 1.85 or confidence < 0.8 when label_tokens = 2 then score < 1.75 or confidence < 0.9 else score < 1.35 or confidence < 0.72 end"


def block_topic_candidates(scored: DataFrame, most: int = 5, gap: float = 0.7) -> DataFrame:
    """Per block the best topics with score and share of the best, and the primary topic with its doubts; a weak topic is
    none. [W2]

    scored: course_id, block_id, topic_ord, topic_slug, unit_slug, topic_label, score. A block's topics are those of its
    course that have a score.
    """
    item = F.struct((-F.col("score")).alias("neg"), "topic_ord", "topic_slug", "unit_slug", F.size(tokens(match_text("topic_label"))).alias("label_tokens"), "topic_label")
    df = scored.filter("score > 0").groupBy("course_id", "block_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    one, two = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    df = df.withColumns({"score": -one["neg"], "second": F.coalesce(-two["neg"], F.lit(0.0)), "label_tokens": one["label_tokens"], "primary": one["topic_slug"], "primary_unit": one["unit_slug"], "primary_label": one["topic_label"]})
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") - F.col("second") + 0.2 * F.col("score")))
    lone = F.size("c") == 1
    df = df.withColumn("confidence", F.when(lone, F.greatest(conf, F.lit(0.72))).otherwise(conf)).withColumn("weak", F.expr(WEAK_TOPIC))
    ambiguous = F.col("weak") | (~lone & (F.col("score") - F.col("second") < gap))
    share = lambda x: F.round(F.least(F.lit(1.0), x["neg"] / -F.col("score")), 3)
    listed = F.transform(F.slice("c", 1, most), lambda x: F.struct(x["topic_slug"].alias("topic_slug"), F.round(-x["neg"], 3).alias("score"), share(x).alias("confidence")))
    return df.select("course_id", "block_id", listed.alias("topic_candidates"), F.when(F.col("weak"), "").otherwise(F.col("primary")).alias("primary_topic_slug"), F.when(F.col("weak"), "").otherwise(F.col("primary_unit")).alias("primary_topic_unit"), F.when(F.col("weak"), "").otherwise(F.col("primary_label")).alias("primary_topic_label"),
        ambiguous.alias("topic_ambiguous"), F.when(ambiguous, F.least("confidence", F.lit(0.45))).otherwise(F.col("confidence")).alias("primary_topic_confidence"))


def block_unit_scores(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Blocks with the units of their course and `score`: of all their rows, and 0.7 of the topic text's where that is
    another text. [W3] blocks: course_id, block_id, full_text, topic_text (match texts)."""
    texts = F.array(F.struct(F.col("full_text").alias("content_norm"), F.lit(1.0).alias("w")), F.struct(F.when(F.col("topic_text") != F.col("full_text"), F.col("topic_text")).otherwise("").alias("content_norm"), F.lit(0.7).alias("w")))
    rows = blocks.select("course_id", "block_id", F.inline(texts)).filter("content_norm != ''").withColumn("row_index", F.struct("block_id", "w"))
    scored = row_unit_scores(rows.select("course_id", "row_index", "content_norm"), units)
    return scored.groupBy("course_id", F.col("row_index.block_id").alias("block_id"), "unit_ord", "unit_slug").agg(F.sum(F.col("score") * F.col("row_index.w")).alias("score"))


def block_units(blocks: DataFrame, scored: DataFrame) -> DataFrame:
    """The unit of each block: from a sure topic, else the best unit with score 1 and a lead of 0.35. [W3]

    blocks: course_id, block_id, taught, topic_unit, topic_ambiguous, topic_confidence; scored: course_id, block_id,
    unit_ord, unit_slug, score. A block that does not teach has none of the latter.
    """
    item = F.struct((-F.col("score")).alias("neg"), "unit_ord", "unit_slug")
    best = scored.filter("score > 0").groupBy("course_id", "block_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    one, two = -F.get("c", F.lit(0))["neg"], F.coalesce(-F.get("c", F.lit(1))["neg"], F.lit(0.0))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), one - two + 0.18 * one))
    best = best.filter((one >= 1) & (one - two >= 0.35)).select("course_id", "block_id", F.get("c", F.lit(0))["unit_slug"].alias("__unit"), conf.alias("__conf"))
    sure = F.coalesce((F.col("topic_unit") != "") & ~F.col("topic_ambiguous") & (F.col("topic_confidence") >= 0.65), F.lit(False))
    out = blocks.join(best, ["course_id", "block_id"], "left")
    return out.withColumns({
        "unit_slug": F.when(sure, F.col("topic_unit")).when(~F.col("taught"), "").otherwise(F.coalesce("__unit", F.lit(""))),
        "unit_confidence": F.when(sure, F.col("topic_confidence")).when(~F.col("taught"), 0.0).otherwise(F.coalesce("__conf", F.lit(0.0))),
    }).drop("__unit", "__conf")


def inherit_unit(blocks: DataFrame, key: str = "course_id", order: str = "block_ord") -> DataFrame:
    """Soft blocks without a unit take it from the block before (filled ones too), else from the one behind. [W4]

    A run of such blocks follows one block: if that has a unit, the whole run takes it; if not, only the run's last
    block takes the next one's unit. blocks: key, order, unit_slug, unit_confidence, soft.
    """
    w = W.partitionBy(key).orderBy(order)
    empty = (F.col("unit_slug") == "") & F.col("soft")
    df = blocks.withColumn("__open", empty)
    # the latest block that is not open, with its unit; a run's last block is the one before a block that is not open
    known = F.last(F.when(~F.col("__open"), F.col("unit_slug")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumns({"__before": F.coalesce(known, F.lit("")), "__next": F.coalesce(F.lead("unit_slug").over(w), F.lit("")), "__next_open": F.coalesce(F.lead("__open").over(w), F.lit(False))})
    taken = F.when(F.col("__before") != "", F.col("__before")).when(~F.col("__next_open"), F.col("__next")).otherwise("")
    unit = F.when(F.col("__open"), taken).otherwise(F.col("unit_slug"))
    conf = F.when(F.col("__open") & (taken != ""), F.greatest("unit_confidence", F.lit(0.51))).otherwise(F.col("unit_confidence"))
    return df.withColumns({"unit_confidence": conf, "unit_slug": unit}).select(*blocks.columns)


def unit_periods(blocks: DataFrame) -> DataFrame:
    """Per course and unit: first and last dates, labels at the ends, number of blocks. [A8]"""
    named = blocks.filter("unit_slug != '' and period_start is not null")
    return named.groupBy("course_id", "unit_slug").agg(
        F.min("period_start").alias("start"), F.max(F.coalesce("period_end", "period_start")).alias("end"), F.min_by("period_label", F.struct("period_start", "block_ord")).alias("start_label"), F.max_by("period_label", F.struct("period_start", "block_ord")).alias("end_label"), F.count("*").alias("n_blocks"))


def period_range() -> Column:
    """The period of a unit (`unit_periods`) as `start a end`: the first date of its first label and the last of its last."""
    return F.when(F.col("start_label") == F.col("end_label"), F.col("start_label")).otherwise(F.concat_ws(" a ", F.substring_index("start_label", " a ", 1), F.substring_index("end_label", " a ", -1)))


#: Characters behind which a unit's title has its description (fixed values).
TITLE_CUT = "[â€”“:\\-]"


def unit_descriptors(units: DataFrame) -> DataFrame:
    """What tells a unit in a schedule: number, description, words of the title, topic phrases, distinctive words. [W8]

    units: course_id, unit_ord, unit_slug, unit_title, topics (array of texts).
    """
    described = F.regexp_extract("unit_title", TITLE_CUT + r"\s*(.+)", 1)
    words = lambda c: F.filter(tokens(c), lambda t: ~t.rlike(r"^\d+$"))
    df = units.withColumns({"number": F.regexp_extract("unit_title", r"(\d+)", 1), "about": match_text(F.when(described != "", described).otherwise(F.col("unit_title")))})
    df = df.withColumn("phrases", F.filter(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: match_text(t)), lambda t: t != ""))
    df = df.withColumns({"title_words": F.array_distinct(words("about")), "all_words": F.array_distinct(F.concat(words("about"), F.flatten(F.transform("phrases", words))))})
    telling = token_weights(df, ["course_id"], "unit_ord", "all_words").groupBy("course_id", "unit_ord").agg(F.collect_list("token").alias("distinctive"))
    df = df.join(telling, ["course_id", "unit_ord"], "left").withColumn("distinctive", F.coalesce("distinctive", F.array().cast("array<string>")))
    return df.select("course_id", "unit_ord", "unit_slug", "unit_title", "number", F.regexp_replace("number", "^0+(?=.)", "").alias("number_int"), "about", "title_words", "phrases", "distinctive")


def unit_anchor_scores(rows: DataFrame, descriptors: DataFrame, least: int = 4) -> DataFrame:
    """Schedule rows that start or go on with a unit: course_id, unit_ord, unit_slug, unit_title, row_index, score. [W8]

    A unit's number gives 10, its description 8, the words of its title 4, a topic 8, distinctive words 3 each up to 6; rows
    with `least` are kept. rows: course_id, row_index, content_norm; descriptors: `unit_descriptors`. A course's units are
    one array that meets each of its rows once.
    """
    course = descriptors.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct(*descriptors.columns[1:]))).alias("__units"))
    df = scoring.with_course(rows.select("course_id", "row_index", "content_norm").filter("content_norm != ''"), descriptors, course, "content_norm")
    said = lambda names: F.regexp_extract_all("content_norm", F.lit(rf"\b(?:{names})\s*(\d+)\b"), F.lit(1))
    df = df.withColumns({"__whole": said("unidade"), "__any": said("unidade|unid|un"), "__words": F.array_distinct(F.split("content_norm", " "))})
    text = F.col("content_norm")

    def score(u: Column) -> Column:
        numbered = (u["number"] != "") & (F.array_contains("__whole", u["number"]) | F.array_contains("__any", u["number_int"]))
        n_title, held = F.size(u["title_words"]), F.size(F.array_intersect(u["title_words"], F.col("__words")))
        rare = F.size(F.array_intersect(u["distinctive"], F.col("__words")))
        points = F.when(numbered, 10).otherwise(0) + F.when((u["about"] != "") & text.contains(u["about"]), 8).otherwise(0)
        points = points + F.when(held >= F.greatest(F.lit(1), F.least(F.lit(2), n_title)), 4).otherwise(0)
        points = points + F.when(F.exists(u["phrases"], lambda p: text.contains(p)), 8).otherwise(0) + F.least(F.lit(6), 3 * rare)
        return F.struct(u["unit_ord"].alias("unit_ord"), u["unit_slug"].alias("unit_slug"), u["unit_title"].alias("unit_title"), points.alias("score"))

    scored = df.select("course_id", "row_index", F.inline(F.transform("__units", score)))
    return scored.filter(F.col("score") >= least)


def unit_start_anchors(anchors: DataFrame) -> DataFrame:
    """Start and end rows of the units of each course: the first anchor row behind the start of the unit before; a unit
    without such a row takes its first anchor. A unit ends before the next one starts, the last at its last anchor, as does
    one that would end before its start. [W8]

    anchors: course_id, unit_ord, unit_slug, row_index. A course's units are one short array, folded in order.
    """
    units = anchors.groupBy("course_id", "unit_ord", "unit_slug").agg(F.sort_array(F.collect_list(F.col("row_index").cast("long"))).alias("rows"))
    course = units.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "unit_slug", "rows"))).alias("units"))
    kind = dict(anchors.dtypes)["unit_ord"]
    start = F.expr(f"named_struct('before', -1L, 'out', cast(array() as array<struct<unit_ord:{kind},unit_slug:string,start_row:bigint,last_row:bigint>>))")

    def step(acc: Column, unit: Column) -> Column:
        row = F.coalesce(F.get(F.filter(unit["rows"], lambda r: r > acc["before"]), F.lit(0)), unit["rows"][0])
        mine = F.struct(unit["unit_ord"].alias("unit_ord"), unit["unit_slug"].alias("unit_slug"), row.alias("start_row"), F.element_at(unit["rows"], -1).alias("last_row"))
        return F.struct(row.alias("before"), F.concat(acc["out"], F.array(mine)).alias("out"))

    starts = course.select("course_id", F.aggregate("units", start, step, lambda acc: acc["out"]).alias("u"))
    following = lambda u, i: F.get(F.col("u"), i + 1)["start_row"] - 1
    ends = F.transform("u", lambda u, i: F.struct(u["unit_ord"].alias("unit_ord"), u["unit_slug"].alias("unit_slug"), u["start_row"].alias("start_row"), F.when(following(u, i) >= u["start_row"], following(u, i)).otherwise(u["last_row"]).alias("end_row")))
    return starts.select("course_id", F.inline(ends))


def unit_row_periods(starts: DataFrame, rows: DataFrame) -> DataFrame:
    """Period and dates of the units over their rows: course_id, unit_ord, unit_slug, start_row, end_row, period, dates. [W8]

    starts: `unit_start_anchors`; rows: course_id, row_index, date_text. A course's dates are one array, cut by rows.
    """
    dates = rows.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct(F.col("row_index").cast("long").alias("row_index"), F.trim("date_text").alias("t")))).alias("__dates"))
    df = starts.join(dates, "course_id", "left")
    mine = F.filter(F.col("__dates"), lambda d: d["row_index"].between(F.col("start_row"), F.col("end_row")) & (d["t"] != ""))
    df = df.withColumn("__d", F.array_distinct(F.transform(F.coalesce(mine, F.slice("__dates", 1, 0)), lambda d: d["t"])))
    first, last = F.get("__d", F.lit(0)), F.try_element_at("__d", F.lit(-1))
    return df.select("course_id", "unit_ord", "unit_slug", "start_row", "end_row", F.when(F.size("__d") > 1, F.concat_ws(" a ", first, last)).otherwise(F.coalesce(first, F.lit(""))).alias("period"), F.coalesce(F.array_join("__d", ", "), F.lit("")).alias("dates"))


#: Lines that start and end a plan's section on assessments, and an assessment's line (fixed patterns).
ASSESSMENT_START, ASSESSMENT_STOP = r"(?iu)^(?:AVALIA[ÇC][AÃ]O|AVALIACAO)\b", r"(?i)^(?:BIBLIOGRAFIA|METODOLOGIA|CRONOGRAMA|CONTEUDO PROGRAMATICO|CONTEUDO)\b"
ASSESSMENT_LINE = r"(?i)^(P\s*\d+|PROVA\s*\d+|PF|PROVA\s+FINAL|EXAME\s+FINAL)\s*(?:[-:]\s*|\s+)(.+)$"
#: What may stand before the numbers of the units that an assessment covers (fixed pattern).
ASSESSMENT_SCOPE = r"\b(?:unidade(?:s)?(?: de aprendizagem)?|conteudo(?:s)?|abrangendo|abrange|cobre|cobrindo|inclui|incluindo)\b(.+)"


def declared_units(norm: Column, label_slug: Column) -> Column:
    """Numbers from 1 to 20 behind a scope word; without one all numbers, the first that is the label's own left out. [F23]"""
    def numbers_of(x: Column) -> Column:
        scope = F.regexp_extract(x["norm"], ASSESSMENT_SCOPE, 1)
        found = F.transform(F.regexp_extract_all(F.when(scope != "", scope).otherwise(x["norm"]), F.lit(r"\b0*(\d+)\b"), F.lit(1)), lambda n: n.try_cast("int"))
        return F.struct(F.filter(found, lambda n: n.between(1, 20)).alias("numbers"), (scope == "").alias("free"), x["own"].alias("own"))

    def without(x: Column) -> Column:
        numbers, at = x["numbers"], F.array_position(x["numbers"], x["own"]).cast("int")
        return F.array_distinct(F.when(x["free"] & (at > 0), F.concat(F.slice(numbers, F.lit(1), at - 1), F.slice(numbers, at + 1, F.size(numbers)))).otherwise(numbers))

    own = F.nullif(F.regexp_extract(label_slug, r"^(?:p|prova)\s*(\d+)$", 1), F.lit("")).try_cast("int")
    return once(once(F.struct(norm.alias("norm"), own.alias("own")), numbers_of), without)


def assessments(plans: DataFrame, text: str = "plan") -> DataFrame:
    """Assessments of a plan, in order: ord, label, label_slug, description, declared_unit_numbers. [F23]

    Only lines between the heading `Avalia\u00e7\u00e3o` and the next stop heading are read; a line that names no assessment goes on
    with the one before it. Marks and items are running windows over a course's lines.
    """
    lines = plans.select("course_id", F.posexplode(text_lines(text)).alias("pos", "line"))
    bare = F.trim(F.replace(F.regexp_replace(strip("line"), r"^#+\s*", ""), F.lit("*"), F.lit("")))
    lines = lines.withColumn("line", strip(F.regexp_replace(strip(bare), r"^[-•*]\s*", ""))).filter("line != ''")
    course = W.partitionBy("course_id")
    lines = lines.withColumn("__from", F.min(F.when(F.col("line").rlike(ASSESSMENT_START), F.col("pos"))).over(course)).filter("pos > __from")
    lines = lines.withColumn("__to", F.min(F.when(F.col("line").rlike(ASSESSMENT_STOP), F.col("pos"))).over(course)).filter("__to is null or pos < __to")
    part = lambda i: F.regexp_extract("line", ASSESSMENT_LINE, i)
    lines = lines.withColumns({"__label": part(1), "ord": F.sum(F.col("line").rlike(ASSESSMENT_LINE).cast("int")).over(course.orderBy("pos"))}).filter("ord > 0")
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("__label") != "", part(2)).otherwise(F.col("line")).alias("t")))), lambda x: x["t"])
    items = lines.groupBy("course_id", "ord").agg(F.max("__label").alias("__label"), collapse_ws(F.array_join(said, " ")).alias("description"))
    def label(norm: Column) -> Column:
        number = F.nullif(F.regexp_extract(norm, r"^p\s*(\d+)$", 1), F.lit("")).cast("int")
        return F.when(number.isNotNull(), F.concat(F.lit("P"), number)).when(norm.isin("pf", "p final", "prova final", "exame final"), "PF").otherwise(F.upper(norm))

    items = items.withColumn("label", once(match_text("__label"), label)).withColumn("label_slug", match_text("label"))
    return items.select("course_id", "ord", "label", "label_slug", "description", declared_units(match_text("description"), F.col("label_slug")).alias("declared_unit_numbers"))


def assessment_aliases(label: Column) -> Column:
    """Ways to write an assessment's label, as match texts. [J13]"""
    def named(x: Column) -> Column:
        norm, number = x["norm"], x["number"]
        return F.when(norm == "pf", F.array(F.lit("pf"), F.lit("prova final"), F.lit("exame final"))).when(number.isNotNull(), F.array(F.format_string("p%d", number), F.format_string("p %d", number), F.format_string("prova %d", number), F.format_string("prova %02d", number), norm)).otherwise(F.array(norm))

    numbered = once(match_text(label), lambda norm: F.struct(norm.alias("norm"), F.regexp_extract(norm, r"^(?:p|prova)\s*(\d+)$", 1).try_cast("int").alias("number")))
    return F.array_distinct(F.filter(once(numbered, named), lambda x: x != ""))


def assessment_rows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The first schedule row that holds an assessment's label, in any of its forms, as whole words, and the date of the
    first such row that has one. [J13] Forms meet rows by their first word."""
    # both sides grow with the courses, and their sizes before the explosion tell nothing, so that neither is broadcast
    forms = found.withColumn("alias", F.explode_outer(assessment_aliases(F.col("label")))).withColumn("__word", F.substring_index("alias", " ", 1)).hint("merge")
    worded = rows.select("course_id", "row_index", "content_norm", "date_dt", F.explode(F.array_distinct(F.split("content_norm", " "))).alias("__word"))
    hit = forms.join(worded, ["course_id", "__word"])
    hit = hit.filter(F.concat(F.lit(" "), F.col("content_norm"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    return hit.groupBy(*found.columns).agg(F.min("row_index").alias("row_index"), F.min_by("date_dt", F.when(F.col("date_dt").isNotNull(), F.col("row_index"))).alias("assessment_date"))


def assessment_conflicts(dated: DataFrame, periods: DataFrame) -> DataFrame:
    """Assessments before the start of a unit that they declare. [J14] periods: course_id, unit_number, start."""
    # the outer form takes no filter on the size of the array, which would be worked out anew below the aggregates
    each = dated.select("course_id", "label_slug", "assessment_date", F.explode_outer("declared_unit_numbers").alias("unit_number"))
    return each.hint("merge").join(periods, ["course_id", "unit_number"]).filter("assessment_date < start").select("course_id", "label_slug", "unit_number", "assessment_date", "start")

