"""Taxonomy and tags: plans, glossaries, headings, cues, tools, tag catalogues and automatic tags.

Frames are keyed by course_id. IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from coursemill.functions import vocab
from coursemill.functions.text import collapse_ws, fold, headings, match_text, once, slugify, text_lines, tokens, unit_slug
from coursemill.operators import naming, scoring
from coursemill.sources.staging import staged

@dataclass(frozen=True)
class Profile:
    """Vocabularies of a course that rules about topics, tags and tools read."""

    known_tools: list[str] = field(default_factory=lambda: vocab.KNOWN_TOOLS)
    generic_slugs: list[str] = field(default_factory=lambda: vocab.GENERIC_SLUGS)
    structural_headings: list[str] = field(default_factory=lambda: vocab.STRUCTURAL_HEADINGS)
    bibliography_markers: list[str] = field(default_factory=lambda: vocab.BIBLIOGRAPHY_MARKERS)
    weak_starts: list[str] = field(default_factory=lambda: vocab.WEAK_STARTS)
    overlap_cues: list[str] = field(default_factory=lambda: vocab.OVERLAP_CUES)


DEFAULT = Profile()
#: Base candidates of all courses whose index is broadcast at most, about 5 KB each; beyond, headings are moved to them.
MOST_BASES = 10_000
#: Likely cues of all courses (rows) that are broadcast at most, and buckets of a course's other words.
MOST_LIKELY, BUCKETS = 100_000, 4_096
#: Points of a heading for a topic (fixed values).
SUPPORT = {"equal": 10.0, "inside": 8.0, "stems": 5.5, "each": 0.4, "cue": 3.4, "weak_cue": 2.8, "subtopic": 0.08, "least": 2.8}


def _holds(norm: Column, words: list[str], start: str = "", end: str = "") -> Column:
    """Whether a text holds one of the words; with `^` or `$` at its start or end."""
    return norm.rlike(f"{start}(?:{'|'.join(map(re.escape, words))}){end}")


def topic_rule(norm: Column, slug: Column, general: Column, structural: Column, weak_start: Column, tool: Column, book: Column) -> Column:
    """Whether a heading or term may be a topic, by what the course's vocabulary tells of it. [P14]"""
    weak = norm.isin(vocab.WEAK_HEADINGS) | structural | weak_start | _holds(norm, vocab.GOAL_STARTS, "^") | (F.size(F.split(norm, " ")) > 6)
    paper = book | norm.rlike(r"\b(?:19|20)\d{2}\b") | (F.regexp_count(norm, F.lit(r"\b[a-z]\b")) >= 3)
    goal = _holds(norm, vocab.GOAL_ENDS, end="$") & (F.regexp_count(norm, F.lit(" ")) >= 5)
    return ~(general | (F.length(slug) < 4) | weak | tool | paper | goal)


def is_topic_candidate(text: Column, profile: Profile = DEFAULT) -> Column:
    """Whether a heading or term may be a topic, by one vocabulary for all courses. [P14]"""
    norm, slug = match_text(text, "c"), slugify(text)
    return topic_rule(norm, slug, slug.isin(profile.generic_slugs), norm.isin(profile.structural_headings), _holds(norm, profile.weak_starts, "^"), _holds(norm, profile.known_tools), _holds(norm, profile.bibliography_markers))


def strip_topic_prefix(text: Column) -> Column:
    """A heading without its number, `unidade 1 -` and the like. [P14]"""
    s = F.regexp_replace(collapse_ws(text), r"^\d+(?:\.\d+)*\.?\s*", "")
    s = F.regexp_replace(s, r"(?i)^(?:unidade|tema|topico)\s+\d+\s*[-\u2014:]?\s*", "")
    s = F.regexp_replace(s, r"(?i)^(?:especificacao|especifica\u00e7\u00e3o)\s+de\s+", "")
    return F.regexp_replace(s, r"^[ \-:\t]+|[ \-:\t]+$", "")


def topic_lines(texts: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Candidates for topics in texts (course_id, text): `## x`, bullets, numbered lines and unit lines that may be one. [A5]"""
    line = collapse_ws(F.col("raw"))
    lines = texts.select("course_id", F.explode(text_lines("text")).alias("raw")).select("course_id", line.alias("line"))
    body = F.when(F.col("line").rlike(r"^(?:## |- )"), F.trim(F.regexp_replace("line", r"^(?:## |- \[ \] |- )", "")))
    body = body.when(F.col("line").rlike(r"(?i)^(?:\d+(?:\.\d+)*\.?|unidade\s+\d+)"), F.col("line"))
    found = lines.select("course_id", body.alias("body")).filter("body is not null").select("course_id", strip_topic_prefix(F.col("body")).alias("text")).filter("text != ''")
    return found.filter(is_topic_candidate(F.col("text"), profile)).groupBy("course_id", slugify("text").alias("slug")).agg(F.min("text").alias("text"))


def plan_lines(plans: DataFrame, text: str = "plan") -> DataFrame:
    """Lines of teaching plans with what each is: unit (title), topic (code, text, depth), stop, other. [F21]

    Units: `### Unidade 1 - x`, `UNIDADE 01: x`, `**Unidade 1 - x**`, `N° da unidade: 1`. Topics: `1.2. x` or bullets.
    """
    lines = plans.select("course_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line"))
    raw = F.trim("line")
    norm = F.lower(fold(raw))
    unit = r"(?i)^(?:#{1,4}\s*|\*\*\s*)?(unidade(?:\s+de\s+aprendizagem)?\s*0*\d+\s*(?:[:\-–—.]\s*.*)?)$"
    topic = r"^(?:[-*•]\s*)?(\d+(?:\.\d+)+)\.?\s+(.+)$"
    bullet = r"^[-*•]\s+(.+)$"
    stop = norm.rlike(r"^(?:#+\s*|\*\*)?(?:bibliografia|avaliacao|metodologia|procedimentos|objetivos|referencias|cronograma|ementa)\b")
    title = collapse_ws(F.regexp_replace(F.regexp_extract(raw, unit, 1), r"\*\*", ""))
    code = F.regexp_extract(raw, topic, 1)
    label = F.when(code != "", F.regexp_extract(raw, topic, 2)).otherwise(F.regexp_extract(raw, bullet, 1))
    kind = F.when(raw.rlike(unit), "unit").when(stop, "stop").when(raw.rlike(topic) | raw.rlike(bullet), "topic").otherwise("other")
    return lines.select("course_id", "pos", kind.alias("kind"), title.alias("unit_title"), F.nullif(code, F.lit("")).alias("topic_code"), collapse_ws(F.regexp_replace(label, r"[.;]\s*$", "")).alias("topic_text"), F.when(code != "", F.regexp_count(code, F.lit(r"\.")) - 1).otherwise(0).alias("depth"))


def plan_units(plans: DataFrame, text: str = "plan") -> DataFrame:
    """Units and topics of teaching plans, one row per topic (or per unit without any). [F21]

    A line's unit is the latest unit line before it with no stop heading between: running windows, no state machine.
    """
    lines = plan_lines(plans, text)
    w = W.partitionBy("course_id").orderBy("pos")
    marks = lines.withColumns({"unit_ord": F.sum(F.when(F.col("kind") == "unit", 1).otherwise(0)).over(w), "mark": F.last(F.when(F.col("kind").isin("unit", "stop"), F.col("kind")), ignorenulls=True).over(w)})
    units = marks.filter("kind = 'unit'").select("course_id", "unit_ord", "unit_title", unit_slug("unit_title").alias("unit_slug"))
    topics = marks.filter("kind = 'topic' and mark = 'unit'").withColumn("topic_ord", F.row_number().over(W.partitionBy("course_id", "unit_ord").orderBy("pos"))).select("course_id", "unit_ord", "topic_ord", "topic_code", "topic_text", "depth")
    return units.join(topics, ["course_id", "unit_ord"], "left")


def bibliography(plans: DataFrame, text: str = "plan") -> DataFrame:
    """Basic and complementary references of plans; a line that does not start a reference goes on with it. [F22]"""
    lines = plans.select("course_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line")).withColumn("norm", F.lower(fold(F.trim("line"))))
    head = F.when(F.col("norm").rlike(r"^(?:#+\s*|\*\*)?(?:bibliografia\s+)?basica\b|^(?:#+\s*|\*\*)?bibliografia\s*:?\**$"), "basic").when(F.col("norm").rlike(r"^(?:#+\s*|\*\*)?(?:bibliografia\s+)?complementar"), "complementary").when(F.col("norm").rlike(r"^#+\s|^unidade\b"), "none")
    w = W.partitionBy("course_id").orderBy("pos")
    df = lines.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(w)).filter("head is null and section in ('basic', 'complementary') and trim(line) != ''")
    starts = F.col("line").rlike(r"^\s*(?:[-*•]|\d+[.)]|\[\d+\])?\s*[A-ZÀ-Þ]{2,}[^a-z]*,")
    df = df.withColumn("n", F.sum(starts.cast("int")).over(W.partitionBy("course_id", "section").orderBy("pos")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(F.regexp_replace("line", r"^\s*(?:[-*•]|\d+[.)]|\[\d+\])\s*", "")).alias("t")))), lambda x: x["t"])
    return df.filter("n > 0").groupBy("course_id", "section", "n").agg(F.array_join(parts, " ").alias("reference"))


def glossary(texts: DataFrame, text: str = "glossary") -> DataFrame:
    """Glossary terms of Markdown `## term` blocks: term, unit_hint, synonyms, definition. [F24]"""
    lines = texts.select("course_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line"))
    w = W.partitionBy("course_id").orderBy("pos")
    df = lines.withColumn("n", F.sum(F.col("line").rlike(r"^##\s+\S").cast("int")).over(w)).filter("n > 0")
    part = lambda names: F.first(F.nullif(collapse_ws(F.regexp_extract("line", rf"(?i)^\s*(?:[-*]\s*)?\**(?:{names})\**\s*:\**\s*(.+)$", 1)), F.lit("")), ignorenulls=True)
    out = df.groupBy("course_id", "n").agg(F.min_by(F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1), "pos").alias("term"), part("unidade|unit").alias("unit_hint"), part("sin[oô]nimos?(?: aceitos?)?|aliases").alias("s"), part("defini[cç][aã]o").alias("definition"))
    synonyms = F.filter(F.transform(F.split(F.coalesce("s", F.lit("")), r"[,;/|]"), collapse_ws), lambda x: x != "")
    return out.select("course_id", "n", "term", "unit_hint", synonyms.alias("synonyms"), "definition")


def contained_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (course_id, inner, outer) of texts of a course of which one, of four letters or more, stands in the other. [J15]

    inner: course_id, inner; outer: course_id, outer. An inner text is looked up by that run of four of its letters that the
    fewest outer texts of its course hold, so common letters bring no pairs together.
    """
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(F.col(c), i, F.lit(4)))))
    small, large = (df.select("course_id", c).filter(F.length(c) >= 4).distinct() for df, c in ((inner, "inner"), (outer, "outer")))
    posted = large.withColumn("g", grams("outer"))
    held = posted.groupBy("course_id", "g").agg(F.count("*").alias("n"))
    rarest = small.withColumn("g", grams("inner")).join(held, ["course_id", "g"], "left").groupBy("course_id", "inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r"))
    asked = rarest.filter("r.n > 0").select("course_id", "inner", "r.g")  # a run that no text holds: nothing holds the whole
    return asked.join(posted, ["course_id", "g"]).filter(F.col("outer").contains(F.col("inner"))).select("course_id", "inner", "outer")


def glossary_aliases(topics: DataFrame, terms: DataFrame) -> DataFrame:
    """Aliases of topics from glossary terms that equal, hold or are held by their label, within the unit hint. [J15]

    Returns course_id, topic_slug, aliases: one form per slug, sorted. Labels and terms meet where they are equal or one
    stands in the other (`contained_pairs`), never all of a course.
    """
    t = terms.withColumns({"term_norm": match_text("term", "c"), "hint": match_text("unit_hint", "c")}).filter("term_norm != ''")
    labelled = topics.withColumn("label_norm", match_text("topic_label", "c"))
    labels, words = labelled.select("course_id", "label_norm").distinct(), t.select("course_id", "term_norm").distinct()
    equal = labels.join(words.select("course_id", F.col("term_norm").alias("label_norm"), "term_norm"), ["course_id", "label_norm"])
    holds = contained_pairs(words.withColumnRenamed("term_norm", "inner"), labels.withColumnRenamed("label_norm", "outer")).select("course_id", F.col("outer").alias("label_norm"), F.col("inner").alias("term_norm"))
    held = contained_pairs(labels.withColumnRenamed("label_norm", "inner"), words.withColumnRenamed("term_norm", "outer")).select("course_id", F.col("inner").alias("label_norm"), F.col("outer").alias("term_norm"))
    met = equal.select("course_id", "label_norm", "term_norm").union(holds).union(held).distinct()
    # of terms that are written alike each alias counts once, by its slug, before they meet the topics
    said = t.select("course_id", "term_norm", "hint", F.explode(F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("alias"))
    said = said.withColumn("s", slugify("alias")).groupBy("course_id", "term_norm", "hint", "s").agg(F.min("alias").alias("alias"))
    own = labelled.select("course_id", "topic_slug", slugify("topic_label").alias("own"), "label_norm", match_text("unit_slug", "c").alias("unit")).distinct()
    pairs = own.join(met, ["course_id", "label_norm"]).join(said, ["course_id", "term_norm"])
    found = pairs.filter(((F.col("hint") == "") | F.col("unit").contains(F.col("hint"))) & (F.col("s") != F.col("own")))
    once = found.groupBy("course_id", "topic_slug", "s").agg(F.min("alias").alias("alias"))
    return once.groupBy("course_id", "topic_slug").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def stems(c: Column | str) -> Column:
    """First five letters of the words of a text without its number, but for a few small words. [J16]"""
    text = F.col(c) if isinstance(c, str) else c
    # only a text that begins so can lose more than white space and dashes, which a match text has not
    norm = once(match_text(text, "c"), lambda n: F.when(n.rlike("^(?:[0-9]|unidade|tema|topico|especificacao)"), match_text(strip_topic_prefix(text), "c")).otherwise(n))
    words = F.filter(tokens(norm), lambda x: ~x.isin("sobre", "para", "entre"))
    return F.array_distinct(F.transform(words, lambda x: F.substring(x, 1, 5)))


def near_texts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (course_id, l_key, r_key) of texts (course_id, key, norm, stems) that share a stem or of which one may hold the
    other: joins on stems and on the first four letters anywhere in the other text. Only their digests (key) are moved. [J16]"""
    l, r = (df.select("course_id", F.col("key").alias(f"{x}_key"), F.col("norm").alias(f"{x}_norm"), F.col("stems").alias(f"{x}_stems")).filter(F.size("stems") > 0) for df, x in ((left, "l"), (right, "r")))
    # runs of four letters in one pass: cut out one by one each would be counted off from the start of the text
    grams = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit("(?=(.{4}))"), F.lit(1))))
    keyed = lambda df, x, k: df.select("course_id", f"{x}_key", k.alias("k")).distinct()
    met = [
        (l.select("course_id", "l_key", F.explode("l_stems").alias("k")), keyed(r, "r", F.explode("r_stems"))),
        (l.select("course_id", "l_key", grams("l_norm").alias("k")), keyed(r, "r", F.substring("r_norm", 1, 4))),
        (l.select("course_id", "l_key", F.substring("l_norm", 1, 4).alias("k")), keyed(r, "r", grams("r_norm"))),
    ]
    return reduce(DataFrame.union, (a.join(b, ["course_id", "k"]).select("course_id", "l_key", "r_key") for a, b in met)).distinct()


def _normed(df: DataFrame, text: str) -> DataFrame:
    """The frame with the match text of a column as norm, its digest as key and its stems, worked out once."""
    made = df.withColumns({"norm": match_text(text, "c"), "stems": stems(text)})
    return staged(made.withColumn("key", F.md5("norm")), "normed")


def heading_support(heads: DataFrame, topics: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """The topic of its course that best supports each heading (course_id, heading, ord), with its points. [J16]

    Headings and topics meet as `near_texts`, so the joins have a key besides the course. A heading that reaches
    SUPPORT['least'] is an alias of that topic.
    """
    h = _normed(heads, "heading")
    t = _normed(topics.select("course_id", "topic_slug", "topic_ord", "kind", "topic_label"), "topic_label")
    near = near_texts(h, t)
    h, t = (df.withColumnsRenamed({"key": f"{x}_key", "norm": f"{n}_norm", "stems": f"{n}_stems"}) for df, x, n in ((h, "l", "h"), (t.drop("topic_label"), "r", "t")))
    pairs = h.join(near, ["course_id", "l_key"]).join(t, ["course_id", "r_key"])
    n, words = F.size(F.array_intersect("h_stems", "t_stems")), F.size("h_stems")
    cue = F.when(_holds(F.col("h_norm"), profile.overlap_cues), SUPPORT["cue"]).when(_holds(F.col("h_norm"), vocab.WEAK_CUES), SUPPORT["weak_cue"]).otherwise(0.0)
    points = F.when(F.col("h_norm") == F.col("t_norm"), SUPPORT["equal"]).when(F.col("h_norm").contains(F.col("t_norm")) | F.col("t_norm").contains(F.col("h_norm")), SUPPORT["inside"]).when(n >= 2, SUPPORT["stems"] + SUPPORT["each"] * n).when((n == 1) & words.between(2, 6), cue).otherwise(0.0)
    scored = pairs.withColumn("points", points + F.when(F.col("kind") == "subtopic", SUPPORT["subtopic"]).otherwise(0.0)).filter(F.col("points") >= SUPPORT["least"])
    best = scored.groupBy(*heads.columns).agg(F.min(F.struct((-F.col("points")).alias("neg"), "topic_ord", "topic_slug")).alias("b"))
    return best.select(*heads.columns, F.col("b.topic_slug").alias("topic_slug"), (-F.col("b.neg")).alias("points"))


def _behind(heads: DataFrame, base: DataFrame, runs: bool) -> DataFrame:
    """The headings with each base text that they may meet as `near_texts`, and null where they meet none: a broadcast index
    of stems, first letters and runs of letters, so no heading is moved or written. Both: course_id, norm, stems. Without
    `runs` base texts that stand inside a heading are not looked for."""
    cut = lambda c: F.regexp_extract_all(c, F.lit("(?=(.{4}))"), F.lit(1))
    marked = lambda mark, words: F.transform(words, lambda x: F.concat(F.lit(mark), x))
    stem, first, anywhere = marked("s", F.col("stems")), F.array(F.substring("norm", 1, 4)), cut("norm")
    keys = lambda *parts: F.when(F.size("stems") > 0, F.concat(*parts))
    of_base = keys(stem, marked("h", anywhere), marked("b", first))
    of_head = keys(stem, marked("h", first), *([marked("b", anywhere)] if runs else []))
    index = base.select("course_id", F.col("norm").alias("r_norm"), F.col("stems").alias("r_stems"), F.explode(F.array_distinct(of_base)).alias("k"))
    return heads.withColumn("k", F.explode_outer(of_head)).join(F.broadcast(index), ["course_id", "k"], "left").drop("k")


def supported_headings(heads: DataFrame, base: DataFrame, profile: Profile = DEFAULT, cue: Column | None = None, sure: Column | None = None, holds: Column | None = None) -> DataFrame:
    """The headings (course_id, text) that a base candidate of their course (course_id, text) stands behind; `cue` tells of a
    heading whether it holds a cue of its course, `sure` whether it needs no candidate, `holds` whether its match text holds
    that of a candidate with stems, where this is known. A column norm is taken for the match text. [A5]

    Headings are read once and stay where they are if there are no more than MOST_BASES candidates, which is counted first.
    """
    sure = F.lit(False) if sure is None else sure
    b = _normed(base.select("course_id", "text"), "text")
    n, mine, other = F.size(F.array_intersect("stems", "r_stems")), F.size("stems"), F.size("r_stems")
    inside = F.col("norm").contains(F.col("r_norm")) | F.col("r_norm").contains(F.col("norm"))
    cue = (n == 1) & mine.between(2, 4) & (_holds(F.col("norm"), profile.overlap_cues) if cue is None else cue)
    most = (n >= 2) & (((n == other) & (mine - n <= 1)) | ((n == mine) & (other - n <= 1)))
    if b.limit(MOST_BASES + 1).count() <= MOST_BASES:
        h = heads.withColumn("norm", F.col("norm") if "norm" in heads.columns else match_text("text", "c"))
        pairs = _behind(h.withColumn("stems", stems("text")), b.select("course_id", "norm", "stems").distinct(), holds is None)
        sure = sure if holds is None else sure | (holds & (F.size("stems") > 0))
    else:
        h = _normed(heads, "text")
        near = near_texts(h.filter(~sure), b)
        r = b.drop("text").distinct().withColumnsRenamed({c: f"r_{c}" for c in ("key", "norm", "stems")})
        met = h.withColumnRenamed("key", "l_key").join(near, ["course_id", "l_key"]).join(r, ["course_id", "r_key"])
        pairs = met.unionByName(h.filter(sure), allowMissingColumns=True)
    return pairs.filter(sure | inside | cue | most).select(*heads.columns).distinct()


def merge_topics(topics: DataFrame) -> DataFrame:
    """Topics of one slug as one: first filled code, label and kind, and all aliases by slug, sorted. [W13]"""
    order = F.struct("unit_ord", "topic_ord")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", order)).alias(c)
    base = topics.groupBy("course_id", "topic_slug").agg(first("topic_code"), first("topic_label"), first("kind"), F.min_by("unit_slug", order).alias("unit_slug"))
    alias = topics.select("course_id", "topic_slug", F.explode("aliases").alias("alias")).groupBy("course_id", "topic_slug", slugify("alias").alias("s")).agg(F.min("alias").alias("alias"))
    alias = alias.groupBy("course_id", "topic_slug").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return base.join(alias, ["course_id", "topic_slug"], "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def heading_cues(lines: DataFrame, most: int = 24) -> DataFrame:
    """The most frequent words of topic-like lines (course_id, line), at most `most` a course. [A3]"""
    return _ranked(_words(lines).groupBy("course_id", "token").agg(F.count("*").alias("n")), most)


def _words(lines: DataFrame) -> DataFrame:
    return lines.select("course_id", F.explode(tokens(match_text("line", "c"))).alias("token"))


def _ranked(counts: DataFrame, most: int) -> DataFrame:
    w = W.partitionBy("course_id").orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def staged_cues(lines: DataFrame, most: int = 24) -> DataFrame:
    """`heading_cues` of lines that lie in a table and may be read again; null courses are left out.

    Words that are frequent in some lines are likely ones; they are counted in all lines, and the others by buckets of a hash.
    The last likely word that would be a cue bounds its course's cues from below, so a bucket whose sum is less holds none. Words
    of other buckets are counted, so the cues are exact, and rare words, nearly as many as there are lines, are not moved.
    """
    lines = lines.filter("course_id is not null")
    some = lines.filter(F.pmod(F.xxhash64("line"), F.lit(16)) == 0)
    likely = staged(heading_cues(some, 8 * most).select("course_id", "token", F.lit(True).alias("likely")), "likely")
    if likely.limit(MOST_LIKELY + 1).count() > MOST_LIKELY:
        return heading_cues(lines, most)
    other = F.when(F.col("likely").isNull(), F.pmod(F.xxhash64("token"), F.lit(BUCKETS)))
    words = lambda df: _words(df).join(F.broadcast(likely), ["course_id", "token"], "left").withColumn("bucket", other)
    held = words(lines).groupBy("course_id", F.when(F.col("likely"), F.col("token")).alias("token"), "bucket").agg(F.count("*").alias("n"))
    held = staged(held, "counted")
    known = held.filter("bucket is null").select("course_id", "token", "n")
    least = _ranked(known, most).filter(F.col("rank") == most).select("course_id", F.col("n").alias("least"))
    wide = held.filter("bucket is not null").join(least, "course_id", "left").filter(F.col("n") >= F.coalesce("least", F.lit(0))).select("course_id", "bucket")
    wide = staged(wide, "buckets")
    if not wide.isEmpty():
        open_ = lines.join(wide.select("course_id").distinct(), "course_id", "left_semi")
        known = known.union(words(open_).join(wide, ["course_id", "bucket"]).groupBy("course_id", "token").agg(F.count("*").alias("n")))
    return _ranked(known, most)


def tool_candidates(sources: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Names that may be tools, per course: name, sources, context. [A4] sources: course_id, source (in order), text.

    A name counts once a source, where it stands first; it is taken if it is known, has a special shape (`+`, `#`, `.`, a
    digit, a capital inside) where it first stands, or is in two sources and in one of them beside a word of tools.
    """
    lines = sources.select("course_id", "source", F.posexplode(text_lines("text")).alias("pos", "line"))
    distinct = F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b[A-Za-z][A-Za-z0-9.+#-]{1,24}\b"), F.lit(0)))  # in order
    lines = lines.select("course_id", "source", "pos", _holds(match_text("line", "d"), vocab.TOOL_CONTEXT).alias("context"), distinct.alias("words")).filter(F.size("words") > 0)
    # a source's lines meet before they are cut into words, so that words are counted in their task and moved as counts
    words = lines.repartition("course_id", "source").select("course_id", "source", "pos", "context", F.posexplode("words").alias("at", "raw"))
    words = words.withColumn("name", F.lower("raw")).filter(~F.col("name").isin(vocab.TOOL_STOPWORDS))  # of ASCII letters: its match text
    shape = F.col("raw").rlike(r"[+#.\d]") | F.substring("raw", 2, 30).rlike(r"\p{Lu}")
    # the line, the place there, and what is asked of it as one number, whose least is kept without sorting
    place = F.shiftleft(F.col("pos").cast("long"), 32) + F.shiftleft(F.col("at").cast("long"), 2) + F.when(F.col("context"), 2).otherwise(0) + F.when(shape, 1).otherwise(0)
    once = words.groupBy("course_id", "source", "name").agg(F.min(place).alias("first"))
    found = once.groupBy("course_id", "name").agg(F.count("*").alias("sources"), F.count_if(F.col("first").bitwiseAND(2) > 0).alias("context"), F.min_by(F.col("first").bitwiseAND(1) > 0, "source").alias("special"))
    special = F.coalesce("special", F.lit(False))
    known = F.array(*(match_text(F.lit(t), "d") for t in profile.known_tools))
    beside = (F.col("context") >= 1) & (F.col("sources") >= 2) & (F.length("name") >= 3)
    return found.filter(F.array_contains(known, F.col("name")) | special | beside).select("course_id", "name", "sources", "context")


def strong_headings(docs: DataFrame, each: int = 4) -> DataFrame:
    """The first headings of each document, the first of its slug in the course. [T3] docs: course_id, ord, markdown."""
    df = docs.select("course_id", "ord", F.posexplode(headings("markdown", each)).alias("pos", "heading"))
    return df.groupBy("course_id", slugify("heading").alias("slug")).agg(F.min(F.struct("ord", "pos", "heading")).alias("x")).select("course_id", "slug", F.col("x.heading").alias("heading"), F.col("x.ord").alias("ord"))


def tag_catalog(candidates: DataFrame, heads: DataFrame | None = None, profile: Profile = DEFAULT) -> DataFrame:
    """Tags of each course, sorted: topics among the candidates (course_id, text), headings (the same) that one of them
    stands behind (any, where a course has none), and known tools that headings name. [A5]"""
    base = candidates.filter(is_topic_candidate(F.col("text"), profile)).select("course_id", "text").distinct()
    tags = base.select("course_id", F.concat(F.lit("topico:"), slugify("text")).alias("tag"))
    if heads is not None:
        good = heads.filter(is_topic_candidate(F.col("text"), profile)).select("course_id", "text").distinct()
        alone = good.join(base.select("course_id").distinct(), "course_id", "left_anti")
        named = supported_headings(good, base, profile).unionByName(alone)
        tools = F.explode(F.filter(F.array(*(F.lit(t) for t in profile.known_tools)), lambda t: match_text("text", "c").contains(match_text(t, "c"))))
        tags = tags.union(named.select("course_id", F.concat(F.lit("topico:"), slugify("text")))).union(heads.select("course_id", tools.alias("tool")).select("course_id", F.concat(F.lit("ferramenta:"), slugify("tool"))))
    return tags.filter(~F.col("tag").endswith(":untitled")).groupBy("course_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def exam_review(norm: Column) -> Column:
    """Whether a match text speaks of review and, as a whole word, of an exam. [F32]"""
    return norm.rlike("|".join(vocab.REVIEW_CUES)) & norm.rlike(r"(?<![a-z0-9])(?:" + "|".join(vocab.EXAM_CUES) + r")(?![a-z0-9])")


def formal_course(norm: Column) -> Column:
    """Whether a match text is of a formal-methods course. [F32]"""
    return norm.rlike("|".join(vocab.FORMAL_WORDS))


def auto_tags(entries: DataFrame, catalog: DataFrame, most: int = 6) -> DataFrame:
    """Tags of each entry: catalogue tags that its title and headings name, its type, exam review; the first `most`. [A6]

    entries: course_id, entry_id, title, head_text, category, and raw_target if it has it; catalog: course_id, tags (in
    order). A topic of one word must be a word of the text, of five letters or more; other tags stand there as a phrase or
    with all their words of four letters.
    """
    raw = "raw_target" if "raw_target" in entries.columns else None
    strong = F.concat_ws(" ", *(F.nullif(match_text(c, "c"), F.lit("")) for c in ("title", "head_text")))
    review = F.concat_ws(" ", *(F.nullif(match_text(c, "c"), F.lit("")) for c in ("title", *([raw] if raw else []), "head_text")))
    df = entries.withColumns({"__n": strong, "__r": review})
    # equal texts of a course are read once; a text meets the tags that it may name, never all of its course
    texts = staged(df.select("course_id", F.col("__n").alias("norm")).distinct(), "texts").filter("course_id is not null and norm != ''")
    named = naming.named_tags(texts, catalog.select("course_id", "tags"), most).withColumnRenamed("norm", "__n")
    df = df.join(named, ["course_id", "__n"], "left")
    found = F.coalesce("named", F.array().cast("array<string>"))
    category = match_text("category", "c")
    kind = F.coalesce(*(F.when(category.contains(part), F.lit(tag)) for part, tag in vocab.TYPE_TAGS))
    extra = F.filter(F.array(kind, F.when(exam_review(F.col("__r")), F.lit("uso:revisao-prova"))), lambda x: x.isNotNull())
    return df.withColumn("auto_tags", F.slice(F.array_distinct(F.concat(found, extra)), 1, most)).select(*entries.columns, "auto_tags")


def best_sentence(pairs: DataFrame, key: list[str]) -> DataFrame:
    """The best sentence of a text for a term: 40 to 220 characters, 6 points for the phrase, 1 a word; at most 180 are
    shown, cut at a word. [F25] pairs: key, term, text."""
    s = pairs.select(*key, "term", F.posexplode(F.split(collapse_ws("text"), r"(?<=[.!?])\s+")).alias("pos", "sentence")).filter(F.length("sentence").between(40, 220))
    norm, t = match_text("sentence", "c"), match_text("term", "c")
    points = F.when(norm.contains(t) & (t != ""), 6).otherwise(0) + F.size(F.array_intersect(F.array_distinct(tokens(t)), F.array_distinct(tokens(norm))))
    bad = F.col("sentence").rlike(r"https?://|\||^\W*\d+\W*$")
    best = s.withColumn("points", points).filter((F.col("points") > 0) & ~bad).groupBy(*key).agg(F.min(F.struct((-F.col("points")).alias("neg"), "pos", "sentence")).alias("b"))
    short = F.when(F.length("b.sentence") <= 180, F.col("b.sentence")).otherwise(F.concat(F.regexp_replace(F.substring("b.sentence", 1, 177), r"\s+\S*$", ""), F.lit("...")))
    return best.select(*key, (-F.col("b.neg")).alias("points"), short.alias("sentence"))


def seeded_fields(terms: DataFrame, rules: list[tuple[str, str, str, str]], evidence: DataFrame) -> DataFrame:
    """Terms (course_id, term) with definition, synonyms and not_confuse: of the first rule (needle as match text,
    definition, synonyms, what it is not) that the term's match text holds, else the evidence's sentence. [F26]

    The rules are a list of a few dozen; a chain of conditions tests them in order, and no join is needed.
    """
    norm = match_text("term", "c")
    pick = lambda k: F.coalesce(*(F.when(norm.contains(r[0]), F.lit(r[k])) for r in rules), F.lit(None).cast("string"))
    out = terms.withColumns({"__d": pick(1), "synonyms": F.coalesce(pick(2), F.lit("")), "not_confuse": F.coalesce(pick(3), F.lit(""))})
    return out.join(evidence, ["course_id", "term"], "left").withColumn("definition", F.coalesce("__d", "sentence", F.lit(""))).drop("__d", "sentence")


def derive_units(maps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Units of a course from `###` titles of its map, else from its blocks' units. [J26]

    maps: course_id, markdown; blocks: course_id, block_ord, unit_slug, topic_text.
    """
    lines = maps.select("course_id", F.posexplode(F.split("markdown", r"\r?\n")).alias("ord", "line")).filter(F.col("line").rlike(r"^###\s+\S"))
    mapped = lines.select("course_id", "ord", F.regexp_extract("line", r"^###\s+(.+?)\s*$", 1).alias("unit_title")).withColumn("unit_slug", unit_slug("unit_title"))
    of_blocks = blocks.filter("unit_slug != ''").groupBy("course_id", "unit_slug").agg(F.min("block_ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "topic_text"))), lambda x: x["topic_text"]), " ").alias("signals"))
    rest = of_blocks.join(mapped.select("course_id").distinct(), "course_id", "left_anti").select("course_id", "ord", F.col("unit_slug").alias("unit_title"), "unit_slug")
    return mapped.unionByName(rest).join(of_blocks.select("course_id", "unit_slug", "signals"), ["course_id", "unit_slug"], "left")
