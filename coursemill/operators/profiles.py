"""Vocabularies of each course as rows, and texts scanned for them: tools, stop headings, book marks, weak starts, cues.

A course's words are compiled into one Aho-Corasick automaton, which reads each text once, however many words there are.
Up to MOST_WORDS of all courses go to every task, so texts stay where they are. More meet the texts of their course in one
sorted stream of a task: first the words, then the texts, so nothing is held but the automaton; courses with many texts are
dealt by their weight. IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from coursemill.functions.text import match_text, slugify, tokens
from coursemill.operators import taxonomy
from coursemill.operators.dealing import TOGETHER, deal
from coursemill.sources.staging import staged

#: Kinds of words: tools (as written, for the rule on topics; and as match texts, for tags), marks of books and cues stand
#: anywhere in a text, weak starts at its start, stop headings are the whole of it; slugs are no topics.
KINDS = {"tool": "known_tools", "book": "bibliography_markers", "cue": "overlap_cues", "start": "weak_starts", "whole": "structural_headings", "slug": "generic_slugs"}

#: Words of all courses that every task gets at most, about 2 MB.
MOST_WORDS = 20_000


def course_vocabulary(courses: DataFrame, sources: DataFrame | None = None, heads: DataFrame | None = None, overrides: DataFrame | None = None, profile: taxonomy.Profile = taxonomy.DEFAULT, again: bool = False) -> DataFrame:
    """The words of every course: course_id, kind, word. The defaults, what its texts tell and what is set by hand. [A3, A4, U4]

    courses: course_id; sources: course_id, source (in order), text, of which tools are inferred; heads: course_id, line, of which
    cues are (a table that may be read `again` is, so that rare words are not moved); overrides: course_id, kind, word. A course's
    own slug is general. Lists only grow, repeats count once.
    """
    # blank words are left out before the union: a filter behind it would cut a slug for every row of `courses`
    ids = courses.select("course_id").filter("course_id is not null").distinct()
    fixed = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(w).alias("word")) for kind, name in KINDS.items() for w in getattr(profile, name) if w))
    out = ids.select("course_id", F.inline(fixed)).union(ids.select("course_id", F.lit("slug"), slugify("course_id")))
    if sources is not None:
        out = out.union(taxonomy.tool_candidates(sources, profile).select("course_id", F.lit("tool"), "name").filter("name != '' and course_id is not null"))
    if heads is not None:
        cues = taxonomy.staged_cues if again else taxonomy.heading_cues
        out = out.union(cues(heads).select("course_id", F.lit("cue"), "token").filter("token != '' and course_id is not null"))
    if overrides is not None:
        out = out.union(overrides.select("course_id", "kind", "word").filter("word != '' and course_id is not null"))
    named = out.filter("kind = 'tool'").select("course_id", F.lit("named"), "word")
    return out.union(named).distinct()


def scan(texts: DataFrame, vocabulary: DataFrame, keep: list[str] | None = None, together: int = TOGETHER) -> DataFrame:
    """texts (course_id, text) with `hits`, the (kind, word) of their course that their match text holds, once each.

    vocabulary: `course_vocabulary`, or rows of other kinds whose words are match texts. Returns course_id, the columns of
    `keep`, hits; without `keep`, text and norm (the match text). Texts of a course without words have no hits; null texts
    are dropped.
    """
    names = ["text", "norm"] if keep is None else keep
    words = vocabulary.filter("kind != 'slug'").withColumn("__norm", F.when(F.col("kind") == "named", match_text("word", "c")).otherwise(F.col("word"))).filter("__norm != ''")
    asked = texts.filter("text is not null").withColumn("norm", match_text("text", "c")).withColumn("__norm", F.col("norm")).select("course_id", "__norm", *names)
    of = dict(asked.dtypes)
    schema = ", ".join(["course_id string", *(f"`{c}` {of[c]}" for c in names), "hits array<struct<kind:string,word:string>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("word", pa.string())]))
    few = words.select("course_id", "__norm", "kind", "word").limit(MOST_WORDS + 1).collect()
    if len(few) <= MOST_WORDS:
        meanings: dict[str, dict[str, list[tuple[str, str]]]] = {}
        for course, norm, what, word in few:
            meanings.setdefault(course, {}).setdefault(norm, []).append((what, word))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = {}
            for batch in batches:
                hits = []
                for course, norm in zip(batch.column(0).to_pylist(), batch.column("__norm").to_pylist(), strict=True):
                    if course not in machines:
                        machines[course] = _machine(meanings.get(course, {}))
                    hits.append(_hits(machines[course], norm))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(c if c != "norm" else "__norm") for c in names), pa.array(hits, kind)], ["course_id", *names, "hits"])

        return asked.select("course_id", "__norm", *(c for c in names if c != "norm")).mapInArrow(read, schema)
    dealt, sent = deal(asked, words, "__norm", together=together)
    null = lambda kind: F.lit(None).cast(kind)
    both = sent.select("course_id", "__part", F.lit(0).alias("side"), "__norm", "kind", "word", *(null(of[c]).alias(c) for c in names)).union(dealt.select("course_id", "__part", F.lit(1), "__norm", null("string"), null("string"), *names))
    stream = both.repartition("course_id", "__part").sortWithinPartitions("course_id", "__part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        pending: dict[str, list[tuple[str, str]]] = {}
        machine = None
        for batch in batches:
            rows, hits = [], []
            for i, (course, part, side, norm, what, word) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                if held != (course, part):
                    held, pending, machine = (course, part), {}, None
                if side == 0:
                    pending.setdefault(norm, []).append((what, word))
                    continue
                if machine is None and pending:
                    machine, pending = _machine(pending), {}
                rows.append(i)
                hits.append(_hits(machine, norm))
            taken = pa.array(rows, pa.int64())
            columns = [batch.column(0), *(batch.column(6 + k) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in columns), pa.array(hits, kind)], ["course_id", *names, "hits"])

    return stream.mapInArrow(run, schema)


def _machine(words: dict[str, list[tuple[str, str]]]):
    """The automaton of match texts and what they mean, None without any."""
    if not words:
        return None
    machine = ahocorasick.Automaton()
    for w, meanings in words.items():
        machine.add_word(w, (len(w), meanings))
    machine.make_automaton()
    return machine


def _hits(machine, text: str) -> list[dict[str, str]]:
    """The (kind, word) that a text holds where their kind asks for it, once each."""
    if machine is None or not text:
        return []
    seen = set()
    for end, (size, meanings) in machine.iter(text):
        at_start = end + 1 == size
        seen |= {(k, w) for k, w in meanings if k not in ("start", "whole") or (at_start and (k == "start" or size == len(text)))}
    return [{"kind": k, "word": w} for k, w in sorted(seen)]


def glossary_evidence(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """The best document for each term: 8 points for the phrase, 1 for each of its words found, 3 at least. [J17]

    terms: course_id, term; docs: course_id, doc_ord, haystack (match text). The first document wins a tie. Phrases and words of
    a course's terms are one automaton that reads each document once; only what a document holds meets the terms again.
    """
    t = terms.select("course_id", "term").distinct().withColumn("norm", match_text("term", "c"))
    part = F.array(F.struct(F.lit("phrase").alias("kind"), F.array("norm").alias("words")), F.struct(F.lit("word").alias("kind"), F.array_distinct(tokens("norm")).alias("words")))
    asked = t.select("course_id", "term", F.inline(part)).select("course_id", "term", "kind", F.explode("words").alias("word")).filter("word != ''")
    found = scan(docs.select("course_id", "doc_ord", F.col("haystack").alias("text")), asked.select("course_id", "kind", "word").distinct(), keep=["doc_ord"])
    held = found.select("course_id", "doc_ord", F.inline("hits")).join(asked, ["course_id", "kind", "word"])
    scored = held.groupBy("course_id", "term", "doc_ord").agg(F.sum(F.when(F.col("kind") == "phrase", 8).otherwise(1)).cast("int").alias("points")).filter("points >= 3")
    best = scored.groupBy("course_id", "term").agg(F.min(F.struct((-F.col("points")).alias("neg"), "doc_ord")).alias("b"))
    return best.select("course_id", "term", F.col("b.doc_ord").alias("doc_ord"), (-F.col("b.neg")).alias("points"))


def _worded(slug: Column) -> Column:
    """Whether a scanned text may be a topic by its hits and its slug. [P14]"""
    has = lambda kind: F.exists("hits", lambda h: h["kind"] == kind)
    return taxonomy.topic_rule(F.col("norm"), slug, F.lit(False), has("whole"), has("start"), has("tool"), has("book"))


def _ungeneral(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The rows whose text's slug is none of their course's general ones. [P14]"""
    general = vocabulary.filter("kind = 'slug'").select("course_id", F.col("word").alias("__slug"))
    return df.withColumn("__slug", slugify("text")).join(general, ["course_id", "__slug"], "left_anti").drop("__slug")


def course_candidates(scanned: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The scanned texts (`scan`) that may be topics of their course. [P14]"""
    return _ungeneral(scanned.filter(_worded(slugify("text"))), vocabulary)


def course_tags(candidates: DataFrame, heads: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tags of each course by its own vocabulary, sorted: topics among the candidates (course_id, text), headings (the same)
    that one of them stands behind (any, where a course has none), and its tools that headings name. [A5]

    Headings are read once: what a candidate stands behind and the tools are staged, the headings themselves are not.
    """
    vocabulary = staged(vocabulary, "vocabulary")
    asked, heads = (df.select("course_id", "text").filter("course_id is not null and text is not null") for df in (candidates, heads))
    base = staged(course_candidates(scan(asked.distinct(), vocabulary), vocabulary).select("course_id", "text"), "base")
    own = base.select("course_id", F.lit(True).alias("__own")).distinct()
    inside = base.select("course_id", F.lit("base").alias("kind"), match_text("text", "c").alias("word"), taxonomy.stems("text").alias("s")).filter("size(s) > 0").drop("s")
    # a heading asks for the tools that it names, which need no candidate, and for itself, by what its slug does not tell
    scanned = scan(heads, vocabulary.unionByName(inside)).join(own, "course_id", "left").withColumn("__good", _worded(F.lit("slug")))
    has = lambda kind: F.exists("hits", lambda x: x["kind"] == kind)
    ask = lambda **of: F.struct(*(c.alias(name) for name, c in of.items()))
    blank, no = F.lit(""), F.lit(False)
    tools = F.transform(F.filter("hits", lambda x: x["kind"] == "named"), lambda x: ask(tool=x["word"], text=blank, norm=blank, cued=no, holds=no, sure=F.lit(True)))
    itself = ask(tool=F.lit(None).cast("string"), text=F.col("text"), norm=F.col("norm"), cued=has("cue"), holds=has("base"), sure=F.col("__own").isNull())
    asks = scanned.select("course_id", F.inline(F.concat(tools, F.when(F.col("__good"), F.array(itself)).otherwise(F.array()))))
    found = staged(taxonomy.supported_headings(asks, base, cue=F.col("cued"), sure=F.col("sure"), holds=F.col("holds")), "found")
    named = _ungeneral(found.filter("tool is null").filter(F.length(slugify("text")) >= 4), vocabulary)
    tools = found.filter("tool is not null").select("course_id", F.concat(F.lit("ferramenta:"), slugify("tool")).alias("tag"))
    topic = lambda df: df.select("course_id", F.concat(F.lit("topico:"), slugify("text")).alias("tag"))
    tags = topic(base).union(topic(named)).union(tools)
    return tags.filter(~F.col("tag").endswith(":untitled")).groupBy("course_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
