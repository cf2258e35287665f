"""Tags of a course that a text names, found without holding each text against each tag.

A course's phrases are one Aho-Corasick automaton, its sets of words one tree in which a text's sorted words are followed;
both read a text once. Tags and texts meet in one sorted stream of a task; courses with many texts are dealt by weight.
IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coursemill.functions.text import match_text, tokens
from coursemill.operators.dealing import deal


class _Names:
    """The tags of one course: phrases, and sets of words in order as paths of a tree (None marks a path's end)."""

    def __init__(self) -> None:
        self.tags: dict[int, str] = {}
        self.phrases: dict[str, list[int]] = {}
        self.tree: dict = {}
        self.machine: ahocorasick.Automaton | None = None

    def add(self, place: int, tag: str, phrase: str, words: list[str]) -> None:
        self.tags[place] = tag
        alone = len(words) == 1
        if not (alone and tag.startswith("topico:")):
            self.phrases.setdefault(phrase, []).append(place)
        if len(words) > 1 or (alone and len(words[0]) >= 5):
            node = self.tree
            for w in sorted(set(words)):
                node = node.setdefault(w, {})
            node.setdefault(None, []).append(place)

    def _within(self, node: dict, words: list[str], start: int, found: set[int]) -> None:
        found.update(node.get(None, ()))
        if len(node) > (None in node):
            for i in range(start, len(words)):
                after = node.get(words[i])
                if after is not None:
                    self._within(after, words, i + 1, found)

    def named(self, text: str, most: int) -> list[str]:
        if self.machine is None and self.phrases:
            self.machine = ahocorasick.Automaton()
            for phrase, places in self.phrases.items():
                self.machine.add_word(phrase, places)
            self.machine.make_automaton()
        found: set[int] = set()
        if self.machine is not None and text:
            for _, places in self.machine.iter(text):
                found.update(places)
        self._within(self.tree, sorted({w for w in text.split(" ") if len(w) >= 4}), 0, found)
        return list(dict.fromkeys(self.tags[p] for p in sorted(found)))[:most]


def named_tags(texts: DataFrame, catalog: DataFrame, most: int) -> DataFrame:
    """texts (course_id, norm) with `named`, the first `most` tags of their course that they name. [A6]

    catalog: course_id, tags (in order). A topic of one word must be a word of the text, of five letters or more; other tags
    stand there as a phrase or with all their words of four letters. Texts of courses without tags are left out.
    """
    phrase = match_text(F.replace(F.regexp_extract("tag", "^[^:]*:(.*)$", 1), F.lit("-"), F.lit(" ")), "c")
    tags = catalog.select("course_id", F.posexplode("tags").alias("place", "tag")).filter(F.col("tag").rlike("^(?:topico|ferramenta):")).withColumn("phrase", phrase).filter("phrase != ''")
    dealt, sent = deal(texts, tags, "norm")
    null = lambda kind: F.lit(None).cast(kind)
    both = sent.select("course_id", "__part", F.lit(0).alias("side"), "place", "tag", F.col("phrase").alias("text"), tokens("phrase").alias("words"))
    both = both.union(dealt.select("course_id", "__part", F.lit(1), null("int"), null("string"), "norm", null("array<string>")))
    stream = both.filter("course_id is not null").repartition("course_id", "__part").sortWithinPartitions("course_id", "__part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, _Names()
        for batch in batches:
            courses, norms, found = [], [], []
            for course, part, side, place, tag, text, words in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if held != (course, part):
                    held, names = (course, part), _Names()
                if side == 0:
                    names.add(place, tag, text, words)
                elif names.tags:
                    courses.append(course)
                    norms.append(text)
                    found.append(names.named(text, most))
            yield pa.RecordBatch.from_arrays([pa.array(courses, pa.string()), pa.array(norms, pa.string()), pa.array(found, pa.list_(pa.string()))], ["course_id", "norm", "named"])

    return stream.mapInArrow(run, "course_id string, norm string, named array<string>")
