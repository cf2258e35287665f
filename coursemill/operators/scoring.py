"""Scores of documents against topics, units, schedule rows, blocks and sessions, and winners with confidence.

Topics and units of a course are one row of arrays, which meets each of its documents once (`with_course`): broadcast
where their number is small, dealt by weight where it is not, so that no course is one task. An inverted index from
words and phrase anchors leaves a few candidates, and only these are scored, inside the row. Token overlap with
schedule rows goes by equality joins on a vocabulary of related tokens. IDs in brackets are those of the operator
inventory.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from coursemill.functions import vocab
from coursemill.functions.text import date_range_signal, headings, lead_text, match_text, may_hold_date, once, session_dates, tokens
from coursemill.operators.dealing import deal
from coursemill.sources.staging import staged

#: Text fields of a document's signals with their weight for topics (fixed values).
TOPIC_WEIGHTS = {"headings": 4.4, "title": 3.8, "lead": 2.8, "manual_tags": 3.0, "body": 1.1, "auto_tags": 0.22, "legacy_tags": 0.15, "raw": 0.9}
SLUG_SHARE, ALIAS_SHARE = 0.65, 0.82
#: Points of a unit's phrase by the first field that holds it; shares of a phrase's words by field where none holds it; of
#: tokens; of distinctive tokens, met before and fresh (fixed values).
PHRASE_LADDER = [("headings", 3.0), ("lead", 2.8), ("title", 2.7), ("body", 1.4), ("manual_tags", 1.6), ("auto_tags", 0.18), ("legacy_tags", 0.24)]
PHRASE_SHARES = {"headings": 0.55, "lead": 0.48, "body": 0.18, "title": 0.45, "manual_tags": 0.35, "auto_tags": 0.04, "legacy_tags": 0.02, "raw": 0.18}
TOKEN_WEIGHTS = {"body": 0.32, "lead": 0.7, "headings": 0.8, "title": 0.55, "manual_tags": 0.45, "auto_tags": 0.05, "legacy_tags": 0.02, "raw": 0.2}
DISTINCT_POINTS = [("body", 0.25, 0.7), ("title", 0.15, 0.35), ("tags", 0.12, 0.3), ("raw", 0.06, 0.15)]
#: Courses' topics or units (rows) that are broadcast at most, about 1 KB each; beyond, courses are dealt by their weight.
MOST_BROADCAST = 100_000

def _empty() -> Column:
    return F.array().cast("array<string>")


def with_course(entries: DataFrame, rows: DataFrame, side: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """Each entry with its course's row of `side`, which was made of `rows`; of other courses' entries by `how`."""
    if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return entries.join(F.broadcast(side), "course_id", how)
    dealt, sent = deal(entries, side, by)
    return dealt.join(sent, ["course_id", "__part"], how).drop("__part")


def signals(entries: DataFrame, markdown: str = "markdown") -> DataFrame:
    """The frame with a match text `s_*` for each field, and the tags together as `s_tags`.

    Reads title, category, manual_tags, auto_tags (arrays), tags, raw_target where the frame has them.
    """
    has = set(entries.columns)
    text = lambda c: F.col(c) if c in has else F.lit("")
    joined = lambda c: F.array_join(F.coalesce(F.col(c), _empty()), "; ") if c in has else F.lit("")
    fields = {
        "title": text("title"), "headings": F.array_join(headings(markdown), " "), "lead": lead_text(markdown), "category": text("category"),
        "manual_tags": joined("manual_tags"), "auto_tags": joined("auto_tags"), "legacy_tags": text("tags"), "raw": text("raw_target"), "body": F.col(markdown),
    }
    # what a match text is made of is a column of its own: `match_text` names it more than once
    made = entries.withColumns({f"__{k}": fields[k] for k in ("headings", "lead")})
    fields |= {k: F.col(f"__{k}") for k in ("headings", "lead")}
    out = made.withColumns({f"s_{k}": match_text(v) for k, v in fields.items()}).drop("__headings", "__lead")
    return out.withColumn("s_tags", F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("s_manual_tags", "s_auto_tags", "s_legacy_tags"))))


# topics

#: What stands around a space: a phrase of several words is found only where its anchor is.
_WIDE, _NARROW = ".{2} .{2}", ". ."


def _anchor(phrase: Column) -> Column:
    """A word itself; of several words the letters around a space."""
    wide = F.nullif(F.regexp_extract(phrase, f"({_WIDE})", 1), F.lit(""))
    return F.when(F.instr(phrase, " ") > 0, F.coalesce(wide, F.regexp_extract(phrase, f"({_NARROW})", 1))).otherwise(phrase)


#: Anchors with a space of a course up to which each is looked for by itself; more are met through all that a text has.
FEW_ANCHORS = 64


def _anchors(texts: Column) -> Column:
    """What stands around the spaces of match texts joined by a mark."""
    return F.concat(*(F.regexp_extract_all(texts, F.lit(f"(?=({p}))"), F.lit(1)) for p in (_WIDE, _NARROW)))


def topic_index(topics: DataFrame) -> DataFrame:
    """Per course its topics in order, with their phrases, words and anchors, and all anchors as `keys`.

    topics: course_id, topic_ord, topic_slug, topic_label, unit_slug, kind, aliases.
    """
    named = topics.select(
        "course_id", "topic_ord", "topic_slug", "topic_label", "unit_slug", "kind", match_text("topic_label").alias("label"),
        match_text(F.replace(F.coalesce("topic_slug", F.lit("")), F.lit("-"), F.lit(" "))).alias("slug"),
        F.filter(F.transform(F.coalesce("aliases", _empty()), lambda x: match_text(x)), lambda x: x != "").alias("aliases"),
    )
    phrases = F.filter(F.concat(F.array("label", "slug"), F.col("aliases")), lambda x: x != "")
    usable = lambda x: (F.length(x) >= 4) & ~x.isin(vocab.UNIT_GENERIC)
    named = named.withColumn("words", F.array_distinct(F.filter(F.flatten(F.transform(phrases, lambda p: F.split(p, " "))), usable)))
    named = named.withColumn("anchors", F.array_distinct(F.concat("words", F.transform(phrases, _anchor))))
    row = F.struct("topic_ord", "topic_slug", "topic_label", "unit_slug", "kind", "label", "slug", "aliases", "words", "anchors")
    return named.groupBy("course_id").agg(F.array_sort(F.collect_list(row)).alias("__topics"), F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("__keys"))


def topic_candidates(entries: DataFrame, topics: DataFrame, rest: int = 2) -> DataFrame:
    """Each document (`signals`) with its course's best topics as `topics`: struct(neg, topic_ord, topic_slug, topic_label,
    unit_slug, n_tokens), best first (neg is the score below zero), and the number of the course's topics. [J4]

    All topics that share a word or a phrase anchor with the document are there; of the others, which only differ by
    their kind, the first `rest` of each kind. `topics` is null where the course has none. The lead has no anchors of its
    own: it stands in the body.
    """
    fields = [f for f in TOPIC_WEIGHTS]
    df = entries.withColumns({"__joined": F.concat_ws(" | ", *(f"s_{f}" for f in fields if f != "lead")), **{f"x_{f}": F.concat(F.lit(" "), f"s_{f}", F.lit(" ")) for f in fields}})
    course = topic_index(topics)
    course = course.withColumns({"__words": F.filter("__keys", lambda k: ~k.contains(" ")), "__spaced": F.filter("__keys", lambda k: k.contains(" "))}).drop("__keys")
    df = with_course(df, topics, course, "s_body", "left")
    spaced = F.when(F.size("__spaced") <= FEW_ANCHORS, F.filter("__spaced", lambda k: F.col("__joined").contains(k))).otherwise(F.array_intersect(_anchors(F.col("__joined")), "__spaced"))
    df = df.withColumn("__hits", F.concat(F.array_intersect(F.split("__joined", " "), "__words"), spaced)).drop("__joined", "__words", "__spaced")
    near = lambda t: F.arrays_overlap(t["anchors"], F.col("__hits")) | (F.size(t["words"]) == 0)
    df = df.withColumns({"__near": F.filter("__topics", near), "__far": F.filter("__topics", lambda t: ~near(t)), "__n": F.size("__topics")})

    def held(field: str, phrase: Column) -> Column:
        text = F.col(f"x_{field}")
        return F.when(F.instr(phrase, " ") > 0, text.contains(phrase)).otherwise((F.length(phrase) >= 4) & text.contains(F.concat(F.lit(" "), phrase, F.lit(" "))))

    def exact(t: Column) -> Column:
        score = F.lit(0.0)
        for f, w in TOPIC_WEIGHTS.items():
            score = score + held(f, t["label"]).cast("int") * w + held(f, t["slug"]).cast("int") * (w * SLUG_SHARE) + F.size(F.filter(t["aliases"], partial(held, f))) * (w * ALIAS_SHARE)
        return score

    facts = lambda t, e, n: F.struct(t.alias("t"), e.alias("exact"), n.alias("shared"))
    scored = F.transform("__near", lambda t: facts(t, exact(t), F.size(F.array_intersect(t["words"], F.col("__hits")))))
    subtopic = lambda t: F.coalesce(t["kind"] == "subtopic", F.lit(False))
    for far in (F.filter("__far", subtopic), F.filter("__far", lambda t: ~subtopic(t))):
        scored = F.concat(scored, F.transform(F.slice(far, 1, rest), lambda t: facts(t, F.lit(0.0), F.lit(0))))

    def points(x: Column) -> Column:
        t, exact, shared, n = x["t"], x["exact"], x["shared"], F.size(x["t"]["words"])
        bonus = F.when(n == 1, F.when(shared > 0, 0.9).otherwise(0.0)).when(shared >= n, 1.4 + 0.22 * shared).when(shared >= 2, 0.9 + 0.18 * shared).when(shared == 1, 0.25).otherwise(0.0)
        raw = exact + bonus + F.when(F.col("s_category").isin("listas", "gabaritos") & (shared > 0), 0.08).otherwise(0.0) + F.when(subtopic(t), 0.04).otherwise(0.0)
        damp = F.when((exact == 0) & (raw > 0), 0.72).otherwise(1.0) * F.when((exact == 0) & (shared <= 1), 0.68).otherwise(1.0)
        damp = damp * F.when((F.col("s_auto_tags") != "") & (exact == 0) & (shared <= 1), 0.88).otherwise(1.0) * F.when((F.col("s_legacy_tags") != "") & (exact == 0), 0.9).otherwise(1.0)
        named = (t["label"] != "") | (t["slug"] != "") | (F.size(t["aliases"]) > 0)
        score = F.when(named, raw * damp).otherwise(0.0)
        return F.struct((-score).alias("neg"), t["topic_ord"].alias("topic_ord"), t["topic_slug"].alias("topic_slug"), t["topic_label"].alias("topic_label"), t["unit_slug"].alias("unit_slug"), n.alias("n_tokens"))

    return df.withColumn("__scored", scored).select(*entries.columns, F.array_sort(F.transform("__scored", points)).alias("topics"), F.col("__n").alias("n_topics"))


def topic_scores(entries: DataFrame, topics: DataFrame, rest: int = 2) -> DataFrame:
    """`topic_candidates` as rows: the document with topic_ord, topic_slug, topic_label, unit_slug, n_tokens and score. [J4]"""
    rows = topic_candidates(entries, topics, rest).select(*entries.columns, F.inline_outer("topics")).filter("topic_ord is not null")
    return rows.withColumn("score", -F.col("neg")).drop("neg")


#: k, gap, floor of a single candidate, cap of an ambiguous one, least score: by kind of match (fixed values).
WINNER = {"topic": (0.2, 0.65, 0.72, 0.45, None), "unit": (0.18, 0.8, 0.7, 0.4, None), "session": (0.18, 0.35, 0.72, 1.0, 1.0), "block": (0.18, 0.35, 0.0, 1.0, 1.0)}


def verdict(best: Column, second: Column, n: Column, kind: str) -> Column:
    """struct(confidence, ambiguous) of the best of n candidates; of periods a single one too must lead by the gap. [W1]"""
    k, gap, floor, cap, least = WINNER[kind]
    close = F.abs(best - second) < gap
    ambiguous = (best <= 0) | ((n > 1) & close) if least is None else (best < least) | close
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), best - second + k * best))
    conf = F.when((n == 1) & ~ambiguous, F.greatest(conf, F.lit(floor))).otherwise(conf)
    return F.struct(F.when(ambiguous, F.least(conf, F.lit(cap))).otherwise(conf).alias("confidence"), ambiguous.alias("ambiguous"))


def best_topic(candidates: DataFrame) -> DataFrame:
    """`topic_candidates` with the best topic: topic_slug, topic_label, topic_unit, best, second, confidence, ambiguous. [W1]"""
    first = F.get("topics", F.lit(0))
    df = candidates.withColumns({"best": -first["neg"], "second": F.coalesce(-F.get("topics", F.lit(1))["neg"], F.lit(0.0))})
    df = df.withColumn("__v", verdict(F.col("best"), F.col("second"), F.col("n_topics"), "topic"))
    named = {"topic_slug": first["topic_slug"], "topic_label": first["topic_label"], "topic_unit": first["unit_slug"]}
    return df.withColumns({**named, "confidence": F.col("__v.confidence"), "ambiguous": F.col("__v.ambiguous")}).drop("__v")


def winner(scored: DataFrame, key: list[str], kind: str, order: str, keep: list[str], score: str = "score") -> DataFrame:
    """Per key the best candidate of a frame of pairs: `keep` columns, best, second, confidence, ambiguous. [W1]

    A tie goes to the smaller `order`. One pass of partial aggregation keeps the two best, so no key's candidates are
    gathered in one task.
    """
    row = F.struct((-F.col(score)).alias("neg"), F.col(order).alias("__o"), *keep)
    best = scored.groupBy(*key).agg(F.min(row).alias("w"), F.count("*").alias("n"))
    second = scored.join(best.select(*key, F.col("w.__o").alias("__ord")), key).filter(F.col(order) != F.col("__ord")).groupBy(*key).agg(F.max(score).alias("second"))
    out = best.join(second, key, "left").withColumn("best", -F.col("w.neg")).withColumn("second", F.coalesce("second", F.lit(0.0)))
    v = verdict(F.col("best"), F.col("second"), F.col("n"), kind)
    return out.withColumn("__v", v).select(*key, *(F.col(f"w.{c}").alias(c) for c in keep), "best", "second", "__v.confidence", "__v.ambiguous")


# units

def unit_index(units: DataFrame) -> DataFrame:
    """Per unit: phrases, words, token weights (1 / units of the course that have it), distinctive tokens, anchors. [A1]

    units: course_id, unit_ord, unit_slug, unit_title, topics (array of texts), and extra_signals (the same) if it has it.
    """
    extra = F.coalesce("extra_signals", _empty()) if "extra_signals" in units.columns else _empty()
    phrases = F.filter(F.transform(F.concat(F.coalesce("topics", _empty()), extra), lambda x: match_text(x)), lambda x: x != "")
    df = units.withColumns({"normalized_title": match_text("unit_title"), "phrases": phrases, "n_extra": F.size(extra)})
    words_of = lambda p, skip: F.filter(F.split(p, " "), lambda x: (F.length(x) >= 4) & ~x.isin(skip))
    single = F.filter("phrases", lambda p: F.instr(p, " ") == 0)
    df = df.withColumns({
        "parts": F.transform("phrases", lambda p: words_of(p, vocab.UNIT_NEUTRAL)),
        "words": F.array_distinct(F.concat(single, F.flatten(F.transform("phrases", lambda p: words_of(p, vocab.UNIT_GENERIC))))),
        "title_anchors": F.array_distinct(words_of(F.col("normalized_title"), ["unidade", "aprendizagem", "verificacao"])),
        "topic_anchors": F.array_distinct(F.flatten(F.transform("phrases", lambda p: words_of(p, ["para", "sobre", "entre"])))),
        "__counted": F.filter(F.array_distinct(F.flatten(F.transform(F.concat(F.array("normalized_title"), F.col("phrases")), lambda p: words_of(p, vocab.UNIT_GENERIC)))), lambda x: ~x.rlike(r"^\d+$")),
    })
    each = df.select("course_id", "unit_ord", F.explode("__counted").alias("token"))
    weights = each.join(each.groupBy("course_id", "token").agg(F.count("*").alias("df")), ["course_id", "token"])
    maps = weights.groupBy("course_id", "unit_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", (1.0 / F.col("df")).alias("w"))))).alias("token_weights"), F.sort_array(F.collect_list(F.when((F.col("df") == 1) & (F.length("token") >= 5), F.col("token")))).alias("distinctive"))
    empty_map = F.expr("cast(map() as map<string,double>)")
    return df.drop("__counted").join(maps, ["course_id", "unit_ord"], "left").withColumns({"token_weights": F.coalesce("token_weights", empty_map), "distinctive": F.coalesce("distinctive", _empty())})


def unit_arrays(units: DataFrame) -> DataFrame:
    """Per course its units (`unit_index`) in order as `__units`, and all their tokens as `__keys`."""
    named = F.zip_with("phrases", "parts", lambda p, w: F.struct(p.alias("p"), w.alias("words")))
    title = F.filter(F.split("normalized_title", " "), lambda x: (F.length(x) >= 4) & ~x.isin(vocab.UNIT_NEUTRAL))
    row = F.struct("unit_ord", "unit_slug", F.struct(F.col("normalized_title").alias("p"), title.alias("words")).alias("title"), named.alias("phrases"), "words", "token_weights", "distinctive", "title_anchors", "topic_anchors", "n_extra")
    every = F.concat("words", "distinctive", "title_anchors", "topic_anchors", F.flatten(F.transform("phrases", lambda p: F.split(p, " "))), F.split("normalized_title", " "))
    course = units.groupBy("course_id").agg(F.collect_list(row).alias("__u"), F.array_distinct(F.flatten(F.collect_list(every))).alias("__keys"))
    order = lambda a, b: F.when(a["unit_ord"] < b["unit_ord"], -1).when(a["unit_ord"] > b["unit_ord"], 1).otherwise(0)
    return course.select("course_id", F.array_sort("__u", order).alias("__units"), "__keys")


def weight_of(unit: Column, token: Column) -> Column:
    """The weight of a token for a unit, 1 where it has none."""
    return F.coalesce(F.element_at(unit["token_weights"], token), F.lit(1.0))


def phrase_points(text: Column, held: Column, unit: Column, phrase: Column) -> Column:
    """Points of a unit's phrase (struct of p and its words) in a match text of which `held` are the tokens: whole, or by
    its words. [J5, J6]"""
    words = phrase["words"]
    hits = F.filter(words, lambda x: F.array_contains(held, x))
    weight = F.aggregate(hits, F.lit(0.0), lambda a, t: a + weight_of(unit, t))
    by_words = F.when(F.size(words) == 1, 1.15 * weight).when(F.size(hits) == F.size(words), 1.15 + 0.95 * weight).when(F.size(hits) >= 2, 0.85 * weight).otherwise(0.0)
    return F.when(phrase["p"] == "", 0.0).when(text.contains(phrase["p"]), 3.8).when(F.arrays_overlap(words, held), by_words).otherwise(0.0)


def unit_candidates(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Each document (`signals`) with its course's units as `units`: struct(neg, unit_ord, unit_slug, topic_score), best
    first. [J5] units: `unit_index`. Where the frame has `topics` (`topic_candidates`), a unit's best topic adds to it.
    """
    df = with_course(entries, units, unit_arrays(units), "s_body", "left")
    # of a text's tokens only those of the course's units: arrays of a few words
    df = df.withColumns({f"h_{f}": F.array_intersect(tokens(f"s_{f}"), "__keys") for f in (*TOKEN_WEIGHTS, "tags")})
    df = df.withColumn("h_any", F.array_distinct(F.concat(*(f"h_{f}" for f in TOKEN_WEIGHTS))))
    held = lambda f, t: F.array_contains(f"h_{f}", t)

    def score(u: Column) -> Column:
        title = u["title"]["p"]
        long_title = F.size(F.filter(F.split(title, " "), lambda x: F.length(x) >= 5)) >= 3
        total = sum((F.when(long_title & F.col(f"s_{f}").contains(title), p).otherwise(0.0) for f, p in (("body", 1.1), ("lead", 1.6), ("headings", 1.8), ("title", 1.0))), F.lit(0.0))
        rung = lambda p: F.coalesce(*(F.when(F.col(f"s_{f}").contains(p), w) for f, w in PHRASE_LADDER))
        parts = lambda p: sum((phrase_points(F.col(f"s_{f}"), F.col(f"h_{f}"), u, p) * w for f, w in PHRASE_SHARES.items()), F.lit(0.0))
        # the whole raw text aside, a phrase without one of its words anywhere gives nothing
        some = lambda p: F.arrays_overlap(p["words"], F.col("h_any")) | F.col("s_raw").contains(p["p"])
        phrases = F.transform(u["phrases"], lambda p: F.struct(rung(p["p"]).alias("whole"), p.alias("p")))
        total = total + F.aggregate(phrases, F.lit(0.0), lambda a, x: a + F.when(x["whole"].isNotNull(), x["whole"]).when(some(x["p"]), parts(x["p"])).otherwise(0.0))
        exact = F.size(F.filter(phrases, lambda x: x["whole"].isNotNull()))
        share = lambda t: sum((F.when(held(f, t), w).otherwise(0.0) for f, w in TOKEN_WEIGHTS.items()), F.lit(0.0))
        weighed = F.transform(F.array_intersect(u["words"], F.col("h_any")), lambda t: F.struct(t.alias("t"), share(t).alias("s")))
        total = total + F.aggregate(weighed, F.lit(0.0), lambda a, x: a + F.when(x["s"] > 0, x["s"] * weight_of(u, x["t"]) * F.when(x["t"].isin(vocab.UNIT_NEUTRAL), 0.2).otherwise(1.0)).otherwise(0.0))
        matched = F.transform(F.filter(weighed, lambda x: (x["s"] > 0) & ~x["t"].isin(vocab.UNIT_NEUTRAL)), lambda x: x["t"])
        # a distinctive token gives more at the first field that holds it if no earlier rule matched it
        rare = F.filter(u["distinctive"], lambda t: held("body", t) | held("title", t) | held("tags", t) | held("raw", t))

        def fresh(t: Column) -> Column:
            points, before = F.lit(0.0), F.array_contains(matched, t)
            for field, again, first in DISTINCT_POINTS:
                points = points + F.when(held(field, t), F.when(before, again).otherwise(first)).otherwise(0.0)
                before = before | held(field, t)
            return points

        total = total + F.aggregate(rare, F.lit(0.0), lambda a, t: a + fresh(t))
        total = total + F.when(F.col("s_category").isin("listas", "gabaritos"), 0.15).otherwise(0.0)
        total = total + F.when(F.col("s_manual_tags") != "", 0.06).when((F.col("s_auto_tags") != "") | (F.col("s_legacy_tags") != ""), 0.01).otherwise(0.0)
        return F.struct(total.alias("raw"), exact.alias("exact"), F.size(F.array_union(matched, rare)).alias("matched"))

    damp = lambda x: F.when((x["exact"] == 0) & (x["matched"] == 0) & (x["raw"] > 0), 0.55).when((x["exact"] == 0) & (x["matched"] == 1), 0.45).otherwise(1.0)
    with_topics = "topics" in entries.columns

    def boosted(x: Column) -> Column:
        u, topic = x["u"], F.lit(0.0)
        if with_topics:
            own = F.transform(F.filter("topics", lambda t: t["unit_slug"] == u["unit_slug"]), lambda t: -t["neg"])
            topic = F.greatest(F.lit(0.0), F.coalesce(F.array_max(own), F.lit(0.0)))
        score = x["s"]["raw"] * damp(x["s"]) + F.when(topic >= 0.25, 0.85 * topic).otherwise(0.0)
        return F.struct((-score).alias("neg"), u["unit_ord"].alias("unit_ord"), u["unit_slug"].alias("unit_slug"), topic.alias("topic_score"))

    scored = F.transform("__units", lambda u: F.struct(u.alias("u"), score(u).alias("s")))
    return df.withColumn("__scored", scored).select(*entries.columns, F.array_sort(F.transform("__scored", boosted)).alias("units"))


def unit_scores(entries: DataFrame, units: DataFrame) -> DataFrame:
    """`unit_candidates` as rows: the document with unit_ord, unit_slug, topic_score and score. [J5]"""
    return unit_candidates(entries, units).select(*entries.columns, F.inline_outer("units")).filter("unit_ord is not null").withColumn("score", -F.col("neg")).drop("neg")


def best_unit(candidates: DataFrame) -> DataFrame:
    """`unit_candidates` with the best unit as unit_slug, unit_best, unit_confidence and unit_ambiguous. [W1]

    A best topic of the winner's that is sure and ahead of the runner-up's settles a close race.
    """
    first, after = F.get("units", F.lit(0)), F.get("units", F.lit(1))
    df = candidates.withColumns({"__best": -first["neg"], "__second": F.coalesce(-after["neg"], F.lit(0.0)), "__topic": first["topic_score"], "__ahead": first["topic_score"] - F.coalesce(after["topic_score"], F.lit(0.0))})
    df = df.withColumn("__v", verdict(F.col("__best"), F.col("__second"), F.size("units"), "unit"))
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__best") - F.col("__second") + WINNER["unit"][0] * F.col("__best")))
    settled = (F.size("units") > 1) & (F.col("__topic") >= 0.55) & (F.col("__ahead") >= 0.01)
    out = df.withColumns({
        "unit_slug": first["unit_slug"], "unit_best": F.col("__best"), "unit_ambiguous": ~settled & F.col("__v.ambiguous"),
        "unit_confidence": F.when(settled, F.greatest(raw, F.least(F.lit(0.95), F.col("__topic")))).otherwise(F.col("__v.confidence")),
    })
    return out.drop("__best", "__second", "__topic", "__ahead", "__v")


# schedule rows, blocks and sessions

def overlap_points(a: Column, b: Column) -> Column:
    """Points of two tokens: equal 1, one inside the other 0.45, the same five first letters 0.2. [J7]"""
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.45).when((F.length(a) >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 5) == F.substring(b, 1, 5)), 0.2).otherwise(0.0)


def related_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a course's tokens (course_id, token; course_id, row_token) that have points, once each, with `p`. [J7]

    Tokens have four letters or more, so of a pair with points one has the first four of the other somewhere in it: the
    join is on the course and four letters, over distinct tokens.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(F.col(c), i, F.lit(4))))
    left, right = left.select("course_id", "token").distinct(), right.select("course_id", "row_token").distinct()
    one = left.withColumn("g", F.explode(grams("token"))).join(right.withColumn("g", F.substring("row_token", 1, 4)), ["course_id", "g"])
    two = left.withColumn("g", F.substring("token", 1, 4)).join(right.withColumn("g", F.explode(grams("row_token"))), ["course_id", "g"])
    pairs = one.union(two.select(*one.columns)).select("course_id", "token", "row_token").distinct()
    return pairs.withColumn("p", overlap_points(F.col("token"), F.col("row_token"))).filter("p > 0")


def overlap_scores(entries: DataFrame, rows: DataFrame, key: list[str], fields: dict[str, float]) -> DataFrame:
    """Each entry with each row of its course that it shares points with, and their weighted sum `score`. [J7]

    entries: key, course_id, texts of `fields` (normalised); rows: course_id, row_index, row_tokens. An entry's tokens
    are counted first, and meet rows by equality through `related_tokens`.
    """
    counted = None
    for field, weight in fields.items():
        part = entries.select("course_id", *key, F.explode(tokens(field)).alias("token")).groupBy("course_id", *key, "token").agg((F.count("*") * weight).alias("w"))
        counted = part if counted is None else counted.unionByName(part)
    counted = staged(counted.groupBy("course_id", *key, "token").agg(F.sum("w").alias("w")), "counted")  # texts are cut into words once
    words = rows.select("course_id", "row_index", F.explode("row_tokens").alias("row_token")).filter(F.length("row_token") >= 4)
    by_word = counted.join(related_tokens(counted, words), ["course_id", "token"]).groupBy("course_id", *key, "row_token").agg(F.sum(F.col("p") * F.col("w")).alias("p"))
    return by_word.join(words, ["course_id", "row_token"]).groupBy("course_id", *key, "row_index").agg(F.sum("p").alias("score"))


#: Weights of an entry's texts for a schedule row, and what tells exercises and guided reading (fixed values).
ROW_WEIGHTS = {"s_title": 1.25, "s_body": 1.0, "s_raw": 0.65, "s_tags": 0.35, "s_category": 0.2}
EXERCISE_WORDS = ["exercicio", "exercicios", "lista", "listas", "gabarito", "respostas"]
READING_WORDS = ["atividade assincrona", "complementar os estudos", "leituras recomendadas"]


def is_exercise(fields: list[str] | None = None) -> Column:
    """Whether any of an entry's texts holds a word of exercises. [J7, J8]"""
    return F.concat_ws(" ", *(fields or list(ROW_WEIGHTS))).rlike("|".join(EXERCISE_WORDS))


def row_bonus(row: Column, exercise: Column) -> Column:
    """What a schedule row gives every entry, by whether that is an exercise. [J7]"""
    own = F.when(row.rlike("|".join(EXERCISE_WORDS)), 0.25 + F.when(exercise, 1.25).otherwise(0.0)).when(exercise, -0.2).otherwise(0.0)
    return own + F.when(row.rlike("|".join(READING_WORDS)), 0.15).otherwise(0.0) + F.when(exercise & row.contains("estudo de caso"), 0.35).otherwise(0.0)


def inside_scores(entries: DataFrame, rows: DataFrame, key: list[str], fields: dict[str, float]) -> DataFrame:
    """Points of entries whose whole text of a field stands inside a row (course_id, row_index, content_norm). [J7]

    A text meets rows by its first three letters (or all it has); none that is longer than the longest row can stand there.
    """
    longest = rows.agg(F.max(F.length("content_norm"))).first()[0] or 0
    # a longer text is not even copied
    fits = lambda f: (F.octet_length(f) > 0) & (F.octet_length(f) <= longest * 4) & (F.length(f) <= longest)
    texts = F.filter(F.array(*(F.when(fits(f), F.struct(F.col(f).alias("text"), F.lit(float(w)).alias("w"))) for f, w in fields.items())), lambda x: x.isNotNull())
    each = entries.select("course_id", *key, F.inline(texts)).withColumn("g", F.substring("text", 1, 3))
    of_size = lambda n: F.when(F.length("content_norm") >= n, F.transform(F.sequence(F.lit(1), F.length("content_norm") - (n - 1)), lambda i: F.substring(F.col("content_norm"), i, F.lit(n)))).otherwise(_empty())
    grams = F.array_distinct(F.concat(of_size(1), of_size(2), of_size(3)))
    hit = each.join(rows.select("course_id", "row_index", "content_norm", F.explode(grams).alias("g")), ["course_id", "g"]).filter(F.col("content_norm").contains(F.col("text")))
    points = F.least(F.lit(1.5), F.greatest(F.lit(0.35), F.length("text") / 18.0)) * F.col("w")
    return hit.groupBy("course_id", *key, "row_index").agg(F.sum(points).alias("score"))


def row_scores(entries: DataFrame, rows: DataFrame, key: list[str], fields: dict[str, float] | None = None) -> DataFrame:
    """Each entry with each schedule row of its course that it has text points for: `score`, without `row_bonus`. [J7]

    entries: key, course_id and the texts of `fields`; rows: course_id, row_index, content_norm.
    """
    fields = fields or ROW_WEIGHTS
    worded = rows.select("course_id", "row_index", tokens("content_norm").alias("row_tokens"))
    both = overlap_scores(entries, worded, key, fields).unionByName(inside_scores(entries, rows, key, fields))
    return both.groupBy("course_id", *key, "row_index").agg(F.sum("score").alias("score"))


def block_scores(pairs: DataFrame, blocks: DataFrame, rows: DataFrame, scored_rows: DataFrame, key: list[str], tag_scores: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """Candidate pairs of entries and blocks with `score`. [J8]

    pairs: key, course_id, block_id, exercise (boolean), preferred_unit, preferred_topic; blocks: course_id, block_id,
    block_unit, unit_confidence, primary_topic_slug, primary_topic_confidence, topic_slugs (array); rows: course_id,
    block_id, row_index, content_norm, ignored; scored_rows: `row_scores`; tag_scores: entries' tags against topic texts
    (key, course_id, block_id, tag_score); cards: key, course_id, block_id, card_score. Ignored rows do not count; the
    first row that does is the anchor (1.15), the others together give 0.18 of their points up to 2.25.
    """
    live = rows.filter(~F.coalesce("ignored", F.lit(False)))
    anchor = live.groupBy("course_id", "block_id").agg(F.min("row_index").alias("__first"))
    live = live.join(anchor, ["course_id", "block_id"]).select("course_id", "block_id", "row_index", "content_norm", (F.col("row_index") == F.col("__first")).alias("anchor"))
    live = live.withColumns({f"b{e}": row_bonus(F.col("content_norm"), F.lit(bool(e))) for e in (0, 1)}).withColumn("has", F.col("content_norm").rlike("|".join(EXERCISE_WORDS)))
    stats = [x for e in (0, 1) for x in (F.sum(F.when(F.col("anchor"), F.col(f"b{e}"))).alias(f"a{e}"), F.sum(F.when(~F.col("anchor"), F.greatest(F.lit(0.0), F.col(f"b{e}"))).otherwise(0.0)).alias(f"r{e}"))]
    known = live.groupBy("course_id", "block_id").agg(*stats, F.count_if(~F.col("anchor") & F.col("has")).alias("n_has"))
    # rows that have points meet their block and then the pair: never each entry with each row of its course
    by_row = scored_rows.join(live.drop("has"), ["course_id", "row_index"]).join(pairs.select("course_id", *key, "block_id", "exercise"), ["course_id", *key, "block_id"])
    bonus = F.when(F.col("exercise"), F.col("b1")).otherwise(F.col("b0"))
    more = F.greatest(F.lit(0.0), F.col("score") + bonus) - F.greatest(F.lit(0.0), bonus)
    text = by_row.groupBy("course_id", *key, "block_id").agg(F.sum(F.when(F.col("anchor"), F.col("score")).otherwise(0.0)).alias("ta"), F.sum(F.when(F.col("anchor"), 0.0).otherwise(more)).alias("tr"))
    out = pairs.join(blocks, ["course_id", "block_id"]).join(known, ["course_id", "block_id"], "left").join(text, ["course_id", *key, "block_id"], "left")
    for side, name in ((tag_scores, "tag_score"), (cards, "card_score")):
        out = out.withColumn(name, F.lit(0.0)) if side is None else out.join(side, ["course_id", *key, "block_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    own = lambda c: F.when(F.col("exercise"), zero(f"{c}1")).otherwise(zero(f"{c}0"))
    score = 1.15 * (own("a") + zero("ta")) + F.least(F.lit(2.25), 0.18 * (own("r") + zero("tr"))) + F.when(F.col("exercise"), F.least(F.lit(0.66), 0.22 * F.coalesce("n_has", F.lit(0)))).otherwise(0.0)
    score = score + 2 * F.least(F.lit(0.45), F.col("card_score")) + F.col("tag_score")
    unit, topic = F.coalesce("block_unit", F.lit("")), F.coalesce("primary_topic_slug", F.lit(""))
    score = score + F.when(F.col("preferred_unit") == "", 0.0).when(unit == F.col("preferred_unit"), 0.35 + 0.25 * zero("unit_confidence")).when(unit != "", -0.45).otherwise(0.0)
    listed = F.coalesce(F.array_contains("topic_slugs", F.col("preferred_topic")), F.lit(False))
    score = score + F.when(F.col("preferred_topic") == "", 0.0).when(topic == F.col("preferred_topic"), 0.8 + 0.35 * zero("primary_topic_confidence")).when(listed, 0.48).when(topic != "", -0.18).otherwise(0.0)
    return out.withColumn("score", F.when(F.col("a0").isNull(), 0.0).otherwise(score)).select(*pairs.columns, "score", "card_score")


def session_scores(pairs: DataFrame, sessions: DataFrame, key: list[str], text_scores: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """Candidate pairs of entries and blocks with each session of the block: session_id, ord, score, session_card. [J9]

    pairs: key, course_id, block_id, dates array<date>, start, end, says_async, says_class (booleans); sessions:
    course_id, block_id, session_id, ord, date, kind; text_scores: entries' whole text against the sessions' words (key,
    course_id, session_id, score); cards: key, course_id, session_id, card_score. A date that both have gives 3, one
    inside the entry's range 2.2, an asynchronous session 0.9 if the entry says so, a dated class 0.15 likewise.
    """
    out = pairs.join(sessions, ["course_id", "block_id"])
    for side, name in ((text_scores, "score"), (cards, "card_score")):
        out = out.withColumn(f"__{name}", F.lit(0.0)) if side is None else out.join(side.withColumnRenamed(name, f"__{name}"), ["course_id", *key, "session_id"], "left")
    dated = F.when(F.array_contains("dates", F.col("date")), 3.0).when(F.col("date").between(F.col("start"), F.col("end")), 2.2).otherwise(0.0)
    kind = F.when((F.col("kind") == "async") & F.col("says_async"), 0.9).when((F.col("kind") == "class") & F.col("date").isNotNull() & F.col("says_class"), 0.15).otherwise(0.0)
    card = F.least(F.lit(0.55), F.coalesce("__card_score", F.lit(0.0)))
    score = F.coalesce("__score", F.lit(0.0)) + F.when(F.col("date").isNull(), 0.0).otherwise(dated) + kind + card
    return out.select(*pairs.columns, "session_id", "ord", score.alias("score"), card.alias("session_card"))


ASYNC_WORDS, CLASS_WORDS = ["assincrona", "assincrono", "async"], ["aula", "semana", "dia"]


def temporal_signals(norm: Column, raw: Column) -> dict[str, Column]:
    """Columns dates, start, end, says_async and says_class of an entry from its match text and its text. [J9]"""
    span = date_range_signal(F.when(may_hold_date(raw), raw))
    of_sessions = F.when(may_hold_date(raw), session_dates(raw)).otherwise(F.array().cast("array<date>"))
    dates = F.array_distinct(F.filter(F.concat(of_sessions, F.array(span["start"], span["end"])), lambda x: x.isNotNull()))
    return {"dates": dates, "start": span["start"], "end": span["end"], "says_async": norm.rlike("|".join(ASYNC_WORDS)), "says_class": norm.rlike("|".join(CLASS_WORDS))}


def period_winner(scored: DataFrame, sessions: DataFrame, key: list[str]) -> DataFrame:
    """The block of each entry with its period: by sessions, else by the blocks themselves. [W1]

    scored: key, block_id, block_ord, period_label, score; sessions: key, block_id, session_score and session_card of the
    block's best session. Blocks whose best session reaches 1 compete by session, block and card score; without any, all
    compete by their own score, of which 0.95 is the least. Returns key, block_id, period, confidence, ambiguous,
    by_session; the period is empty where none holds.
    """
    rows = scored.join(sessions, [*key, "block_id"], "left").withColumn("by_session", F.coalesce(F.col("session_score") >= 1.0, F.lit(False)))
    first = lambda a, b: (-F.when(F.col("by_session"), a).otherwise(b))
    rank = F.struct((~F.col("by_session")).alias("rest"), first(F.col("session_score"), F.col("score")).alias("neg"), first(F.col("score"), F.lit(0.0)).alias("n2"), first(F.coalesce("session_card", F.lit(0.0)), F.lit(0.0)).alias("n3"), "block_ord", "block_id", "period_label")
    # an entry's candidates are the blocks of one unit of its course: a short list
    best = rows.groupBy(*key).agg(F.array_sort(F.collect_list(rank)).alias("r"))
    one, two = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    same = two.isNotNull() & (two["rest"] == one["rest"])
    df = best.select(*key, one.alias("w"), (-one["neg"]).alias("best"), F.when(same, -two["neg"]).otherwise(0.0).alias("second"), F.size(F.filter("r", lambda x: x["rest"] == F.get("r", F.lit(0))["rest"])).alias("n"))
    low = F.when(F.col("w.rest"), F.col("best") < 0.95).otherwise(F.col("best") < 1.0) | (F.coalesce("w.period_label", F.lit("")) == "")
    v = F.when(F.col("w.rest"), verdict(F.col("best"), F.col("second"), F.col("n"), "block")).otherwise(verdict(F.col("best"), F.col("second"), F.col("n"), "session"))
    return df.withColumns({"__v": v, "__low": low}).select(*key, "w.block_id", F.when(F.col("__low"), "").otherwise(F.col("w.period_label")).alias("period"), F.when(F.col("__low"), F.col("best")).otherwise(F.col("__v.confidence")).alias("confidence"), (F.col("__low") | F.col("__v.ambiguous")).alias("ambiguous"), (~F.col("w.rest")).alias("by_session"))


def _months(start: Column, end: Column) -> tuple[Column, Column]:
    """The first and the last month of a range, counted from year 0; null where an end is."""
    month = lambda d: F.year(d) * 12 + F.month(d)
    known = start.isNotNull() & end.isNotNull()
    return F.when(known, month(F.least(start, end))), F.when(known, month(F.greatest(start, end)))


def period_blocks(docs: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """Blocks that go with a document's period: equal labels first (tier 0), else overlapping ones (1), else all of the
    course (2). [J24]

    docs: key, course_id, start, end, period_label; blocks: course_id, block_id, period_start, period_end, period_label.
    Labels meet by equality. Ranges are cut into months and meet by course and month, each pair in its first common month.
    Only documents that are left over take the course's list, which meets each of them as one row.
    """
    b = blocks.withColumnRenamed("period_label", "block_label")
    named = docs.join(b.select("course_id", "block_id", F.col("block_label").alias("period_label")), ["course_id", "period_label"]).select(*docs.columns, "block_id", F.lit(0).alias("tier"))
    rest = docs.join(named.select(*key).distinct(), key, "left_anti").select(*docs.columns)
    by_month = lambda df, a, z, name: df.withColumns(dict(zip((f"__{name}", f"__{name}_last"), _months(F.col(a), F.col(z)), strict=True))).withColumn("__month", F.explode(F.sequence(f"__{name}", f"__{name}_last"))).drop(f"__{name}_last")
    left = by_month(rest.filter("start is not null and end is not null"), "start", "end", "d")
    right = by_month(b.filter("period_start is not null and period_end is not null"), "period_start", "period_end", "b").select("course_id", "block_id", "period_start", "period_end", "__b", "__month")
    met = left.join(right, ["course_id", "__month"]).filter((F.col("__month") == F.greatest("__d", "__b")) & (F.col("start") <= F.col("period_end")) & (F.col("period_start") <= F.col("end")))
    over = met.select(*docs.columns, "block_id", F.lit(1).alias("tier"))
    alone = rest.join(over.select(*key).distinct(), key, "left_anti").select(*docs.columns)
    course = b.groupBy("course_id").agg(F.collect_list("block_id").alias("__blocks"))
    every = with_course(alone, b, course, key[0]).select(*docs.columns, F.explode("__blocks").alias("block_id"), F.lit(2).alias("tier"))
    return named.unionByName(over).unionByName(every)


#: Weights of a document's fields for a block's text (fixed values).
RECONCILE_WEIGHTS = {"s_title": 1.25, "s_tags": 1.05, "s_headings": 0.95, "s_lead": 0.75, "s_body": 0.18}


def reconcile_texts(entries: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """Documents (`signals`) with the blocks whose text they share points with: key, course_id, block_id, text_score. [J25]

    blocks: course_id, block_id, text_norm (label of the topic, topic text, topics and aliases as one match text).
    """
    rows = blocks.select("course_id", F.col("block_id").alias("row_index"), tokens("text_norm").alias("row_tokens"))
    scored = overlap_scores(entries, rows, key, RECONCILE_WEIGHTS)
    return scored.select("course_id", *key, F.col("row_index").alias("block_id"), F.col("score").alias("text_score"))


def reconcile(pairs: DataFrame, key: list[str]) -> DataFrame:
    """The best block of an already mapped document, with `review` where the next one is closer than 0.2. [J25]

    pairs: key, block_id, block_ord, same_unit (boolean, null if the document has none), tier (of `period_blocks`),
    text_score (`reconcile_texts`, 0 where absent), unit_confidence, topic_confidence.
    """
    score = F.when(F.col("same_unit"), 1.25).when(~F.col("same_unit"), -0.35).otherwise(0.0) + F.when(F.col("tier") == 0, 0.85).when(F.col("tier") == 1, 0.45).otherwise(0.0) + F.col("text_score") + 0.25 * F.col("unit_confidence") + 0.1 * F.col("topic_confidence")
    w = W.partitionBy(*key).orderBy(F.desc("score"), "block_ord")
    ranked = pairs.withColumn("score", score).withColumns({"__n": F.row_number().over(w), "__next": F.lead("score").over(w)})
    return ranked.filter("__n = 1").select(*key, "block_id", "score", (F.round(F.col("score") - F.coalesce("__next", F.lit(-1e9)), 9) < 0.2).alias("review"))


def card_hits(texts: DataFrame, cards: DataFrame, key: list[str]) -> DataFrame:
    """The cards (course_id, card_norm, kind) that texts (key, course_id, text_norm) hold something of: key, course_id, hits
    array<struct(card_norm, kind, points)>; texts without any are left out. [J22]

    A course's cards are one array that meets each text once; of its words only those of the cards are kept.
    """
    words = cards.select("course_id", "card_norm", "kind").distinct().withColumn("words", F.array_distinct(tokens("card_norm"))).filter(F.size("words") > 0)
    course = words.groupBy("course_id").agg(F.collect_list(F.struct("card_norm", "kind", "words")).alias("__cards"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("__keys"))
    # a card has a word of four letters, and so has a text that holds one of its words or all of it
    df = with_course(texts, words, course, "text_norm").withColumn("__held", F.array_intersect(F.split("text_norm", " "), "__keys"))

    def points(c: Column) -> Column:
        some = once(F.size(F.array_intersect(c["words"], F.col("__held"))), lambda n: F.when(n >= 2, 0.34).when(n == 1, 0.16).otherwise(0.0))
        hit = F.when(F.col("text_norm").contains(c["card_norm"]), 0.5).otherwise(some)
        more = once(hit, lambda h: F.when(h > 0, h + F.when(c["kind"] == "topic", 0.05).otherwise(0.03)).otherwise(0.0))
        return F.struct(c["card_norm"].alias("card_norm"), c["kind"].alias("kind"), more.alias("points"))

    hits = F.filter(F.transform("__cards", points), lambda h: h["points"] > 0)
    return df.select("course_id", *key, hits.alias("hits")).filter(F.size("hits") > 0)


def held_cards(hits: DataFrame, holders: DataFrame, key: list[str], name: str) -> DataFrame:
    """Evidence of the cards that blocks or sessions hold, for the texts that hit one: key, course_id, `name`, card_score, at
    most 0.7 each. [J22]

    hits: `card_hits`; holders: course_id, `name`, cards array<struct(card_norm, kind)>. A hit meets the holders of its
    card by equality.
    """
    each = hits.select("course_id", *key, F.inline("hits"))
    of_card = holders.select("course_id", name, F.inline("cards"))
    return each.join(of_card, ["course_id", "card_norm", "kind"]).groupBy("course_id", *key, name).agg(F.least(F.lit(0.7), F.sum("points")).alias("card_score"))


def card_scores(texts: DataFrame, cards: DataFrame, key: list[str]) -> DataFrame:
    """Evidence of a course's cards (course_id, card_norm, kind) in its texts (key, course_id, text_norm): at most 0.7 a text. [J22]"""
    held = cards.groupBy("course_id").agg(F.collect_list(F.struct("card_norm", "kind")).alias("cards")).withColumn("__all", F.lit(0))
    found = held_cards(card_hits(texts, cards, key), held, key, "__all").drop("__all")
    named = texts.join(held.select("course_id"), "course_id", "left_semi").select("course_id", *key)
    return named.join(found, ["course_id", *key], "left").select(*key, F.coalesce("card_score", F.lit(0.0)).alias("card_score"))


def topic_unit(matches: DataFrame, topics: DataFrame, units: DataFrame) -> DataFrame:
    """The unit of a matched topic: its own if it exists, else the first unit that has a topic of that slug. [J21]"""
    own = units.select("course_id", F.col("unit_slug").alias("__own")).distinct()
    first = topics.groupBy("course_id", "topic_slug").agg(F.min_by("unit_slug", F.struct("unit_ord", "topic_ord")).alias("__first"))
    out = matches.join(own, (matches.course_id == own.course_id) & (matches.unit_slug == F.col("__own")), "left").drop(own.course_id)
    out = out.join(first, ["course_id", "topic_slug"], "left")
    return out.withColumn("derived_unit", F.coalesce("__own", "__first", F.lit(""))).drop("__own", "__first")


def manual_blocks(entries: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """The block that an entry names: by id, or, as `bloco-n`, the n-th teaching block of its unit, or of its course where it
    names no unit. [J12, W18]

    entries: key, course_id, manual_block, manual_unit; blocks: course_id, block_id, block_ord, unit_slug, administrative.
    """
    teaching = blocks.filter("not coalesce(administrative, false)").select("course_id", "block_id", "block_ord", F.trim(F.coalesce("unit_slug", F.lit(""))).alias("unit"))
    nth = lambda *by: F.row_number().over(W.partitionBy("course_id", *by).orderBy("block_ord", "block_id")).cast("string")
    counted = teaching.withColumns({"__in_unit": nth("unit"), "__in_course": nth()})
    unit = F.trim(F.coalesce("manual_unit", F.lit("")))
    names = F.array(F.when(F.col("unit") != "", F.concat_ws("\n", "__in_unit", "unit")), F.concat("__in_course", F.lit("\n")))
    by_n = counted.select("course_id", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("__nth"), F.col("block_id").alias("__by_n"))
    by_id = blocks.select("course_id", F.trim("block_id").alias("__named"), F.col("block_id").alias("__by_id"))
    ordinal = F.nullif(F.regexp_replace(F.regexp_extract(F.trim("manual_block"), r"(?i)^bloco-(\d+)$", 1), "^0+(?=.)", ""), F.lit(""))
    out = entries.withColumns({"__named": F.trim("manual_block"), "__nth": F.concat(ordinal, F.lit("\n"), unit)})
    return out.join(by_id, ["course_id", "__named"], "left").join(by_n, ["course_id", "__nth"], "left").select(*key, F.coalesce("__by_id", "__by_n").alias("block_id"))
