"""Documents: pages and chunks, cleaning, sections, images and their descriptions.

IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

from coursemill.functions.batches import by_parts
from coursemill.functions.text import compact_description, match_text, page_from_name, tokens


# pages

def collapse_pages(pages: DataFrame, key: list[str], page: str = "page") -> DataFrame:
    """Distinct pages per key as ranges like `1-3,7`. [W10] Runs are pages minus their rank."""
    once = pages.filter(f"{page} >= 0").select(*key, page).distinct()
    run = F.col(page) - F.row_number().over(W.partitionBy(*key).orderBy(page))
    runs = once.withColumn("__run", run).groupBy(*key, "__run").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    parts = runs.withColumn("t", text).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("a", "t"))).alias("x"))
    return parts.select(*key, F.array_join(F.transform("x", lambda s: s["t"]), ",").alias("pages"))


def chunk_size(profile: Column, n_pages: Column) -> Column:
    """Pages of an extraction chunk by profile and length. [W11]"""
    return F.when(profile == "scanned", 10).when(profile.isin("math_heavy", "diagram_heavy"), F.when(n_pages >= 150, 10).otherwise(15)).otherwise(F.when(n_pages >= 150, 20).otherwise(25))


def page_chunks(pages: DataFrame, key: list[str], page: str = "page", least: int = 50) -> DataFrame:
    """Each page with its chunk; documents under `least` pages are one chunk. [W11] pages: key, page, profile."""
    total = pages.groupBy(*key).agg(F.countDistinct(page).alias("n_pages"))
    df = pages.join(total, key)
    nth = F.row_number().over(W.partitionBy(*key).orderBy(page)) - 1
    chunk = F.when(F.col("n_pages") >= least, F.floor(nth / chunk_size(F.col("profile"), F.col("n_pages")))).otherwise(0)
    return df.withColumn("chunk", chunk.cast("int"))


def document_profile(pages: DataFrame, key: list[str]) -> DataFrame:
    """Totals of each document's pages (text_chars, images, tables) and its suggested profile. [A7]

    A scan has at least half of its pages with under 60 characters and an image.
    """
    out = pages.groupBy(*key).agg(
        F.count("*").alias("page_count"), F.sum("text_chars").alias("text_chars"), F.sum("images").alias("images_count"), F.sum("tables").alias("table_candidates"),
        F.count_if((F.col("text_chars") < 60) & (F.col("images") > 0)).alias("bare_pages"),
    )
    scan = F.col("bare_pages") * 2 >= F.col("page_count")
    density = F.round(F.col("text_chars") / F.col("page_count"), 2)
    suggested = F.when(scan, "scanned").when((F.col("images_count") >= 2 * F.col("page_count")) | (F.col("table_candidates") >= F.col("page_count")), "diagram_heavy").otherwise("auto")
    return out.withColumns({"text_density": density, "suspected_scan": scan, "suggested_profile": suggested}).drop("bare_pages")


def merge_chunks(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Extraction chunks as one document: bodies in order, page totals, mean quality, costs by name, image pages of the
    latest chunk that tells them. [A13] chunks: key, chunk, first_page, body, pages, quality, costs map, image_pages map."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.format_string("<!-- page %d -->\n%s", "first_page", "body").alias("t")))), lambda x: x["t"]), "\n\n")
    base = chunks.groupBy(*key).agg(body.alias("body"), F.sum("pages").alias("pages"), F.round(F.avg("quality"), 4).alias("quality"))
    costs = chunks.select(*key, F.explode("costs").alias("k", "v")).groupBy(*key, "k").agg(F.sum("v").alias("v")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("costs"))
    images = chunks.select(*key, "chunk", F.explode("image_pages").alias("k", "v")).groupBy(*key, "k").agg(F.max_by("v", "chunk").alias("v")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("image_pages"))
    return base.join(costs, key, "left").join(images, key, "left")


def image_page_map(docs: DataFrame, key: list[str], text: str = "markdown", offset: int = 0) -> DataFrame:
    """The first page on which each image of a document is referred to. [F16] Page markers are a number over hyphens."""
    parts = docs.select(*key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?m)(?=^\d+\r?\n-{40,}$)")).alias("pos", "part"))
    page = F.nullif(F.regexp_extract("part", r"^(\d+)\r?\n-{40,}", 1), F.lit("")).cast("int") + offset
    refs = parts.select(*key, page.alias("page"), "pos", F.explode(F.regexp_extract_all("part", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))).alias("ref"))
    return refs.filter("page is not null").groupBy(*key, F.substring_index("ref", "/", -1).alias("fname")).agg(F.min_by("page", "pos").alias("page"))


# Markdown

def truncate_blocks(blocks: DataFrame, key: list[str], most: int = 15_000, part: int = 160) -> DataFrame:
    """Blocks (key, ord, block) while the running size fits; the first that does not is clipped if over `part` characters
    are left, and a marker line follows. [W14]"""
    w = W.partitionBy(*key).orderBy("ord")
    df = blocks.withColumn("upto", F.sum(F.length("block") + 2).over(w)).withColumn("room", most - (F.col("upto") - F.length("block") - 2))
    fits = F.col("upto") <= most
    first_over = F.coalesce(F.lag(fits).over(w), F.lit(True)) & ~fits
    clipped = F.concat(F.rtrim(F.substring(F.col("block"), F.lit(1), F.col("room").cast("int"))), F.lit("\n\n[...]"))
    df = df.withColumns({"__fits": fits, "__first": first_over})
    text = F.when(F.col("__fits"), F.col("block")).when(F.col("__first"), F.when(F.col("room") > part, clipped).otherwise("[...]"))
    return df.withColumn("block", text).filter("block is not null").select(*blocks.columns)


def clean_noise(docs: DataFrame, key: list[str], text: str = "markdown") -> DataFrame:
    """Texts without page-number lines, rules, a repeated header line and more than two blank lines in a row; code
    fences and `$$` blocks stay as they are. [W15] One pass over each text's lines, in Arrow batches."""
    import re

    number, rule = re.compile(r"^\s*(?:p[áa]g(?:ina)?\.?\s*)?\d{1,4}(?:\s*(?:/|de)\s*\d{1,4})?\s*$", re.I), re.compile(r"^\s*(?:-{3,}|_{3,}|\*{3,}|={3,})\s*$")

    def clean(s: str) -> str:
        out, fence, maths, blank, header = [], False, False, 0, None
        for line in (s or "").split("\n"):
            bare = line.strip()
            if bare.startswith("```"):
                fence = not fence
            elif not fence and bare.count("$$") % 2:
                maths = not maths
            elif not fence and not maths:
                if number.match(line) or rule.match(line):
                    continue
                if bare.startswith("#") and bare == header:
                    continue
                header = bare if bare.startswith("#") else header if not bare else None
                blank = blank + 1 if not bare else 0
                if blank > 2:
                    continue
            out.append(line)
        return "\n".join(out)

    return docs.select(*key, by_parts(F.col(text), lambda s: None if s is None else clean(s), StringType()).alias(text))


def section_headers(docs: DataFrame, key: list[str], text: str = "markdown") -> DataFrame:
    """`##` and `###` headers with line numbers, outside code fences and the summary block. [F9]"""
    lines = docs.select(*key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "line"))
    w = W.partitionBy(*key).orderBy("pos")
    fences = F.sum(F.col("line").rlike(r"^\s*```").cast("int")).over(w)
    start, stop = F.col("line").contains(SUMMARY_START), F.col("line").contains(SUMMARY_END)
    inside = F.sum(F.when(start, 1).when(stop, -1).otherwise(0)).over(w)
    df = lines.withColumns({"fences": fences, "inside": inside})
    return df.filter((F.col("fences") % 2 == 0) & (F.col("inside") <= 0) & F.col("line").rlike(r"^#{2,3}\s+\S")).select(*key, F.col("pos").alias("line_no"), F.regexp_extract("line", r"^(#+)", 1).alias("level"), F.regexp_extract("line", r"^#+\s+(.+?)\s*$", 1).alias("header"))


def section_list(markdown: Column, most: int = 4) -> Column:
    """The first `##` headers of a text, outside code fences and the summary block, joined by two spaces. [F9]"""
    text = F.regexp_replace(F.coalesce(markdown, F.lit("")), r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)", "")
    text = F.regexp_replace(text, rf"(?s){SUMMARY_START}.*?(?:{SUMMARY_END}|\z)", "")
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^##[ \t]+(\S.*?)[ \t\r]*$"), F.lit(1))
    return F.when(F.coalesce(markdown, F.lit("")).contains("##"), F.array_join(F.slice(heads, 1, most), "  ")).otherwise("")


SUMMARY_START, SUMMARY_END = "<!-- summary:start -->", "<!-- summary:end -->"


def executive_summary(docs: DataFrame, key: list[str], text: str = "markdown") -> DataFrame:
    """Texts with a list of their sections on top if they have two or more; done twice it changes nothing. [F28]"""
    heads = section_headers(docs, key, text)
    listed = heads.groupBy(*key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "header"))), lambda x: F.concat(F.lit("- "), x["header"])), "\n").alias("list"))
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s){SUMMARY_START}.*?{SUMMARY_END}\n*", "")
    block = F.concat(F.lit(f"{SUMMARY_START}\n"), F.col("list"), F.lit(f"\n{SUMMARY_END}\n\n"))
    out = docs.join(listed, key, "left")
    return out.withColumn(text, F.when(F.col("n") >= 2, F.concat(block, bare)).otherwise(bare)).select(*docs.columns)


def split_sections(docs: DataFrame, key: list[str], text: str = "markdown", window: int = 1600) -> DataFrame:
    """Sections at `##` to `######`: heading, body and the words of the heading and the body's start. [F19]"""
    parts = docs.select(*key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?m)(?=^#{2,6}\s)")).alias("section", "body")).filter(F.trim("body") != "")
    head = F.regexp_extract("body", r"^#{2,6}\s+([^\r\n]+)", 1)
    return parts.withColumns({"heading": F.trim(head), "words": F.array_distinct(tokens(match_text(F.concat_ws(" ", head, F.substring("body", 1, window)), "c")))})


# repair

def repair_mojibake(c: Column) -> Column:
    """Text decoded anew from Latin-1 or cp1252 where that leaves fewer signs of wrong decoding. [F12]"""
    from coursemill.functions.text import MOJIBAKE_MARKS

    marks = tuple(MOJIBAKE_MARKS)

    def best(s: str) -> str:
        score = lambda x: sum(x.count(m) for m in marks)
        if not (least := score(s)):
            return s
        out = s
        for name in ("latin-1", "cp1252"):
            try:
                t = s.encode(name).decode("utf-8")
            except UnicodeError:
                continue
            if (k := score(t)) < least:
                out, least = t, k
        return out

    return by_parts(c, lambda s: None if s is None else best(s), StringType())


#: Symbols and their LaTeX commands; accents of TeX and their combining marks (fixed values, short lists).
MATH_SYMBOLS = {"∀": r"\forall", "∃": r"\exists", "∈": r"\in", "∉": r"\notin", "⊆": r"\subseteq", "⊂": r"\subset", "∪": r"\cup", "∩": r"\cap", "→": r"\to", "⇒": r"\Rightarrow", "↔": r"\leftrightarrow", "⇔": r"\Leftrightarrow", "¬": r"\neg", "∧": r"\land", "∨": r"\lor", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≡": r"\equiv", "≈": r"\approx", "×": r"\times", "÷": r"\div", "∞": r"\infty", "∅": r"\emptyset", "⊢": r"\vdash", "⊨": r"\models", "⊥": r"\bot", "⊤": r"\top", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "√": r"\sqrt", "λ": r"\lambda", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "φ": r"\phi", "ψ": r"\psi", "ω": r"\omega", "Γ": r"\Gamma", "Δ": r"\Delta", "Σ": r"\Sigma", "Ω": r"\Omega"}
TEX_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", '"': "\u0308", "c": "\u0327"}


def unicode_math(c: Column) -> Column:
    """Symbols as LaTeX inside math, and wrapped in `$` outside; TeX accents inside math as letters. [F14]"""
    import re
    import unicodedata

    regions = re.compile(r"(\$\$.*?\$\$|\$[^$\n]+\$|```.*?```|`[^`\n]*`)", re.S)
    symbol = re.compile("|".join(map(re.escape, MATH_SYMBOLS)))
    accent = re.compile(r"\\(['`^~\"c])\{?([A-Za-z])\}?")

    def inside(s: str) -> str:
        s = accent.sub(lambda m: unicodedata.normalize("NFC", m[2] + TEX_ACCENTS[m[1]]) if m[1] != "c" or m[0].startswith(r"\c{") else m[0], s)
        return symbol.sub(lambda m: MATH_SYMBOLS[m[0]] + " ", s)

    def convert(s: str) -> str:
        parts = regions.split(s)
        return "".join(inside(p) if p.startswith("$") else p if p.startswith("`") else symbol.sub(lambda m: f"${MATH_SYMBOLS[m[0]]}$", p) for p in parts)

    return by_parts(c, lambda s: None if s is None else convert(s), StringType())


def line_rescue(pairs: DataFrame, key: list[str], kinds: str) -> DataFrame:
    """Lines of `advanced` in place of which `base` has the same line with better accents: a moving window of lines, a
    ratio of 0.88, equal when folded. [J20] Per document, no shuffle. kinds: DDL of the key columns."""
    import difflib
    import unicodedata

    def folded(s: str) -> str:
        if s.isascii():
            return s.lower().strip()
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().strip()

    def accents(s: str) -> int:
        return sum(ord(c) > 127 and c.isalpha() for c in s)

    def alike(line: str, other: str) -> bool:
        if line == other:
            return True
        matcher = difflib.SequenceMatcher(None, line, other)
        return matcher.quick_ratio() >= 0.88 and matcher.ratio() >= 0.88  # the first is an upper bound

    def rescue(advanced: str, base: str) -> tuple[str, int]:
        old, new, cursor, n = (base or "").split("\n"), [], 0, 0
        plain = [folded(x) for x in old]  # once a line, not at every place of the window
        for line in (advanced or "").split("\n"):
            if line.strip() and "$" not in line:
                flat = folded(line)
                for j in range(max(0, cursor - 2), min(len(old), cursor + 12)):
                    other = old[j]
                    if plain[j] == flat and other.strip() and alike(line, other):
                        cursor = j + 1
                        if accents(other) > accents(line):
                            line, n = other, n + 1
                        break
            new.append(line)
        return "\n".join(new), n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [rescue(a, b) for a, b in zip(pdf["advanced"], pdf["base"], strict=True)]
            yield pdf[key].assign(markdown=[t for t, _ in out], n_rescued=[n for _, n in out])

    return pairs.select(*key, "advanced", "base").mapInPandas(run, f"{kinds}, markdown string, n_rescued int")


# images

#: Least bytes, least side and greatest ratio of kept images by policy (fixed values).
IMAGE_POLICY = [("math_heavy", 512, 8, 20.0, 0), ("scanned", 512, 8, 20.0, 0), ("diagram_heavy", 1200, 16, 12.0, 0), ("auto", 2000, 20, 8.0, 4)]


def keep_images(images: DataFrame) -> DataFrame:
    """Images (profile, bytes, width, height, colours) that their profile's policy keeps. [P16]"""
    spark = images.sparkSession
    policy = F.broadcast(spark.createDataFrame(IMAGE_POLICY, "profile string, least_bytes int, least_side int, most_ratio double, few_colours int"))  # four rows
    ratio = F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1))
    good = (F.col("bytes") >= F.col("least_bytes")) & (F.least("width", "height") >= F.col("least_side")) & (ratio <= F.col("most_ratio")) & (F.col("colours") > F.col("few_colours"))
    return images.join(policy, "profile").filter(good).select(*images.columns)


def image_class(size: Column, width: Column, height: Column, colours: Column) -> Column:
    """decorative or generic; unreadable sizes are generic. [P17]"""
    ratio = F.greatest(width, height) / F.least(width, height)
    return F.when(width.isNull() | height.isNull(), "generic").when((size < 5000) | (F.least(width, height) < 50) | (ratio > 6) | (colours <= 8), "decorative").otherwise("generic")


def duplicate_images(images: DataFrame, key: str = "doc_id", digest: str = "sha1", page: str = "page") -> DataFrame:
    """Images of a document with equal bytes: pages, the other pages of each, and how many. [A12]"""
    pages = images.groupBy(key, digest).agg(F.sort_array(F.collect_set(page)).alias("pages"), F.count("*").alias("copies")).filter("copies >= 2")
    return images.join(pages, [key, digest]).withColumn("other_pages", F.array_except("pages", F.array(page)))


def images_by_page(images: DataFrame, overrides: DataFrame, key: str = "doc_id") -> DataFrame:
    """File names by document and page; a page may be set by hand, unknown ones are one group. [A15]"""
    df = images.withColumn("page", page_from_name("fname")).join(overrides.select(key, "fname", F.col("page").alias("__page")), [key, "fname"], "left")
    return df.groupBy(key, F.coalesce("__page", "page").alias("page")).agg(F.sort_array(F.collect_list("fname")).alias("fnames"))


def near_duplicate_descriptions(descriptions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Descriptions of one compact text in a document: the first by page and name leads, others within a page of it only
    refer to it. [W9]"""
    compact = match_text(compact_description("description"), "c")
    w = W.partitionBy(key, "compact").orderBy("page", "fname")
    df = descriptions.withColumn("compact", compact)
    df = df.withColumns({"lead_page": F.first("page").over(w), "lead_fname": F.first("fname").over(w)})
    refers = (F.col("fname") != F.col("lead_fname")) & (F.abs(F.col("page") - F.col("lead_page")) <= 1)
    return df.withColumn("refers_to", F.when(refers, F.col("lead_fname"))).drop("compact", "lead_page", "lead_fname")


def match_descriptions(refs: DataFrame, descriptions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The description of each image reference: same name, else one whose name the reference's ends with; then the same
    page, then the longest name. [J18] refs: key, ref_ord, fname, page; descriptions: key, fname, page, description."""
    d = descriptions.select(key, F.col("fname").alias("d_fname"), F.col("page").alias("d_page"), "description")
    pairs = refs.join(d, key).filter((F.col("fname") == F.col("d_fname")) | F.col("fname").endswith(F.concat(F.lit("-"), F.col("d_fname"))))
    rank = F.struct((F.col("fname") != F.col("d_fname")).alias("a"), (~F.coalesce(F.col("page") == F.col("d_page"), F.lit(False))).alias("b"), (-F.length("d_fname")).alias("c"), "d_fname")
    return pairs.groupBy(*refs.columns).agg(F.min_by("description", rank).alias("description"), F.min_by("d_fname", rank).alias("d_fname"))


def place_orphans(orphans: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """The section of each description that no reference matched: most shared words and at most two in its heading, two
    at least; null where none. [J19] orphans: key, fname, description; sections: `split_sections`."""
    o = orphans.withColumn("o_words", F.array_distinct(tokens(match_text("description", "c"))))
    s = sections.select(key, "section", "words", F.array_distinct(tokens(match_text("heading", "c"))).alias("h_words"))
    points = F.size(F.array_intersect("o_words", "words")) + F.least(F.lit(2), F.size(F.array_intersect("o_words", "h_words")))
    best = o.join(s, key).withColumn("points", points).filter("points >= 2").groupBy(key, "fname").agg(F.min(F.struct((-F.col("points")).alias("neg"), "section")).alias("b"))
    return orphans.join(best.select(key, "fname", F.col("b.section").alias("section"), (-F.col("b.neg")).alias("points")), [key, "fname"], "left")


def inject_descriptions(docs: DataFrame, matched: DataFrame, key: str = "doc_id", text: str = "markdown") -> DataFrame:
    """Texts with a description block in place of each matched image reference. [F31] A second run finds no reference.

    matched: key, fname, description (one row a name); references without one stay.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))
    ref = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"
    named = lines.withColumn("fname", F.substring_index(F.regexp_extract("line", ref, 1), "/", -1))
    out = named.join(matched.select(key, "fname", "description"), [key, "fname"], "left")
    block = F.concat(F.lit("> **Image:** "), compact_description("description"), F.regexp_replace("line", ref, ""))
    out = out.withColumn("line", F.when(F.col("description").isNotNull() & (F.col("fname") != ""), F.rtrim(block)).otherwise(F.col("line")))
    body = out.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("__text"))
    return docs.join(body, key, "left").withColumn(text, F.coalesce("__text", text)).select(*docs.columns)


def append_orphans(docs: DataFrame, placed: DataFrame, key: str = "doc_id", text: str = "markdown") -> DataFrame:
    """Texts with descriptions that no reference matched: at the end of the section that `place_orphans` found for them,
    the others in a list at the end. [F31] placed: key, fname, description, section (a number of `split_sections`)."""
    item = F.struct("fname", F.concat(F.lit("> **Image ("), "fname", F.lit("):** "), compact_description("description")).alias("line"))
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n\n")
    near = placed.filter("section is not null").groupBy(key, "section").agg(gathered.alias("__near"))
    far = placed.filter("section is null").groupBy(key).agg(gathered.alias("__far"))
    parts = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?m)(?=^#{2,6}\s)")).alias("section", "part")).join(near, [key, "section"], "left")
    body = F.when(F.col("__near").isNull(), F.col("part")).otherwise(F.concat(F.rtrim(F.regexp_replace("part", r"\s+$", "")), F.lit("\n\n"), "__near", F.lit("\n\n")))
    whole = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", body.alias("part")))), lambda x: x["part"]), "").alias("__text"))
    out = docs.join(whole, key, "left").join(far, key, "left")
    tail = F.when(F.col("__far").isNotNull(), F.concat(F.regexp_replace("__text", r"\s+$", ""), F.lit("\n\n## Other images\n\n"), "__far", F.lit("\n"))).otherwise(F.col("__text"))
    return out.withColumn(text, F.coalesce(tail, text)).select(*docs.columns)


def table_markdown(rows: DataFrame, key: list[str]) -> DataFrame:
    """Markdown tables from rows (key, row, cells array): all rows as wide as the widest. [S10]"""
    width = rows.groupBy(*key).agg(F.max(F.size("cells")).alias("w"))
    df = rows.join(width, key).withColumn("cells", F.slice(F.concat(F.transform("cells", lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "))), F.array_repeat(F.lit(""), F.col("w"))), F.lit(1), F.col("w")))
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    df = df.groupBy(*key).agg(F.max("w").alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), F.col("w")), ""))
    return df.select(*key, F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.expr("slice(lines, 2, size(lines))")), "\n").alias("markdown"))
