"""Text columns: folding, slugs, match text, dates, Markdown pieces. All are built-in expressions over Columns.

A null text gives null unless a function says otherwise. IDs in brackets are those of the operator inventory.
"""

from __future__ import annotations

import unicodedata

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often `use` names it: nested texts would else be written
    out again at every place, and the plan would grow by a power of the nesting."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold_tables() -> tuple[str, str]:
    """Latin letters with marks and compatibility forms of one letter, and their plain letters (by Unicode's NFKD)."""
    pairs = []
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_tables()
#: Combining marks: letters behind the table's end have no counterpart, so `translate` drops them.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(c: Column | str) -> Column:
    """Letters without their marks (Latin range), combining marks dropped; plain ASCII is left as it is."""
    x = _col(c)
    return F.when(F.octet_length(x) == F.char_length(x), x).otherwise(F.translate(x, FOLD_FROM + MARKS, FOLD_TO))


def collapse_ws(c: Column | str) -> Column:
    """White space runs as one space, none at the ends; null as empty. [F1]"""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "))


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def slugify(c: Column | str) -> Column:
    """Lower-case words joined by hyphens; `untitled` where nothing is left, also for null. [P1]"""
    s = F.trim(F.lower(fold(F.coalesce(_col(c), F.lit("")))))
    s = F.regexp_replace(s, r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


#: The four kinds of match text: what stays besides a-z, 0-9 and spaces, and whether the known typo is mended.
MATCH_KINDS = {"a": ("", True), "b": (r"+\-./", False), "c": ("", False), "d": (r"#+.\-", False)}


def match_text(c: Column | str, kind: str = "a") -> Column:
    """Folded lower-case text of letters, digits and single spaces; null as empty. [P3]"""
    keep, mend = MATCH_KINDS[kind]
    s = F.lower(fold(F.coalesce(_col(c), F.lit(""))))
    if kind == "b":
        s = F.regexp_replace(s, "[\u2010-\u2015]", "-")
    if mend:
        s = F.replace(s, F.lit("propocional"), F.lit("proposicional"))
    return F.trim(F.regexp_replace(s, f"[^a-z0-9{keep}]+", " "))


def tokens(c: Column | str, least: int = 4) -> Column:
    """Words of a match text with at least so many letters, in order, with repeats."""
    return F.filter(F.split(_col(c), " "), lambda x: F.length(x) >= least)


def unit_slug(title: Column | str) -> Column:
    """Slug of a unit's title with its number in two digits. [data model]"""
    s = slugify(F.replace(F.coalesce(_col(title), F.lit("")), F.lit("\u2014"), F.lit("-")))
    number = F.regexp_extract(s, r"^unidade(?:-de-aprendizagem)?-(\d+)(?:-.+)?$", 1)
    padded = F.concat(F.regexp_extract(s, r"^(unidade(?:-de-aprendizagem)?-)\d+", 1), F.lpad(F.regexp_replace(number, "^0+(?=.)", ""), 2, "0"), F.regexp_extract(s, r"^unidade(?:-de-aprendizagem)?-\d+(-.+)?$", 1))
    return F.when((number != "") & (F.length(number) <= 2), padded).otherwise(s)


DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")
DATE_PATTERN = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}"


def parse_date(c: Column | str) -> Column:
    """The date in the first ten characters, in any of three forms, else null. [F2]"""
    head = F.substring(collapse_ws(c), 1, 10)
    shapes = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$")
    return F.coalesce(*(F.when(head.rlike(s), F.try_to_timestamp(head, F.lit(f)).cast("date")) for f, s in zip(DATE_FORMATS, shapes, strict=True)))


def period_bounds(c: Column | str) -> Column:
    """struct(start, end): the first two dates of a text in order, one date twice, nulls without any. [F3]"""
    found = F.regexp_extract_all(collapse_ws(c), F.lit(DATE_PATTERN), F.lit(0))
    first, second = parse_date(F.get(found, F.lit(0))), parse_date(F.get(found, F.lit(1)))
    end = F.when(F.size(found) > 1, second).otherwise(first)
    swap = first > end
    return F.struct(F.when(swap, end).otherwise(first).alias("start"), F.when(swap, first).otherwise(end).alias("end"))


def date_range_signal(c: Column | str) -> Column:
    """struct(start, end) of `[semana] date (a | ate | -) date` in folded text. [F4]"""
    s = F.lower(fold(F.coalesce(_col(c), F.lit(""))))
    s = F.regexp_replace(s, "[\u2010-\u2015]", "-")
    date = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"
    pattern = rf"(?:semana\s+)?{date}\s*(?:a|ate|-)\s*{date}"
    pick = lambda i: parse_date(F.nullif(F.regexp_extract(s, pattern, i), F.lit("")))
    return F.struct(pick(1).alias("start"), pick(2).alias("end"))


def may_hold_date(c: Column | str) -> Column:
    """Whether a text holds a digit before a dash or a slash, as any date does, before or behind folding."""
    return F.coalesce(_col(c), F.lit("")).rlike("[\\d\u00b2\u00b3\u00b9][\u0300-\u036f]*[-/\u2010-\u2015]")


def display_period(c: Column | str) -> Column:
    """Every date of a label as dd/MM/yyyy, dash ranges between them as ` a `. [F33]"""
    s = F.regexp_replace(collapse_ws(c), r"(\d{4})-(\d{2})-(\d{2})", "$3/$2/$1")
    s = F.regexp_replace(s, r"\b(\d{2})-(\d{2})-(\d{4})\b", "$1/$2/$3")
    return F.regexp_replace(s, "(\\d{2}/\\d{2}/\\d{4})\\s*[-\u2010-\u2015]\\s*(\\d{2}/\\d{2}/\\d{4})", "$1 a $2")


#: Schedule kinds that take a row out of scoring (fixed values).
IGNORED_KINDS = ["suspension", "g2", "ps", "event"]


def kind_marker(c: Column | str) -> Column:
    """struct(kind, content, ignored): a `{kind=x}` marker taken out of a row's text, `class` without one. [F7]"""
    text = F.coalesce(_col(c), F.lit(""))
    kind = F.lower(F.regexp_extract(text, r"\{kind=(\w+)\}", 1))
    found = kind != ""
    kind = F.when(found, kind).otherwise("class")
    content = F.when(found, collapse_ws(F.regexp_replace(text, r"\{kind=\w+\}", ""))).otherwise(F.trim(text))
    return F.struct(kind.alias("kind"), content.alias("content"), kind.isin(IGNORED_KINDS).alias("ignored"))


def session_signals(content: Column) -> Column:
    """Signals array<struct(kind, date, label)> of a schedule text: dated parts, then asynchronous lines. [F5]"""
    text = F.coalesce(content, F.lit(""))
    date = r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"
    dated = F.regexp_extract_all(text, F.lit(rf"(?m)({date}\)?\s*[:\-–—]?[^\n;]*)"), F.lit(1))
    one = lambda x: F.struct(F.when(match_text(x, "c").contains("assincron"), "async").otherwise("class").alias("kind"), parse_date(x).alias("date"), collapse_ws(F.regexp_replace(F.regexp_replace(x, date, ""), r"\{kind=\w+\}|^[\s:)\-–—]+", "")).alias("label"))
    loose = F.filter(F.split(text, r"[\n;]"), lambda x: match_text(x, "c").contains("assincron") & ~x.rlike(date))
    rest = F.transform(loose, lambda x: F.struct(F.lit("async").alias("kind"), F.lit(None).cast("date").alias("date"), collapse_ws(F.regexp_replace(x, r"\{kind=\w+\}", "")).alias("label")))
    skip = text.contains("⊘") | kind_marker(text)["ignored"]
    both = F.array_distinct(F.concat(F.transform(dated, one), rest))
    return F.when(skip, F.slice(both, 1, 0)).otherwise(both)


def session_dates(content: Column) -> Column:
    """The dates of `session_signals`, in order, with repeats: dated parts alone. [F5]"""
    text = F.coalesce(content, F.lit(""))
    dated = F.regexp_extract_all(text, F.lit(rf"({DATE_PATTERN})\)?\s*[:\-–—]?[^\n;]*"), F.lit(1))
    skip = text.contains("⊘") | kind_marker(text)["ignored"]
    return F.when(skip, F.array().cast("array<date>")).otherwise(F.transform(dated, parse_date))


def first_of(items: Column, keys: list[str], kind: str) -> Column:
    """An array of structs (`kind`) without those whose keys an earlier one has."""
    same = lambda x, y: reduce(Column.__and__, [F.equal_null(x[k], y[k]) for k in keys])
    return F.aggregate(items, F.expr(f"cast(array() as array<struct<{kind}>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


#: Dated and asynchronous sessions in folded text: what leads up to them, then their parts (fixed patterns).
_LEAD, _DAY = r"(?:^|[\n;]\s*|:\s*)\s*(?:[-*•]\s*)?", r"\d{2}/\d{2}/\d{4}"
PREFIXED_SESSION = _LEAD + r"(aula|encontro|reuniao|atividade(?:\s+assincrona|(?:\s+async)?)?)\s+(" + _DAY + r")(?:\s*(?:[:\-–—]\s*)?([^;\n]*))?"
LABELLED_SESSION = _LEAD + r"\(?\s*((?:" + _DAY + r")|(?:atividade\s+assincrona|assincrona|atividade\s+async|async))\s*\)?\s*(?:[a-z]{3}\s+)?\s*[:\-–—]\s*([^;\n]*)"


def timed_sessions(c: Column | str) -> Column:
    """Sessions array<struct(kind, date, label, signals)> of a schedule text: those behind a word like `aula`, then those
    that a date or an asynchronous mark starts; ignored kinds and suspended ones left out. [F5, F6]"""
    text = F.trim(F.lower(fold(F.coalesce(_col(c), F.lit("")))))
    every = lambda pattern, day, body: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("head"), (F.regexp_extract(x, pattern, day) if day else F.lit("")).alias("day"), F.regexp_extract(x, pattern, body).alias("body")))
    both = F.concat(every(PREFIXED_SESSION, 2, 3), every(LABELLED_SESSION, 0, 2))
    marked = F.filter(both, lambda x: ~x["body"].contains("⊘") & ~F.regexp_extract(x["body"], r"\{kind=([a-z0-9_]+)\}", 1).isin(IGNORED_KINDS))

    def bare(x: Column) -> Column:
        said = F.when(x["body"].rlike(r"\{kind=[a-z0-9_]+\}"), collapse_ws(F.regexp_replace(x["body"], r"\{kind=[a-z0-9_]+\}", " "))).otherwise(x["body"])
        return F.struct(x["head"].alias("raw_head"), match_text(x["head"]).alias("head"), x["day"].alias("day"), F.regexp_replace(said, r"^[ \t\-:;.,]+|[ \t\-:;.,]+$", "").alias("body"))

    def session(x: Column) -> Column:
        is_async = x["head"].contains("assincr") | x["head"].contains("async")
        date = parse_date(F.when(x["day"] != "", x["day"]).otherwise(F.when(~is_async, x["raw_head"])))
        signals = F.concat(F.filter(F.array(date.cast("string")), lambda d: d.isNotNull()), signal_terms(x["raw_head"]), signal_terms(x["body"]))
        label = lambda b: F.struct(F.when(is_async, "async").otherwise("class").alias("kind"), date.alias("date"), F.coalesce(F.nullif(b, F.lit("")), x["head"]).alias("label"), signals.alias("signals"), b.alias("body"))
        return once(match_text(x["body"]), label)

    found = first_of(F.transform(F.transform(marked, bare), session), ["kind", "date", "label", "body"], "kind:string,date:date,label:string,signals:array<string>,body:string")
    return F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "date", "label", "signals"))))


#: Marks of cards and of topics in schedule text (fixed patterns).
CARD_MARKS = {"card-title": r"(?i)(?:^|[\n;]\s*)\s*card\s*[:\-]\s*([^;\n]+)", "topic-title": r"(?iu)(?:^|[\n;]\s*)\s*(?:topico|t[oó]pico)\s*[:\-]\s*([^;\n]+)"}


def card_evidence(c: Column | str) -> Column:
    """Cards array<struct(source_kind, normalized_title, title)> of a schedule text, `Card:` before `Tópico:`. [F27]"""
    text = collapse_ws(c)

    def of(kind: str, pattern: str) -> Column:
        titles = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(collapse_ws(x), r"^[ \t\r\n\-:;,.]+|[ \t\r\n\-:;,.]+$", ""))
        made = F.transform(F.filter(titles, lambda x: x != ""), lambda x: F.struct(F.lit(kind).alias("source_kind"), match_text(x).alias("normalized_title"), x.alias("title")))
        return first_of(made, ["normalized_title"], "source_kind:string,normalized_title:string,title:string")

    return F.concat(*(of(k, p) for k, p in CARD_MARKS.items()))


def text_lines(c: Column | str) -> Column:
    """Lines of a text, at every line break that Python's splitlines knows."""
    return F.split(F.coalesce(_col(c), F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")


def headings(c: Column | str, limit: int = 8) -> Column:
    """Texts of the first Markdown headings. [F9]"""
    pattern = r"^#{1,6}\s+(.+?)\s*$"
    lines = F.when(_col(c).contains("#"), text_lines(c)).otherwise(F.array().cast("array<string>"))
    found = F.filter(lines, lambda x: x.rlike(pattern))
    named = F.transform(found, lambda x: collapse_ws(F.regexp_extract(x, pattern, 1)))
    return F.slice(F.filter(named, lambda x: x != ""), 1, limit)


def strip_frontmatter(c: Column | str) -> Column:
    """The text behind a leading `---` block."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"^---\r?\n(?s:.*?)\r?\n---\r?\n?", "")


def frontmatter(c: Column | str) -> Column:
    """`key: value` lines of the leading `---` block as a map (quotes at the ends dropped). [F11]"""
    block = F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"^---\r?\n((?s:.*?))\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*[^:\s][^:]*:"))
    key = lambda x: F.trim(F.regexp_extract(x, r"^([^:]+):", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", "")
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != key(x)), F.create_map(key(x), value(x))))
    return last


def lead_text(c: Column | str, most: int = 2600) -> Column:
    """The start of a document's text on one line, cut at a word. [F10]"""
    def cut(s: Column) -> Column:
        return F.when(F.length(s) <= most, s).otherwise(F.trim(F.regexp_replace(F.substring(s, 1, most), r"\s+\S*$", "")))

    # the start of a text tells its lead, unless too little is left of it without its white space
    text = F.when(_col(c).startswith("---"), strip_frontmatter(c)).otherwise(F.coalesce(_col(c), F.lit("")))
    return once(text, lambda x: once(collapse_ws(F.substring(x, 1, 2 * most)), lambda s: cut(F.when(F.length(s) > most, s).otherwise(collapse_ws(x)))))


def compact_description(c: Column | str, least: int = 40, most: int = 220) -> Column:
    """The first sentence if it is long enough, else the text; at most `most` characters, cut at a word. [F18]"""
    first = lambda s: F.regexp_extract(s, r"^(.+?[.!?])(?:\s|$)", 1)
    cut = lambda s: F.concat(F.regexp_replace(F.regexp_replace(F.substring(s, 1, most), r"\s+\S*$", ""), r"[\s.,;:]+$", ""), F.lit("..."))
    whole = once(collapse_ws(c), lambda s: once(first(s), lambda x: F.when(F.length(x) >= least, x).otherwise(s)))
    return once(whole, lambda s: F.when(F.length(s) <= most, s).otherwise(cut(s)))


def signal_terms(c: Column | str, longest: int = 4) -> Column:
    """A match text itself, its tokens, then its 2- to 4-word runs, first occurrences only. [F6]"""
    def terms(s: Column, words: Column) -> Column:
        def runs_of(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
            return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

        return F.filter(F.array_distinct(F.concat(F.array(s), words, *(runs_of(n) for n in range(2, longest + 1)))), lambda x: x != "")

    # the words are split once, not again for every run
    return once(match_text(c, "c"), lambda s: once(F.filter(F.split(s, " "), lambda x: x != ""), lambda words: terms(s, words)))


#: Letters that wrongly decoded UTF-8 leaves behind (fixed values).
MOJIBAKE_MARKS = ["\u00c3", "\u00c2", "\u00e2", "\ufffd"]


def mojibake_score(c: Column | str) -> Column:
    """How many signs of wrong decoding a text holds. [F12]"""
    s = F.coalesce(_col(c), F.lit(""))
    return F.length(s) - F.length(F.translate(s, "".join(MOJIBAKE_MARKS), ""))


#: Page numbers in file names, in the order they are tried; the first counts from zero (fixed patterns).
PAGE_PATTERNS = [r"_page_(\d+)_", r"page[-_]?(\d+)", r"pagina[-_]?(\d+)", r"pag[-_](\d+)", r"[-_]p(\d+)(?:[-_.]|$)", r"^(\d+)[-_]", r"[-_](\d+)\.[a-z]+$"]


def page_from_name(c: Column | str) -> Column:
    """The page that a file name tells, null if none. [F13]"""
    s = F.lower(F.coalesce(_col(c), F.lit("")))
    found = [F.nullif(F.regexp_extract(s, p, 1), F.lit("")).cast("int") for p in PAGE_PATTERNS]
    years = found[1:-1] + [F.when(found[-1] < 1900, found[-1])]  # a trailing year is no page
    return F.coalesce(found[0] + 1, *years)


def strip_pagination(c: Column | str) -> Column:
    """The text without page markers (a number line over a line of 40 or more hyphens) and bare number lines. [F16]"""
    s = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?m)^\d+\r?\n-{40,}$\r?\n?", "")
    return F.regexp_replace(s, r"(?m)^[ \t]*\d+[ \t]*$\r?\n?", "")


def strip_images(c: Column | str) -> Column:
    """The text without Markdown image references. [F17]"""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"!\[[^\]]*\]\([^)]*\)", "")


def relink_images(c: Column | str, base: str) -> Column:
    """Relative Markdown image references put below a folder. [F17]"""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(!\[[^\]]*\]\()(?!https?://|/|data:)(?:\./)?", "$1" + base.rstrip("/").replace("$", r"\$") + "/")


def clamp(c: Column | str, most: int, note: str = "\n\n> ...") -> Column:
    """At most `most` characters, cut at the end of a line, with a note behind it. [T4]"""
    s = F.coalesce(_col(c), F.lit(""))
    head = F.substring(s, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), "\n")
    cut = F.when(F.instr(head, "\n") > 0, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.rtrim(cut), F.lit(note)))


def strip_reasoning(c: Column | str) -> Column:
    """Generated text without `<think>` blocks and an English preamble line before the answer. [F29]"""
    s = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?is)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?is)^\s*<think>.*$", "")
    return strip(F.regexp_replace(strip(s), r"(?is)^(?:okay|ok|sure|here is|here's|let me|the user)[^\n]*\n+", ""))


def card_titles(c: Column | str) -> Column:
    """Distinct titles behind `Card:` or `T\u00f3pico:` at line starts. [F27]"""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit("(?im)^\\s*(?:[-*]\\s*)?(?:card|t[o\u00f3]pico)\\s*:\\s*(.+?)\\s*$"), F.lit(1))
    return F.array_distinct(F.transform(found, collapse_ws))


#: Signs of broken LaTeX: name, most points, points each, what every match holds (none: a letter beyond ASCII), pattern (fixed values).
LATEX_SIGNS = [("bare_symbols", 20, 4, "", "[\u2200\u2203\u2208\u2209\u2286\u2282\u222a\u2229\u2192\u21d2\u2194\u21d4\u00ac\u2227\u2228\u2264\u2265\u2260]"), ("hoare", 16, 8, "{", r"\{[^{}\n]*\}\s*[A-Za-z_]\w*\s*:?=\s*[^{}\n]*\{[^{}\n]*\}"), ("raw_commands", 20, 4, "\\", r"\\(?:frac|sum|int|forall|exists|alpha|beta|lambda|Rightarrow|rightarrow|land|lor|neg)\b"), ("orphan_escapes", 12, 3, "\\", r"\\(?![A-Za-z\\$%&#_{}()\[\] ,;:!\"'^~`=.|/<>*+-]).")]


def latex_corruption(c: Column | str) -> Column:
    """struct(score, signals, detected): points for odd `$`, unbalanced begin/end and braces, and stray signs. [F15]"""
    said = F.coalesce(_col(c), F.lit(""))
    plain = F.when(said.contains("```"), F.regexp_replace(said, r"(?s)```.*?```", "")).otherwise(said)
    # a pattern is counted only where the text holds a letter that each of its matches has
    count = lambda text, mark, p: F.when(text.contains(mark) if mark else F.octet_length(text) != F.length(text), F.regexp_count(text, F.lit(p))).otherwise(0)

    def points(s: Column, outside: Column) -> Column:
        return F.struct(
            F.when(count(s, "$", r"(?<!\\)\$") % 2 == 1, 30).otherwise(0).alias("odd_dollars"),
            F.least(F.lit(30), 15 * F.abs(count(s, "\\begin{", r"\\begin\{") - count(s, "\\end{", r"\\end\{"))).alias("environments"),
            F.least(F.lit(25), 5 * F.abs(count(s, "{", r"(?<!\\)\{") - count(s, "}", r"(?<!\\)\}"))).alias("braces"),
            *(F.least(F.lit(most), each * count(outside, mark, p)).alias(name) for name, most, each, mark, p in LATEX_SIGNS),
        )

    def scored(p: Column) -> Column:
        names = ["odd_dollars", "environments", "braces", *(x[0] for x in LATEX_SIGNS)]
        total = F.least(F.lit(100), sum((p[k] for k in names), F.lit(0)))
        signals = F.filter(F.array(*(F.when(p[k] > 0, F.lit(k)) for k in names)), lambda x: x.isNotNull())
        return F.struct(total.cast("int").alias("score"), signals.alias("signals"), (total >= 25).alias("detected"))

    outside = lambda s: F.when(s.contains("$"), F.regexp_replace(F.regexp_replace(s, r"(?s)\$\$.*?\$\$", ""), r"\$[^$\n]*\$", "")).otherwise(s)
    return once(plain, lambda s: once(once(outside(s), lambda o: points(s, o)), scored))
