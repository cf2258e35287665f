"""Quality rules with host verdicts, in DataFrame operations only.

Each text gets its base measures inside its own row (no line or word is exploded or shuffled). Five rules ask for one
failure each: too few words, repeated windows of words, many symbols, repeated lines, odd word lengths. The first two
fail the document itself. The failures of every rule are summed by host; each rule has a beta prior of its own, fitted
to all hosts by moments that weigh a host by its documents and leave out the binomial part of the variance. A host is
rejected with all its documents when its rate of some rule, as the posterior has it, is almost surely (LEVEL) above
LEAST_RATE and above TIMES the common rate; the tail of the posterior is that of a normal with its mean and variance.

Defined cases: null and empty texts have no words and fail; a null host is no host, it gets no verdict; one host alone,
or hosts that differ by no more than chance, are shrunk to the common rate with the weight of all documents; repeated
rows count each; an empty table gives an empty result; extra columns stay where `measured` adds to a frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from coursemill.llm.common import spread_join, staged

#: The white space of the rules, and the marks that count as symbols (fixed values of the contract).
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, SPAN = 20, 30, 8
#: Rules over the measures.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and word_chars not between 3 * n_words and 12 * n_words",
}
#: A rejected host's rate of a rule is above LEAST_RATE and above TIMES the common rate with a chance of 0.99 (LEVEL standard
#: deviations of the posterior).
LEAST_RATE, TIMES, LEVEL = 0.25, 1.5, 2.326
BASE_RULES = ["short", "repeats"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The frame with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) and base_failed."""
    keep = [c for c in docs.columns if c not in (*MEASURES, "n_lines")]
    ws = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
    text = f"coalesce(`{text_col}`, '')"
    split = r"'[\\x20\\x09-\\x0D]+'"
    df = docs.selectExpr(
        *(f"`{c}`" for c in keep),
        f"case when trim(both {ws} from {text}) = '' then cast(array() as array<string>) else split(trim(both {ws} from {text}), {split}) end as __words",
        f"filter(split({text}, char(10)), x -> trim(both {ws} from x) != '') as __lines",
    )
    # hashes of words, then of 2, 4 and 8 words in a row
    df = df.selectExpr(*(f"`{c}`" for c in keep), "__lines", "size(__words) as __n", f"case when size(__words) >= {SPAN} then transform(__words, w -> xxhash64(w)) end as __h")
    for step in (1, 2, 4):
        m = f"(size(__h) - {step})"
        df = df.selectExpr(*(f"`{c}`" for c in keep), "__lines", "__n", f"zip_with(slice(__h, 1, {m}), slice(__h, {step + 1}, {m}), (a, b) -> xxhash64(a, b)) as __h")
    # windows found twice or more, by sorting; then the words that they cover
    df = df.selectExpr(*(f"`{c}`" for c in keep), "__lines", "__n", "case when size(array_distinct(__h)) < size(__h) then sort_array(zip_with(__h, sequence(0, size(__h) - 1), (h, p) -> named_struct('h', h, 'p', p))) end as __s")
    again = "(i > 0 and get(__s, i - 1).h = x.h) or (i < size(__s) - 1 and get(__s, i + 1).h = x.h)"
    df = df.selectExpr(*(f"`{c}`" for c in keep), "__lines", "__n", f"sort_array(transform(filter(__s, (x, i) -> {again}), x -> x.p)) as __p")
    covered = f"aggregate(__p, named_struct('last', -{SPAN}, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least({SPAN}, p - a.last)), a -> a.n)"
    measures = {
        "n_words": "cast(__n as long)",
        "word_chars": f"cast(char_length(translate({text}, {ws}, '')) as long)",
        "n_symbols": f"cast(char_length({text}) - char_length(translate({text}, '{SYMBOLS}', '')) as long)",
        "n_dup_lines": "cast(size(__lines) - size(array_distinct(__lines)) as long)",
        "n_lines": "cast(size(__lines) as long)",
        "n_repeat_words": f"cast(coalesce({covered}, 0) as long)",
    }
    # as rows of a generator: a later filter on the measures is not pushed below, where it would work them out again
    struct = ", ".join(f"'{k}', {v}" for k, v in measures.items())
    df = df.selectExpr(*(f"`{c}`" for c in keep), f"inline(array(named_struct({struct})))")
    return df.withColumn("base_failed", F.expr(" or ".join(RULES[r] for r in BASE_RULES)))


def failures() -> dict[str, Column]:
    """Each rule's failure as a column over the measures."""
    return {f"failed_{r}": F.expr(test) for r, test in RULES.items()}


def prior(n_hosts: float, total: float, squares: float, failed: float, spread: float) -> tuple[float, float]:
    """Mean and weight of a rule's beta prior from five sums over hosts: hosts, documents, their squares, failures, and
    squared failures by documents.

    The weighted variance of the rates, less what binomial chance gives, is the hosts' own correlation r; the weight is
    1 / r - 1, one document at least and all documents at most.
    """
    if not total:
        return 0.0, 1.0
    mean = failed / total
    chance = mean * (1 - mean)
    room = total - squares / total - (n_hosts - 1)
    if chance <= 0 or room <= 0:
        return mean, total
    own = ((spread - failed * mean) / chance - (n_hosts - 1)) / room
    return mean, min(total, max(1.0, 1 / own - 1)) if own > 0 else total


def host_verdicts(rows: DataFrame, host_col: str = "source") -> DataFrame:
    """Per host: n_docs, failed_* and rate_* (shrunk) of each rule, host_rate (the highest) and host_kept.

    rows: the host and a boolean failed_* for each rule.
    """
    sums = [F.count_if(F.col(f"failed_{r}")).alias(f"failed_{r}") for r in RULES]
    hosts = rows.filter(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count("*").alias("n_docs"), *sums)
    n = F.col("n_docs").cast("double")
    moments = [F.sum(x) for r in RULES for x in (F.col(f"failed_{r}").cast("double"), F.col(f"failed_{r}") * F.col(f"failed_{r}") / n)]
    got = [x or 0.0 for x in hosts.agg(F.count("*"), F.sum(n), F.sum(n * n), *moments).first()]  # a few numbers
    priors = {r: prior(*got[:3], *got[3 + 2 * i : 5 + 2 * i]) for i, r in enumerate(RULES)}
    rates = {f"rate_{r}": (F.col(f"failed_{r}") + F.lit(m * w)) / (n + F.lit(float(w))) for r, (m, w) in priors.items()}
    spread = lambda r, w: F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (n + F.lit(w + 1.0)))
    kept = [F.col(f"rate_{r}") - LEVEL * spread(r, w) <= max(LEAST_RATE, TIMES * m) for r, (m, w) in priors.items()]
    return hosts.withColumns(rates).withColumns({"host_rate": F.greatest(*rates), "host_kept": reduce(Column.__and__, kept)})


def _with_hosts(rows: DataFrame, hosts: DataFrame, host: str, by: Column) -> DataFrame:
    """Each row with its host's columns, null for a null host. Rows of a hot host are dealt by `by`; those of no host stay
    where they are."""
    named = spread_join(rows.filter(F.col(host).isNotNull()).withColumn("__by", by), hosts, [host], "__by", how="left").drop("__by")
    alone = rows.filter(F.col(host).isNull())
    return named.unionByName(alone, allowMissingColumns=True)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: the key, the base measures, base_failed, host_rate and kept."""
    rows = staged(measured(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(host_col).alias("__host")), "__text").drop("__text"), "measures")
    hosts = host_verdicts(rows.select("__host", *(c.alias(k) for k, c in failures().items())), "__host").select("__host", "host_rate", "host_kept")
    out = _with_hosts(rows, hosts, "__host", F.hash("__id", "n_words", "word_chars"))
    return out.select(F.col("__id").alias(id_col), *MEASURES, "host_rate", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def kept_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns only.

    The measures are worked out once; what passes them is staged with its text, what fails with its host alone.
    """
    rows = measured(docs.select(*docs.columns), text_col)
    own = [F.when(~F.col("base_failed"), F.col(c)).alias(c) if c != host_col else F.col(c) for c in docs.columns]
    rows = staged(rows.select(*own, F.col("base_failed").alias("__failed"), *(c.alias(k) for k, c in failures().items())), "rules")
    bad = staged(host_verdicts(rows, host_col).filter("not host_kept").select(host_col), "hosts")
    good = rows.filter("not __failed").select(*docs.columns)
    if bad.isEmpty():
        return good
    marked = _with_hosts(good, bad.withColumn("__bad", F.lit(True)), host_col, F.xxhash64(*docs.columns))
    return marked.filter("__bad is null").select(*docs.columns)


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS words,
    list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT r, p, array_to_string(words[p:p + 7], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8)),
d AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS k FROM g) WHERE k > 1),
c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM d) GROUP BY r),
b AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, {" OR ".join(RULES[r] for r in BASE_RULES)} AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"count(*) FILTER ({test})::DOUBLE AS k_{r}" for r, test in RULES.items())} FROM f WHERE source IS NOT NULL GROUP BY source),
e AS (SELECT source, n, unnest([{", ".join(f"{{'rule': '{r}', 'k': k_{r}}}" for r in RULES)}], recursive := true) FROM h),
m AS (SELECT rule, count(*) AS hosts, sum(n) AS total, sum(k) / sum(n) AS m, sum(k * k / n) - sum(k) * (sum(k) / sum(n)) AS s, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM e GROUP BY rule),
o AS (SELECT *, CASE WHEN m * (1 - m) > 0 AND room > 0 THEN (s / (m * (1 - m)) - (hosts - 1)) / room ELSE 0 END AS own FROM m),
p AS (SELECT rule, m, CASE WHEN own > 0 THEN least(total, greatest(1.0, 1 / own - 1)) ELSE total END AS weight FROM o),
q AS (SELECT source, m, n + weight + 1 AS t, (k + m * weight) / (n + weight) AS rate FROM e JOIN p USING (rule)),
s AS (SELECT source, bool_and(rate - {LEVEL} * sqrt(rate * (1 - rate) / t) <= greatest({LEAST_RATE}, {TIMES} * m)) AS host_kept FROM q GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept
FROM f LEFT JOIN s USING (source)"""
