"""URL filters, in DataFrame operations only: a list of fixed rules, and association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens that go with pages labelled as bad. Rules below a confidence, a lift
or a support (and LEAST_ROWS bad pages at least) are pruned, and so is a rule of which a part is a rule already. Pages
meet rules by an inverted index from a rule's rarest token: a rule fits a URL that holds all its tokens.

A frequent set of n tokens has 2^n parts, so three things are taken out before the mining, none of which changes what
the rules say: tokens that occur in too few bad pages; tokens that are a rule alone (a set with one is covered by it);
and, of tokens that occur in just the same pages, all but the least (such a token says what the least one says). The
tokens that always come together in the template of a URL are therefore one item, however many there are.

Defined cases: a null URL or one without "://" has an empty host and path and no fixed rule; one without "://" has only
the tokens it has, a null one has none and is allowed; repeated rows are judged each; without labels, or without rules that pass, all other pages are allowed; an empty table
gives an empty result. Extra columns are not returned.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from coursemill.llm.common import spread_join, staged

#: Fixed rules of the contract: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LEAST_CONFIDENCE, LEAST_SUPPORT, LEAST_LIFT, LEAST_ROWS = 0.6, 0.002, 1.5, 5
BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The frame with host and path of its URLs."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def fixed_rule(host: F.Column, path: F.Column, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """The longest rule that fits (host and path as one string) and its verdict, null where none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return tuple(F.coalesce(*(F.when(fits(h, p), F.lit(out)) for (_, h, p), out in zip(ordered, outs, strict=True))) for outs in ([h + p for _, h, p in ordered], [v for v, _, _ in ordered]))


def tokens(host: F.Column, path: F.Column, url: F.Column) -> F.Column:
    """Distinct tokens of a URL: host labels, the last two labels together, words of the path, query names, fragment."""
    labels = F.split(host, r"\.")
    words = F.filter(F.split(F.lower(path), r"[^a-z]+"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(
        named("host:", F.filter(labels, lambda x: x != "")),
        F.array(F.concat(F.lit("site:"), F.substring_index(host, ".", -2))),
        named("path:", words),
        named("query:", F.transform(query, lambda x: F.substring_index(x, "=", 1))),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ))


def mine(labelled: DataFrame, confidence: float = LEAST_CONFIDENCE, support: float = LEAST_SUPPORT, lift: float = LEAST_LIFT, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) from rows (tokens, bad): their tokens go with bad pages.

    A rule has at least `least_rows` bad pages and `support` of all rows, and a confidence of at least `confidence` and
    of `lift` times the share of bad pages.
    """
    rows = staged(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    least, sure = max(least_rows, support * n), max(confidence, lift * n_bad / n if n else 1.0)
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    # a token's pages as a count and two sums of hashes: equal for tokens that occur in the same pages
    pages = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"p{k}") for k in (1, 2)]
    counts = staged(each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("k"), *pages).filter(F.col("k") >= least), "tokens")
    alone = counts.filter(F.col("k") >= sure * F.col("n")).select(F.array("token").alias("tokens"), (F.col("k") / F.col("n")).alias("confidence"), (F.col("k") / F.lit(n)).alias("support"))
    items = counts.filter(F.col("k") < sure * F.col("n")).groupBy("n", "p1", "p2").agg(F.min("token").alias("token")).select("token")
    # at most (tokens of a URL) / support items, or fewer than the tokens of LEAST_ROWS / support rows: a few thousand
    left = each.join(F.broadcast(items), "token").groupBy("row").agg(F.collect_set("token").alias("items"), F.first("bad").alias("bad"))
    left = staged(left.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "items")
    if seen := left.count():  # supports are shares of the rows that FP-growth sees
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(least) - 0.5) / seen), minConfidence=min(1.0, sure)).fit(left)
        found = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.col("confidence") >= sure))
        alone = alone.union(found.select(F.col("antecedent").alias("tokens"), "confidence", F.col("support") * F.lit(seen / n)))
    rules = staged(alone.withColumn("rule_id", F.xxhash64(F.sort_array("tokens"))), "rules")
    # a rule is not needed where a part of its tokens is a rule: count the shared tokens by token
    by_token = rules.select("rule_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    small = by_token.select(F.col("rule_id").alias("small"), F.col("n").alias("m"), "token")
    covered = by_token.join(small, "token").filter("m < n").groupBy("rule_id", "small", "m").count().filter("count = m").select("rule_id").distinct()
    return rules.join(covered, "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct URLs (url) that hold all tokens of a rule; takes url, tokens.

    The index names a rule under the one of its tokens that fewest URLs hold; the others are looked up in the URL.
    """
    named = rules.select("rule_id", F.col("tokens").alias("rule"), F.explode("tokens").alias("token"))
    common = urls.select(F.explode("tokens").alias("token")).join(named.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    index = named.join(common, "token").groupBy("rule_id").agg(F.min(F.struct("count", "token")).alias("t"), F.first("rule").alias("rule")).select("t.token", "rule")
    held = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return held.filter(F.size(F.array_except("rule", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """Per page: the key, host, path, rule and verdict. Labels go by the page's id; a page is bad when its quality is 0
    or its toxic is 1."""
    cut = parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    cut = cut.withColumn("tokens", tokens(F.col("host"), F.col("path"), F.coalesce("url", F.lit(""))))
    bad = labels.select(F.col(label_id).alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).filter("id is not null and bad is not null")
    mined = staged(mine(cut.join(bad, "id").select("tokens", "bad")), "rules")
    rule, fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    out = cut.drop("tokens").withColumns({"rule": rule, "verdict": fixed})
    if mined.isEmpty():
        return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    hit = matched(staged(cut.filter("url is not null").select("url", "tokens").distinct(), "urls"), mined).withColumn("hit", F.lit(True))
    method = F.when(F.col("hit"), "block").otherwise("allow")
    hit = spread_join(staged(out.filter("url is not null"), "judged"), hit, ["url"], "id", how="left")
    out = hit.unionByName(out.filter("url is null").withColumn("hit", F.lit(None).cast("boolean")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))
