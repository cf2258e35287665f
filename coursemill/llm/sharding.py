"""Sharding by extendible hashing, in DataFrame operations only.

Every row gets 60 hash bits. A directory maps hash prefixes to shards: all rows start in one bucket (no bits), and only
a bucket over the byte limit is divided by one more bit, until each fits. As bytes only shrink with longer prefixes,
a row's shard is the shortest prefix whose bucket fits, so the directory comes from sums per prefix: 15 bits at a time,
and the next 15 only for prefixes that are still too large.

Defined cases: a null text has no bytes; null keys hash like any value; a row larger than the limit is alone in its
shard; fully equal rows cannot be told apart by bits, so where their bucket is too large they are numbered from 0 and cut
by count, which gives the same shards however the input is partitioned; an empty table gives an empty result. Extra columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from coursemill.llm.common import staged

BITS, STEP = 60, 15


def hash_bits(key: str, text: str) -> F.Column:
    """60 bits of the md5 of key and text, as a long."""
    whole = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def _directory(rows: DataFrame, low: int, limit: int) -> DataFrame:
    """For rows whose first `low` bits are too few: (leaf, depth, total) for each prefix of low + STEP bits; depth is
    null where even that prefix is over the limit and holds different hashes."""
    high = low + STEP
    leaf = F.expr(f"shiftright(h, {BITS - high})")
    leaves = rows.groupBy(leaf.alias("leaf")).agg(F.sum("n_bytes").alias("total"), F.min("h").alias("least"), F.max("h").alias("most"))
    by_depth = leaves.select("leaf", "total", "least", "most", F.explode(F.sequence(F.lit(low if low == 0 else low + 1), F.lit(high))).alias("depth"))
    prefix = F.expr(f"shiftright(leaf, {high} - depth)")
    sums = by_depth.groupBy("depth", prefix.alias("prefix")).agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    fits = sums.filter((F.col("total") <= limit) | (F.col("least") == F.col("most"))).select("depth", "prefix", "total")
    if low == 0:  # at most 2 ** (STEP + 1) rows; deeper down a prefix has at most 2 ** (STEP - 1) leaves
        fits = F.broadcast(fits)
    found = by_depth.select("leaf", "depth", prefix.alias("prefix")).join(fits, ["depth", "prefix"])
    best = found.groupBy("leaf").agg(F.min(F.struct("depth", "total")).alias("b")).select("leaf", "b.depth", "b.total")
    return leaves.select("leaf").join(best, "leaf", "left")


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per document: the key, n_bytes, shard (the prefix as 0s and 1s, with a suffix where equal rows are cut),
    shard_depth and shard_bytes (of the whole prefix); with `whole` also the document's row, as a struct `row`."""
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(id_col, text_col).alias("h"), *row)
    rows = staged(rows, "rows")
    todo, done = rows, None
    for low in range(0, BITS, STEP):
        high = low + STEP
        directory = staged(_directory(todo, low, limit), "directory")
        if low == 0:  # at most 2 ** 15 rows
            directory = F.broadcast(directory)
        placed = todo.withColumn("leaf", F.expr(f"shiftright(h, {BITS - high})")).join(directory, "leaf", "left").drop("leaf")
        now = placed.filter("depth is not null")
        done = now if done is None else done.union(now)
        if high == BITS or directory.filter("depth is null").isEmpty():
            break
        todo = staged(placed.filter("depth is null").drop("depth", "total"), "rows")
    bits = F.expr(f"case when depth = 0 then '' else lpad(bin(shiftright(h, cast({BITS} - depth as int))), cast(depth as int), '0') end")
    out = done.select("id", "n_bytes", "h", *(["row"] if whole else []), bits.alias("shard"), F.col("depth").cast("int").alias("shard_depth"), F.col("total").alias("shard_bytes"))
    # only equal rows are left in a bucket over the limit: cut them by their number, counted by task and then over tasks
    large = (F.col("shard_bytes") > limit) & (F.col("shard_bytes") > F.col("n_bytes"))
    over = staged(out.filter(large).withColumn("part", F.spark_partition_id()), "over")
    before = over.groupBy("h", "part").agg(F.count("*").alias("n")).select("h", "part", (F.sum("n").over(W.partitionBy("h").orderBy("part")) - F.col("n")).alias("before"))
    over = over.join(before, ["h", "part"]).withColumn("nth", F.col("before") + F.row_number().over(W.partitionBy("h", "part").orderBy("n_bytes")) - 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    over = over.withColumn("shard", F.concat("shard", F.lit("."), F.floor(F.col("nth") / each).cast("string")))
    done = ["id", "n_bytes", "shard", "shard_depth", "shard_bytes", *(["row"] if whole else [])]
    return out.filter(~large).select(*done).union(over.select(*done)).withColumnRenamed("id", id_col)


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet, one folder per shard; every row once, null and repeated ids too.

    A document's row goes with its shard through the operator, so nothing is joined back. A column `shard` of the
    documents is replaced; its values begin with a `b`, so that readers do not take the bits for numbers. A shard's rows
    are brought together before they are written, so it is one file.
    """
    columns = [c for c in docs.columns if c != "shard"]
    found = shard(docs, limit, id_col, text_col, whole=True)
    found.select(*(F.col("row")[c].alias(c) for c in columns), F.concat(F.lit("b"), "shard").alias("shard")).repartitionByRange("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int) -> str:
    """DuckDB SQL for `shard` over documents; prefixes of at most 20 bits, enough for tables of any test size."""
    return f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
d AS (SELECT r.*, depth::INTEGER AS depth, h >> (60 - depth)::INTEGER AS prefix FROM r, range(21) t(depth)),
s AS (SELECT *, sum(n_bytes) OVER w AS total, min(h) OVER w AS lo, max(h) OVER w AS hi FROM d WINDOW w AS (PARTITION BY depth, prefix)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS k FROM s WHERE total <= {limit} OR lo = hi)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth) END AS shard,
    depth AS shard_depth, total::BIGINT AS shard_bytes FROM f WHERE k = 1"""
