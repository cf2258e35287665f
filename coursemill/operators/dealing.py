"""Keys dealt over tasks by their weight: what one course holds of all rows decides how many parts it is cut into."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that always stay together, and the share of all rows (one in so many) from which a key is hot.
TOGETHER, HOT_SHARE = 2_000, 1_000


def deal(rows: DataFrame, side: DataFrame, by: str, key: str = "course_id", together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """Both frames with `__part`: rows of a hot key are dealt over parts by a hash of `by`, its rows of `side` are sent to each.

    Rows are counted first. A key is hot with more than a HOT_SHARE-th of all rows (or `together`, if that is more), so there
    are fewer than HOT_SHARE hot keys and they are broadcast; each gets as many parts as it has such shares. Null keys stay.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    most = max(together, (counts.agg(F.sum("__n")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(counts.filter(F.col("__n") > most).select(key, F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    sent = side.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt, sent
