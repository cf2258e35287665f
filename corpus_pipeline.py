"""The corpus pipeline: quality classifier, quality rules, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. `run` writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemill.llm import line_dedup, minhash, packing, quality_classifier, quality_rules
from coursemill.llm.common import staged
from coursemill.llm.training import fold

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier scores at its threshold or above."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("id", 5) != 0)
    scored = quality_classifier.score(docs, model, keep=COLUMNS)
    return scored.filter(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the quality rules."""
    return quality_rules.kept_documents(docs).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows from the texts; every document stays."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates over two-word sets, as `op8_minhash_near_dedup` groups them.

    It is the row with the smallest id. Of rows with the same id the least by text stays; a row with a null id stays
    only where no row with an id has the same set, one of each set. Documents without a word all stay.
    """
    rows = minhash.near_duplicates(docs, k=minhash.PAIR_WORDS, threshold=80)
    kept = rows.filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select(*COLUMNS)
    many = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")  # odd tables only
    least = named.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return named.join(many, "doc_id", "left_anti").select(*COLUMNS).union(least.select(*COLUMNS)).union(minhash.unnamed_firsts(docs, minhash.PAIR_WORDS).select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: A trained classifier is not expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
