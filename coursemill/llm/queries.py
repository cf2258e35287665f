"""The subpackage's registered queries and their SQL: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemill.llm import bpe_codec, embedding_dedup, line_dedup, minhash, packing, quality_classifier, quality_rules, sharding, source_divergence, spelling_variants, token_counts, toxicity, url_filters


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later occurrences of three-line windows."""
    return line_dedup.dedup(_documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of at most 1 MiB of text."""
    return sharding.shard(_documents(spark, sf_dir), SHARD_BYTES)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them, as digests."""
    both = bpe_codec.round_trip(_documents(spark, sf_dir), _tokenizer())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base measures and verdict, the host's rate considered."""
    return quality_rules.judge(_documents(spark, sf_dir)).select("doc_id", *quality_rules.MEASURES, "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return quality_classifier.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, fixed rule and verdict."""
    return url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links at a similarity of 0.8 over two-word shingles."""
    found = minhash.near_duplicates(_documents(spark, sf_dir), k=minhash.PAIR_WORDS, threshold=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links at a cosine of 0.98 within its label, and its component."""
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    return packing.pack(_documents(spark, sf_dir), _tokenizer(), end_id=2)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it has more than 1024 tokens."""
    return token_counts.count_tokens(_documents(spark, sf_dir), _tokenizer())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, its form and its root."""
    return spelling_variants.variants(_documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and the terms that it uses more than its language."""
    return source_divergence.divergence(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_extendible_sharding": op2_extendible_sharding,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_url_filters": op7_url_filters,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_token_counts": op11_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_extendible_sharding": sharding.oracle(SHARD_BYTES),
    "op4_quality_rules": quality_rules.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
