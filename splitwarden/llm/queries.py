"""One query for each operator over its whole table, as the driver calls them: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ftrl, jaccard_join, line_spread, pivot_search, poisson_mix, preference_format, secret_scan, source_divergence, substring_index, suffix_shards, templates, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return pivot_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least_words=templates.PLAIN)


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(_table(spark, sf_dir, "documents"))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    rejected = preference_format.swapped(turns)
    return preference_format.digest(preference_format.preference_pairs(turns, rejected))


def op4_preference_formatting_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for every answered conversation; the query above keeps to the pairs of its SQL."""
    turns = _table(spark, sf_dir, "conversations")
    return preference_format.digest(preference_format.preference_pairs(turns, preference_format.rotated(turns)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.digest(substring_index.remove_repeats(_table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", ftrl.QUALITY, 4, 2, 0.7)


def op7_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "toxic", ftrl.TOXICITY, 5, 0, 0.5)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_shards.digest(suffix_shards.remove_later_copies(_table(spark, sf_dir, "documents")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.digest(line_spread.remove_spread_lines(_table(spark, sf_dir, "documents")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(_table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(_table(spark, sf_dir, "embeddings"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_top_k": pivot_search.SQL, "op3_poisson_mixing": poisson_mix.SQL, "op4_preference_formatting": preference_format.SQL, "op5_substring_dedup": substring_index.SQL, "op9_jaccard_join": jaccard_join.SQL, "op10_line_spread": line_spread.SQL, "op11_source_divergence": source_divergence.SQL, "op12_secret_scan": secret_scan.SQL, "op13_vector_codes": vector_codes.SQL}
