"""The queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm import embedding_dedup, html_text, language_model, mixing, nearest, ngram_join, packing, ranking, sharding, spelling, suffix_dedup, token_counts, toxicity

#: Shards of op1.
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.fit_on_labels(documents, _table(spark, sf_dir, "labels")))


def op3_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(_table(spark, sf_dir, "documents"))


def op5_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op6_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_along_curve(_table(spark, sf_dir, "documents"), tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op9_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.bpe_token_counts(_table(spark, sf_dir, "documents"), tokenizer())


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_by_product(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op11_wildcard_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_counting_sort_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_sale_lines(_table(spark, sf_dir, "sale_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hypergeometric_shards, op2_classifier_chain, op3_projection_passes, op4_mix_to_targets, op5_maxent_scores, op6_line_block_text, op7_hilbert_packing, op8_token_group_join, op9_bpe_token_counts, op10_projection_forest, op11_wildcard_spellings, op12_deep_shallow_dedup, op13_counting_sort_places)}
ORACLE_SQL: dict[str, str] = {"op3_projection_passes": embedding_dedup.SQL, "op4_mix_to_targets": mixing.SQL, "op8_token_group_join": ngram_join.SQL, "op11_wildcard_spellings": spelling.SQL, "op12_deep_shallow_dedup": suffix_dedup.SQL, "op13_counting_sort_places": ranking.SQL}
