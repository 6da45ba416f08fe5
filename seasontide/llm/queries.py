"""One query per training-data operator, over the whole of its table, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasontide.llm import (
    centroids, chat, forest, grid_join, language, mixing, packing, pieces, quality, ranked, suffixes, token_files, warc,
)
from seasontide.llm.common import table


def op1_warc_records(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf, "documents"), k=3, percent=85)


def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf, "documents"), seat="seat")
    mixed = mixing.read_back(mixing.training_order(plan, "seat"), "seat")
    position = lambda i: F.round(F.get("positions", F.lit(i)), 6)
    return mixed.withColumns({"position": position(0), "second_position": position(1)}).drop("positions")


def op5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_format_chats(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = chat.conversation_messages(rows)
    return chat.read_back(chat.format_paths(chat.root_paths(messages), messages))


def op7_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf, "documents"))


def op8_vector_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return grid_join.near_duplicates(table(spark, sf, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    rated = quality.rate(table(spark, sf, "documents"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op10_languages(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked.search(table(spark, sf, "benchmark"), table(spark, sf, "documents"), k=50)


def op12_pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op13_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.summarised(table(spark, sf, "embeddings"))


QUERIES = {
    "op1_warc_records": (op1_warc_records, warc.ORACLE),
    "op2_token_files": (op2_token_files, None),
    "op3_near_duplicates": (op3_near_duplicates, None),
    "op4_mix_sources": (op4_mix_sources, mixing.ORACLE),
    "op5_pieces": (op5_pieces, None),
    "op6_format_chats": (op6_format_chats, chat.ORACLE),
    "op7_repeated_passages": (op7_repeated_passages, None),
    "op8_vector_duplicates": (op8_vector_duplicates, None),
    "op9_quality_rules": (op9_quality_rules, None),
    "op10_languages": (op10_languages, None),
    "op11_ranked_search": (op11_ranked_search, ranked.oracle()),
    "op12_pack_sequences": (op12_pack_sequences, None),
    "op13_centroid_clusters": (op13_centroid_clusters, centroids.oracle()),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries():
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
