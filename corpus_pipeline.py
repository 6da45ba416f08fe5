"""A corpus from raw documents to token ids: quality, near duplicates, repeats, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasontide.functions.ordering import keep_first
from seasontide.llm import forest, mixing, pieces, quality, suffixes
from seasontide.llm.common import stored


def _packed(docs: DataFrame) -> DataFrame:
    """(_key, _row): whole rows in a struct, so that no column name clashes; equal rows share a key."""
    return docs.select(F.xxhash64(*docs.columns).alias("_key"), F.struct(*docs.columns).alias("_row"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    keyed = docs.select("doc_id", "text", "lang", "source", F.xxhash64(*docs.columns).alias("_key"))
    kept = quality.rate(keyed, ("_key",)).where("kept").select("_key").distinct()
    return _packed(docs).join(kept, "_key", "left_semi").select("_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, 0.8).

    Rows that repeat a doc_id with different texts are documents of their own, in the
    order of a hash of their texts, and named by a hash for the search. Of rows that
    agree in doc_id and text the one with the smallest hash of the whole row stays.
    Rows with a null doc_id all stay.
    """
    named = docs.where("doc_id is not null")
    texts = named.select("doc_id", F.xxhash64("text").alias("_print"))
    several = texts.groupBy("doc_id").agg(F.min("_print").alias("a"), F.max("_print").alias("z")).where("a != z").select("doc_id")
    # stored, so that Spark sees how few they mostly are and moves no texts to look them up
    several = stored(several.select(F.col("doc_id").alias("_id")), "several")
    name = F.when(F.col("_id").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "_print"))
    known = (
        named.select("doc_id", "text", F.xxhash64("text").alias("_print"))
        .join(several, F.col("doc_id") == F.col("_id"), "left")
        .select("doc_id", "text", "_print", name.alias("_name"))
    )
    found = forest.near_duplicates(known.select(F.col("_name").alias("doc_id"), "text"), k=5, percent=80)
    groups = known.select("_name", "doc_id", "_print").join(
        found.select(F.col("doc_id").alias("_name"), "component_id").distinct(), "_name"
    )
    kept = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "_print")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_id"), F.col("k._print").alias("_kept"))
    rows = named.select(
        F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_print"), F.xxhash64(*docs.columns).alias("_key"), F.struct(*docs.columns).alias("_row")
    )
    one = rows.join(kept, (F.col("_doc") == F.col("_id")) & (F.col("_print") == F.col("_kept")), "left_semi")
    one = keep_first(one, ["_doc", "_print"], ["_key"]).select("_row.*")
    return one.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier place has; n_chars follows the text."""
    cleaned = suffixes.remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def training_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row per read of a document, the last read of a source cut at its target.

    Equal rows are documents of their own in the plan; each of their reads is one row.
    """
    keyed = docs.select("doc_id", "text", "source", F.xxhash64(*docs.columns).alias("_key"))
    plan = mixing.mix(keyed, keep=("_key",)).select("_key", "size", "taken", "positions")
    rows = _packed(docs).dropDuplicates(["_key"]).join(mixing.reads(plan), "_key")
    # pieces of a text that each end with a word
    whole = F.col("_row")["text"]
    ends = F.split(whole, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(ends, 1, F.col("words").cast("int")), "")).otherwise(whole)
    rows = rows.withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)}
    row = F.struct(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
    cut = rows.select("position", F.col("_row")["doc_id"].alias("doc_id"), row.alias("_row"))
    return mixing.in_order(cut, "doc_id").select("_row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and decoded texts of every row, as digests."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", training_mix),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Sketches, estimates by iteration and piece ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
