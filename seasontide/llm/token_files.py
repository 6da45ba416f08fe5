"""Token-id files in ORC.

One row per document: doc_id, start (ids of all documents before it within the
file), n_tokens and ids. ORC run-length encodes the integers of each stripe and
keeps row indexes and a Bloom filter on doc_id, so that readers split files by
stripe and skip stripes and row groups by doc_id. Files hold disjoint, ascending
ranges of doc_id; a small table of their totals turns local starts into global ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasontide.llm.chunk_ids import encoder, runs
from seasontide.llm.common import scratch, stored

#: Bytes of texts encoded together; the sort before and the file writer behind need memory too.
TEXT_BYTES = 4 << 20


def encode(documents: DataFrame, tokenizer: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) in ascending doc_id order, in partitions that become files.

    ``end_id`` is appended to each document; a null text is empty and has it alone.
    start counts the ids before the row within its partition. Rows that repeat an id
    stay apart, in the order of their texts; null ids come first; other columns are
    left out. Strings of special tokens inside a text get their ids, as the library does
    by default.
    """

    def run(batches):
        start = 0
        for batch in batches:
            for at, texts in runs(batch.column(1), TEXT_BYTES):
                ids, bounds = encoder(tokenizer, spaced=True).encode(texts, end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                start += len(ids)

    rows = documents.select("doc_id", "text")
    rows = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids array<int>"
    )


def write(encoded: DataFrame, path: str, stripe_mb: int = 64) -> str:
    """Write one ORC file per partition, with row indexes and Bloom filters on doc_id."""
    (
        encoded.write.option("orc.stripe.size", stripe_mb << 20)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "zstd")
        .orc(path)
    )
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): rows of the files with starts over the whole corpus.

    Filters on doc_id reach the stripe and row-group indexes. The files' totals are
    one row per file; only the narrow columns are read for them, and they are stored, so
    that Spark knows their size and sends them to the rows instead of the rows to them.
    """
    schema = spark.read.orc(path).schema
    rows = spark.read.schema(schema).orc(path).withColumn("_file", F.col("_metadata.file_name"))
    # file names carry the partition numbers, which ascend with doc_id
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy("_file")
        .agg(F.sum("n_tokens").alias("_n"))
        .withColumn("_part", F.regexp_extract("_file", r"part-(\d+)", 1).cast("long"))
        .select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return rows.join(stored(totals, "totals"), "_file").select(
        "doc_id", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", "ids"
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            data = np.asarray(ids.values).astype("<i4", copy=False)
            offsets = np.asarray(ids.offsets)
            crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(documents: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Encode, write, read back and digest; an empty table gives no rows."""
    spark = documents.sparkSession
    path = write(encode(documents, tokenizer), path or scratch(spark, "tokens"))
    return checksums(read(spark, path))
