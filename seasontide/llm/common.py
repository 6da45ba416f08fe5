"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasontide.functions.checkpoints import ensure_checkpoint_dir

# A word is a run of bytes outside space and \t..\r; both sets are ASCII, so bytes do for UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[_SPACE] = 0
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
#: Bytes hashed at a time, so that temporaries stay small whatever a text's length.
_CHUNK = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(array: pa.Array, size: int = 4 << 20):
    """Cut a text column into runs of about ``size`` bytes: (first row, bytes, row offsets)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    values = array.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(array))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


_powers = [np.ones(1, np.uint64)]


def _power_table(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        grown = np.full(max(n, 256), _BASE, np.uint64)
        grown[0] = 1
        _powers[0] = np.cumprod(grown, dtype=np.uint64)
    return _powers[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: bool):
    """64-bit hashes of all words of a run of texts, and the index of each text's first word.

    ``fold`` reads A-Z as a-z. The second result has one entry more than there are texts.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    starts = np.flatnonzero(word & ~before)
    del word, before
    codes = _FOLDED if fold else _BYTES
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _CHUNK)))
        begin, end = starts[first], starts[last] if last < len(starts) else n
        own = starts[first:last] - begin
        length = np.diff(own, append=end - begin)
        place = np.arange(end - begin) - np.repeat(own, length)
        part = codes[data[begin:end]]
        part *= _power_table(int(length.max()))[place]
        hashes[first:last] = np.add.reduceat(part, own)
        first = last
    return mix(hashes), np.searchsorted(starts, offsets).astype(np.int64)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int):
    """Hashes of all k-word windows inside each text, and the index of each text's first one."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    n = len(hashes) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * _BASE + hashes[i : i + n]
    total = mix(total)
    first = np.concatenate(([0], np.cumsum(counts)))
    where = np.arange(first[-1]) - np.repeat(first[:-1] - bounds[:-1], counts)
    return total[where], first


def spread(df: DataFrame, per_core: int = 3) -> int:
    """A number of partitions for narrow Python work."""
    return max(df.sparkSession.sparkContext.defaultParallelism * per_core, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
