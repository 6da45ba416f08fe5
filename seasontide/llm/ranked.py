"""Ranked lexical search as blocked matrix products in double precision.

Items are dealt into blocks of bounded vocabulary. For each block one pass over the
documents keeps, per document, its length and the terms that the block asks for. Term
weights follow from counts over all documents. Then a task multiplies tiles: item
weights over a run of the vocabulary times the impacts of a run of documents on the
same terms, with the terms that no document of the run holds left out. Weights and
impacts are whole numbers, and a run of terms is so short that every partial sum stays
below 2 ** 53, so the products are exact; runs are added up in 64-bit integers. Each
task keeps the best documents of each item in the total order of score and id, so that
ties never depend on tiles, tasks or partitions.
"""

from __future__ import annotations

import collections
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasontide.functions.ordering import first_n
from seasontide.llm.common import stored

#: Item terms that go to the workers at a time; more items make more blocks, each with its own pass.
BLOCK_TERMS = 500_000
#: Documents, items and terms of a tile.
TILE_DOCUMENTS, TILE_ITEMS, TILE_TERMS = 512, 512, 4096
#: No impact is above this: (SCALE * tf) div (SCALE / IMPACT * tf + ...).
SCALE, IMPACT = 1_000_000_000, 1_000_000
#: Lanes over which the best documents of one item are sifted before they meet in one window.
LANES = 64

# Term characters are letters and digits of ASCII and all beyond it; A-Z count as a-z.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_TABLE).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows that share an id are one item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms(t or b""))) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([t for f in found for t in f], pa.binary())],
                ["item_id", "term"],
            )

    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _postings(documents: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, ids, tfs) of documents with a term: length, and the vocabulary's terms with their counts."""

    def run(batches):
        place = vocabulary.value
        for batch in batches:
            sizes, keep, ids, tfs, held = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = terms(text.as_py() or b"")
                if found:
                    counts = collections.Counter(map(place.get, found))
                    counts.pop(None, None)
                    keep.append(i)
                    sizes.append(len(found))
                    held.append(len(counts))
                    ids.extend(counts)
                    tfs.extend(counts.values())
            ends = pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                ],
                ["doc_id", "n", "ids", "tfs"],
            )

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, ids array<int>, tfs array<long>")


class _Best:
    """The best documents of each item so far, by score, then by id, those without an id last."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.least = np.ones(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, first_item: int, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        """``scores`` of items (rows) and documents (columns)."""
        item, doc = np.nonzero(scores >= self.least[first_item : first_item + len(scores), None])
        if len(item):
            self.parts.append((item + first_item, scores[item, doc], ids[doc], absent[doc]))
            self.waiting += len(item)
            if self.waiting > 4 * self.items * self.k + (1 << 16):
                self.sift()

    def sift(self) -> tuple[np.ndarray, ...]:
        item, score, ids, absent = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, absent, -score, item))
        item, score, ids, absent = item[order], score[order], ids[order], absent[order]
        begins = np.searchsorted(item, np.arange(self.items + 1))
        keep = np.arange(len(item)) - begins[item] < self.k
        full = np.flatnonzero(np.diff(begins) >= self.k)
        # an equal score may still win by its id
        self.least[full] = score[begins[full] + self.k - 1]
        held = item[keep], score[keep], ids[keep], absent[keep]
        self.parts, self.waiting = [held], 0
        return held


def _scores(postings: DataFrame, block, k: int, item_kind: str) -> DataFrame:
    """(item_id, doc_id, score, lane): each task's best documents of each item."""

    def run(batches):
        b = block.value
        documents, total, starts, owned, weights = (b[x] for x in ("documents", "total", "starts", "terms", "weights"))
        width = int(min(TILE_TERMS, max(1, (1 << 53) // (IMPACT * max(int(weights.max(initial=0)), 1)))))
        count = len(starts) - 1
        best = _Best(count, k)
        column = np.full(len(weights), -1)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCUMENTS):
                part = batch.slice(at, TILE_DOCUMENTS)
                held = np.diff(np.asarray(part.column(2).offsets))
                doc = np.repeat(np.arange(len(part)), held)
                ids = np.asarray(part.column(2).flatten(), np.int64)
                tf = np.asarray(part.column(3).flatten(), np.int64)
                m = 50 + (50 * np.asarray(part.column(1), np.int64) * documents) // total
                impact = ((SCALE * tf) // (SCALE // IMPACT * tf + 20 * m[doc])).astype(float)
                present, spot = np.unique(ids, return_inverse=True)
                names = part.column(0)
                numbers = np.asarray(names.fill_null(0), np.int64)
                absent = np.asarray(names.is_null())
                for i in range(0, count, TILE_ITEMS):
                    j = min(i + TILE_ITEMS, count)
                    mine = owned[starts[i] : starts[j]]
                    row = np.repeat(np.arange(j - i), np.diff(starts[i : j + 1]))
                    scores = np.zeros((j - i, len(part)), np.int64)
                    for c in range(0, len(present), width):
                        tile = present[c : c + width]
                        column[tile] = np.arange(len(tile))
                        where = column[mine]
                        asked = where >= 0
                        left = np.zeros((j - i, len(tile)))
                        left[row[asked], where[asked]] = weights[mine[asked]]
                        column[tile] = -1
                        if asked.any():
                            inside = (spot >= c) & (spot < c + len(tile))
                            right = np.zeros((len(tile), len(part)))
                            right[spot[inside] - c, doc[inside]] = impact[inside]
                            scores += (left @ right).astype(np.int64)
                    best.offer(i, scores, numbers, absent)
        if best.parts:
            item, score, ids, absent = best.sift()
            lane = TaskContext.get().partitionId() % LANES
            yield pa.RecordBatch.from_arrays(
                [
                    b["items"].take(pa.array(item)), pa.array(ids, mask=absent), pa.array(score),
                    pa.array(np.full(len(item), lane, np.int32)),
                ],
                ["item_id", "doc_id", "score", "lane"],
            )

    return postings.mapInArrow(run, f"item_id {item_kind}, doc_id long, score long, lane int")


def search(items: DataFrame, documents: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, equal scores by doc_id.

    ``items`` has (item_id, text), ``documents`` (doc_id, text) with whole-number ids.
    Documents with a score of 0 are left out, so an item may have fewer, or none. Rows
    that share an item_id, also null, are one item that holds the terms of all of them.
    Rows that repeat a doc_id count and rank as documents of their own; a null doc_id
    comes after others of an equal score. Null texts have no terms.
    """
    spark = documents.sparkSession
    wanted = stored(_item_terms(items), "item-terms")
    blocks = -(-wanted.count() // BLOCK_TERMS)
    item_kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for n in range(blocks):
        # about BLOCK_TERMS rows; one item of a longer text is a row that a task holds anyway
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).orderBy("item_id", "term").toArrow()
        if not mine.num_rows:
            continue
        names = mine.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        starts = np.searchsorted(np.asarray(names.indices), np.arange(len(names.dictionary) + 1))
        coded = mine.column("term").combine_chunks().dictionary_encode()
        vocabulary = spark.sparkContext.broadcast({t: i for i, t in enumerate(coded.dictionary.to_pylist())})
        postings = stored(_postings(documents, vocabulary), "postings")
        whole = postings.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
        if not whole["documents"]:
            break
        df = np.zeros(len(coded.dictionary), np.int64)
        # one row per term of the block
        for r in postings.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
            df[r["id"]] = r["count"]
        weights = [math.floor(1000 * math.log((2 * whole["documents"] + 2) / (2 * x + 1))) for x in df.tolist()]
        block = spark.sparkContext.broadcast(
            {
                "documents": whole["documents"],
                "total": whole["total"],
                "items": names.dictionary,
                "starts": starts,
                "terms": np.asarray(coded.indices),
                "weights": np.array(weights, np.int64),
            }
        )
        rows = stored(_scores(postings, block, k, item_kind), "best")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # a hot item is sifted in lanes first
    few = first_n(found, ["item_id", "lane"], order, k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return few.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 50) -> str:
    """The same rows by plain SQL."""
    # a class of characters, written for the pattern language of the SQL engine
    split = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS t FROM documents),
    s AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
    i AS (SELECT DISTINCT item_id, unnest({split}) AS term FROM benchmark),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM p, s WHERE term IN (SELECT term FROM i) GROUP BY term, s.n),
    m AS (SELECT r, doc_id, 50 + (50 * len(t) * s.n) // s.l AS m FROM d, s WHERE len(t) > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
        WHERE score > 0) WHERE rank <= {k}"""
