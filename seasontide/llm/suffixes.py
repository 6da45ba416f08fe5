"""Repeated passages by sparse suffix arrays.

A suffix of a document is retained where the hash of its first SEED words is the
smallest among all SEED-word runs of a passage of ``least`` words (a minimiser). Two
equal passages have the same minimiser at the same place, so every repeated passage
shows as two retained suffixes with equal heads. The retained suffixes of the corpus
are sorted by their heads, and each is compared with its neighbours. Suffixes that
agree with one are extended left and right: all passages of ``least`` words around
them are compared as a whole, which is linear however often a passage occurs, and
the repeated ones are joined to maximal spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasontide.llm.common import hash_words, slices, stored, windows

#: Words of a passage, and words by which suffixes are sorted.
LEAST, SEED = 50, 8


def _minimisers(heads: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of each ``width`` consecutive hashes."""
    at, span = np.arange(len(heads)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(heads[left] <= heads[right], left, right)
        span += step
    return at


def _heads(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, print1, print2, n_words, heads, places): retained suffixes of each text of ``least`` words or more; stored."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(1), 1 << 20):
                words, bounds = hash_words(data, offsets, fold=False)
                runs, first = windows(words, bounds, SEED)
                out = []
                for i in range(len(offsets) - 1):
                    n = int(bounds[i + 1] - bounds[i])
                    if n >= least:
                        own = runs[first[i] : first[i + 1]]
                        places = np.unique(_minimisers(own, least - SEED + 1))
                        out.append((row + i, n, own[places].view(np.int64), places.astype(np.int32)))
                if out:
                    rows = pa.array([x[0] for x in out])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows), batch.column(2).take(rows), batch.column(3).take(rows),
                            pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64())),
                            pa.array([x[3] for x in out], pa.list_(pa.int32())),
                        ],
                        ["doc_id", "print1", "print2", "n_words", "heads", "places"],
                    )

    # two hashes of the whole text tell exact copies
    rows = documents.where("doc_id is not null").select(
        "doc_id", "text", F.xxhash64("text").alias("print1"), F.xxhash64(F.lit(1), "text").alias("print2")
    )
    schema = "doc_id long, print1 long, print2 long, n_words long, heads array<long>, places array<int>"
    return stored(rows.mapInArrow(run, schema), "suffixes")


def _matched(suffixes: DataFrame) -> DataFrame:
    """(doc_id, print1, place) of suffixes whose head equals that of a neighbour in sorted order.

    The order has the text and place as its last keys, so no head is hot. Rows at
    the ends of a range are kept, as one neighbour isn't seen.
    """
    order = ["head", "doc_id", "print1", "place"]
    ordered = suffixes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        last, linked = None, True

        def emit(ids, prints, places, keep):
            columns = [pa.array(ids[keep]), pa.array(prints[keep]), pa.array(places[keep].astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "print1", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            heads, ids, prints, places = (np.asarray(batch.column(i)) for i in range(4))
            if last is not None:
                heads, ids, prints, places = (np.concatenate(x) for x in zip(last, (heads, ids, prints, places)))
            equal = heads[1:] == heads[:-1]
            keep = np.concatenate(([linked], equal))
            keep[:-1] |= equal
            last, linked = (heads[-1:], ids[-1:], prints[-1:], places[-1:]), bool(keep[-1])
            yield emit(ids[:-1], prints[:-1], places[:-1], keep[:-1])
        if last is not None:
            yield emit(*last[1:], np.array([True]))

    return ordered.mapInArrow(run, "doc_id long, print1 long, place int")


def _passages(documents: DataFrame, matched: DataFrame, least: int) -> DataFrame:
    """(passage, doc_id, print1, start): passages of ``least`` words whose minimiser is a matched suffix; stored."""
    key = ["doc_id", "print1"]
    places = matched.groupBy(*key).agg(F.collect_set("place").alias("places"))
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("print1"))
    rows = texts.join(places, key).select("doc_id", "text", "places", "print1")

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(1), 1 << 20):
                words, bounds = hash_words(data, offsets, fold=False)
                runs, first = windows(words, bounds, SEED)
                whole, begin = windows(words, bounds, least)
                for i in range(len(offsets) - 1):
                    at = _minimisers(runs[first[i] : first[i + 1]], least - SEED + 1)
                    wanted = np.asarray(batch.column(2)[row + i].values)
                    starts = np.flatnonzero(np.isin(at, wanted))
                    if len(starts):
                        own = whole[begin[i] : begin[i + 1]][starts].view(np.int64)
                        ids, prints = (pa.repeat(batch.column(c)[row + i], len(starts)) for c in (0, 3))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own), ids, prints, pa.array(starts.astype(np.int32))],
                            ["passage", "doc_id", "print1", "start"],
                        )

    return stored(rows.mapInArrow(run, "passage long, doc_id long, print1 long, start int"), "passages")


def repeated_spans(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): spans that repeat an earlier passage.

    A passage is ``least`` consecutive words, compared exactly as written; its first
    occurrence (smallest doc_id, then place) stays and every other one is in a span.
    Spans are maximal unions of repeated passages, counted in words from 0, end
    excluded; first_doc_id holds the first occurrence of the span's first passage, which may
    be the document itself. A document without repeats has no row. Exact copies of a
    whole text are one row each, pointing to the smallest doc_id, and are not searched.
    Null, empty and short texts and rows with a null doc_id have no passages. Rows
    that repeat a doc_id with different texts are documents of their own, in the order
    of a hash of their texts (``spans_of_texts`` tells them apart); equal ones count as one.
    """
    return spans_of_texts(documents, least).select("doc_id", "start_word", "end_word", "first_doc_id")


def spans_of_texts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``repeated_spans`` with ``print1``, the xxhash64 of the text that a span lies in."""
    heads = _heads(documents, least)
    prints = ["print1", "print2"]
    firsts = heads.groupBy(*prints).agg(F.min("doc_id").alias("rep"))
    named = heads.join(firsts, prints)
    copies = named.where("doc_id != rep").select(
        "doc_id", "print1", F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("end_word"), F.col("rep").alias("first_doc_id")
    )
    suffixes = named.where("doc_id = rep").select(
        "doc_id", "print1", F.explode(F.arrays_zip("heads", "places")).alias("s")
    ).select(F.col("s.heads").alias("head"), "doc_id", "print1", F.col("s.places").alias("place"))
    passages = _passages(documents, _matched(suffixes), least)
    first = F.min(F.struct("doc_id", "print1", "start")).alias("first")
    origin = passages.groupBy("passage").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("passage", "first")
    again = passages.join(origin, "passage").where(F.struct("doc_id", "print1", "start") != F.col("first")).distinct()
    # a passage that overlaps its own first occurrence repeats only what lies behind that
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("print1") == F.col("first.print1"))
    lo = F.when(own, F.greatest("start", F.col("first.start") + least)).otherwise(F.col("start"))
    again = again.select(
        "doc_id", "print1", lo.alias("lo"), (F.col("start") + least).alias("hi"), F.col("first.doc_id").alias("first_doc_id")
    ).where("lo < hi")
    # a document's passages are as many as its words; spans are islands of overlapping ones
    order = Window.partitionBy("doc_id", "print1").orderBy("lo", "hi", "first_doc_id")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col("lo") > F.col("reach"), F.lit(True))).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    spans = (
        again.withColumn("reach", reach)
        .withColumn("island", island)
        .groupBy("doc_id", "print1", "island")
        .agg(
            F.min("lo").cast("int").alias("start_word"), F.max("hi").cast("int").alias("end_word"),
            F.min_by("first_doc_id", F.struct("lo", "hi", "first_doc_id")).alias("first_doc_id"),
        )
        .drop("island")
    )
    return spans.unionByName(copies)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """Leave out the words of spans (start, end), with the space behind them."""
    begins = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, at = [], 0
    for start, end in sorted(spans):
        kept.append(text[at : begins[start]])
        at = begins[min(end, len(begins) - 1)]
    return "".join(kept) + text[at:]


def remove_repeats(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``documents`` without the repeated spans; documents with no word left are dropped.

    Documents without spans pass unchanged, empty ones included. All columns stay,
    whatever their names. Rows that repeat a doc_id are cut each by its own text's spans.
    """
    spans = spans_of_texts(documents, least)
    lists = spans.groupBy(F.col("doc_id").alias("_id"), F.col("print1").alias("_print")).agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("spans")
    )
    # other columns travel in a struct, so that their names can't clash with inner ones
    packed = documents.select(F.struct(*[c for c in documents.columns if c != "text"]).alias("row"), "text")
    same = (F.col("row.doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_print"))
    rows = packed.join(lists, same, "left").select("text", "spans", "row")

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, own in enumerate(batch.column(1).to_pylist()):
                if own and texts[i]:
                    texts[i] = cut(texts[i], [(s["start_word"], s["end_word"]) for s in own])
            columns = [pa.array(texts, pa.string()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    cleaned = rows.mapInArrow(run, rows.schema)
    left = F.col("spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.where(left).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns])
