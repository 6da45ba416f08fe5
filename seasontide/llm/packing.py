"""Packing of tokenised documents into sequences of bounded length, in order.

The ids of the documents of a partition form one stream. It is cut into windows of at
most ``length`` ids, each a sequence. Cuts at the end of a document are free, those at
the end of a sentence cost a little, those inside a sentence (possible every ``STRIDE``
ids) more. A window costs its padding, which is what it lacks to ``length``, or nothing
if it is a power of two long. Dynamic programming finds the cuts of least total cost:

    f(j) = penalty(j) + min(f(i) + length - (pos(j) - pos(i)),  pos(j) - pos(i) <= length)

As pos(j) is the same for all i, the minimum is that of f(i) + pos(i) over a sliding
range of i, which a monotone queue gives in constant time. Windows of a power of two
are further transitions. The plan is exact per block of about ``BLOCK`` ids; a block
ends at the cheapest cut of its last window, and the rest goes on with the next block.

Rows stay in their partitions: nothing is shuffled, and a partition ends its last
sequence by itself, cut into powers of two where that costs less than padding.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seasontide.llm.chunk_ids import encoder, runs

#: Costs of a cut at a sentence's end and inside a sentence, in ids of padding.
SENTENCE, INSIDE = 8, 64
#: Ids between possible cuts inside a sentence.
STRIDE = 64
#: Ids that are planned together.
BLOCK = 1 << 19
#: Shortest window of a power of two inside a block.
LEAST_POWER = 64
#: A sentence ends with a chunk that ends so.
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


def boundaries(documents: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of all possible cuts, from the ends of documents and of sentences; the first is 0."""
    known = np.unique(np.concatenate(([0], documents, sentences)))
    more = np.maximum(np.diff(known) - 1, 0) // STRIDE
    within = np.repeat(known[:-1], more) + STRIDE * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    places = np.union1d(known, within)
    penalties = np.full(len(places), INSIDE)
    penalties[np.searchsorted(places, sentences)] = SENTENCE
    penalties[np.searchsorted(places, documents)] = 0
    penalties[0] = 0
    return places, penalties


def plan(places: np.ndarray, penalties: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """(cost, previous): of the cheapest cuts up to each place, and the place of the cut before it."""
    power = LEAST_POWER
    exact: dict[int, list[int]] = {}
    while power <= length:
        at = np.searchsorted(places, places - power)
        for j in np.flatnonzero(places[at] == places - power).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power *= 2
    spots, extra = places.tolist(), penalties.tolist()
    cost, previous = [0] * len(spots), [0] * len(spots)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (f(i) + pos(i), pos(i), i), ascending
    nothing: list[int] = []
    for j in range(1, len(spots)):
        here = spots[j]
        while queue[0][1] < here - length:
            queue.popleft()
        least, _, before = queue[0]
        least += length - here
        for i in exact.get(j, nothing):
            if cost[i] < least:
                least, before = cost[i], i
        least += extra[j]
        cost[j], previous[j] = least, before
        key = least + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    return cost, previous


def _tail(size: int, length: int) -> tuple[int, list[int]]:
    """Cost of a last window, and its parts: padded, or cut into powers of two."""
    parts = [1 << b for b in reversed(range(size.bit_length())) if size >> b & 1]
    split = (len(parts) - 1) * INSIDE
    return (split, parts) if split < length - size or len(parts) == 1 else (length - size, [size])


def cuts(places: np.ndarray, penalties: np.ndarray, length: int, last: bool) -> list[int]:
    """Ascending cuts, the first 0. The last one ends the stream if ``last``, else the cheapest of the last window."""
    cost, previous = plan(places, penalties, length)
    end = int(places[-1])
    reach = range(int(np.searchsorted(places, end - length)), len(places) - 1 if last else len(places))
    if last:
        total, at = min((cost[i] + _tail(end - int(places[i]), length)[0], -i) for i in reach)
        found = np.cumsum(_tail(end - int(places[-at]), length)[1])[::-1] + int(places[-at])
    else:
        total, at = min((cost[i], -i) for i in reach if i)
        found = []
    out, at = [int(x) for x in found], -at
    while at:
        out.append(int(places[at]))
        at = previous[at]
    return [0, *reversed(out)]


class _Stream:
    """Documents of a partition that wait for their sequences."""

    def __init__(self, length: int, part: int, kind: pa.DataType):
        self.length, self.kind, self.next = length, kind, part << 33
        self.names: list = []
        self.sizes = self.begun = np.zeros(0, np.int64)  # whole size, and ids already in sequences
        self.ids, self.sentences = np.zeros(0, "<i4"), np.zeros(0, np.int64)

    def add(self, names: list, ids: np.ndarray, bounds: np.ndarray, sentences: np.ndarray) -> None:
        self.sentences = np.concatenate((self.sentences, sentences + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))
        self.names += names
        self.sizes = np.concatenate((self.sizes, np.diff(bounds)))
        self.begun = np.concatenate((self.begun, np.zeros(len(names), np.int64)))

    def take(self, last: bool) -> pa.RecordBatch:
        """Pieces of the sequences that are settled."""
        ends = np.cumsum(self.sizes - self.begun)
        found = np.array(cuts(*boundaries(ends, self.sentences), self.length, last))
        end = found[-1]
        edges = np.union1d(found, ends[ends < end])
        lengths, first = np.diff(edges), edges[:-1]
        doc = np.searchsorted(ends, first, side="right")
        sequence = np.searchsorted(found, first, side="right") - 1
        starts = first - (ends - self.sizes)[doc]
        ids = self.ids[:end]
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.names[i] for i in doc.tolist()], self.kind),
                pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(self.sizes[doc]),
                pa.array(sequence + self.next), pa.array(first - found[sequence]),
                pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )
        self.next += len(found) - 1
        done = int(np.searchsorted(ends, end, side="right"))
        begun = self.begun[done:].copy()
        if len(begun):
            begun[0] += end - (ends[done - 1] if done else 0)
        self.names, self.sizes, self.begun = self.names[done:], self.sizes[done:], begun
        self.ids, self.sentences = self.ids[end:], self.sentences[self.sentences > end] - end
        return out


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of each piece of ``documents`` (doc_id, text).

    A document is its ids and ``end_id``; a null text is empty and has that alone.
    Every row is a document of its own, also if it repeats an id or has none. Rows are
    packed in the order in which they lie in their partitions: a stored table gives the
    same sequences again. Other columns are left out; an empty table gives no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, stream = encoder(tokenizer, spaced=False).encode, None
        for batch in batches:
            for at, texts in runs(batch.column(1)):
                ids, bounds, sentences = encode(texts, end_id, SENTENCE_END)
                # the end of a document's text is no cut: its end id follows
                inner = sentences + 1 < bounds[np.searchsorted(bounds, sentences)]
                names = batch.column(0).slice(at, len(texts))
                stream = stream or _Stream(length, TaskContext.get().partitionId(), names.type)
                stream.add(names.to_pylist(), ids, bounds, sentences[inner])
                if len(stream.ids) >= BLOCK:
                    yield stream.take(last=False)
        if stream and len(stream.ids):
            yield stream.take(last=True)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)
