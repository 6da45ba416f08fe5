"""Token ids of whole texts by the tokenizers library, asked once per distinct chunk in a while.

A text is cut where the tokenizer never looks across, so that a text's ids are those of
its chunks in a row. Chunks are told apart by Arrow for many texts at a time; each
distinct one is looked up once per batch, and ids are gathered by whole columns.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Encoded chunks that a Python worker keeps in each of two generations; only speed depends on it.
KEPT, KEPT_LENGTH = 400_000, 64
#: Bytes of texts that are cut together, and chunks that the library gets in a row.
TEXT_BYTES, ROW = 16 << 20, 256
#: A token of its own.
MARK = "|"
#: How byte-level vocabularies write the space.
SPACE = "Ġ"


class ChunkEncoder:
    """Ids of texts; ``spaced`` says whether spaces count.

    If they do (byte-level vocabularies whose splits let one space go with the word
    after it), chunks begin with their space: no token and no look-ahead crosses a place
    with a non-space before and a space after it. If they don't (white space only
    parts words), chunks are runs without ASCII white space. Strings of special tokens
    hold no space, so they lie inside a chunk and get what the library gives them.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.spaced = spaced
        size = self.library.get_vocab_size()
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        # the tokens that part the chunks of a row
        parts = [(self.library.id_to_token(i) or "").startswith(SPACE) if spaced else [i] == mark for i in range(size)]
        self.parts = np.array(parts)
        self.plain = re.compile(r" [^ <]*[^\s<]" if spaced else rf"[^\s<{re.escape(MARK)}]+").fullmatch
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, asked one by one."""
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        data = np.fromiter(itertools.chain.from_iterable(found), "<u4").tobytes()
        ends = np.cumsum([4 * len(x) for x in found]).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _ask(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks. Those of plain words go to the library in rows.

        If spaces count, a row's chunks each begin with their space; it begins a token,
        and no other token of them holds one. If not, a mark that no chunk of the row
        holds, and which is a token of its own, stands between them.
        """
        plain = list(filter(self.plain, chunks))
        found = {}
        rows = [plain[i : i + ROW] for i in range(0, len(plain), ROW)]
        joined = ["".join(r) if self.spaced else f" {MARK} ".join(r) for r in rows]
        for row, got in zip(rows, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            begins = np.flatnonzero(self.parts[ids])
            if self.spaced:
                ends = np.append(begins[1:], len(ids))
            else:
                begins, ends = np.append(0, begins + 1), np.append(begins, len(ids))
            if len(begins) == len(row):
                data = ids.tobytes()
                found.update((c, data[a:b]) for c, a, b in zip(row, (begins * 4).tolist(), (ends * 4).tolist()))
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._library(rest)))
        return found

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each of some distinct chunks."""
        found = list(map(self.kept.get, chunks))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            names = [chunks[i] for i in missing]
            got = list(map(self.older.get, names))
            new = self._ask([c for c, f in zip(names, got) if f is None])
            got = [new[c] if f is None else f for c, f in zip(names, got)]
            for i, f in zip(missing, got):
                found[i] = f
            if len(self.kept) >= KEPT:
                self.kept, self.older = {}, self.kept
            if max(map(len, names)) <= KEPT_LENGTH:
                self.kept.update(zip(names, got))
            else:
                self.kept.update((c, x) for c, x in zip(names, got) if len(c) <= KEPT_LENGTH)
        return found

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of all texts, and each text's first one."""
        parts = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        return parts.flatten(), np.asarray(parts.offsets, np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = None, ends_sentence: re.Pattern | None = None):
        """(ids, bounds) of some texts, null as empty: text i has ids[bounds[i]:bounds[i + 1]].

        ``end_id`` is appended to each text's ids. With ``ends_sentence`` also the places
        in ids after which a chunk ends that the pattern is found in.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        chunks, first = self._cut(texts)
        coded = chunks.dictionary_encode()
        names, index = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        if self.spaced:
            names, index, first = self._with_spaces(texts, names, index, first)
        found = self.of_chunks(names)
        if end_id is not None:
            index, first = np.insert(index, first[1:], len(names)), first + np.arange(len(first))
            found.append(np.array([end_id], "<u4").tobytes())
        begins = np.cumsum([0, *[len(x) // 4 for x in found]])
        data = np.frombuffer(b"".join(found), "<i4")
        lists = pa.LargeListArray.from_arrays(pa.array(begins), pa.array(data)).take(pa.array(index))
        bounds = np.asarray(lists.offsets, np.int64)
        ids = np.asarray(lists.values)
        if ends_sentence is None:
            return ids, bounds[first]
        last = np.array([bool(ends_sentence.search(c)) for c in names] + [False], bool)
        return ids, bounds[first], bounds[1:][last[index]]

    def _with_spaces(self, texts: pa.Array, names: list[str], index: np.ndarray, first: np.ndarray):
        """Put the spaces back: chunks that follow another begin with one.

        A text in which white space comes before a space is cut again, there only
        where a space follows something else.
        """
        open_end = np.array([not c or c[-1].isspace() for c in names], bool)
        loose = open_end[index] if len(index) else np.zeros(0, bool)
        last = first[1:] - 1
        loose[last[last >= first[:-1]]] = False
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        again = np.unique(text_of[loose])
        # names: as they are for first chunks, then with a space
        index = index + len(names)
        heads = first[:-1][first[:-1] < first[1:]]
        index[heads] -= len(names)
        names = names + [" " + c for c in names]
        if len(again):
            recut = {i: re.split(r"(?<=\S)(?= )", texts[i].as_py()) for i in again.tolist()}
            places = {c: n for n, c in enumerate(names)}
            for chunks in recut.values():
                for c in chunks:
                    places.setdefault(c, len(places))
            lists, at = [], 0
            for i, chunks in recut.items():
                lists += [index[at : first[i]], np.array([places[c] for c in chunks], np.int64)]
                at = first[i + 1]
            lists.append(index[at:])
            counts = np.diff(first)
            counts[list(recut)] = [len(c) for c in recut.values()]
            index, first, names = np.concatenate(lists), np.concatenate(([0], np.cumsum(counts))), list(places)
        used = np.zeros(len(names), bool)
        used[index] = True
        place = np.cumsum(used) - 1
        return [names[i] for i in np.flatnonzero(used).tolist()], place[index], first


def runs(texts: pa.Array, size: int = TEXT_BYTES):
    """(first row, rows) of runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + size, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """The worker's encoder of a vocabulary."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = ChunkEncoder(path, spaced)
    return _encoders[path, spaced]
