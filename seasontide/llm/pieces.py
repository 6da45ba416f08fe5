"""SentencePiece encoding and decoding by a merge-type prefix table.

The vocabulary merges neighbouring symbols, best piece first. Such an encoding is
unique and local: a row of pieces is the encoding of its text exactly when each
neighbouring pair is, so every prefix of a text has one last piece. An automaton
over the vocabulary reports the pieces that end at each character; the one whose
pair with the last piece of the remaining prefix is compatible goes to the table.
The ids are then read backwards from the end. Time is linear in the text.

Only the vocabulary and its order come from the model file; the library's encoder
is used by the tests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Encoded stretches that a Python worker keeps, and the longest one kept; only speed depends on them.
KEPT, KEPT_LENGTH, KEPT_PAIRS = 300_000, 48, 2_000_000


class PieceTable:
    """Vocabulary of a merging piece model: encodes and decodes text."""

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.vocab_size()
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        rank: dict[str, float] = {}
        ids: dict[str, int] = {}
        self.bytes_of: dict[int, int] = {}
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, value
                self.surface.append(bytes([value]))
            elif m.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            elif m.is_control(i) or m.is_unused(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                ids[piece], rank[piece] = i, -m.get_score(i)
        self.rank, self.ids = rank, ids
        self.lengths = {i: len(p) for p, i in ids.items()}
        self.width = n
        # edges[i]: the pieces that stand at the right (left) end of piece i while it grows, with their times
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.finder = ahocorasick.Automaton()
        for piece in sorted(ids, key=len):
            if self._grow(piece):
                self.finder.add_word(piece, ids[piece] << 8 | len(piece))
        self.finder.make_automaton()
        self.fits: dict[int, bool] = {}
        # no piece holds a mark behind another character: stretches between such places are independent
        apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in ids)
        lines = not any("\n" in p for p in ids)
        stretch = f"{MARK}*[^{MARK}\n]+|{MARK}+" if apart else "[^\n]+"
        self.stretches = re.compile(f"\n|{stretch}" if lines else "(?s:.+)").findall
        # neither does one hold a comma or stop behind a lower-case letter, which shortens most stretches
        self.plain = apart and lines and not any(re.search(r"[a-z][.,]", p) for p in ids)
        self.before_stop = re.compile(r"(?<=[a-z])(?=[.,])").sub
        self.decimals = [str(i) for i in range(n)]
        # two generations: stretches that come again move from the older to the newer one
        self.kept: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def _grow(self, piece: str) -> bool:
        """Merge the characters of a piece as the encoder would; False if it isn't reached."""
        parts = [(c, 0.0, [(c, 0.0)], [(c, 0.0)]) for c in piece]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i][0] + parts[i + 1][0])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return False
            a, b = parts[at], parts[at + 1]
            # a merge takes place when its parts are there and nothing better is left
            when = max(best, a[1], b[1])
            whole = a[0] + b[0]
            parts[at : at + 2] = [(whole, when, b[2] + [(whole, when)], a[3] + [(whole, when)])]
        i = self.ids[piece]
        self.right[i], self.left[i] = parts[0][2], parts[0][3]
        return True

    def _compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when their characters are merged side by side."""
        right, left = self.right[a], self.left[b]
        i = j = 0
        far = float("inf")
        while True:
            next_a = right[i + 1][1] if i + 1 < len(right) else far
            next_b = left[j + 1][1] if j + 1 < len(left) else far
            across = self.rank.get(right[i][0] + left[j][0], far)
            # equal pieces merge from the left
            if across < next_a and across <= next_b and across < far:
                return False
            if next_a == far and next_b == far:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _encode_stretch(self, text: str) -> tuple[int, ...]:
        n = len(text)
        last = [-1] * (n + 1)
        fits, known, width = self.fits.get, self.ids, self.width
        for end, found in self.finder.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            token, start = found >> 8, end - (found & 255)
            if not start:
                last[end] = token
                continue
            before = last[start]
            if before < 0:
                # behind a character outside the vocabulary nothing merges across
                if text[start - 1] not in known:
                    last[end] = token
                continue
            pair = before * width + token
            ok = fits(pair)
            if ok is None:
                ok = self.fits[pair] = self._compatible(before, token)
            if ok:
                last[end] = token
        out: list[int] = []
        lengths = self.lengths
        while n:
            token = last[n]
            if token < 0:
                out.extend([self.byte_ids[b] for b in reversed(text[n - 1].encode())])
                n -= 1
            else:
                out.append(token)
                n -= lengths[token]
        out.reverse()
        return tuple(out)

    def decode_bytes(self, ids) -> bytes:
        """UTF-8 of the pieces; the mark put before a text is still there."""
        if self.bytes_of.keys().isdisjoint(ids):
            return b"".join([self.surface[i] for i in ids])
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            while run:
                # one wrong byte gives one replacement character
                try:
                    run.decode()
                    out.append(bytes(run))
                    run.clear()
                except UnicodeDecodeError as wrong:
                    out += [bytes(run[: wrong.start]), "�".encode()]
                    del run[: wrong.start + 1]
            if i >= 0:
                out.append(self.surface[i])
        return b"".join(out)

    def _stretch(self, text: str) -> tuple[str, str]:
        found = self.kept.get(text) or self.older.get(text)
        if found is None:
            ids = self._encode_stretch(text)
            decoded = self.decode_bytes(ids).decode()
            found = ",".join([self.decimals[i] for i in ids]), decoded
        if len(text) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept, self.older = {}, self.kept
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            self.kept[text] = found
        return found

    def parts(self, text: str) -> list[tuple[str, str]]:
        """The encoding in independent stretches: (ids as decimals, decoded text)."""
        if not text:
            return []
        if self.plain and "  " not in text and MARK not in text and text[0] != " ":
            # single spaces: each begins a stretch, and so do line ends and stops
            cut = self.before_stop(" ", text.replace(" ", f" {MARK}").replace("\n", " \n "))
            stretches = (MARK + cut).split(" ")
        else:
            stretches = self.stretches(MARK + text.replace(" ", MARK))
        found = list(map(self.kept.get, stretches))
        if None in found:
            own = self._stretch
            found = [f or own(s) for f, s in zip(found, stretches)]
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) if ids for i in ids.split(",")]

    def decode(self, ids) -> str:
        found = self.decode_bytes(ids).decode()
        return found[1:] if found[:1] == " " else found


_tables: dict[str, PieceTable] = {}


def load(model: str) -> PieceTable:
    """The table of a model, built once per Python worker."""
    if model not in _tables:
        _tables[model] = PieceTable(model)
    return _tables[model]


def _texts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple[pa.Array, list[str]]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encode(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) for every row; a null text is empty and has no ids."""

    def run(batches):
        table = load(model)
        for batch in batches:
            for ids, texts in _texts(batch):
                tokens = pa.array([table.encode(t) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, tokens], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""

    def run(batches):
        table = load(model)
        for batch in batches:
            texts = pa.array([table.decode(i or ()) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(documents: DataFrame, model: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both; one row per row.

    A null or empty text has no ids and decodes to an empty text. Rows that repeat
    give repeated rows; other columns are left out. Texts stream in small runs, and
    only the stretches of one text are held.
    """

    def run(batches):
        table = load(model)
        for batch in batches:
            for ids, texts in _texts(batch):
                n_tokens, id_digests, text_digests = [], [], []
                for text in texts:
                    parts = table.parts(text)
                    listed = ",".join([p[0] for p in parts if p[0]])
                    decoded = "".join([p[1] for p in parts])
                    n_tokens.append(listed.count(",") + 1 if listed else 0)
                    id_digests.append(hashlib.sha256(listed.encode()).hexdigest())
                    text_digests.append(hashlib.sha256(decoded[decoded[:1] == " " :].encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_tokens, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
