"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

A model file is compiled into three transducers: the normaliser (identity, blank
to the space mark, a space mark in front), the pieces (a path of characters in,
a piece out) and the byte fallback (a character in, its bytes' pieces out).
Composed with a text they give a graph whose nodes are places in the text and
whose arcs are pieces; the encoding is its shortest path in the tropical
semiring. In a unigram model an arc weighs minus the piece's score. In a BPE
model it weighs 0 if it may follow the piece before, else infinity: two pieces
may stand side by side if merging their joined text gives just these two, and
a sequence in which all neighbours may is the result of merging. Exactly one path
to each place has weight 0 then, so a place is a whole state.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import text_slices

# Fixed values of the model format: the space mark, kinds of models and of pieces.
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
_UNKNOWN_SHOWN = " ⁇ "
# What the cached segments may take, and about what one takes beside its text and ids.
_CACHE_BYTES, _ENTRY_BYTES = 96 << 20, 240
# Pairs of pieces that are kept with whether they may stand side by side.
_CACHE_PAIRS = 1 << 18
# Letters of the first 256 code points, which a piece seldom joins with marks.
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
_MARKS = "!-@\\[-`{-~\n"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message; fixed-size values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, data[at : at + n]
        at += n


class PieceTransducer:
    """A compiled model; encode() and decode() of texts."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for _, value in (x for x in model if x[0] == 1):
            piece = dict(_fields(value))
            self.pieces.append(piece.get(1, b"").decode())
            scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            self.kinds.append(piece.get(3, NORMAL))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        rules = dict(_fields(next((v for k, v in model if k == 3), b"")))
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24):
            raise ValueError("only models with the identity normaliser, white space kept and marks in front are compiled")
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        self._prefix = SPACE if rules.get(3, 1) else ""
        self.unknown = self.kinds.index(UNKNOWN)
        self._ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self._bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self._shown = [self._decoded(p, k) for p, k in zip(self.pieces, self.kinds)]
        self._last: tuple[str, list[str]] = ("", [""])
        self._longest = max(map(len, self._ids), default=1)
        self._weight = {i: -scores[i] for i in self._ids.values()}
        self._unknown_weight = 10 - min((scores[i] for i in self._ids.values()), default=0.0)
        # Where no piece has the space mark behind another character, no arc passes from one word to the next.
        inner = any(SPACE in p.lstrip(SPACE) for p in self._ids)
        self._cut = (lambda t: [t]) if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        # Nor from letters to marks and back, where no piece has one beside the other.
        beside = re.compile(f"[{_LETTERS}][{_MARKS}]|[{_MARKS}][{_LETTERS}]")
        if self.kind == BPE and not inner and not any(map(beside.search, self._ids)):
            self._cut = re.compile(
                f"{SPACE}*[{_LETTERS}]+(?=[{_MARKS}{SPACE}]|\\Z)|{SPACE}*[{_MARKS}]+(?=[{_LETTERS}{SPACE}]|\\Z)"
                f"|{SPACE}*[^{SPACE}]+|{SPACE}+"
            ).findall
        self._cache: dict[str, bytes] = {}
        self._cached = 0
        self._score = scores
        self._compiled = self.kind != BPE  # merges are compiled when a text is encoded first

    @staticmethod
    def _decoded(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else (_UNKNOWN_SHOWN if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    # --- Which pieces of a BPE model may stand side by side ---

    def _compile_merges(self) -> None:
        order = sorted(self._ids.values(), key=lambda i: (-self._score[i], i))
        self._rank = {i: r for r, i in enumerate(order)}
        self._allowed: dict[tuple[str, str], bool] = {}
        # The two parts that a piece is last merged from; none for single characters and pieces that merging never makes.
        self._parts: dict[str, tuple[str, str] | None] = {p: self._last_merge(p) for p in self._ids}
        self._stands = {p for p in self._ids if len(p) == 1 or self._parts[p] is not None}
        self._compiled = True

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The result of merging and the last merge: best score first, then leftmost."""
        symbols, last = list(text), None
        while True:
            best = None
            for k in range(len(symbols) - 1):
                i = self._ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self._score[i] > best[0]):
                    best = (self._score[i], k)
            if best is None:
                return symbols, last
            k = best[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [last[0] + last[1]]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        symbols, last = self._merged(piece)
        return last if len(symbols) == 1 else None

    def allowed(self, a: str, b: str) -> bool:
        """Whether piece (or unknown character) b may follow a.

        Merging the joined text makes another piece across the border only if two
        parts that meet there make one before the merge that uses either up; the
        merges are undone from the last one, those of the worse rank first.
        """
        found = self._allowed.get((a, b))
        if found is None:
            # Space marks alone merge with equal scores, by place; there the merges are run.
            run = not (a.strip(SPACE) and b.strip(SPACE))
            found = self._allowed[a, b] = self._merged(a + b)[0] == [a, b] if run else self._border_holds(a, b)
        return found

    def _border_holds(self, a: str, b: str) -> bool:
        rank, ids, parts = self._rank, self._ids, self._parts
        never = len(rank)
        limit = (never, 0)  # a merge across the border counts if it comes before this one
        while True:
            across = ids.get(a + b)
            # The border's merge lies left of those inside b and right of those inside a; of equal rank the left one is first.
            if across is not None and (rank[across], 1) < limit:
                return False
            ra = rank[ids[a]] if parts.get(a) else -1
            rb = rank[ids[b]] if parts.get(b) else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit = (ra, 0)
                a = parts[a][1]
            else:  # of the same piece on both sides the right one is merged last
                limit = (rb, 2)
                b = parts[b][0]

    # --- Encoding ---

    def _path(self, text: str) -> list[str]:
        """The shortest path over a segment, as the texts of its arcs."""
        if self.kind == BPE:
            return self._allowed_path(text)
        n, ids = len(text), self._ids
        before: list[str | None] = [None] * (n + 1)  # the last arc of the shortest path to each place
        weight = [0.0] + [float("inf")] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - self._longest), end):
                if weight[start] == float("inf"):
                    continue
                arc = text[start:end]
                i = ids.get(arc)
                if i is None and start < end - 1:
                    continue
                far = weight[start] + (self._unknown_weight if i is None else self._weight[i])
                if far < weight[end]:
                    weight[end], before[end] = far, arc
        arcs, at = [], n
        while at:
            arcs.append(before[at])
            at -= len(before[at])
        return arcs[::-1]

    def _allowed_path(self, text: str) -> list[str]:
        """The path of weight 0 of a BPE model: the first arc to a place that has weight 0 is the only one.

        What leads to a place depends on the text before it alone, so the arcs of
        the last text are kept as far as this one begins like it.
        """
        n, longest, stands, allowed = len(text), self._longest, self._stands, self._allowed
        last, before = self._last
        same = len(os.path.commonprefix((last, text)))
        before = before[: same + 1] + [""] * (n - same)
        for end in range(same + 1, n + 1):
            for start in range(max(0, end - longest), end):
                arc = text[start:end]
                if arc not in stands and start < end - 1:
                    continue
                if start:
                    pair = (before[start], arc)
                    may = allowed.get(pair)
                    if not (self.allowed(*pair) if may is None else may):
                        continue
                before[end] = arc
                break
        self._last = (text, before)
        arcs, at = [], n
        while at:
            arcs.append(before[at])
            at -= len(before[at])
        return arcs[::-1]

    def _segment(self, text: str) -> bytes:
        out = array("I")
        for arc in self._path(text):
            i = self._ids.get(arc)
            if i is not None:
                out.append(i)
            elif self._bytes:
                out.extend(self._bytes[b] for b in arc.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit; an empty text has none."""
        if not self._compiled:
            self._compile_merges()
        if self._cached > _CACHE_BYTES:
            # Frequent segments come early, so the first half stays.
            self._cache = dict(islice(self._cache.items(), len(self._cache) // 2))
            self._cached = sum(map(self._held, self._cache, self._cache.values()))
        if self.kind == BPE and len(self._allowed) > _CACHE_PAIRS:
            self._allowed.clear()
        cache = self._cache
        missed: set[str] = set()
        for t in texts:
            missed.update(set(self._segments(t)).difference(cache))
        # In order, so that segments that begin alike follow each other.
        for segment in sorted(missed):
            cache[segment] = ids = self._segment(segment)
            self._cached += self._held(segment, ids)
        # Cut again, since the segments of all texts take some ten times their bytes.
        return [b"".join(map(cache.__getitem__, self._segments(t))) for t in texts]

    def _segments(self, text: str) -> list[str]:
        return self._cut(self._prefix + text.replace(" ", SPACE)) if text else []

    @staticmethod
    def _held(segment: str, ids: bytes) -> int:
        return _ENTRY_BYTES + 2 * len(segment) + len(ids)

    # --- Decoding ---

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, control pieces nothing."""
        out = map(self._shown.__getitem__, ids.tolist())
        text = b"".join(out).decode("utf-8", "replace")
        return text[1:] if self._prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def coder_of(model: str) -> PieceTransducer:
    """The compiled model of a worker process: its tasks share it and the cached segments."""
    return PieceTransducer(model)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_bytes (pieces of the byte fallback) and ids (little-endian unsigned 32-bit) of each document.

    Null and empty texts have no ids; null and repeated ids are rows like any
    other; no documents give no rows. The texts of control pieces are ordinary
    characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model)
        is_byte = np.array([k == BYTE for k in coder.kinds])
        for batch in text_slices(batches, 1):
            ids = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            arrays = [np.frombuffer(b, "<u4") for b in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array([int(is_byte[a].sum()) for a in arrays], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_pieces", "n_bytes", "ids"],
            )

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_pieces bigint, n_bytes bigint, ids binary")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model)
        for batch in text_slices(batches, 1):
            texts = [coder.decode(np.frombuffer(b or b"", "<u4")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_crc32 and decoded_md5 of each document, encoded and decoded again."""
    encoded = encode_documents(docs, model, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model)
        for batch in text_slices(batches, 3, 2 << 20):
            ids = batch.column(3).to_pylist()
            texts = [coder.decode(np.frombuffer(b, "<u4")) for b in ids]
            columns = [*batch.columns[:3], pa.array([zlib.crc32(b) for b in ids], pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "text"])

    decoded = encoded.mapInArrow(run, "doc_id bigint, n_pieces bigint, n_bytes bigint, ids_crc32 bigint, text string")
    return decoded.select("doc_id", "n_pieces", "n_bytes", "ids_crc32", F.md5(F.encode("text", "UTF-8")).alias("decoded_md5"))
