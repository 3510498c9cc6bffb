"""Token ids of whole texts by the tokenizers library, by way of a cache of text segments.

The library encodes about 1 MB a second and core. Its pre-tokenizers never join
characters across a word's gap, so a column of texts is cut there by its bytes,
equal segments of the column are numbered, every new segment is encoded once by
the library, and texts are put together from the ids by number.
"""

from __future__ import annotations

import codecs
import functools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space beyond ASCII, as UTF-8.
_WIDE_GAPS = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_WIDE_GAPS = [np.frombuffer(c.encode(), np.uint8) for c in _WIDE_GAPS]
# Letters of the first 256 code points and ASCII marks without the apostrophe; every pre-tokenizer cuts between the two.
_LETTERS, _MARKS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]", r"[!-&(-/:-@\[-`{-~]"
_PLAIN = f"^ ?(?:{_LETTERS}+|{_MARKS}+)$"
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([32 < b < 127 and b != 39 and not chr(b).isalnum() for b in range(256)])


def _byte_chars() -> str:
    """Byte-level text: the printable character that stands for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return "".join(shown[b] for b in range(256))


_BYTE_CHARS = _byte_chars()
# What the cached segments may take, and what one takes beside its text and ids.
_CACHE_BYTES, _ENTRY_BYTES = 32 << 20, 16


class _Cache:
    """Segments and their ids in two columns, in the order in which they came."""

    def __init__(self):
        self.segments, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.segments)

    def __contains__(self, segment: str) -> bool:
        return pc.index(self.segments, pa.scalar(segment, pa.large_string())).as_py() >= 0

    @property
    def size(self) -> int:
        """The bytes held."""
        return sum(_bytes_of(a) for a in (self.segments, self.ids)) + _ENTRY_BYTES * len(self)

    def add(self, segments: pa.Array, ids: pa.Array) -> None:
        """Keep new segments; above `_CACHE_BYTES` the later half is forgotten, as frequent segments come early."""
        short = pc.less(pc.binary_length(segments), 1024)  # a longer segment hardly comes twice
        self.segments = pa.concat_arrays([self.segments, segments.filter(short)])
        self.ids = pa.concat_arrays([self.ids, ids.filter(short)])
        while self.size > _CACHE_BYTES:
            half = pa.array(np.arange(len(self) // 2))
            self.segments, self.ids = self.segments.take(half), self.ids.take(half)


def _bytes_of(column: pa.Array) -> int:
    return pc.sum(pc.binary_length(column)).as_py() or 0


def _gaps(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space, as the library takes it."""
    gap = (data == 0x20) | (data - np.uint8(9) < 5)
    for lead in {int(c[0]) for c in _WIDE_GAPS}:
        at = np.flatnonzero(data == lead)
        for c in _WIDE_GAPS:
            if c[0] == lead and len(at):
                found = at[at <= len(data) - len(c)]
                for k in range(1, len(c)):
                    found = found[data[found + k] == c[k]]
                for k in range(len(c)):
                    gap[found + k] = True
    return gap


def _segments(data: np.ndarray, ends: np.ndarray, whole: np.ndarray, keep_gaps: bool) -> tuple[pa.Array, np.ndarray]:
    """The segments of texts that lie one after another in `data`, and how many there are up to each text's end.

    With `keep_gaps` a segment is a word with one blank before it, or white space, as
    byte level takes them: the last of several white space characters before a word
    stands alone or is the word's blank. Else it is a word. Words are cut between
    letters and marks. The texts numbered in `whole` are one segment each.
    """
    begins = np.concatenate([[0], ends[:-1]])
    filled = begins[ends > begins]
    gap = _gaps(data)
    word = ~gap
    start = np.zeros(len(data), bool)
    start[1:] = word[1:] & gap[:-1]
    start[filled] = word[filled]
    if keep_gaps:
        # A word's blank is part of it, unless it lies in the text before.
        start[1:] &= data[:-1] != 0x20
        start[1:] |= gap[1:] & word[:-1]
        last = gap[:-1] & word[1:]
        last[filled[1:] - 1] = False
        last = np.flatnonzero(last)
        # From a wide character's last byte to its first.
        while len(inner := np.flatnonzero(data[last] & 0xC0 == 0x80)):
            last[inner] -= 1
        start[last] = True
        start[filled] = True
        word[:] = True
    letter, mark = _LETTER[data], _MARK[data]
    # Two bytes of one letter.
    wide = np.flatnonzero(data[:-1] == 0xC3)
    wide = wide[data[wide + 1] & 0xDF != 0x97]
    letter[wide] = letter[wide + 1] = True
    start[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    for k in whole.tolist():
        start[begins[k] : ends[k]] = False
        start[begins[k] : ends[k]][:1] = True
        word[begins[k] : ends[k]] = True
    counts = np.searchsorted(np.flatnonzero(start), ends)
    if not keep_gaps:
        data, start = data[word], start[word]
    at = np.append(np.flatnonzero(start), len(data))
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), counts


class TextEncoder:
    """Ids of texts as little-endian bytes, those of the library's encode(text, add_special_tokens=False).

    A special token's string within a text gives that token, as the library has
    it, unless `special_as_text`, which takes such strings for ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Texts with one of these strings, in whatever case, are left to the library whole.
        self._special = [] if special_as_text else [t["content"].lower() for t in spec.get("added_tokens", [])]
        # What all of them begin with, up to the first letter: the same in every case, and rare in texts.
        self._mark = re.match(r"[!-@\[-`{-~]*", os.path.commonprefix(self._special)).group()
        kinds = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        # Byte level with its own pattern keeps white space; the other kind drops it and lowers letters.
        self._bytes = spec.get("normalizer") is None and '"use_regex": true' in kinds and spec["pre_tokenizer"]["type"] == "ByteLevel"
        self._lower = not self._bytes and '"\\\\s+"' in kinds and '"Removed"' in kinds
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._cache = _Cache()

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _segment_ids(self, segments: pa.Array, plain: np.ndarray) -> pa.Array:
        """Ids of segments. Where `plain` letters or marks alone go to the library's model, without its pre-tokenizer."""
        plain = plain & pc.match_substring_regex(segments, _PLAIN).to_numpy(zero_copy_only=False)
        parts = "\n".join(segments.filter(pa.array(plain)).to_pylist())
        # The normalizer lowers letters; all parts are made byte-level text at once.
        parts = codecs.charmap_decode((parts.lower() if self._lower else parts).encode(), "strict", _BYTE_CHARS)[0]
        tokenize, ids, counts = self._tokenizer.model.tokenize, array(self._code), []
        for part in parts.split(_BYTE_CHARS[10]) if parts else []:
            tokens = tokenize(part)
            counts.append(len(tokens))
            ids.extend([t.id for t in tokens])
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) * self.dtype.itemsize
        modelled = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        others = pa.array([self._ids([t])[0] for t in segments.filter(pa.array(~plain)).to_pylist()], pa.large_binary())
        places = np.empty(len(segments), np.int64)
        places[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(segments))
        return pa.concat_arrays([modelled, others]).take(pa.array(places))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in the bytes of `dtype`."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text of a string column, in the bytes of `dtype`, with `end` behind them; a null text is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not (self._bytes or self._lower):
            return pa.array([b + end for b in self._ids(texts.to_pylist())], pa.binary())
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        ends = at[1:] - at[0]
        whole = self._whole(texts, data, ends)
        segments, counts = _segments(data, ends, whole, self._bytes)
        numbered = segments.dictionary_encode()
        numbers, distinct = numbered.indices.to_numpy(), numbered.dictionary
        plain = np.ones(len(distinct), bool)
        plain[numbers[counts[whole] - 1]] = False
        # Places of the distinct segments among the cached ones, the new ones behind these, and the end.
        places = pc.index_in(distinct, value_set=self._cache.segments)
        missing = places.is_null().to_numpy(zero_copy_only=False)
        places = places.fill_null(0).to_numpy().astype(np.int64)
        places[missing] = len(self._cache) + np.arange(missing.sum())
        new = distinct.filter(pa.array(missing))
        new_ids = self._segment_ids(new, plain[missing])
        ids = pa.concat_arrays([self._cache.ids, new_ids, pa.array([end], pa.large_binary())])
        self._cache.add(new, new_ids)
        numbers = places[numbers]
        if end:
            numbers = np.insert(numbers, counts, len(ids) - 1)
            counts = counts + np.arange(1, len(counts) + 1)
        joined = ids.take(pa.array(numbers))
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        at = at[np.concatenate([[0], counts])]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), joined.buffers()[2]]).cast(pa.binary())

    def _whole(self, texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the texts that are left to the library whole: those with a special string or with
        one of the four characters that Python alone takes for white space."""
        odd = np.searchsorted(ends, np.flatnonzero(data - np.uint8(0x1C) < 4), "right")
        marked = np.flatnonzero(pc.match_substring(texts, self._mark).to_numpy(zero_copy_only=False)) if self._special else []
        return np.unique(np.append(odd, [k for k in marked if self._has_special(texts[k].as_py())]).astype(np.int64))

    def _has_special(self, text: str) -> bool:
        if not self._special or (self._mark and self._mark not in text):
            return False
        low = text.lower()
        return any(s in low for s in self._special)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, special_as_text: bool = False) -> TextEncoder:
    """The encoder of a worker process: its tasks share the loaded model and the cached segments."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextEncoder(path, special_as_text)
