"""Chat formatting: turns joined by a template into one byte buffer, with a mask of what is learnt."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template: what stands before and after a turn's text. Each mark is parted
# from the text by a blank, so a text can never complete or escape a mark.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
# Any other role, named between two marks.
OTHER = ("[ROLE] ", " [/ROLE] ", " [/END]")
_MARK = r"(?:</?s>|<</?SYS>>|\[/?(?:INST|ROLE)\]|\[/END\])"
_ESCAPE = re.compile(rf"(\\*{_MARK})")
_ESCAPED = re.compile(rf"\\(\\*{_MARK})")
_TURN = re.compile(
    r"(?<!\\)(?:<<SYS>> (?P<system>.*?) (?<!\\)<</SYS>>|\[INST\] (?P<user>.*?) (?<!\\)\[/INST\]"
    r"|<s> (?P<assistant>.*?) (?<!\\)</s>|\[ROLE\] (?P<role>.*?) (?<!\\)\[/ROLE\] (?P<other>.*?) (?<!\\)\[/END\])",
    re.S,
)


def escape(text: str) -> str:
    """A backslash more before every mark in a text, with or without backslashes."""
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    for m in _TURN.finditer(text):
        kind = m.lastgroup
        yield (unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind]))


def _escaped(texts: pa.Array) -> pa.Array:
    """Escapes the few texts that hold a mark; the others are not touched."""
    texts = pc.fill_null(texts, "")
    marked = pc.match_substring_regex(texts, _MARK)
    if not pc.any(marked).as_py():
        return texts
    return pc.replace_with_mask(texts, marked, pa.array([escape(t) for t in texts.filter(marked).to_pylist()], pa.string()))


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string array's bytes, and the start and length of each string in them."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy string i of data to out[to[i]:]."""
    before = np.cumsum(length) - length
    at = np.arange(int(length.sum()))
    out[at + np.repeat(to - before, length)] = data[at + np.repeat(start - before, length)]


def assemble(roles: pa.Array, texts: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, joined from bounds[k] to bounds[k + 1] into string k.

    Returns the strings, and for each turn where its text starts in its string
    and how long it is, in characters.
    """
    roles, texts = pc.fill_null(roles, ""), _escaped(texts)
    kinds = list(MARKS)
    kind = pc.fill_null(pc.index_in(roles, pa.array(kinds)), len(kinds)).to_numpy(zero_copy_only=False)
    named = [OTHER[0] + escape(r) + OTHER[1] for r in roles.filter(pa.array(kind == len(kinds))).to_pylist()]
    table = pa.array([MARKS[k][0] for k in kinds] + named + [MARKS[k][1] for k in kinds] + [OTHER[2]], pa.string())
    which = kind.copy()
    which[kind == len(kinds)] += np.arange(len(named))
    head = table.take(pa.array(which))
    tail = table.take(pa.array(len(kinds) + len(named) + kind))

    parts = [_bytes_of(a) for a in (head, texts, tail)]
    lengths = np.stack([p[2] for p in parts])
    turn = lengths.sum(0)
    first = np.cumsum(turn) - turn
    out = np.empty(int(turn.sum()), np.uint8)
    to = first
    for data, start, length in parts:
        _scatter(out, to, data, start, length)
        to = to + length
    ends = np.concatenate([first, [out.size]])[bounds]
    strings = pa.Array.from_buffers(
        pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]
    )
    n_chars = np.stack([pc.utf8_length(a).to_numpy() for a in (head, texts, tail)]).astype(np.int64)
    whole = n_chars.sum(0)
    before = np.cumsum(whole) - whole
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return strings, before - before[bounds[:-1]][owner] + n_chars[0], n_chars[1]


_FORMATTED = "conv_id bigint, part bigint, n_turns bigint, text string, loss_start array<bigint>, loss_length array<bigint>"


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learn: tuple[str, ...] = ("assistant",), max_rows: int = 2000,
) -> DataFrame:
    """Rows of turns to formatted conversations: conv_id, part, n_turns, text, loss_start, loss_length.

    A conversation is its turns in the order of `turn`, then role and text for
    ties; null turns come first, a null role or text is empty, the rows with a
    null conversation are one conversation. loss_start and loss_length, in
    characters, are the texts of the roles in `learn`. A conversation of more
    turns than fit into a batch of at most max_rows rows is given in several
    parts, numbered in order, whose texts are to be joined; so no row and no
    task holds an unbounded conversation. Parts of a conversation come one
    after another in one partition. No turns give no rows.
    """
    chosen = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    learnt = pa.array(learn, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, begun = None, 0, False
        for whole in batches:
            for k in range(0, whole.num_rows, max_rows):
                batch = whole.slice(k, max_rows)
                ids = batch.column(0).to_pylist()
                bounds = np.array([0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] + [len(ids)])
                strings, starts, lengths = assemble(batch.column(2), batch.column(3), bounds)
                mask = pc.is_in(batch.column(2), learnt).to_numpy(zero_copy_only=False)
                counts = np.add.reduceat(mask.astype(np.int64), bounds[:-1])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                parts = [part + 1 if begun and ids[0] == last else 0] + [0] * (len(bounds) - 2)
                last, part, begun = ids[-1], parts[-1], True
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(bounds[:-1])), pa.array(parts, pa.int64()), pa.array(np.diff(bounds)), strings.cast(pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(starts[mask])), pa.ListArray.from_arrays(offsets, pa.array(lengths[mask])),
                    ],
                    names=["conv_id", "part", "n_turns", "text", "loss_start", "loss_length"],
                )

    dealt = chosen.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _FORMATTED)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back, part after part: one row of counts and hashes each.

    Expects the partitions of format_conversations; only running hashes are held.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def rows(done):
            columns = [[d[0] for d in done], [d[1] for d in done], [d[2].hexdigest() for d in done], [d[3] for d in done], [d[4].hexdigest() for d in done], [d[5] for d in done]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if state:
                        done.append(state)
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["text"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for start, length in zip(r["loss_start"], r["loss_length"]):
                    learnt = unescape(r["text"][start : start + length])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(r["text"])
            if done:
                yield rows(done)
        if state:
            yield rows([state])

    return formatted.mapInArrow(run, schema)
