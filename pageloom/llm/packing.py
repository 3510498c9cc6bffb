"""Packing token sequences: best fit, then a local search that empties bins by swaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import blocks, text_slices
from pageloom.llm.token_ids import encoder_of
from pageloom.operators.storage import materialize

# --- Packing numbers: plain Python on one block of lengths ---


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that takes it.

    Bins of equal room are kept on one stack; the rooms in use are the bits of
    one integer, so the tightest one is found without a search.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


class _Open:
    """Open bins by what they can give back: a sum of no, one or two of their sizes, then by their room.

    The rooms of the bins that hold a sum are the bits of one integer, so the
    bins an exchange fits into are found without a look at the others.
    """

    def __init__(self):
        self.rooms: list[dict[int, int]] = [{}, {}]
        self._bins: list[dict[tuple[int, int], set[int]]] = [{}, {}]

    @staticmethod
    def _sums(sizes: dict[int, list[int]]) -> tuple[set[int], set[int]]:
        alone = sorted(sizes)
        return {0, *alone}, {a + b for k, a in enumerate(alone) for b in alone[k:] if a != b or len(sizes[a]) > 1}

    def add(self, b: int, sizes: dict[int, list[int]], room: int) -> None:
        for rooms, bins, sums in zip(self.rooms, self._bins, self._sums(sizes)):
            for s in sums:
                bins.setdefault((s, room), set()).add(b)
                rooms[s] = rooms.get(s, 0) | 1 << room

    def remove(self, b: int, sizes: dict[int, list[int]], room: int) -> None:
        for rooms, bins, sums in zip(self.rooms, self._bins, self._sums(sizes)):
            for s in sums:
                held = bins[s, room]
                held.remove(b)
                if not held:
                    del bins[s, room]
                    rooms[s] ^= 1 << room
                    if not rooms[s]:
                        del rooms[s]

    def best(self, sizes: dict[int, list[int]], most: int) -> tuple[int, int, int, bool] | None:
        """bin, sum to give, sum to take and whether that is of two pieces, of an exchange that gains most.

        Only bins with at most `most` room are asked; of those that gain alike, one with the tightest room is taken.
        """
        one, two = 0, 0
        for a in sizes:
            one |= 1 << a
        for a, held in sizes.items():
            two |= (one if len(held) > 1 else one ^ 1 << a) << a
        below = (2 << most) - 1
        best, gain = None, 0
        for pairs, totals in ((False, one | two), (True, one)):
            for s, rooms in self.rooms[pairs].items():
                largest = (rooms & below).bit_length() - 1
                if largest > gain:
                    d = (totals >> s & (2 << largest) - 1).bit_length() - 1
                    if d > gain:
                        best, gain = (s, pairs), d
        if best is None:
            return None
        s, pairs = best
        fitting = self.rooms[pairs][s] >> gain
        room = gain + (fitting & -fitting).bit_length() - 1
        return min(self._bins[pairs][s, room]), s + gain, s, pairs


def _chosen(sizes: dict[int, list[int]], total: int, pair: bool) -> list[int]:
    """The sizes of one piece, or else of two, that make the total."""
    if not total:
        return []
    if total in sizes and not pair:
        return [total]
    a = next(a for a in sorted(sizes) if total - a in sizes and (2 * a != total or len(sizes[a]) > 1))
    return [a, total - a]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the least filled bins into the room of the others.

    A bin's pieces are moved or exchanged, one for one, two for one or one for
    two, with those of bins at least as full, the largest gain first, then the
    tightest room, as long as there is a gain; each raises the sum of squared
    fills. It ends when the bins are as few as the total length allows, or after
    a round without an exchange: then no bin has a gaining exchange left.
    """
    fill = [int(lengths[b].sum()) for b in bins]
    needed = -(-sum(fill) // capacity)
    live = len(bins)
    if live <= needed:
        return bins
    held: dict[int, dict[int, list[int]]] = {}
    open_ = _Open()
    for b, pieces in enumerate(bins):
        if fill[b] < capacity:
            held[b] = {}
            for i in pieces:
                held[b].setdefault(int(lengths[i]), []).append(i)
            open_.add(b, held[b], capacity - fill[b])

    def move(sizes: list[int], source: dict[int, list[int]], target: dict[int, list[int]]) -> None:
        for s in sizes:
            target.setdefault(s, []).append(source[s].pop())
            if not source[s]:
                del source[s]

    changed = True
    while changed and live > needed:
        changed = False
        for source in sorted((b for b in held if 0 < fill[b] < capacity), key=lambda b: (fill[b], -b)):
            if live <= needed:
                break
            if fill[source] == capacity:
                continue
            give = held[source]
            open_.remove(source, give, capacity - fill[source])
            while give and (found := open_.best(give, capacity - fill[source])):
                target, total, back, pair = found
                theirs = held[target]
                open_.remove(target, theirs, capacity - fill[target])
                there, here = _chosen(give, total, False), _chosen(theirs, back, pair)
                move(there, give, theirs)
                move(here, theirs, give)
                fill[target] += total - back
                fill[source] -= total - back
                if fill[target] < capacity:
                    open_.add(target, theirs, capacity - fill[target])
                changed = True
            if give:
                open_.add(source, give, capacity - fill[source])
            else:
                live -= 1
    for b, sizes in held.items():
        bins[b] = [i for pieces in sizes.values() for i in pieces]
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of pieces by bin; every length is from 1 to the capacity."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


# --- The same on Spark ---

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Token ids of each document, in pieces of at most `capacity`; only longer documents are cut.

    A null or empty text has just the end id. Rows with a null or repeated id
    are documents like any other. With with_ids the pieces carry `ids`, the
    little-endian unsigned 32-bit ids; ids_crc32 is the checksum of these.
    A document without any id (end_id None and an empty text) is one piece of
    length 0.
    """
    schema = _PIECE + (", ids binary" if with_ids else "")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of stages before this one
        encoder = encoder_of(tokenizer)
        for batch in text_slices(batches, 1, 2 << 20):
            rows: list[tuple] = []
            encoded = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc, raw in zip(batch.column(0).to_pylist(), encoded):
                ids = np.frombuffer(raw, encoder.dtype).astype("<u4").tobytes() + end
                for k in range(0, max(len(ids), 1), step):
                    part = ids[k : k + step]
                    rows.append((doc, k // step, k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, block: int = 1 << 16) -> DataFrame:
    """Add sequence_id and offset to pieces with a length of at most `capacity`.

    Pieces are packed in blocks of at most `block` short pieces of a partition,
    so no task holds more; the pieces of bins that a block leaves less than
    nine tenths full go on to the next block, those of the least filled bins
    first, up to a quarter of a block. Every partition may thus leave
    one bin unfilled, few against what it packs. Read from a written table, a
    lost task packs the same pieces again. Pieces of length 0 share bins with
    others. No pieces give no rows.
    """
    names = pieces.columns

    def place(held: pa.Table, chosen: list[list[int]], first: int) -> pa.RecordBatch:
        order = np.fromiter((i for b in chosen for i in b), np.int64)
        lengths = held.column("length").to_numpy()[order]
        counts = np.array([len(b) for b in chosen], np.int64)
        before = np.cumsum(lengths) - lengths
        offset = before - np.repeat(before[np.cumsum(counts) - counts], counts)
        out = held.take(pa.array(order))
        out = out.append_column("sequence_id", pa.array(np.repeat(first + np.arange(len(chosen)), counts)))
        return out.append_column("offset", pa.array(offset)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the worker held to cut texts is not needed here.
        encoder_of.cache_clear()
        pa.default_memory_pool().release_unused()
        number = TaskContext.get().partitionId() << 33
        rest: pa.Table | None = None

        def packed(short: pa.Table, last: bool):
            nonlocal number, rest
            lengths = short.column("length").to_numpy()
            # A piece of length 0 takes no room; it is counted as 1 and never overfills a bin.
            bins = pack(np.maximum(lengths, 1), capacity)
            keep = [] if last else sorted((b for b in bins if lengths[b].sum() < 0.9 * capacity), key=lambda b: lengths[b].sum())
            keep = keep[: int(np.searchsorted(np.cumsum([len(b) for b in keep]), block // 4, side="right"))]
            open_bins = {b[0] for b in keep}
            done = [b for b in bins if b[0] not in open_bins]
            rest = short.take(pa.array([i for b in keep for i in b], pa.int64())) if keep else None
            if done:
                yield from place(short, done, number).to_batches()
                number += len(done)

        for held in blocks(batches, block):
            full = held.filter(pc.greater_equal(held.column("length"), capacity))
            if full.num_rows:
                yield from place(full, [[i] for i in range(full.num_rows)], number).to_batches()
                number += full.num_rows
            short = held.filter(pc.less(held.column("length"), capacity))
            short = short if rest is None else pa.concat_tables([rest, short])
            rest = None
            if short.num_rows:
                yield from packed(short, False)
        if rest is not None:
            yield from packed(rest, True)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint").select(*names, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False, block: int = 1 << 16,
) -> DataFrame:
    """Documents to fixed-size training sequences; see cut_pieces and pack_pieces."""
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids))
    return pack_pieces(pieces, capacity, block)
