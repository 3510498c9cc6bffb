"""Token ids in shard files with a minimal perfect hash index from document key to place.

A shard file holds, in this order:

* payload: the ids of its documents one after another, raw little-endian unsigned
  integers of 2 or 4 bytes;
* index, one array after another: document keys and null flags in payload order;
  for each hash level its bit map of 64-bit words and the number of bits set before
  each word; then for each hash slot a fingerprint (uint32), the place of the
  first id (uint64), the number of ids (uint64), the key itself (int64) and its
  number among equal keys (uint32);
* a JSON header with the array table, and 16 bytes: its length and the magic.

The hash places keys level by level: a key that meets no other at its bit of a
level keeps it, the rest go to the next level; a key's slot is the number of
bits set before its own, so n keys have the slots 0 to n - 1. Looking a key up
reads one bit per level, one fingerprint and one place, whatever the shard's size.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import mix, text_slices
from pageloom.llm.token_ids import encoder_of
from pageloom.operators.storage import checkpoint_dir, materialize

MAGIC = b"PGLTOK01"
_NULL_KEY = -(1 << 63)

# --- The hash ---


def _key_hash(keys: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed)) + copies.astype(np.uint64))


class PerfectHash:
    """Distinct (key, copy) pairs to the slots 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.ranks = levels, ranks

    @classmethod
    def build(cls, keys: np.ndarray, copies: np.ndarray) -> PerfectHash:
        levels, ranks, before = [], [], 0
        while len(keys):
            bits = -(-2 * len(keys) // 64) * 64
            at = _key_hash(keys, copies, len(levels) + 1) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            levels.append(words)
            ranks.append((before + np.cumsum(ones) - ones).astype("<u4"))
            before += int(ones.sum())
            met = ~alone[at.astype(np.int64)]
            keys, copies = keys[met], copies[met]
        return cls(levels, ranks)

    def slots(self, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _key_hash(keys[open_], copies[open_], k + 1) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out


def _fingerprints(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return (_key_hash(keys, copies, 0) >> np.uint64(32)).astype("<u4")


def _copies(sorted_keys: np.ndarray) -> np.ndarray:
    """For keys in order, how many equal keys stand before each."""
    n = np.arange(len(sorted_keys))
    first = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(n) else np.zeros(0, bool)
    return n - np.maximum.accumulate(np.where(first, n, 0)) if len(n) else n


# --- One shard ---


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a URI or a plain path; executors open shards through it."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


class ShardWriter:
    """Writes one shard; payload goes out as it comes, only keys and lengths are held."""

    def __init__(self, folder: str, name: str, dtype: np.dtype):
        self._fs, base = _store(folder)
        self._path, self._dtype = f"{base}/{name}", dtype
        self._part = f"{base}/.{name}-{uuid.uuid4().hex}"
        self._out = self._fs.open_output_stream(self._part)
        self._keys: list[int | None] = []
        self._lengths: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self._out.write(ids)
        self._keys.append(key)
        self._lengths.append(len(ids) // self._dtype.itemsize)

    def close(self) -> tuple[int, int]:
        """Finish the file under its name; the documents and ids in it. A task that runs twice writes the same file."""
        lengths = np.array(self._lengths, "<u8")
        starts = np.cumsum(lengths, dtype="<u8") - lengths
        null = np.array([k is None for k in self._keys], "u1")
        keys = np.array([_NULL_KEY if k is None else k for k in self._keys], "<i8")
        copies = _copies(keys)
        hashed = PerfectHash.build(keys, copies)
        order = np.empty(len(keys), np.int64)
        order[hashed.slots(keys, copies)] = np.arange(len(keys))
        arrays = [("keys", keys), ("null", null)]
        for k, (words, ranks) in enumerate(zip(hashed.levels, hashed.ranks)):
            arrays += [(f"level{k}", words), (f"rank{k}", ranks)]
        arrays += [("fingerprints", _fingerprints(keys, copies)[order]), ("starts", starts[order]), ("lengths", lengths[order])]
        arrays += [("slot_keys", keys[order]), ("slot_copies", copies[order].astype("<u4"))]
        at, listed = int(lengths.sum()) * self._dtype.itemsize, []
        for name, a in arrays:
            listed.append((name, a.dtype.str, at, len(a)))
            self._out.write(a.tobytes())
            at += a.nbytes
        header = json.dumps({"ids": self._dtype.str, "arrays": listed}).encode()
        self._out.write(header + struct.pack("<Q", len(header)) + MAGIC)
        self._out.close()
        self._fs.move(self._part, self._path)
        return len(keys), int(lengths.sum())


class ShardReader:
    """Keyed reads of one shard file."""

    def __init__(self, folder: str, name: str):
        self._fs, base = _store(folder)
        self._file = self._fs.open_input_file(f"{base}/{name}")
        end = self._file.size()
        n, magic = struct.unpack("<Q8s", self._file.read_at(16, end - 16))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        header = json.loads(self._file.read_at(n, end - 16 - n))
        self.dtype = np.dtype(header["ids"])
        self._arrays = {name: (dtype, at, size) for name, dtype, at, size in header["arrays"]}
        k = 0
        levels, ranks = [], []
        while f"level{k}" in self._arrays:
            levels.append(self._array(f"level{k}"))
            ranks.append(self._array(f"rank{k}"))
            k += 1
        self._hash = PerfectHash(levels, ranks)
        self._slots = [self._array(x) for x in ("fingerprints", "starts", "lengths")]

    def _array(self, name: str) -> np.ndarray:
        dtype, at, size = self._arrays[name]
        dtype = np.dtype(dtype)
        return np.frombuffer(self._file.read_at(size * dtype.itemsize, at), dtype)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in payload order and whether each is null."""
        return self._array("keys"), self._array("null").astype(bool)

    def places(self, keys: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, its first id's place in the shard and its number of ids."""
        prints, starts, lengths = self._slots
        if not len(prints) or not len(keys):
            none = np.zeros(len(keys), np.int64)
            return none.astype(bool), none, none
        slot = self._hash.slots(keys, copies)
        found = (slot >= 0) & (prints[slot] == _fingerprints(keys, copies))
        # A fingerprint rules out nearly all other keys; what it leaves is compared itself.
        there = slot[found]
        found[found] = (self._array("slot_keys")[there] == keys[found]) & (self._array("slot_copies")[there] == copies[found])
        return found, starts[slot].astype(np.int64), lengths[slot].astype(np.int64)

    def ids(self, start: int, length: int) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self._file.read_at(length * size, start * size), self.dtype)

    def close(self) -> None:
        self._file.close()


# --- The same on Spark ---


def _limits(docs: DataFrame, shard_bytes: int) -> list[int]:
    """Ids that part the table into shards of about shard_bytes of text; one number for each shard reaches the driver."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    if n == 1:
        return []
    at = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(max(10_000, 20 * n)))).first()[0]
    return sorted(found or [])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
    shard_bytes: int = 32 << 20,
) -> DataFrame:
    """Encode documents into shard files under `folder`, in ascending id order.

    Returns the manifest, a row for each shard: shard, file, n_docs, n_ids and
    first_id, the number of ids in the shards before. It is also written to
    `folder`/manifest. A null text is empty; null ids come first; rows of one id
    stand in the order of their ids' bytes and are told apart by their number
    (0, 1, …). An id that holds many shards' worth of rows is spread over these
    shards. No documents give no shard and an empty manifest.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    limits = np.array(_limits(chosen, shard_bytes), np.int64)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    end = None if end_id is None else int(end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        tail = b"" if end is None else end.to_bytes(encoder.dtype.itemsize, "little")
        for batch in text_slices(batches, 1, 4 << 20):
            raw = encoder.encode_column(batch.column(1), tail)
            keys = batch.column(0).fill_null(_NULL_KEY).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(limits, keys, "left"), np.searchsorted(limits, keys, "right")
            # An id equal to several limits may lie in any shard between them: equal ids have no order among shards.
            shard = low.copy()
            for k in np.flatnonzero(high > low).tolist():
                shard[k] += zlib.crc32(raw[k].as_py()) % (high[k] - low[k] + 1)
            width = pa.array(np.full(len(raw), encoder.dtype.itemsize, np.int8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard, pa.int32()), width, raw], names=["doc_id", "shard", "width", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, current = None, None

        def closed():
            n_docs, n_ids = writer.close()
            return pa.RecordBatch.from_pylist([{"shard": current, "file": f"shard-{current:06d}.ids", "n_docs": n_docs, "n_ids": n_ids}], schema=manifest)

        for batch in batches:
            for key, shard, width, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != current:
                    if writer:
                        yield closed()
                    writer, current = ShardWriter(folder, f"shard-{shard:06d}.ids", np.dtype(f"<u{width}")), shard
                writer.add(key, ids)
        if writer:
            yield closed()

    manifest = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    encoded = chosen.mapInArrow(encode, "doc_id bigint, shard int, width tinyint, ids binary")
    dealt = encoded.repartitionById(len(limits) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    written = materialize(dealt.mapInArrow(write, "shard int, file string, n_docs bigint, n_ids bigint"))
    # A row for each shard: the number of shards is the text's size over shard_bytes.
    rows, first = [], 0
    for r in sorted(written.collect()):
        rows.append((*r, first))
        first += r["n_ids"]
    schema = "shard int, file string, n_docs bigint, n_ids bigint, first_id bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


_FOUND = "doc_id bigint, copy bigint, shard int, start bigint, n_tokens bigint, ids_crc32 bigint"


def _found_rows(reader: ShardReader, keys, null, copies, shard: int, first: int, with_ids: bool, piece: int = 4096) -> Iterator[pa.RecordBatch]:
    there, starts, lengths = reader.places(keys, copies)
    keys, null, copies, starts, lengths = (a[there] for a in (keys, null, copies, starts, lengths))
    for k in range(0, len(keys), piece):
        part = slice(k, k + piece)
        ids = [reader.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts[part].tolist(), lengths[part].tolist())]
        columns = [
            pa.array(keys[part], mask=null[part]), pa.array(copies[part].astype(np.int64)), pa.array([shard] * len(ids), pa.int32()),
            pa.array(starts[part] + first), pa.array(lengths[part]), pa.array([zlib.crc32(b) for b in ids], pa.int64()),
        ] + ([pa.array(ids, pa.binary())] if with_ids else [])
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "shard", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files, each found by its key: doc_id, copy, shard, start, n_tokens, ids_crc32[, ids].

    copy tells rows of one doc_id apart; start counts the ids of all documents
    before; ids and their checksum are little-endian unsigned 32-bit.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "file", "first_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader = ShardReader(folder, r["file"])
                keys, null = reader.keys()
                yield from _found_rows(reader, keys, null, _copies(keys), r["shard"], r["first_id"], with_ids)
                reader.close()

    n = max(manifest.count(), 1)
    return manifest.repartition(n, "shard").mapInArrow(read, _FOUND + (", ids binary" if with_ids else ""))


def lookup_token_files(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The documents with the given ids; a key that no shard holds has no row, a null key finds none.

    Each key is asked of each shard whose index it may be in, and only the index
    and the found documents' ids are read.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "file", "first_id")
    asked = keys.select(F.col(id_col).cast("bigint").alias("key")).filter("key IS NOT NULL").distinct()
    shards = [r[0] for r in manifest.select("shard").collect()]
    each = asked.withColumn("shard", F.explode(F.array(*map(F.lit, shards)).cast("array<int>")))
    pairs = each.join(manifest, "shard").repartition("shard").sortWithinPartitions("shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            rows = batch.to_pandas()
            for (shard, file, first), part in rows.groupby(["shard", "file", "first_id"]):
                if file != name:
                    reader, name = ShardReader(folder, file), file
                wanted, copy = part["key"].to_numpy(np.int64), 0
                while len(wanted):
                    copies = np.full(len(wanted), copy)
                    there, _, _ = reader.places(wanted, copies)
                    wanted = wanted[there]
                    yield from _found_rows(reader, wanted, np.zeros(len(wanted), bool), copies[there], int(shard), int(first), with_ids)
                    copy += 1

    return pairs.select("key", "shard", "file", "first_id").mapInArrow(read, _FOUND + (", ids binary" if with_ids else ""))


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
