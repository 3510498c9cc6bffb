"""Jaccard join of documents' word shingles by token-combination prefixes, and its components.

A set that lacks at most t of its tokens in a partner keeps, of any c tokens,
at least c - t. Tokens are ordered, rare ones first, and a prefix is taken that
a partner cannot empty: a rare token falls to one missing token, the pairs among
c frequent tokens of one class to c - 1. So the prefix is extended until
(number of rare tokens) + sum over classes (c - 1) exceeds t; two similar sets
then share a rare token or a pair of frequent ones of their prefixes. Single
tokens are indexed for the rare, pairs within a class for the frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.common import mix, row_key, text_slices
from pageloom.llm.components import component_labels
from pageloom.operators.storage import materialize

_SLICE = 4 << 20
CELL_BITS = 18
SKETCH, WIDE_SKETCH = 256, 1024
_BLOCK = 256
# Of a set's keys, the first ones by which a pair that meets at many keys is given out at one of them.
_FIRST_KEYS = 16


def shingle_sets(raws: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; fewer words than `size` are one shingle."""
    seen: dict[bytes, int] = {}
    texts = [(r or b"").lower().split() for r in raws]
    counts = [len(t) for t in texts]
    ids = np.fromiter((seen.setdefault(w, len(seen)) for t in texts for w in t), np.int64, sum(counts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    word = np.concatenate([hashes[ids], np.zeros(size, np.uint64)])

    def chained(start: int, end: int, n: int) -> np.ndarray:
        out = np.full(end - start, n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word[start + k : end + k])
        return out

    every = chained(0, len(ids), size) if len(ids) else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(every[at : at + n - size + 1]))
        else:
            out.append(chained(at, at + 1, n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def digest(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; sets of one name are taken for equal."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed(n: int, percent: int) -> int:
    """The fewest tokens that a partner of a set of n tokens shares with it."""
    return -(-percent * n // 100)


def classes(n: int, percent: int) -> int:
    """Into how many classes a set of n tokens parts its frequent ones: a power of 2, about half the tokens it can lack."""
    lacking = n - needed(n, percent)
    return 1 << max(0, (lacking // 2 + 1) - 1).bit_length()


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set; frequent tells which tokens are frequent, the same way for every set.

    The classes depend on the size of a set, so a set has keys for each number of
    classes that a smaller partner may use: at most two.
    """
    n = len(tokens)
    least = needed(n, percent)
    need = n - least + 1
    rare, often = tokens[~frequent], tokens[frequent]
    if len(rare) >= need:
        return rare[:need]
    need -= len(rare)
    keys = [rare]
    for k in sorted({classes(m, percent) for m in range(max(least, 1), n + 1)}):
        of = (often >> np.uint64(7)) % np.uint64(k)
        # A token raises the sum if it is not the first of its class.
        first = np.zeros(len(often), bool)
        first[np.unique(of, return_index=True)[1]] = True
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1
        chosen, of = often[:end], of[:end]
        order = np.argsort(of, kind="stable")
        chosen, of = chosen[order], of[order]
        # Pairs at distance 1, 2, … in the order of classes, as long as any class has some.
        d = 1
        while d < len(chosen) and (same := of[d:] == of[:-d]).any():
            keys.append(mix(mix(chosen[:-d][same]) + chosen[d:][same]))
            d += 1
    return np.unique(np.concatenate(keys))


def _compatible(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def measure(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: key, doc_id, node (set name), n and sketch of each document; kind 1: cell and n, token counts of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        names = ["kind", "key", "doc_id", "node", "n", "sketch"]
        for batch in text_slices(batches, 2, _SLICE):
            sets = shingle_sets(batch.column(2).to_pylist(), size)
            for s in sets:
                cells += np.bincount((s >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)) if len(s) > 20_000 else 0
            small = [s for s in sets if len(s) <= 20_000]
            if small:
                cells += np.bincount((np.concatenate(small) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
            sketch = [sketch_of(s, SKETCH) for s in sets]
            rows = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(rows, np.int32)), batch.column(0), batch.column(1), pa.array([digest(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary()),
                ],
                names=names,
            )
        used = np.flatnonzero(cells)
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(used), np.int32)), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(used), pa.array(cells[used]), none.cast(pa.binary())],
            names=names,
        )

    return docs.mapInArrow(run, "kind int, key bigint, doc_id bigint, node bigint, n bigint, sketch binary")


def frequent_cells(cells: DataFrame) -> np.ndarray:
    """Which of the 2 ** CELL_BITS hash cells hold a frequent token: well above the mean of all."""
    found = cells.groupBy("node").agg(F.sum("n").alias("n")).toPandas()  # a number for each cell, at most
    counts = np.zeros(1 << CELL_BITS)
    counts[found["node"].to_numpy()] = found["n"].to_numpy()
    mean = counts.mean()
    return counts > mean + 8 * np.sqrt(mean) + 32


def index_rows(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """sig, node, n: the index keys of each set; a task gives the keys of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in text_slices(batches, 0, _SLICE):
            sigs, nodes, sizes = [], [], []
            for s in shingle_sets(batch.column(0).to_pylist(), size):
                # Below this size only equal sets are similar enough.
                if len(s) < 2 or 100 * len(s) < percent * (len(s) + 1):
                    continue
                if (node := digest(s)) in given:
                    continue
                if len(given) < 1_000_000:
                    given.add(node)
                sigs.append(signatures(s, frequent[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)], percent))
                nodes.append(node)
                sizes.append(len(s))
            if sigs:
                counts = [len(x) for x in sigs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int64), counts))],
                    names=["sig", "node", "n"],
                )

    return docs.mapInArrow(run, "sig bigint, node bigint, n bigint")


def shared_keys(index: DataFrame) -> DataFrame:
    """sig, hub, hub_n, node, n: of each key that different sets share, its first set (the hub) with each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # the hub of the last key so far
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            rows = rows[:, new]
            first = np.ones(rows.shape[1], bool)
            first[1:] = rows[0, 1:] != rows[0, :-1]
            hub = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            held = rows[:, hub[-1:]]
            member = ~first & (rows[1] != rows[1, hub])
            if member.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a) for a in (rows[0, member], rows[1, hub[member]], rows[2, hub[member]], rows[1, member], rows[2, member])],
                    names=["sig", "hub", "hub_n", "node", "n"],
                )

    dealt = index.repartition("sig").sortWithinPartitions("sig", "n", "node")
    return dealt.mapInArrow(run, "sig bigint, hub bigint, hub_n bigint, node bigint, n bigint")


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches leave it open that sets of n and m tokens are similar enough.

    A sketch counts a set's tokens by class, up to 255; two sets differ in at
    least as many tokens as their sketches do.
    """
    return (100 + percent) * np.abs(a - b).sum(-1, dtype=np.int64) <= (100 - percent) * (n + m)


def sketch_of(tokens: np.ndarray, width: int) -> bytes:
    """How many tokens of a set lie in each of `width` classes, up to 255."""
    return np.minimum(np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype("u1").tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(len(column), -1).astype(np.int16)


def possible_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of a, b whose sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                yield batch.select([0, 1]).filter(pa.array(_near(_sketches(batch.column(2)), _sketches(batch.column(3)), n, m, percent)))

    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def token_sets(docs: DataFrame, size: int) -> DataFrame:
    """node, n, tokens (sorted 64-bit hashes) and a wide sketch of each distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0, _SLICE):
            sets = shingle_sets(batch.column(0).to_pylist(), size)
            columns = [
                pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([sketch_of(s, WIDE_SKETCH) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "tokens", "sketch"])

    return docs.mapInArrow(run, "node bigint, n bigint, tokens binary, sketch binary").dropDuplicates(["node"])


def _pairs_within(first: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places of rows of one group, in parts; first tells where a group begins."""
    n = len(first)
    starts = np.append(np.flatnonzero(first), n)
    later = starts[np.searchsorted(starts, np.arange(n), side="right")] - np.arange(n) - 1  # rows behind in the group
    before = np.concatenate([[0], np.cumsum(later)])
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(before, before[row] + most, side="right")) - 1)
        left = np.repeat(np.arange(row, end), later[row:end])
        yield left, left + 1 + np.arange(len(left)) - (before[left] - before[row])
        row = end


def _met_before(x: np.ndarray, y: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Whether two sets share one of their first keys that comes before a key; rows of first keys, padded with the greatest."""
    out = np.zeros(len(sig), bool)
    for k in range(x.shape[1]):
        key = x[:, k : k + 1]
        out |= ((key == y) & (key < sig[:, None])).any(1)
    return out


def _open_pairs(shared: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b: possible pairs of sets that share a key and lie in different components so far.

    Keys whose sets are all in one component have none. A key's sets are dealt
    out in blocks, and a task compares the sketches of two blocks, so no task
    holds more than two blocks of a key and only possible pairs are given out. A
    pair that meets at several keys is left to the first of them, as far as the
    least keys of both tell: sets of different components share only such keys, so
    the pair is compared there.
    """
    members = shared.select("sig", "node").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = members.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).filter("m > 1 AND lo <> hi").select("sig", "m")
    k = F.ceil(F.col("m") / _BLOCK).cast("int")
    rows = materialize(members.join(mixed, "sig"))
    last = F.array_repeat(F.lit((1 << 63) - 1).cast("bigint"), _FIRST_KEYS)
    firsts = rows.groupBy("node").agg(F.slice(F.concat(F.slice(F.sort_array(F.collect_set("sig")), 1, _FIRST_KEYS), last), 1, _FIRST_KEYS).alias("firsts"))
    facts = sketches.join(firsts, "node")
    rows = rows.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int")).join(facts, "node")
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "sketch", "firsts"
    )

    def compared(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        sig, own, node, label, n = (rows.column(c).to_numpy() for c in ("sig", "own", "node", "label", "n"))
        one_block = rows.column("i").to_numpy() == rows.column("j").to_numpy()
        sketch = _sketches(rows.column("sketch"))
        firsts = rows.column("firsts").flatten().to_numpy().reshape(rows.num_rows, _FIRST_KEYS)
        a, b = [], []
        for x, y in _pairs_within(first):
            keep = (label[x] != label[y]) & (node[x] != node[y]) & (one_block[x] | (own[x] != own[y]))
            keep &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[keep], y[keep]
            keep = np.concatenate([np.zeros(0, bool), *(
                _near(sketch[x[c : c + 8192]], sketch[y[c : c + 8192]], n[x[c : c + 8192]], n[y[c : c + 8192]], percent) for c in range(0, len(x), 8192))])
            x, y = x[keep], y[keep]
            keep = ~_met_before(firsts[x], firsts[y], sig[x])
            x, y = x[keep], y[keep]
            a.append(np.minimum(node[x], node[y]))
            b.append(np.maximum(node[x], node[y]))
        found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last cell so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            cell = np.stack([rows.column(c).to_numpy() for c in ("sig", "i", "j")])
            first = np.ones(rows.num_rows, bool)
            first[1:] = (cell[:, 1:] != cell[:, :-1]).any(0)
            last = int(np.flatnonzero(first)[-1])
            held = rows.slice(last)
            if last:
                yield compared(rows.slice(0, last), first[:last])
        if held is not None:
            yield compared(held, np.arange(held.num_rows) == 0)

    dealt = cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    """a, b of hub and node, each pair once."""
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of hub and node that do not lie in one component."""
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    known = pairs.join(labels, "node", "left").join(of_hub, "hub", "left")
    return known.filter(F.coalesce("label", "node") != F.coalesce("hub_label", "hub")).select("hub", "node", "votes")


def no_labels(spark: SparkSession) -> DataFrame:
    """No labels yet: every set is a component of its own."""
    return spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("label"))


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) of components after links a, b join some of them.

    The components are worked out over components, of which each pair is one
    link; a node without a label is a component by itself.
    """
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = component_labels(ends.filter("a <> b").distinct())
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("least"))
    known = labels.join(moved, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    own = labels.select(F.col("label").alias("node")).distinct()
    return materialize(known.unionByName(joined.join(own, "node", "left_anti")))


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """key, doc_id, node and n of each document; node, label (of its component) and component_id of each set."""
    if not 50 < percent <= 100 or size < 1:
        raise ValueError("percent must be 51 to 100 and size at least 1")
    chosen = docs.select(
        row_key(id_col, text_col).alias("key"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    measured = materialize(measure(chosen, size))
    documents = measured.filter("kind = 0").select("key", "doc_id", "node", "n", "sketch")
    frequent = frequent_cells(measured.filter("kind = 1"))
    shared = materialize(shared_keys(index_rows(chosen.select("text"), size, percent, frequent)))

    nodes = shared.select("node").union(shared.select("hub")).distinct()
    sketches = documents.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.min("sketch").alias("sketch"))
    sketches = materialize(sketches)

    def linked(pairs: DataFrame) -> DataFrame:
        # Only the texts of possible pairs are read again for their whole sets.
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        keys = materialize(sketches.select("node", "key").join(wanted, "node", "left_semi").select("key"))
        sets = materialize(token_sets(chosen.join(keys, "key", "left_semi").select("text"), size))
        # Whole sets travel only for pairs that a wider sketch leaves open too.
        left = materialize(possible_pairs(pairs, sets.select("node", "n", "sketch"), percent))
        return materialize(verified(left, sets, percent))

    small = sketches.select("node", "n", "sketch")
    # Each set with the hub that most of its keys have; then with more of its other hubs a round, as
    # long as these are apart from it. What is joined already is not compared, so links stay few.
    near = shared.filter(_compatible("hub_n", "n", percent) & (F.col("hub") != F.col("node")))
    near = materialize(near.groupBy("hub", "node").agg(F.count(F.lit(1)).alias("votes")))
    labels, width = no_labels(docs.sparkSession), 1
    while not near.isEmpty():
        turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("votes"), "hub"))
        ranked = materialize(near.withColumn("turn", turn))
        found = linked(materialize(possible_pairs(_ordered(ranked.filter(F.col("turn") <= width)), small, percent)))
        labels = joined_labels(labels, found)
        near = materialize(_apart(ranked.filter(F.col("turn") > width).drop("turn"), labels))
        width *= 4
    open_ = materialize(_open_pairs(shared, labels, small, percent))
    if not open_.isEmpty():
        labels = joined_labels(labels, linked(open_))

    first = documents.groupBy("node").agg(F.min("doc_id").alias("first_doc"))
    least = first.join(labels, "node").groupBy("label").agg(F.min("first_doc").alias("component_id"))
    found = first.join(labels.join(least, "label"), "node", "left")
    found = found.select("node", F.coalesce("label", "node").alias("label"), F.coalesce("component_id", "first_doc").alias("component_id"))
    return documents.select("key", "doc_id", "node", "n"), found


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are lower-cased in ASCII; a document's set is its distinct shingles of
    `size` words, or its whole words as one if it has fewer. Two documents are
    linked if 100 * intersection >= percent * union. component_id is the least
    doc_id reachable by links, its own included; a document without words is
    linked with none. Null texts have no words. A null doc_id never names a
    component that has another; equal sets are one class however many documents
    hold it. percent must be 51 to 100. No documents give no rows.

    First each set is compared with the hub of most of its keys, then round by round
    with more of those hubs that it is not joined with yet. Keys whose sets then lie in
    one component are done; in the others all sets in different components are compared. So every link either is found or joins what is
    joined already, without listing the pairs of a group of copies.
    """
    documents, found = _components(docs, id_col, text_col, size, percent)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return documents.join(found, "node").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The document with the least id of each component, with all its columns.

    Documents without words all stay; of rows equal in id and text one stays; a
    null id stays only where its component has no other.
    """
    documents, found = _components(docs, id_col, text_col, size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = documents.filter("n > 0").join(found, "node").groupBy("label").agg(F.min(order).alias("at"))
    keys = first.select(F.col("at.key").alias("_key")).union(documents.filter("n = 0").select("key")).distinct()
    kept = docs.withColumn("_key", row_key(id_col, text_col)).join(keys, "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select(*[f"`{c}`" for c in docs.columns])
