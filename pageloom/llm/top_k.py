"""Exact top-k by inner product with MaxScore: dimensions are the query's terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import blocks
from pageloom.operators.storage import materialize


def max_score(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one query among the rows of a shard, ties to smaller ids.

    A term's contribution q * x is counted above its least in the shard, so no
    contribution is negative and its greatest is a bound. Terms are taken by
    falling bound. While what the terms not yet taken can add could still lift
    an unseen row into the best k, a term is essential: its postings (all rows,
    vectors being dense) are traversed. The others are non-essential: they are
    probed only for rows whose score so far plus the bounds left still reach the
    k-th best, which is raised between terms. Rows given up are those that
    cannot reach it, so the result is exact.
    """
    alive = np.flatnonzero(ids != own) if own is not None else np.arange(len(ids))
    if not len(alive):
        return alive, alive
    low = np.minimum(query * rows.min(0), query * rows.max(0))
    high = np.maximum(query * rows.min(0), query * rows.max(0))
    order = np.argsort(low - high, kind="stable")
    left = np.cumsum((high - low)[order][::-1])[::-1]  # what the terms from here on can add
    scores = np.full(len(alive), int(low.sum()), np.int64)
    step = 8
    for at in range(0, len(order), step):
        terms = order[at : at + step]
        scores += (rows[np.ix_(alive, terms)] @ query[terms]) - int(low[terms].sum())
        rest = int(left[at + step]) if at + step < len(order) else 0
        if len(alive) > k:
            # The k-th best of what is sure so far: every row's score can only grow.
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores + rest >= least
            alive, scores = alive[keep], scores[keep]
    best = np.lexsort((ids[alive], -scores))[:k]
    return ids[alive][best], scores[best]


def _vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and floor(scale * x) of the vectors all whose components are finite numbers."""
    x = F.col(vector_col).cast("array<double>")
    chosen = df.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull())
    chosen = chosen.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))))
    return chosen.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("x"))


def _packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors in blocks of at most `size` rows: the block's ids and components as bytes, padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks(batches, size):
            ids = held.column("vec_id").to_pylist()
            lists = held.column("x").combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            width = int(lengths.max(initial=0))
            x = np.zeros((len(ids), width), "<i8")
            x[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
            null = [i is None for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([np.array([0 if i is None else i for i in ids], "<i8").tobytes()]),
                    pa.array([np.array(null, "u1").tobytes()]), pa.array([x.tobytes()]),
                ],
                names=[f"{name}_ids", f"{name}_null", f"{name}_x"],
            )

    return vectors.mapInArrow(run, f"{name}_ids binary, {name}_null binary, {name}_x binary")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 256.0, shard_rows: int = 4096, query_rows: int = 256,
) -> DataFrame:
    """The k highest integer inner products of each query with all vectors but its own.

    Components become floor(scale * x). Vectors that are null or hold a null or
    non-finite component take no part, on either side. Vectors of different
    lengths are compared over the shorter one's components. Returns query_id,
    rank from 1, vec_id, score; ties go to the smaller vec_id. A null vec_id is
    a candidate after all others and no query. Rows that repeat a vec_id are
    candidates of their own; a repeated query answers once. Sums must fit in 64
    bits. No queries or no candidates give no rows.

    Vectors are packed in shards and the query set in blocks; every block meets
    every shard in a task of its own, and the shards' best k are merged.
    """
    shards = materialize(_packed(_vectors(vectors, id_col, vector_col, scale), shard_rows, "v").withColumn("shard", F.monotonically_increasing_id()))
    asked = _vectors(queries, id_col, vector_col, scale).filter("vec_id IS NOT NULL").dropDuplicates(["vec_id"])
    asked = materialize(_packed(asked, query_rows, "q").withColumn("block", F.monotonically_increasing_id()))
    # The stated query set against all rows: a small row for each block and shard, which then fetches both.
    n = 16
    cells = (
        shards.select("shard").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .join(asked.select("block", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("_k")), "_k").drop("_k")
    )
    met = cells.join(asked, "block").join(shards, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out: list[list] = [[], [], []]
                ids, null = np.frombuffer(r["v_ids"], "<i8"), np.frombuffer(r["v_null"], "u1").astype(bool)
                wanted = np.frombuffer(r["q_ids"], "<i8")
                x = np.frombuffer(r["v_x"], "<i8").reshape(len(ids), -1)
                q = np.frombuffer(r["q_x"], "<i8").reshape(len(wanted), -1)
                width = min(x.shape[1], q.shape[1])
                # A null id stands last among ties: it gets the greatest number here.
                shown = np.where(null, np.iinfo(np.int64).max, ids)
                for query, own in zip(q[:, :width], wanted.tolist()):
                    found, scores = max_score(x[:, :width], shown, query, own, k)
                    out[0] += [own] * len(found)
                    out[1] += [None if f == np.iinfo(np.int64).max else f for f in found.tolist()]
                    out[2] += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    best = met.select("v_ids", "v_null", "v_x", "q_ids", "q_x").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
