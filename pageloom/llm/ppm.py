"""Language-model scores by prediction by partial matching over bytes, beside a unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import id_remainder, text_slices
from pageloom.operators.storage import materialize

ORDER = 5
END = b"\n"  # stands for a text's end; no word holds it
_PAD = END * ORDER
_SLICE = 2 << 20
_WINDOW = 1 << 20
_WORDS, _GRAMS = 0, 1


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def _tokens(raw: bytes | None) -> list[bytes]:
    """Words in ASCII lower case, then the end. bytes.split() parts at blanks and the controls 9 to 13."""
    return [*(raw or b"").lower().split(), END]


def _streams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one row of bytes, each after ORDER ends; where each begins and ends in it."""
    # The end follows the last word directly, so that it costs one symbol.
    parts = [_PAD + b" ".join(t[:-1]) + END for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) - ORDER for p in parts]
    return np.frombuffer(b"".join(parts), np.uint8), starts, ends


def _grams(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """For the places from start to end the ORDER bytes before and the byte itself, as one integer."""
    out = np.zeros(end - start, np.uint64)
    for j in range(ORDER, -1, -1):
        out <<= np.uint64(8)
        out |= data[start - j : end - j]
    return out


def _word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct words, and for each token the place of its word's hash."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for t in texts for w in t), np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen)).view(np.int64)
    return hashes, ids


# --- Counting ---


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Counter:
    """Adds up counts of integers; gives them out when it holds many."""

    def __init__(self, kind: int, most: int = 2_000_000):
        self._kind, self._most, self._held, self._n = kind, most, [], 0

    def _sum(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self._held))
        self._held = []  # the parts are not held while their sums are made
        return _summed(keys, counts)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._held.append((keys, counts))
        self._n += len(keys)
        if self._n > self._most:
            keys, counts = self._sum()
            self._held, self._n = [(keys, counts)], len(keys)
            if self._n > self._most // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._held:
            keys, counts = self._sum()
            for k in range(0, len(keys), 1 << 18):
                part = slice(k, k + (1 << 18))
                kind = pa.array(np.full(len(keys[part]), self._kind, np.int32))
                yield pa.RecordBatch.from_arrays([kind, pa.array(keys[part]), pa.array(counts[part])], names=["kind", "key", "n"])
        self._held, self._n = [], 0


def count_corpus(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, key, n: tokens by the hash of the word, and byte grams of ORDER + 1, over all texts.

    Each task adds up what it reads before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = _Counter(_WORDS), _Counter(_GRAMS)
        for batch in text_slices(batches, 0, _SLICE):
            texts = [_tokens(t) for t in batch.column(0).to_pylist()]
            hashes, ids = _word_ids(texts)
            yield from words.add(hashes, np.bincount(ids, minlength=len(hashes)))
            data, starts, ends = _streams(texts)
            inside = np.ones(len(data), bool)
            inside[(starts[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
            for k in range(ORDER, len(data), _WINDOW):
                top = min(k + _WINDOW, len(data))
                found, n = np.unique(_grams(data, k, top)[inside[k:top]], return_counts=True)
                yield from grams.add(found.view(np.int64), n)
        yield from words.rest()
        yield from grams.rest()

    chosen = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    counted = chosen.mapInArrow(run, "kind int, key bigint, n bigint")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- The model ---


class _Lookup:
    """Places of integers in a sorted list, by hash tables; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(_mask(8)))  # the last stands for "none"
        self._tables, rest = [], np.arange(len(keys))
        none, draw = len(keys), np.random.default_rng(len(keys))
        while True:
            odd = np.uint64(int(draw.integers(1 << 62, 1 << 63)) | 1)
            bits = max(10, (2 * len(rest)).bit_length())
            shift = np.uint64(64 - bits)
            at = (self.keys[rest] * odd) >> shift
            table = np.full(1 << bits, none, np.int32)
            table[at] = rest
            self._tables.append((odd, shift, table))
            rest = rest[table[at] != rest]
            if not len(rest):
                break

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int32)
        open_ = None
        for odd, shift, table in self._tables:
            some = wanted if open_ is None else wanted[open_]
            at = table[(some * odd) >> shift]
            hit = self.keys[at] == some
            if open_ is None:
                out[hit] = at[hit]
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = at[hit]
                open_ = open_[~hit]
        return out


@dataclass
class PPM:
    """A byte-context trie: contexts of each order, and log10 P(symbol | context) for every symbol."""

    symbols: np.ndarray  # byte to column; all bytes that were never seen share the last
    contexts: list[np.ndarray]
    tables: list[np.ndarray]


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> PPM:
    """The model of the grams (context and symbol) and counts of each order, from 0 up, in memory; train() has it as tables.

    In a context with T occurrences of D different symbols, a symbol seen c
    times has c / (T + D) and an escape D / (T + D). After an escape the next
    shorter context is asked without the symbols of the longer one. A longer
    context's symbols are among the shorter one's, so what follows an escape
    depends on the context alone and every symbol's probability is a table entry.
    Below order 0 all bytes left are alike.
    """
    seen = np.unique((levels[0][0] & np.uint64(255)).astype(np.int64)) if len(levels[0][0]) else np.zeros(0, np.int64)
    size = len(seen)
    symbols = np.full(256, size, np.int64)
    symbols[seen] = np.arange(size)
    unseen = max(256 - size, 1)
    contexts, tables = [], []
    above_counts = above_escaped = above_keys = None
    for order, (grams, counts) in enumerate(levels):
        keys, row = np.unique(grams >> np.uint64(8), return_inverse=True)
        if not order:
            keys, row = np.zeros(1, np.uint64), np.zeros(len(grams), np.int64)
        table = np.zeros((len(keys), size + 1), np.float32)
        escaped_all = np.zeros_like(table)
        count_all = np.zeros((len(keys), size + 1), np.float32)
        column = symbols[(grams & np.uint64(255)).astype(np.int64)]
        count_all[row, column] = counts
        parent = np.searchsorted(above_keys, keys & np.uint64(_mask(order - 1))) if order else None
        for k in range(0, len(keys), 4096):
            c = count_all[k : k + 4096].astype(np.float64)
            has = c > 0
            total, kinds = c.sum(1, keepdims=True), has.sum(1, keepdims=True)
            if order:
                up = parent[k : k + 4096]
                pc = np.where(has, 0.0, above_counts[up])
                pt, pk = pc.sum(1, keepdims=True), (pc > 0).sum(1, keepdims=True)
                left = np.maximum(pt + pk, 1)
                # Where all symbols of the parent are excluded, it escapes for sure.
                escape = np.where(pk == 0, 1.0, pk / left)
                escaped = np.where(has, 0.0, np.where(pc > 0, pc / left, escape * above_escaped[up]))
            else:
                escaped = np.where(has, 0.0, 1.0 / unseen)
            base = np.maximum(total + kinds, 1)
            out = np.where(has, c / base, np.where(kinds == 0, 1.0, kinds / base) * escaped)
            table[k : k + 4096] = np.log10(np.maximum(out, 1e-300))
            escaped_all[k : k + 4096] = escaped
        contexts.append(keys)
        tables.append(table)
        above_counts, above_escaped, above_keys = count_all, escaped_all, keys
    return PPM(symbols, contexts, tables)


@dataclass
class Model:
    """The same model as Spark tables, every counted context in it.

    seen: key, n, logp of each gram of ORDER + 1 bytes. levels, from order 0:
    grams (key, n) and contexts (context, total, kinds, and base and left of
    the next shorter context without the symbols of this one). total, kinds:
    of order 0.
    """

    seen: DataFrame
    levels: list[tuple[DataFrame, DataFrame]]
    total: int
    kinds: int


def _low(column: Column, order: int) -> Column:
    return column.bitwiseAND(F.lit(_mask(order)))


def train(grams: DataFrame) -> Model:
    """The model of a table of key (gram) and n. No join key has more than 256 rows: grams that differ in one byte."""
    tables = [grams.select("key", "n")]
    for order in range(ORDER - 1, -1, -1):
        tables.append(materialize(tables[-1].groupBy(_low(F.col("key"), order + 1).alias("key")).agg(F.sum("n").alias("n"))))
    tables = tables[::-1]
    r = tables[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = int(r[0]), int(r[1])
    levels, above = [(tables[0], None)], None
    for order in range(1, ORDER + 1):
        # n_above: how often the symbol follows the next shorter context.
        suffix = Window.partitionBy(_low(F.col("key"), order))
        level = tables[order].withColumn("n_above", F.sum("n").over(suffix))
        found = level.groupBy(F.shiftright("key", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("n_above").alias("taken")
        )
        if above is None:
            found = found.withColumn("up_total", F.lit(total)).withColumn("up_kinds", F.lit(kinds))
        else:
            up = above.select(F.col("context").alias("up"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
            found = found.withColumn("up", _low(F.col("context"), order - 1)).join(up, "up")
        left = F.col("up_kinds") - F.col("kinds")
        above = materialize(found.select("context", "total", "kinds", (F.col("up_total") - F.col("taken") + left).alias("base"), left.alias("left")))
        levels.append((tables[order], above))
    full = tables[ORDER].withColumn("context", F.shiftright("key", 8)).join(above, "context")
    seen = materialize(full.select("key", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("logp")))
    return Model(seen, levels, total, kinds)


def unseen_grams(wanted: DataFrame, model: Model) -> DataFrame:
    """key, logp of the grams wanted(key, distinct), from the longest context that was counted.

    From order 0 up, for the ends of the wanted grams: n, the gram's count;
    escaped, log10 P after its context's escape, if the context was counted;
    and logp, log10 P given the longest counted context up to this order.
    """
    lowest = -math.log10(max(256 - model.kinds, 1))
    below = None
    for order in range(ORDER + 1):
        grams, contexts = model.levels[order]
        rows = wanted if order == ORDER else wanted.select(_low(F.col("key"), order + 1).alias("key")).distinct()
        rows = rows.join(grams, "key", "left")
        if not order:
            rows = rows.withColumn("total", F.lit(model.total or None).cast("bigint")).withColumn("kinds", F.lit(model.kinds))
            rows = rows.withColumn("escaped", F.lit(lowest)).withColumn("logp_below", F.lit(lowest))
        else:
            rows = rows.withColumn("context", F.shiftright("key", 8)).join(contexts, "context", "left")
            rows = rows.withColumn("end", _low(F.col("key"), order)).join(below, "end")
            base = F.log10(F.greatest("base", F.lit(1)))
            # Where all symbols of the shorter context are excluded, it escapes for sure.
            escape = F.when(F.col("left") == 0, 0.0).otherwise(F.log10(F.greatest("left", F.lit(1))) - base)
            rows = rows.withColumn(
                "escaped", F.when(F.col("n_below").isNotNull(), F.log10(F.col("n_below")) - base).otherwise(escape + F.col("escaped_below"))
            )
        whole = F.log10(F.col("total") + F.col("kinds"))
        logp = (
            F.when(F.col("total").isNull(), F.col("logp_below"))
            .when(F.col("n").isNotNull(), F.log10("n") - whole)
            .otherwise(F.log10("kinds") - whole + F.col("escaped"))
        )
        # Written, so that the driver holds the plan of one order at a time.
        rows = materialize(rows.select("key", "n", "escaped", logp.alias("logp")))
        below = rows.select(F.col("key").alias("end"), F.col("n").alias("n_below"), F.col("escaped").alias("escaped_below"), F.col("logp").alias("logp_below"))
    return rows.select("key", "logp")


def hot_grams(seen: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and logp of the most frequent grams, at most `most`: all those above a count."""
    step = F.floor(8 * F.log2("n"))
    counts = sorted(map(tuple, seen.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, held = None, 0
    for at, n in counts:
        held += n
        if held > most:
            break
        least = at
    # In order already, so that the driver holds the list once.
    found = seen.filter(F.lit(False) if least is None else step >= least).select("key", "logp").orderBy("key").toArrow()
    return found.column("key").to_numpy(), found.column("logp").to_numpy()


# --- Scoring ---

_SCORED = (
    "uid bigint, doc_id bigint, n_tokens bigint, hot_known bigint, hot_score double, score double, "
    "rare array<bigint>, rare_n array<int>, cold array<bigint>, cold_n array<int>"
)


def _by_text(text: np.ndarray, ids: np.ndarray, values: np.ndarray, n_texts: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each text the different values at its ids, and how often each is there."""
    size = max(len(values), 1)
    pair, n = np.unique(text * size + ids, return_counts=True)
    offsets = pa.array(np.searchsorted(pair, np.arange(n_texts + 1) * size), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values[pair % size])), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, divisor: int = 7, hot_words: int = 1 << 19,
    most_grams: int = 1 << 21,
) -> DataFrame:
    """Score every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from all documents whose crc32 of the id as text, modulo
    divisor, is not held_out. score is the log10 probability of the text's words
    in ASCII lower case, joined by one blank, and its end. A null text is empty
    and holds just the end; null ids are documents like any other, equal rows
    are scored alike. No training documents give a uniform byte model and
    counts of 0; no documents give no rows.

    For base_score the words that make at least one part in hot_words of the
    training tokens, at most hot_words of them, go to all tasks; each text's
    other words are looked up by a join, whose keys are rare by that rule. For
    score the most_grams most frequent byte grams of ORDER + 1 go to all tasks
    likewise; each text's other grams, those never counted among them, are
    looked up in the tables of all contexts.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = id_remainder("doc_id", divisor) == held_out
    counts = materialize(count_corpus(chosen.filter(~out)))
    words, grams = counts.filter(F.col("kind") == _WORDS), counts.filter(F.col("kind") == _GRAMS)
    r = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_train, n_kinds = int(r[0]), int(r[1])
    base = float(np.log10(n_train + n_kinds + 1))
    model = train(grams)
    hot = words.filter(F.col("n") >= -(-n_train // hot_words)).select("key", F.col("n").cast("double")).orderBy("key").toArrow()
    shared = spark.sparkContext.broadcast((hot.column("key").to_numpy(), hot.column("n").to_numpy(), *hot_grams(model.seen, most_grams)))
    del hot  # the tasks have it; the driver keeps none of it
    pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, gram_keys, gram_logs = shared.value
        logs = np.log10(counts + 1) - base
        lookup, gram_logs = _Lookup(gram_keys), np.append(gram_logs, 0.0)
        uid = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches, 1, _SLICE):
            texts = [_tokens(t) for t in batch.column(1).to_pylist()]
            hashes, ids = _word_ids(texts)
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
            value = np.where(known, logs[at] if len(keys) else 0.0, 0.0)
            n_tokens = np.array([len(t) for t in texts])
            first = np.cumsum(n_tokens) - n_tokens
            data, starts, ends = _streams(texts)
            scores, inside = np.zeros(len(data)), np.ones(len(data), bool)
            inside[(starts[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
            cold_at, cold_keys = [], []
            for k in range(ORDER, len(data), _WINDOW):
                top = min(k + _WINDOW, len(data))
                wanted = _grams(data, k, top)
                found = lookup.find(wanted)
                scores[k:top] = gram_logs[found]
                miss = np.flatnonzero((found < 0) & inside[k:top])
                cold_at.append(k + miss)
                cold_keys.append(wanted[miss].view(np.int64))
            score = np.add.reduceat(np.append(scores, 0.0), np.stack([starts, ends], axis=1).ravel())[::2]
            different, cold_ids = np.unique(np.concatenate(cold_keys), return_inverse=True)
            cold = _by_text(np.searchsorted(starts, np.concatenate(cold_at), side="right") - 1, cold_ids, different, len(texts))
            # The rare words of each text with their numbers there.
            doc = np.repeat(np.arange(len(texts)), n_tokens)
            rare = ~known[ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(len(texts))), batch.column(0), pa.array(n_tokens), pa.array(np.add.reduceat(known[ids].astype(np.int64), first)),
                    pa.array(np.add.reduceat(value[ids], first)), pa.array(score),
                    *_by_text(doc[rare], ids[rare], hashes, len(texts)), *cold,
                ],
                names=["uid", "doc_id", "n_tokens", "hot_known", "hot_score", "score", "rare", "rare_n", "cold", "cold_n"],
            )
            uid += len(texts)

    scored = materialize(chosen.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _SCORED))
    each = scored.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("uid", F.col("r.rare").alias("key"), F.col("r.rare_n").alias("m"))
    looked = each.join(words.select("key", "n"), "key", "left")
    summed = looked.groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("m") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(base))).alias("rare_score"),
    )
    passed = scored.select("uid", F.explode(F.arrays_zip("cold", "cold_n")).alias("r")).select("uid", F.col("r.cold").alias("key"), F.col("r.cold_n").alias("m"))
    first = materialize(passed.select("key").distinct().join(model.seen.select("key", "logp"), "key", "left"))
    missing = unseen_grams(first.filter(F.col("logp").isNull()).select("key"), model)
    summed = materialize(summed)
    values = first.filter(F.col("logp").isNotNull()).unionByName(missing)
    cold_score = materialize(passed.join(values, "key").groupBy("uid").agg(F.sum(F.col("m") * F.col("logp")).alias("cold_score")))
    whole = scored.drop("rare", "rare_n", "cold", "cold_n").join(summed, "uid", "left").join(cold_score, "uid", "left")
    return whole.select(
        "doc_id", out.alias("held_out"), "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"), (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("cold_score", F.lit(0.0))).alias("score"),
    )
