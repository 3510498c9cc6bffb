"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import id_remainder, row_key, text_slices
from pageloom.operators.storage import materialize

STATISTICS = (
    "log_words", "log_lines", "word_length", "word_length_spread", "long_words", "letters", "upper", "digits", "punctuation",
    "symbols", "other_marks", "non_ascii", "distinct_words", "word_entropy", "repeat_next", "repeat_pairs", "words_per_line",
    "marked_words", "capital_words", "upper_words", "ended_lines", "repeated_lines", "mean_sentence", "stop_mark_share",
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Classes of ASCII bytes: 1 small letter, 2 capital, 3 digit, 4 sentence marks, 5 symbols, 6 other marks; 0 is white space and controls.
_CLASS = np.zeros(256, np.uint8)
for _chars, _class in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (".,;:?'\"-", 4), ("#*$%&|<>@^~=+_", 5), ("!()[]{}/\\`", 6)):
    _CLASS[[ord(c) for c in _chars]] = _class
_CLASS[128:] = 7


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, each of the order of 1; all 0 for a text without words."""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    share = np.bincount(ids) / n
    pairs = ids[:-1] * len(seen) + ids[1:]
    firsts = [w[0] for w in words]
    kinds = list(seen)
    use = share * n
    ends = np.fromiter((w[-1] for w in kinds), "U1", len(kinds))
    upper = np.fromiter((w.isupper() and len(w) > 1 for w in kinds), bool, len(kinds))
    marked = np.isin(ends, list("#*$%&|<>!"))
    stops = np.isin(ends, list(".?!"))
    return [
        np.log1p(n) / 4, np.log1p(len(lines)) / 2, lengths.mean() / 4, min(lengths.std() / 4, 5.0), (lengths > 14).mean() * 4,
        counts[1], counts[2] * 4, counts[3] * 8, counts[4] * 8, counts[5] * 8, counts[6] * 8, counts[7] * 4, len(seen) / n,
        float(-(share * np.log(share)).sum()) / 4, float((ids[1:] == ids[:-1]).mean()) * 4 if n > 1 else 0.0,
        1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0, np.log1p(n / len(lines)) / 2, float(use[marked].sum()) / n * 2,
        sum(c.isupper() for c in firsts) / n, float(use[upper].sum()) / n * 2, sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines), np.log1p(n / (1 + float(use[stops].sum()))) / 2, float(use[stops].sum()) / n * 4,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id and the array `stats` of each document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            rows = np.array([statistics(t or "") for t in batch.column(2).to_pylist()], np.float32)
            offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["key", "doc_id", "stats"])

    chosen = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "key bigint, doc_id bigint, stats array<float>")


# Features are whole multiples of 1 / _UNIT, so that sums over partitions are exact in any order.
_UNIT = 1 << 12


@dataclass
class QualityModel:
    """Frequencies and phases of the features, ridge weights, and the calibration's knots."""

    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return _features(stats, self.frequencies, self.phases)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights / _UNIT

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def _features(stats: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """cos(w x + b) in units, and a constant; all whole numbers."""
    z = np.rint(np.cos(stats.astype(np.float64) @ frequencies + phases) * _UNIT)
    return np.concatenate([z, np.full((len(z), 1), float(_UNIT))], axis=1)


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values in weighted squares (pool adjacent violators)."""
    level, weight, size = [], [], []
    for v, w in zip(values, weights):
        level.append(v), weight.append(w), size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w2, v2, s2 = weight.pop(), level.pop(), size.pop()
            level[-1] = (level[-1] * weight[-1] + v2 * w2) / (weight[-1] + w2)
            weight[-1] += w2
            size[-1] += s2
    return np.repeat(level, size)


def fit(labelled: DataFrame, n_features: int = 192, gamma: float = 0.1, ridge: float = 1e-4, seed: int = 7, bins: int = 512) -> QualityModel:
    """Fit on rows of `stats` and `label` (0 or 1), all of them.

    Rows with a null label are left out. Without rows of both labels every
    score is the share of label 1, or 0.5 without any row.

    Each partition sums its rows' products of features into the normal
    equations; a row of the matrix is a row of the table, summed by Spark. The
    driver solves n_features + 1 equations. For the calibration, raw scores are
    counted in `bins` bins, so what reaches the driver has a fixed size.
    """
    draw = np.random.default_rng(seed)
    d = len(STATISTICS)
    frequencies = draw.normal(0.0, np.sqrt(2 * gamma), (d, n_features))
    phases = draw.uniform(0.0, 2 * np.pi, n_features)
    size = n_features + 1
    rows = labelled.filter("label IS NOT NULL").select("stats", F.col("label").cast("int").alias("label"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target = np.zeros((size, size), np.int64), np.zeros((2, size), np.int64)
        for batch in batches:
            z = _features(np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d), frequencies, phases)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(0, len(z), 4096):  # a float sum of this many products is still exact
                part, of = z[k : k + 4096], y[k : k + 4096]
                gram += (part.T @ part).astype(np.int64)
                target += np.stack([part[of == 0].sum(0), part[of == 1].sum(0)]).astype(np.int64)
        both = np.concatenate([gram, target])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(size + 2), size), pa.int32()), pa.array(np.tile(np.arange(size), size + 2), pa.int32()), pa.array(both.ravel())],
            names=["i", "j", "v"],
        )

    summed = rows.mapInArrow(sums, "i int, j int, v bigint").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v"))
    both = np.zeros((size + 2, size))
    cells = summed.toPandas()  # (n_features + 3) * (n_features + 1) numbers
    both[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    n0, n1 = both[size, -1] / _UNIT, both[size + 1, -1] / _UNIT
    if not n0 or not n1:
        share = 0.5 if not n0 + n1 else n1 / (n0 + n1)
        return QualityModel(frequencies, phases, np.zeros(size), np.array([0.0, 1.0]), np.array([share, share]))
    n = n0 + n1
    gram = both[:size] / _UNIT**2 / n
    # The target counts both labels as halves, so that the rarer one is not drowned.
    target = (both[size + 1] / n1 - both[size] / n0) / _UNIT / 2
    weights = np.linalg.solve(gram + ridge * np.eye(size), target)
    model = QualityModel(frequencies, phases, weights, np.zeros(2), np.zeros(2))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, bins), np.int64)
        for batch in batches:
            raw = model.raw(np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d))
            at = np.clip(np.rint((np.clip(raw, low, high) - low) / (high - low) * (bins - 1)), 0, bins - 1).astype(np.int64)
            for label in (0, 1):
                table[label] += np.bincount(at[batch.column(1).to_numpy(zero_copy_only=False) == label], minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins)), pa.array(table[0]), pa.array(table[1])], names=["bin", "n0", "n1"])

    # Mean raw scores of the two labels bound the range that is worth resolving.
    m0, m1 = both[size] / n0 / _UNIT @ weights, both[size + 1] / n1 / _UNIT @ weights
    low, high = min(m0, m1) - abs(m1 - m0) - 1e-9, max(m0, m1) + abs(m1 - m0) + 1e-9
    found = rows.mapInArrow(counted, "bin bigint, n0 bigint, n1 bigint").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    found = found.sort_values("bin")
    n0s, n1s = found["n0"].to_numpy(np.float64), found["n1"].to_numpy(np.float64)
    used = n0s + n1s > 0
    values = pool(n1s[used] / (n0s + n1s)[used], (n0s + n1s)[used])
    model.knots = low + np.flatnonzero(used) * (high - low) / (bins - 1)
    model.values = values
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """key, doc_id, score and predicted of every row of document_statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(2).to_pylist(), np.float64).reshape(-1, len(STATISTICS))
                s = model.score(x)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["key", "doc_id", "score", "predicted"])

    return stats.select("key", "doc_id", "stats").mapInArrow(run, "key bigint, doc_id bigint, score double, predicted int")


def _scored(docs, labels, id_col, text_col, label_id_col, label_col, held_out) -> DataFrame:
    stats = materialize(document_statistics(docs, id_col, text_col))
    given = labels.select(F.col(label_id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    given = given.filter(F.col("label").isin(0, 1) & (id_remainder("doc_id", 3) != held_out)).distinct()
    return score(stats, fit(stats.join(given, "doc_id")))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", held_out: int = 1,
) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted.

    Learns from all labelled documents whose crc32 of the id as text, mod 3, is
    not `held_out` (pass -1 to hold out none). A score depends on the whole text
    alone; a null text counts as empty. An id with labels of both kinds learns
    from each kind once, repeated equal labels once; null ids are scored but
    never learnt from. No labels give the score 0.5; no documents give no rows.
    """
    scored = _scored(docs, labels, id_col, text_col, label_id_col, label_col, held_out)
    return scored.select("doc_id", (id_remainder("doc_id", 3) == held_out).alias("held_out"), "score", "predicted")


def keep_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", held_out: int = 1,
) -> DataFrame:
    """The documents that classify() predicts label 1, with all their columns."""
    scored = _scored(docs, labels, id_col, text_col, label_id_col, label_col, held_out)
    rejected = scored.filter("predicted = 0").select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", row_key(id_col, text_col)).join(rejected, "_key", "left_anti").select(*[f"`{c}`" for c in docs.columns])
