"""Grouping of spelling variants: pairs of words one edit apart, by composing acceptors with a one-edit transducer.

The words are an acceptor. Composed with a transducer that inserts, deletes or
replaces one code point, and with the acceptor again, it accepts the pairs of
words one edit apart. The composed machine is enumerated partition by partition:
a partition is the state it is in after a prefix that both words share, or, read
backwards, after a suffix that both share, and holds two minimal acceptors, of
the rests of the shorter and of the longer words. Of a pair at least one half of
the shorter word is shared, so every word enters four partitions. One that is
large is divided again by halves of the part left over, until few words are in
it or one code point is left, so that no prefix is too frequent.

A pair belongs to the partition that its first differing place names, and to no
other, so partial results (how many near words, and the best) can be summed
without pairs ever being written out.

Defined results: null and empty texts have no words; a null id counts as an
empty text where it is hashed; repeated rows count each; words that are equally
frequent are taken in code-point order. Other columns are not read. No rows give none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import text_slices
from pageloom.operators.storage import materialize

LETTERS = "A-Za-zÀ-ÿ"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10

# Counts a task holds before it gives them on, and what a partition holds that is not divided again.
HELD_COUNTS = 1 << 18
MAX_WORDS, MAX_REST = 4096, 64
LONG_TEXT = 1 << 20


def _runs(text: str, pattern: re.Pattern) -> Counter:
    """How often each run occurs; a long text is read on without a list of all its runs."""
    if len(text) <= LONG_TEXT:
        runs = Counter(pattern.findall(text))
    else:
        runs = Counter(m.group() for m in pattern.finditer(text))
    lower: Counter = Counter()
    for run, n in runs.items():
        lower[run.lower() if run.isascii() else run.translate(ASCII_LOWER)] += n
    return lower


def word_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = None,
) -> DataFrame:
    """word and n, how often it occurs, of words long and frequent enough.

    With `damage`, a run whose hash with its document's id that number divides
    loses the code point that the hash names, in all places of the document.
    """
    pattern = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for part in text_slices(batches, 1):
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                runs = _runs(text, pattern)
                if damage:
                    seed = zlib.crc32(f"{name}:".encode())
                    for run, n in runs.items():
                        h = zlib.crc32(run.encode(), seed)
                        if h % damage == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < min_length:
                                continue
                        held[run] += n
                else:
                    held.update(runs)
                if len(held) >= HELD_COUNTS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= min_count)


def _entry(m: Column, head: Column, tail: Column) -> Column:
    """A partition of pairs whose shorter word has m code points, which share so many at the start and at the end."""
    shared = F.xxhash64(m, head, tail, F.left("word", head), F.right("word", tail))
    return F.struct(m.alias("m"), head.alias("head"), tail.alias("tail"), shared.alias("key"))


def _entries(words: DataFrame, min_length: int) -> DataFrame:
    n, none = F.length("word"), F.lit(0)
    halves = []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        halves += [F.when(m >= min_length, _entry(m, half, none)), F.when(m >= min_length, _entry(m, none, m - half))]
    each = F.explode(F.filter(F.array(*halves), lambda e: e.isNotNull()))
    return words.select("word", "n", each.alias("e")).select("word", "n", "e.*")


def _divided(entries: DataFrame) -> DataFrame:
    """Each entry again in the two partitions of which one holds any pair of its own."""
    rest = F.col("m") - F.col("head") - F.col("tail")
    half = F.floor(rest / 2).cast("int")
    each = F.explode(F.array(_entry(F.col("m"), F.col("head") + half, F.col("tail")), _entry(F.col("m"), F.col("head"), F.col("tail") + rest - half)))
    return entries.select("word", "n", each.alias("e")).select("word", "n", "e.*")


class Acceptor:
    """The minimal acceptor of strings of one length: states of one table, equal rests the same state."""

    def __init__(self, strings: list[str], arcs: list[dict[str, int]], register: dict[tuple, int]):
        """`arcs` and `register` may be shared, so that equal rests of two acceptors are one state; state 0 accepts."""
        strings = sorted(strings)
        path: list[list[tuple[str, int]]] = [[] for _ in range(len(strings[0]) + 1)]

        def close(depth: int, upto: int, last: str) -> None:
            for d in range(depth, upto, -1):
                state = 0 if d == len(last) else self._state(path[d], arcs, register)
                path[d] = []
                path[d - 1].append((last[d - 1], state))

        last = strings[0]
        for s in strings[1:]:
            same = 0
            while s[same] == last[same]:
                same += 1
            close(len(last), same, last)
            last = s
        close(len(last), 0, last)
        self.start = self._state(path[0], arcs, register) if last else 0

    @staticmethod
    def _state(out: list[tuple[str, int]], arcs: list[dict[str, int]], register: dict[tuple, int]) -> int:
        key = tuple(out)
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            arcs.append(dict(out))
        return state


def near_pairs(short: list[str], long: list[str], at_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs with exactly one replaced code point among `short`, and one inserted between `short` and `long`.

    All of `short` have one length and all of `long` one more. Of an insertion
    into a run of equal code points, the last place counts; with `at_end` it may
    be the end. Each pair comes once.
    """
    arcs: list[dict[str, int]] = [{}]
    register: dict[tuple, int] = {}
    rest_of: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        """The rests that both states accept."""
        if p > q:
            p, q = q, p
        found = rest_of.get((p, q))
        if found is None:
            if q == 0:
                found = [""]
            else:
                mine, other = arcs[p], arcs[q]
                found = [label + rest for label, to in mine.items() if label in other for rest in common(to, other[label])]
            rest_of[p, q] = found
        return found

    a = Acceptor(short, arcs, register)
    b = Acceptor(long, arcs, register) if long else None
    # The composed machine before its edit: what both have read, and their states.
    todo = [("", a.start, b.start if b else -1)]
    while todo:
        read, p, q = todo.pop()
        out = list(arcs[p].items())
        for i, (x, to) in enumerate(out):
            for y, to_other in out[i + 1:]:
                for rest in common(to, to_other):
                    yield read + x + rest, read + y + rest
        inserted = arcs[q] if q > 0 else {}
        for x, to in inserted.items():
            if p == 0:
                if at_end and to == 0:
                    yield read, read + x
                continue
            for label, after in arcs[p].items():
                if label != x and label in arcs[to]:
                    for rest in common(after, arcs[to][label]):
                        yield read + label + rest, read + x + label + rest
        for x, to in out:
            todo.append((read + x, to, inserted.get(x, -1)))


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, and n and word of the best near one, of the partitions of sorted entries."""
    held: dict[tuple, dict[str, int]] = {}
    key, result = None, ([], [], [], [])

    def out() -> Iterator[pa.RecordBatch]:
        for (m, head, tail, _, _), words in held.items():
            rests: dict[str, str] = {w[head: len(w) - tail]: w for w in words}
            short = [r for r, w in rests.items() if len(w) == m]
            if not short or len(words) < 2:
                continue
            near: dict[str, list] = {}
            for u, v in near_pairs(short, [r for r, w in rests.items() if len(w) > m], tail == 0):
                for one, other in ((rests[u], rests[v]), (rests[v], rests[u])):
                    best = (-words[other], other)
                    found = near.get(one)
                    if found is None:
                        near[one] = [1, best]
                    else:
                        found[0] += 1
                        found[1] = min(found[1], best)
            for word, (count, (n, best)) in near.items():
                for column, value in zip(result, (word, count, -n, best)):
                    column.append(value)
        if len(result[0]) >= 10_000:
            yield batch()

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(result[0], pa.string()), pa.array(result[1], pa.int64()), pa.array(result[2], pa.int64()), pa.array(result[3], pa.string())],
            names=["word", "n_near", "best_n", "best"])
        for column in result:
            column.clear()
        return made

    for part in batches:
        columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("key", "m", "head", "tail", "word", "n")]
        for k, m, head, tail, word, n in zip(*columns):
            if k != key:
                yield from out()
                key, held = k, {}
            # Partitions whose hashes agree are told apart by what is shared.
            held.setdefault((m, head, tail, word[:head], word[len(word) - tail:]), {})[word] = n
    yield from out()
    if result[0]:
        yield batch()


def near_words(words: DataFrame, *, min_length: int = MIN_LENGTH, max_words: int = MAX_WORDS, max_rest: int = MAX_REST) -> DataFrame:
    """word, n_near, best_n and best (the most frequent near word) of the words(word, n) that have a near one."""
    rest = F.col("m") - F.col("head") - F.col("tail")
    entries, parts = _entries(words, min_length), []
    while entries is not None:
        entries = materialize(entries)
        sizes = entries.groupBy("key", rest.alias("rest")).agg(F.count("*").alias("size")).filter("size > 1")
        sizes = materialize(sizes.withColumn("large", (F.col("rest") > 1) & ((F.col("size") > max_words) | (F.col("rest") > max_rest))))
        parts.append(entries.join(sizes.filter("NOT large").select("key").distinct(), "key", "left_semi"))
        large = sizes.filter("large").select("key").distinct()
        entries = _divided(entries.join(large, "key", "left_semi")) if large.limit(1).count() else None
    found = None
    for part in parts:
        dealt = part.repartition("key").sortWithinPartitions("key")
        near = dealt.select("key", "m", "head", "tail", "word", "n").mapInArrow(_near_words, "word string, n_near bigint, best_n bigint, best string")
        found = near if found is None else found.union(near)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of forms(word, form): the last form that a word's forms lead to. Forms grow in frequency, so they end."""
    roots = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialize(roots.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if not step.filter("moved").limit(1).count():
            return step.select("word", "root")
        roots = step.select("word", "root")


def spelling_variants(words: DataFrame, *, min_length: int = MIN_LENGTH, ratio: int = RATIO, max_words: int = MAX_WORDS, max_rest: int = MAX_REST) -> DataFrame:
    """Every word of words(word, n) with form, root, n, n_near and form_n.

    The form is the most frequent near word if it is at least `ratio` times as frequent.
    """
    words = materialize(words.select("word", "n"))
    near = near_words(words, min_length=min_length, max_words=max_words, max_rest=max_rest)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ))
    roots = _roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
