"""URL filters: rules on host and path, and exact membership of listed keys by a cascade of Bloom filters.

Columns only. A page asks for two keys, its host and its host with path. The
distinct keys of all pages are the complete universe of questions, so a filter
of the listed keys, a filter of the other keys that pass it, a filter of the
listed keys that pass that one, and so on, end at a level that nothing passes
wrongly: the chain then answers every key of the universe exactly. The filters
reach the rows as scalar subqueries, so that pages are neither joined nor
shuffled.

Defined results: a null URL, or one without `://`, has an empty host and path,
fits no rule and is listed only if the empty key is. Null keys in the list are
ignored, repeated ones count once. An empty list lists nothing; no pages give no
rows. Other columns of the pages stay as they are, whatever their names; the
result's columns replace those of the same name.
"""

from __future__ import annotations

import math
import string
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.storage import materialize

# Name parts that list a host in the query; fixed values.
BLOCKED_WORDS = ("ads", "adult", "bet", "bets", "casino", "pills", "porn", "spam", "xxx")

# DNS names have 127 labels at most, so a listed parent domain is not looked for beyond them.
MAX_LABELS = 127

# The share of other keys that a level after the first lets pass.
LATER_PASS = 1 / 16


@dataclass(frozen=True)
class Rule:
    """What becomes of the URLs of a host and its subdomains whose path begins so."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a URL; both empty if it is null or has no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does; of equals the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def with_parents(host: Column) -> Column:
    """A host and the domains above it."""
    parts = F.split(host, r"\.")
    n = F.least(F.size(parts), F.lit(MAX_LABELS))
    parents = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    return F.array_distinct(F.concat(F.array(host), parents))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words in a table of one row, their number, and the hash functions."""

    words: DataFrame
    n_bits: int
    n_hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        first, second = (F.pmod(F.xxhash64(key, F.lit(2 * self.seed + i)), F.lit(self.n_bits)) for i in (0, 1))
        return [F.pmod(first + second * i, F.lit(self.n_bits)) for i in range(self.n_hashes)]

    def passes(self, key: Column, words: Column) -> Column:
        test = F.lit(True)
        for at in self.positions(key):
            test = test & (F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), (at % 64).cast("int")) == 1)
        return test


def _level(keys: DataFrame, n: int, share: float, seed: int) -> Level:
    """A filter of `n` keys that lets about `share` of other keys pass."""
    n_hashes = max(1, round(math.log2(1 / share)))
    n_words = max(1, math.ceil(n * n_hashes / math.log(2) / 64))
    shape = Level(keys, 64 * n_words, n_hashes, seed)
    bits = keys.select(F.explode(F.array(*shape.positions(F.col("key")))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = bits.select(F.shiftright("at", 6).alias("no"), one.alias("word"))
    words = words.union(keys.sparkSession.range(n_words).select("id", F.lit(0).cast("bigint")))
    words = words.groupBy("no").agg(F.bit_or("word").alias("word"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "word"))), lambda w: w["word"]).alias("words"))
    return Level(materialize(row), shape.n_bits, n_hashes, seed)


def _with_test(rows: DataFrame, name: str, keys: Sequence[Column], levels: Sequence[Level], test) -> DataFrame:
    """The rows with a new column, what `test` makes of the levels' words and the keys.

    A subquery may not stand inside a function with a lambda, so it is a column
    that is used once; the optimizer puts the subquery in its place, and no row
    carries the filters (a test looks at the plan). The keys are worked out once a row.
    """
    held = f"held_{uuid.uuid4().hex}"
    words = F.array(*[level.words.scalar() for level in levels])
    given = F.array(F.struct(F.col(held).alias("words"), F.array(*keys).alias("keys")))
    tested = F.transform(given, lambda x: test(x["words"], [F.element_at(x["keys"], i + 1) for i in range(len(keys))]))
    return rows.withColumn(held, words).withColumn(name, F.element_at(tested, 1)).drop(held)


def build_cascade(keys: DataFrame) -> list[Level]:
    """The levels for keys(key, listed), all keys that will ever be asked for; none if nothing is listed."""
    sides = [keys.filter("listed").select("key"), keys.filter("NOT listed").select("key")]
    counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n, n_other, levels = counts.get(True, 0), counts.get(False, 0), []
    while n:
        share = min(0.5, max(2.0**-30, math.sqrt(0.5) * n / max(n_other, 1))) if not levels else LATER_PASS
        level = _level(sides[0], n, share, len(levels))
        passed = _with_test(sides[1], "passes", [F.col("key")], [level], lambda w, k, level=level: level.passes(k[0], F.element_at(w, 1)))
        sides = [materialize(passed.filter("passes").select("key")), sides[0]]
        levels.append(level)
        n = sides[0].count()
    return levels


def with_listed(rows: DataFrame, name: str, keys: Sequence[Column], levels: Sequence[Level], mine=lambda key: F.lit(True)) -> DataFrame:
    """The rows with a new column, whether one of the keys is listed, for keys of the universe the levels were built over.

    `mine` says of a key whether the levels hold its answer.
    """
    if not levels:
        return rows.withColumn(name, F.lit(False))

    def holds(words: Column, keys: Sequence[Column]) -> Column:
        found = F.lit(False)
        for key in keys:
            member = F.lit(False)
            for no in reversed(range(len(levels))):
                member = levels[no].passes(key, F.element_at(words, no + 1)) & ~member
            found = found | (mine(key) & member)
        return found

    return _with_test(rows, name, keys, levels, holds)


def _universe(pages: DataFrame, listed: DataFrame, host: Column, path: Column) -> DataFrame:
    """key and listed of every key the pages ask for; a host is listed with its parents, a URL by itself."""
    asked = pages.select(F.explode(F.array_distinct(F.array(host, F.concat(host, path)))).alias("key")).distinct()
    asked = materialize(asked)
    parents = F.when(F.col("key").contains("/"), F.array("key")).otherwise(with_parents(F.col("key")))
    looked_up = asked.select("key", F.explode(parents).alias("name"))
    names = listed.select(F.col(listed.columns[0]).alias("name")).filter("name IS NOT NULL").distinct()
    found = looked_up.join(names, "name", "left_semi").select("key", F.lit(True).alias("listed"))
    marked = asked.select("key", F.lit(False).alias("listed")).union(found)
    return materialize(marked.groupBy("key").agg(F.max("listed").alias("listed")))


def url_verdicts(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, *, url_col: str = "url", max_bytes: int = 32 << 20,
) -> DataFrame:
    """The pages with host, path, rule, listed and verdict: the rule's, else block for listed keys, else allow.

    `listed` has the keys in its first column: a host, which lists its subdomains
    too, or a host with path, which lists that URL only. Filters of more than
    about `max_bytes` are dealt into shards of the keys, asked one after another
    over a written table of the pages; so tasks and driver hold no more than that.
    """
    host, path = host_and_path(F.col(url_col))
    universe = _universe(pages, listed, host, path)
    n, n_listed = universe.agg(F.count("*"), F.count_if("listed")).first()
    bits = n_listed * (4 + 1.5 * math.log2(max(2, 2 * n / max(1, n_listed))))
    shards = max(1, math.ceil(bits / 8 / max_bytes))
    hit = f"hit_{uuid.uuid4().hex}"
    held = pages.withColumn(hit, F.lit(False))
    for no in range(shards):
        mine = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)) == no if shards > 1 else F.lit(True)  # noqa: E731, B023
        levels, now = build_cascade(universe.filter(mine(F.col("key")))), f"now_{uuid.uuid4().hex}"
        held = with_listed(held, now, [host, F.concat(host, path)], levels, mine).withColumn(hit, F.col(hit) | F.col(now)).drop(now)
        if no < shards - 1:
            held = materialize(held)
    name, verdict = rule_columns(host, path, rules)
    judged = F.coalesce(verdict, F.when(F.col(hit), "block").otherwise("allow"))
    return held.withColumns({"host": host, "path": path, "rule": name, "listed": F.col(hit), "verdict": judged}).drop(hit)


def listed_by_words(pages: DataFrame, words: Sequence[str] = BLOCKED_WORDS, url_col: str = "url") -> DataFrame:
    """key: the pages' hosts of which a part of the name, between dots and hyphens, is one of the words."""
    hosts = pages.select(host_and_path(F.col(url_col))[0].alias("key")).distinct()
    return hosts.filter(F.arrays_overlap(F.split("key", "[.-]"), F.array(*map(F.lit, words))))
