"""Conversation repair against a plain table of costs and strings, with odd rows and runs of a few rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pageloom.llm import queries, turn_repair

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_audit(rows):
    """(cost, audit, repaired lines) of (role, text, fault) by the whole table, from the end; all inserts up to three in a row."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = [dict() for _ in range(len(rows) + 1)]
    best[len(rows)] = {0: (0, "", []), 3: (0, "", [])}

    def insert(known):
        for _ in range(3):
            for q in range(4):
                for role in ("user", "assistant"):
                    to = step.get((q, role[0]))
                    if to in known:
                        cost, audit, lines = known[to]
                        new = (cost + 5, "I" + audit, [role + ":"] + lines)
                        known[q] = min(known.get(q, new), new, key=lambda x: x[:2])

    insert(best[len(rows)])
    for i in range(len(rows) - 1, -1, -1):
        role, text, fault = rows[i]
        known, after = best[i], best[i + 1]
        for q in range(4):
            ways = []
            if q in after:
                cost, audit, lines = after[q]
                ways.append((cost + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for new_role, cost0, letter in [(role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")]:
                    to = step.get((q, new_role[:1]))
                    if to in after:
                        cost, audit, lines = after[to]
                        ways.append((cost + cost0 + extra, letter + audit, [f"{new_role}:{text}"] + lines))
            if ways:
                known[q] = min(ways, key=lambda x: x[:2])
        insert(known)
    return best[0][0]


def plain(turns):
    """The contract of op11, row by row."""
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        rows += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            stripped = text.rstrip(BLANKS)
            faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "none")
            seen.add((role, text))
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = plain_audit([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        assert LEGAL.fullmatch("".join(line[0] for line in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def known(row):
    return tuple((x is not None, x) for x in row)


def compare(df, turns):
    assert sorted(map(known, df.select(*COLUMNS).collect())) == sorted(map(known, plain(turns)))


def test_query_against_plain_version(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op11_turn_repair(spark, sf), turns)


def random_turns(seed, convs, rows):
    rng = random.Random(seed)
    texts = ["", " \n", "yes.", "no!", "cut off", "why?  ", "done.\x0b", "é.", None, "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "unknown", None]
    found = []
    for conv in range(convs):
        numbers = [None if rng.random() < 0.03 else n + rng.choice([0, 0, 0, 3]) for n in range(rng.randint(0, rows))]
        found += [(None if conv == 1 else conv, n, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.") for n in numbers]
    rng.shuffle(found)
    return found


def test_odd_rows(spark):
    turns = random_turns(7, 60, 14)
    df = spark.createDataFrame([(*r, "x", 1) for r in turns], SCHEMA + ", edits string, place int")
    compare(turn_repair.repair_summary(df, turn_repair.damaged(df)), turns)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair_summary(none, turn_repair.damaged(none)).count() == 0


@pytest.mark.parametrize("run_bits, tree_bits", [(1, 1), (2, 2), (3, 1)])
def test_runs_of_few_rows_make_no_difference(spark, run_bits, tree_bits):
    turns = random_turns(3, 6, 60)
    df = turn_repair.damaged(spark.createDataFrame(turns, SCHEMA))
    whole = turn_repair.repair_digests(turn_repair.repair_turns(df)).collect()
    parts = turn_repair.repair_digests(turn_repair.repair_turns(df, run_bits=run_bits, tree_bits=tree_bits)).collect()
    assert len(whole) == 6 and sorted(map(known, whole)) == sorted(map(known, parts))


def test_crossings_of_many_kinds():
    rng = random.Random(5)
    faults = {0: "blank", **{k: "none" if k < 5 else "truncated" for k in range(1, 9)}}
    for n in [*range(8)] * 40 + [40] * 30:
        kinds = [rng.randrange(9) for _ in range(n)]
        rows = [(("system", "user", "assistant", "tool")[(k - 1) % 4], "x", faults[k]) for k in kinds]
        table = turn_repair.joined([turn_repair.ROWS[k] for k in kinds])
        end = turn_repair.last_state(table)
        edits = turn_repair.edits_of(kinds, 0, end)
        audit = "".join(map(turn_repair.letters, edits)) + turn_repair.letters(turn_repair.TAIL[end])
        cost, expected, _ = plain_audit(rows)
        assert audit == expected
        assert cost == sum(turn_repair.price(e, k > 4) for e, k in zip(edits, kinds)) + turn_repair.price(turn_repair.TAIL[end], False)


def test_repaired_turns_are_rows(spark):
    turns = [(1, 0, "user", "hi."), (1, 1, "user", "again."), (1, 2, "assistant", "yes."), (2, 0, "assistant", "alone.")]
    df = spark.createDataFrame(turns, SCHEMA)
    found = turn_repair.repaired_turns(turn_repair.repair_turns(df)).orderBy("conv_id", "place", "part").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in found] == [(1, "user", "again."), (1, "assistant", "yes.")]


def test_long_conversation(spark):
    """One conversation with most rows: it is spread over runs, and equal texts are not gathered."""
    df = spark.range(20_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 3 == 0, F.lit("same.")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit("."))).alias("text"),
    )
    rows = [tuple(r) for r in df.collect()]
    compare(turn_repair.repair_summary(df, turn_repair.damaged(df)), rows)
