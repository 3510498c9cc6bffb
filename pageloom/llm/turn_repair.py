"""Repair of the structure of conversations by the cheapest edits, found by divide and conquer in linear space.

A conversation's roles should read as an optional system turn and then pairs of
user and assistant. Four states say what has been read: nothing, a system turn,
a user turn, an assistant turn. Rows are kept (free), given another role,
deleted, and empty rows are inserted; `COST` has the prices. Of the cheapest
edits those whose initials are least in ASCII order are taken.

A row, and likewise any run of rows, is a four-by-four table: the least cost
from a state before it to a state after it, and for each state before it the
order of the least edits to the four states after it. Edits of one run to
different states are never prefixes of each other, so the order of two joined
runs follows from the orders of the parts. A run is solved by a forward vector
of its first half and a backward vector of its second: they meet in the middle,
the least of the optimal crossings is taken and both halves are solved alike.
That holds one vector and the states passed, never a table of rows by states.

On Spark, rows are put in order by range partitions and numbered, runs of at
most `2 ** RUN_BITS` rows become tables, tables are joined up a tree with
`2 ** TREE_BITS` children each until a conversation has one, and the states are
handed down again; so no task holds a conversation, however long. Only a digest
over a whole conversation reads it in one task, in order and in bounded memory.

Defined results: null texts, roles, turns and ids count as one blank where a
string is needed; null turns come first; rows of one turn are ordered by role
and text; a row with an empty role has no initial that can be kept. Null ids are
one conversation. Other columns of the input are not carried. No rows give none.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from pageloom.llm.common import text_slices
from pageloom.operators.storage import materialize

BLANKS = " \t\n\x0b\x0c\r"
RUN_BITS, TREE_BITS = 12, 8

# The edits: D delete, K keep, U and A another role, u and a an inserted row.
COST = {"D": 2, "K": 0, "U": 1, "A": 1, "u": 5, "a": 5}
TRUNCATED_COST = 5
INITIAL = str.maketrans("UAua", "RRII")

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
NO_WAY = 1 << 60
STATES = range(4)
# By state: what may be inserted, or another role be, and the state after it.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
# By initial of a kept row: the states before it, and the state after it.
KEPT = {"s": ((0,), 1), "u": ((0, 1, 3), 2), "a": ((2,), 3)}
# What must be inserted at the end of a conversation, by state.
TAIL = {0: "", 1: "ua", 2: "a", 3: ""}


def letters(edits: str) -> str:
    """The audit of edits: initials of Delete, Insert, Keep, Rerole."""
    return edits.translate(INITIAL)


def price(edits: str, truncated: bool) -> int:
    return sum(COST[e] for e in edits) + (TRUNCATED_COST if truncated and edits[-1:] != "D" else 0)


def _row_edits(kind: int) -> list[list[str | None]]:
    """The least edits of a row, with what is inserted before it, from state to state; kind 0 must be deleted."""
    truncated, initial = kind > 4, "sua?"[(kind - 1) % 4]
    found: list[list[str | None]] = [[None] * 4 for _ in STATES]
    for start in STATES:
        before, at = "", start
        for _ in range(3):
            ways = [("D", at)]
            if kind:
                ways.append((NEXT[at][0].upper(), NEXT[at][1]))
                if at in KEPT.get(initial, ((), 0))[0]:
                    ways.append(("K", KEPT[initial][1]))
            for edit, end in ways:
                old, new = found[start][end], before + edit
                if old is None or (price(new, truncated), letters(new)) < (price(old, truncated), letters(old)):
                    found[start][end] = new
            before, at = before + NEXT[at][0], NEXT[at][1]
    return found


def _order(keys: Sequence) -> list[int]:
    by = sorted(STATES, key=lambda b: keys[b])
    return [by.index(b) for b in STATES]


def _row_table(kind: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    edits, costs, orders = EDITS[kind], [], []
    for start in STATES:
        costs += [NO_WAY if e is None else price(e, kind > 4) for e in edits[start]]
        orders += _order([(e is None, letters(e or "")) for e in edits[start]])
    return tuple(costs), tuple(orders)


EDITS = [_row_edits(kind) for kind in range(9)]
# A table is the costs and the orders, each of 4 x 4 numbers.
Table = tuple[tuple[int, ...], tuple[int, ...]]
ROWS: list[Table] = [_row_table(kind) for kind in range(9)]


@functools.lru_cache(maxsize=1 << 16)
def _forward(costs: tuple[int, ...], order: tuple[int, ...], table: Table) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """A forward vector one table on; its least cost is taken off and given apart, so that vectors repeat."""
    to, orders = table
    new, came = [], []
    for b in STATES:
        a = min(STATES, key=lambda a: (costs[a] + to[4 * a + b], order[a]))
        total = costs[a] + to[4 * a + b]
        new.append(min(total, NO_WAY))
        came.append((total >= NO_WAY, order[a], orders[4 * a + b]))
    least = min(new)
    return least, tuple(c if c >= NO_WAY else c - least for c in new), tuple(_order(came))


@functools.lru_cache(maxsize=1 << 16)
def _backward(costs: tuple[int, ...], table: Table) -> tuple[int, tuple[int, ...]]:
    to = table[0]
    new = [min(NO_WAY, *(to[4 * a + b] + costs[b] for b in STATES)) for a in STATES]
    least = min(new)
    return least, tuple(c if c >= NO_WAY else c - least for c in new)


def _start(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NO_WAY for s in STATES)


def forward(tables: Sequence[Table], lo: int, hi: int, state: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Costs (less a base) from a state to every state, and the order of the edits."""
    base, costs, order = 0, _start(state), (0, 1, 2, 3)
    for i in range(lo, hi):
        least, costs, order = _forward(costs, order, tables[i])
        base += least
    return base, costs, order


def backward(tables: Sequence[Table], lo: int, hi: int, state: int) -> tuple[int, ...]:
    costs = _start(state)
    for i in range(hi - 1, lo - 1, -1):
        _, costs = _backward(costs, tables[i])
    return costs


def joined(tables: Sequence[Table]) -> Table:
    """The table of a run of tables."""
    costs, orders = [], []
    for state in STATES:
        base, ends, order = forward(tables, 0, len(tables), state)
        costs += [c if c >= NO_WAY else c + base for c in ends]
        orders += order
    return tuple(costs), tuple(orders)


def last_state(table: Table) -> int:
    """Where the cheapest and then least edits of a whole conversation end, before what is inserted at the end."""
    return min(STATES, key=lambda b: (table[0][b] + price(TAIL[b], False), table[1][b]))


def crossings(tables: Sequence[Table], start: int, end: int) -> list[int]:
    """The states after each table on the least optimal way from one state to another."""
    passed = [end] * len(tables)
    spans = [(0, len(tables), start, end)]
    while spans:
        lo, hi, a, b = spans.pop()
        if hi - lo < 2:
            continue
        middle = (lo + hi) // 2
        _, costs, order = forward(tables, lo, middle, a)
        rest = backward(tables, middle, hi, b)
        state = min(STATES, key=lambda s: (costs[s] + rest[s], order[s]))
        passed[middle - 1] = state
        spans += [(lo, middle, a, state), (middle, hi, state, b)]
    return passed


def edits_of(kinds: Sequence[int], start: int, end: int) -> list[str]:
    """The edits of each row of a run."""
    states = [start, *crossings([ROWS[k] for k in kinds], start, end)]
    return [EDITS[k][a][b] for k, a, b in zip(kinds, states, states[1:])]


def ordered_rows(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role and text with `place`, which rises in the order of the rows within a conversation.

    Range partitions put the order over tasks, so a long conversation is spread;
    the places are written, since a second reckoning might deal rows otherwise.
    """
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    # The start of a text deals out the rows of one turn; within a partition whole texts are compared.
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    return materialize(rows.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id()))


def _last_mark(text: Column) -> Column:
    """The last character that is not blank; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def with_faults(rows: DataFrame) -> DataFrame:
    """Ordered rows with their first fault and their kind, 0 for those that must be deleted."""
    text = F.sha2(F.col("text"), 256)
    firsts = rows.groupBy("conv_id", "role", text.alias("hash")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "hash", "first")
    same = rows["conv_id"].eqNullSafe(F.col("c")) & (rows["role"] == F.col("r")) & (text == F.col("hash"))
    mark = _last_mark(F.col("text"))
    fault = (
        F.when(mark == "", BLANK).when(F.col("place") > F.col("first"), DUPLICATE)
        .when(~mark.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    )
    initial = F.left("role", F.lit(1))
    by_initial = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    kind = F.when(F.col("fault").isin(BLANK, DUPLICATE), 0).when(F.col("fault") == TRUNCATED, by_initial + 4).otherwise(by_initial)
    found = rows.join(firsts, same, "left").withColumn("fault", fault).withColumn("kind", kind)
    return found.select("conv_id", "place", "turn", "role", "text", "fault", "kind")


# Types as objects: workers import this module without a session that could read a schema.
NODE = ArrayType(LongType())


def _packed(table: Table) -> list[int]:
    return [*table[0], *table[1]]


def _table(packed: Sequence[int]) -> Table:
    return tuple(map(int, packed[:16])), tuple(map(int, packed[16:]))


@F.pandas_udf(NODE)
def _run_table(kinds: pd.Series) -> pd.Series:
    return kinds.map(lambda ks: _packed(joined([ROWS[k] for k in ks])))


@F.pandas_udf(NODE)
def _joined_table(nodes: pd.Series) -> pd.Series:
    return nodes.map(lambda ns: _packed(joined([_table(n) for n in ns])))


@F.pandas_udf(LongType())
def _last_state(node: pd.Series) -> pd.Series:
    return node.map(lambda n: last_state(_table(n)))


@F.pandas_udf(NODE)
def _crossings(nodes: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([crossings([_table(n) for n in ns], int(a), int(b)) for ns, a, b in zip(nodes, start, end)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _edits(kinds: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([edits_of([int(k) for k in ks], int(a), int(b)) for ks, a, b in zip(kinds, start, end)], dtype=object)


def _runs_with_states(rows: DataFrame, run_bits: int, tree_bits: int) -> DataFrame:
    """Runs of rows (conv_id, run, first place, kinds) with the states before and after, and whether they end a conversation."""
    run = F.shiftright("place", run_bits)
    runs = rows.groupBy("conv_id", run.alias("run")).agg(
        F.min("place").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda r: r["kind"]).alias("kinds"),
    )
    runs = materialize(runs.withColumn("node", _run_table("kinds")))
    level, levels = runs.select("conv_id", F.col("run").alias("at"), "node"), []
    while level.groupBy("conv_id").count().filter("count > 1").limit(1).count():
        up = level.groupBy("conv_id", F.shiftright("at", tree_bits).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("children"))
        up = materialize(up.withColumn("node", _joined_table(F.col("children")["node"])))
        levels.append(up)
        level = up.select("conv_id", F.col("parent").alias("at"), "node")
    known = level.select("conv_id", "at", F.lit(0).cast("bigint").alias("start"), _last_state("node").alias("end"), F.lit(True).alias("is_last"))
    for up in reversed(levels):
        held = up.join(known.withColumnsRenamed({"conv_id": "c", "at": "parent_at"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("parent_at")))
        passed = held.withColumn("passed", _crossings(F.col("children")["node"], "start", "end"))
        n = F.size("children")
        child = F.transform("children", lambda child, i: F.struct(
            child["at"].alias("at"), F.when(i == 0, F.col("start")).otherwise(F.get("passed", i - 1)).alias("start"),
            F.get("passed", i).alias("end"), (F.col("is_last") & (i == n - 1)).alias("is_last")))
        known = materialize(passed.select("conv_id", F.explode(child).alias("child")).select("conv_id", "child.*"))
    known = known.withColumnsRenamed({"conv_id": "c", "at": "run_at"})
    return runs.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("run_at"))).drop("c", "run_at", "node")


def repair_turns(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    run_bits: int = RUN_BITS, tree_bits: int = TREE_BITS,
) -> DataFrame:
    """Every row with place, turn, role, text, fault and the edits that repair its conversation.

    `edits` has a letter for each row inserted before it (u, a), then its own (D, K, U, A),
    then, at the end of a conversation, those inserted after it.
    """
    rows = materialize(with_faults(ordered_rows(turns, id_col, turn_col, role_col, text_col)))
    runs = _runs_with_states(rows, run_bits, tree_bits)
    tail = F.when(F.col("is_last"), F.element_at(F.array(*[F.lit(TAIL[s]) for s in STATES]), F.col("end").cast("int") + 1)).otherwise("")
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "first", _edits("kinds", "start", "end").alias("each"), tail.alias("tail"))
    held = rows.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("place", run_bits) == F.col("r")))
    at = (F.col("place") - F.col("first")).cast("int")
    edits = F.concat(F.get("each", at), F.when(at == F.size("each") - 1, F.col("tail")).otherwise(""))
    return held.withColumn("edits", edits).select("conv_id", "place", "turn", "role", "text", "fault", "edits")


def _new_rows(edits: Column) -> Column:
    """role and text of what a row becomes, in order; the text is null where it stays the row's own."""
    one = F.split(edits, "")

    def row(edit: Column) -> Column:
        role = F.when(edit == "K", F.col("role")).when(edit.isin("u", "U"), "user").otherwise("assistant")
        return F.struct(role.alias("role"), F.when(edit.isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    return F.transform(F.filter(one, lambda e: (e != "D") & (e != "")), row)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place and part (their order), role, text."""
    new = repaired.select("conv_id", "place", F.posexplode(_new_rows(F.col("edits"))).alias("part", "row"))
    return new.select("conv_id", "place", "part", "row.role", "row.text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of ordered rows; a conversation is read on from batch to batch."""
    held: dict | None = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "conv_id": held["conv_id"], "gaps": held["last"] - held["least"] + 1 - held["turns"] if held["turns"] else 0,
            "blank": held["faults"][BLANK], "duplicate": held["faults"][DUPLICATE], "truncated": held["faults"][TRUNCATED],
            "illegal": held["illegal"], "cost": held["cost"], "audit": "".join(held["audit"]), "repaired_sha256": held["sha"].hexdigest(),
        }], schema=schema)

    schema = None
    for batch in batches:
        for part in text_slices(iter([batch]), batch.schema.get_field_index("lines")):
            schema = schema or pa.schema([
                ("conv_id", part.schema.field("conv_id").type), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                ("audit", pa.string()), ("repaired_sha256", pa.string()),
            ])
            for r in part.to_pylist():
                if held is None or held["conv_id"] != r["conv_id"]:
                    if held:
                        yield out()
                    held = {"conv_id": r["conv_id"], "least": None, "last": None, "turns": 0, "faults": [0] * 4, "illegal": 0, "cost": 0,
                            "audit": [], "sha": hashlib.sha256(), "initial": None, "started": False}
                if r["turn"] is not None and r["turn"] != held["last"]:
                    held["least"] = r["turn"] if held["least"] is None else held["least"]
                    held["last"], held["turns"] = r["turn"], held["turns"] + 1
                held["faults"][r["fault"]] += 1
                if held["initial"] is not None and held["initial"] + r["initial"] not in ("su", "ua", "au"):
                    held["illegal"] += 1
                held["initial"] = r["initial"]
                tail = len(r["edits"].rstrip("ua"))
                held["cost"] += price(r["edits"][:tail], r["fault"] == TRUNCATED) + price(r["edits"][tail:], False)
                held["audit"].append(letters(r["edits"]))
                if r["lines"] is not None:
                    held["sha"].update(("\n" * held["started"] + r["lines"]).encode())
                    held["started"] = True
    if held:
        yield out()


def repair_digests(repaired: DataFrame) -> DataFrame:
    """gaps, counts of faults and illegal neighbours, cost, audit and digest of every repaired conversation."""
    line = F.transform(_new_rows(F.col("edits")), lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    rows = repaired.select(
        "conv_id", "place", F.col("turn").cast("bigint").alias("turn"), F.left("role", F.lit(1)).alias("initial"), "fault", "edits",
        F.when(F.size(line) > 0, F.array_join(line, "\n")).alias("lines"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        _digests, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32 of `conv_id:turn`, modulo 20; for measuring repairs.

    0 drops a row, 1 empties its text, 2 removes `.!?` from it, 3 repeats the row, 4 makes it a user's.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    how = F.crc32(F.encode(name, "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), how.alias("how"))
    rows = rows.filter("how <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def repair_summary(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """Digests of the repaired `rows` for every conversation of `turns`; one without rows has zeros and empty strings."""
    found = repair_digests(repair_turns(rows)).withColumnRenamed("conv_id", "c")
    ids = turns.select("conv_id").distinct()
    joined_ = ids.join(found, ids["conv_id"].eqNullSafe(found["c"]), "left")
    numbers = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined_.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
