"""Role repair and rendering of conversations.

A repaired conversation is one optional system turn, then user and assistant in alternation, ending with the assistant.
Each source turn is emitted under a role (another one than its own is a relabel) as a turn of its own or merged into the
turn before; empty turns are inserted where two roles can't follow each other. Dynamic programming over the automaton of
legal turns finds the cheapest repair.

One turn's moves are a min-plus matrix over the automaton's states, and matrices compose: long conversations are cut
into chunks of ``CHUNK`` rows, whose matrices are combined level by level; then the states at the chunks' edges are
settled from the top down, and each chunk is repaired on its own. Rows are numbered in one sort over all conversations,
whose ranges cut conversations, equal turn numbers and equal rows anywhere. No task holds a whole long conversation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.plans.lineage import materialize

from .batches import map_arrow
from .registry import query, table

ROLES = ("system", "user", "assistant")
#: States: the role of the last turn, or nothing yet.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Naming an unknown role, merging, inserting an empty turn, giving a turn another role than its own.
NAME, MERGE, INSERT, RELABEL = 1, 2, 5, 8
INF = 1 << 40
CHUNK, FAN = 64, 64
#: Empty turns that lead from a state to the state before a role may follow.
FILL = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER], (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, ASSISTANT): [], (USER, USER): [ASSISTANT], (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER],
}
#: Empty turns that end a conversation.
END = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def options(role: str | None) -> list[tuple[int, int, int, bool]]:
    """(state before, state after, cost, merged) of one source turn; the first of equal costs is taken."""
    out = []
    for target in (SYSTEM, USER, ASSISTANT):
        cost = NAME if role is None else 0 if role == ROLES[target - 1] else RELABEL
        for state in range(4):
            if state == target:
                out.append((state, target, cost + MERGE, True))
            if (state, target) in FILL:
                out.append((state, target, cost + INSERT * len(FILL[state, target]), False))
    return out


OPTIONS = {r: options(r) for r in (*ROLES, None)}


def known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def turn_matrix(role: str | None) -> list[int]:
    m = [INF] * 16
    for s, t, cost, _ in OPTIONS[known(role)]:
        m[4 * s + t] = min(m[4 * s + t], cost)
    return m


def product(a: list[int], b: list[int]) -> list[int]:
    return [min(a[4 * i + k] + b[4 * k + j] for k in range(4)) for i in range(4) for j in range(4)]


def through(matrices: list[list[int]], entry: int, leave: int | None) -> list[int]:
    """States after each matrix on a cheapest way from ``entry``; ``leave`` None: with the cost of ending."""
    cost, back = [0 if s == entry else INF for s in range(4)], []
    for m in matrices:
        best = [min((cost[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
        cost = [min(c, INF) for c, _ in best]
        back.append([s for _, s in best])
    state = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + INSERT * len(END[s]), s))
    out = []
    for step in reversed(back):
        out.append(state)
        state = step[state]
    return out[::-1]


def repair(turns: list[tuple[str | None, str | None]], entry: int, leave: int) -> tuple[list[tuple[int, str, bool]], dict[str, int]]:
    """Turns (state, text, continues the turn before) from ``entry`` to ``leave`` and what was changed."""
    made: list[tuple[int, str, bool]] = []
    n = {"cost": 0, "merged": 0, "relabeled": 0, "inserted": 0}
    state = entry
    for (role, text), target in zip(turns, through([turn_matrix(r) for r, _ in turns], entry, leave), strict=True):
        _, _, cost, merged = min((o for o in OPTIONS[known(role)] if o[:2] == (state, target)), key=lambda o: o[2])
        if merged:
            made.append((target, text or "", True))
        else:
            made += [(s, "", False) for s in FILL[state, target]] + [(target, text or "", False)]
            n["inserted"] += len(FILL[state, target])
        n["cost"] += cost
        n["merged"] += merged
        n["relabeled"] += known(role) != ROLES[target - 1]
        state = target
    return made, n


def render(made: list[tuple[int, str, bool]], entry: int, last: bool) -> str:
    """Text of a chunk's turns; the chunks' texts in order make up the conversation's."""
    out, state = [], entry
    for role, text, more in made:
        if more:
            out.append("\n" + text)
        else:
            out.append(("<|end|>\n" if state != START else "") + f"<|{ROLES[role - 1]}|>\n" + text)
        state = role
    if last and state != START:
        out.append("<|end|>\n")
    return "".join(out)


def _order(turn, role, text):
    return (turn is None, turn or 0, role is None, role or "", text is None, text or "")


def _rows(data: pa.Table) -> list[tuple[str | None, str | None]]:
    cols = [data.column(n).to_pylist() for n in ("turn", "role", "text")]
    return [(r, x) for _, r, x in sorted(zip(*cols, strict=True), key=lambda t: _order(*t))]


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``number``, from 0 along each ``k`` by turn, role and text; written once."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k", *[F.col(n).asc_nulls_last() for n in ("turn", "role", "text")], "row"]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered = ordered.drop("row").withColumn("piece", F.spark_partition_id()).withColumn("number", F.lit(0).cast("long"))

    def run(batches):
        last, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            k = batch.column(batch.schema.get_field_index("k"))
            new = np.append(k[0].as_py() != last, np.asarray(pc.not_equal(k[1:], k[:-1]).cast(pa.int8())) == 1)
            at = np.arange(len(k))
            start = np.maximum.accumulate(np.where(new, at, -n))
            number = at - start
            last, n = k[-1].as_py(), int(number[-1]) + 1
            yield batch.set_column(batch.schema.get_field_index("number"), "number", pa.array(number, pa.int64()))

    found = materialize(map_arrow(ordered, run, ordered.schema), "turns")
    counts = found.groupBy("k", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    # At most one conversation of every piece began before it.
    carried = counts.withColumn("before", before).where("before > 0").select("k", "piece", "before")
    carried = materialize(carried, "carried")
    out = found.join(F.broadcast(carried), ["k", "piece"], "left")
    return out.withColumn("number", F.col("number") + F.coalesce("before", F.lit(0))).drop("piece", "before")


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, part, n_turns, cost, n_merged, n_relabeled, n_inserted, rendered``: a row per conversation and chunk.

    Parts of a conversation, of at most ``CHUNK`` turns, are numbered from 0 in order; their texts joined are the
    conversation. Turns go by number, then role and text, nulls last; repeated rows are turns of their own. Null texts
    are empty turns, unknown and null roles are relabelled, null conversation ids are one conversation. Conversations
    without turns do not exist. Other columns are not looked at.
    """
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = numbered(rows.withColumn("k", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))))
    rows = rows.withColumn("part", F.floor(F.col("number") / CHUNK).cast("long")).drop("number")
    top = rows.agg(F.max("part")).first()[0] or 0

    def chunk_matrix(data: pa.Table) -> pa.Table:
        m = [0 if i == j else INF for i in range(4) for j in range(4)]
        for r, _ in _rows(data):
            m = [min(x, INF) for x in product(m, turn_matrix(r))]
        return pa.table({"k": [data.column("k")[0].as_py()], "part": [data.column("part")[0].as_py()], "m": pa.array([m], pa.list_(pa.int64()))})

    def join(data: pa.Table) -> pa.Table:
        parts = sorted(zip(data.column("part").to_pylist(), data.column("m").to_pylist(), strict=True))
        m = parts[0][1]
        for _, x in parts[1:]:
            m = [min(v, INF) for v in product(m, x)]
        return pa.table({"k": [data.column("k")[0].as_py()], "part": pa.array([parts[0][0] // FAN], pa.int64()), "m": pa.array([m], pa.list_(pa.int64()))})

    shape = "k string, part long, m array<bigint>"
    levels = [rows.groupBy("k", "part").applyInArrow(chunk_matrix, shape)]
    while top > 0:
        levels.append(levels[-1].withColumn("up", F.floor(F.col("part") / FAN)).groupBy("k", "up").applyInArrow(join, shape))
        top //= FAN

    edges = "k string, part long, entry int, leave int, last boolean"

    def settle_top(data: pa.Table) -> pa.Table:
        leave = through([data.column("m")[0].as_py()], START, None)[-1]
        return pa.table({"k": data.column("k"), "part": data.column("part"), "entry": pa.array([START], pa.int32()), "leave": pa.array([leave], pa.int32()), "last": [True]})

    def settle(data: pa.Table, above: pa.Table) -> pa.Table:
        parts = sorted(zip(data.column("part").to_pylist(), data.column("m").to_pylist(), strict=True))
        entry, leave, last = (above.column(n)[0].as_py() for n in ("entry", "leave", "last"))
        states = through([m for _, m in parts], entry, leave)
        return pa.table({
            "k": [data.column("k")[0].as_py()] * len(parts), "part": pa.array([p for p, _ in parts], pa.int64()), "entry": pa.array([entry, *states[:-1]], pa.int32()),
            "leave": pa.array(states, pa.int32()), "last": [last and i == len(parts) - 1 for i in range(len(parts))],
        })

    settled = levels[-1].groupBy("k", "part").applyInArrow(settle_top, edges)
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.floor(F.col("part") / FAN))
        settled = below.groupBy("k", "up").cogroup(settled.withColumn("up", F.col("part")).groupBy("k", "up")).applyInArrow(settle, edges)

    def finish(data: pa.Table, above: pa.Table) -> pa.Table:
        entry, leave, last = (above.column(n)[0].as_py() for n in ("entry", "leave", "last"))
        turns = _rows(data)
        made, n = repair(turns, entry, leave)
        if last:
            made += [(s, "", False) for s in END[leave]]
            n["inserted"] += len(END[leave])
            n["cost"] += INSERT * len(END[leave])
        return pa.table({
            "conv_id": data.column("conv_id").slice(0, 1), "part": data.column("part").slice(0, 1), "n_turns": pa.array([len(turns)], pa.int64()), "cost": pa.array([n["cost"]], pa.int64()),
            "n_merged": pa.array([n["merged"]], pa.int64()), "n_relabeled": pa.array([n["relabeled"]], pa.int64()), "n_inserted": pa.array([n["inserted"]], pa.int64()),
            "rendered": pa.array([render(made, entry, last)], pa.string()),
        })

    out = f"conv_id {kind}, part long, n_turns long, cost long, n_merged long, n_relabeled long, n_inserted long, rendered string"
    return rows.groupBy("k", "part").cogroup(settled.groupBy("k", "part")).applyInArrow(finish, out)


@query("op4_chat_formatting")
def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, repaired and rendered."""
    return format_chats(table(spark, folder, "conversations"))
