"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, user first, assistant last. Turns that
break this are kept, merged into the turn before, relabelled, or preceded by empty turns; a dynamic programme over the
automaton's states finds the cheapest repair, and the repaired sequence is rendered turn by turn.

A conversation of any length is worked on in stretches of rows. What a stretch does to the states' costs is a
small matrix (least sums), so stretches of one conversation are linked by their matrices, and no task holds more than one stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import global_index
from .common import over_texts, stored

if TYPE_CHECKING:
    import pandas as pd

STRETCH = 1 << 16  # rows
ROLES = ("", "system", "user", "assistant")  # by state; state 0 is the beginning
NEXT = ((1, 2), (2,), (3,), (2,))  # states that may follow
LAST = 3
KEEP, MERGE, MERGE_OTHER, RELABEL, NAME, INSERT = 0, 1, 4, 3, 1, 2  # costs; NAME gives an unknown role a known one
NEVER = float("inf")
START = (0.0, NEVER, NEVER, NEVER)
JOINT = "\n\n"  # between merged texts
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


@cache
def insertions(state: int, to: int) -> tuple[float, tuple[int, ...]]:
    """Cost and states of the fewest empty turns that lead from one state to another."""
    paths = [(0, (state,))]
    for cost, path in paths:
        if path[-1] == to:
            return cost, path[1:]
        paths += [(cost + INSERT, (*path, n)) for n in NEXT[path[-1]] if n not in path[1:] and len(path) < 5]
    return NEVER, ()


@cache
def step(role: str | None) -> tuple[tuple[tuple[float, str, tuple[int, ...]] | None, ...], ...]:
    """For a turn of this role, by state before and after: cost, action, states of empty turns in front; None if impossible."""

    def options(state: int, to: int) -> Iterator[tuple[float, int, str, tuple[int, ...]]]:
        for before in range(4):
            cost, empty = insertions(state, before)
            if cost < NEVER and to in NEXT[before]:
                if role == ROLES[to]:
                    yield cost + KEEP, 0, "keep", empty
                else:
                    yield cost + (RELABEL if role in ROLES[1:] else NAME), 2, "relabel", empty
        if state == to and state:
            yield (MERGE if role == ROLES[state] else MERGE_OTHER), 1, "merge", ()

    def best(state: int, to: int) -> tuple[float, str, tuple[int, ...]] | None:
        found = min(options(state, to), default=None)
        return found and (found[0], found[2], found[3])

    return tuple(tuple(best(s, t) for t in range(4)) for s in range(4))


@cache
def advance(costs: tuple[float, ...], role: str | None) -> tuple[tuple[float, ...], float, tuple[int, ...]]:
    """Costs of the states after a turn, less their least one, that least one, and each state's best state before.

    Only differences matter, and they take few values, so this is soon a table.
    """
    moves = step(role)
    after, came = [], []
    for to in range(4):
        ways = [(costs[s] + moves[s][to][0], s) for s in range(4) if moves[s][to] and costs[s] < NEVER]
        cost, state = min(ways, default=(NEVER, 0))
        after.append(cost)
        came.append(state)
    least = min(after)
    return tuple(c - least for c in after), least, tuple(came)


def final_state(costs: tuple[float, ...]) -> tuple[float, int]:
    """Cost and state at the end of a conversation, empty turns up to the assistant's included."""
    return min((costs[s] + insertions(s, LAST)[0], s) for s in range(4))


def forward(roles: list[str | None], costs: tuple[float, ...]) -> tuple[tuple[float, ...], float, list[tuple[int, ...]]]:
    total, back = 0.0, []
    for role in roles:
        costs, least, came = advance(costs, role)
        total += least
        back.append(came)
    return costs, total, back


def backward(back: list[tuple[int, ...]], state: int) -> list[int]:
    """States before each turn and after the last one, for the state after the last."""
    states = [state]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def matrix(roles: list[str | None]) -> list[float]:
    """Least cost from each state to each state over a stretch, row by row."""
    found = []
    for s in range(4):
        costs, total, _ = forward(roles, tuple(0.0 if t == s else NEVER for t in range(4)))
        found += [c + total for c in costs]
    return found


def known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES[1:] else None


def render(roles: list[str | None], texts: list[str | None], states: list[int], first: bool, last: bool) -> Iterator[dict]:
    """One row per turn. ``piece`` in row order is the whole conversation; a turn is closed by what comes after it."""
    for i, (role, text) in enumerate(zip(roles, texts)):
        state, to = states[i], states[i + 1]
        cost, action, empty = step(role)[state][to]
        opening = "" if state == 0 or action == "merge" else CLOSE
        piece = opening + "".join(OPEN.format(ROLES[e]) + CLOSE for e in empty)
        piece += (JOINT if action == "merge" else OPEN.format(ROLES[to])) + (text or "")
        behind: tuple[int, ...] = ()
        if last and i == len(roles) - 1:
            more, behind = insertions(to, LAST)
            cost += more
            piece += CLOSE + "".join(OPEN.format(ROLES[e]) + CLOSE for e in behind)
        yield {
            "new_role": ROLES[to], "action": action, "cost": int(cost), "inserted_before": [ROLES[e] for e in empty],
            "inserted_after": [ROLES[e] for e in behind], "piece": piece,
        }


_ORDER = ["conv_id", "turn", "role", "text"]


def _by_stretch(turns: DataFrame, *columns: str) -> DataFrame:
    return turns.select(*columns).repartition("stretch").sortWithinPartitions("stretch", "place")


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, list]]:
    """Rows of one conversation in one stretch together."""
    names = ["stretch", "conv_id"]
    run: dict[str, list] = {}
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        keys = list(zip(*(values[columns.index(n)] for n in names)))
        at = 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if run and (run["stretch"][0], run["conv_id"][0]) != keys[at]:
                yield run
                run = {}
            for c, v in zip(columns, values):
                run.setdefault(c, []).extend(v[at:to])
            at = to
    if run:
        yield run


def _fragments(turns: DataFrame) -> DataFrame:
    """Conversations that lie in several stretches: a row per stretch with its number and roles' matrix."""
    spans = turns.groupBy("conv_id").agg(F.min("stretch").alias("_a"), F.max("stretch").alias("_b")).filter("_a < _b")
    spans = spans.withColumnRenamed("conv_id", "_conv")
    # at most one conversation crosses each boundary between stretches
    own = turns.select("stretch", "place", "conv_id", "role").join(
        spans, F.col("conv_id").eqNullSafe(F.col("_conv"))
    )
    columns = ["stretch", "place", "conv_id", "role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, columns):
            roles = [known(r) for r in part["role"]]
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array(part["conv_id"][:1], pa.int64()),
                    "stretch": pa.array(part["stretch"][:1], pa.int64()),
                    "matrix": pa.array([matrix(roles)], pa.list_(pa.float64())),
                }
            )

    return over_texts(_by_stretch(own, *columns), run, "conv_id long, stretch long, matrix array<double>")


def _linked(turns: DataFrame) -> DataFrame:
    """For each stretch of a long conversation the costs it starts with, the state it ends in, and whether it is the first or last."""
    fragments = stored(_fragments(turns), "chat-fragments")

    def costs(group: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        group = group.sort_values("stretch")
        now, out = START, []
        for values in group["matrix"]:
            out.append(list(now))
            after = [min(now[s] + values[4 * s + t] for s in range(4)) for t in range(4)]
            least = min(after)
            now = tuple(float(a - least) for a in after)
        return pd.DataFrame({
            "conv_id": group["conv_id"], "stretch": group["stretch"], "start": out,
            "end": [final_state(now)[1]] * len(group), "nth": range(len(group)), "of": len(group),
        })

    started = stored(
        fragments.groupBy("conv_id").applyInPandas(costs, "conv_id long, stretch long, start array<double>, end int, nth int, of int"),
        "chat-started",
    )
    columns = ["stretch", "place", "conv_id", "role", "start"]
    keyed = started.select(F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch"), "start")
    own = turns.join(keyed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("stretch") == F.col("_stretch")))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before the stretch for each state after it."""
        for part in _runs(batches, columns):
            _, _, back = forward([known(r) for r in part["role"]], tuple(part["start"][0]))
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array(part["conv_id"][:1], pa.int64()),
                    "stretch": pa.array(part["stretch"][:1], pa.int64()),
                    "before": pa.array([[backward(back, s)[0] for s in range(4)]], pa.list_(pa.int32())),
                }
            )

    before = over_texts(_by_stretch(own, *columns), ways, "conv_id long, stretch long, before array<int>")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("stretch") == F.col("_stretch"))
    both = started.join(before.withColumnsRenamed({"conv_id": "_conv", "stretch": "_stretch"}), same).drop("_conv", "_stretch")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("stretch")
        state, out = int(group["end"].iloc[0]), []
        for before in reversed(list(group["before"])):
            out.append(state)
            state = int(before[state])
        return group.assign(end=out[::-1])[["conv_id", "stretch", "start", "end", "nth", "of"]]

    return both.groupBy("conv_id").applyInPandas(ends, "conv_id long, stretch long, start array<double>, end int, nth int, of int")


REPAIRED = (
    "conv_id long, turn long, role string, place long, new_role string, action string, cost int, "
    "inserted_before array<string>, inserted_after array<string>, piece string"
)


def repair(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per row of ``conversations``: conv_id, turn, role, place, new_role, action, cost, inserted turns, piece.

    Turns are ordered by turn, null last, then role and text; null conv_ids are one conversation. Roles are read without case and outer
    spaces; null and other roles can only be relabelled or merged. Null texts are empty. Of repairs of equal cost the one that ends
    in, and comes from, the earlier state of (system, user, assistant) is taken, so results do not depend on ``stretch``. The pieces of
    a conversation by ``place`` are its rendering. Repeated rows are turns of their own; other columns are not
    read; an empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = rows.withColumn("_last", F.col("turn").isNull())
    placed = global_index(order, ["conv_id", "_last", "turn", "role", "text"], "place").drop("_last")
    turns = stored(placed.withColumn("stretch", F.expr(f"place div {stretch}")), "chat-turns")
    linked = stored(_linked(turns), "chat-linked").withColumnsRenamed({"conv_id": "_conv", "stretch": "_stretch"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("stretch") == F.col("_stretch"))
    columns = ["stretch", "place", "conv_id", "turn", "role", "text", "start", "end", "nth", "of"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, columns):
            roles = [known(r) for r in part["role"]]
            linked, nth, of = part["start"][0] is not None, part["nth"][0], part["of"][0]
            costs, _, back = forward(roles, tuple(part["start"][0]) if linked else START)
            states = backward(back, part["end"][0] if linked else final_state(costs)[1])
            found = list(render(roles, part["text"], states, not linked or nth == 0, not linked or nth == of - 1))
            out = {c: part[c] for c in ("conv_id", "turn", "role", "place")}
            out |= {c: [f[c] for f in found] for c in found[0]}
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("place", pa.int64()), ("new_role", pa.string()),
        ("action", pa.string()), ("cost", pa.int32()), ("inserted_before", pa.list_(pa.string())),
        ("inserted_after", pa.list_(pa.string())), ("piece", pa.string()),
    ])
    return over_texts(_by_stretch(turns.join(linked, same, "left"), *columns), run, REPAIRED)


def rendered(repaired: DataFrame) -> DataFrame:
    """Whole conversations: conv_id, cost, text. For conversations that fit in a task's memory; others are used piece by piece."""
    pieces = F.sort_array(F.collect_list(F.struct("place", "piece")))
    return repaired.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text")
    )
