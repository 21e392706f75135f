"""Chat formatting with minimum-cost role repair (operator 9).

A legal conversation is at most one system turn, then user and assistant turns in
alternation, the last by the assistant. Dynamic programming over the automaton of those
turns decides for every given turn: keep its role, give it another (relabel), or join it to
the turn before it (merge), and where to put empty turns (insert), at the least total cost;
ties are settled from the last turn back, for the option that costs less itself, then in the
order keep, merge, insert, relabel. The result has one
row per given turn with its share of the rendering; the shares of a conversation, in order,
are its whole rendering.

The cost of a stretch of turns is a matrix over the automaton's states, and matrices of
neighbouring stretches combine by (min, +). So a conversation of any length is handled in
stretches of at most about ``STRETCH`` turn numbers: for those of more than one stretch the
matrices come first and give the states at the borders; then every stretch is repaired by
itself. Stretches are dealt by hash and sorted, and run through Arrow batches.

Cases: null and unknown roles are relabelled; null texts are empty; texts are never altered,
even if they hold the strings that mark turns; turns with equal numbers
are ordered by role and text, null numbers come first; rows with a null conv_id form one
conversation of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import columns, short_batches, written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns that have to be put in to get from one state to a turn of another; missing: illegal.
BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Turns to put in after the last one.
CLOSING: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
MERGE, INSERT, RELABEL = 1, 2, 4
STRETCH = 4096

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def options(role: str | None) -> list[tuple[int, int, int, str]]:
    """(cost, state before, state after, action) for a turn of the role, best option first on ties."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    out = []
    for after in (SYSTEM, USER, ASSISTANT):
        change = 0 if after == own else RELABEL
        for before in range(4):
            if before == after:
                out.append((change + MERGE, before, after, "merge" if not change else "relabel+merge"))
            if (between := BETWEEN.get((before, after))) is not None:
                cost = change + INSERT * len(between)
                parts = [*["relabel"] * bool(change), *["insert"] * bool(between)]
                out.append((cost, before, after, "+".join(parts) or "keep"))
    rank = {"keep": 0, "merge": 1, "insert": 2}
    return sorted(out, key=lambda o: (o[0], rank.get(o[3], 3), o[1], o[2]))


_OPTIONS = {role: options(role) for role in (*ROLES, None)}


def _options(role: str | None) -> list[tuple[int, int, int, str]]:
    return _OPTIONS.get(role, _OPTIONS[None])


def closing_cost() -> np.ndarray:
    return np.array([INSERT * len(CLOSING[s]) for s in range(4)], dtype=np.float64)


def matrix(roles: Iterable[str | None]) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        step = np.full((4, 4), np.inf)
        for cost, before, after, _ in reversed(_options(role)):
            step[before, after] = min(step[before, after], cost)
        total = (total[:, :, None] + step[None, :, :]).min(axis=1)
    return total


def repair(roles: list[str | None], enter: int, leave: int) -> list[tuple[int, int, str]]:
    """(state before, state after, action) for every turn on a cheapest path between the two states."""
    costs, choice = np.full(4, np.inf), []
    costs[enter] = 0
    for role in roles:
        now, came = np.full(4, np.inf), [None] * 4
        for option in _options(role):
            cost, before, after, _ = option
            if costs[before] + cost < now[after]:
                now[after], came[after] = costs[before] + cost, option
        costs = now
        choice.append(came)
    out, state = [], leave
    for came in reversed(choice):
        _, before, after, action = came[state]
        out.append((before, after, action))
        state = before
    return out[::-1]


def borders(matrices: list[np.ndarray]) -> list[int]:
    """States before, between and after the stretches on a cheapest way through all of them."""
    rest = [closing_cost()]
    for m in reversed(matrices):
        rest.append((m + rest[-1][None, :]).min(axis=1))
    rest.reverse()
    states = [START]
    for m, after in zip(matrices, rest[1:]):
        states.append(int((m[states[-1]] + after).argmin()))
    return states


def turn(state: int, text: str = "") -> str:
    return f"{OPEN}{ROLES[state - 1]}\n{text}"


def render(before: int, after: int, action: str, text: str | None, last: bool) -> str:
    """A turn's share of the rendering: it closes the turn before it, unless it joins that one."""
    text = text or ""
    if "merge" in action:
        out = f"\n{text}"
    else:
        out = CLOSE if before != START else ""
        out += "".join(turn(s) + CLOSE for s in BETWEEN[before, after]) + turn(after, text)
    return out + (CLOSE + "".join(turn(s) + CLOSE for s in CLOSING[after]) if last else "")


_RESULT = [("conv_id", "long"), ("turn", "long"), ("nth", "long"), ("role_given", "string"), ("role", "string"), ("action", "string"), ("rendered", "string")]
_ARROW = {"long": pa.int64(), "string": pa.string()}
RESULT = ", ".join(f"{n} {t}" for n, t in _RESULT)
COSTS = "conv_id long, stretch long, n long, cost array<double>"


def _role(value: object) -> str | None:
    return value if value in ROLES else None


#: Conversations have few sequences of roles, so most repairs are look-ups.
_borders = functools.lru_cache(10_000)(lambda roles: borders([matrix(roles)]))
_repair = functools.lru_cache(10_000)(lambda roles, enter, leave: repair(list(roles), enter, leave))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (conv_id, stretch), the first two columns, which come one after the other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterable[tuple], fields: list[tuple[str, pa.DataType]], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield flush()
            held = []
    yield flush()


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("conv_id", pa.int64()), ("stretch", pa.int64()), ("n", pa.int64()), ("cost", pa.list_(pa.float64()))]
    found = ((rows[0][0], rows[0][1], len(rows), matrix(_role(r[3]) for r in rows).ravel().tolist()) for rows in _stretches(batches))
    yield from _batches(found, fields)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("stretch")
    states = borders([np.array(c).reshape(4, 4) for c in pdf["cost"]])
    return pd.DataFrame(
        {"conv": pdf["conv_id"], "part": pdf["stretch"], "enter": states[:-1], "leave": states[1:], "first": pdf["n"].cumsum() - pdf["n"], "last": [k == len(pdf) - 1 for k in range(len(pdf))]}
    )


def _written_out(rows: list[tuple]) -> Iterator[tuple]:
    conv_id, _, _, _, _, enter, leave, first, last = rows[0]
    roles = tuple(_role(r[3]) for r in rows)
    if enter is None:  # the only stretch of its conversation
        (enter, leave), first, last = _borders(roles), 0, True
    steps = _repair(roles, enter, leave)
    for k, ((before, after, action), row) in enumerate(zip(steps, rows)):
        yield conv_id, row[2], first + k, row[3], ROLES[after - 1], action, render(before, after, action, row[4], last and k == len(rows) - 1)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches((out for rows in _stretches(batches) for out in _written_out(rows)), [(n, _ARROW[t]) for n, t in _RESULT])


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "turn", "role", "text")


def format_conversations(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per turn: conv_id, turn, nth (from 0), role_given, role, action, rendered."""
    number = F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-1 << 62)).cast("long").alias("stretch")
    rows = columns(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.select("conv_id", number, "turn", "role", "text")
    short_batches(turns.sparkSession, 1000)
    long = rows.groupBy("conv_id").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("low < high")
    long = written(long.select(F.col("conv_id").alias("conv")), "long-conversations")
    of_long = rows.join(long, F.col("conv_id").eqNullSafe(F.col("conv")), "left_semi")
    costs = _in_order(of_long.select("conv_id", "stretch", "turn", "role", F.lit(None).cast("string").alias("text"))).mapInArrow(_summarise, COSTS)
    states = written(costs.groupBy("conv_id").applyInPandas(_meet, "conv long, part long, enter int, leave int, first long, last boolean"), "chat-states")
    joined = rows.join(states, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("stretch") == F.col("part")), "left").drop("conv", "part")
    return _in_order(joined).mapInArrow(_write, RESULT)
