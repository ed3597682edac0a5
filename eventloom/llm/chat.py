"""Chat formatting by minimum-cost role repair.

Legal conversations: an optional system turn, then user and assistant in turn, user first, assistant last. Each input
turn is kept or relabelled, alone or merged into the turn before; empty turns may be inserted between. A dynamic program over
the states (nothing yet, system, user, assistant) finds the cheapest repair; ties take the first choice in the order of
CHOICES. The repaired turns are rendered in ChatML.

A conversation may be longer than a task should hold. Rows are dealt by range of (conv_id, turn), so a long one spans several
parts; each part sums up its first and its last conversation as 4 x 4 tables: least costs (min-plus), the order of equal ways,
repaired turns, and does the first turn merge. The tables of all parts (two for each, no more) are composed to give the states and the turn numbers at the
bounds, and each part then traces back its own turns. The rows don't depend on where the bounds fall.

Defined cases: a null or unknown role must be relabelled; a null text is empty; turns are ordered by turn (null first), role and text, so
repeated rows stand side by side and merge; a null conv_id is a conversation of its own; conv_id and turn keep their types; an empty table gives an empty table;
other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions, range_parts, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Cost of merging a turn into the one before, of an empty turn, of a relabel by (from, to).
MERGE, INSERT = 1.0, 3.0
RELABEL = {("user", "assistant"): 4.0, ("assistant", "user"): 4.0, ("system", "user"): 2.0, ("system", "assistant"): 5.0, ("user", "system"): 4.0, ("assistant", "system"): 5.0}
RELABEL_UNKNOWN = {"system": 4.0, "user": 2.0, "assistant": 2.5}
#: Steps that need no empty turn.
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
OUT = "out_turn long, role string, action string, inserted string, piece string"
_INF = float("inf")


def inserts(a: int, b: int) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from state a to a turn in state b."""
    if b == START or (b == SYSTEM and a != START):
        return None
    if (a, b) in LEGAL:
        return ()
    return {USER: (ASSISTANT,), SYSTEM: (USER,), START: (USER,), ASSISTANT: (USER,)}.get(a)


#: (state before, state after, merged, inserted), in the order of preference.
CHOICES = [(a, a, True, ()) for a in (SYSTEM, USER, ASSISTANT)] + [
    (a, b, False, way) for a in range(4) for b in (SYSTEM, USER, ASSISTANT) if (way := inserts(a, b)) is not None
]


def role_cost(role: str | None, state: int) -> float:
    to = ROLES[state]
    if role == to:
        return 0.0
    return RELABEL.get((role, to), RELABEL_UNKNOWN[to]) if role in ROLES[1:] else RELABEL_UNKNOWN[to]


@cache
def step(role: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(least cost, choice) of one turn from each state to each."""
    cost, choice = np.full((4, 4), _INF), np.zeros((4, 4), np.int8)
    for k, (a, b, merged, way) in enumerate(CHOICES):
        c = role_cost(role, b) + MERGE * merged + INSERT * len(way)
        if c < cost[a, b]:
            cost[a, b], choice[a, b] = c, k
    return cost, choice


#: What it costs to end in a state: an assistant turn must come last; START is the empty conversation.
END = np.array([0.0, 2 * INSERT, INSERT, 0.0])


@cache
def turns_added(role: str | None) -> np.ndarray:
    """The repaired turns that one input turn adds, from each state to each."""
    return np.array([[len(CHOICES[k][3]) + (not CHOICES[k][2]) for k in row] for row in step(role)[1]])


@cache
def merges(role: str | None) -> np.ndarray:
    """Is the turn merged, from each state to each?"""
    return np.array([[float(CHOICES[k][2]) for k in row] for row in step(role)[1]])


def summary() -> np.ndarray:
    """Of no turns: for each (first state, last state) the least cost, the rank of its way, its repaired turns, does its first turn merge.

    Ways to one last state are ranked as trace() prefers them at equal costs: by the states before the last turn, the
    last but one, and so on.
    """
    cost = np.full((4, 4), _INF)
    np.fill_diagonal(cost, 0)
    return np.stack([cost, np.repeat(np.arange(4.0)[:, None], 4, axis=1), np.zeros((4, 4)), np.full((4, 4), np.nan)])


def extend(table: np.ndarray, role: str | None) -> np.ndarray:
    """The summary with one more turn."""
    ways = table[0][:, :, None] + step(role)[0][None]
    came = ways.argmin(axis=1)
    rank = 4 * came + np.take_along_axis(table[1], came, axis=1)
    turns = np.take_along_axis(table[2], came, axis=1) + turns_added(role)[came, np.arange(4)]
    first = np.take_along_axis(table[3], came, axis=1)
    first = np.where(np.isnan(first), merges(role)[came, np.arange(4)], first)
    return np.stack([ways.min(axis=1), rank.argsort(axis=0).argsort(axis=0), turns, first])


def trace(roles: list[str | None], first: int, final: np.ndarray) -> tuple[list[int], int]:
    """The choices of the cheapest way from state first, with the cost `final` of each end state; and that end state."""
    cost = np.full(4, _INF)
    cost[first] = 0
    came = np.zeros((len(roles), 4), np.int8)
    for k, role in enumerate(roles):
        all_ways = cost[:, None] + step(role)[0]
        came[k] = all_ways.argmin(axis=0)
        cost = all_ways.min(axis=0)
    state = end = int((cost + final).argmin())
    picks = []
    for k in range(len(roles) - 1, -1, -1):
        before = int(came[k, state])
        picks.append(int(step(roles[k])[1][before, state]))
        state = before
    return picks[::-1], end


def _known(role: str | None) -> str | None:
    role = role.strip().lower() if role is not None else None
    return role if role in ROLES[1:] else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[tuple]]]:
    """The conversations of sorted parts, one after another: (part, conv_id, [(turn, role, text)])."""
    now, rows = None, []
    names = ("_part", "conv_id", "turn", "role", "text")
    for batch in batches:
        for part, conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if rows and (part, conv) != now:
                yield *now, rows
                rows = []
            now = part, conv
            rows.append((turn, _known(role), text or ""))
    if rows:
        yield *now, rows


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of each part, summed up: (part, place, conv_id as text, tables)."""
    found: dict[int, list[tuple]] = {}
    now, table, place = None, None, 0

    def close() -> None:
        if now:
            own = found.setdefault(now[0], [])
            del own[1:]
            own.append((place, None if now[1] is None else str(now[1]), table.ravel().tolist()))

    for batch in batches:
        for part, conv, role in zip(*(batch.column(c).to_pylist() for c in ("_part", "conv_id", "role")), strict=True):
            if (part, conv) != now:
                close()
                now, table, place = (part, conv), summary(), place + 1
            table = extend(table, _known(role))
    close()
    rows = [(part, *own) for part, both in found.items() for own in both]
    if rows:
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "place", "conv", "table"])


def bounds(ends: list[tuple[int, int, str | None, list[float]]]) -> dict[tuple[int, str | None], tuple[int, int, int, bool | None]]:
    """For each (part, conversation) that spans parts: the states it begins and ends in, the repaired turns before, does the turn after it merge (None: it is the last).

    ends: sorted by part and place.
    """
    out, chain = {}, []

    def close() -> None:
        if len(chain) > 1:
            costs = [np.array([0.0, _INF, _INF, _INF])]
            for _, table in chain:
                costs.append((costs[-1][:, None] + table[0]).min(axis=0))
            states = [int((costs[-1] + END).argmin())]
            for (_, table), cost in zip(reversed(chain), reversed(costs[:-1]), strict=True):
                end = states[-1]
                total = cost + table[0][:, end]
                states.append(int(np.where(total == total.min(), table[1][:, end], _INF).argmin()))
            states.reverse()
            number = 0
            for k, (part, table) in enumerate(chain):
                after = bool(chain[k + 1][1][3][states[k + 1], states[k + 2]]) if k + 1 < len(chain) else None
                out[part, name] = (states[k], states[k + 1], number, after)
                number += int(table[2][states[k], states[k + 1]])

    name, last_part = None, None
    for part, _, conv, table in ends:
        if chain and conv == name and part != last_part:
            chain.append((part, np.array(table).reshape(4, 4, 4)))
        else:
            close()
            chain = [(part, np.array(table).reshape(4, 4, 4))]
        name, last_part = conv, part
    close()
    return out


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def _repair(batches: Iterator[pa.RecordBatch], known: dict, kind: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for part, conv, rows in _runs(batches):
        first, end, number, next_merges = known.get((part, None if conv is None else str(conv)), (START, None, 0, None))
        final = END if end is None else np.where(np.arange(4) == end, 0.0, _INF)
        picks, end = trace([r for _, r, _ in rows], first, final)
        for k, (pick, (turn, role, text)) in enumerate(zip(picks, rows, strict=True)):
            _, state, merged, way = CHOICES[pick]
            new = ROLES[state]
            action = ("merge" if merged else "keep") if role == new else ("merge+relabel" if merged else "relabel")
            closed = k + 1 == len(rows)
            after = list({SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(end, ())) if closed and next_merges is None else []
            opening = "".join(render(ROLES[x], "") for x in way)
            opens = "\n\n" if merged else f"<|im_start|>{new}\n"
            # a turn stays open while the next row merges into it, be it in the next part
            shut = "" if (next_merges if closed else CHOICES[picks[k + 1]][2]) else "<|im_end|>\n"
            tail = "".join(render(ROLES[x], "") for x in after)
            number += len(way) + (not merged)
            out.append((conv, turn, number, new, action, ",".join(ROLES[x] for x in [*way, *after]) or None, opening + opens + text + shut + tail))
        if len(out) >= 2000:
            yield _batch(out, kind)
            out = []
    if out:
        yield _batch(out, kind)


def _batch(rows: list[tuple], kind: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [*kind, pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "turn", "out_turn", "role", "action", "inserted", "piece"])


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, turn, out_turn, role, action, inserted, piece: a row for each input turn.

    The pieces of a conversation, in order, are its rendering. out_turn counts the repaired turns of the
    conversation; inserted names the empty turns that the piece adds.
    """
    small_batches(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "text")
    kinds = [rows.schema[c].dataType for c in ("conv_id", "turn")]
    arrow = [to_arrow_type(k) for k in kinds]
    rows = rows.withColumn("_hash", F.xxhash64("role", "text"))
    order = ["conv_id", "turn", "role", "_hash"]
    dealt = range_parts(rows, order, "turns")
    # a task has whole ranges, each in order; a range is as large as the range partitioner made it
    dealt = dealt.repartition(partitions(turns.sparkSession), "_part").sortWithinPartitions("_part", *order)
    ends = dealt.select("_part", "conv_id", "role").mapInArrow(_ends, "part int, place long, conv string, table array<double>")
    known = bounds(sorted((r.part, r.place, r.conv, r.table) for r in ends.toLocalIterator()))
    shared = turns.sparkSession.sparkContext.broadcast(known)
    return dealt.mapInArrow(lambda b: _repair(b, shared.value, arrow), f"conv_id {kinds[0].simpleString()}, turn {kinds[1].simpleString()}, {OUT}")
