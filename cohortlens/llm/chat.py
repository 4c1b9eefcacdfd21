"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last one by the
assistant. Dynamic programming over this automaton chooses for every turn the cheapest of: keep or relabel it as the
next turn, merge it into the turn before, with empty turns inserted where needed. The repaired sequence is rendered.

A conversation is worked on in parts of PART consecutive turn numbers: first each part's costs from every entry state
to every exit state, then the cheapest chain of states over the parts, then each part's repair and its share of the
rendered text; a very long conversation is thus spread over many tasks, and its parts' texts join to the whole.

Edge cases: turns are ordered by number (null first), then role, then text; a null or unknown role may take any role
at UNKNOWN's cost; a null text is empty. Of equally cheap repairs, a turn of its own beats a merge and the earlier role
in ROLES wins. Repeated rows are turns of their own. A null conversation id is a conversation of its own. An empty table
gives an empty result; other columns are ignored. The key of the result is (conversation, part), in the order of part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("start", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 3, 1, 2
PART = 256
FAR = 1 << 40


def _routes() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest legal ways from a state to a state: the turns to insert before the last step."""
    out = {}
    for s in range(4):
        seen, queue = set(), [(q, ()) for q in NEXT[s]]
        while queue:
            q, via = queue.pop(0)
            if q not in seen:
                seen.add(q)
                out[s, q] = via
                queue += [(r, (*via, q)) for r in NEXT[q]]
    return out


ROUTES = _routes()


def _label(role: object, to: int) -> int:
    return 0 if role == ROLES[to] else RELABEL if role in ROLES[1:] else UNKNOWN


def _steps(role: object) -> list[tuple[int, int, int, bool]]:
    """(from, to, cost, merged) of what may become of a turn, better ones first among equals."""
    own = [(s, q, INSERT * len(via) + _label(role, q), False) for (s, q), via in sorted(ROUTES.items())]
    return own + [(s, s, MERGE + _label(role, s), True) for s in (1, 2, 3)]


STEPS = {r: _steps(r) for r in (*ROLES[1:], None)}


def relax(costs: list[int], role: object) -> tuple[list[int], list[tuple[int, bool] | None]]:
    """Costs of all states after one more turn, and how each is reached."""
    out, how = [FAR] * 4, [None] * 4
    for s, q, c, merged in STEPS.get(role, STEPS[None]):
        if costs[s] + c < out[q]:
            out[q], how[q] = costs[s] + c, (s, merged)
    return out, how


def closing(state: int) -> tuple[int, ...]:
    """Empty turns that end a conversation in the given state."""
    return () if state in (0, 3) else (*ROUTES[state, 3], 3)


def transfer(roles: list) -> list[int]:
    """Costs from each of the four states to each, row by row."""
    out = []
    for s in range(4):
        costs = [0 if s == t else FAR for t in range(4)]
        for r in roles:
            costs, _ = relax(costs, r)
        out += costs
    return out


def chain(parts: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, exit) of every part on the cheapest way from start to a closed conversation."""
    costs, back = [0, FAR, FAR, FAR], []
    for m in parts:
        new, how = [FAR] * 4, [0] * 4
        for q in range(4):
            for s in range(4):
                if costs[s] + m[4 * s + q] < new[q]:
                    new[q], how[q] = costs[s] + m[4 * s + q], s
        costs = new
        back.append(how)
    state = min(range(4), key=lambda s: (costs[s] + INSERT * len(closing(s)), s))
    out = []
    for how in reversed(back):
        out.append((how[state], state))
        state = how[state]
    return out[::-1]


def repair(roles: list, entry: int, leave: int) -> list[tuple[int, bool, tuple[int, ...]]]:
    """For each turn: its role, whether it is merged, and the empty turns before it."""
    costs, back = [0 if s == entry else FAR for s in range(4)], []
    for r in roles:
        costs, how = relax(costs, r)
        back.append(how)
    out, state = [], leave
    for how in reversed(back):
        s, merged = how[state]
        out.append((state, merged, () if merged else ROUTES[s, state]))
        state = s
    return out[::-1]


def render(turns: list[tuple[object, object]], entry: int, leave: int, last: bool) -> dict:
    """The part's text and what was done. `<|` in a text becomes `<||`, so that it can't be taken for a mark."""
    out, open_, roles, merges, relabels, inserts = [], entry > 0, [], 0, 0, 0

    def begin(q: int) -> None:
        nonlocal open_
        out.append("<|end|>\n" * open_ + f"<|{ROLES[q]}|>\n")
        roles.append(ROLES[q][0])
        open_ = True

    for (role, text), (q, merged, before) in zip(turns, repair([r for r, _ in turns], entry, leave), strict=True):
        for x in before:
            begin(x)
        inserts += len(before)
        if merged:
            out.append("\n\n")
            merges += 1
        else:
            begin(q)
        relabels += role != ROLES[q]
        out.append((text or "").replace("<|", "<||"))
    if last:
        for x in closing(leave):
            begin(x)
            inserts += 1
        out.append("<|end|>\n" * open_)
    return {"turns": len(turns), "roles": "".join(roles), "merges": merges, "relabels": relabels, "inserts": inserts, "rendered": "".join(out)}


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys, whole even where they go on in the next frame. Rows come sorted by the keys."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        cut = (frame[keys].ne(frame[keys].shift()) & ~(frame[keys].isna() & frame[keys].shift().isna())).any(axis=1).to_numpy()
        cut[0] = bool(rest) and not frame[keys].iloc[0].equals(rest[-1][keys].iloc[-1])
        at = [0, *[i for i in cut.nonzero()[0].tolist() if i], len(frame)]
        if cut[0]:
            yield pd.concat(rest)
            rest = []
        for a, b in zip(at, at[1:], strict=False):
            rest.append(frame.iloc[a:b])
            if b < len(frame):
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
    if rest:
        yield pd.concat(rest)


def _none(values: pd.Series) -> list:
    return [None if pd.isna(v) else v for v in values]


def _transfers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [(g["conv"].iloc[0], g["part"].iloc[0], transfer(_none(g["role"]))) for g in _groups(frames, ["conv", "part"])]
    yield pd.DataFrame(rows, columns=["conv", "part", "costs"])


def _chains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for conv, parts in zip(frame["conv"], frame["parts"], strict=True):
            found = chain([list(p["costs"]) for p in parts])
            rows += [(conv, p["part"], a, b, i == len(parts) - 1) for i, (p, (a, b)) in enumerate(zip(parts, found, strict=True))]
        yield pd.DataFrame(rows, columns=["conv", "part", "entry", "leave", "last"])


def _rendered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for g in _groups(frames, ["conv", "part"]):
        first = g.iloc[0]
        rows.append({"conv": first["conv"], "part": first["part"]} | render(list(zip(_none(g["role"]), _none(g["text"]), strict=True)), int(first["entry"]), int(first["leave"]), bool(first["last"])))
        if len(rows) == 500:
            yield pd.DataFrame(rows)
            rows = []
    if rows:
        yield pd.DataFrame(rows)


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, turns, roles, merges, relabels, inserts, rendered), a row for each part of a conversation."""
    kind = "string"  # numbers would become doubles beside a null
    rows = turns.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.floor(F.coalesce(F.col(turn_col), F.lit(0)) / PART).alias("part"))
    key = ["conv", "part"]
    costs = rows.select(*key, "turn", "role").repartition(*key).sortWithinPartitions(*key, "turn", "role").mapInPandas(_transfers, f"conv {kind}, part long, costs array<long>")
    parts = costs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("parts"))
    ways = parts.mapInPandas(_chains, f"conv {kind}, part long, entry int, leave int, last boolean")
    joined = rows.alias("r").join(ways.alias("w"), F.col("r.conv").eqNullSafe(F.col("w.conv")) & (F.col("r.part") == F.col("w.part"))).select("r.*", "entry", "leave", "last")
    done = joined.repartition(*key).sortWithinPartitions(*key, "turn", "role", "text").mapInPandas(_rendered, f"conv {kind}, part long, turns long, roles string, merges long, relabels long, inserts long, rendered string")
    return done.withColumn("conv", F.col("conv").cast(turns.schema[conv_col].dataType)).withColumnRenamed("conv", conv_col)
