"""Regular expressions over bytes as deterministic automata: subset construction, minimisation, transition arrays.

A pattern is a bytes pattern of Python's syntax with literals, classes, groups, alternatives, greedy repetitions and
ASCII case folding; no anchors, references or lookaround, which are refused. It must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from re import IGNORECASE, _constants, _parser

import numpy as np


@dataclass
class Nfa:
    """Moves are (bytes, target); a fragment is built from its last item on, so reversal only turns sequences round."""

    reverse: bool
    empty: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)

    def state(self, *to: int) -> int:
        self.empty.append(list(to))
        self.moves.append([])
        return len(self.empty) - 1

    def sequence(self, items: Sequence, fold: bool, to: int) -> int:
        """The state from which `items` lead to the state `to`."""
        for op, arg in items if self.reverse else list(items)[::-1]:
            to = self.item(op, arg, fold, to)
        return to

    def item(self, op, arg, fold: bool, to: int) -> int:
        c = _constants
        if op is c.SUBPATTERN:
            return self.sequence(arg[3], (fold or bool(arg[1] & IGNORECASE)) and not arg[2] & IGNORECASE, to)
        if op is c.BRANCH:
            return self.state(*[self.sequence(x, fold, to) for x in arg[1]])
        if op is c.MAX_REPEAT:
            least, most, items = arg
            if most is c.MAXREPEAT:
                loop = self.state(to)
                self.empty[loop].append(self.sequence(items, fold, loop))
                to = loop
            else:
                for _ in range(most - least):
                    to = self.state(to, self.sequence(items, fold, to))
            for _ in range(least):
                to = self.sequence(items, fold, to)
            return to
        s = self.state()
        self.moves[s].append((_bytes(op, arg, fold), to))
        return s

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes(op, arg, fold: bool) -> frozenset[int]:
    c, every = _constants, frozenset(range(256))
    if op is c.LITERAL:
        found = {arg}
    elif op is c.NOT_LITERAL:
        found = {arg}
    elif op is c.ANY:
        return every - {10}
    elif op is c.IN:
        if any(k not in (c.LITERAL, c.RANGE, c.NEGATE) for k, _ in arg):
            raise ValueError("a class of a rule has literals and ranges only")
        found = {b for k, x in arg if k is not c.NEGATE for b in ([x] if k is c.LITERAL else range(x[0], x[1] + 1))}
    else:
        raise ValueError(f"a rule has no {op}")
    if fold:
        found |= {ord(f(chr(b))) for b in found if b < 128 for f in (str.lower, str.upper)}
    return every - found if op is c.NOT_LITERAL or op is c.IN and arg[0][0] is c.NEGATE else frozenset(found)


@dataclass(frozen=True)
class Dfa:
    """`table[state * width + kind[byte]]` is the next state times `width`; `hits[state]` are bits of the patterns that
    the state accepts. State 0 is the start. Accepting states have the highest numbers: those from `hot` on (times
    `width`). `dead` (times `width`) is the state that nothing leaves, or -1."""

    kind: np.ndarray
    table: np.ndarray
    width: int
    hits: np.ndarray
    hot: int
    dead: int


def compile_patterns(patterns: Sequence[bytes], *, reverse: bool = False, search: bool = False) -> Dfa:
    """One minimal automaton for all patterns. `reverse` reads texts backwards; `search` begins anew at every byte."""
    nfa = Nfa(reverse)
    ends = [nfa.state() for _ in patterns]
    starts = [nfa.sequence(_parser.parse(p), False, e) for p, e in zip(patterns, ends, strict=True)]
    first = nfa.closure(starts)
    if first & set(ends):
        raise ValueError("a rule must not match the empty text")
    # bytes that no pattern tells apart are one kind
    sets = sorted({m for ms in nfa.moves for m, _ in ms}, key=sorted)
    told = np.array([[b in m for m in sets] for b in range(256)])
    _, example, kind = np.unique(told, axis=0, return_index=True, return_inverse=True)
    kind = kind.ravel()
    # subset construction
    number, todo, rows = {first: 0}, [first], []
    for subset in todo:
        moves = [m for s in subset for m in nfa.moves[s]]
        row = []
        for b in example.tolist():
            to = nfa.closure([t for m, t in moves if b in m])
            to = to | first if search else to
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows)
    hits = np.array([sum(1 << i for i, e in enumerate(ends) if e in s) for s in todo])
    # minimisation: split classes of states until their successors' classes agree
    label, n = np.unique(hits, return_inverse=True)[1], 0
    while n < (n := label.max() + 1):
        label = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)[1].ravel()
    one = np.unique(label, return_index=True)[1]
    order = np.lexsort((one, one != one[label[0]], hits[one] > 0))  # the start first, accepting states last
    place = np.argsort(order)
    small, hits = place[label[table[one[order]]]], hits[one[order]]
    width = len(example)
    dead = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (hits == 0))
    return Dfa(kind.astype(np.uint8), (small * width).astype(np.int32).ravel(), width, hits, int(np.count_nonzero(hits == 0)) * width, int(dead[0]) * width if len(dead) else -1)


#: So few texts at a time are read byte by byte.
FEW = 48


def marks(dfa: Dfa, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hits) where `dfa`, reading each text data[first:last] backwards, accepts; places ascend.

    Every byte is read once. After a byte that leads from every state to the start nothing before it counts, so texts
    are cut there; the pieces are read side by side, the longest first, one transition of each at a time.
    """
    table, width = dfa.table, dfa.width
    kind = dfa.kind[data]
    resets = (table.reshape(-1, width) == 0).all(axis=0)
    cuts = np.flatnonzero(resets[kind])
    left = np.sort(np.concatenate([first, cuts + 1]))
    right = np.sort(np.concatenate([last, cuts]))
    size = right - left
    order = np.argsort(-size, kind="stable")
    left, right, size = left[order], right[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    state, places, states = np.zeros(len(size), np.int32), [], []
    steps = int(np.count_nonzero(alive >= FEW))
    for j in range(steps):
        k = alive[j]
        at = right[:k] - (j + 1)
        now = table[state[:k] + kind[at]]
        state[:k] = now
        if len(hot := np.flatnonzero(now >= dfa.hot)):
            places.append(at[hot])
            states.append(now[hot])
    step = table.tolist()
    for lane in range(int(alive[steps]) if steps < len(alive) else 0):
        s, here, found = int(state[lane]), [], []
        rest = kind[left[lane] : right[lane] - steps].tobytes()
        for i in range(len(rest) - 1, -1, -1):
            s = step[s + rest[i]]
            if s >= dfa.hot:
                here.append(left[lane] + i)
                found.append(s)
        places.append(np.array(here, np.int64))
        states.append(np.array(found, np.int32))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, states = np.concatenate(places), np.concatenate(states)
    order = np.argsort(places, kind="stable")
    return places[order], dfa.hits[states[order] // width]


def longest(dfa: Dfa, data: memoryview | bytes, at: int, stop: int) -> tuple[int, int]:
    """(end, earliest) of the longest match that begins at `at`: the place after it, and that after the shortest one."""
    table, kind, width, s, end, earliest = dfa.table, dfa.kind, dfa.width, 0, -1, -1
    while at < stop and s != dfa.dead:
        s = int(table[s + int(kind[data[at]])])
        at += 1
        if dfa.hits[s // width]:
            end, earliest = at, earliest if earliest >= 0 else at
    return end, earliest
