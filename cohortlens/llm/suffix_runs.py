"""Runs: maximal periodic stretches of a document's words, by longest common extensions in suffix trees.

Every run has a Lyndon root that is the longest Lyndon word at its place, in the words' order or in the reversed one.
So the roots are taken at every place (up to the next smaller suffix, by leaf ranks of the suffix tree) and extended in
both directions: to the right by the tree of the document, to the left by that of its reversal. Both trees are
Ukkonen's; an extension is the string depth of a lowest common ancestor, the least depth on the Euler tour between two
leaves, found in constant time by a sparse table.

A run of `least` words or more consists of windows of half as many words which occur twice in the document (it is at
least two periods long). Only stretches of such windows go into the trees, each behind a separator that occurs once. No
run is lost by that, and prose without repetitions costs no tree.

Edge cases: a null or empty text has no words, no runs and an empty collapsed text. Words are bytes between ASCII white
space and are not folded. Repeated rows each get their result; null ids stay; an empty table gives an empty result;
other columns are not read. A very long text is worked on whole: some 12 microseconds and a kilobyte for every word that
lies in repeated windows, 100 bytes for every other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SuffixTree:
    """Of numbers that end with a 0 which occurs nowhere else. `depths` is the Euler tour, `leaf[i]` the place of suffix i
    on it, `rank` and `rank_reversed` the suffixes' order with symbols ascending and descending (0 first in both)."""

    def __init__(self, s: list[int], orders: bool = True):
        first, stop, suffix, child, m = _ukkonen(s)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        kids = np.fromiter(child.values(), np.int64, len(child))
        parent, symbol = np.divmod(keys, m)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(first)))]).tolist()
        size = (np.array(stop) - np.array(first)).tolist()
        ascending = kids[np.lexsort((symbol, parent))].tolist()
        self.depths, self.leaf, leaves = _tour(ascending, bounds, size, suffix, len(s))
        self.table = [self.depths]
        while (half := 1 << (len(self.table) - 1)) * 2 <= len(self.depths):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
        if orders:
            self.rank = np.empty(len(s), np.int64)
            self.rank[leaves] = np.arange(len(s))
            self.rank_reversed = np.empty(len(s), np.int64)
            descending = kids[np.lexsort((-symbol, symbol > 0, parent))].tolist()
            self.rank_reversed[_leaves(descending, bounds, suffix)] = np.arange(len(s))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes i and j (different ones) have in common at their beginning."""
        a, b = np.minimum(self.leaf[i], self.leaf[j]), np.maximum(self.leaf[i], self.leaf[j]) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << k)])
        return out


def _ukkonen(s: list[int]) -> tuple[list[int], list[int], list[int], dict[int, int], int]:
    """Edges (first, stop) into each node, the suffix of each leaf (-1 inside), and children by node * m + symbol.

    As the whole text is known, a leaf's edge ends at the text's end from the beginning."""
    n, m = len(s), max(s) + 1
    first, stop, suffix, link, child = [0], [0], [-1], [0], {}
    node = edge = length = left = 0
    for i, c in enumerate(s):
        left += 1
        made = 0
        while left:
            if not length:
                edge = i
            key = node * m + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                if made:
                    link[made] = node
                    made = 0
            else:
                span = stop[below] - first[below]
                if length >= span:
                    node, edge, length = below, edge + span, length - span
                    continue
                at = first[below]
                if s[at + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                split = len(first)
                first.append(at)
                stop.append(at + length)
                suffix.append(-1)
                link.append(0)
                child[key] = split
                first[below] = at + length
                child[split * m + s[at + length]] = below
                child[split * m + c] = split + 1
                if made:
                    link[made] = split
                made = split
            first.append(i)
            stop.append(n)
            suffix.append(i - left + 1)
            link.append(0)
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return first, stop, suffix, child, m


def _tour(kids: list[int], bounds: list[int], size: list[int], suffix: list[int], n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """String depths along the Euler tour, each leaf's place on it, and the suffixes in the leaves' order."""
    depths, place, leaves, todo, at = [0], [0] * n, [], [], bounds[:-1]
    node = depth = 0
    while True:
        k = at[node]
        if k < bounds[node + 1]:
            at[node] = k + 1
            kid = kids[k]
            i = suffix[kid]
            if i >= 0:
                place[i] = len(depths)
                leaves.append(i)
                depths += (depth + size[kid], depth)
            else:
                todo.append((node, depth))
                node, depth = kid, depth + size[kid]
                depths.append(depth)
        elif todo:
            node, depth = todo.pop()
            depths.append(depth)
        else:
            return np.array(depths, np.int32), np.array(place, np.int64), leaves


def _leaves(kids: list[int], bounds: list[int], suffix: list[int]) -> list[int]:
    found, todo = [], [0]
    while todo:
        node = todo.pop()
        if suffix[node] >= 0:
            found.append(suffix[node])
        else:
            todo += kids[bounds[node] : bounds[node + 1]][::-1]
    return found


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place but the last (whose rank is 0), the next one of a smaller rank."""
    out, open_places = [0] * (len(rank) - 1), []
    ranks = rank.tolist()
    for j, r in enumerate(ranks):
        while open_places and ranks[open_places[-1]] > r:
            out[open_places.pop()] = j
        open_places.append(j)
    return np.array(out, np.int64)


def all_runs(s: list[int]) -> np.ndarray:
    """All runs (start, length, period) of at least two periods, by start and period. Numbers are 1 or more."""
    n = len(s)
    tree = SuffixTree([*s, 0])
    place = np.arange(n)
    i = np.concatenate([place, place])
    p = np.concatenate([next_smaller(tree.rank), next_smaller(tree.rank_reversed)]) - i
    right = tree.common(i, i + p)
    del tree
    back = SuffixTree([*s[::-1], 0], orders=False)
    left = np.zeros(2 * n, np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = back.common(n - i[inner], n - i[inner] - p[inner])
    found = np.column_stack([i - left, p, left + p + right])[left + right >= p]
    return np.unique(found, axis=0)[:, [0, 2, 1]]


#: Fixed odd multipliers of a window's hash (multiples of 2 ** 64 over the golden ratio).
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def repeated_stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches that windows occurring at least twice cover. Equal hashes count as equal windows, which can only
    make a stretch longer than need be."""
    n = len(ids) - window + 1
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ (h >> np.uint64(29))) * _FACTOR + ids[k : k + n].astype(np.uint64)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return []
    step = np.zeros(len(ids) + 1, np.int64)
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    step[at] += 1
    step[at + window] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(step) > 0, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def runs_of_words(words: list[bytes], least: int = 12) -> np.ndarray:
    """Runs (start, length, period) of at least `least` words (2 or more) and two periods, by start and period."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < least:
        return none
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
    stretches = [x for x in repeated_stretches(np.array(ids), least // 2) if x[1] - x[0] >= least]
    if not stretches:
        return none
    s, place, mark = [], [], len(numbers)
    for a, b in stretches:
        mark += 1
        s += [mark, *ids[a:b]]
        place += range(a - 1, b)
    names = {x: k for k, x in enumerate(dict.fromkeys(s), 1)}
    found = all_runs([names[x] for x in s])
    found = found[found[:, 1] >= least]
    found[:, 0] = np.array(place)[found[:, 0]]
    return found


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not len(runs):
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Rows leave in batches of so many.
ROWS = 512


def periodic_runs(docs: DataFrame, least: int = 12, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, runs, collapsed): the runs (start, length, period; in words) of each text, and its words joined by one
    space, where of each run only the first period stays. No shuffle: every text is worked on where it is read."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found, texts = [], []
                for text in pc.fill_null(part.column(1), "").cast(pa.large_binary()):
                    words = text.as_py().split()
                    runs = runs_of_words(words, least)
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                    texts.append(b" ".join(collapsed(words, runs)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _RUN), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").withColumnRenamed("id", id_col)


def words_of(text: Column) -> Column:
    """The words between ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
