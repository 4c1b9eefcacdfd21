"""Secret scans: all rules as one minimal automaton that reads every byte of a text once.

The automaton is that of the reversed rules: reading a text backwards, it is in an accepting state just where a match of
a rule begins (`automata`). From the leftmost of these places on, the rule's own forward automaton gives the longest
match; the next one begins after it. So matches of a kind are leftmost, longest and do not overlap. Rules are compiled
once, on the driver; every task has the transition arrays (below a megabyte).

Edge cases: a null or empty text has no spans. Places are code points, also in texts with characters of several bytes;
letters are folded within ASCII only. Repeated rows each get their spans; null ids stay; an empty table gives an empty
result; other columns are not read, so they may have any name. A very long text is read whole: time grows with its
length, memory with some 20 bytes for each of its bytes at worst.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import compile_patterns, longest, marks


@dataclass(frozen=True)
class Rule:
    """`least`: characters that a match must have from the last one of its shortest form on, else it is dropped."""

    kind: str
    pattern: bytes
    least: int = 1


#: assign: the value has 12 characters. access: 18 in all. hex: 16, of which the pattern itself takes care, as a shorter
#: run of digits cannot hold a longer one.
BASE = (
    Rule("assign", rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12),
    Rule("access", rb"AKIA[A-Z0-9]+", 14),
    Rule("hex", rb"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 8),
    Rule("git", rb"gh[opsu]_[A-Za-z0-9]+", 36),
    Rule("chat", rb"xox[abprs]-[0-9A-Za-z-]+", 10),
)
#: Bytes of texts that are read side by side.
SLICE = 8_000_000


def _spans(rules, whole, each, data: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    """The spans of each text; text i is data[ends[i]:ends[i + 1]]."""
    found: list[list[tuple]] = [[] for _ in range(len(ends) - 1)]
    places, hits = marks(whole, data, ends[:-1], ends[1:])
    owner = np.searchsorted(ends, places, "right") - 1
    raw = data.tobytes() if len(places) else b""
    for r, rule in enumerate(rules):
        mine = np.flatnonzero(hits >> r & 1)
        done = 0
        for at, i in zip(places[mine].tolist(), owner[mine].tolist(), strict=True):
            if at >= done:
                done, earliest = longest(each[r], raw, at, int(ends[i + 1]))
                if done - earliest + 1 >= rule.least:
                    found[i].append((at, r, done))
    leads = (data & 0xC0) != 0x80
    out = []
    for i, spans in enumerate(found):
        base, points, rows = int(ends[i]), 0, []
        for at, r, done in sorted(spans):
            points, base = points + int(np.count_nonzero(leads[base:at])), at
            rows.append({"kind": rules[r].kind, "start": points, "end": points + int(np.count_nonzero(leads[at:done]))})
        out.append(rows)
    return out


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): spans (kind, start, end) of each text by start, then the rules' order; ends are exclusive."""
    rules = tuple(rules)
    whole = compile_patterns([r.pattern for r in rules], reverse=True, search=True)
    each = [compile_patterns([r.pattern]) for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, size[at] + SLICE, "right")) - 1)
                part = texts.slice(at, stop - at)
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                body = part.buffers()[2]
                data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
                spans = _spans(rules, whole, each, data, offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(spans, kind)], ["id", "spans"])
                at = stop

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>").withColumnRenamed("id", id_col)


def joined(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with each span of its text replaced by its kind in brackets; of overlapping spans the later ones only blank
    what the earlier ones left. Ids must be unique; a null text stays null."""
    step = """aggregate(spans, named_struct('at', 0L, 'out', ''),
        (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', if(s.end <= a.at, a.out,
            concat(a.out, substr(`{t}`, cast(a.at + 1 as int), cast(greatest(s.start - a.at, 0) as int)), '[', s.kind, ']'))),
        a -> concat(a.out, substr(`{t}`, cast(a.at + 1 as int))))""".format(t=text_col)
    found = spans.select(F.col(id_col).alias("__id"), F.col("spans"))
    both = docs.withColumnRenamed("spans", "__kept").join(found, F.col(id_col) == F.col("__id"), "left")
    names = [F.col("__kept").alias(c) if c == "spans" else F.coalesce(F.expr(step), F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*names)
