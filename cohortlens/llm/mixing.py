"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Every source is cut into blocks of equal size. In a mix with weight p / q, its block j is released at floor(j q / p)
and due at ceil((j + 1) q / p); earliest deadline first among the released blocks fills one slot after another. On one
processor with weights that sum to 1 every block gets a slot in its window, so each source is always less than one
block away from p / q of the slots, for as long as no source has run out. The schedule repeats after q slots, so one
period is worked out and every further block follows from it by arithmetic. Parts are made so fine that p / q differs
from the target by less than one block until the first source runs out; so the period grows with the blocks up to then,
and one task works it out. Beyond MOST_STEPS (slots times sources) parts stay coarser.

Edge cases: a null source is a source of its own. Null ids sort first. When a source runs out, its later slots stay
empty; no row is dropped or repeated. Repeated rows get places of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A period's schedule has slots + sources rows at most; it is broadcast up to this many sources.
BROADCAST_SOURCES = 20_000
#: A period has this many slots at least; as many as this are broadcast.
LEAST_SLOTS, BROADCAST_SLOTS = 1000, 200_000
#: A fixed odd number (2 ** 32 over the golden ratio).
SPREAD = 2_654_435_761
#: Steps of one period's fold at most.
MOST_STEPS = 200_000_000


def _name(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))


def proportional_weights(docs: DataFrame, *, source_col: str = "source", power: float = 0.5) -> DataFrame:
    """(name, weight): row counts to the given power; below 1 this favours small sources."""
    return docs.groupBy(_name(source_col).alias("name")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))


def _parts(weights: DataFrame) -> DataFrame:
    """(slots, name, share, parts): `weights` with slots, each number of slots for itself."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("slots"))
    return weights.withColumn("share", share).withColumn("parts", F.greatest(F.lit(1), F.floor(F.col("share") * F.col("slots") + 0.5).cast("int")))


def fine_slots(weights: DataFrame, blocks: DataFrame) -> int:
    """The fewest slots (LEAST_SLOTS, doubled) whose rounding stays below one block until a source runs out.

    `blocks` has name and blocks.
    """
    doubled = F.explode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.lit(LEAST_SLOTS) * F.pow(F.lit(2), i)).cast("array<int>"))
    sized = _parts(weights.withColumn("slots", doubled)).join(blocks, "name", "left")
    totals = sized.groupBy("slots").agg(F.sum("parts").alias("q"), F.count(F.lit(1)).alias("n"), F.min(F.col("blocks") / F.col("share")).alias("end"))
    off = F.max(F.abs(F.col("parts") / F.col("q") - F.col("share")) * F.col("end"))
    tried = sized.drop("blocks").join(totals, "slots").groupBy("slots").agg(off.alias("off"), F.first(F.col("q") * F.col("n")).alias("steps")).orderBy("slots").collect()
    within = [r for r in tried if r["slots"] == LEAST_SLOTS or r["steps"] <= MOST_STEPS]
    return next((r["slots"] for r in within if (r["off"] or 0) < 1), within[-1]["slots"] if within else LEAST_SLOTS)


def period(weights: DataFrame, slots: int) -> DataFrame:
    """(name, parts, period, nth, at): the slot of a source's nth block within a period of about `slots` slots."""
    parts = _parts(weights.withColumn("slots", F.lit(slots)))
    one = parts.agg(F.sort_array(F.collect_list(F.struct("name", "parts"))).alias("s"), F.sum("parts").cast("int").alias("q"))
    # a chunk of slots at a time, as an array that grows by one is copied every time
    fold = """aggregate(sequence(0, (q - 1) div 1000),
        named_struct('done', transform(s, x -> 0L), 'chunks', cast(array() as array<array<int>>)),
        (o, c) -> transform(array(aggregate(sequence(cast(c * 1000 as int), cast(least(q, (c + 1) * 1000) - 1 as int)),
            named_struct('done', o.done, 'picks', cast(array() as array<int>)),
            (a, t) -> transform(array(array_min(transform(s, (x, i) -> if(a.done[i] * q div x.parts <= t,
                        cast(((a.done[i] + 1) * q + x.parts - 1) div x.parts as bigint) * size(s) + i, null))) % size(s)),
                    k -> named_struct('done', transform(a.done, (d, i) -> d + if(i = k, 1, 0)), 'picks', array_append(a.picks, cast(k as int))))[0])),
            w -> named_struct('done', w.done, 'chunks', array_append(o.chunks, w.picks)))[0],
        o -> flatten(o.chunks))"""
    slot = one.filter("q > 0").select("s", "q", F.posexplode(F.expr(fold)).alias("at", "i"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("at")) - 1
    return slot.select(F.expr("s[i].name").alias("name"), F.expr("s[i].parts").alias("parts"), F.col("q").alias("period"), nth.alias("nth"), "at")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", source_col: str = "source", block: int = 32, slots: int | None = None, chunks: int = 1024) -> DataFrame:
    """All rows and columns of `docs`, and a struct column `mix` (which replaces one of that name) with block, slot and
    place; order by slot, place.

    `weights` has name and weight (as `proportional_weights` gives them). A source's rows are numbered chunk by chunk
    (a hash of the id, modulo `chunks`), so a hot source is numbered by many tasks. Without `slots` they are as many as
    `fine_slots` finds.
    """
    weights = proportional_weights(docs, source_col=source_col) if weights is None else weights
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    # the upper bits of a product, so that ids in steps of any size are spread
    spread = F.floor(F.pmod(F.col(id_col).cast("long"), F.lit(1 << 31)) * F.lit(SPREAD) / F.lit(1 << 22)) if whole else F.xxhash64(id_col)
    rows = docs.withColumns({"__name": _name(source_col), "__chunk": F.coalesce(F.pmod(spread, F.lit(chunks)), F.lit(0)).cast("int")})
    counts = rows.groupBy("__name", "__chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__name").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__name", "__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    nth = F.row_number().over(Window.partitionBy("__name", "__chunk").orderBy(id_col)) - 1
    numbered = rows.withColumn("__nth", nth).join(first, ["__name", "__chunk"]).withColumn("__nth", F.col("__nth") + F.col("__first"))
    numbered = numbered.withColumn("__block", F.floor(F.col("__nth") / block))
    if slots is None:
        slots = fine_slots(weights, counts.groupBy(F.col("__name").alias("name")).agg(F.ceil(F.sum("n") / block).alias("blocks")))
    plan = period(weights, slots)
    sizes = plan.select(F.col("name").alias("__name"), F.col("parts").alias("__parts"), F.col("period").alias("__period")).distinct()
    small = weights.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else lambda d: d
    numbered = numbered.join(hint(sizes), "__name").withColumn("__in_period", F.pmod(F.col("__block"), F.col("__parts")).cast("int"))
    few = hint if slots <= BROADCAST_SLOTS else lambda d: d
    out = numbered.join(few(plan.select(F.col("name").alias("__name"), F.col("nth").alias("__in_period"), F.col("at").alias("__at"))), ["__name", "__in_period"])
    slot = F.floor(F.col("__block") / F.col("__parts")) * F.col("__period") + F.col("__at")
    made = F.struct(F.col("__block").alias("block"), slot.alias("slot"), F.pmod(F.col("__nth"), F.lit(block)).cast("long").alias("place"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"], made.alias("mix"))
