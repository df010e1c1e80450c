"""Effective recipes from an event log with undo and reset.

Events of a dataset, in position order: ``apply`` pushes a batch of operations,
``reset`` pushes an empty recipe, ``undo`` takes back the latest push that is
not taken back yet. At most ``undo_levels`` pushes, eight by default, can be
taken back in a row; an undo beyond that does nothing. A batch without operations
is no push.

A dataset may have any number of events, so they are not collected. Three facts
decide everything, and each is a running value of the form
``x -> min(max(x + shift, low), high)``, which composes: how deep undo can go
at an event (forward), and how far later undos reach back (backward). Events
are folded in small groups, the groups in groups, and the running values are
handed down again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cleanloom.plans.lookup import attach
from cleanloom.session import stored

UNDO_LEVELS = 8
FAN = 256
FAR = 1 << 40


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def _fold(items: Column) -> Column:
    """Composition of the steps of one group."""
    start = F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(-FAR).cast("bigint").alias("low"), F.lit(FAR).cast("bigint").alias("high"))
    return F.aggregate(items, start, lambda a, s: F.struct(
        (a["shift"] + s["shift"]).alias("shift"),
        _clamp(a["low"] + s["shift"], s["low"], s["high"]).alias("low"),
        _clamp(a["high"] + s["shift"], s["low"], s["high"]).alias("high")))


def _running(items: Column, start: Column) -> Column:
    """Value before each step of one group."""
    first = F.struct(start.alias("x"), F.array().cast("array<bigint>").alias("before"))
    done = F.aggregate(items, first, lambda a, s: F.struct(
        _clamp(a["x"] + s["shift"], s["low"], s["high"]).alias("x"), F.concat(a["before"], F.array(a["x"])).alias("before")))
    return done["before"]


def running_clamped(steps: DataFrame, group: str, last: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(group, idx, before, *keep): running value before each step, starting at 0; idx is unique in 0..last."""
    if last == 0:
        return steps.select(group, "idx", F.lit(0).cast("bigint").alias("before"), *keep)
    item = F.struct("idx", "shift", "low", "high", *keep)
    packed = steps.groupBy(group, F.floor(F.col("idx") / FAN).alias("pack")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most FAN items
    folded = packed.select(group, F.col("pack").alias("idx"), _fold(F.col("items")).alias("f")).select(group, "idx", "f.*")
    above = running_clamped(folded, group, last // FAN).select(group, F.col("idx").alias("pack"), F.col("before").alias("start"))
    inside = packed.join(above, [group, "pack"]).withColumn("befores", _running(F.col("items"), F.col("start")))
    opened = inside.select(group, F.explode(F.arrays_zip("items", "befores")).alias("z"))
    return opened.select(group, F.col("z.items.idx").alias("idx"), F.col("z.befores").alias("before"), *[F.col(f"z.items.{c}").alias(c) for c in keep])


def effective_events(log: DataFrame, group: str = "dataset_id", undo_levels: int = UNDO_LEVELS) -> DataFrame:
    """Apply events that are still in force; ``position`` is a unique integer >= 0 per group."""
    filled = F.coalesce(F.size(F.from_json("ops", "array<string>")), F.lit(0)) > 0
    log = log.where((F.col("event") != "apply") | filled)
    last = log.agg(F.max("position")).first()[0] or 0

    def const(x: int) -> Column:
        return F.lit(x).cast("bigint")

    push = F.when(F.col("event") == "undo", -1).otherwise(1).cast("bigint")
    steps = log.select(group, F.col("position").cast("bigint").alias("idx"), push.alias("shift"), const(0).alias("low"), const(undo_levels).alias("high"), "event")
    # Each running value reads its input several times, so the narrow results are stored once.
    depth = stored(running_clamped(steps, group, last, ("event",)), "depth")
    # An undo without anything to take back does nothing.
    shift = F.when(F.col("event") != "undo", 1).when(F.col("before") > 0, -1).otherwise(0).cast("bigint")
    # Backwards: how far the later events reach below their start; a push survives if they do not.
    back = depth.select(group, (const(last) - F.col("idx")).alias("idx"), shift.alias("shift"), const(-FAR).alias("low"), const(0).alias("high"), "event")
    reach = running_clamped(back, group, last, ("event",)).filter((F.col("event") != "undo") & (F.col("before") == 0))
    alive = stored(reach.select(group, (const(last) - F.col("idx")).alias("position"), "event"), "alive")
    resets = alive.groupBy(group).agg(
        F.coalesce(F.max(F.when(F.col("event") == "reset", F.col("position"))), F.lit(-1)).alias("last_reset"), F.count(F.lit(1)).alias("weight"))
    size = resets.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rows")).first()
    joined = attach(alive, resets, [group], "weight", size.rows or 0, size.n, F.lit(True))
    inforce = joined.filter((F.col("event") == "apply") & (F.col("position") > F.col("last_reset"))).select(group, "position")
    return log.join(inforce, [group, "position"], "left_semi")


def effective_recipe(log: DataFrame, group: str = "dataset_id", undo_levels: int = UNDO_LEVELS) -> DataFrame:
    """Operations in force: (group, position, step, op); recipe order is position, then step."""
    ops = F.from_json("ops", "array<string>")
    return effective_events(log, group, undo_levels).select(group, "position", F.posexplode(ops).alias("step", "op"))
