"""Attach one small result per key to a large table whose keys may be skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cleanloom.functions.text import ref

BROADCAST_ROWS = 200_000
HOT_KEYS = 1_000
SPREAD = 1_024


def attach(
    fact: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    rows: int,
    lookup_rows: int,
    needed: Column,
) -> DataFrame:
    """Left join on null-safe keys; ``lookup`` has one row per key and its ``weight``.

    Rows where ``needed`` is false get nulls. ``rows`` is the number of needed
    rows, ``weight`` how many of them have the key. A small look-up is
    broadcast. Otherwise keys that hold more than 1/HOT_KEYS of the needed rows
    (so at most HOT_KEYS of them) are broadcast; their rows and the rows that
    need nothing are spread by a salt over the shuffle partitions, and only the
    rest is matched by shuffle.
    """
    payload = [c for c in lookup.columns if c not in (*keys, weight)]
    named = lookup.select(*[ref(k).alias(f"__k_{k}") for k in keys], ref(weight).alias("__weight"), F.struct(*map(ref, payload)).alias("__hit"))
    taken = {c.lower() for c in (*fact.columns, *lookup.columns)}
    if any(c.startswith("__") for c in taken):
        # Helper names begin with two underscores; a table that has such names is renamed for the while.
        inner = {c: f"c{i}" for i, c in enumerate(dict.fromkeys((*fact.columns, *lookup.columns)))}
        plain = fact.select(*[ref(c).alias(inner[c]) for c in fact.columns], needed.alias("n"))
        got = attach(plain, lookup.select(*[ref(c).alias(inner[c]) for c in lookup.columns]), [inner[k] for k in keys], inner[weight], rows, lookup_rows, F.col("n"))
        return got.select(*[ref(inner[c]).alias(c) for c in fact.columns], *[ref(inner[c]).alias(c) for c in payload])
    fact = fact.withColumn("__need", needed)
    kept = [ref(c) for c in fact.columns if c != "__need"]
    opened = [F.col("__hit").getField(p).alias(p) for p in payload]
    if lookup_rows <= BROADCAST_ROWS:
        return fact.join(F.broadcast(named), _same(fact, named, keys), "left").select(*kept, *opened)
    limit = max(1, rows // HOT_KEYS)
    hot = named.filter(F.col("__weight") > limit).drop("__weight")
    cold = named.filter(F.col("__weight") <= limit).drop("__weight").withColumn("__zero", F.lit(0).cast("bigint"))
    step = fact.join(F.broadcast(hot), _same(fact, hot, keys), "left").select(*map(ref, fact.columns), F.col("__hit").alias("__hot"))
    settled = F.col("__hot").isNotNull() | ~F.col("__need")
    salt = F.when(settled, 1 + F.pmod(F.xxhash64(*kept), F.lit(SPREAD))).otherwise(0)
    step = step.withColumn("__salt", salt)
    rest = step.join(cold, (step["__salt"] == cold["__zero"]) & _same(step, cold, keys), "left")
    return rest.select(*kept, F.coalesce(F.col("__hot"), F.col("__hit")).alias("__hit")).select(*kept, *opened)


def _same(fact: DataFrame, named: DataFrame, keys: Sequence[str]) -> Column:
    cond = fact["__need"]
    for k in keys:
        cond = cond & ref(k).eqNullSafe(ref(f"__k_{k}"))
    return cond
