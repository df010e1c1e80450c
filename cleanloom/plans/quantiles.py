"""Exact order statistics and quantiles of any number of rows.

Small columns use the built-in ``percentile`` in one pass. A column with more
rows is narrowed: an approximate sketch brackets each wanted rank, and one more
pass both proves the brackets by exact counts and stores the few values inside
them. All later steps read those only, so the table is read twice whatever the
number of columns and ranks. The last brackets hold few values, which are
counted per value, all in one tally. No step keeps all distinct values of a
column in one buffer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from cleanloom.session import stored

ONE_PASS_ROWS = 1_000_000
LAST_BRACKET_ROWS = 100_000
SKETCH_ACCURACY = 2_000


@dataclass
class _Bracket:
    """Rows in [lo, hi] contain the sorted positions first..last; ``below`` rows are smaller."""

    column: str
    first: int
    last: int
    lo: float
    hi: float
    below: int
    inside: int

    @property
    def done(self) -> bool:
        return self.lo == self.hi or self.inside <= LAST_BRACKET_ROWS


def counts(df: DataFrame, values: Mapping[str, Column]) -> dict[str, int]:
    row = df.agg(*[F.count(c).alias(n) for n, c in values.items()]).first()
    return {n: row[n] for n in values}


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Sequence[float],
    sizes: Mapping[str, int] | None = None,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles at index (n - 1) * p; None for a column without values."""
    if not values:
        return {}
    sizes = sizes or counts(df, values)
    small = [n for n in values if 0 < sizes[n] <= ONE_PASS_ROWS]
    out: dict[str, list[float] | None] = {n: None for n in values}
    if small:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(values[n], grid).alias(n) for n in small]).first()
        out.update({n: list(row[n]) for n in small})
    large = {n: values[n] for n in values if sizes[n] > ONE_PASS_ROWS}
    if large:
        ranks = {n: [(sizes[n] - 1) * p for p in probs] for n in large}
        need = {n: sorted({r for x in ranks[n] for r in (math.floor(x), math.ceil(x))}) for n in large}
        found = order_statistics(df, large, need, sizes)
        for n in large:
            out[n] = [_between(found[n], x) for x in ranks[n]]
    return out


def _between(found: Mapping[int, float], index: float) -> float:
    lo, hi = found[math.floor(index)], found[math.ceil(index)]
    return lo if lo == hi else lo + (hi - lo) * (index - math.floor(index))


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    sizes: Mapping[str, int],
) -> dict[str, dict[int, float]]:
    """Values at the given 0-based ascending ranks of each column (nulls ignored)."""
    # Plain names inside, as the values in brackets are stored.
    named = {n: f"c{i}" for i, n in enumerate(values)}
    data = df.select(*[c.cast("double").alias(named[n]) for n, c in values.items()])
    open_ = [_Bracket(named[n], first, last, -math.inf, math.inf, 0, sizes[n]) for n in values for first, last in _runs(ranks[n])]
    while any(not b.done for b in open_):
        data = _narrow(data, open_)
    found = _pick(data, [b for b in open_ if b.lo != b.hi])
    for b in open_:
        if b.lo == b.hi:
            found.update({(b.column, r): b.lo for r in range(b.first, b.last + 1)})
    return {n: {r: found[named[n], r] for r in ranks[n]} for n in values}


def _runs(ranks: Sequence[int]) -> list[tuple[int, int]]:
    """Two neighbouring ranks, as those on both sides of a quantile, share a bracket."""
    out: list[tuple[int, int]] = []
    for r in sorted(set(ranks)):
        if out and out[-1] == (r - 1, r - 1):
            out[-1] = (r - 1, r)
        else:
            out.append((r, r))
    return out


def _within(b: _Bracket) -> Column:
    return F.col(b.column).between(b.lo, b.hi)


def _narrow(data: DataFrame, open_: list[_Bracket]) -> DataFrame:
    """One sketch pass, and one pass that proves the brackets and stores the values inside them.

    Brackets over the same rows share a sketch. Counts are of rows within a bracket, so rows outside all of them may be
    missing from ``data``. Returns the stored values, or ``data`` if the sketch missed a rank.
    """
    brackets, slack = [b for b in open_ if not b.done], 2.0 / SKETCH_ACCURACY
    shared: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        shared.setdefault((b.column, b.lo, b.hi), []).append(b)
    sketches = []
    for i, group in enumerate(shared.values()):
        span = max(group[0].inside - 1, 1)
        grid = [x for b in group for x in (max(0.0, (b.first - b.below) / span - slack), min(1.0, (b.last - b.below) / span + slack))]
        sketches.append(F.percentile_approx(F.when(_within(group[0]), F.col(group[0].column)), grid, SKETCH_ACCURACY).alias(f"s{i}"))
    row = data.agg(*sketches).first()
    guess = {id(b): row[f"s{i}"][2 * j:2 * j + 2] for i, group in enumerate(shared.values()) for j, b in enumerate(group)}
    proofs = []
    for i, b in enumerate(brackets):
        lo, hi = guess[id(b)]
        proofs.append(F.count(F.when(_within(b) & (F.col(b.column) < lo), 1)).alias(f"b{i}"))
        proofs.append(F.count(F.when(_within(b) & (F.col(b.column) <= hi), 1)).alias(f"u{i}"))
    wanted: dict[str, list[Column]] = {}
    for b in open_:
        lo, hi = guess.get(id(b), (b.lo, b.hi))
        if lo != hi:
            wanted.setdefault(b.column, []).append(F.col(b.column).between(lo, hi))
    if wanted:
        # The counts are taken while the values are written, so the columns are computed once for both.
        proof = Observation()
        kept = [F.when(reduce(or_, wanted.get(c, [F.lit(False)])), F.col(c)).alias(c) for c in data.columns]
        inside = stored(data.observe(proof, *proofs).select(*kept).dropna("all"), "brackets")
        counted = proof.get
    else:
        inside, counted = data, data.agg(*proofs).first()
    missed = False
    for i, b in enumerate(brackets):
        lo, hi, below, upto = *guess[id(b)], b.below + counted[f"b{i}"], b.below + counted[f"u{i}"]
        if below > b.first:  # the sketch missed on the left
            lo, below, missed = b.lo, b.below, True
        if upto <= b.last:
            hi, upto, missed = b.hi, b.below + b.inside, True
        if (lo, hi) == (b.lo, b.hi):  # no progress: halve the value range
            open_.extend(_halve(data, b))
        else:
            b.lo, b.hi, b.below, b.inside = lo, hi, below, upto - below
    return data if missed else inside


def _halve(data: DataFrame, b: _Bracket) -> list[_Bracket]:
    """Halve the value range; if its two ranks lie on both sides of the cut, each is found, the second as a new bracket."""
    c = F.when(_within(b), F.col(b.column))
    if math.isinf(b.lo) or math.isinf(b.hi):
        ends = data.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        b.lo, b.hi = ends.lo, ends.hi
        return []
    mid = b.lo + (b.hi - b.lo) / 2
    row = data.agg(
        F.count(F.when(c <= mid, 1)).alias("n"),
        F.max(F.when(c <= mid, c)).alias("left"),
        F.min(F.when(c > mid, c)).alias("right"),
    ).first()
    cut, end = b.below + row.n, b.below + b.inside
    if b.first < cut <= b.last:
        other = _Bracket(b.column, cut, b.last, row.right, row.right, cut, end - cut)
        b.last, b.lo, b.hi, b.inside = cut - 1, row.left, row.left, row.n
        return [other]
    if cut > b.last:
        b.hi, b.inside = row.left, row.n
    else:
        b.lo, b.below, b.inside = row.right, cut, end - cut
    return []


def _pick(data: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Values at the ranks of all brackets, from one tally; a bracket has at most LAST_BRACKET_ROWS rows."""
    if not brackets:
        return {}
    cells = [F.when(_within(b), F.struct(F.lit(i).alias("b"), F.col(b.column).alias("v"))) for i, b in enumerate(brackets)]
    tally = data.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("b", "v").count()
    upto = F.sum("count").over(Window.partitionBy("b").orderBy("v"))
    ends = F.array(*[F.lit(b.first - b.below) for b in brackets]), F.array(*[F.lit(b.last - b.below) for b in brackets])
    first, last = (F.element_at(e, F.col("b") + 1) for e in ends)
    near = tally.withColumn("upto", upto).where((F.col("upto") > first) & (F.col("upto") - F.col("count") <= last))
    out = {}
    for r in near.collect():
        b = brackets[r.b]
        out.update({(b.column, rank): r.v for rank in range(b.first, b.last + 1) if r.upto - r["count"] <= rank - b.below < r.upto})
    return out
