"""Exact order statistics and equal-width histograms.

Exact percentiles are selected by counting between bracketing values, so nothing is sorted and
memory does not grow with distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DRIVER_VALUES = 50_000


def exact_quantiles(df: DataFrame, col: str, ps: Sequence[float], most: int = DRIVER_VALUES, accuracy: int = 10_000) -> list[float | None]:
    """Linear-interpolated quantiles (numpy ``percentile`` default) of non-null ``col``, selected by counting.

    ``ps`` are fractions in [0, 1].  No row is sorted or shuffled: mergeable quantile sketches bracket each wanted rank, and an
    aggregate counts the values inside the brackets and the rows between them: two jobs.  Where the brackets would hold over ``most`` values
    they are narrowed first (each time by about ``accuracy / 4``), so at most ``most`` values per quantile reach the driver.
    """
    if not ps:
        return []
    x = F.col(col)
    d = df.where(x.isNotNull() & ~F.isnan(x)).select(col)
    slack = 2.0 / accuracy
    around = [min(max(p + s, 0.0), 1.0) for p in ps for s in (-slack, slack)]
    n, least, greatest, cuts = d.agg(F.count(F.lit(1)), F.min(x), F.max(x), F.percentile_approx(x, around, accuracy)).first()
    if not n:
        return [None for _ in ps]
    ranks = [(n - 1) * p for p in ps]  # from 0
    # The bracket of each quantile: least and greatest value.  A small table is one bracket.
    brackets = [(cuts[2 * i], cuts[2 * i + 1]) for i in range(len(ps))] if n > most else [(least, greatest)] * len(ps)
    if n > most and len(ps) * 4 * n / accuracy > most:
        brackets = _narrowed(d, x, n, ranks, brackets, most, accuracy)
    found = _values_at(d, x, ranks, brackets)
    if found is None:  # a sketch was off
        found = _values_at(d, x, ranks, _narrowed(d, x, n, ranks, brackets, most, accuracy))
    return [found[math.floor(h)] + (found[math.ceil(h)] - found[math.floor(h)]) * (h - math.floor(h)) for h in ranks]


def _values_at(d: DataFrame, x: Column, ranks: Sequence[float], brackets: list[tuple]) -> dict | None:
    """Rank -> value, from one aggregate: the values inside the brackets with their counts, and how many rows lie between them.

    None where a rank lies outside the brackets.
    """
    edges = sorted({e for b in brackets for e in b})
    place = reduce(lambda u, v: u + v, [(x > F.lit(e)).cast("int") for e in edges])
    value = F.when(reduce(lambda u, v: u | v, [(x >= F.lit(lo)) & (x <= F.lit(hi)) for lo, hi in set(brackets)]), x)
    groups = d.groupBy(place.alias("place"), value.alias("value")).count().collect()
    found, seen = {}, 0
    wanted = sorted({r for h in ranks for r in (math.floor(h), math.ceil(h))})
    for _, v, c in sorted(groups, key=lambda g: (g[0], g[1] is not None, g[1] or 0)):  # rows between brackets come before the edge above them
        if v is not None:
            found.update({r: v for r in wanted if seen <= r < seen + c})
        seen += c
    return found if len(found) == len(wanted) else None


def _narrowed(d: DataFrame, x: Column, n: int, ranks: Sequence[float], brackets: list[tuple], most: int, accuracy: int) -> list[tuple]:
    """Brackets of at most ``most`` rows each, or of a few values that have more."""
    inside = lambda b: (x >= F.lit(b[0])) & (x <= F.lit(b[1])) if b else F.lit(True)
    done: set[int] = set()
    while True:
        counts = d.agg(*[F.count_if(c) for b in brackets for c in (x < F.lit(b[0]), inside(b))]).first()
        below, held = counts[0::2], counts[1::2]
        missed = [i for i, h in enumerate(ranks) if not below[i] <= math.floor(h) <= math.ceil(h) < below[i] + held[i]]
        wide = [i for i in range(len(ranks)) if i not in missed and i not in done and held[i] > most and brackets[i][0] != brackets[i][1]]
        if not missed and not wide:
            return brackets
        # Finer next time: over all rows where a sketch was off, over those of the bracket where that is still wide.
        accuracy = min(4 * accuracy, (1 << 31) - 1)
        spans = {i: ((), 0, n) if i in missed else (brackets[i], below[i], held[i]) for i in (*missed, *wide)}
        shares = {i: [min(max((r - low) / max(m - 1, 1) + s / accuracy, 0.0), 1.0) for r, s in ((math.floor(ranks[i]), -2.0), (math.ceil(ranks[i]), 2.0))]
                  for i, (_, low, m) in spans.items()}
        found = d.agg(*[F.percentile_approx(F.when(inside(span), x), shares[i], accuracy) for i, (span, *_) in spans.items()]).first()
        for i, q in zip(spans, found):
            if i in wide and tuple(q) == brackets[i]:
                done.add(i)  # a few values with many rows each
            brackets[i] = tuple(q)


def uniform_bin(x: Column, lo: Column, hi: Column, n_bins: int) -> Column:
    """Bin 0..n-1 of ``x`` on ``n`` equal bins of [lo, hi]; the last bin is closed.

    Edges are ``lo + i * step`` (last edge = hi), as numpy builds them; a first
    guess by scaling is corrected against those edges so that edge values land
    where a search over the edges would put them.
    """
    step = (hi - lo) / F.lit(float(n_bins))
    norm = F.lit(float(n_bins)) / (hi - lo)
    guess = F.least(F.floor((x - lo) * norm).cast("int"), F.lit(n_bins - 1))

    def edge(i: Column) -> Column:
        return F.when(i >= n_bins, hi).otherwise(i.cast("double") * step + lo)

    fixed = (F.when(x < edge(guess), guess - 1)
             .when((x >= edge(guess + 1)) & (guess != n_bins - 1), guess + 1)
             .otherwise(guess))
    return F.when(hi == lo, F.lit(0)).otherwise(fixed)


def uniform_bin_sql(x: str, lo: str, hi: str, n_bins: int) -> str:
    """The same rule as ``uniform_bin`` in SQL (for oracles)."""
    step = f"(({hi} - {lo}) / {float(n_bins)})"
    guess = f"least(cast(floor(({x} - {lo}) * ({float(n_bins)} / ({hi} - {lo}))) as integer), {n_bins - 1})"

    def edge(i: str) -> str:
        return f"(case when {i} >= {n_bins} then {hi} else cast({i} as double) * {step} + {lo} end)"
    return (f"(case when {hi} = {lo} then 0 when {x} < {edge(guess)} then {guess} - 1 "
            f"when {x} >= {edge(guess + ' + 1')} and {guess} <> {n_bins - 1} then {guess} + 1 "
            f"else {guess} end)")


def histogram(df: DataFrame, col: str, n_bins: int, cls: str | None = None,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] of ``col`` (or given bounds), every bin listed.

    With ``cls`` (0/1) the two classes are counted on the same edges.
    Columns: bin, bin_lo, bin_hi, n, [n_class_1, n_class_0], density.
    """
    d = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))
    bounds = d.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    if lo is not None:
        bounds = bounds.withColumn("_lo", F.lit(float(lo)))
    if hi is not None:
        bounds = bounds.withColumn("_hi", F.lit(float(hi)))
    bounds = F.broadcast(bounds)  # one row
    binned = d.crossJoin(bounds).withColumn("bin", uniform_bin(F.col(col), F.col("_lo"), F.col("_hi"), n_bins))
    binned = binned.where((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    aggs = [F.count(F.lit(1)).alias("n")]
    if cls is not None:
        aggs += [F.count_if(F.col(cls) == 1).alias("n_class_1"), F.count_if(F.col(cls) == 0).alias("n_class_0")]
    counts = binned.groupBy("bin").agg(*aggs)
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).crossJoin(bounds)
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_bins))
    out = (grid.join(counts, "bin", "left")
           .withColumn("bin_lo", F.col("bin").cast("double") * step + F.col("_lo"))
           .withColumn("bin_hi", F.when(F.col("bin") == n_bins - 1, F.col("_hi"))
                       .otherwise((F.col("bin") + 1).cast("double") * step + F.col("_lo"))))
    for c in ["n"] + (["n_class_1", "n_class_0"] if cls is not None else []):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    out = out.withColumn("density", F.coalesce(F.try_divide(F.col("n").cast("double"),
                                                            F.col("_n") * step), F.lit(0.0)))
    return out.drop("_lo", "_hi", "_n")


def grouped_exact_quantile(df: DataFrame, by: Sequence[str], col: str, p: float, out: str = "quantile",
                           accuracy: int = 100_000) -> DataFrame:
    """Exact linear-interpolated quantile of ``col`` per group, without a value-count map.

    1. per group: row count and an approximate bracket ``[q(p - 2/acc), q(p + 2/acc)]``;
    2. per group: rows below the bracket and inside it (one aggregate);
    3. only bracket rows are ranked (window per group): about ``4 n / acc`` rows
       for a group of ``n``, so even a group holding a third of the table ranks a
       small slice.  A group whose bracket misses the target ranks falls back to
       ranking the whole group (correct, slower; the approximation's rank error
       bound makes it rare).
    """
    by = list(by)
    work = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))
    if not by:
        work, by = work.withColumn("_g", F.lit(0)), ["_g"]
    lo_p, hi_p = max(p - 2.0 / accuracy, 0.0), min(p + 2.0 / accuracy, 1.0)
    st = work.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                               F.percentile_approx(F.col(col), [lo_p, hi_p], accuracy).alias("_b"))
    st = st.select(*by, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"),
                   ((F.col("_n") - 1).cast("double") * F.lit(p)).alias("_h"))
    st = st.withColumn("_r1", F.floor("_h").cast("long") + 1).withColumn("_r2", F.ceil("_h").cast("long") + 1)
    x = F.col(col)
    cnt = work.join(st, by).groupBy(*by).agg(
        F.count_if(x < F.col("_lo")).alias("_below"),
        F.count_if((x >= F.col("_lo")) & (x <= F.col("_hi"))).alias("_in"))
    st = st.join(cnt, by)
    ok = (F.col("_below") < F.col("_r1")) & (F.col("_r2") <= F.col("_below") + F.col("_in"))
    st = (st.withColumn("_lo", F.when(ok, F.col("_lo")).otherwise(F.lit(float("-inf"))))
          .withColumn("_hi", F.when(ok, F.col("_hi")).otherwise(F.lit(float("inf"))))
          .withColumn("_below", F.when(ok, F.col("_below")).otherwise(F.lit(0))))
    inb = work.join(st, by).where((x >= F.col("_lo")) & (x <= F.col("_hi")))
    ranked = inb.withColumn("_r", F.col("_below") + F.row_number().over(Window.partitionBy(*by).orderBy(x)))
    picked = ranked.where((F.col("_r") == F.col("_r1")) | (F.col("_r") == F.col("_r2"))).groupBy(*by).agg(
        F.max(F.when(F.col("_r") == F.col("_r1"), x)).alias("_v1"),
        F.max(F.when(F.col("_r") == F.col("_r2"), x)).alias("_v2"), F.first("_h").alias("_h"))
    res = picked.select(*by, (F.col("_v1") + (F.col("_v2") - F.col("_v1")) * (F.col("_h") - F.floor("_h")))
                        .alias(out))
    return res.drop("_g") if by == ["_g"] else res
