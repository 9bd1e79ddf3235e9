"""Fixed-grid binning (A6) and axis re-basing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebase_axis(df: DataFrame, pos: str, out: str) -> DataFrame:
    """``t = pos - min``; ``out = -(t - max(t))``, i.e. distance from the far end.

    The two-step arithmetic is kept so results are bit-identical to doing it in
    that order.  The one-row min/max table is broadcast (J4).
    """
    mm = F.broadcast(df.agg(F.min(pos).alias("_mn"), F.max(pos).alias("_mx")))
    t = F.col(pos) - F.col("_mn")
    return (df.crossJoin(mm).withColumn(out, -(t - (F.col("_mx") - F.col("_mn"))))
            .drop("_mn", "_mx"))


def grid_cells(df: DataFrame, pos: str, width: float, features: Sequence[str], label: str | None) -> DataFrame:
    """Mean of every feature, rounded mean label, row count and edges per grid cell; empty cells kept.

    Edges follow numpy ``arange(min, max, width)``: ``e_i = min + i * dl`` with
    ``dl = (min + width) - min`` and ``ceil((max - min) / width)`` edges, so
    ``edges - 1`` cells ``[e_i, e_(i+1))``; rows at or past the last edge are
    dropped.  The label mean of a cell is rounded half to even.
    """
    mn, mx = df.agg(F.min(pos), F.max(pos)).first()
    if mn is None:
        raise ValueError("empty input")
    dl = (mn + width) - mn
    n_cells = max(math.ceil((mx - mn) / width) - 1, 0)
    x = F.col(pos)
    guess = F.floor((x - F.lit(mn)) / F.lit(dl))
    edge = lambda i: F.lit(mn) + i.cast("double") * F.lit(dl)
    cell = (F.when(x < edge(guess), guess - 1).when(x >= edge(guess + 1), guess + 1).otherwise(guess))
    binned = df.withColumn("cell", cell).where((F.col("cell") >= 0) & (F.col("cell") < n_cells))
    aggs = [F.avg(f).alias(f) for f in features]
    if label is not None:
        aggs.append(F.bround(F.avg(F.col(label).cast("double")), 0).alias(label))
    aggs.append(F.count(F.lit(1)).alias("n_dp"))
    per_cell = binned.groupBy("cell").agg(*aggs)
    grid = (df.sparkSession.range(n_cells).withColumnRenamed("id", "cell")
            .withColumn("bin_start", F.lit(mn) + F.col("cell").cast("double") * F.lit(dl))
            .withColumn("bin_stop", F.lit(mn) + (F.col("cell") + 1).cast("double") * F.lit(dl)))
    return (grid.join(per_cell, "cell", "left")
            .withColumn("n_dp", F.coalesce(F.col("n_dp"), F.lit(0))))
