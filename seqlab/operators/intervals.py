"""Interval labelling and membership.

A row is labelled 1 when any interval covers it, both ends closed.  The
interval table is bucketed onto a grid: every interval is exploded to the grid
cells it touches, every row gets its one cell, and an EXISTS subquery on
(cell equality + range condition) plans as an ExistenceJoin: one output row per
input row, no duplicates from overlapping intervals, no extra shuffle on the id.
Intervals are gridded by length class (powers of four), each with cells as wide
as its longest interval, so one very long interval does not widen the cells of
the short ones; there are as many joins as classes in the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.operators.sampling import is_listed

# Interval tables up to this many exploded rows are broadcast.
BROADCAST_INTERVAL_ROWS = 2_000_000


def label_by_intervals(df: DataFrame, pos: str, iv: DataFrame, start: str, end: str,
                       out: str = "in_interval", strategy: str = "auto", tie: str | None = None,
                       salt: int = 8) -> DataFrame:
    """Add ``out`` = 1 where ``end <= pos <= start`` for any interval, else 0.

    ``start >= end`` as in a descending chainage.  ``strategy``: ``broadcast``
    ships the exploded interval cells to every task (size checked in ``auto``);
    ``shuffle`` co-partitions rows and cells on (cell, salt): rows take a salt
    from a hash of ``tie`` (or of the position) and every cell is copied once
    per salt, so a grid cell holding a large share of the rows is spread over
    ``salt`` tasks.
    """
    ivs = iv.select(F.least(start, end).alias("_iv_lo"), F.greatest(start, end).alias("_iv_hi")) \
        .where(F.col("_iv_lo").isNotNull() & F.col("_iv_hi").isNotNull())
    length = F.col("_iv_hi") - F.col("_iv_lo")
    ivs = ivs.withColumn("_iv_class", F.when(length > 0, F.ceil(F.log(4.0, length))).otherwise(0).cast("int"))
    found = [r["_iv_class"] for r in ivs.select("_iv_class").distinct().orderBy("_iv_class").collect()]  # a few powers
    width = F.pow(F.lit(4.0), F.col("_iv_class"))
    cells = ivs.withColumn("_iv_cell", F.explode(F.sequence(  # an interval is no wider than a cell: one or two of them
        F.floor(F.col("_iv_lo") / width), F.floor(F.col("_iv_hi") / width))))
    if strategy == "auto":
        strategy = "broadcast" if cells.count() <= BROADCAST_INTERVAL_ROWS else "shuffle"
    rows, flag = df, F.lit(0)
    if strategy != "broadcast":
        key = F.col(tie) if tie is not None else F.col(pos)
        rows = rows.withColumn("_row_salt", F.pmod(F.xxhash64(key), F.lit(salt)).cast("int"))
    for n, c in enumerate(found):
        rows = rows.withColumn("_row_cell", F.floor(F.col(pos) / F.lit(4.0 ** c)))
        of = cells.where(F.col("_iv_class") == c)
        cond = F.col("_iv_cell") == F.col("_row_cell").outer()
        if strategy == "broadcast":
            of = F.broadcast(of)
        else:
            of = of.withColumn("_iv_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("shuffle_merge")
            cond = cond & (F.col("_iv_salt") == F.col("_row_salt").outer())
        hit = of.where(cond & (F.col(pos).outer() >= F.col("_iv_lo")) & (F.col(pos).outer() <= F.col("_iv_hi")))
        rows = rows.withColumn(f"_hit_{n}", hit.exists()).drop("_row_cell")
        flag = F.greatest(flag, F.col(f"_hit_{n}").cast("int"))
    return rows.withColumn(out, flag).drop("_row_salt", *[f"_hit_{n}" for n in range(len(found))])


def split_by_membership(df: DataFrame, key: str, train_keys: Sequence, test_keys: Sequence,
                        side: str = "side") -> DataFrame:
    """``side`` = train / test by membership of ``key``; rows in neither list are dropped."""
    lab = F.when(is_listed(key, train_keys), F.lit("train")).when(is_listed(key, test_keys), F.lit("test"))
    return df.withColumn(side, lab).where(F.col(side).isNotNull())
