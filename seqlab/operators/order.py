"""Global-order scans without a single-partition window.

A literal ``Window.orderBy(pos)`` with no ``partitionBy`` moves the whole table
to one task.  ``ordered_scan`` instead:

1. cuts the position axis into ``k`` contiguous blocks at approximate quantiles
   (k - 1 numbers reach the driver, never rows).  A position value that holds
   more than one block's worth of rows gets its own block, split further by the
   tie-break id, so a hot value cannot pile up in one task;
2. runs ``lag`` / running sums inside each block (``partitionBy(block)``);
3. summarises each block in one row (first and last row, local totals);
4. carries values across blocks with a window over the k-row summary;
5. joins the carry back (broadcast when k is below a fixed bound, otherwise a
   join co-partitioned with step 2) and fixes the first row of every block.

Results do not depend on k or on the shuffle partitioning.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Accessor = Callable[[str], Column]
StepFn = Callable[[Accessor, Accessor], Column]

DEFAULT_ROWS_PER_BLOCK = 1_000_000
MIN_ROWS_PER_BLOCK = 10_000
# Carry tables up to this many rows are broadcast; the bound is exact because
# the block count is decided on the driver.
BROADCAST_BLOCKS = 100_000

_BLK, _SUB = "_blk", "_sub"


@dataclass
class BlockPlan:
    """Cut points on the position axis plus id cut points for hot positions."""

    cuts: list[float] = field(default_factory=list)
    hot_ids: dict[float, list] = field(default_factory=dict)
    n_rows: int | None = None

    @property
    def max_rows(self) -> int:
        per_hot = max((len(v) + 1 for v in self.hot_ids.values()), default=1)
        return (len(self.cuts) + 1) * per_hot


# Fractions of the first quantile pass: one job yields the row count and a
# 1/1024 quantile grid, from which the cut points of up to 1024 blocks are read.
_GRID = 1024


def plan_blocks(df: DataFrame, pos: str, tie: str, blocks: int | None = None,
                rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> BlockPlan:
    """Decide the block boundaries for ``df`` ordered by ``(pos, tie)``.

    One aggregate returns the row count and a quantile grid; a second quantile
    pass is needed only for more than 1024 blocks (over ~1e9 rows at the
    default block size).
    """
    p = F.col(pos).cast("double")
    grid_fracs = [j / _GRID for j in range(1, _GRID)]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(p, grid_fracs, 10_000).alias("q")).first()
    n, grid = row["n"], [q for q in (row["q"] or [])]
    if blocks is None:
        blocks = max(1, math.ceil(n / rows_per_block))
        parallel = df.sparkSession.sparkContext.defaultParallelism
        blocks = max(blocks, min(parallel, n // MIN_ROWS_PER_BLOCK))
    if blocks <= 1 or n == 0:
        return BlockPlan(n_rows=n)
    accuracy = max(10_000, 8 * blocks)
    if blocks <= _GRID and len(grid) == _GRID - 1:
        qs = [grid[min(max(round(i * _GRID / blocks), 1), _GRID - 1) - 1] for i in range(1, blocks)]
    else:
        fracs = [i / blocks for i in range(1, blocks)]
        qs = df.agg(F.percentile_approx(p, fracs, accuracy)).first()[0] or []
    qs = [q for q in qs if q is not None]
    mult = Counter(qs)
    hot = sorted(v for v, c in mult.items() if c >= 2)
    cuts = set(qs) | {math.nextafter(h, math.inf) for h in hot}
    plan = BlockPlan(cuts=sorted(cuts), n_rows=n)
    if hot:
        m = max(mult[h] for h in hot)
        sub_fracs = [j / (m + 1) for j in range(1, m + 1)]
        rows = (df.where(p.isin(hot))
                .groupBy(p.alias("_p"))
                .agg(F.percentile_approx(F.col(tie), sub_fracs, accuracy).alias("_q"))
                .collect())
        plan.hot_ids = {r["_p"]: sorted(set(r["_q"])) for r in rows}
    return plan


def assign_blocks(df: DataFrame, pos: str, tie: str, plan: BlockPlan) -> DataFrame:
    """Add ``_blk`` (count of cuts <= pos, by binary search) and ``_sub``."""
    if not plan.cuts:
        return df.withColumn(_BLK, F.lit(0)).withColumn(_SUB, F.lit(0))
    bucketizer = Bucketizer(splits=[-math.inf, *plan.cuts, math.inf],
                            inputCol="_pos_d", outputCol="_blk_d")
    keyed = bucketizer.transform(df.withColumn("_pos_d", F.col(pos).cast("double")))
    keyed = keyed.withColumn(_BLK, F.col("_blk_d").cast("int"))
    if plan.hot_ids:
        hot_map = F.create_map(*[x for h, ids in plan.hot_ids.items()
                                 for x in (F.lit(h), F.array(*[F.lit(i) for i in ids]))])
        sub = F.when(F.col("_pos_d").isin(list(plan.hot_ids)),
                     F.size(F.filter(F.element_at(hot_map, F.col("_pos_d")),
                                     lambda c: c <= F.col(tie)))).otherwise(F.lit(0))
    else:
        sub = F.lit(0)
    return keyed.withColumn(_SUB, sub.cast("int")).drop("_pos_d", "_blk_d")


def ordered_scan(df: DataFrame, pos: str, tie: str, lags: Iterable[str] = (),
                 steps: Mapping[str, StepFn] | None = None, cur_cols: Iterable[str] = (),
                 row_number: str | None = None, prev_prefix: str = "prev_",
                 plan: BlockPlan | None = None, blocks: int | None = None,
                 rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Previous-row values and inclusive running sums over the order ``(pos, tie)``.

    ``lags``: columns whose previous-row value is added as ``prev_<c>``.
    ``steps``: ``name -> fn(cur, prev)``; ``fn`` builds a numeric Column from the
    current row (``cur(c)``) and the previous row (``prev(c)``, ``c`` in
    ``lags``); ``name`` receives its running sum.  Null steps count as 0.
    ``cur_cols``: extra columns ``fn`` reads through ``cur``.
    ``row_number``: if given, the global 1-based position of each row.
    ``pos`` must be non-null and ``(pos, tie)`` unique.
    """
    lags = list(dict.fromkeys(lags))
    steps = dict(steps or {})
    carried = sorted(set(lags) | set(cur_cols) | {pos, tie})
    if plan is None:
        plan = plan_blocks(df, pos, tie, blocks, rows_per_block)
    keyed = assign_blocks(df, pos, tie, plan)

    w = Window.partitionBy(_BLK, _SUB).orderBy(F.col(pos), F.col(tie))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loc = keyed.withColumn("_rn", F.row_number().over(w))
    for c in lags:
        loc = loc.withColumn(f"_lp_{c}", F.lag(F.col(c)).over(w))

    def cur_local(c: str) -> Column:
        return F.col(c)

    def prev_local(c: str) -> Column:
        if c not in lags:
            raise KeyError(f"step reads prev({c!r}) but {c!r} is not in lags")
        return F.col(f"_lp_{c}")

    for name, fn in steps.items():
        loc = loc.withColumn(f"_lf_{name}", fn(cur_local, prev_local))
    for name in steps:
        loc = loc.withColumn(f"_ls_{name}", F.sum(F.col(f"_lf_{name}")).over(running))

    # One row per block: first and last row (by (pos, tie)) and local totals.
    # Only each block's first and last rows feed the aggregate (the last row
    # holds the block's running totals), so the aggregate never sorts the data.
    # This summary pass is a second read of the input, but Catalyst prunes it to
    # the order and carried columns, so its scan and shuffle are narrow.
    order_key = F.struct(F.col(pos), F.col(tie))
    row_struct = F.struct(*[F.col(c) for c in carried])
    is_last = F.lead(F.lit(1)).over(w).isNull()
    edges = loc.withColumn("_is_last", is_last).where((F.col("_rn") == 1) | F.col("_is_last"))
    summary = edges.groupBy(_BLK, _SUB).agg(
        F.max("_rn").alias("_n"),
        F.min_by(row_struct, order_key).alias("_first"),
        F.max_by(row_struct, order_key).alias("_last"),
        *[F.max_by(F.col(f"_ls_{name}"), order_key).alias(f"_tot_{name}") for name in steps],
    )
    # The summary holds one row per block (bounded by plan.max_rows), so this
    # un-partitioned window is over k rows, not over the data.
    wk = Window.orderBy(_BLK, _SUB)
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn("_pl", F.lag("_last").over(wk))

    def first_acc(c: str) -> Column:
        return F.col("_first")[c]

    def pl_acc(c: str) -> Column:
        return F.col("_pl")[c]

    def null_acc(c: str) -> Column:
        return F.lit(None)

    for name, fn in steps.items():
        carry = carry.withColumn(
            f"_corr_{name}",
            F.coalesce(fn(first_acc, pl_acc), F.lit(0)) - F.coalesce(fn(first_acc, null_acc), F.lit(0)))
        carry = carry.withColumn(
            f"_off_{name}",
            F.coalesce(F.sum(F.coalesce(F.col(f"_tot_{name}"), F.lit(0)) + F.col(f"_corr_{name}"))
                       .over(before), F.lit(0)))
    carry = carry.withColumn("_off_rows", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carry = carry.select(_BLK, _SUB, "_pl", "_off_rows",
                         *[f"_{k}_{name}" for name in steps for k in ("corr", "off")])
    if plan.max_rows <= BROADCAST_BLOCKS:
        carry = F.broadcast(carry)
    # Every block has a carry row, so a left join equals an inner one here.
    out = loc.join(carry, [_BLK, _SUB], "left")

    for c in lags:
        out = out.withColumn(f"{prev_prefix}{c}",
                             F.when(F.col("_rn") == 1, F.col("_pl")[c]).otherwise(F.col(f"_lp_{c}")))
    for name in steps:
        out = out.withColumn(name, F.col(f"_off_{name}") + F.coalesce(F.col(f"_ls_{name}"), F.lit(0))
                             + F.col(f"_corr_{name}"))
    if row_number:
        out = out.withColumn(row_number, F.col("_off_rows") + F.col("_rn"))
    internal = [_BLK, _SUB, "_rn", "_pl", "_off_rows"]
    internal += [f"_lp_{c}" for c in lags]
    internal += [f"_{k}_{name}" for name in steps for k in ("lf", "ls", "corr", "off")]
    return out.drop(*internal)


def global_rank(df: DataFrame, pos: str, tie: str, name: str = "row_idx", descending: bool = False,
                **kw) -> DataFrame:
    """1-based position of each row in the total order ``(pos, tie)``."""
    if descending:
        neg = f"_neg_{pos}"
        ranked = ordered_scan(df.withColumn(neg, -F.col(pos)), neg, tie, row_number=name, **kw)
        return ranked.drop(neg)
    return ordered_scan(df, pos, tie, row_number=name, **kw)
