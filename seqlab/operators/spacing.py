"""Spacing, gaps and coverage along the position axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions.exprs import safe_div
from seqlab.operators.order import global_rank, ordered_scan, plan_blocks
from seqlab.operators.stats import exact_quantiles, histogram
from seqlab.session import materialize

def _dlit(v: float | None) -> str:
    """Exact SQL double literal (repr round-trips)."""
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST('{float(v)!r}' AS DOUBLE)"


# Fixed percentile list of the spacing report, in percent.
SPACING_PERCENTILES = [50, 75, 90, 95, 99, 99.5, 99.9]


def with_spacing(df: DataFrame, pos: str, tie: str, **scan_kw) -> DataFrame:
    """Add ``prev_<pos>``, ``prev_<tie>`` and ``diff = pos - prev pos``."""
    out = ordered_scan(df, pos, tie, lags=[pos, tie], **scan_kw)
    return out.withColumn("diff", F.col(pos) - F.col(f"prev_{pos}"))


def gaps(spaced: DataFrame, pos: str, threshold: float) -> DataFrame:
    """Consecutive pairs further apart than ``threshold`` (strictly)."""
    return (spaced.where(F.col("diff") > F.lit(threshold))
            .select(F.col(f"prev_{pos}").alias("gap_start"), F.col(pos).alias("gap_end"),
                    F.col("diff").alias("gap_length")))


def segments(df: DataFrame, pos: str, tie: str, threshold: float, value: str, **scan_kw) -> DataFrame:
    """Segment id (running count of gaps) per row plus one separator row after each gap start.

    Separator rows carry the gap start's (pos, tie), ``is_separator = 1`` and a
    null value, so ordering by (pos, tie, is_separator) puts them between the
    two rows of the gap.
    """
    def is_gap(cur, prev):
        return (cur(pos) - prev(pos) > F.lit(threshold)).cast("long")

    seg = ordered_scan(df, pos, tie, lags=[pos, tie], steps={"segment": is_gap}, **scan_kw)
    rows = seg.select(F.col(pos), F.col(tie), F.lit(0).alias("is_separator"), F.col(value),
                      F.col("segment"))
    seps = (seg.where(F.col(pos) - F.col(f"prev_{pos}") > F.lit(threshold))
            .select(F.col(f"prev_{pos}").alias(pos), F.col(f"prev_{tie}").alias(tie),
                    F.lit(1).alias("is_separator"), F.lit(None).cast("double").alias(value),
                    (F.col("segment") - 1).alias("segment")))
    return rows.unionByName(seps)


def ecdf(values: DataFrame, col: str, tie: str, **scan_kw) -> DataFrame:
    """Sorted value with ``100 * i / n`` by row number (ties get distinct values)."""
    d = values.where(F.col(col).isNotNull())
    plan = plan_blocks(d, col, tie, **scan_kw)  # also counts the rows
    ranked = global_rank(d, col, tie, name="_i", plan=plan)
    n = plan.n_rows or 1
    return ranked.withColumn("ecdf_pct", F.col("_i") * F.lit(100.0) / F.lit(float(n))).drop("_i")


def spacing_stats(spaced: DataFrame, tie: str | None = None, **scan_kw) -> DataFrame:
    """Count, mean, median, sample std, min, max of the spacings.

    With ``tie`` the median is picked by rank (no value-count map, safe for a
    continuous column of any size); without it Spark's exact ``median``.
    """
    d = spaced.where(F.col("diff").isNotNull())
    if tie is not None:
        (med,) = exact_quantiles(d, "diff", [0.5])
        median = F.lit(med).cast("double")
    else:
        median = F.median("diff")
    return d.agg(F.count("diff").alias("n"), F.avg("diff").alias("mean"),
                 median.alias("median"), F.stddev_samp("diff").alias("std"),
                 F.min("diff").alias("min"), F.max("diff").alias("max"))


def _spacings(spaced: DataFrame, tie: str) -> DataFrame:
    """The (diff, tie) table, checkpointed: the statistics below read it in
    several jobs (quantile plan, rank pick, aggregates), and recomputing the
    ordered scan for each would cost more than writing two narrow columns."""
    return materialize(spaced.where(F.col("diff").isNotNull()).select("diff", tie))


def spacing_percentiles(spaced: DataFrame, tie: str, percents: Sequence[float] = SPACING_PERCENTILES,
                        **scan_kw) -> DataFrame:
    """Each percentile of the spacings with the count strictly above it."""
    d = _spacings(spaced, tie)
    vals = exact_quantiles(d, "diff", [p / 100.0 for p in percents])
    counts = d.agg(*[F.count_if(F.col("diff") > F.lit(v)).alias(f"c{i}") for i, v in enumerate(vals)])
    stack = ", ".join(f"{_dlit(p)}, {_dlit(v)}, c{i}" for i, (p, v) in enumerate(zip(percents, vals)))
    return counts.selectExpr(f"stack({len(vals)}, {stack}) as (percentile, value, n_above)")


# Fixed method labels of the gap-threshold table.
THRESHOLD_METHODS = [
    "Mean + 2*Std", "Mean + 3*Std", "Q3 + 1.5*IQR (Outliers)", "Q3 + 3*IQR (Extreme outliers)",
    "95th percentile", "99th percentile", "99.5th percentile",
]


def gap_thresholds(spaced: DataFrame, tie: str, **scan_kw) -> DataFrame:
    """Seven candidate thresholds with the gaps above each and their total length."""
    d = _spacings(spaced, tie)
    q1, q3, p95, p99, p995 = exact_quantiles(d, "diff", [0.25, 0.75, 0.95, 0.99, 0.995])
    mean, std = d.agg(F.avg("diff"), F.stddev_samp("diff")).first()
    # With no spacing there are no quartiles, with one no deviation: null thresholds, no gaps above them.
    thr = [None if std is None else mean + k * std for k in (2, 3)]
    thr += [None if q1 is None else q3 + k * (q3 - q1) for k in (1.5, 3)] + [p95, p99, p995]
    aggs = []
    for i, t in enumerate(thr):
        aggs += [F.count_if(F.col("diff") > F.lit(t).cast("double")).alias(f"n{i}"),
                 F.coalesce(F.sum(F.when(F.col("diff") > F.lit(t).cast("double"), F.col("diff"))), F.lit(0.0)).alias(f"s{i}")]
    stack = ", ".join(f"'{m}', {_dlit(t)}, n{i}, s{i}" for i, (m, t) in enumerate(zip(THRESHOLD_METHODS, thr)))
    return d.agg(*aggs).selectExpr(
        f"stack({len(thr)}, {stack}) as (method, threshold, n_gaps, total_gap_length)")


def top_gaps(spaced: DataFrame, pos: str, k: int = 20) -> DataFrame:
    """The ``k`` largest spacings with rank and both end positions."""
    top = (spaced.where(F.col("diff").isNotNull())
           .orderBy(F.col("diff").desc(), F.col(pos)).limit(k))
    w = Window.orderBy(F.col("diff").desc(), F.col(pos))  # over k rows only
    return top.select(F.row_number().over(w).alias("gap_rank"), F.col(f"prev_{pos}").alias("gap_start"),
                      F.col(pos).alias("gap_end"), F.col("diff"))


def coverage_summary(spaced: DataFrame, pos: str, tie: str, label: str, threshold: float,
                     **scan_kw) -> DataFrame:
    """Length, gaps, coverage, label counts and estimated label length."""
    small = spaced.where(F.col("diff").isNotNull() & (F.col("diff") <= F.lit(threshold)))
    (median_small,) = exact_quantiles(small, "diff", [0.5])
    med = F.lit(median_small).cast("double")
    total = F.max(pos) - F.min(pos)
    gap_len = F.coalesce(F.sum(F.when(F.col("diff") > F.lit(threshold), F.col("diff"))), F.lit(0.0))
    n1 = F.count_if(F.col(label) == 1)
    return spaced.agg(
        total.alias("total_length"),
        (total - gap_len).alias("data_coverage"),
        safe_div((total - gap_len) * F.lit(100.0), total).alias("coverage_percentage"),
        F.count_if(F.col("diff") > F.lit(threshold)).alias("num_gaps"),
        n1.alias("num_label_points"),
        F.count_if(F.col(label) == 0).alias("num_other_points"),
        F.coalesce(n1 * med, F.lit(0.0)).alias("label_length"),
        F.count(F.lit(1)).alias("num_data_points"),
    )


def box_stats(df: DataFrame, col: str, tie: str, whis: float = 1.5, **scan_kw) -> DataFrame:
    """Quartiles, whiskers (furthest values within whis * IQR) and outlier count."""
    d = df.where(F.col(col).isNotNull()).select(col, tie)
    q1, med, q3 = exact_quantiles(d, col, [0.25, 0.5, 0.75])
    q1, med, q3 = (F.lit(q).cast("double") for q in (q1, med, q3))  # null without rows
    iqr = q3 - q1
    lo_f, hi_f = q1 - whis * iqr, q3 + whis * iqr
    x = F.col(col)
    return d.agg(
        q1.alias("q1"), med.alias("median"), q3.alias("q3"), iqr.alias("iqr"),
        F.min(F.when(x >= lo_f, x)).alias("whisker_low"), F.max(F.when(x <= hi_f, x)).alias("whisker_high"),
        F.count_if((x < lo_f) | (x > hi_f)).alias("n_outliers"),
    )


def truncated_histogram(spaced: DataFrame, tie: str, pct: float = 99.0, n_bins: int = 100,
                        **scan_kw) -> DataFrame:
    """Histogram of the spacings at or below their ``pct`` percentile."""
    d = _spacings(spaced, tie)
    (cut,) = exact_quantiles(d, "diff", [pct / 100.0])
    return histogram(d.where(F.col("diff") <= F.lit(cut)), "diff", n_bins)
