"""Gaps-and-islands over a binary label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions.exprs import safe_div
from seqlab.operators.order import ordered_scan


def section_start(label: str) -> callable:
    """Step: 1 where the label is 1 and the previous label is not (before the first row = 0)."""
    def fn(cur, prev) -> Column:
        return ((cur(label) == 1) & (F.coalesce(prev(label), F.lit(0)) != 1)).cast("long")
    return fn


def add_sections(df: DataFrame, label: str, pos: str, tie: str, section: str = "section",
                 ascending: bool = True, **scan_kw) -> DataFrame:
    """Number contiguous runs of ``label == 1`` along ``(pos, tie)``: 1, 2, ...; 0 elsewhere."""
    work = df
    order_col = pos
    if not ascending:
        order_col = f"_neg_{pos}"
        work = work.withColumn(order_col, -F.col(pos))
    scanned = ordered_scan(work, order_col, tie, lags=[label],
                           steps={"_starts": section_start(label)}, **scan_kw)
    out = scanned.withColumn(section, F.when(F.col(label) == 1, F.col("_starts")).otherwise(F.lit(0))
                             .cast("long"))
    return out.drop("_starts", f"prev_{label}", *([order_col] if not ascending else []))


def section_sizes(df: DataFrame, section: str = "section") -> DataFrame:
    """Rows per section, sections > 0 only (A3)."""
    return (df.where(F.col(section) > 0).groupBy(section)
            .agg(F.count(F.lit(1)).alias("n_samples")))


def section_stats(sizes: DataFrame, section: str = "section", n: str = "n_samples") -> DataFrame:
    """Count, mean, median, min, max, sample std of section sizes; smallest and largest section (A4).

    Ties on size go to the smaller section id, as a first-occurrence scan over
    id-sorted sizes would.  The median is Spark's exact ``median``: sizes are
    integers, so its value-count map holds at most one entry per distinct size.
    """
    return sizes.agg(
        F.count(F.lit(1)).alias("n_sections"),
        F.avg(n).alias("mean_size"),
        F.median(n).cast("double").alias("median_size"),
        F.min(n).cast("long").alias("min_size"),
        F.max(n).cast("long").alias("max_size"),
        F.stddev_samp(n).alias("std_size"),
        F.min_by(F.col(section), F.struct(F.col(n), F.col(section))).alias("smallest_section"),
        F.min_by(F.col(section), F.struct(-F.col(n), F.col(section))).alias("largest_section"),
    )


def section_report(sizes: DataFrame, section: str = "section", n: str = "n_samples",
                   **scan_kw) -> DataFrame:
    """Size, cumulative rows by section id, % of all label-1 rows (2 decimals) (A5).

    The running sum goes through the block-wise scan: sections can number in the
    millions on a long axis.
    """
    total = sizes.agg(F.sum(n).alias("_total"))
    ranked = ordered_scan(sizes, section, section, steps={"cumulative_samples": lambda cur, prev: cur(n)},
                          cur_cols=[n], **scan_kw)
    return (ranked.crossJoin(F.broadcast(total))
            .withColumn("percentage_of_total", F.round(safe_div(F.col(n) * F.lit(100.0), "_total"), 2))
            .drop("_total"))


def first_section_reaching(report: DataFrame, share: float = 0.75, section: str = "section",
                           cum: str = "cumulative_samples", n: str = "n_samples") -> DataFrame:
    """The first section (by id) whose cumulative rows reach ``share`` of all label-1 rows."""
    total = report.agg(F.sum(n).alias("_total"))
    hit = report.crossJoin(F.broadcast(total)).where(F.col(cum) >= F.lit(share) * F.col("_total"))
    return hit.agg(F.min(section).alias(section), F.min(cum).alias(cum),
                   F.first("_total").alias("total_samples"))


def label_spans(df: DataFrame, pos: str, section: str = "section") -> DataFrame:
    """Contiguous label-1 stretches as (start, end, rows) per section."""
    return (df.where(F.col(section) > 0).groupBy(section)
            .agg(F.min(pos).alias("span_start"), F.max(pos).alias("span_end"),
                 F.count(F.lit(1)).alias("n_samples")))


def size_rank(sizes: DataFrame, section: str = "section", n: str = "n_samples",
              **scan_kw) -> DataFrame:
    """Rank of each section by size, largest first, ties by id."""
    keyed = sizes.withColumn("_neg_n", -F.col(n).cast("double"))
    ranked = ordered_scan(keyed, "_neg_n", section, row_number="size_rank", **scan_kw)
    return ranked.drop("_neg_n")


def n_sections(df: DataFrame, section: str = "section") -> DataFrame:
    """Distinct sections > 0."""
    return df.where(F.col(section) > 0).agg(F.countDistinct(section).alias("n_sections"))
