"""Cleaning steps: projection, null drop, keep-first dedup, rename, MAD outliers,
row-count tracking and the not-empty guard (P3-P6, P15, P16, O1, O3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from seqlab.operators.stats import exact_quantiles
from seqlab.session import materialize


def choose_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projection in the given order (P3); Catalyst prunes the scan to these."""
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any column, or a NaN in any floating column."""
    cols = list(columns or df.columns)
    cond = F.lit(True)
    types = dict(df.dtypes)
    for c in cols:
        col = F.col(f"`{c}`")
        cond = cond & col.isNotNull()
        if types.get(c) in ("double", "float"):
            cond = cond & ~F.isnan(col)
    return df.where(cond)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every ``keys`` group in ``order`` (P5).

    An aggregate (``min_by`` over the row) rather than a window: Spark combines
    map-side, so only one row per key and partition crosses the shuffle.
    ``order`` must decide between rows that differ in any column.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    first = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select(*[F.col(f"`{k}`") for k in keys], *[F.col("_row")[c].alias(c) for c in others]) \
        .select(*[F.col(f"`{c}`") for c in df.columns])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Bulk rename; names not in the frame are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def mad_scores(df: DataFrame, col: str) -> tuple[DataFrame, float, float]:
    """Modified z-score ``0.6745 * |x - median| / MAD`` (O1).

    MAD = 0: a zero deviation scores 0 (kept), any other scores +inf (dropped).
    Both medians are exact, selected by counting: no row is sorted or shuffled.
    """
    (med,) = exact_quantiles(df, col, [0.5])
    (mad,) = exact_quantiles(df.select(F.abs(F.col(col) - F.lit(med)).alias("_dev")), "_dev", [0.5])
    d = F.abs(F.col(col) - F.lit(med))
    score = (F.when(F.lit(mad) == 0, F.when(d == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))
             .otherwise(F.lit(0.6745) * d / F.lit(mad if mad else 1.0)))
    return df.withColumn("mad_score", score), med, mad


def remove_outliers_mad(df: DataFrame, col: str, threshold: float = 3.0) -> DataFrame:
    """Drop rows whose modified z-score exceeds ``threshold`` (O1)."""
    scored, _, _ = mad_scores(df, col)
    return scored.where(F.col("mad_score") <= F.lit(threshold)).drop("mad_score")


def outlier_share(flagged: DataFrame, flag: str) -> DataFrame:
    """Total rows, outliers and their share (O3)."""
    return flagged.agg(F.count(F.lit(1)).alias("n_total"),
                       F.count_if(F.col(flag) == 1).alias("n_outliers"),
                       F.coalesce(F.try_divide(F.count_if(F.col(flag) == 1).cast("double"),
                                               F.count(F.lit(1))), F.lit(0.0)).alias("outlier_share"))


class StageCounter:
    """Row counts in and out of each pipeline stage without extra scans.

    Each stage's output gets a ``DataFrame.observe`` metric; the counts arrive
    with whatever action finally runs the plan.  Use it on a sibling session
    (``spark.newSession()``): on Spark 4.1, once a session has served an
    observation, some ``pyspark.ml`` closures built on it fail to serialise.
    """

    def __init__(self) -> None:
        self._obs: list[tuple[str, Observation]] = []

    def track(self, name: str, df: DataFrame) -> DataFrame:
        obs = Observation(f"rows_{len(self._obs)}_{name}")
        self._obs.append((name, obs))
        return df.observe(obs, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[int, str, int | None, int]]:
        out, prev = [], None
        for i, (name, obs) in enumerate(self._obs):
            n = obs.get["rows"]
            out.append((i, name, prev, n))
            prev = n
        return out


def require_rows(df: DataFrame, what: str = "DataFrame") -> DataFrame:
    """Raise when ``df`` is empty (P16); reads at most one row."""
    if not df.take(1):
        raise ValueError(f"{what} is empty after preprocessing")
    return df


def is_floating(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (DoubleType, FloatType))
