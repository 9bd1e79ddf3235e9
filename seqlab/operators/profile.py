"""Column profile, pairwise class-split 2-D counts and standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: name, Spark type, non-null count (A25).  One scan."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    types = dict(df.dtypes)
    parts = ", ".join(f"'{c}', '{types[c]}', _c{i}" for i, c in enumerate(df.columns))
    return counts.selectExpr(f"stack({len(df.columns)}, {parts}) as (column_name, data_type, non_null)")


def pair_counts(df: DataFrame, features: Sequence[str], cls: str, n_bins: int = 10) -> DataFrame:
    """For every feature pair, counts per (x bin, y bin, class) on equal-width bins over each
    feature's [min, max] (A24).  Edges are those of ``uniform_bin``.  A null class is a class of its
    own; a null or NaN feature has the null bin.

    One aggregate gives the bounds, one row.  A task then adds its Arrow batches up in a dense count
    vector per class, ``pairs * (n_bins + 1)**2`` numbers whatever its rows, and hands on the cells
    that are not zero; a sum per cell merges the tasks.  No record is copied per pair."""
    values = [F.col(f).cast("double") for f in features]
    seen = [F.when(~F.isnan(v), v) for v in values]
    bounds = df.agg(*[x for i, v in enumerate(seen) for x in (F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"))]).first()
    limits = [(bounds[2 * i], bounds[2 * i + 1]) for i in range(len(features))]
    src = df.select(F.col(cls).alias("cls"), *[F.coalesce(v, F.lit(float("nan"))).alias(f"x{i}") for i, v in enumerate(values)])
    pairs, side = list(combinations(range(len(features)), 2)), n_bins + 1

    def bins(x, lo, hi):
        import numpy as np

        if lo is None or lo == hi:
            return np.where(np.isnan(x), n_bins, 0)
        inner = np.arange(1, n_bins) * ((hi - lo) / float(n_bins)) + lo
        return np.where(np.isnan(x), n_bins, np.searchsorted(inner, x, side="right"))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        totals, kind = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            code, classes = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            at = [bins(batch.column(1 + i).to_numpy(), lo, hi) for i, (lo, hi) in enumerate(limits)]
            cells = len(classes) * side * side
            for p, (a, b) in enumerate(pairs):
                found = np.bincount((code * side + at[a]) * side + at[b], minlength=cells).reshape(len(classes), -1)
                for value, row in zip(classes, found):
                    totals.setdefault(value, np.zeros((len(pairs), side * side), np.int64))[p] += row
        for value, n in totals.items():
            pair, cell = np.nonzero(n)
            columns = [pa.array([value] * len(pair), kind), pa.array(pair.astype(np.int32)),
                       pa.array((cell // side).astype(np.int32)), pa.array((cell % side).astype(np.int32)), pa.array(n[pair, cell])]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "pair", "x_bin", "y_bin", "n"])

    cells = src.mapInArrow(count, f"cls {src.schema['cls'].dataType.simpleString()}, pair int, x_bin int, y_bin int, n long")
    merged = cells.groupBy("pair", "x_bin", "y_bin", "cls").agg(F.sum("n").alias("n"))
    names = [F.array(*[F.lit(features[pair[k]]) for pair in pairs])[F.col("pair")] for k in (0, 1)]
    bin_or_null = [F.when(F.col(c) < n_bins, F.col(c)).alias(c) for c in ("x_bin", "y_bin")]
    return merged.select(names[0].alias("x_col"), names[1].alias("y_col"), *bin_or_null, "cls", "n")


def standardize(df: DataFrame, features: Sequence[str], suffix: str = "") -> DataFrame:
    """``(x - mean) / std`` with the population std; a constant column becomes 0 (M1).

    ``pyspark.ml.feature.StandardScaler`` divides by the sample std, so the
    statistics come from one aggregate instead."""
    st = F.broadcast(df.agg(*[x for f in features
                              for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))]))
    out = df.crossJoin(st)
    for f in features:
        z = F.when(F.col(f"_s_{f}") == 0, F.lit(0.0)).otherwise((F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}"))
        out = out.withColumn(f + suffix, z)
    return out.drop(*[f"_{k}_{f}" for f in features for k in ("m", "s")])
