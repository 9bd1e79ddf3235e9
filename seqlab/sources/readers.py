"""Readers (S1-S5) and the stand-in views over the driver tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqlab.functions.exprs import epoch_seconds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | None = None,
             multiline: bool = False) -> DataFrame:
    """CSV with a header (S1).  Pass ``schema`` in production; inference is a profiling step.

    ``multiline`` is needed when a quoted header holds a newline.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def strip_header_blanks(df: DataFrame) -> DataFrame:
    """Remove stray blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def concat_sources(parts: Iterable[tuple[str, DataFrame]], source_col: str = "source") -> DataFrame:
    """Union-all of several inputs of one kind; missing columns become null."""
    out = None
    for name, part in parts:
        tagged = part.withColumn(source_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out


def load_features(df: DataFrame, features: Sequence[str], label: str | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Chosen features, plus the label when present, plus ``keep`` columns.

    The section column belongs in ``keep`` so that grouped folds can see it.
    """
    df = strip_header_blanks(df)
    cols = [*keep, *features]
    if label is not None and label in df.columns:
        cols.append(label)
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(cols)])


# --- stand-ins over the driver tables (FIXTURES.md part 2) -------------------

def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered records: id, pos (epoch seconds), label (error event), value, user_id, event_type."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        epoch_seconds("ts").alias("pos"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("value"), F.col("user_id"), F.col("event_type"),
    )


RECORDS_SQL = (
    "select event_id as id, epoch_us(ts)/1e6 as pos, cast(event_type = 'error' as integer) as label, "
    "value, user_id, event_type from events"
)


def intervals(spark: SparkSession, sf_dir: str, half_width: float = 60.0) -> DataFrame:
    """Interval table: every signup +/- ``half_width`` seconds (start >= end)."""
    ev = read_table(spark, sf_dir, "events")
    p = epoch_seconds("ts")
    return (ev.where(F.col("event_type") == "signup")
            .select(F.col("event_id").alias("interval_id"),
                    (p + F.lit(half_width)).alias("iv_start"), (p - F.lit(half_width)).alias("iv_end")))


def intervals_sql(half_width: float = 60.0) -> str:
    return (f"select event_id as interval_id, epoch_us(ts)/1e6 + {half_width} as iv_start, "
            f"epoch_us(ts)/1e6 - {half_width} as iv_end from events "
            "where event_type = 'signup'")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table: y_true = return flag R, y_pred = discount above 5 %."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                     (F.col("l_discount") > 0.05).cast("int").alias("y_pred"))


PREDICTIONS_SQL = ("select cast(l_returnflag = 'R' as integer) as y_true, "
                   "cast(l_discount > 0.05 as integer) as y_pred from lineitem")
