"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint only after counting: ``df`` (a small aggregate, say one row per
    class) is broadcast when it has at most ``limit`` rows, else joined by shuffle."""
    return F.broadcast(df) if df.count() <= limit else df
