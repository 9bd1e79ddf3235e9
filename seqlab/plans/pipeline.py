"""The cleaning chain (O4): read -> sections -> select -> null drop -> dedup ->
[MAD] -> [isolation forest] -> not-empty check, each step switchable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.operators import clean as C
from seqlab.operators.sections import add_sections
from seqlab.session import materialize


@dataclass
class CleanConfig:
    features: Sequence[str]
    label: str
    pos: str
    tie: str
    site_features: Sequence[str] = ()
    add_sections: bool = True
    ascending: bool = True
    remove_duplicates: bool = True
    outlier_feature: str | None = None
    remove_outliers_uni: bool = False
    univariate_threshold: float = 3.0
    remove_outliers_multi: bool = False
    multivariate_threshold: float = 0.5
    n_trees: int = 100
    seed: int = 42
    keep: Sequence[str] = field(default_factory=tuple)


def clean(df: DataFrame, cfg: CleanConfig, counter: C.StageCounter | None = None,
          check_not_empty: bool = True) -> DataFrame:
    """Run the chain; ``counter`` records rows after each stage."""
    def track(name: str, d: DataFrame) -> DataFrame:
        return counter.track(name, d) if counter is not None else d

    d = track("loaded", df)
    cols = [*cfg.keep, cfg.pos, cfg.tie, *cfg.site_features, *cfg.features, cfg.label]
    if cfg.add_sections:
        d = add_sections(d, cfg.label, cfg.pos, cfg.tie, "section", ascending=cfg.ascending)
        cols.append("section")
    d = track("selected", C.choose_columns(d, cols))
    d = track("nulls_dropped", C.drop_missing(d))
    if cfg.remove_duplicates:
        pos_order = F.col(cfg.pos) if cfg.ascending else -F.col(cfg.pos)
        d = track("duplicates_dropped", C.dedup_first(d, list(cfg.features), [pos_order, F.col(cfg.tie)]))
    if cfg.remove_outliers_uni and cfg.outlier_feature:
        # The MAD step reads its input in four jobs (two exact medians); cut the
        # lineage once instead of recomputing sections and dedup for each.
        d = materialize(d)
        d = track("univariate_outliers_dropped",
                  C.remove_outliers_mad(d, cfg.outlier_feature, cfg.univariate_threshold))
    if cfg.remove_outliers_multi:
        from seqlab.operators.iforest import remove_outliers_iforest
        d = track("multivariate_outliers_dropped",
                  remove_outliers_iforest(d, list(cfg.features), cfg.multivariate_threshold, cfg.tie,
                                          n_trees=cfg.n_trees, seed=cfg.seed))
    if check_not_empty and counter is not None:
        # A one-row probe would be the action that the counts report: run the chain in full, then read them.
        d = materialize(d)
        if not counter.rows()[-1][3]:
            raise ValueError("DataFrame is empty after preprocessing")
    elif check_not_empty:
        C.require_rows(d)
    return d
