"""Confusion counts, cost-sensitive metrics and fold/trial statistics
(A7-A16, M9, T3-T6).  Everything is one aggregate over the prediction table;
zero denominators give 0 (ANSI-safe ``try_divide``)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions.exprs import safe_div


@dataclass(frozen=True)
class CostMatrix:
    """Cost of each outcome in multiples of one regular advance, and hours per advance."""

    tn: float = 1.0
    fp: float = 10.0
    fn: float = 240.0
    tp: float = 10.0
    time_per_regular_advance: float = 1.0

    def __post_init__(self) -> None:  # P16: complete matrix
        for k in ("tn", "fp", "fn", "tp", "time_per_regular_advance"):
            if getattr(self, k) is None:
                raise ValueError(f"cost matrix misses {k}")


DEFAULT_COSTS = CostMatrix()


def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp; always four numbers, zeros where a cell is empty."""
    t, p = F.col(y_true), F.col(y_pred)
    aggs = [F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
            F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def rates(prefix: str = "") -> list[Column]:
    """Metrics from the tn/fp/fn/tp columns."""
    tn, fp, fn, tp = _c("tn"), _c("fp"), _c("fn"), _c("tp")
    recall = safe_div(tp, tp + fn)
    spec = safe_div(tn, tn + fp)
    precision = safe_div(tp, tp + fp)
    f1 = safe_div(F.lit(2.0) * precision * recall, precision + recall)
    return [
        safe_div(tp + tn, tn + fp + fn + tp).alias(f"{prefix}accuracy"),
        ((recall + spec) / F.lit(2.0)).alias(f"{prefix}balanced_accuracy"),
        recall.alias(f"{prefix}recall"),
        precision.alias(f"{prefix}precision"),
        f1.alias(f"{prefix}f1"),
    ]


def sensitivity_specificity() -> list[Column]:
    tn, fp, fn, tp = _c("tn"), _c("fp"), _c("fn"), _c("tp")
    return [safe_div(tp, tp + fn).alias("sensitivity"), safe_div(tn, tn + fp).alias("specificity")]


def cost_columns(costs: CostMatrix = DEFAULT_COSTS, prefix: str = "") -> list[Column]:
    """Four weighted costs x time, total, and average per row (0 when empty)."""
    m = costs.time_per_regular_advance
    parts = {k: _c(k) * F.lit(getattr(costs, k) * m) for k in ("tn", "fp", "fn", "tp")}
    total = parts["tn"] + parts["fp"] + parts["fn"] + parts["tp"]
    n = _c("tn") + _c("fp") + _c("fn") + _c("tp")
    return [*[v.alias(f"{prefix}{k}_cost") for k, v in parts.items()], total.alias(f"{prefix}total_cost"),
            safe_div(total, n).alias(f"{prefix}average_cost")]


def prediction_costs(df: DataFrame, costs: CostMatrix = DEFAULT_COSTS, y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """Counts plus costs in one row."""
    cm = confusion_counts(df, y_true, y_pred)
    return cm.select("tn", "fp", "fn", "tp", *cost_columns(costs))


def expected_cost(df: DataFrame, costs: CostMatrix = DEFAULT_COSTS, y_true: str = "y_true",
                  y_pred: str = "y_pred") -> DataFrame:
    """Average cost only (A10)."""
    return prediction_costs(df, costs, y_true, y_pred).select("average_cost")


def evaluate(df: DataFrame, costs: CostMatrix = DEFAULT_COSTS, y_true: str = "y_true",
             y_pred: str = "y_pred") -> DataFrame:
    """A11 metrics plus A9 with a ``cost_`` prefix, one row (M9)."""
    cm = confusion_counts(df, y_true, y_pred)
    return cm.select("tn", "fp", "fn", "tp", *rates(), *cost_columns(costs, "cost_"))


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """k x k counts over all classes seen, normalised by true row, predicted column and all.

    One pass over ``df``: its class pairs are counted, and everything else works on those at most k*k counts.
    """
    counts = df.groupBy(F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cells = counts.agg(F.collect_list(F.struct("t", "p", "n")).alias("cells"))
    classes = F.array_sort(F.array_distinct(F.flatten(F.transform("cells", lambda c: F.array(c["t"], c["p"])))))
    grid = cells.select("cells", classes.alias("cs")).select("cells", "cs", F.explode("cs").alias("true_class"))
    grid = grid.select("cells", "true_class", F.explode("cs").alias("pred_class"))
    own = F.filter("cells", lambda c: c["t"].eqNullSafe(F.col("true_class")) & c["p"].eqNullSafe(F.col("pred_class")))
    m = grid.select("true_class", "pred_class", F.coalesce(F.get(own, F.lit(0))["n"], F.lit(0)).cast("long").alias("n"))
    # The grid has k*k rows for k classes, so these windows are over a tiny table.
    row = F.sum("n").over(Window.partitionBy("true_class"))
    col = F.sum("n").over(Window.partitionBy("pred_class"))
    tot = F.sum("n").over(Window.partitionBy())
    return m.select("true_class", "pred_class", "n", safe_div(_c("n"), row).alias("pct_true"),
                    safe_div(_c("n"), col).alias("pct_pred"), safe_div(_c("n"), tot).alias("pct_all"))


def class_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per class precision, recall, F1, support, plus macro and weighted averages (A13), in one pass."""
    cm = confusion_matrix(df, y_true, y_pred)
    support = F.sum("n").over(Window.partitionBy("true_class"))
    per = cm.select("true_class", "pred_class", support.alias("support"), F.col("pct_true").alias("recall"),
                    F.col("pct_pred").alias("precision")).where(F.col("true_class").eqNullSafe(F.col("pred_class")))
    f1 = safe_div(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    per = per.select(F.col("true_class").cast("string").alias("label"), "precision", "recall", "support", f1.alias("f1"))
    rates = ("precision", "recall", "f1")
    w = _c("support")
    one = per.agg(F.collect_list(F.struct("label", "precision", "recall", "support", "f1")).alias("rows"), F.sum("support").alias("support"),
                  *[F.avg(x).alias(f"m_{x}") for x in rates], *[safe_div(F.sum(F.col(x) * w), F.sum(w)).alias(f"w_{x}") for x in rates])

    def average(name: str, p: str) -> Column:
        return F.struct(F.lit(name).alias("label"), F.col(f"{p}_precision").alias("precision"), F.col(f"{p}_recall").alias("recall"),
                        "support", F.col(f"{p}_f1").alias("f1"))
    both = F.array(average("macro avg", "m"), average("weighted avg", "w"))
    return one.select(F.explode(F.concat("rows", both)).alias("r")).select("r.label", "r.precision", "r.recall", "r.support", "r.f1")


FOLD_METRICS = ("average_cost", "accuracy", "balanced_accuracy", "recall", "precision", "f1")


def fold_table(df: DataFrame, setting: str, fold: str, costs: CostMatrix = DEFAULT_COSTS,
               y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row per (setting, fold): counts, cost components per prediction, total and average cost, metrics."""
    cm = confusion_counts(df, y_true, y_pred, by=[setting, fold])
    cm = cm.select(setting, fold, "tn", "fp", "fn", "tp", *cost_columns(costs), *rates())
    size = _c("tn") + _c("fp") + _c("fn") + _c("tp")
    per = {f"{c}_cost": safe_div(F.col(f"{c}_cost"), size).alias(f"{c}_avg_cost") for c in ("tn", "fp", "fn", "tp")}
    return cm.select(*[per.get(c, F.col(c)) for c in cm.columns])


def fold_summary(folds: DataFrame, setting: str, metrics: Sequence[str] = FOLD_METRICS) -> DataFrame:
    """Mean and population std over folds of each metric, plus mean counts."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in ("tn", "fp", "fn", "tp")]
    return folds.groupBy(setting).agg(*aggs)


def study_statistics(trials: DataFrame, model: str, state: str, objective: str) -> DataFrame:
    """Per model: completed / pruned / failed trials, success rate and objective statistics
    (population std) over completed trials (A16).  The median is exact and rank-based
    (no value-count map), so it holds for a model with any number of trials."""
    from seqlab.operators.stats import grouped_exact_quantile

    done = F.col(state) == "COMPLETE"
    obj = F.when(done, F.col(objective))
    stats = trials.groupBy(model).agg(
        F.count_if(done).alias("n_complete"), F.count_if(F.col(state) == "PRUNED").alias("n_pruned"),
        F.count_if(F.col(state) == "FAIL").alias("n_failed"),
        safe_div(F.count_if(done).cast("double"), F.count(F.lit(1))).alias("success_rate"),
        F.avg(obj).alias("objective_mean"), F.stddev_pop(obj).alias("objective_std"),
        F.min(obj).alias("objective_min"), F.max(obj).alias("objective_max"))
    med = grouped_exact_quantile(trials.where(done), [model], objective, 0.5, "objective_median")
    return stats.join(med, model, "left")


def best_setting(summary: DataFrame, setting: str, metric: str = "average_cost_mean") -> DataFrame:
    """Setting with the lowest value, first (smallest setting) on ties."""
    return summary.agg(F.min_by(F.col(setting), F.struct(F.col(metric), F.col(setting))).alias(setting),
                       F.min(metric).alias(metric))


def rank_settings(summary: DataFrame, setting: str, metric: str = "average_cost_mean") -> DataFrame:
    """All settings ranked by cost (T4); the settings table is small (one row per setting)."""
    w = Window.orderBy(F.col(metric), F.col(setting))
    return summary.select(setting, metric, F.row_number().over(w).alias("cost_rank"))


def best_per_metric(summary: DataFrame, setting: str, metrics: Sequence[str]) -> DataFrame:
    """For each metric the setting with the highest value, first on ties (T5)."""
    aggs = []
    for m in metrics:
        aggs += [F.min_by(F.col(setting), F.struct(-F.col(m), F.col(setting))).alias(f"s_{m}"),
                 F.max(m).alias(f"v_{m}")]
    stack = ", ".join(f"'{m}', s_{m}, v_{m}" for m in metrics)
    return summary.agg(*aggs).selectExpr(f"stack({len(metrics)}, {stack}) as (metric, best_setting, value)")


def best_trial(trials: DataFrame, model: str, trial: str, state: str, objective: str) -> DataFrame:
    """Per model the completed trial with the lowest objective, smallest id on ties.
    Failed trials carry no objective and never win (fixes a failure scoring as best)."""
    done = trials.where((F.col(state) == "COMPLETE") & F.col(objective).isNotNull())
    return done.groupBy(model).agg(
        F.min_by(F.col(trial), F.struct(F.col(objective), F.col(trial))).alias("best_trial"),
        F.min(objective).alias("best_objective"))


class CostEvaluator:
    """Average prediction cost as a ``pyspark.ml`` evaluator (M9): smaller is better.

    ``CostEvaluator(costs).evaluate(predictions)`` runs one aggregate over the
    prediction table; it plugs into ``CrossValidator`` / ``TrainValidationSplit``.
    """

    def __new__(cls, costs: CostMatrix = DEFAULT_COSTS, label_col: str = "y_true",
                prediction_col: str = "y_pred"):
        from pyspark.ml.evaluation import Evaluator

        class _CostEvaluator(Evaluator):
            def _evaluate(self, dataset):
                t = dataset.select(F.col(label_col).cast("int").alias("y_true"),
                                   F.col(prediction_col).cast("int").alias("y_pred"))
                return float(prediction_costs(t, costs).first()["average_cost"])

            def isLargerBetter(self) -> bool:
                return False

        return _CostEvaluator()
