"""Queries: confusion, costs, metrics, folds, studies, rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlab.operators import metrics as M
from seqlab.operators.sampling import stratified_kfold
from seqlab.plans.catalog import register
from seqlab.session import checkpoint_dir
from seqlab.sources import writers as W
from seqlab.sources.readers import PREDICTIONS_SQL, predictions, read_table

C = M.DEFAULT_COSTS
CM_SQL = (f"with p as ({PREDICTIONS_SQL}), cm as (select count(*) filter (where y_true = 0 and y_pred = 0) as tn, "
          "count(*) filter (where y_true = 0 and y_pred = 1) as fp, "
          "count(*) filter (where y_true = 1 and y_pred = 0) as fn, "
          "count(*) filter (where y_true = 1 and y_pred = 1) as tp from p)")


def _div(n: str, d: str) -> str:
    return f"(case when ({d}) = 0 then 0.0 else ({n}) / ({d}) end)"


def rates_sql(prefix: str = "") -> str:
    tn, fp, fn, tp = "cast(tn as double)", "cast(fp as double)", "cast(fn as double)", "cast(tp as double)"
    rec = _div(tp, f"{tp} + {fn}")
    spec = _div(tn, f"{tn} + {fp}")
    prec = _div(tp, f"{tp} + {fp}")
    f1 = _div(f"2.0 * {prec} * {rec}", f"{prec} + {rec}")
    acc = _div(f"{tp} + {tn}", f"{tn} + {fp} + {fn} + {tp}")
    return (f"round({acc}, 6) as {prefix}accuracy, round(({rec} + {spec}) / 2.0, 6) as {prefix}balanced_accuracy, "
            f"round({rec}, 6) as {prefix}recall, round({prec}, 6) as {prefix}precision, round({f1}, 6) as {prefix}f1")


def costs_sql(prefix: str = "", per_prediction: bool = False) -> str:
    m = C.time_per_regular_advance
    parts = {k: f"cast({k} as double) * {getattr(C, k) * m}" for k in ("tn", "fp", "fn", "tp")}
    total = " + ".join(parts.values())
    n = "cast(tn + fp + fn + tp as double)"
    if per_prediction:
        shown = ", ".join(f"round({_div(f'({v})', n)}, 6) as {prefix}{k}_avg_cost" for k, v in parts.items())
    else:
        shown = ", ".join(f"round({v}, 6) as {prefix}{k}_cost" for k, v in parts.items())
    return (shown
            + f", round({total}, 6) as {prefix}total_cost, round({_div(total, n)}, 6) as {prefix}average_cost")


def _r(df, keep=()):
    """Round every double column to 6 digits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])


@register("A7_confusion_counts", f"{CM_SQL} select tn, fp, fn, tp from cm")
def a7_confusion_counts(spark, sf_dir):
    return M.confusion_counts(predictions(spark, sf_dir))


@register("A9_prediction_costs", f"{CM_SQL} select tn, fp, fn, tp, {costs_sql()} from cm")
def a9_prediction_costs(spark, sf_dir):
    return _r(M.prediction_costs(predictions(spark, sf_dir)))


@register("A10_expected_cost", f"{CM_SQL} select round({_div('cast(tn as double) * 1.0 + cast(fp as double) * 10.0 + cast(fn as double) * 240.0 + cast(tp as double) * 10.0', 'cast(tn + fp + fn + tp as double)')}, 6) as average_cost from cm")
def a10_expected_cost(spark, sf_dir):
    return _r(M.expected_cost(predictions(spark, sf_dir)))


@register("A11_metrics", f"{CM_SQL} select {rates_sql()} from cm")
def a11_metrics(spark, sf_dir):
    cm = M.confusion_counts(predictions(spark, sf_dir))
    return _r(cm.select(*M.rates()))


@register("A12_metrics_from_counts", f"{CM_SQL} select tn, fp, fn, tp, {rates_sql()}, "
          f"round({_div('cast(tp as double)', 'cast(tp + fn as double)')}, 6) as sensitivity, "
          f"round({_div('cast(tn as double)', 'cast(tn + fp as double)')}, 6) as specificity from cm")
def a12_metrics_from_counts(spark, sf_dir):
    cm = M.confusion_counts(predictions(spark, sf_dir))
    return _r(cm.select("tn", "fp", "fn", "tp", *M.rates(), *M.sensitivity_specificity()))


@register("M9_evaluate", f"{CM_SQL} select tn, fp, fn, tp, {rates_sql()}, {costs_sql('cost_')} from cm")
def m9_evaluate(spark, sf_dir):
    return _r(M.evaluate(predictions(spark, sf_dir)))


A8_SQL = f"""with p as ({PREDICTIONS_SQL}),
cls as (select y_true as c from p union select y_pred from p),
g as (select a.c as true_class, b.c as pred_class from cls a cross join cls b),
n as (select y_true as true_class, y_pred as pred_class, count(*) as n from p group by all),
m as (select g.true_class, g.pred_class, coalesce(n.n, 0) as n from g left join n using (true_class, pred_class))
select true_class, pred_class, n,
  round({_div('n', 'sum(n) over (partition by true_class)')}, 6) as pct_true,
  round({_div('n', 'sum(n) over (partition by pred_class)')}, 6) as pct_pred,
  round({_div('n', 'sum(n) over ()')}, 6) as pct_all from m"""


@register("A8_confusion_normalised", A8_SQL)
def a8_confusion_normalised(spark, sf_dir):
    return _r(M.confusion_matrix(predictions(spark, sf_dir)))


A13_SQL = f"""with p as ({PREDICTIONS_SQL}),
cls as (select y_true as c from p union select y_pred from p),
per as (select c, (select count(*) from p where y_true = c and y_pred = c) as tp,
        (select count(*) from p where y_true = c) as support, (select count(*) from p where y_pred = c) as pp
        from cls),
m as (select cast(c as varchar) as label, {_div('cast(tp as double)', 'cast(pp as double)')} as precision,
      {_div('cast(tp as double)', 'cast(support as double)')} as recall, support from per),
f as (select *, {_div('2.0 * precision * recall', 'precision + recall')} as f1 from m)
select label, round(precision, 6) as precision, round(recall, 6) as recall, support, round(f1, 6) as f1 from f
union all
select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), cast(sum(support) as bigint), round(avg(f1), 6) from f
union all
select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       cast(sum(support) as bigint), round(sum(f1 * support) / sum(support), 6) from f"""


@register("A13_class_report", A13_SQL)
def a13_class_report(spark, sf_dir):
    return _r(M.class_report(predictions(spark, sf_dir)))


# --- folds and settings on orders -------------------------------------------

FOLD_SQL = """with o as (select o_orderkey, o_orderpriority as setting, cast(o_orderstatus = 'F' as integer) as y_true,
  cast(o_totalprice > 200000 as integer) as y_pred from orders),
f as (select *, cast((row_number() over (partition by y_true order by md5('42:' || o_orderkey), o_orderkey) - 1) % 5
      as integer) as fold from o),
cm as (select setting, fold, count(*) filter (where y_true = 0 and y_pred = 0) as tn,
       count(*) filter (where y_true = 0 and y_pred = 1) as fp, count(*) filter (where y_true = 1 and y_pred = 0) as fn,
       count(*) filter (where y_true = 1 and y_pred = 1) as tp from f group by setting, fold)"""

FT_SQL = f"{FOLD_SQL}, ft as (select setting, fold, tn, fp, fn, tp, {costs_sql(per_prediction=True)}, {rates_sql()} from cm)"


def _folded(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("setting"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        (F.col("o_totalprice") > 200000).cast("int").alias("y_pred"))
    return stratified_kfold(o, "o_orderkey", "y_true", 5, 42)


def _fold_table(spark, sf_dir):
    return M.fold_table(_folded(spark, sf_dir), "setting", "fold")


@register("A14_fold_costs", f"{FT_SQL} select * from ft")
def a14_fold_costs(spark, sf_dir):
    return _r(_fold_table(spark, sf_dir))


def _summary_sql() -> str:
    cols = []
    for m in M.FOLD_METRICS:
        cols += [f"round(avg({m}), 6) as {m}_mean", f"round(stddev_pop({m}), 6) as {m}_std"]
    cols += [f"round(avg({c}), 6) as {c}_mean" for c in ("tn", "fp", "fn", "tp")]
    return f"sm as (select setting, {', '.join(cols)} from ft group by setting)"


SM_SQL = f"{FT_SQL}, {_summary_sql()}"


def _summary(spark, sf_dir):
    # Fold metrics are rounded before averaging, as the oracle does.
    return _r(M.fold_summary(_r(_fold_table(spark, sf_dir)), "setting"))


@register("A15_fold_mean_std", f"{SM_SQL} select * from sm")
def a15_fold_mean_std(spark, sf_dir):
    return _summary(spark, sf_dir)


@register("T3_best_setting", f"{SM_SQL} select (select setting from sm order by average_cost_mean, setting limit 1) "
          "as setting, min(average_cost_mean) as average_cost_mean from sm")
def t3_best_setting(spark, sf_dir):
    return M.best_setting(_summary(spark, sf_dir), "setting")


@register("T4_settings_by_cost", f"{SM_SQL} select setting, average_cost_mean, cast(row_number() over "
          "(order by average_cost_mean, setting) as integer) as cost_rank from sm")
def t4_settings_by_cost(spark, sf_dir):
    return M.rank_settings(_summary(spark, sf_dir), "setting")


T5_METRICS = ("accuracy_mean", "balanced_accuracy_mean", "recall_mean", "precision_mean", "f1_mean")


@register("T5_best_per_metric", f"{SM_SQL} " + " union all ".join(
    f"select '{m}' as metric, (select setting from sm order by {m} desc, setting limit 1) as best_setting, "
    f"max({m}) as value from sm" for m in T5_METRICS))
def t5_best_per_metric(spark, sf_dir):
    return M.best_per_metric(_summary(spark, sf_dir), "setting", T5_METRICS)


# --- trials: one per order; state from the status, objective = total price ---

TRIALS_SQL = ("select o_orderpriority as model, o_orderkey as trial, case o_orderstatus when 'F' then 'COMPLETE' "
              "when 'O' then 'PRUNED' else 'FAIL' end as state, case when o_orderstatus = 'F' then o_totalprice "
              "end as objective from orders")


def _trials(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    state = (F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "PRUNED")
             .otherwise("FAIL"))
    return o.select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("trial"),
                    state.alias("state"),
                    F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("objective"))


@register("A16_study_statistics", f"""with t as ({TRIALS_SQL})
select model, count(*) filter (where state = 'COMPLETE') as n_complete, count(*) filter (where state = 'PRUNED')
  as n_pruned, count(*) filter (where state = 'FAIL') as n_failed,
  round(count(*) filter (where state = 'COMPLETE') * 1.0 / count(*), 6) as success_rate,
  round(avg(objective) filter (where state = 'COMPLETE'), 6) as objective_mean,
  round(stddev_pop(objective) filter (where state = 'COMPLETE'), 6) as objective_std,
  min(objective) filter (where state = 'COMPLETE') as objective_min,
  max(objective) filter (where state = 'COMPLETE') as objective_max,
  round(median(objective) filter (where state = 'COMPLETE'), 6) as objective_median
from t group by model""")
def a16_study_statistics(spark, sf_dir):
    return _r(M.study_statistics(_trials(spark, sf_dir), "model", "state", "objective"),
              keep=("objective_min", "objective_max"))


@register("T6_best_trial", f"""with t as ({TRIALS_SQL}),
r as (select model, trial, objective, row_number() over (partition by model order by objective, trial) as rn
      from t where state = 'COMPLETE' and objective is not null)
select model, trial as best_trial, objective as best_objective from r where rn = 1""")
def t6_best_trial(spark, sf_dir):
    return M.best_trial(_trials(spark, sf_dir), "model", "trial", "state", "objective")


# --- sinks, read back: what was written, after a repeated write --------------------------------------------------

def _fresh(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("S6_write_dataset", "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def s6_write_dataset(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = _fresh(spark, "dataset")
    for _ in range(2):
        W.write_dataset(orders, path, partition_by=["o_orderstatus"])
    return spark.read.schema(orders.schema).parquet(path)


@register("S7_write_results", f"{FT_SQL} select * from ft")
def s7_write_results(spark, sf_dir):
    results = _r(_fold_table(spark, sf_dir))
    path = _fresh(spark, "results")
    W.write_results(results.withColumn("predictions", F.array("tn", "fp", "fn", "tp")), path)
    return spark.read.parquet(path)


@register("S8_run_summary", f"""with t as ({TRIALS_SQL}) select count(*) as n_models, count(*) filter (where state = 'COMPLETE') as n_succeeded,
  count(*) filter (where state <> 'COMPLETE') as n_failed, round(count(*) filter (where state = 'COMPLETE')::double / count(*), 6) as success_rate from t""")
def s8_run_summary(spark, sf_dir):
    path = _fresh(spark, "summary")
    W.write_dataset(W.run_summary(_trials(spark, sf_dir)), path)
    return _r(spark.read.parquet(path))


LOGGED = ("average_cost_mean", "accuracy_mean", "f1_mean")


@register("S9_run_log", f"{SM_SQL} " + " union all ".join(
    f"select setting as run_id, '{m}' as key, 'metric' as kind, round({m}, 6) as value from sm" for m in LOGGED))
def s9_run_log(spark, sf_dir):
    """Every setting is a run; one of them is logged again, as after a lost acknowledgement."""
    rows = W.run_rows(_summary(spark, sf_dir), "setting", LOGGED)
    path = _fresh(spark, "run-log")
    W.append_runs(rows, path)
    W.append_runs(rows.where(F.col("run_id").startswith("1")), path)
    log = W.read_runs(spark, path, "run_id string, key string, kind string, value string")
    return log.select("run_id", "key", "kind", F.round(F.col("value").cast("double"), 6).alias("value"))


@register("S11_best_records", f"""with t as ({TRIALS_SQL}),
r as (select model, trial, objective, row_number() over (partition by model order by objective, trial) as rn
      from t where state = 'COMPLETE' and objective is not null)
select model, trial as best_trial, objective as best_objective from r where rn = 1""")
def s11_best_records(spark, sf_dir):
    best = M.best_trial(_trials(spark, sf_dir), "model", "trial", "state", "objective")
    path = _fresh(spark, "best")
    for _ in range(2):
        W.append_runs(best, path, "model")
    return W.read_runs(spark, path, "model string, best_trial long, best_objective double")
