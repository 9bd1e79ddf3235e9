"""Queries: neighbours, kNN vote and the model family on the embedding stand-in (J3, M8, ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.operators.knn import knn_predict, nearest_neighbours
from seqlab.functions.exprs import safe_div
from seqlab.operators.sampling import stratified_kfold, stratified_split
from seqlab.plans.catalog import register
from seqlab.session import materialize
from seqlab.sources.readers import read_table

SEED = 42


def embeddings(spark, sf_dir):
    """vec_id, embedding, y: the learnable label e1 + e2 > 0 (the table's own label is noise)."""
    e = read_table(spark, sf_dir, "embeddings")
    y = ((F.element_at("embedding", 1) + F.element_at("embedding", 2)) > 0).cast("int")
    return e.select("vec_id", "embedding", y.alias("y"))


EMB_SIDES_SQL = """e as (select vec_id, embedding, cast(embedding[1] + embedding[2] > 0 as integer) as y from embeddings),
r as (select *, row_number() over (partition by y order by md5('42:' || vec_id), vec_id) as rk from e),
c as (select y, count(*) as n from e group by y),
t as (select ceil(0.33::double * sum(n)) as nt, sum(n) as ntot from c),
b as (select y, n, nt * n / ntot as ex, floor(nt * n / ntot) as base, nt from c, t),
k as (select *, ex - base as rem, nt - sum(base) over () as extra from b),
a as (select y, base + case when row_number() over (order by rem desc, y) <= extra then 1 else 0 end as n_test from k),
s as (select r.vec_id, r.embedding, r.y, case when rk <= n_test then 'test' else 'train' end as side
      from r join a using (y))"""

EMB_SPLIT_SQL = f"""{EMB_SIDES_SQL},
d as (select q.vec_id as qid, t.vec_id as tid, t.y as ty,
      sqrt(list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda x: (x[1]::double - x[2]::double) ^ 2))) as dist
      from s q, s t where q.side = 'test' and t.side = 'train'),
nn as (select *, cast(row_number() over (partition by qid order by dist, tid) as integer) as nn_rank from d)"""


def split_embeddings(spark, sf_dir):
    return stratified_split(embeddings(spark, sf_dir), "vec_id", "y", 0.33, SEED)


def _neighbours(s, k=5):
    """Neighbours of the test rows of a split table, which is read several times and therefore written once."""
    test = s.where(F.col("side") == "test").select(F.col("vec_id").alias("qid"), "embedding")
    train = s.where(F.col("side") == "train").select(F.col("vec_id").alias("tid"), "embedding", "y")
    return nearest_neighbours(test, train, k, "qid", "tid", "embedding", extra=["y"])


@register("J3_nearest_neighbours", f"with {EMB_SPLIT_SQL} select qid, tid, round(dist, 6) as dist, nn_rank "
          "from nn where nn_rank <= 5")
def j3_nearest_neighbours(spark, sf_dir):
    return _neighbours(materialize(split_embeddings(spark, sf_dir))).select("qid", "tid", F.round("dist", 6).alias("dist"), "nn_rank")


M8_SQL = f"""with {EMB_SPLIT_SQL},
v as (select qid, ty, count(*) as votes from nn where nn_rank <= 5 group by qid, ty),
w as (select qid, ty, row_number() over (partition by qid order by votes desc, ty) as rn from v)
select s.vec_id, s.y as y_true, w.ty as y_pred from s join w on s.vec_id = w.qid where w.rn = 1"""


@register("M8_knn_predict", M8_SQL)
def m8_knn_predict(spark, sf_dir):
    s = materialize(split_embeddings(spark, sf_dir))
    pred = knn_predict(_neighbours(s), "qid", "y", "uniform")
    truth = s.where(F.col("side") == "test").select("vec_id", F.col("y").alias("y_true"))
    return truth.join(pred.withColumnRenamed("qid", "vec_id"), "vec_id").select("vec_id", "y_true", "y_pred")


# --- outliers, oversampling, model family, search and sweep ------------------

from seqlab.operators.clean import outlier_share  # noqa: E402
from seqlab.operators.iforest import iforest_probability, remove_outliers_iforest  # noqa: E402
from seqlab.operators import metrics as M  # noqa: E402
from seqlab.operators.smote import smote  # noqa: E402
from seqlab.plans.models import BOOSTED, TrainConfig, train_predict  # noqa: E402
from seqlab.plans.q_metrics import costs_sql, rates_sql  # noqa: E402
from seqlab.plans import search as H  # noqa: E402

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
N_DIMS = 64
EMB_FEATURES = [f"e{i}" for i in range(N_DIMS)]


def _lineitem_rows(spark, sf_dir):
    """(rows, their key)."""
    li = read_table(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LI_FEATURES]
    # lineitem has no unique key: the row content is the sampling id (equal
    # rows are interchangeable, so the sample is still a fixed multiset).
    return li.select(*[F.col(c) + F.lit(0.0) if c == "l_discount" else F.col(c) for c in cols]).toDF(*cols), \
        F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _iforest_sql(n_trees: int = 100, psi: int = 256, levels: int = 8) -> str:
    """CTE scored: the rows of lineitem with ``p``, their outlier probability."""
    u = lambda kind: f"('0x' || substr(md5('{SEED}:' || tree || ':' || node || ':{kind}'), 1, 13))::bigint / 4503599627370496::double"
    ranges = ", ".join(f"{{'i': {i}, 'lo': min(x[{i + 1}]) over w, 'hi': max(x[{i + 1}]) over w}}" for i in range(4))
    grow = "".join(f"""
g{k} as (select *, case when len(ranges) > 0 and {k} < {levels} then ranges[floor({u("f")} * len(ranges))::integer + 1] end as pick
  from (select tree, node, x, count(*) over w as size, list_filter([{ranges}], lambda r: r.hi > r.lo) as ranges
        from s{k} window w as (partition by tree, node))),
c{k} as (select *, pick.lo + {u("t")} * (pick.hi - pick.lo) as threshold from g{k}),
s{k + 1} as (select tree, x, 2 * node + (x[pick.i + 1] >= threshold)::integer as node from c{k} where pick is not null),""" for k in range(levels + 1))
    nodes = " union all ".join(f"select distinct tree, node, coalesce(pick.i, -1) as feature, threshold, size from c{k}" for k in range(levels + 1))
    walk = "".join(f"""
w{k + 1} as (select rid, w.tree, x, case when feature < 0 then w.node else 2 * w.node + (x[feature + 1] >= threshold)::integer end as node
  from w{k} w join nodes n on n.tree = w.tree and n.node = w.node),""" for k in range(levels))
    c = lambda n: f"case when {n} < 2 then 0 when {n} = 2 then 1 else 2.0::double * (ln({n} - 1.0::double) + 0.5772156649015329::double) - 2.0::double * ({n} - 1.0::double) / {n} end"
    cols = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
    return f"""with li as materialized (select *, concat_ws('|', {cols}) as key, [l_quantity, l_extendedprice, l_discount, l_tax] as x,
  row_number() over () as rid from (select {cols.replace("l_discount", "l_discount + 0.0::double as l_discount")} from lineitem)),
ranked as (select x, row_number() over (order by md5('{SEED}:' || key), key) as rk, count(*) over () as n, least({psi}, count(*) over ()) as psi from li),
s0 as (select ((rk - 1 + turn * n) // psi)::integer as tree, x, 1 as node
  from ranked, unnest(range(0, greatest({n_trees} * psi - rk, -1) // n + 1)) as t(turn) where rk <= {n_trees} * psi),{grow}
nodes as materialized ({nodes}),
w0 as (select rid, tree, x, 1 as node from li, (select distinct tree from nodes) t),{walk}
paths as (select rid, sum(length(bin(n.node)) - 1 + {c("size")}) / {n_trees} as h from w{levels} w join nodes n on n.tree = w.tree and n.node = w.node group by rid),
scores as (select rid, pow(2, -h / (select {c("psi")} from ranked limit 1)) as score from paths),
scored as (select {cols}, (score - min(score) over ()) / (max(score) over () - min(score) over ()) as p from scores join li using (rid))"""


@register("O2_iforest_filter", f"{_iforest_sql()} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax "
          "from scored where p <= 0.5")
def o2_iforest_filter(spark, sf_dir):
    rows, key = _lineitem_rows(spark, sf_dir)
    return remove_outliers_iforest(rows, LI_FEATURES, 0.5, key, n_trees=100, seed=SEED)


@register("O2_iforest_outlier_share", f"{_iforest_sql()} select count(*) as n_total, count(*) filter (where p > 0.5) as n_outliers, "
          "count(*) filter (where p > 0.5)::double / count(*) as outlier_share from scored")
def o2_iforest_outlier_share(spark, sf_dir):
    rows, key = _lineitem_rows(spark, sf_dir)
    p = iforest_probability(rows, LI_FEATURES, key, n_trees=100, seed=SEED)
    return outlier_share(p.withColumn("_o", (F.col("outlier_prob") > 0.5).cast("int")), "_o")


def emb_table(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", "y", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(N_DIMS)])


@register("D8_smote_class_counts", """with e as (select cast(embedding[1] + embedding[2] > 0 as integer) as y
  from embeddings), c as (select y, count(*) as n from e group by y)
select y, (select max(n) from c) as n, (select max(n) from c) - n as n_synthetic from c""")
def d8_smote_class_counts(spark, sf_dir):
    e = emb_table(spark, sf_dir)
    level = e.groupBy("y").count().agg(F.max("count")).first()[0]
    out = smote(e, "vec_id", EMB_FEATURES, "y", level, k=5, seed=SEED)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("synthetic").alias("n_synthetic"))


_SMOTE_U = f"('0x' || substr(md5('{SEED}:' || y || ':' || i || ':{{}}'), 1, 13))::bigint / 4503599627370496::double"


@register("D8_smote_rows", f"""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v, cast(embedding[1] + embedding[2] > 0 as integer) as y from embeddings),
c as (select *, least(5, n - 1) as k, coalesce(sum(need) over (order by y rows between unbounded preceding and 1 preceding), 0) as used
  from (select y, n, 2 * max(n) over () - n as need from (select y, count(*) as n from e group by y))),
r as (select e.*, n, need, k, used, row_number() over (partition by y order by md5('{SEED}:' || vec_id), vec_id) as r from e join c using (y)),
i as (select r.*, r + j * n as i from r, unnest(range(0, greatest(need - r, -1) // n + 1)) as t(j) where r <= need),
d as (select *, floor({_SMOTE_U.format("n")} * k) + 1 as nth, {_SMOTE_U.format("u")} as u from i),
nn as (select a.vec_id, b.v as nv, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as nth
  from e a join e b on a.y = b.y and a.vec_id <> b.vec_id),
o as (select vec_id, y, 0 as synthetic, v from e union all select (-(used + i))::bigint, y, 1,
  list_transform(list_zip(v, nv), lambda p: p[1] + u * (p[2] - p[1])) from d join nn using (vec_id, nth))
select vec_id, y, synthetic, {", ".join(f"round(v[{j + 1}], 6) as e{j}" for j in range(N_DIMS))} from o""")
def d8_smote_rows(spark, sf_dir):
    """Every class brought to twice the largest: all rows, given and synthetic."""
    e = emb_table(spark, sf_dir)
    level = 2 * e.groupBy("y").count().agg(F.max("count")).first()[0]
    return _r(smote(e, "vec_id", EMB_FEATURES, "y", level, k=5, seed=SEED))


def _split_tables(spark, sf_dir):
    s = stratified_split(emb_table(spark, sf_dir), "vec_id", "y", 0.33, SEED)
    return s.where(F.col("side") == "train").drop("side"), s.where(F.col("side") == "test").drop("side")


def _base_cfg(model="logistic_regression", params=None):
    return TrainConfig(model=model, params=params or {}, features=EMB_FEATURES, label="y", id_col="vec_id",
                       undersample_ratio=1.0, seed=SEED)


def _eval_model(spark, sf_dir, model, params):
    train, test = _split_tables(spark, sf_dir)
    pred = train_predict(train, test, _base_cfg(model, params))
    return M.evaluate(pred)


# Fixed parameter maps of the stored model configurations (the values the
# workload ships for each model).
MODEL_PARAMS = {
    "logistic_regression": {"C": 0.2895667317295911, "penalty": "l1"},
    "random_forest": {"max_depth": 11, "max_features": "log2", "min_samples_leaf": 4, "n_estimators": 109},
    "xgboost": {"colsample_bytree": 0.7351421288846683, "learning_rate": 0.07926004251101824, "max_depth": 8,
                "n_estimators": 96, "subsample": 0.9437099479618614},
    "svm": {"C": 0.9175201343352734, "gamma": "scale", "kernel": "rbf"},
    "knn": {"n_neighbors": 9, "p": 2, "weights": "uniform"},
}


# --- the kNN model in SQL: fold set -1 is the test evaluation, 0..k-1 the folds (M2, H4, H5, H6, T3) ---

def _knn_sql(grid: str, n_neighbors: int, k: int) -> str:
    """CTE cm (fold, ri, tn, fp, fn, tp) of the uniform Euclidean kNN vote; ``grid``: a query giving (ri, lv), the
    undersample level of each setting, which may read ``minority`` (n)."""
    return f"""{EMB_SIDES_SQL},
f as (select vec_id, embedding, y, cast((row_number() over (partition by y order by md5('42:' || vec_id), vec_id) - 1) % {k}
      as integer) as fold from s where side = 'train'),
minority as (select min(n) as n from (select count(*) as n from f group by y) z),
grid as ({grid}),
refs as (select p.p as fold, f.vec_id, f.embedding, f.y, row_number() over (partition by p.p, f.y
         order by md5('42:' || f.vec_id), f.vec_id) as rk
         from f, unnest(range(-1, {k})) as p(p) where p.p <> f.fold),
qs as (select fold, vec_id, embedding, y from f union all select -1, vec_id, embedding, y from s where side = 'test'),
dims as (select fold, i, avg(embedding[i]::double) as m, stddev_pop(embedding[i]::double) as sd
         from refs, unnest(range(1, {N_DIMS + 1})) as t(i) group by fold, i),
st as (select fold, list(m order by i) as m, list(sd order by i) as sd from dims group by fold),
scaled_q as (select q.fold, vec_id, y, list_transform(range(1, {N_DIMS + 1}),
             lambda i: case when sd[i] = 0 then 0.0::double else (embedding[i]::double - m[i]) / sd[i] end) as v from qs q join st using (fold)),
scaled_t as (select r.fold, vec_id, y, rk, list_transform(range(1, {N_DIMS + 1}),
             lambda i: case when sd[i] = 0 then 0.0::double else (embedding[i]::double - m[i]) / sd[i] end) as v from refs r join st using (fold)),
pairs as (select q.fold, q.vec_id as qid, q.y as yt, t.vec_id as tid, t.y, t.rk, list_distance(q.v, t.v) as dist
          from scaled_q q join scaled_t t using (fold)),
near as (select fold, ri, qid, yt, y, row_number() over (partition by fold, ri, qid order by dist, tid) as rn
         from pairs, grid where rk <= lv),
votes as (select fold, ri, qid, yt, cast(count(*) filter (where y = 1) > count(*) filter (where y = 0) as integer) as yp
          from near where rn <= {n_neighbors} group by fold, ri, qid, yt),
cm as (select fold, ri, count(*) filter (where yt = 0 and yp = 0) as tn, count(*) filter (where yt = 0 and yp = 1) as fp,
       count(*) filter (where yt = 1 and yp = 0) as fn, count(*) filter (where yt = 1 and yp = 1) as tp
       from votes group by fold, ri)"""


def _ratio_sql(lo: float, hi: float, n: int) -> str:
    return (f"select i as ri, frac, cast(floor(n * frac) as bigint) as lv from minority, (select i, case when i = {n - 1} then {hi}::double "
            f"else {lo}::double + i::double * (({hi}::double - {lo}::double) / {n - 1}::double) end as frac from range({n}) as t(i)) g")


def _sweep_sql() -> str:
    """CTE sw: the sweep's result rows, not rounded."""
    c = M.DEFAULT_COSTS
    cost = {x: f"{x}::double * {getattr(c, x) * c.time_per_regular_advance}::double" for x in ("tn", "fp", "fn", "tp")}
    n = "(tn + fp + fn + tp)"
    div = lambda a, b: f"coalesce(({a})::double / nullif(({b})::double, 0), 0)"
    rec, spec, prec = div("tp", "tp + fn"), div("tn", "tn + fp"), div("tp", "tp + fp")
    per = {"average_cost": div(" + ".join(cost.values()), n), "accuracy": div("tp + tn", n), "recall": rec, "specificity": spec,
           "balanced_accuracy": f"({rec} + {spec}) / 2.0::double", "precision": prec, "f1": div(f"2.0::double * {prec} * {rec}", f"{prec} + {rec}")}
    cv = ", ".join(f"avg({m}) as {m}_cv, stddev_pop({m}) as {m}_std" if m != "average_cost"
                   else f"avg({m}) as cost_average, stddev_pop({m}) as cost_average_std" for m in per)
    counts = ", ".join(f"avg({x}) as {x}_avg, avg({div(v, n)}) as {x}_avg_cost" for x, v in cost.items())
    test = ", ".join([*(f"{v} as {x}_total_cost" for x, v in cost.items()), f"{' + '.join(cost.values())} as cost_total",
                      *(f"{m} as test_{m}" for m in per), "recall as test_sensitivity"])
    return f"""{_knn_sql(_ratio_sql(0.5, 8.0, 30), MODEL_PARAMS["knn"]["n_neighbors"], 5)},
per as (select *, {', '.join(f'{v} as {m}' for m, v in per.items())} from cm),
cvs as (select ri, {cv}, {counts} from per where fold >= 0 group by ri),
tst as (select ri, {test} from per where fold = -1),
sw as (select round(frac, 6) as undersample_fraction, lv as undersample_level, cvs.* exclude (ri), tst.* exclude (ri)
       from cvs join tst using (ri) join grid using (ri))"""


def _r(df):
    """Round every double column to 6 digits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("M4_logistic_regression")
def m4_logistic_regression(spark, sf_dir):
    return _eval_model(spark, sf_dir, "logistic_regression", MODEL_PARAMS["logistic_regression"])


@register("M5_random_forest")
def m5_random_forest(spark, sf_dir):
    return _eval_model(spark, sf_dir, "random_forest", MODEL_PARAMS["random_forest"])


@register("M6_gradient_boosted_trees")
def m6_gradient_boosted_trees(spark, sf_dir):
    return _eval_model(spark, sf_dir, "xgboost", MODEL_PARAMS["xgboost"])


@register("M7_svm_rbf")
def m7_svm_rbf(spark, sf_dir):
    return _eval_model(spark, sf_dir, "svm", MODEL_PARAMS["svm"])


@register("M2_dispatch_knn", f"with {_knn_sql('select 0 as ri, n as lv from minority', 9, 5)} "
          f"select tn, fp, fn, tp, {rates_sql()}, {costs_sql('cost_')} from cm where fold = -1")
def m2_dispatch_knn(spark, sf_dir):
    return _r(_eval_model(spark, sf_dir, "knn", MODEL_PARAMS["knn"]))


# --- studies at full size: 100 trials x 5 folds (H1, H3, H4) -------------------------------------------------

N_TRIALS, N_FOLDS = 100, 5


def _draws_sql(models, trials: str) -> str:
    """(model, trial, param, value, choice) of every parameter of the models' spaces for the trials of a query giving (trial)."""
    space = ", ".join(f"('{m}', '{p.name}', '{p.kind}', {p.lo!r}::double, {p.hi!r}::double, [{', '.join(repr(str(c)) for c in p.choices)}]::varchar[])"
                      for m in models for p in H.SPACES[m])
    return f"""select model, trial, param, round(case kind when 'int' then floor(lo + floor(u * (hi - lo + 1))) when 'float' then lo + u * (hi - lo)
  when 'logfloat' then exp(ln(lo) + u * (ln(hi) - ln(lo))) end, 6) as value,
  case when kind = 'cat' then choices[least(floor(u * len(choices)), len(choices) - 1)::integer + 1] end as choice
from (select *, ('0x' || substr(md5('{SEED}:' || model || ':' || trial || ':' || param), 1, 13))::bigint / 4503599627370496::double as u
  from (values {space}) as s(model, param, kind, lo, hi, choices), ({trials}))"""


def _study_vectors(spark, sf_dir):
    train, _ = _split_tables(spark, sf_dir)
    return stratified_kfold(train, "vec_id", "y", N_FOLDS, SEED)


@register("H3_study_logistic_regression")
def h3_study(spark, sf_dir):
    return H.run_study(spark, _study_vectors(spark, sf_dir), _base_cfg(), "logistic_regression", N_TRIALS, N_FOLDS, SEED)


def _knn_study_sql() -> str:
    c = M.DEFAULT_COSTS
    cost = " + ".join(f"{x}::double * {getattr(c, x) * c.time_per_regular_advance}::double" for x in ("tn", "fp", "fn", "tp"))
    div = lambda a, b: f"coalesce(({a})::double / nullif(({b})::double, 0), 0)"
    rec, spec, prec, n = div("tp", "tp + fn"), div("tn", "tn + fp"), div("tp", "tp + fp"), "(tn + fp + fn + tp)"
    per = {"objective": div(cost, n), "accuracy_mean": div("tp + tn", n), "balanced_accuracy_mean": f"({rec} + {spec}) / 2.0::double",
           "recall_mean": rec, "precision_mean": prec, "f1_mean": div(f"2.0::double * {prec} * {rec}", f"{prec} + {rec}")}
    head = _knn_sql("select 0 as ri, n as lv from minority", 1, N_FOLDS).split("pairs as (")[0]
    return f"""with {head}
draws as ({_draws_sql(["knn"], f"select i::integer as trial from range({N_TRIALS}) as t(i)")}),
points as (select trial, max(value) filter (where param = 'n_neighbors')::integer as n_neighbors,
  max(choice) filter (where param = 'weights') as weights, max(value) filter (where param = 'p')::integer as p from draws group by trial),
lv as (select fold, min(n) as lv from (select fold, y, count(*) as n from refs where fold >= 0 group by fold, y) group by fold),
pairs as (select q.fold, q.vec_id as qid, q.y as yt, t.vec_id as tid, t.y, list_distance(q.v, t.v) as d2,
  list_sum(list_transform(list_zip(q.v, t.v), lambda x: abs(x[1] - x[2]))) as d1
  from scaled_q q join scaled_t t using (fold) join lv using (fold) where t.rk <= lv.lv),
near as (select fold, qid, yt, tid, y, 2 as p, d2 as dist from pairs union all select fold, qid, yt, tid, y, 1, d1 from pairs),
ranked as (select *, row_number() over (partition by p, fold, qid order by dist, tid) as rn from near),
votes as (select trial, fold, qid, yt, sum(case when weights = 'uniform' then 1 when lowest = 0 then (dist = 0)::integer else 1 / dist end
    * case when y = 1 then 1 else -1 end) > 0 as yp
  from (select *, min(dist) over (partition by p, fold, qid) as lowest from ranked where rn <= 25) r join points on points.p = r.p and rn <= n_neighbors
  group by trial, fold, qid, yt),
cells as (select trial, fold, count(*) filter (where yt = 0 and not yp) as tn, count(*) filter (where yt = 0 and yp) as fp,
  count(*) filter (where yt = 1 and not yp) as fn, count(*) filter (where yt = 1 and yp) as tp from votes group by trial, fold),
per as (select trial, {", ".join(f"{v} as {k}" for k, v in per.items())} from cells)
select trial, n_neighbors, weights, p, 'COMPLETE' as state, round(stddev_pop(objective), 6) as objective_std,
  {", ".join(f"round(avg({k}), 6) as {k}" for k in per)} from per join points using (trial) group by all"""


@register("H3_study_knn", _knn_study_sql())
def h3_study_knn(spark, sf_dir):
    study = H.run_study(spark, _study_vectors(spark, sf_dir), _base_cfg(), "knn", N_TRIALS, N_FOLDS, SEED)
    point = [F.col("params")[c].cast(t).alias(c) for c, t in (("n_neighbors", "int"), ("weights", "string"), ("p", "int"))]
    return _r(study.select("trial", *point, "state", *[c for c in study.columns if c.startswith("objective") or c.endswith("_mean")]))


@register("H1_draw_table", _draws_sql(H.SPACES, "select vec_id as trial from embeddings"))
def h1_draw_table(spark, sf_dir):
    """One trial of every model per vector: its number is the vector's id."""
    return H.draw_table(spark, read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial")), SEED)


def _batch(spark, sf_dir, models):
    train, test = _split_tables(spark, sf_dir)
    return H.batch_optimize(spark, train, test, _base_cfg(), models, N_TRIALS, N_FOLDS, SEED)[1]


@register("H4_batch_models")
def h4_batch_models(spark, sf_dir):
    return _batch(spark, sf_dir, ["dummy", "logistic_regression", "knn", "svm", "random_forest"])


@register("H4_batch_boosted")
def h4_batch_boosted(spark, sf_dir):
    return _batch(spark, sf_dir, list(BOOSTED))


def _sweep_counts(spark, sf_dir):
    train, test = _split_tables(spark, sf_dir)
    # The sweep model is the stored kNN configuration, whose 30 x 6 fits
    # run as one plan (one group per fold set x ratio).
    cfg = _base_cfg("knn", MODEL_PARAMS["knn"])
    counts = H.knn_undersampling_sweep(spark, train, test, cfg, H.ratio_grid(0.5, 8.0, 30), k=5, seed=SEED)
    return materialize(counts)  # 180 rows that the summaries read several times


@register("H5_undersampling_sweep", f"with {_sweep_sql()} select undersample_fraction, undersample_level, "
          "round(columns(* exclude (undersample_fraction, undersample_level)), 6) from sw")
def h5_undersampling_sweep(spark, sf_dir):
    return _r(H.sweep_summary(_sweep_counts(spark, sf_dir)))


@register("H6_sweep_series", f"with {_sweep_sql()} " + " union all ".join(
    f"select undersample_fraction, '{m}' as series, round({v}, 6) as mean, round({d}, 6) as std from sw"
    for m, v, d in [("cost_average", "cost_average", "cost_average_std"), *((m, f"{m}_cv", f"{m}_std") for m in (
        "accuracy", "balanced_accuracy", "recall", "precision", "f1", "specificity"))]))
def h6_sweep_series(spark, sf_dir):
    return _r(H.sweep_long(H.sweep_summary(_sweep_counts(spark, sf_dir))))


SWEEP_METRICS = ("accuracy_cv", "balanced_accuracy_cv", "recall_cv", "precision_cv", "f1_cv")


# Rounded before the comparison on both sides, so that the last bits decide no tie.
@register("H6_sweep_metric_maxima", f"with {_sweep_sql()} " + " union all ".join(
    f"select '{m}' as metric, (select undersample_fraction from sw order by round({m}, 6) desc, undersample_fraction limit 1) "
    f"as best_setting, max(round({m}, 6)) as value from sw" for m in SWEEP_METRICS))
def h6_sweep_metric_maxima(spark, sf_dir):
    return M.best_per_metric(_r(H.sweep_summary(_sweep_counts(spark, sf_dir))), "undersample_fraction", SWEEP_METRICS)


@register("T3_sweep_best_ratio", f"with {_sweep_sql()} select (select undersample_fraction from sw order by "
          "round(cost_average, 6), undersample_fraction limit 1) as undersample_fraction, "
          "min(round(cost_average, 6)) as cost_average from sw")
def t3_sweep_best_ratio(spark, sf_dir):
    return M.best_setting(_r(H.sweep_summary(_sweep_counts(spark, sf_dir))), "undersample_fraction", "cost_average")


@register("H6_sweep_confusion_matrices", f"with {_sweep_sql()} select round(frac, 6) as undersample_fraction, lv as undersample_level, "
          "tn, fp, fn, tp, " + ", ".join(f"round({c}::double / nullif({n}, 0), 6) as {c}_share" for c, n in (
              ("tn", "tn + fp"), ("fp", "tn + fp"), ("fn", "fn + tp"), ("tp", "fn + tp")))
          + f" from cm join grid using (ri) where fold = -1 and ri in ({', '.join(map(str, H.spaced_indices(30, 6)))})")
def h6_sweep_confusion_matrices(spark, sf_dir):
    counts = _sweep_counts(spark, sf_dir).where(F.col("fold") == -1)
    ratios = sorted(r[0] for r in counts.select("undersample_fraction").collect())
    picks = [ratios[i] for i in H.spaced_indices(len(ratios), 6)]
    n0, n1 = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    share = {"tn": n0, "fp": n0, "fn": n1, "tp": n1}  # normalised by true class
    return _r(counts.where(F.col("undersample_fraction").isin(picks)).select(
        "undersample_fraction", "undersample_level", "tn", "fp", "fn", "tp",
        *[safe_div(F.col(c), n).alias(f"{c}_share") for c, n in share.items()]))
