import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators.iforest import iforest_probability
from seqlab.operators.knn import knn_predict, nearest_neighbours
from seqlab.operators.smote import smote
from seqlab.plans import search as H
from seqlab.plans.models import TrainConfig, train_predict
from seqlab.operators import metrics as M
from seqlab.operators.sampling import stratified_split


def test_iforest_ranks_planted_outliers_top(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, size=(2000, 3))
    x[:10] += 12.0  # planted outliers
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    p = iforest_probability(df, ["a", "b", "c"], "id", n_trees=50, seed=1)
    top = [r.id for r in p.orderBy(F.col("outlier_prob").desc()).limit(10).collect()]
    assert set(top) == set(range(10))


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(40, 5))
    t = rng.normal(size=(120, 5))
    qdf = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "qid long, v array<double>")
    tdf = spark.createDataFrame([(1000 + i, [float(v) for v in r]) for i, r in enumerate(t)], "tid long, v array<double>")
    got = nearest_neighbours(qdf, tdf, 3, "qid", "tid", "v", block_rows=16)
    got = {(r.qid, r.nn_rank): r.tid for r in got.collect()}
    d = ((q[:, None, :] - t[None, :, :]) ** 2).sum(-1)
    for i in range(40):
        best = np.argsort(d[i], kind="stable")[:3]
        assert [got[(i, j + 1)] for j in range(3)] == [1000 + b for b in best]


def test_smote_rows_lie_between_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    rows += [(100 + i, float(a), float(b), 1) for i, (a, b) in enumerate(rng.normal(5, 1, size=(12, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = smote(df, "id", ["a", "b"], "y", 60, k=5, seed=3)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 60, 1: 60}
    syn = out.where(F.col("synthetic") == 1).collect()
    assert len(syn) == 48
    mins = np.array([[r[1], r[2]] for r in rows if r[3] == 1])
    lo, hi = mins.min(axis=0), mins.max(axis=0)
    for r in syn:  # inside the class's bounding box (segments between class members)
        assert lo[0] - 1e-9 <= r.a <= hi[0] + 1e-9 and lo[1] - 1e-9 <= r.b <= hi[1] + 1e-9


def _learnable(spark, n=400):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, d double, y int")


@pytest.mark.parametrize("model,params", [("logistic_regression", {"C": 1.0}), ("random_forest", {"n_estimators": 20, "max_depth": 5}),
                                          ("xgboost", {"n_estimators": 10, "max_depth": 3}), ("svm", {"kernel": "rbf"}),
                                          ("knn", {"n_neighbors": 5})])
def test_model_beats_majority(spark, model, params):
    df = _learnable(spark)
    s = stratified_split(df, "id", "y", 0.33)
    tr, te = s.where(F.col("side") == "train"), s.where(F.col("side") == "test")
    feats = ["a", "b", "c", "d"]
    got = M.evaluate(train_predict(tr, te, TrainConfig(model, params, feats, "y", "id"))).first()
    base = M.evaluate(train_predict(tr, te, TrainConfig("dummy", {}, feats, "y", "id"))).first()
    assert got.balanced_accuracy > 0.75 > base.balanced_accuracy
    assert model != "logistic_regression" or got.balanced_accuracy > 0.85


def test_knn_sweep_plan_equals_fit_loop(spark):
    df = _learnable(spark, 240)
    s = stratified_split(df, "id", "y", 0.33)
    tr, te = s.where(F.col("side") == "train").drop("side"), s.where(F.col("side") == "test").drop("side")
    cfg = TrainConfig("knn", {"n_neighbors": 3}, ["a", "b", "c", "d"], "y", "id")
    ratios = [0.5, 1.0]
    one = sorted(tuple(r) for r in H.knn_undersampling_sweep(spark, tr, te, cfg, ratios, k=3).collect())
    loop = sorted(tuple(r) for r in H.undersampling_sweep(spark, tr, te, cfg, ratios, k=3, parallelism=2).collect())
    assert one == loop


def test_param_draws_are_reproducible():
    a = [H.draw_params("random_forest", t, 42) for t in range(5)]
    b = [H.draw_params("random_forest", t, 42) for t in range(5)]
    assert a == b and all(50 <= p["n_estimators"] <= 300 for p in a)
    assert H.ratio_grid()[0] == 0.5 and H.ratio_grid()[-1] == 8.0 and len(H.ratio_grid()) == 30
