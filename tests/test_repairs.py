"""Cases found in review: failing first, kept as regressions."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from seqlab.operators import clean as C
from seqlab.operators import metrics as M
from seqlab.operators import sampling as D
from seqlab.operators import spacing as S
from seqlab.operators.iforest import fit_forest
from seqlab.operators.knn import nearest_neighbours
from seqlab.operators.smote import smote
from seqlab.plans import search as H
from seqlab.plans.models import TrainConfig, estimator
from seqlab.plans.pipeline import CleanConfig, clean

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def two_blobs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3 == 0), float(a + 2 * (i % 3 == 0)), float(b)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    return spark.createDataFrame(rows, "id long, y int, a double, b double")


def test_every_trial_of_a_study_completes(spark, two_blobs):
    cfg = TrainConfig(model="knn", features=["a", "b"], label="y", id_col="id")
    folded = D.stratified_kfold(two_blobs, "id", "y", 2, 42)
    rows = H.run_study(spark, folded, cfg, "knn", n_trials=2, k=2).collect()
    assert [r.state for r in rows] == ["COMPLETE"] * 2 and all(r.objective > 0 and r.error is None for r in rows)


def test_a_study_without_a_completed_trial_raises(spark, two_blobs):
    cfg = TrainConfig(model="knn", features=["a", "missing"], label="y", id_col="id")
    folded = D.stratified_kfold(two_blobs, "id", "y", 2, 42)
    with pytest.raises(RuntimeError, match="no trial of knn completed"):
        H.run_study(spark, folded, cfg, "knn", n_trials=1, k=2)


def test_batch_evaluates_every_model(spark, two_blobs):
    cfg = TrainConfig(model="knn", features=["a", "b"], label="y", id_col="id")
    trials, comp = H.batch_optimize(spark, two_blobs.where("id % 4 > 0"), two_blobs.where("id % 4 = 0"), cfg, ["dummy", "knn"], 1, 2)
    got = {r.model: r for r in comp.collect()}
    assert {r.state for r in got.values()} == {"COMPLETE"} and trials.count() == 1
    assert got["knn"].test_accuracy > got["dummy"].test_balanced_accuracy


def test_draws_match_the_table_and_duckdb(spark):
    rows = H.draw_table(spark, 4).collect()
    for r in rows:
        v = H.draw_params(r.model, r.trial)[r.param]
        assert r.choice == str(v) if r.choice is not None else math.isclose(r.value, v, abs_tol=1e-6)
    u = duckdb.sql("select cast('0x' || substr(md5('42:knn:3:n_neighbors'), 1, 13) as bigint) / pow(16, 13)").fetchall()[0][0]
    assert H.draw_params("knn", 3)["n_neighbors"] == 3 + math.floor(u * 23)
    assert {(r.model, r.param) for r in rows} == {(m, p.name) for m, ps in H.SPACES.items() for p in ps}


def test_grids():
    assert np.allclose(H.ratio_grid(0.5, 8.0, 30), np.linspace(0.5, 8.0, 30))
    assert H.spaced_indices(30, 6) == [int(i * 29 / 5) for i in range(6)]


def test_depth_beyond_spark_raises():
    with pytest.raises(ValueError, match="at most 30"):
        estimator("random_forest", {"max_depth": 31}, 10, 2, "y", 1)


def test_stage_counts_with_default_arguments(spark):
    df = spark.newSession().range(20_000, numPartitions=8).select(
        F.col("id"), F.col("id").cast("double").alias("pos"), (F.col("id") % 5 == 0).cast("int").alias("label"), (F.col("id") % 100).alias("v"))
    counter = C.StageCounter()
    out = clean(df, CleanConfig(features=["v"], label="label", pos="pos", tie="id"), counter=counter)
    assert [r[3] for r in counter.rows()] == [20_000, 20_000, 20_000, 100] and out.count() == 100
    with pytest.raises(ValueError, match="empty"):
        clean(df.where("id < 0"), CleanConfig(features=["v"], label="label", pos="pos", tie="id"), counter=C.StageCounter())


def test_null_classes_are_ranked_and_kept(spark):
    df = spark.range(90).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("y"))
    ranks = {}
    for r in D.hash_rank(df, "id", 42, by=["y"]).collect():
        ranks.setdefault(r.y, []).append(r["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(1, 31)) for k in (None, 1, 2)}
    assert D.undersample(df, "id", "y", level=10).groupBy("y").count().where("count = 10").count() == 3
    assert D.stratified_split(df, "id", "y", 0.5).count() == 90


def test_bucket_digits_follow_the_rows():
    assert [D.bucket_digits(n) for n in (0, 10**9, 10**10, 10**12)] == [3, 3, 4, 6]


def test_fold_components_are_per_prediction(spark):
    df = spark.createDataFrame([("s", 0, 0, 0)] * 5 + [("s", 0, 0, 1)] * 2 + [("s", 0, 1, 0)] + [("s", 0, 1, 1)] * 2,
                               "setting string, fold int, y_true int, y_pred int")
    r = M.fold_table(df, "setting", "fold").first()
    assert (r.tn_avg_cost, r.fp_avg_cost, r.fn_avg_cost, r.tp_avg_cost) == (0.5, 2.0, 24.0, 2.0)
    assert r.average_cost == 28.5


def test_few_rows_give_nulls(spark):
    for n in (0, 1, 2):
        df = spark.range(n).select(F.col("id"), F.col("id").cast("double").alias("pos"))
        spaced = S.with_spacing(df, "pos", "id")
        rows = S.gap_thresholds(spaced, "id").collect()
        assert len(rows) == 7 and all(r.n_gaps == 0 for r in rows)
        box = S.box_stats(df, "pos", "id").first()
        assert (box.median is None) == (n == 0) and box.n_outliers == 0


def test_smote_ids_are_unique_for_any_label_and_id_type(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[min(i // 8, 2)], float(x)) for i, x in enumerate(rng.normal(size=60))]
    out = smote(spark.createDataFrame(rows, "id int, y string, x double"), "id", ["x"], "y", 44, k=3)
    assert out.count() == 3 * 44 == out.select("id").distinct().count()


def test_smote_needs_two_rows_and_takes_null_classes(spark):
    rows = [(i, None if i % 2 else 1, float(i)) for i in range(20)] + [(99, 7, 1.0)]
    df = spark.createDataFrame(rows, "id long, y int, x double")
    with pytest.raises(ValueError, match="class 7 has one row"):
        smote(df, "id", ["x"], "y", 12)
    out = smote(df.where("y is null or y < 7"), "id", ["x"], "y", 35, k=3).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in out} == {None: 35, 1: 35}


def test_mad_without_a_tie_on_a_shuffled_hot_value(spark):
    df = spark.range(5000).select((F.col("id") % 7 * F.lit(1.0)).alias("x")).repartition(5).union(spark.createDataFrame([(1e6,)], "x double"))
    assert C.remove_outliers_mad(df, "x", 3.0).count() == 5000


def test_iforest_samples_by_one_rule(spark):
    df = spark.range(300).select("id", (F.col("id") * 1.0).alias("x"))
    for trees, psi in ((10, 64), (3, 50)):
        sizes = [r["size"] for r in fit_forest(df, ["x"], "id", trees, psi).where("node = 0").collect()]
        assert sizes == [psi] * trees


def test_iforest_takes_its_key_as_an_expression_and_hashes_once(spark, monkeypatch):
    from seqlab.operators import iforest as I

    df = spark.range(3000).select("id", (F.col("id") % 97 * 1.5).alias("x"), (F.col("id") % 89 * 1.0).alias("y"))
    asked, rank = [], I.hash_rank
    monkeypatch.setattr(I, "hash_rank", lambda d, *a, **k: asked.append(d.count()) or rank(d, *a, **k))
    key = F.concat_ws("|", "id", "x")
    got = sorted(map(tuple, I.fit_forest(df, ["x", "y"], key, 5, 20).collect()))
    assert asked[0] < 1000  # not all rows are ranked
    rows = sorted(((hashlib.md5(f"42:{i}|{i % 97 * 1.5}".encode()).hexdigest(), i % 97 * 1.5, i % 89 * 1.0) for i in range(3000)))
    want = [r for t in range(5) for r in I.grow_tree(t, np.array([x[1:] for x in rows[20 * t:20 * t + 20]]), 20, 42)]
    assert got == sorted((t, n - 1, *rest) for t, n, *rest in want)
    assert "key" not in I.iforest_probability(df, ["x", "y"], key, 5, 20).columns


def test_knn_groups_are_blocked_by_their_own_size(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 2, i, [float(x) for x in rng.normal(size=3)]) for i in range(80)] + [(7, 100, [0.0] * 3)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")
    refs = df.withColumnRenamed("id", "t").where("g < 7")
    ask = lambda block: sorted(map(tuple, nearest_neighbours(df, refs, 3, "id", "t", "v", by=["g"], block_rows=block).select(
        "g", "id", "t", "nn_rank").collect()))
    assert ask(9) == ask(1000) and len(ask(1000)) == 240


@pytest.mark.parametrize("name, scans", [("A8_confusion_normalised", 1), ("A13_class_report", 1), ("A7_confusion_counts", 1)])
def test_scans(spark, name, scans):
    name = next(q for q in E.queries() if q.startswith(name.split("_")[0] + "_"))
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet") == scans


def test_confusion_matrix_classes(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (3, 1)], "y_true int, y_pred int")
    rows = {(r.true_class, r.pred_class): r for r in M.confusion_matrix(df).collect()}
    assert len(rows) == 9 and rows[1, 2].pct_true == 0.5 and rows[2, 2].pct_true == 0 and rows[1, 1].pct_pred == 0.5
