import os
import tempfile

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seqlab.functions.exprs import class_name, display_name, torque_ratio
from seqlab.operators.clean import require_rows
from seqlab.operators.metrics import CostMatrix
from seqlab.plans import search as H
from seqlab.sources import readers as R
from seqlab.sources import writers as W


def _tmp():
    return tempfile.mkdtemp(prefix="seqlab-io-")


def test_csv_roundtrip_with_blank_headers(spark):
    d = _tmp()
    path = os.path.join(d, "a.csv")
    with open(path, "w") as f:
        f.write(" Chainage , F [kN] ,collapse\n100.0,1.5,0\n99.0,2.5,1\n")
    df = R.load_features(R.read_csv(spark, path), ["F [kN]"], label="collapse", keep=["Chainage"])
    assert df.columns == ["Chainage", "F [kN]", "collapse"]
    assert df.count() == 2


def test_concat_sources_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id long, x double")
    b = spark.createDataFrame([(2,)], "id long")
    u = R.concat_sources([("a", a), ("b", b)]).orderBy("id").collect()
    assert [(r.id, r.x, r.source) for r in u] == [(1, 2.0, "a"), (2, None, "b")]


def test_writers_roundtrip(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, "x", [1, 2])], "id long, s string, predictions array<int>")
    W.write_results(df, os.path.join(d, "res"))
    assert spark.read.parquet(os.path.join(d, "res")).columns == ["id", "s"]
    W.write_dataset(df.drop("predictions"), os.path.join(d, "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).count() == 1
    rid = W.log_run(spark, os.path.join(d, "log"), {"cost": 1.5}, {"C": 0.3})
    W.log_run(spark, os.path.join(d, "log"), {"cost": 2.5}, {"C": 0.4})
    log = spark.read.parquet(os.path.join(d, "log"))
    assert log.count() == 4 and log.where(F.col("run_id") == rid).count() == 2
    W.record_best(spark, os.path.join(d, "best"), "knn", {"n_neighbors": 9}, 12.5, 3, {"f1": 0.7})
    assert W.read_best(spark, os.path.join(d, "best"), "knn") == {"n_neighbors": "9"}
    # a run that is logged or recorded again replaces itself and leaves the others
    W.log_run(spark, os.path.join(d, "log"), {"cost": 1.5}, {"C": 0.3}, rid)
    assert spark.read.parquet(os.path.join(d, "log")).count() == 4
    for score in (12.0, 11.0):
        W.record_best(spark, os.path.join(d, "best"), "svm", {"C": score}, score, 1, {}, run_id="007")
    best = W.read_runs(spark, os.path.join(d, "best"), W.BEST_SCHEMA)
    assert best.count() == 2 and best.where("run_id = '007'").first().best_score == 11.0
    comp = spark.createDataFrame([("a", "COMPLETE"), ("b", "FAIL")], "model string, state string")
    s = W.run_summary(comp).first()
    assert (s.n_models, s.n_succeeded, s.n_failed, s.success_rate) == (2, 1, 1, 0.5)


def test_model_save_load(spark):
    d = _tmp()
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(20)], "x double, y double")
    m = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"),
                         LogisticRegression(featuresCol="f", labelCol="y", maxIter=5)]).fit(df)
    W.save_model(m, os.path.join(d, "m"))
    assert W.load_model(os.path.join(d, "m")).transform(df).count() == 20


def test_guards():
    with pytest.raises(ValueError):
        CostMatrix(tn=None)


def test_require_rows(spark):
    with pytest.raises(ValueError):
        require_rows(spark.range(0))


def test_display_and_class_names(spark):
    df = spark.createDataFrame([("random_forest", 0), ("knn", 7)], "m string, c int")
    r = df.select(display_name("m").alias("d"), class_name("c").alias("n")).collect()
    assert [(x.d, x.n) for x in r] == [("RANDOMFOREST", "regular"), ("KNN", "7")]


def test_torque_ratio_out_of_domain_is_nan(spark):
    df = spark.createDataFrame([(1000.0, 10.0, 500.0), (1000.0, 600.0, 500.0)], "f double, p double, m double")
    theo, ratio = torque_ratio("f", "p", "m")
    rows = df.select(theo.alias("t"), ratio.alias("r")).collect()
    assert rows[0].t > 180 and rows[0].r > 0
    assert rows[1].t != rows[1].t  # NaN: penetration beyond the cutter radius


def test_grids():
    assert H.spaced_indices(30, 6) == [0, 5, 11, 17, 23, 29]
