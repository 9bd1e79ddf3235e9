from pyspark.sql import functions as F

from seqlab.operators import metrics as M
from seqlab.operators import sampling as D
from seqlab.operators.clean import remove_outliers_mad
from seqlab.operators.profile import standardize


def _classes(spark, n0=100, n1=10):
    rows = [(i, 0) for i in range(n0)] + [(n0 + i, 1) for i in range(n1)]
    return spark.createDataFrame(rows, "id long, y int")


def test_undersample_ratio_half_and_two(spark):
    df = _classes(spark)
    half = {r.y: r["count"] for r in D.undersample(df, "id", "y", ratio=0.5).groupBy("y").count().collect()}
    assert half == {0: 5, 1: 5}
    two = {r.y: r["count"] for r in D.undersample(df, "id", "y", ratio=2.0).groupBy("y").count().collect()}
    assert two == {0: 20, 1: 10}


def test_hash_rank_independent_of_partitions(spark):
    df = _classes(spark, 500, 50)
    a = {r.id: r["rank"] for r in D.hash_rank(df.repartition(1), "id", 42, by=["y"]).collect()}
    b = {r.id: r["rank"] for r in D.hash_rank(df.repartition(13), "id", 42, by=["y"]).collect()}
    assert a == b
    assert sorted(v for k, v in a.items() if k < 500) == list(range(1, 501))


def test_group_folds_keep_sections_whole(spark):
    rows = [(i, (i // 7) + 1 if i % 3 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, section long")
    f = D.stratified_group_kfold(df, "id", "section", 5, 42)
    per = f.where(F.col("section") > 0).groupBy("section").agg(F.countDistinct("fold").alias("n"))
    assert per.where(F.col("n") > 1).count() == 0
    assert f.count() == 400


def test_split_sides_disjoint_and_complete(spark):
    df = _classes(spark, 300, 30)
    s = D.stratified_split(df, "id", "y", 0.33)
    assert s.count() == 330 and s.select("id").distinct().count() == 330
    assert s.where(F.col("side") == "test").count() == 109  # ceil(0.33 * 330)


def test_one_class_gives_four_counts(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    r = M.evaluate(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 0, 0)
    assert r.precision == 0.0 and r.f1 == 0.0


def test_cost_example(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 2
    r = M.prediction_costs(spark.createDataFrame(rows, "y_true int, y_pred int")).first()
    assert r.total_cost == 285.0 and r.average_cost == 28.5


def test_mad_zero_keeps_equal_values(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)] + [(10, 5.0)], "id long, x double")
    kept = remove_outliers_mad(df, "x", 3.0).collect()
    assert len(kept) == 10 and all(r.x == 1.0 for r in kept)


def test_constant_column_standardised_to_zero(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 4.0)], "c double, v double")
    out = standardize(df, ["c", "v"]).collect()
    assert all(r.c == 0.0 for r in out)
    assert abs(sum(r.v for r in out)) < 1e-12


def test_cost_evaluator(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 2
    ev = M.CostEvaluator()
    assert ev.evaluate(spark.createDataFrame(rows, "y_true int, y_pred int")) == 28.5
    assert ev.isLargerBetter() is False


def test_grouped_exact_quantile_matches_numpy(spark):
    import numpy as np
    from seqlab.operators.stats import grouped_exact_quantile

    rng = np.random.default_rng(5)
    big = rng.integers(0, 50, size=30_000).astype(float)   # hot group, many ties
    small = rng.normal(size=301)
    rows = [("a", float(v)) for v in big] + [("b", float(v)) for v in small] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for p in (0.5, 0.9):
        got = {r.g: r.quantile for r in grouped_exact_quantile(df, ["g"], "x", p, accuracy=1000).collect()}
        assert got["a"] == np.percentile(big, p * 100)
        assert abs(got["b"] - np.percentile(small, p * 100)) < 1e-12
        assert got["c"] == 1.0
    one = grouped_exact_quantile(df, [], "x", 0.5).first()
    assert one.quantile == np.percentile(np.concatenate([big, small, [1.0]]), 50)
