"""Exact neighbours by pivot cells, nested samples in one search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import knn as K


def _frame(spark, x, name, groups=None):
    rows = [(int(i), [float(v) for v in r], int(groups[i]) if groups is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, v array<double>, g int")


def _brute(q, t, k, metric, ids=None, drop_self=False):
    d = np.abs(q[:, None] - t[None]).sum(-1) if metric == "manhattan" else np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1))
    if drop_self:
        np.fill_diagonal(d, np.inf)
    ids = np.arange(len(t)) if ids is None else ids
    return [[(int(ids[j]), round(float(row[j]), 9)) for j in np.lexsort((ids, row))[:k] if np.isfinite(row[j])] for row in d]


def _clustered(n, d, rng, spread=0.05):
    return rng.normal(size=(20, d))[rng.integers(0, 20, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["clustered", "uniform", "copies"])
def test_cells_give_the_exact_neighbours(spark, metric, kind):
    rng = np.random.default_rng(8)
    t = _clustered(900, 5, rng) if kind == "clustered" else rng.random((900, 5))
    if kind == "copies":
        t[::3] = t[0]  # a third of the rows are equal
    q = np.r_[t[:60], rng.normal(size=(60, 5))]
    got = K.nearest_neighbours(_frame(spark, q, "qid"), _frame(spark, t, "tid"), 7, "qid", "tid", "v", metric=metric, block_rows=100, pivots=25)
    rows = {}
    for r in got.orderBy("qid", "nn_rank").collect():
        rows.setdefault(r.qid, []).append((r.tid, round(r.dist, 9)))
    assert [rows[i] for i in range(len(q))] == _brute(q, t, 7, metric)


def test_groups_self_and_few_references(spark):
    rng = np.random.default_rng(9)
    x, g = _clustered(300, 4, rng), rng.integers(0, 3, 300)
    df = _frame(spark, x, "qid", g)
    got = K.nearest_neighbours(df, df.withColumnRenamed("qid", "tid"), 5, "qid", "tid", "v", exclude_self=True, by=["g"], block_rows=40, pivots=10)
    rows = {}
    for r in got.orderBy("qid", "nn_rank").collect():
        rows.setdefault(r.qid, []).append((r.tid, round(r.dist, 9)))
    for c in range(3):
        mine = np.flatnonzero(g == c)
        for i, want in zip(mine, _brute(x[mine], x[mine], 5, "euclidean", mine, True)):
            assert rows[i] == want
    few = K.nearest_neighbours(df, df.withColumnRenamed("qid", "tid").where("tid < 3"), 5, "qid", "tid", "v", pivots=2)
    assert few.groupBy("qid").count().where("count <> 3").count() == 0


def test_clustered_queries_reach_few_cells(spark):
    rng = np.random.default_rng(10)
    x = _clustered(4000, 16, rng, 0.02)
    df = _frame(spark, x, "id")
    queries, refs = K._pruned(df.select("id", F.col("v").alias("_qvec")), df.select("id", F.col("v").alias("_vec")), 5, "euclidean", [], 64)
    pairs = queries.groupBy("_cell").count().withColumnRenamed("count", "a").join(refs.groupBy("_cell").count(), "_cell").agg(F.sum(F.col("a") * F.col("count"))).first()[0]
    assert pairs < 0.15 * 4000 ** 2
    assert queries.select("id").distinct().count() == refs.count() == 4000


def test_staircase_equals_a_search_per_limit(spark):
    rng = np.random.default_rng(11)
    t, q = np.round(rng.random((400, 3)), 1), np.round(rng.random((50, 3)), 1)  # many ties
    rank = rng.permutation(400) + 1
    refs = _frame(spark, t, "tid").join(spark.createDataFrame([(i, int(r)) for i, r in enumerate(rank)], "tid long, rk long"), "tid")
    limits = [2, 5, 40, 41, 300, 400]
    near = K.staircase_neighbours(_frame(spark, q, "qid"), refs, 5, limits, "rk", "qid", "tid", "v", block_rows=64).collect()
    assert len(near) == 50
    for lim in limits:
        ids = np.flatnonzero(rank <= lim)
        want = _brute(q, t[ids], 5, "euclidean", ids)
        for r in near:
            assert [(c.tid, round(c.dist, 9)) for c in r.near if c.rk <= lim][:5] == want[r.qid]
    assert max(len(r.near) for r in near) <= 7 * 5 * len(limits)


def test_queries_that_reach_every_cell_are_not_copied_to_them(spark):
    rng = np.random.default_rng(12)
    t, q = rng.normal(size=(1200, 32)), rng.normal(size=(90, 32))
    ref = _frame(spark, t, "tid").withColumnRenamed("v", "_vec").select("tid", "_vec", "g")
    ask = _frame(spark, q, "qid").withColumnRenamed("v", "_qvec")
    queries, refs = K._pruned(ask, ref, 5, "euclidean", ["g"], 35, 400)
    assert "_cell" not in queries.columns and queries.count() == 90 and refs.columns == ref.columns and refs.count() == 1200
    got = K.nearest_neighbours(_frame(spark, q, "qid"), _frame(spark, t, "tid"), 5, "qid", "tid", "v", by=["g"], block_rows=100)
    rows = {}
    for r in got.orderBy("qid", "nn_rank").collect():
        rows.setdefault(r.qid, []).append((r.tid, round(r.dist, 9)))
    assert [rows[i] for i in range(90)] == _brute(q, t, 5, "euclidean")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["plain", "far from zero", "rounded", "copies", "an outlier", "tiny", "all equal"])
def test_screened_search_equals_all_distances(metric, kind):
    rng = np.random.default_rng(13)
    q, t = rng.normal(size=(150, 12)), rng.normal(size=(2500, 12))
    if kind == "far from zero":
        q, t = q + 1e7, t + 1e7
    elif kind == "rounded":
        q, t = np.round(q[:, :2], 1), np.round(t[:, :2], 1)
    elif kind == "copies":
        t[::3] = q[::5] = t[0]
    elif kind == "an outlier":
        t[7] *= 1e12
    elif kind == "tiny":
        q, t = q * 1e-25, t * 1e-25
    elif kind == "all equal":
        q[:] = t[:] = 1.0
    ids = rng.permutation(2500)
    for k, ends, drop_self in ((9, [2500], False), (6, [3, 10, 500, 501, 2400], False), (5, [2500], True)):
        got, want = (sorted(zip(*[x.tolist() for x in f(q, t, np.arange(150), ids, k, metric, drop_self, ends)])) for f in (K._search, K._search_directly))
        assert got == want
