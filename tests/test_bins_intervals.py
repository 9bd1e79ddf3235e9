import math
import random

from pyspark.sql import functions as F

from seqlab.operators.bins import grid_cells
from seqlab.operators.intervals import label_by_intervals
from seqlab.operators.stats import histogram


def test_grid_edges_and_dropped_rows(spark):
    df = spark.createDataFrame([(float(i), 1.0, 0) for i in range(11)], "pos double, v double, label int")
    cells = grid_cells(df, "pos", 3.0, ["v"], "label").orderBy("cell").collect()
    assert [(c.bin_start, c.bin_stop) for c in cells] == [(0.0, 3.0), (3.0, 6.0), (6.0, 9.0)]
    assert sum(c.n_dp for c in cells) == 9  # rows 9 and 10 dropped


def test_label_mean_half_rounds_to_even(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (5.0, 0)], "pos double, label int")
    cells = grid_cells(df, "pos", 2.0, [], "label").orderBy("cell").collect()
    assert cells[0].label == 0.0 and cells[0].n_dp == 2


def test_grid_matches_loop_on_decimal_positions(spark):
    pos = [round(3 + 0.1 * i, 1) for i in range(201)]
    df = spark.createDataFrame([(p,) for p in pos], "pos double")
    cells = {c.cell: c.n_dp for c in grid_cells(df, "pos", 0.1, [], None).collect()}
    mn, mx, w = min(pos), max(pos), 0.1
    dl = (mn + w) - mn
    n_edges = math.ceil((mx - mn) / w)
    edges = [mn + i * dl for i in range(n_edges)]
    expect = {i: sum(1 for p in pos if edges[i] <= p < edges[i + 1]) for i in range(n_edges - 1)}
    assert cells == expect


def test_interval_end_inclusive_and_overlaps(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 25.0), (4, 40.0)], "id long, pos double")
    iv = spark.createDataFrame([(20.0, 10.0), (26.0, 15.0)], "s double, e double")  # overlapping
    for strategy in ("broadcast", "shuffle"):
        got = {r.id: r.in_interval for r in label_by_intervals(rows, "pos", iv, "s", "e", strategy=strategy).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 0}


def test_intervals_of_very_different_lengths(spark):
    rnd = random.Random(6)
    ivs = [(x + w, x) for x, w in ((rnd.uniform(-1e4, 1e4), rnd.choice([0.0, 0.01, 1.0, 7.0, 300.0])) for _ in range(200))] + [(9e5, 2e4)]
    pos = [rnd.uniform(-1e4, 1e4) for _ in range(2000)] + [x for s, e in ivs for x in (s, e)] + [5e5, 2e6]
    rows = spark.createDataFrame(list(enumerate(pos)), "id long, pos double")
    iv = spark.createDataFrame(ivs, "s double, e double")
    want = {i: int(any(e <= p <= s for s, e in ivs)) for i, p in enumerate(pos)}
    for strategy in ("broadcast", "shuffle"):
        assert {r.id: r.in_interval for r in label_by_intervals(rows, "pos", iv, "s", "e", strategy=strategy).collect()} == want
    none = label_by_intervals(rows, "pos", iv.where("false"), "s", "e")
    assert none.where("in_interval = 0").count() == len(pos)


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    h = histogram(df, "x", 5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 2, 2, 2, 3]  # 10 = max falls in the last, closed bin
