from collections import Counter
from itertools import combinations

import pytest

from seqlab.operators.profile import pair_counts


def brute(rows, features, n_bins):
    bounds = {f: [v for r in rows if (v := r[f]) is not None] for f in features}

    def cell(f, v):
        lo, hi = min(bounds[f]), max(bounds[f])
        return None if v is None else 0 if hi == lo else min(int((v - lo) / (hi - lo) * n_bins), n_bins - 1)

    return Counter((a, b, cell(a, r[a]), cell(b, r[b]), r["cls"]) for r in rows for a, b in combinations(features, 2))


@pytest.mark.parametrize("parts", [1, 7])
def test_pair_counts_equal_counting_every_record(spark, parts):
    features = ["u", "v", "w"]
    rows = [{"id": i, "u": float(i % 17), "v": None if i % 11 == 0 else float(i * i % 64), "w": 8.0 * (i % 9),
             "cls": (None, "a", "b")[i % 3]} for i in range(900)]
    df = spark.createDataFrame(rows, "id long, u double, v double, w double, cls string").repartition(parts)
    got = pair_counts(df, features, "cls", 8).collect()
    assert {(r.x_col, r.y_col, r.x_bin, r.y_bin, r.cls): r.n for r in got} == brute(rows, features, 8)


def test_pair_counts_of_an_empty_table(spark):
    df = spark.createDataFrame([], "u double, v double, cls int")
    assert pair_counts(df, ["u", "v"], "cls").collect() == []


def test_no_row_is_copied_per_pair(spark):
    df = spark.range(10).selectExpr("cast(id as double) u", "cast(id % 3 as double) v", "cast(id % 2 as int) cls")
    plan = pair_counts(df, ["u", "v"], "cls")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
