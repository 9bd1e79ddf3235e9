"""Exact quantiles by counting, against numpy."""

import numpy as np
import pytest

from seqlab.operators.stats import exact_quantiles

PS = [0.0, 0.001, 0.25, 0.5, 0.505, 0.95, 0.999, 1.0]


def _check(spark, values, **kw):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
    got = exact_quantiles(df, "x", PS, **kw)
    assert np.allclose(got, np.percentile(values, [100 * p for p in PS]), rtol=0, atol=1e-12)


@pytest.mark.parametrize("kind", ["normal", "few values", "hot", "one", "two", "integers"])
def test_equals_numpy(spark, kind):
    rng = np.random.default_rng(6)
    x = {"normal": rng.normal(size=3001), "few values": rng.integers(0, 4, 2000), "hot": np.r_[np.full(900, 0.5), rng.random(1100)],
         "one": [7.5], "two": [1.0, 2.0], "integers": rng.permutation(2500)}[kind]
    _check(spark, x)
    # coarse sketches and small brackets: narrowed several times, or found to be off and made finer
    _check(spark, x, most=20, accuracy=20)
    _check(spark, x, most=1, accuracy=100)


def test_no_rows(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert exact_quantiles(df, "x", [0.5, 0.9]) == [None, None] and exact_quantiles(df, "x", []) == []
