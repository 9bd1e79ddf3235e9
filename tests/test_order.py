import random

import pytest
from pyspark.sql import functions as F

from seqlab.operators.order import global_rank, ordered_scan, plan_blocks
from seqlab.operators.sections import add_sections


def brute_sections(labels):
    out, cur, prev = [], 0, 0
    for lab in labels:
        if lab == 1 and prev != 1:
            cur += 1
        out.append(cur if lab == 1 else 0)
        prev = lab
    return out


def test_hand_case(spark):
    df = spark.createDataFrame([(i, float(i), lab) for i, lab in enumerate([1, 1, 0, 1])], "id long, pos double, label int")
    got = [r.section for r in add_sections(df, "label", "pos", "id").orderBy("pos").collect()]
    assert got == [1, 1, 0, 2]


@pytest.mark.parametrize("blocks", [1, 4, 16])
def test_sections_independent_of_blocks(spark, blocks):
    rng = random.Random(7)
    labels = [1 if rng.random() < 0.4 else 0 for _ in range(3000)]
    # long runs that certainly cross block cuts
    labels[1000:1600] = [1] * 600
    df = spark.createDataFrame([(i, float(i // 3), lab) for i, lab in enumerate(labels)],
                               "id long, pos double, label int")
    got = add_sections(df, "label", "pos", "id", blocks=blocks).orderBy("pos", "id").collect()
    assert [r.section for r in got] == brute_sections(labels)


def test_hot_position_is_split(spark):
    # a third of the rows share one position
    rows = [(i, 5.0 if i % 3 == 0 else float(i), i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, pos double, label int")
    plan = plan_blocks(df, "pos", "id", blocks=16)
    assert plan.hot_ids, "hot value should get id sub-blocks"
    got = add_sections(df, "label", "pos", "id", plan=plan).orderBy("pos", "id").collect()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [r.section for r in got] == brute_sections([r[2] for r in ordered])


def test_equal_positions_order_by_id(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 1.0), (0, 0.5)], "id long, pos double")
    got = global_rank(df, "pos", "id", blocks=2).orderBy("row_idx").collect()
    assert [r.id for r in got] == [0, 1, 2, 3]


def test_lag_and_running_sum(spark):
    rng = random.Random(3)
    vals = [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(i, float(i), v) for i, v in enumerate(vals)], "id long, pos double, v double")
    out = ordered_scan(df, "pos", "id", lags=["v"], steps={"cum": lambda cur, prev: cur("v")}, cur_cols=["v"],
                       row_number="rn", blocks=7).orderBy("pos").collect()
    assert [r.prev_v for r in out] == [None] + vals[:-1]
    acc = 0.0
    for r, v in zip(out, vals):
        acc += v
        assert r.cum == pytest.approx(acc)
    assert [r.rn for r in out] == list(range(1, 501))


def test_shuffle_partitions_do_not_matter(spark):
    labels = [1, 0, 1, 1, 0, 0, 1] * 50
    df = spark.createDataFrame([(i, float(i), lab) for i, lab in enumerate(labels)], "id long, pos double, label int")
    res = []
    for parts in ("1", "8", "33"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        res.append([r.section for r in add_sections(df, "label", "pos", "id", blocks=5).orderBy("pos").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1] == res[2] == brute_sections(labels)


def test_no_single_partition_window_on_data(spark):
    df = spark.range(50_000).select(F.col("id"), F.col("id").cast("double").alias("pos"),
                                    (F.col("id") % 3 == 0).cast("int").alias("label"))
    plan = add_sections(df, "label", "pos", "id", blocks=8)._jdf.queryExecution().executedPlan().toString()
    # the only single-partition exchange allowed is the one over the k-row block summary
    assert "hashpartitioning(_blk" in plan
