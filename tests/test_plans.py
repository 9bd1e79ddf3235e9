"""Physical-plan checks: pruning, pushdown, and no single-partition work on data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from seqlab.operators.order import ordered_scan
from seqlab.operators.sampling import hash_rank

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_reaches_the_scan(spark):
    plan = _plan(E.queries()["P3_choose_columns"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan


def test_filter_is_pushed_to_the_scan(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").where(F.col("event_type") == "error").select("event_id")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in _plan(df)


def test_ordered_scan_single_partition_only_over_block_summary(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("pos"))
    plan = _plan(ordered_scan(df, "pos", "id", lags=["pos"], blocks=8))
    # one single-partition exchange: the k-row carry window, under the broadcast
    assert plan.count("SinglePartition") == 1
    assert "hashpartitioning(_blk" in plan


def test_hash_rank_has_no_single_partition_exchange(spark):
    df = spark.range(10_000).select(F.col("id"), (F.col("id") % 3).alias("y"))
    assert "SinglePartition" not in _plan(hash_rank(df, "id", 42, by=["y"]))


@pytest.mark.parametrize("name,most", [("A8_confusion_normalised", 1), ("A13_class_report", 1), ("A5_section_report", 3), ("W6_first_section_75pct", 3),
                                       ("W8_section_size_rank", 3), ("D2_group_split", 3), ("D3_section_range_split", 3),
                                       ("D5_stratified_group_kfold", 3), ("D10_split_summary", 3)])
def test_number_of_table_scans(spark, name, most):
    assert _plan(E.queries()[name](spark, SF)).count("Scan parquet") <= most
