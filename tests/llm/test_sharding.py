import zlib

import numpy as np
from pyspark.sql import functions as F

from seqlab.llm import sharding as S


def check(docs, shards=40, **options):
    rows = S.assign_shards(docs, shards, **options).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    by = {}
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return rows


def loads(rows, shards, of="size"):
    out = np.zeros(shards)
    for r in rows:
        out[r.shard] += r[of]
    return out / out.mean()


def test_balance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = check(docs)
    assert abs(loads(rows, 40) - 1).max() < 0.01
    assert abs(loads(rows, 40, "tokens") - 1).max() < 0.1
    groups = {}
    for r in rows:
        groups.setdefault(r.key, set()).add(r.shard)
    assert max(map(len, groups.values())) == 1  # copies stay together


def test_hot_group_many_tasks(spark):
    """A text that a third of the rows hold is split; several packing tasks balance together."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text " * 30)).otherwise(
        F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), (F.col("id") % 50 + 1).cast("int"))).alias("text"))
    rows = check(docs, 8, task_rows=400)
    assert abs(loads(rows, 8) - 1).max() < 0.03
    assert len({r.shard for r in rows if r.doc_id % 3 == 0}) == 8


def test_odd_rows(odd, none, tmp_path, spark):
    check(odd)
    assert check(none) == []
    S.write_shards(odd, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and {*back.columns} == {*odd.columns, "shard"}


def test_pack_prefers_the_best_dot_product():
    v = np.array([[5.0, 1, 1], [5, 9, 1], [1, 9, 1], [1, 1, 9]])
    assert len(set(S.pack(v[:2], 2))) == 2
    assert S.pack(v, 2).shape == (4,)


def test_pack_balances_every_dimension():
    """Many short texts and few long ones: shards even in bytes must be even in rows as well."""
    rng = np.random.default_rng(5)
    size = np.r_[rng.integers(16, 300, 8000), rng.integers(20_000, 90_000, 300)].astype(float)
    v = np.stack([size, size // 6, np.ones(size.size)], axis=1)
    at = S.pack(v, 40)
    for d, most in enumerate((0.001, 0.01, 0.01)):
        load = np.bincount(at, v[:, d], 40)
        assert abs(load / load.mean() - 1).max() < most


def test_pack_levels_the_others_beside_a_row_above_a_share():
    v = np.r_[[[5000.0, 1, 1]], np.stack([np.arange(1.0, 100), np.ones(99), np.ones(99)], axis=1)]
    load = np.sort(np.bincount(S.pack(v, 4), v[:, 0], 4))
    assert load[3] < 5200 and load[2] - load[0] < 10


def test_groups_stay_whole_up_to_a_share_and_shards_do_not_depend_on_files(spark):
    """Groups of 400 and 900 rows with a shard's share of 1500, one of two shares; many packing tasks."""
    name = F.when(F.col("id") < 400, F.lit("copy a")).when(F.col("id") < 1300, F.lit("copy b")).when(F.col("id") < 4300, F.lit("copy c")).otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string")))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.rpad(name, 40, ".").alias("text"))
    rows = check(docs, 40, task_rows=2_000)
    where = {r.doc_id: r.shard for r in rows}
    for a, z, pieces in ((0, 400, 1), (400, 1300, 1)):
        assert len({where[i] for i in range(a, z)}) == pieces
    assert len({where[i] for i in range(1300, 4300)}) > 2
    assert abs(loads(rows, 40) - 1).max() < 0.01
    again = S.assign_shards(docs.orderBy(F.xxhash64("doc_id")).repartition(5), 40, task_rows=2_000).collect()
    assert {r.doc_id: r.shard for r in again} == where


def test_pack_fills_beside_what_the_shards_hold():
    used = np.array([[900.0, 9, 9], [0, 0, 0], [0, 0, 0]])
    v = np.stack([np.full(210, 10.0), np.full(210, 0.1), np.full(210, 0.1)], axis=1)
    for first in (0, 2):
        load = used[:, 0] + np.bincount(S.pack(v, 3, first, used), v[:, 0], 3)
        assert load.max() - load.min() <= 10
