import re

import numpy as np
from pyspark.sql import functions as F

from seqlab.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), repeat=3):
    """{source: target} by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(repeat * sizes[s] for s in stopped)
        open_w = sum(w[s] for s in names if s not in stopped)
        out = {s: float(repeat * sizes[s]) if s in stopped else rest * w[s] / open_w for s in names}
        new = {s for s in names if s not in stopped and out[s] > repeat * sizes[s]}
        if not new:
            return out
        stopped |= new
        if len(stopped) == len(names):
            return {s: float(repeat * sizes[s]) for s in names}


def check(docs, near):
    src = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in src:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = targets(sizes) if src else {}
    _, placed, _ = M.mix(docs)
    rows = M.op9_mixing(docs).collect()
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((r.doc_id, len(WORD.findall(r.text or ""))) for r in src), key=str)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    got = {}
    for r in rows:
        got.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(got) == sorted({(sizes[s], round(t, 6)) for s, t in want.items()})
    for (_, t), taken in got.items():
        n = sum(round(t, 6) == round(x, 6) and sizes[s] == _ for s, x in want.items())
        assert abs(sum(taken) - n * t) <= max(near, 0.02 * n * t), (t, sum(taken))
    again = M.op9_mixing(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    return rows


def test_small_table(small):
    check(small, 100)


def test_caps_and_hot_source(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "b").when(F.col("id") % 30 == 1, "a").otherwise(
        F.concat(F.lit("c"), F.col("id") % 5)).alias("source"), F.repeat(F.lit("w x\ty  "), (F.col("id") % 97).cast("int")).alias("text"))
    rows = check(docs, 100)
    assert any(r.taken == 3 * r.size > 0 for r in rows)


def test_odd_rows(odd, none):
    check(odd, 5000)
    assert check(none, 0) == []
    out = M.mix_documents(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r.taken > 0 for r in M.op9_mixing(odd).collect())


def test_documents_hold_what_the_mix_takes(small):
    took = {r.doc_id: r.taken for r in M.op9_mixing(small).collect()}
    out = {r.doc_id: r for r in M.mix_documents(small).collect()}
    old = {r.doc_id: r.text for r in small.collect()}
    assert {d for d, n in took.items() if n} == set(out)
    for d, r in out.items():
        assert len(WORD.findall(r.text)) == took[d] and r.n_chars == len(r.text)
        assert set(WORD.findall(r.text)) <= set(WORD.findall(old[d]))
    assert any(out[d].text == old[d] for d in out)


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(M.permute(np.arange(n), n, 12345)) == list(range(n))
    assert list(M.permute(np.arange(1000), 1000, 1)) != list(M.permute(np.arange(1000), 1000, 2))


def test_shards_hold_the_slots(spark, small):
    """Every slot of a shard holds its block's words; the seed decides how many slots of a source a shard has."""
    options = {"shard_words": 2_000, "block_words": 32}
    counts = []
    for seed in (1, 2):
        shards = M.mixed_shards(small, seed=seed, **options).collect()
        assert all(len(r.text.split()) == r.n_words <= 32 for r in shards)
        assert len({(r.shard, r.sid, r.slot) for r in shards}) == len(shards)
        took = M.mix(small, seed=seed, **options)[2].selectExpr("sum(len * copies)").first()[0]
        assert sum(r.n_words for r in shards) == took
        cells = {}
        for r in shards:
            cells[r.shard, r.sid] = cells.get((r.shard, r.sid), 0) + 1
        counts.append(cells)
    assert counts[0] != counts[1] and len({shard for shard, _ in counts[0]}) > 3
    words = {" ".join((r.text or "").split()) for r in small.collect()}
    assert sum(any(r.text in w for w in words) for r in shards) > 0.5 * len(shards)
