import random

import brute
from pyspark.sql import functions as F

from seqlab.llm import common, simhash


def want(rows):
    fps = {t: brute.simhash(t) for _, t in rows}
    roots = brute.groups(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    ids = {}
    for d, t in rows:
        if d is not None:
            r = roots[fps[t]]
            ids[r] = min(ids.get(r, d), d)
    return sorted([(d, f"{fps[t]:016x}", ids.get(roots[fps[t]])) for d, t in rows], key=str)


def check(docs):
    got = sorted(map(tuple, simhash.op2_simhash_near_dedup(docs).collect()), key=str)
    assert got == want([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_small_table(small):
    check(small)


def test_odd_rows(odd, none):
    check(odd)
    check(none)
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    groups = simhash.near_groups(odd)
    assert kept.count() == groups.select("root").distinct().count()
    assert simhash.simhash_dedup(none).count() == 0


def test_links_keep_components_when_buckets_are_cut(spark):
    """Dense balls, chains and noise; hot buckets cut into blocks give the same groups."""
    rnd = random.Random(5)
    vals = {rnd.getrandbits(64) for _ in range(150)}
    for c in [rnd.getrandbits(64) for _ in range(3)]:
        for _ in range(60):
            x = c
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            vals.add(x)
    x = rnd.getrandbits(64)
    for _ in range(30):
        for _ in range(3):
            x ^= 1 << rnd.randrange(64)
        vals.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = brute.groups(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for block in (20_000, 7):
        links = common.hamming_links(df, 3, block)
        comp = {r.node: r.component for r in common.components(links).collect()}
        assert {v: comp.get(v, v) for v in signed} == roots
        assert links.count() < 20 * 3 * len(vals)


def test_components_of_a_long_path(spark):
    path = spark.range(500).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {r.component for r in common.components(path).collect()} == {0}
    assert common.components(path.where("false")).count() == 0


def test_pieces(monkeypatch):
    text = " ".join(f"v{i * 7919 % 1009}" for i in range(3000)).encode()
    whole = simhash.text_fingerprint(text)
    monkeypatch.setattr(simhash, "word_pieces", lambda d: common.word_pieces(d, 400))
    assert simhash.text_fingerprint(text) == whole
