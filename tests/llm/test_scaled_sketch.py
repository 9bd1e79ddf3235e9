import hashlib
import re
from collections import Counter

import brute
import xxhash
from pyspark.sql import functions as F

from seqlab.llm import scaled_sketch as S

COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def sketch(text, scale=8):
    ws = [w for w in re.split(r"[\x20\t-\r]+", text.translate(brute.LOWER)) if w]
    shingles = [ws[i:i + 5] for i in range(len(ws) - 4)] or ([ws] if ws else [])
    hs = [hashlib.md5(" ".join(s).encode()).hexdigest()[:16] for s in shingles]
    low = sorted({h for h in hs if int(h, 16) < 2**64 / scale})
    return low or ([min(hs)] if hs else [])


def near(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(a) if a else 0.0


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def check(docs):
    rows = sorted([(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()],
                  key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b), near(a, b), near(a, c)))
    got = S.op11_document_fingerprints(docs)
    assert got.columns == COLS
    assert Counter(map(tuple, got.collect())) == Counter(want)
    return want


def test_given_table(spark):
    want = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    long = [w for w in want if w[1] > 1000]
    assert sum(w[5] > w[6] for w in long) >= 0.95 * len(long)
    assert abs(sum(w[5] for w in long) / len(long) - 0.5) < 0.05


def test_odd_rows(odd, none):
    check(odd)
    check(none)
    check(odd.limit(1))


def test_blocks(spark, monkeypatch):
    """Many blocks, a hot id that is split by text hash, null ids: each row still meets the next one."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 20)
    docs = spark.range(600).selectExpr("case when id % 3 = 0 then 77L when id % 50 = 1 then null else id end as doc_id",
                                       "concat('a b c d ', id, ' e f g h i ', id * 7) as text")
    check(docs)


def test_merge_and_containment(spark):
    """The sketch of two texts' shingles is the merge of their sketches; containment is right for very unequal texts."""
    small = " ".join(f"w{i}" for i in range(4000))
    other = " ".join(f"v{i}" for i in range(40_000))
    df = spark.createDataFrame([(small, other)], "a string, b string").withColumn("c", F.concat_ws(" . . . . . ", "a", "b"))
    for c in "abc":
        df = S.with_sketch(df, c, f"s{c}")
    r = df.select(S.containment(F.col("sa"), F.col("sc")).alias("inside"), S.containment(F.col("sc"), F.col("sa")).alias("share"),
                  S.merged(F.col("sa"), F.col("sb")).alias("m"), "sa", "sb", "sc").first()
    assert r.inside == 1.0 and abs(r.share - 4000 / 44_000) < 0.02
    assert r.m == sorted({*r.sa, *r.sb}) and set(r.m) <= set(r.sc)
    short = spark.createDataFrame([("one two three",), ("four",)], "t string")
    got = S.with_sketch(short, "t", "s", scale=1_000_000)
    assert [len(x.s) for x in got.collect()] == [1, 1]
    hashes = [x.s for x in got.collect()]
    assert got.agg(F.first(S.merged(F.array(F.lit(hashes[0][0])),
                                    F.array(F.lit(hashes[1][0])), 1_000_000))).first()[0] == [min(h[0] for h in hashes)]


def test_native_plan(small):
    plan = S.op11_document_fingerprints(small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
