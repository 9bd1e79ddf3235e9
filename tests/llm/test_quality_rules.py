import brute

from seqlab.llm import quality_rules as Q

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(docs):
    rows = Q.op6_quality_rules(docs).collect()
    got = sorted([(r.doc_id, *[r[c] for c in BASE]) for r in rows], key=str)
    want = sorted([(r.doc_id, *brute.quality_base(r.text)) for r in docs.select("doc_id", "text").collect()], key=str)
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows) and all(r.kept is not None for r in rows)
    return rows


def test_small_table_and_labels(spark, small):
    rows = {r.doc_id: r for r in check(small)}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    verdicts = Q.op6_quality_rules(docs).collect()
    kept, failed = {r.doc_id: r.kept for r in verdicts}, {r.doc_id for r in verdicts if r.base_failed}
    good = [kept[r.doc_id] for r in labels if r.quality == 1 and r.doc_id not in failed]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) >= 0.98 * len(good), (sum(good), len(good))
    assert sum(bad) <= 0.05 * len(bad), (sum(bad), len(bad))
    assert any(r.kept for r in rows.values())


def test_odd_rows(odd, none):
    check(odd)
    check(none)
    assert Q.quality_filter(odd).columns == odd.columns


def test_native_plan(small):
    plan = Q.op6_quality_rules(small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
