import brute
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from seqlab.llm import decontaminate, line_dedup, mixing, quality_rules, simhash


def test_stages_against_plain_python(spark, small, items):
    docs, cols = small, small.columns
    for (name, stage), left in zip(P.STAGES, range(5, 0, -1)):
        rows = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, "/root/testdata/sf0.001")
        got = {r.doc_id: r for r in out.collect()}
        if left > 1:
            assert out.columns == cols and [t for _, t in out.dtypes] == [t for _, t in small.dtypes]
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.op6_quality_rules(docs).where("kept").collect()}
            assert set(got) == kept and all(not brute.quality_base(rows[d].text)[-1] for d in got)
        elif name == "simhash_near_dedup":
            fps = {d: brute.simhash(r.text) for d, r in rows.items()}
            roots = brute.groups(rows, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
            assert set(got) == set(roots.values())
        elif name == "benchmark_decontamination":
            bad = {r[0] for r in brute.contamination([(d, r.text) for d, r in rows.items()], [tuple(r) for r in items.select("item_id", "text").collect()]) if r[-1]}
            assert set(got) == set(rows) - bad and bad
        elif name == "mixing":
            took = {r.doc_id: r.taken for r in mixing.op9_mixing(docs).collect()}
            assert {d: len(brute.WORD.findall(r.text)) for d, r in got.items()} == {d: n for d, n in took.items() if n}
        else:
            assert set(got) == set(rows)
        if left > 3:
            assert all(got[d] == rows[d] for d in got)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert P.run(spark, "/root/testdata/sf0.001").count() == docs.count()


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
    assert set(E.oracle_sql()) <= set(names)


def test_odd_rows_pass_through_all_stages(spark, odd, none):
    for docs in (odd, none):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert "shard" in docs.columns


#: Names that the operators use for columns of their own.
CLASHING = ("n_words", "kept", "n_lines", "symbols_lo", "_lang", "_w", "_h", "base_failed", "_text_th", "_kept_id", "_bad_key", "_rid", "_size", "_th",
            "_words", "_pieces", "_mixed", "_line_th", "_left", "_gone", "shard", "key", "root", "contaminated")


def test_columns_named_like_an_operators_own(spark, small, items):
    docs = small.limit(60).select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASHING])
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for operator in (quality_rules.quality_filter, simhash.simhash_dedup, lambda d: decontaminate.decontaminate(d, items), mixing.mix_documents,
                     line_dedup.line_dedup):
        out, plain = operator(docs), operator(docs.select(*small.columns))
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)
        assert sorted(tuple(r[c] for c in small.columns) for r in rows) == sorted(map(tuple, plain.collect()))
