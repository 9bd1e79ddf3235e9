import numpy as np

from seqlab.llm import quality_ordinal as Q


def test_held_out_grades(spark, monkeypatch):
    """Two thirds of the labels train the model; it grades the others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = Q.train(docs, labels.where("doc_id % 3 > 0"))
    assert model.cuts == sorted(model.cuts)
    rows = Q.score(docs, model).join(Q.graded(labels.where("doc_id % 3 = 0")), "doc_id").collect()
    by = {g: [r for r in rows if r.grade == g] for g in range(3)}
    means = [np.mean([r.expected_grade for r in by[g]]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert np.mean([r.selected for r in by[2]]) > 0.97
    assert np.mean([r.selected for r in by[0]]) < 0.1 and np.mean([r.selected for r in by[1]]) < 0.5


def test_odd_rows(spark, odd, none, small):
    labels = spark.createDataFrame([(0, 0, 0), (3, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false")):
        rows = Q.op5_quality_ordinal(odd, lab).collect()
        assert len(rows) == odd.count()
        assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_good <= 1 and r.selected is not None for r in rows)
        assert not any(r.selected for r in rows if r.doc_id in (0, 1, 2))
    assert Q.op5_quality_ordinal(none, labels).count() == 0
    assert {r.doc_id: r.grade for r in Q.graded(labels).collect()} == {0: 0, 3: 0, 99: 1}


def test_gradient_reaches_the_ordered_optimum():
    """Cumulative frequencies without features; a feature that decides moves the grade."""
    rows = [(g, [70] if g == 0 else [80] if g == 2 else [90]) for g in (0, 1, 2) for _ in range(50)]
    m = Q.OrdinalModel.fit(rows)
    p = [m.probabilities({s}) for s in (70, 90, 80)]
    assert p[0][0] > 0.9 and p[1][1] > 0.8 and p[2][2] > 0.9 and abs(sum(p[0]) - 1) < 1e-9
    flat = Q.OrdinalModel.fit([(g, []) for g in (0, 0, 1, 2)] * 50).probabilities(set())
    assert np.allclose(flat, [0.5, 0.25, 0.25], atol=0.02)
