from seqlab.llm import license_scan as L


def test_families_and_clean_text(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    rows = {r.doc_id: r for r in L.licence_scan(docs, model).collect()}
    assert len(rows) == docs.count()
    says = {"Licensed under the Apache License, Version 2.0.": "apache", "GNU General Public License, version 3.": "gpl",
            "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    for r in docs.collect():
        want = ",".join(sorted({f for line, f in says.items() if line in r.text}))
        assert rows[r.doc_id].licences == want, (r.doc_id, want, rows[r.doc_id])
        assert rows[r.doc_id].n_paragraphs == sum(bool(x.strip()) for x in r.text.split("\n"))
    # Notices inside other prose, in other case and spacing, and every template; near misses stay unknown.
    cases = [(i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in L.TEMPLATES.items() for t in ts)]
    cases += [(100, "Some words first. RELEASED under the\tMIT License and then others", "mit"), (101, "a license to kill, version 2.0", ""),
              (102, "the of and in the of this work is", ""), (103, "line\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "cc-by-nc,mit")]
    got = {r.doc_id: r for r in L.licence_scan(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string"), model).collect()}
    assert {i: got[i].licences for i, _, _ in cases} == {i: f for i, _, f in cases}
    assert got[103].n_licence == 2
    assert L.licence_scan(odd, model).count() == odd.count() and L.licence_scan(none, model).count() == 0


def test_empty_corpus_trains_on_templates(none):
    assert L.op10_licence_scan(none).count() == 0


def test_native_plan(small):
    plan = L.op10_licence_scan(small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
