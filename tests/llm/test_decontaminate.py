import brute

from seqlab.llm import decontaminate as D

KEYS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def rows(df):
    return sorted(map(tuple, df.select(*KEYS).collect()), key=str)


def check(docs, items):
    got = rows(D.op1_benchmark_decontamination(docs, items))
    want = brute.contamination([tuple(r) for r in docs.select("doc_id", "text").collect()],
                               [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got == sorted(want, key=str)
    return got


def test_small_table(small, items):
    assert any(r[-1] for r in check(small, items))


def test_odd_rows_short_items_and_nulls(spark, odd, none, items):
    its = spark.createDataFrame([(1, "one"), (2, "a b c"), (2, "A b C"), (3, None), (4, ""), (None, "two WORDS"), (5, "nul unit"),
                                 (6, " ".join(f"w{i}x{i}" for i in range(13))), (7, "é É"), (8, "end end end"),
                                 (9, "same line here same line here same line here same line here same")], "item_id long, text string")
    assert sum(r[2] > 0 for r in check(odd, its)) > 5
    assert check(none, its) == []
    check(odd, its.where("false"))
    kept = D.decontaminate(odd, its)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not r[-1] for r in check(odd, its))


def test_pieces_of_a_long_text():
    """Cutting a long text changes nothing."""
    text = " ".join(f"v{i * 7919 % 1009}" for i in range(4000)).encode()
    whole = D.text_windows(text, [3, 13], D._Hashes())
    cut = D.text_windows(text, [3, 13], D._Hashes(), piece=500)
    assert whole[0] == cut[0] == 4000 and sorted(whole[1]) == sorted(cut[1])


def test_equal_windows_have_equal_fingerprints_and_are_few():
    a = D.text_windows(b" ".join(b"a%d" % (i % 500) for i in range(5000)), [13], D._Hashes())[1]
    by = {}
    for f, _, _, w in a:
        assert by.setdefault(w, f) == f
    assert len(set(by.values())) < 0.4 * len(by)


def test_short_pieces_keep_all_their_words():
    """Pieces of fewer words than the longest window lose none at their ends."""
    text = b" ".join(b"w%d" % i for i in range(200))
    whole = D.text_windows(text, [3, 13], D._Hashes())
    for piece in range(4, 80):
        got = D.text_windows(text, [3, 13], D._Hashes(), piece=piece)
        assert got[0] == whole[0] and sorted(got[1]) == sorted(whole[1]), piece
