import random

from pyspark.sql import functions as F

from seqlab.llm import span_dedup as S


def brute(rows):
    """{(doc_id, text): [removed sentence numbers]} with the order of text hashes given in rows: (doc_id, th, text)."""
    first, places = {}, []
    for d, th, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        units = [" ".join(w) for _, _, w in S.sentences(t or "")]
        for i in range(len(units) - 2):
            run = tuple(units[i:i + 3])
            if sum(len(u.split()) for u in run) >= S.MIN_WORDS:
                if first.setdefault(run, (d, t, i)) != (d, t, i):
                    places += [((d, t), i + j) for j in range(3)]
    out = {}
    for k, i in places:
        out.setdefault(k, set()).add(i)
    return out


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    want = brute(rows)
    got = S.op7_substring_dedup(docs).collect()
    res = []
    for d, _, t in rows:
        units, gone = S.sentences(t or ""), want.get((d, t), set())
        left = t if not gone else t[:units[0][0]] + "".join(t[a:z] for i, (a, z, _) in enumerate(units) if i not in gone)
        res.append((d, len(units), len(gone), ",".join(f"{units[i][0]}:{units[i][1]}" for i in sorted(gone)), left))
    assert sorted(map(tuple, got), key=str) == sorted(res, key=str)
    return got


def test_small_table(small):
    assert any(r.n_removed for r in check(small))


def test_odd_rows(odd, none):
    check(odd)
    assert check(none) == []


def test_sentences_cover_the_text():
    for t in ["", "a", " a. b!  c?d\n\n e", "x " * 100, "One. " + "word other " * 40 + "end. Last", "é.\nß. K"]:
        units = S.sentences(t)
        assert [w for _, _, ws in units for w in ws] == [w.lower() for w in t.split()]
        assert all(a[1] <= b[0] for a, b in zip(units, units[1:]))


def test_planted_passages(spark):
    """Passages of more than 50 words, with or without full stops, wherever they stand: only the first copy stays."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    prose = lambda n, p: " ".join(word() + ("." if rnd.random() < p else "") for _ in range(n))
    passages = [prose(70, 0.2) + "." for _ in range(10)] + [prose(90, 0) for _ in range(5)]
    docs = [(i, f"{prose(60, .15)}. {passages[i % 15]} {prose(40, .15)}") for i in range(60)] + [(100 + i, prose(120, 0.15)) for i in range(40)]
    got = {r.doc_id: r for r in check(spark.createDataFrame(docs, "doc_id long, text string"))}
    texts = dict(docs)
    for i in range(60):
        r = got[i]
        if i < 15:
            assert r.n_removed == 0 and r.text == texts[i]
        else:
            cut = sum(len(texts[i][int(a):int(b)].split()) for a, b in (x.split(":") for x in r.spans.split(",")))
            assert cut >= 0.6 * len(passages[i % 15].split()) and passages[i % 15] not in r.text
    assert all(got[100 + i].n_removed == 0 for i in range(40))


def test_passages_of_51_words_share_a_run_wherever_they_start(small):
    """A passage put at any blank of two texts, with sentences of any length or none, has a span hash in common."""
    texts = [r.text for r in small.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 100]
    for lengths in ((999, 999), (15, 24), (8, 14), (4, 8), (1, 3)):
        found = 0
        for seed in range(120):
            rnd = random.Random(seed)
            word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
            words, left = [], rnd.randint(*lengths)
            for _ in range(rnd.randint(51, 70)):
                left -= 1
                words.append(word() + "." * (left == 0))
                left = left or rnd.randint(*lengths)
            runs = []
            for _ in range(2):
                around = rnd.choice(texts).split(" ")
                at = rnd.randrange(1, len(around))
                units = S.sentences(" ".join(around[:at] + words + around[at:]))
                runs.append({x[:2] for x in S.span_hashes(units)})
            found += bool(runs[0] & runs[1])
        assert found >= 119, (lengths, found)


def test_units_are_short():
    rnd = random.Random(9)
    text = " ".join(rnd.choice(["a", "bc", "def.", "g", "hij", "k\n"]) for _ in range(5000)) + " " + "same " * 100 + "\n \n"
    units = S.sentences(text)
    assert max(len(w) for _, _, w in units) <= S.LONG_WORDS and units[0][0] == 0 and units[-1][1] == len(text)
