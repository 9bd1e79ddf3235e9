import hashlib
import random
import re

from seqlab.llm import secret_scan as S


def brute(text):
    """The contract's base spans, one kind after the other."""
    text = text or ""
    word = "(" + "|".join(("password", "passwd", "secret", "token", "api_?key")) + ")"
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)  # ASCII letters only
    out, at = [], 0
    while m := re.compile(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").search(low, at):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
        at = m.end()
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


CASES = ['token = "abcdef"', "secret=token:abcdefgh", "Password: x token=yyyyyy", "api_key='A+/b_c.=-'", "apikey==abcdef", "ſecret=abcdefg toKen=abcdefg",
         "AKIAAKIA" + "B" * 20, "xAKIA" + "0" * 15, "AKIA" + "Z" * 16 + "é", "f" * 23, "g" + "0" * 24 + "h", "é token : " + "ab" * 20, None, "",
         'PASSWD"  :  "hunter22" secret = q', "token = abcde", "token\n=abcdefg"]


def check(docs):
    rows = S.op4_secret_scan(docs).collect()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        b = brute(r.text)
        base = ",".join(f"{S.KINDS[k]}:{a}:{z}" for a, k, z in b)
        want.setdefault(r.doc_id, []).append((*[sum(k == i for _, k, _ in b) for i in range(3)], hashlib.sha256(base.encode()).hexdigest(), base))
    assert len(rows) == docs.count()
    for r in rows:
        got = ",".join(x for x in r.spans.split(",") if not x.startswith("learned"))
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, got) in want[r.doc_id]
        places = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x]
        assert [p[0] for p in places] == sorted(p[0] for p in places)
    return rows


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = check(docs)
    assert sum(r.n_assign for r in rows) > 5
    clean = [r for r in rows if not r.spans.replace("learned", "")]
    assert sum("learned" in r.spans for r in rows) <= 0.01 * len(rows) and clean


def test_cases_and_odd_rows(spark, odd, none):
    check(spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string"))
    check(odd)
    assert check(none) == []


def test_inference_learns_the_formats():
    rnd = random.Random(2)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    keys = ["AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(200)]
    words = ["".join(rnd.choice(["ing", "the", "on", "er", "st", "ly"]) for _ in range(7)) for _ in range(1000)]
    f = S.Formats({"hex": hexes[:150], "access": keys[:150]}, words[:800])
    assert all(map(f.is_secret, hexes[150:])) and all(map(f.is_secret, keys[150:]))
    assert not any(map(f.is_secret, words[800:])) and not any(f.is_secret(w.upper()) for w in words[800:])
    assert all(len(a.arcs) for a in f.kinds.values())


def test_automaton_merges_and_is_a_distribution():
    rnd = random.Random(1)
    sample = ["ab" * (1 + int(rnd.expovariate(0.7))) for _ in range(2000)]
    a = S.Automaton(sample, symbols=2)
    live, todo = {0}, [0]
    while todo:
        for t, _ in a.arcs[todo.pop()].values():
            if t not in live:
                live.add(t)
                todo.append(t)
    assert len(live) <= 4  # the prefix tree has more than 13 states
    assert a.score("abab") > a.score("abba") and a.score("ab" * 3) > a.score("ba" * 3)
