import hashlib
import zlib
from collections import Counter

import pytest

from seqlab.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def build(nodes):
    """levels of a binary tree"""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def leaf(row, more=0):
    doc, source, lang, n, text = row
    values = [doc, source, lang, None if n is None else n + more, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    lows = {g: build([leaf(r) for r in rs]) for g, rs in trees.items()}
    top = build([lows[g][-1][0] for g in langs]) if langs else []
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(trees[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, siblings = leaf(r, 1 if hit else 0), []
            for tree, at in ((lows[g], i), (top, k)):
                for level in tree[:-1]:
                    other = [level[j] for j in range(at & ~1, min((at | 1) + 1, len(level))) if j != at]
                    siblings += other
                    node = H(node, *other) if at % 2 == 0 else H(*other, node)
                    at >>= 1
            out.append((r[0], leaf(r), lows[g][-1][0], top[-1][0], H(*siblings), node, node == top[-1][0]))
    return Counter(out)


def check(docs):
    rows = [tuple(r) for r in docs.select(*M.FIELDS).collect()]
    got = M.op13_merkle_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = expected(rows)
    assert Counter(map(tuple, got.collect())) == want
    return want


def test_given_table(spark):
    want = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert 0 < sum(not w[-1] for w in want) < len(want) / 4


def test_odd_rows(odd, none):
    check(odd)
    check(none)
    check(odd.limit(1))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17, 100])
def test_blocks_and_tiers(spark, n):
    """Small blocks make many tiers, in the languages' trees and in the top tree."""
    docs = spark.range(n).selectExpr("id * 3 - 9007199254740993 as doc_id", "'s' as source", "if(id % 3 = 0, concat('l', id), 'en') as lang",
                                     "nullif(id, 5) as n_chars", "concat('text ', id) as text")
    rows = [tuple(r) for r in docs.collect()]
    got = M.merkle_manifest(M.document_leaves(docs), bits=1 if n < 20 else 2).collect()
    assert Counter((int(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.folded_root == r.root) for r in got) == expected(rows)


def test_versions_copy_only_ancestors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leaves = M.document_leaves(docs)
    proofs = {r.doc_id: r for r in M.merkle_manifest(leaves, bits=3).collect()}
    tampered = {str(r.doc_id) for r in leaves.where("changed is not null").collect()}
    copies = {}
    for r in M.merkle_versions(leaves, bits=3).collect():
        copies.setdefault(r.doc_id, {})[r.level] = r.node
    assert set(copies) == tampered
    langs = dict(docs.groupBy("lang").count().collect())
    for r in docs.collect():
        if str(r.doc_id) in tampered:
            depth = (langs[r.lang] - 1).bit_length() + (len(langs) - 1).bit_length()
            mine = copies[str(r.doc_id)]
            assert len(mine) == depth and mine[max(mine)] == proofs[str(r.doc_id)].folded_root
