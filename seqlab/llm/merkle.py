"""Merkle dataset manifest on a persistent path-copying tree (op 13).

Each row is a leaf; per language a binary hash tree over the leaves by ascending doc_id gives a subroot, and
the same tree over the subroots by language (null first, bytes) gives the root.  A node is the
SHA-256 of its one or two children's hex digests.

The tree is kept in tiers of aligned blocks of 2^10 nodes: a task builds the ten levels of a block from its
nodes, and the block roots are the nodes of the next tier, so no task holds more than a block.  Top down,
every block then gets the siblings on its own way to the root.  A tampered leaf makes a *version*:
it copies the ancestors of that leaf inside its block, shares every other node of it, and goes on through the upper tiers,
whose shared nodes its block's way names, again copying one ancestor per level.  So versions are made where
their leaves are, in as many tasks as there are blocks, and none rebuilds a tree.

Cases: nulls are ``-`` in a leaf and tampering leaves a null n_chars null; rows of equal doc_id go by their leaf; repeated rows are
leaves of their own; a single row is its own root, with no siblings; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import numbered, saved

BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


# --- one block, in a task ---------------------------------------------------------------------------------

def levels(nodes: list[str], depth: int) -> list[list[str]]:
    """The block's nodes and the ``depth`` levels above them, the last of one node."""
    out = [nodes]
    for _ in range(depth):
        below = out[-1]
        out.append([digest(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def way(tree: list[list[str]], i: int) -> list[str]:
    """Per level below the block's root: the sibling of node ``i``'s ancestor after its side, ``L`` or ``R``; ``-`` if it has none."""
    out = []
    for level in tree[:-1]:
        j = i ^ 1
        out.append(("L" if j < i else "R") + level[j] if j < len(level) else "-")
        i >>= 1
    return out


def _split(ways: str) -> list[str]:
    return ways.split(",") if ways else []


def copied_path(node: str, siblings: list[str]) -> list[str]:
    """The ancestors that a version with ``node`` copies, from its parent to the root; all else it shares."""
    out = []
    for s in siblings:
        node = digest(node) if s == "-" else digest(s[1:], node) if s[0] == "L" else digest(node, s[1:])
        out.append(node)
    return out


_TIER = "tree string, idx long, node string, depth int"
_WAYS = "tree string, idx long, way string"


def _block(bits: int) -> Column:
    return F.shiftright("idx", bits).alias("block")


def _tiers(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The tiers of trees given as (tree, idx, node), bottom first; the last has one node per tree, its root.

    Column ``depth``: how many levels the tree has above that tier.
    """
    def block_root(pdf):
        import pandas as pd

        pdf = pdf.sort_values("idx")
        first = pdf.iloc[0]
        up = min(bits, int(first.depth))
        return pd.DataFrame({"tree": [first.tree], "idx": [int(first.idx) >> bits], "node": [levels(list(pdf.node), up)[-1][0]],
                             "depth": [int(first.depth) - up]})

    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"))
    # n - 1 has as many binary digits as the tree has levels above its leaves.
    sizes = saved(sizes.select("tree", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).alias("depth")), "merkle-depth")
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    out = [nodes.join(sizes, "tree")]
    for _ in range(-(-deepest // bits)):
        blocks = out[-1].select("tree", "idx", "node", "depth").groupBy("tree", _block(bits))
        out.append(saved(blocks.applyInPandas(block_root, _TIER), "merkle-tier"))
    return out


def _ways(tiers: list[DataFrame], roots: DataFrame, down_to: int, bits: int) -> DataFrame:
    """(tree, idx, way) of the nodes of tier ``down_to`` (or of the roots, if they lie lower), given the ``roots``' own ways."""
    def block_ways(key, nodes, above):
        import pandas as pd

        nodes = nodes.sort_values("idx")
        if nodes.empty:
            return pd.DataFrame({"tree": [], "idx": [], "way": []})
        tree = levels(list(nodes.node), min(bits, int(nodes.depth.iloc[0])))
        up = _split(above.way.iloc[0])
        return pd.DataFrame({"tree": key[0], "idx": nodes.idx.to_numpy(), "way": [",".join(way(tree, i) + up) for i in range(len(nodes))]})

    ways = roots.select("tree", F.lit(0).cast("long").alias("idx"), "way")
    for tier in reversed(tiers[down_to:-1]):
        nodes = tier.select("tree", "idx", "node", "depth").groupBy("tree", _block(bits))
        ways = saved(nodes.cogroup(ways.groupBy("tree", F.col("idx").alias("block"))).applyInPandas(block_ways, _WAYS), "merkle-ways")
    return ways


@dataclass(frozen=True)
class MerkleTree:
    """leaves: (tree, idx, doc_id as string, node, changed, depth); blocks: (tree, block, way, subroot, root);
    tiers: stored nodes (tree, idx, node, depth) above the leaves, of the languages' trees and of the top tree."""

    leaves: DataFrame
    blocks: DataFrame
    tiers: list[DataFrame]
    bits: int

    def per_block(self, emit, schema: str) -> DataFrame:
        """``emit(leaves, tree levels, way up, subroot, root)`` of every block of leaves."""
        bits = self.bits

        def rows(key, leaves, above):
            import pandas as pd

            if leaves.empty:
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            leaves, up = leaves.sort_values("idx"), above.iloc[0]
            tree = levels(list(leaves.node), min(bits, int(leaves.depth.iloc[0])))
            return emit(leaves, tree, _split(up.way), up.subroot, up.root)

        return self.leaves.groupBy("tree", _block(bits)).cogroup(self.blocks.groupBy("tree", "block")).applyInPandas(rows, schema)


def merkle_tree(leaves: DataFrame, bits: int = BITS) -> MerkleTree:
    """The tree over ``leaves`` (doc_id, lang, leaf, changed), ``changed``: the tampered leaf, or null."""
    # '' stands for a null language: it comes first, as the others get a mark before them.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree")
    rows = leaves.select(tree, "doc_id", F.col("leaf").alias("node"), "changed")
    rows = numbered(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("changed")], "idx")
    tiers = _tiers(rows.withColumn("doc_id", F.col("doc_id").cast("string")), bits)  # pandas has no long with nulls
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "node")
    subroots = numbered(subroots, "tree", [F.col("lang_tree")], "idx")
    top = _tiers(subroots, bits)
    ways = _ways(top, top[-1].select("tree", F.lit("").alias("way")), 0, bits).select("idx", "way")
    root = F.broadcast(top[-1].select(F.col("node").alias("root")))  # one row
    roots = subroots.select(F.col("lang_tree").alias("tree"), F.col("node").alias("subroot"), "idx").join(ways, "idx").crossJoin(root)
    roots = saved(roots.drop("idx"), "merkle-roots")
    blocks = _ways(tiers, roots, 1, bits).withColumnRenamed("idx", "block").join(roots.drop("way"), "tree")
    return MerkleTree(tiers[0], blocks, tiers[1:] + top[1:], bits)


def merkle_manifest(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id (string), leaf, subroot, root, proof_sha256, folded_root of every leaf.

    ``folded_root`` is the root of the leaf's version: of the tampered leaf, where there is one.
    """
    def proofs(leaves, tree, up, subroot, root):
        ways = [way(tree, i) + up for i in range(len(leaves))]
        now = leaves.changed.where(leaves.changed.notna(), leaves.node)
        return leaves.assign(leaf=leaves.node, subroot=subroot, root=root, proof_sha256=[digest(*[s[1:] for s in w]) for w in ways],
                             folded_root=[([x] + copied_path(x, w))[-1] for x, w in zip(now, ways)])[
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]]

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return merkle_tree(leaves, bits).per_block(proofs, schema)


def merkle_versions(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """The nodes that the versions add: (doc_id as string, leaf, level, node), one per level above a tampered leaf, the root last."""
    def copies(leaves, tree, up, subroot, root):
        import pandas as pd

        out = [(d, old, n, node) for i, (d, old, new) in enumerate(zip(leaves.doc_id, leaves.node, leaves.changed)) if new is not None
               for n, node in enumerate(copied_path(new, way(tree, i) + up), 1)]
        return pd.DataFrame(out, columns=["doc_id", "leaf", "level", "node"])

    return merkle_tree(leaves, bits).per_block(copies, "doc_id string, leaf string, level int, node string")


def document_leaves(docs: DataFrame, every: int = TAMPER_EVERY) -> DataFrame:
    """Leaves of ``docs``; where ``every`` divides the CRC-32 of the decimal doc_id, n_chars + 1 makes the tampered leaf."""
    fields = {c: F.col(c) for c in FIELDS}
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return docs.select("doc_id", "lang", leaf_hash(list(fields.values())).alias("leaf"),
                       F.when(hit, leaf_hash(list((fields | {"n_chars": more}).values()))).alias("changed"))


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    rows = merkle_manifest(document_leaves(docs.select(*FIELDS)))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
