"""SimHash near-dedup: pigeonhole blocks, Hamming check, connected groups (op 2).

Cases: a null or empty text has fingerprint zero and links like any other; a
text of fewer words than a shingle is one shingle; equal fingerprints are one
node, so a group of copies of any size costs one row after the first
aggregation; rows without doc_id never name a group unless all of it lacks one.
An empty table gives no rows.  Very long texts are hashed piece by piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import apart, components, hamming_links, saved, word_pieces


def text_fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, as a signed integer."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    votes, total, tail = np.zeros(64, np.int64), 0, []

    def vote(words):
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        line, m = b" ".join(words), len(words) - shingle + 1
        spans = zip((end - size)[:m].tolist(), end[shingle - 1:].tolist())
        h = np.fromiter((digest(line[s:e], 42) for s, e in spans), np.uint64, m)
        return np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(0, dtype=np.int64), m

    for words in word_pieces((data or b"").lower()):
        words = tail + words
        if len(words) >= shingle:
            more, m = vote(words)
            votes, total = votes + more, total + m
            tail = words[len(words) - shingle + 1:]
        else:
            tail = words
    if not total and tail:
        h = np.array([digest(b" ".join(tail), 42)], np.uint64)
        votes, total = np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, th): the signed 64-bit fingerprint and a hash of the text for every row."""
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                fp = [text_fingerprint(x, shingle) for x in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp, pa.int64())], ["doc_id", "th", "fp"])

    return src.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, fp long")


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, th, fp, root, component_id); root: least fingerprint reachable over links of at most
    ``max_bits`` differing bits, component_id: the smallest doc_id of the group."""
    rows = saved(fingerprints(docs, shingle), "simhash")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    comp = components(hamming_links(nodes.select("fp"), max_bits))
    named = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp").select(
        "doc_id", "th", "fp", "root", "component_id")


@apart
def simhash_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays.

    Ties (several texts under one doc_id in a group) go to the smaller text hash,
    rows that repeat doc_id and text are kept once; rows without doc_id come last.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    keep = (near_groups(docs, shingle, max_bits).groupBy("root").agg(first.alias("f"))
            .select(F.col("f.doc_id").alias("_kept_id"), F.col("f.th").alias("_kept_th")))
    return (docs.withColumn("_text_th", F.xxhash64("text"))
            .join(keep, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_text_th") == F.col("_kept_th")), "left_semi")
            .dropDuplicates(["doc_id", "_text_th"]).drop("_text_th"))


def op2_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
