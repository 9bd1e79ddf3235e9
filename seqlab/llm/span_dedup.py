"""Substring dedup over sliding sentence spans (op 7).

Every run of ``run`` consecutive sentences with at least ``min_words`` words is hashed
(96 bits of its lower-cased words) and the hashes are joined globally.  A
sentence that lies in any occurrence of a repeated run but the first one (by
doc_id, text hash, position; rows without doc_id last) is removed.

A sentence ends at ``.``, ``!`` or ``?`` before a blank, or at a line end, and has
``SHORT_WORDS`` words at least (a shorter one goes with the next).  One of more than
``long_words`` words is cut after the word of the least hash in each window of so many, so
that no unit is longer and cuts depend on nearby words alone: a passage of more than 50 words
holds whole runs wherever it starts, with or without full stops.

Texts are cut once: a written row per document holds the sentence bounds and the hashes.  A count per
64-bit hash, combined before the shuffle, finds what may repeat; only those places meet again with all 96 bits
and their document's key.  The large sides of these joins are read or shuffled for the join alone, so a span
that many documents hold is split by adaptive execution.

Cases: a null or empty text has no sentences and stays as it is; rows that
repeat doc_id and text are one document and get one result; repeats inside one
document count like any others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import saved

RUN, MIN_WORDS, LONG_WORDS, SHORT_WORDS = 3, 12, 9, 4
_END = re.compile(r"[.!?]+(?=\s)|\n")
_WORD = re.compile(r"\S+")


def _window_cuts(hashes: list[int], window: int) -> list[int]:
    """The place of the least hash (the last of equals) in every window of so many."""
    from collections import deque

    queue, out = deque(), []
    for i, h in enumerate(hashes):
        while queue and hashes[queue[-1]] >= h:
            queue.pop()
        queue.append(i)
        if queue[0] <= i - window:
            queue.popleft()
        if i >= window - 1 and (not out or out[-1] != queue[0]):
            out.append(queue[0])
    return out


def sentences(text: str, long_words: int = LONG_WORDS) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of every unit, in code points; the blanks after it belong to it."""
    import xxhash

    out, start, before, words = [], 0, 0, []
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        new = text[before:end].lower().split()
        words += new
        before = end
        if not words or len(new) < SHORT_WORDS and end < len(text):
            continue
        cuts = _window_cuts([xxhash.xxh32_intdigest(w) for w in words], long_words) if len(words) > long_words else []
        if cuts:
            ends, at = [m.end() for m in _WORD.finditer(text, start, end)], 0
            for i in cuts:
                if i + 1 < len(words):
                    out.append((start, ends[i], words[at:i + 1]))
                    start, at = ends[i], i + 1
            words = words[at:]
        out.append((start, end, words))
        start, words = end, []
    if words or start < len(text) and out:  # blanks at the end
        a, _, last = out.pop()
        out.append((a, len(text), last + words))
    return out


def span_hashes(units, run: int = RUN, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(h1, h2, first sentence) of every run of sentences that is long enough: 64 and 32 bits, signed."""
    import xxhash

    joined = [" ".join(w) for _, _, w in units]
    sizes, out = [len(w) for _, _, w in units], []
    for i in range(len(units) - run + 1):
        if sum(sizes[i:i + run]) >= min_words:
            d = xxhash.xxh3_128_digest("\n".join(joined[i:i + run]))
            out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:12], "big", signed=True), i))
    return out


def cut_texts(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, starts, ends, h1, h2, pos) for every row: the bounds of its sentences, and its spans."""
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    lists = {"starts": "int", "ends": "int", "h1": "long", "h2": "int", "pos": "int"}

    def cut(batches):
        import pyarrow as pa

        kinds = [pa.list_(pa.int64() if t == "long" else pa.int32()) for t in lists.values()]
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part, rows = b.slice(s, 128), []
                for text in part.column(2).to_pylist():
                    units = sentences(text or "")
                    spans = list(zip(*span_hashes(units, run, min_words))) or [()] * 3
                    rows.append(([u[0] for u in units], [u[1] for u in units], *spans))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "th", *lists])

    return src.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, " + ", ".join(f"{c} array<{t}>" for c, t in lists.items()))


def removed_sentences(cuts: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, th, gone): the sentences of each document that a later occurrence of a span covers.

    ``cuts``: a written table with the columns of ``cut_texts`` and a number ``rid`` for every row.
    """
    twice = saved(cuts.select(F.explode("h1").alias("h1")).groupBy("h1").count().where("count > 1").select("h1"), "repeated-hashes")
    places = cuts.select("rid", F.inline(F.arrays_zip("h1", "h2", "pos")))
    places = places.join(twice, "h1", "left_semi").join(cuts.select("rid", "doc_id", "th"), "rid")
    places = saved(places.select("h1", "h2", "doc_id", "th", "pos"), "repeated-places")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "pos")
    # One row per span and task leaves the map side, however often a passage occurs.
    first = places.groupBy("h1", "h2").agg(F.min(at).alias("f"), F.max(at).alias("l")).where("not (f <=> l)")
    first = saved(first.select("h1", "h2", "f"), "first-places")
    later = places.join(first, ["h1", "h2"]).where(~at.eqNullSafe(F.col("f")))
    ranges = later.select("doc_id", "th", F.explode(F.sequence(F.col("pos"), F.col("pos") + run - 1)).alias("i"))
    return ranges.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("i")).alias("gone"))


def span_dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, spans, text) for every row: the text without its removed sentences;
    spans: their start:end in code points of the old text, comma-joined."""
    cuts = saved(cut_texts(docs, run, min_words).withColumn("rid", F.monotonically_increasing_id()), "cut-texts")
    gone = removed_sentences(cuts, run).select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "gone")
    # One row per document again: its bounds, where sentences go, and their number.
    bounds = cuts.select("doc_id", "th", "starts", "ends").dropDuplicates(["doc_id", "th"])
    bounds = bounds.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    none = F.col("gone").isNull()
    bounds = saved(bounds.select(
        F.col("doc_id").alias("i"), F.col("th").alias("t"), F.size("ends").cast("long").alias("n_sentences"), "gone",
        *[F.when(~none, F.col(c)).alias(c) for c in ("starts", "ends")]), "removed-sentences")
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    src = src.join(bounds, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    src = src.select("doc_id", "text", "n_sentences", "gone", "starts", "ends")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for s in range(0, b.num_rows, 128):
                part, rows = b.slice(s, 128), []
                for text, out, starts, ends in zip(*(part.column(i).to_pylist() for i in (1, 3, 4, 5))):
                    where = [(starts[i], ends[i]) for i in out or ()]
                    if where:
                        out = set(out)
                        text = text[:starts[0]] + "".join(text[a:z] for i, (a, z) in enumerate(zip(starts, ends)) if i not in out)
                    rows.append((len(where), ",".join(f"{a}:{z}" for a, z in where), text))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], ["doc_id", "n_sentences", "n_removed", "spans", "text"])

    return src.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_sentences long, n_removed long, spans string, text string")


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    return span_dedup(docs)
