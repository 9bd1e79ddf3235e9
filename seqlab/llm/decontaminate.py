"""Benchmark decontamination by winnowing (op 1).

A window is 13 consecutive item words (a shorter item is one window).  In
documents and items alike every window keeps the minimum of its k-gram hashes
as its fingerprint, so two equal windows always have equal fingerprints:
every shared span of 13 words is found.  Document windows whose fingerprint the
benchmark has are candidates; they are joined with the benchmark's windows on
fingerprint and words, which extends a hit to the whole window and verifies it.

Cases: a null or empty text has no words; an item without words has no windows;
items that repeat an item_id count once, items without item_id count as one
item "null"; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import apart, saved, text_key

WINDOW = 13
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
_MUL, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class _Hashes(dict):
    """word -> XXH64, kept for the words seen lately."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def window_prints(hashes, n: int):
    """The fingerprint of each n-word window: the minimum hash of its k-grams."""
    import numpy as np

    k = max(1, round(0.4 * n))
    m = hashes.size - k + 1
    h = hashes[:m].copy()
    for j in range(1, k):
        h *= np.uint64(_MUL)
        h += hashes[j:j + m]
    h ^= np.uint64(n)
    for shift in (32, 29):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(_MIX)
    wide, w = 1, n - k + 1
    while 2 * wide <= w:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    return np.minimum(h[:wide - w], h[w - wide:]) if wide < w else h


def text_windows(data: bytes | None, sizes: list[int], cache: dict, kept=None, piece: int = 1 << 20):
    """Number of words, and (fingerprint, size, start, words) of the windows whose fingerprints ``kept`` passes."""
    import numpy as np

    data, start, count, tail, out = (data or b"").lower(), 0, 0, [], []
    longest = max(sizes, default=1)
    while start < len(data):
        end = min(len(data), start + piece)
        if end < len(data):
            m = _GAP.search(data, end)
            end = m.start() if m else len(data)
        fresh = _WORD.findall(data[start:end])
        start = end
        words = tail + fresh
        hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        for n in sizes:
            skip = max(0, len(tail) - n + 1)  # windows that end in the tail are done
            if len(words) - skip < n:
                continue
            fp = window_prints(hashes[skip:], n)
            at = np.arange(fp.size) if kept is None else np.flatnonzero(kept(fp))
            out.extend((int(f), n, count - len(tail) + skip + i, b" ".join(words[skip + i:skip + i + n]))
                       for f, i in zip(fp[at].view(np.int64), at.tolist()))
        count += len(fresh)
        tail = words[max(0, len(words) - longest + 1):] if longest > 1 else []
    return count, out


def item_windows(items: DataFrame, id_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(item, fp, n, w): the windows of every item, with their words."""
    src = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), "text")

    def run(batches):
        import pyarrow as pa

        cache = _Hashes()
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part, rows = b.slice(s, 512), []
                for item, data in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    n = min(window, len(_WORD.findall((data or b"").lower())))
                    if n:
                        rows += [(item, f, k, w.decode()) for f, k, _, w in text_windows(data, [n], cache)[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))],
                    ["item", "fp", "n", "w"])

    return src.mapInArrow(run, "item string, fp long, n int, w string").distinct()


def _fingerprint_filter(windows: DataFrame, max_bits: int):
    """A bit table of the benchmark's fingerprints with two probes: 64 bits each, ``max_bits`` in all.

    Its size is bounded whatever the benchmark's; past the bound it only lets
    more candidates through to the join, which decides alone.
    """
    import numpy as np

    fps = windows.select("fp").distinct()
    bits = min(max_bits, max(1 << 16, 1 << (64 * max(1, fps.count()) - 1).bit_length()))
    low, high = F.col("fp").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(bits - 1))
    at = fps.select(F.explode(F.array(low, high)).alias("p"))
    table = at.groupBy(F.shiftright("p", 3).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(p & 7 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[table.column("i").to_numpy()] = table.column("b").to_numpy()
    return out


def candidate_windows(docs: DataFrame, windows: DataFrame, window: int = WINDOW, max_bits: int = 1 << 25) -> DataFrame:
    """(doc_id, key, n_words, wins) for every row: the windows that may be the benchmark's."""
    sizes = sorted({window} | {r.n for r in windows.select("n").distinct().collect()})  # at most ``window`` values
    table = docs.sparkSession.sparkContext.broadcast(_fingerprint_filter(windows, max_bits))
    src = docs.select("doc_id", text_key("text").alias("key"), "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache, bits = _Hashes(), table.value
        mask = np.uint64(8 * bits.size - 1)

        def kept(fp):
            hit = np.ones(fp.size, bool)
            for p in (fp & mask, (fp >> np.uint64(32)) & mask):
                hit &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            return hit

        win = pa.list_(pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("s", pa.int64()), ("w", pa.string())]))
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                got = [text_windows(x, sizes, cache, kept) for x in part.column(2).cast(pa.binary()).to_pylist()]
                wins = [[{"fp": f, "n": n, "s": i, "w": w.decode()} for f, n, i, w in x] for _, x in got]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in got], pa.int64()),
                                                  pa.array(wins, win)], ["doc_id", "key", "n_words", "wins"])

    kind = dict(docs.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, key struct<k1:long,k2:long>, n_words long, "
                               "wins array<struct<fp:long,n:int,s:long,w:string>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, items.

    ``contaminated``: at least one word in ``share`` lies in a benchmark window.
    """
    windows = saved(item_windows(items, window=window), "benchmark-windows")
    rows = saved(candidate_windows(docs, windows, window), "decontaminate")
    texts = rows.where(F.size("wins") > 0).select("key", "wins").dropDuplicates(["key"])
    wins = texts.select("key", F.explode("wins").alias("x")).select("key", "x.*")
    found = saved(wins.join(windows.select("fp", "n", "w").distinct(), ["fp", "n", "w"]), "decontaminate-hits")
    spans = F.array_sort(F.collect_list(F.struct("s", (F.col("s") + F.col("n")).alias("e"))))
    cover = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("to")),
                        lambda a, x: F.struct((a["c"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("c"),
                                              F.greatest(a["to"], x["e"]).alias("to")))["c"]
    hit = found.groupBy("key").agg(cover.alias("n_hit"))
    pairs = found.select("key", "fp", "n", "w").distinct().join(windows, ["fp", "n", "w"]).select("key", "item").distinct()
    named = pairs.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = hit.join(named, "key")
    none = F.array().cast("array<string>")
    out = (rows.select("doc_id", "key", "n_words").join(both, "key", "left")
           .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", none)))
    return out.select("doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items")


@apart
def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = contamination(docs, items, window, share).where("contaminated").select(F.col("key").alias("_bad_key")).distinct()
    return docs.join(bad, text_key(docs["text"]) == F.col("_bad_key"), "left_anti")


def op1_benchmark_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).drop("key", "items")
