"""Mixing sources to target weights (op 9).

The words of a source form one stream (documents in an order given by hashes),
cut into blocks of ``block_words``.  A source's target is turned into a number
of blocks; multinomial draws spread that number over the output shards.  The
source's slots, numbered through the shards, are mapped to blocks by a
pseudorandom permutation (a Feistel network walked until it lands inside the
range), a new one for every pass over the source, so a block is used at most
``ceil(slots / blocks)`` times and never more than ``repeat`` times.  Slots and blocks
are joined by block index.  Every draw depends on the seed and the data alone.

Cases: a null text has no words and is never taken; a null source is a source,
the last one; repeated rows have places of their own in the stream; an empty
table, or one without words, has targets of zero.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.common import apart, once, saved

WEIGHTS, REPEAT = (5, 2, 1), 3
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
_WORDS = "[^\\x20\\x09-\\x0D]+"


def permute(i, n: int, key: int):
    """A pseudorandom permutation of range(n), applied to an array of indices."""
    import numpy as np

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x):
        left, right = x >> shift, x & mask
        for r in range(4):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key + r * 0xBF58476D1CE4E5B9) % (1 << 64))
            f ^= f >> np.uint64(31)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(33)) & mask)
        return (left << shift) | right

    x = once(np.asarray(i, np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(sid, source, source_size, weight, target) from (source, source_size).

    The words of all sources are shared by weight; a source at ``repeat`` times
    its size stops there and the rest is shared again.  One small aggregate per round.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    src = saved(sizes.withColumn("sid", at.cast("long")).withColumn("weight", w.cast("double")), "sources")
    cap = F.col("source_size") * float(repeat)
    left, weight = src.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    total, stopped, share = left or 0.0, 0, (left or 0.0) / (weight or 1.0)
    while True:
        full = cap < F.col("weight") * share
        n, used, open_weight = src.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
                                       F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or not open_weight:
            break
        stopped, share = n, (total - used) / open_weight
    return src.withColumn("target", F.least(F.col("weight") * share, cap))


def mix_slots(sources: DataFrame, n_shards: int, block_words: int = BLOCK_WORDS, repeat: int = REPEAT, seed: int = 1) -> DataFrame:
    """(sid, shard, slot, block): which block of its source every slot of every output shard takes."""
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    draws = F.round(F.col("target") * blocks / F.col("source_size")).cast("long")
    src = sources.where("source_size > 0").select("sid", blocks.alias("nb"), F.least(draws, repeat * blocks).alias("draws"))

    def counts(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for sid, nb, k in pdf.itertuples(index=False):
                n = np.random.default_rng([seed, sid]).multinomial(k, np.full(n_shards, 1 / n_shards))
                some = np.flatnonzero(n)
                yield pd.DataFrame({"sid": sid, "shard": some, "first": (np.cumsum(n) - n)[some], "n": n[some], "nb": nb})

    def slots(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for sid, shard, first, n, nb in pdf.itertuples(index=False):
                for a in range(first, first + n, 100_000):
                    k = np.arange(a, min(a + 100_000, first + n))
                    block = np.empty(k.size, np.int64)
                    for turn in np.unique(k // nb).tolist():
                        mine = k // nb == turn
                        key = int(np.random.default_rng([seed, sid, turn, 9]).integers(1 << 62))
                        block[mine] = permute(k[mine] % nb, nb, key)
                    yield pd.DataFrame({"sid": sid, "shard": shard, "slot": k - first, "block": block})

    drawn = src.mapInPandas(counts, "sid long, shard long, first long, n long, nb long")
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartition(parts, "sid", "shard").mapInPandas(slots, "sid long, shard long, slot long, block long")


def streams(docs: DataFrame, weights=WEIGHTS, repeat: int = REPEAT, block_words: int = BLOCK_WORDS,
            shard_words: int = SHARD_WORDS, seed: int = 1, bucket_rows: int = 4_000):
    """(rows, placed, cut, slots): the rows of ``docs``; each one's place in its source's stream, with source_size and target; the parts
    (rid, at, len) of its words that lie in each block (sid, block); and the slots (sid, shard, slot, block) of the output shards."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORDS)).cast("long")
    rows = saved(docs.select("*", F.monotonically_increasing_id().alias("_rid"), F.xxhash64("text").alias("_th"), size.alias("_size")), "mix")
    thin = rows.select(F.col("_rid").alias("rid"), "doc_id", "source", F.col("_th").alias("th"), F.col("_size").alias("size"))
    sources = saved(source_targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeat), "targets")
    n, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    rows_n = thin.count()
    thin = thin.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source", "weight")
    # Stream offsets in two steps, so that a hot source is spread over many buckets.
    thin = thin.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th"), F.lit(max(1, math.ceil(rows_n / bucket_rows)))))
    up = Window.unboundedPreceding, -1
    heads = thin.groupBy("sid", "bucket").agg(F.sum("size").alias("s")).select(
        "sid", "bucket", F.coalesce(F.sum("s").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(*up)), F.lit(0)).alias("head"))
    own = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("doc_id", "th", "rid").rowsBetween(*up)), F.lit(0))
    placed = saved(thin.withColumn("own", own).join(heads, ["sid", "bucket"]).select(
        "rid", "doc_id", "sid", "size", "source_size", "target", (F.col("head") + F.col("own")).alias("start")), "mix-stream")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = placed.where("size > 0").select("rid", "sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * block_words, F.col("start"))
    hi = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    cut = cut.select("rid", "sid", "block", (lo - F.col("start")).alias("at"), (hi - lo).alias("len"))
    n_shards = max(1, math.ceil((total or 0) / shard_words))
    return rows, placed, cut, mix_slots(sources, n_shards, block_words, repeat, seed)


def mix(docs: DataFrame, **options):
    """(rows, placed, pieces): as ``streams``, and the parts (rid, at, len, copies) of their words that the mix takes."""
    rows, placed, cut, slots = streams(docs, **options)
    used = slots.groupBy("sid", "block").agg(F.count("*").alias("copies"))
    used = used.hint("merge")  # grown from the few rows of ``sources``, it would seem small enough to broadcast
    return rows, placed, cut.join(used, ["sid", "block"]).select("rid", "at", "len", "copies")


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix as output shards: (shard, sid, slot, n_words, text), one row per slot with the words of the block it takes.

    ``sid`` numbers the sources by code point, null last; how many slots of each source a shard has is the shard's multinomial draw.
    A block that several documents share holds their words one after the other.
    """
    rows, placed, cut, slots = streams(docs, **options)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    parts = cut.join(rows.select(F.col("_rid").alias("rid"), once(words).alias("words")), "rid")
    parts = parts.select("rid", "sid", "block", "at", "len", F.array_join(F.slice("words", (F.col("at") + 1).cast("int"), F.col("len").cast("int")), " ").alias("part"))
    parts = parts.join(placed.select("rid", "start"), "rid")
    blocks = parts.groupBy("sid", "block").agg(F.sum("len").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct((F.col("start") + F.col("at")).alias("from"), "part"))), lambda p: p["part"]), " ").alias("text"))
    return slots.join(blocks, ["sid", "block"]).select("shard", "sid", "slot", "n_words", "text")


@apart
def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each text becomes the words that the mix takes of it (a text taken once
    as a whole stays as it is; a repeat follows on a new line); documents of which nothing is taken go."""
    rows, _, pieces = mix(docs, **options)
    got = pieces.groupBy(F.col("rid").alias("_piece_rid")).agg(
        F.sort_array(F.collect_list(F.struct("at", "len", "copies"))).alias("_pieces"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    turns = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("_pieces", lambda p: p["copies"])) - 1), lambda turn: F.array_join(
        F.transform(F.filter("_pieces", lambda p: p["copies"] > turn), lambda p: F.array_join(
            F.slice(F.col("_words"), (p["at"] + 1).cast("int"), p["len"].cast("int")), " ")), " "))
    plain = F.forall("_pieces", lambda p: p["copies"] == 1) & (
        F.aggregate("_pieces", F.lit(0).cast("long"), lambda a, p: a + p["len"]) == F.col("_size"))
    joined = rows.join(got, rows["_rid"] == F.col("_piece_rid"))
    joined = joined.withColumn("_words", once(F.when(~plain, words)))
    text = F.when(F.col("_words").isNull(), F.col("text")).otherwise(F.array_join(turns, "\n"))
    joined = joined.withColumn("_mixed", once(text))
    return joined.select(*[F.col("_mixed").alias(c) if c == "text" else F.length("_mixed").cast(dict(docs.dtypes)[c]).alias(c)
                           if c == "n_chars" else F.col(c) for c in docs.columns])


def op9_mixing(docs: DataFrame) -> DataFrame:
    _, placed, pieces = mix(docs.select("doc_id", "text", "source"))
    took = pieces.groupBy("rid").agg(F.sum(F.col("len") * F.col("copies")).alias("t"))
    return placed.join(took, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"))
