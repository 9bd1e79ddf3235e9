"""Sharding by vector bin packing (op 8): bytes, tokens and rows are balanced jointly.

Law ``bytes``: shard sizes are near equal, and so are tokens and rows.  A group (rows of equal
text) is a vector (bytes, tokens, rows) and goes to the shard whose residual
capacity has the highest dot product with it.  Large groups come first: a tier of groups is dealt by key
hash to as many packing tasks as leave each group a fourth of a task's share of a shard at most, from
one task for the largest to one per ``task_rows`` rows for the smallest, 16 times as many from tier to tier.
So a task packs a bounded number of groups, largest first, into its part of what the tiers before left free
(a table of a row per shard, all that passes the driver), and the tasks' small remainders start at different shards.

A group stays whole up to a whole shard's share in every dimension.  A larger one is split by doc_id into pieces of
about a fourth of a share, so a text that a third of all rows hold cannot overfill one.  Shards depend on the
rows' values alone, not on their order or files.

Cases: a null text has no bytes or tokens (size 16) and groups with the empty
one; repeated rows get slots of their own and one shard (rows without doc_id in a split group are dealt by row); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.common import saved, text_key

SHARDS = 40
TASK_ROWS = 20_000
TIER = 16


def pack(vectors, shards: int, first: int = 0, used=None):
    """Greedy vector bin packing of the rows -> shard per row; ``used``: what the shards hold already.

    The rows come by their largest share of a shard in any dimension, greatest first (ties in the
    order given), and each goes to the shard with the highest dot product of row and residual
    capacity.  A residual may turn negative and then counts against its shard, so that a row without
    room anywhere still goes where it adds least.  Last, ``even_out`` levels the first dimension.
    """
    import numpy as np

    used = np.zeros((shards, vectors.shape[1])) if used is None else np.roll(used, -first, axis=0)
    share = np.maximum((vectors.sum(0) + used.sum(0)) / shards, 1e-9)
    v, left, out = vectors / share, 1 - used / share, np.empty(len(vectors), np.int32)
    for i in np.argsort(-v.max(1), kind="stable"):
        best = np.argmax(left @ v[i])
        left[best] -= v[i]
        out[i] = best
    even_out(vectors, out, shards, held=used[:, 0])
    return (out + first) % shards


def even_out(vectors, at, shards: int, rounds: int = 10, held=0) -> None:
    """Level the first dimension in place, beside what is ``held`` already: the fullest and the emptiest shard swap the two rows, alike in
    the last dimension, whose difference is nearest to half their gap; at most ``rounds`` swaps a shard.
    A shard that no swap helps (it may hold a row above a shard's share) is left as it is."""
    import numpy as np

    load, fixed = np.bincount(at, vectors[:, 0], shards) + held, np.zeros(shards, bool)
    for _ in range(rounds * shards):
        high, low = np.where(fixed, -np.inf, load).argmax(), np.where(fixed, np.inf, load).argmin()
        gap, best, pair = load[high] - load[low], 0.0, None
        mine, other = np.flatnonzero(at == high), np.flatnonzero(at == low)
        for kind in np.intersect1d(vectors[mine, -1], vectors[other, -1]):
            a, b = (x[vectors[x, -1] == kind] for x in (mine, other))
            b = b[np.argsort(vectors[b, 0], kind="stable")]
            near = np.searchsorted(vectors[b, 0], vectors[a, 0] - gap / 2)
            for j in (np.maximum(near - 1, 0), np.minimum(near, b.size - 1)):
                move = vectors[a, 0] - vectors[b[j], 0]
                gain = np.minimum(move, gap - move)
                i = gain.argmax()
                if gain[i] > best:
                    best, pair = gain[i], (a[i], b[j[i]], move[i])
        if pair is None:
            fixed[high] = True
            continue
        at[pair[0]], at[pair[1]] = low, high
        load[high] -= pair[2]
        load[low] += pair[2]


def assign_shards(docs: DataFrame, shards: int = SHARDS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, key, law, shard, slot, grown_shard) for every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = saved(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"), text_key("text").alias("key"), F.monotonically_increasing_id().alias("rid")), "shard-rows")
    n, *totals = rows.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    tasks = max(1, math.ceil(n / task_rows))

    def sized(by):  # what a group holds, and its largest share of a shard
        groups = rows.groupBy(*by).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
        parts = [F.col(c) * F.lit(shards / max(1, total or 0)) for c, total in zip("btr", (*totals, n))]
        return groups.withColumn("share", F.greatest(*parts))

    # At most one group a shard and dimension holds more than a shard's share.
    large = saved(sized(["key"]).where("share > 1").select("key", F.ceil(F.col("share") * 4).cast("long").alias("parts")), "shard-large")
    own = F.xxhash64(F.coalesce("doc_id", "rid"))
    rows = saved(rows.join(F.broadcast(large), "key", "left").withColumn(
        "piece", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(own, F.col("parts"))).cast("long")).drop("parts"), "shard-pieces")
    counts = [1]
    while counts[-1] < tasks:
        counts.append(min(tasks, counts[-1] * TIER))
    tier = F.lit(0)
    for i, c in enumerate(counts[1:], 1):
        tier = F.when(F.col("share") * F.lit(4.0 * c) <= 1, F.lit(i)).otherwise(tier)
    groups = sized(["key", "piece"]).withColumn("tier", tier)
    bins = F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("tier") + 1)
    groups = saved(groups.withColumn("bin", F.pmod(F.xxhash64("key", "piece"), bins).cast("int")), "shard-groups")
    placed = _placed(groups, counts, shards)
    rows = saved(rows.join(placed, ["key", "piece"]), "shard-placed")
    # Slots: numbered inside a cell of a shard, then moved past the shard's earlier cells; a tier of few tasks has more cells in each.
    cells = F.element_at(F.array(*[F.lit(math.ceil(tasks / c)) for c in counts]), F.col("tier") + 1)
    rows = rows.withColumn("cell", F.pmod(own, cells).cast("int"))
    at = ["tier", "bin", "cell"]
    before = Window.partitionBy("shard").orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("shard", *at).count().select(
        "shard", *at, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("shard", *at).orderBy("doc_id", "rid")) - 1
    return (rows.withColumn("local", local).join(offset, ["shard", *at])
            .select("doc_id", "size", "tokens", "text_crc32", "key", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.col("local")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def _placed(groups: DataFrame, counts: list[int], shards: int) -> DataFrame:
    """(key, piece, tier, bin, shard) of the groups, tier by tier; the loads of the shards go from tier to tier."""
    import numpy as np

    def packing(used):
        def run(pdf):
            pdf = pdf.sort_values(["k1", "k2", "piece"])
            pdf["shard"] = pack(pdf[["b", "t", "r"]].to_numpy(float), shards, int(pdf["bin"].iloc[0]) * 7 % shards, used)
            return pdf
        return run

    load, out = np.zeros((shards, 3)), None
    for tier, tasks in enumerate(counts):
        one = groups.where(F.col("tier") == tier).select("bin", "key.k1", "key.k2", "piece", "b", "t", "r")
        one = saved(one.groupBy("bin").applyInPandas(packing(load / tasks), "bin int, k1 long, k2 long, piece long, b long, t long, r long, shard int"), "shard-tier")
        if tier + 1 < len(counts):
            load = load.copy()
            for r in one.groupBy("shard").agg(F.sum("b"), F.sum("t"), F.sum("r")).collect():
                load[r[0]] += r[1:]
        one = one.select(F.struct("k1", "k2").alias("key"), "piece", F.lit(tier).alias("tier"), "bin", "shard")
        out = one if out is None else out.union(one)
    return out


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the rows of ``docs`` as Parquet, one folder per shard; rows that repeat go together."""
    at = assign_shards(docs, shards).groupBy(F.col("doc_id").alias("_at_id"), F.col("key").alias("_at_key")).agg(F.min("shard").alias("shard"))
    same = docs["doc_id"].eqNullSafe(F.col("_at_id")) & (text_key(docs["text"]) == F.col("_at_key"))
    docs.drop("shard").join(at, same).drop("_at_id", "_at_key").write.partitionBy("shard").parquet(path)


def op8_sharding(docs: DataFrame) -> DataFrame:
    return assign_shards(docs).drop("key", "tokens")
