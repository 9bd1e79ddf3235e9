"""Reproducible exact sampling, splits and folds.

Every random choice is a hash rank: ``md5('<seed>:<id>')`` orders the rows of a
class, so a sample of exactly ``n`` is ``rank <= n`` and the result does not
depend on partitioning (``rand(seed)`` / ``sampleBy`` do).  The rank is built
without a single-partition window: rows are spread over hash-prefix buckets,
bucket sizes are counted (a small table), and a bucket's offset is the running
sum of the sizes before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.operators.joins import broadcast_if_small


def hash_key(id_col: str | Column, seed: int) -> Column:
    """``md5('<seed>:<id>')`` as a hex string (DuckDB: ``md5('42:' || id)``)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


BUCKET_ROWS = 250_000


def bucket_digits(n_rows: int) -> int:
    """Hex digits so that a bucket of one class holds ``BUCKET_ROWS`` rows on average at most; 3 (4,096 buckets) at least."""
    return max(3, math.ceil(math.log(max(1, n_rows / BUCKET_ROWS), 16)))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``a`` joined with the small table ``b`` on equal keys, null equal to null; the keys come once."""
    b = b.select(*[F.col(k).alias(f"_same_{k}") if k in keys else F.col(k) for k in b.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return a.join(b, on).drop(*[f"_same_{k}" for k in keys])


def hash_rank(df: DataFrame, id_col: str, seed: int = 42, by: Sequence[str] = (), rank_col: str = "rank",
              digits: int | None = None, limit: int | None = None) -> DataFrame:
    """1-based rank of every row within ``by`` in the order ``(md5(seed:id), id)``.

    ``digits`` hex digits of the hash make ``16**digits`` buckets per class; the
    rank window is partitioned by (class, bucket), so even a class holding a
    third of all rows is spread over that many tasks.  Unless given it follows
    from the row count.  ``id`` must be unique.  Rows whose class is null are a class.
    ``limit``: keep only ranks <= limit (an exact-n sample); buckets that start
    past the limit are dropped before the sort, so only about ``limit`` rows
    per class are shuffled and sorted.
    """
    digits = digits or bucket_digits(df.count())
    if limit is not None:
        return _hash_head(df, id_col, seed, list(by), rank_col, digits, limit)
    by = list(by)
    h, b = "_h", "_hb"
    keyed = df.withColumn(h, hash_key(id_col, seed)).withColumn(b, F.substring(F.col(h), 1, digits))
    counts = keyed.groupBy(*by, b).agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(*by).orderBy(b) if by else Window.orderBy(b)
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_cnt")
    w = Window.partitionBy(*by, b).orderBy(F.col(h), F.col(id_col))
    ranked = keyed.withColumn("_rn", F.row_number().over(w))
    # Joined on (class, bucket): the same keys the rank window is partitioned
    # by, so the big side is not shuffled again.
    out = _same(ranked, offsets, [*by, b])
    return out.withColumn(rank_col, F.col("_off") + F.col("_rn")).drop(h, b, "_rn", "_off")


def _hash_head(df: DataFrame, id_col: str, seed: int, by: list, rank_col: str, digits: int,
               limit: int) -> DataFrame:
    h, b = "_h", "_hb"
    keyed = df.withColumn(h, hash_key(id_col, seed)).withColumn(b, F.substring(F.col(h), 1, digits))
    counts = keyed.groupBy(*by, b).agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(*by).orderBy(b) if by else Window.orderBy(b)
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_cnt")
    lim = F.lit(int(limit))
    offsets = offsets.where(F.col("_off") < lim)
    # Rows of buckets that start past the limit never reach the sort.
    kept = _same(keyed, offsets, [*by, b])
    w = Window.partitionBy(*by, b).orderBy(F.col(h), F.col(id_col))
    ranked = kept.withColumn(rank_col, F.col("_off") + F.row_number().over(w))
    return ranked.where(F.col(rank_col) <= lim).drop(h, b, "_off")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def largest_remainder(counts: DataFrame, label: str, total_draws: Column | float, out: str) -> DataFrame:
    """Share ``total_draws`` over classes in proportion to ``n``: floors, then one more
    to the largest remainders (ties by class value).  ``counts`` is the small class table."""
    tot = F.sum("n").over(Window.partitionBy())
    draws = total_draws if isinstance(total_draws, Column) else F.lit(float(total_draws))
    exact = draws * F.col("n").cast("double") / tot.cast("double")
    c = counts.withColumn("_exact", exact).withColumn("_base", F.floor("_exact").cast("long"))
    c = c.withColumn("_rem", F.col("_exact") - F.col("_base"))
    c = c.withColumn("_extra", draws.cast("long") - F.sum("_base").over(Window.partitionBy()))
    c = c.withColumn("_rr", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label))))
    return c.withColumn(out, F.col("_base") + F.when(F.col("_rr") <= F.col("_extra"), 1).otherwise(0)) \
        .select(label, "n", out)


def stratified_split(df: DataFrame, id_col: str, label: str, test_size: float = 0.33, seed: int = 42,
                     side: str = "side") -> DataFrame:
    """``ceil(test_size * n)`` test rows, shared over classes by largest remainder."""
    counts = class_counts(df, label)
    n_test = F.ceil(F.lit(test_size) * F.sum("n").over(Window.partitionBy()).cast("double"))
    alloc = largest_remainder(counts, label, n_test, "_n_test").select(label, "_n_test")
    ranked = hash_rank(df, id_col, seed, by=[label], rank_col="_rk")
    return (_same(ranked, broadcast_if_small(alloc), [label])  # one row per class, size checked
            .withColumn(side, F.when(F.col("_rk") <= F.col("_n_test"), "test").otherwise("train"))
            .drop("_rk", "_n_test"))


def group_key(section: str, id_col: str) -> Column:
    """Group of a row: its section when > 0, else the row itself."""
    return F.when(F.col(section) > 0, F.concat(F.lit("s"), F.col(section).cast("string"))) \
        .otherwise(F.concat(F.lit("r"), F.col(id_col).cast("string")))


def group_split(df: DataFrame, id_col: str, section: str, train_size: float = 0.75, seed: int = 42,
                side: str = "side") -> DataFrame:
    """Whole groups to one side: ``floor(train_size * groups)`` groups train."""
    keyed = df.withColumn("_grp", group_key(section, id_col))
    groups = keyed.select("_grp").distinct()
    ranked = hash_rank(groups, "_grp", seed, rank_col="_grk")
    total = groups.agg(F.floor(F.lit(train_size) * F.count(F.lit(1)).cast("double")).alias("_ntr"))
    sides = (ranked.crossJoin(F.broadcast(total))
             .withColumn(side, F.when(F.col("_grk") <= F.col("_ntr"), "train").otherwise("test"))
             .select("_grp", side))
    return keyed.join(sides, "_grp").drop("_grp")


def is_listed(section: str, listed: Sequence[int]) -> Column:
    """Membership in a list of sections; a ``range`` of any length is one comparison."""
    if isinstance(listed, range) and listed.step == 1:
        return (F.col(section) >= listed.start) & (F.col(section) < listed.stop)
    return F.col(section).isin(list(listed))


def section_ranges(n_sections: int, train: int = 15, test: int = 3) -> tuple[range, range]:
    """Sections 1..n listed whole: the first ``train`` parts of ``train + test`` (rounded up), then the others."""
    cut = -(-n_sections * train // (train + test))
    return range(1, cut + 1), range(cut + 1, n_sections + 1)


def section_range_split(df: DataFrame, id_col: str, label: str, section: str, train_sections: Sequence[int],
                        test_sections: Sequence[int], seed: int = 42, side: str = "side") -> DataFrame:
    """Label-1 rows by listed section; label-0 rows: the first ``int(n0 * f)`` by hash rank
    to train, ``f`` = train share of listed label-1 rows (0.75 if none) (D3).
    Sections in neither list are dropped."""
    pos = df.where(F.col(section) > 0)
    pos = pos.withColumn(side, F.when(is_listed(section, train_sections), "train")
                         .when(is_listed(section, test_sections), "test")).where(F.col(side).isNotNull())
    neg = df.where(F.col(section) == 0)
    share = pos.agg(F.count_if(F.col(side) == "train").alias("_tr"), F.count(F.lit(1)).alias("_all"))
    share = share.select(F.when(F.col("_all") > 0, F.col("_tr") / F.col("_all")).otherwise(F.lit(0.75))
                         .alias("_f"))
    n0 = neg.agg(F.count(F.lit(1)).alias("_n0"))
    cut = F.broadcast(share.crossJoin(n0).select(F.floor(F.col("_n0") * F.col("_f")).alias("_cut")))
    neg = (hash_rank(neg, id_col, seed, rank_col="_rk").crossJoin(cut)
           .withColumn(side, F.when(F.col("_rk") <= F.col("_cut"), "train").otherwise("test"))
           .drop("_rk", "_cut"))
    return pos.unionByName(neg)


def unlisted_sections(df: DataFrame, section: str, train_sections: Sequence[int],
                      test_sections: Sequence[int]) -> DataFrame:
    """Rows a section-range split drops (sections in neither list), per section (Q13: reported, not silent)."""
    listed = is_listed(section, train_sections) | is_listed(section, test_sections)
    return (df.where((F.col(section) > 0) & ~listed)
            .groupBy(section).agg(F.count(F.lit(1)).alias("n_dropped")))


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42,
                     fold: str = "fold") -> DataFrame:
    """Fold = (hash rank within class - 1) mod k."""
    r = hash_rank(df, id_col, seed, by=[label], rank_col="_rk")
    return r.withColumn(fold, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def stratified_group_kfold(df: DataFrame, id_col: str, section: str, k: int = 5, seed: int = 42,
                           fold: str = "fold") -> DataFrame:
    """Sections never cross folds.

    Sections are ranked by (size desc, md5) and dealt out serpentine (0..k-1,
    k-1..0, ...) so fold sizes stay balanced; label-0 rows take hash rank mod k.
    """
    sizes = (df.where(F.col(section) > 0).groupBy(section).agg(F.count(F.lit(1)).alias("_sz"))
             .withColumn("_neg", -F.col("_sz")))
    # Rank sections by (size desc, hash) with the block-wise scan: sections can
    # be many, so no single-partition window.
    from seqlab.operators.order import global_rank
    # Tie-break: the first 15 hex digits of the hash as a number (same order as
    # the hex string; the scan needs a numeric tie to split hot sizes).
    sized = sizes.withColumn("_h", F.conv(F.substring(hash_key(section, seed), 1, 15), 16, 10).cast("long"))
    ranked = global_rank(sized.select(section, "_neg", "_h"), "_neg", "_h", name="_r")
    r0 = F.col("_r") - 1
    serp = F.when(((r0 / k).cast("long") % 2) == 0, r0 % k).otherwise(F.lit(k - 1) - r0 % k)
    sec_folds = ranked.select(section, serp.cast("int").alias(fold))
    pos = df.where(F.col(section) > 0).join(sec_folds, section)
    neg = hash_rank(df.where(F.col(section) == 0), id_col, seed, rank_col="_rk")
    neg = neg.withColumn(fold, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")
    return pos.unionByName(neg)


def undersample_level(counts: DataFrame, ratio: float | None = 1.0, level: int | None = None) -> DataFrame:
    """Level: a given level wins; else ``int(minority * ratio)``; else the majority."""
    agg = counts.agg(F.min("n").alias("minority"), F.max("n").alias("majority"))
    if level is not None:
        lv = F.lit(int(level)).cast("long")
    elif ratio is not None:
        lv = (F.col("minority").cast("double") * F.lit(float(ratio))).cast("long")
    else:
        lv = F.col("majority")
    return agg.withColumn("level", lv)


def undersample(df: DataFrame, id_col: str, label: str, ratio: float | None = 1.0, level: int | None = None,
                seed: int = 42, keep_rank: bool = False) -> DataFrame:
    """Every class above the level is cut to exactly ``level`` rows, without replacement."""
    lv = undersample_level(class_counts(df, label), ratio, level).first()["level"]  # one number
    out = hash_rank(df, id_col, seed, by=[label], rank_col="_rk", limit=int(lv))
    return out if keep_rank else out.drop("_rk")


def complement(df: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """Rows not in ``sample``."""
    return df.join(sample.select(id_col), id_col, "left_anti")


def split_summary(df: DataFrame, side: str, label: str, section: str) -> DataFrame:
    """Per side: rows, label counts and number of sections."""
    return df.groupBy(side).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_label_1"),
        F.count_if(F.col(label) == 0).alias("n_label_0"),
        F.countDistinct(F.when(F.col(section) > 0, F.col(section))).alias("n_sections"))


def split_sections(df: DataFrame, side: str, section: str) -> DataFrame:
    """The section list of each side as rows (side, section), not one unbounded array."""
    return df.where(F.col(section) > 0).select(side, section).distinct()
