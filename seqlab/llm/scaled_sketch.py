"""Document fingerprints by threshold-scaled sketches (op 11), in DataFrame functions only.

A text's sketch holds every distinct hash of its five-word shingles (A-Z in lower case, words between
blanks; a text of fewer words is one shingle) that lies below ``1 / scale`` of the hash space.
The bound is the same for all texts, so the sketch of a union is the union of sketches, and the share of a text's
retained hashes that another sketch holds estimates the containment of the one in the other,
however unequal their lengths.  A text with words but without a hash below the bound keeps its least
hash alone (``merged`` keeps that rule), so only texts without words have empty sketches.
Hashes are the first 16 hex digits of MD5, which SQL engines have as well.

Likeness of a fingerprint to another: the share of its hashes that the other holds; two empty ones are
alike (1), an empty one and another are not (0).

Next documents come from one shuffle: ids are cut into blocks at quantiles (a hot id is split by text
hash), a copy of each block's first row goes to the block before, and a window per block looks one row ahead.

Cases: a null text is empty; ids ascend with nulls first, rows of one id by their text's hash; a repeated row
is followed by its copy; the only row of a table follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.llm.common import fresh
from seqlab.operators.order import BROADCAST_BLOCKS, assign_blocks, plan_blocks

SHINGLE = 5
SCALE = 8
DIGITS = 16
_BLANK = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a block: few, so that a middling table fills a cluster; more where that made over 1024 blocks.
BLOCK_ROWS, MOST_BLOCK_ROWS = 1_000, 200_000


def bound(scale: int) -> str:
    """Retained hashes, as lower-case hex, come before this string."""
    return f"{-(-(1 << 32) // scale):08x}" if scale > 1 else "g"


def _retained(hashes: Column, scale: int) -> Column:
    """Of 16-digit hashes: the distinct ones below the bound, sorted, or else the least one."""
    low = F.filter(hashes, lambda h: h < F.lit(bound(scale)))
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(
        F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull()))


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE, k: int = SHINGLE) -> DataFrame:
    """``df`` with ``out``: the sketch of column ``text`` (array of hex strings, sorted)."""
    w, h = fresh(df, "words_", "hashes_")
    words = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BLANK)
    df = df.withColumn(w, F.filter(words, lambda x: x != ""))
    n = F.size(w)
    digits = lambda s: F.substring(F.md5(s), 1, DIGITS)
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: digits(F.concat_ws(" ", *[F.col(w)[i + j] for j in range(k)])))
    few = F.array(digits(F.concat_ws(" ", w)))
    df = df.withColumn(h, F.when(n >= k, many).when(n > 0, few).otherwise(F.array().cast("array<string>")))
    return df.withColumn(out, _retained(F.col(h), scale)).drop(w, h)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return _retained(F.concat(a, b), scale)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles behind sketch ``a`` that are behind ``b`` too."""
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def with_next(df: DataFrame, key: str, tie: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each (column, new name) of ``columns``, that column of the next row by (``key`` nulls first, ``tie``).

    ``key`` and ``tie`` are long columns; the first row follows the last.
    """
    pos, low, first, prev, to = fresh(df, "pos_", "low_", "first_", "prev_", "to_")
    keyed = df.withColumn(pos, F.coalesce(F.col(key), F.lit(-(1 << 63))))
    n = df.count()
    plan = plan_blocks(keyed, pos, tie, max(1, min(1024, n // BLOCK_ROWS), n // MOST_BLOCK_ROWS))
    keyed = assign_blocks(keyed, pos, tie, plan)
    here = F.struct(pos, tie)
    firsts = keyed.groupBy("_blk", "_sub").agg(F.min(here).alias(low))
    # One row per block, whose number plan_blocks bounds.
    order = Window.orderBy("_blk", "_sub")
    place = F.struct("_blk", "_sub")
    last = F.last(place).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.withColumn(prev, F.coalesce(F.lag(place).over(order), last))
    if plan.max_rows <= BROADCAST_BLOCKS:
        firsts = F.broadcast(firsts)
    row = lambda at, copy: F.struct(at["_blk"].alias("blk"), at["_sub"].alias("sub"), F.lit(copy).alias("copy"))
    own = row(place, False)
    places = F.when(here == F.col(low), F.array(own, row(F.col(prev), True))).otherwise(F.array(own))
    rows = keyed.join(firsts, ["_blk", "_sub"]).withColumn(to, F.explode(places))
    ahead = Window.partitionBy(f"{to}.blk", f"{to}.sub").orderBy(f"{to}.copy", pos, tie)
    rows = rows.select("*", *[F.lead(c).over(ahead).alias(name) for c, name in columns.items()])
    return rows.where(~F.col(f"{to}.copy")).select(*df.columns, *columns.values())


def half_edited(text: Column, following: Column) -> Column:
    """``text`` whose last floor(n / 2) code points are replaced by the first as many (or all) of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def op11_document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (retained hashes, comma-joined), near_edited, near_next."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_sketch(docs.withColumn("tie", F.xxhash64("text")), "text", "sketch")
    docs = docs.withColumn("fingerprint", F.concat_ws(",", "sketch")).drop("sketch")
    rows = with_next(docs, "doc_id", "tie", {"text": "next_text", "fingerprint": "next_fingerprint"})
    rows = with_sketch(rows.withColumn("edited", half_edited(F.col("text"), F.col("next_text"))), "edited", "edited_sketch")
    hashes = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    own = hashes("fingerprint")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       "fingerprint", F.concat_ws(",", "edited_sketch").alias("edited_fingerprint"),
                       containment(own, F.col("edited_sketch")).alias("near_edited"),
                       containment(own, hashes("next_fingerprint")).alias("near_next"))
