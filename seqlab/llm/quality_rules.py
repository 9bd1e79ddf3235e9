"""Quality rules with adaptive thresholds (op 6), in DataFrame functions only.

Per (lang, source) group, mergeable quantile sketches (``percentile_approx``:
partial sketches per task, merged per group) give the quartiles of each ratio;
a document is rejected when a ratio lies outside its group's fences
``q1 - spread * w`` and ``q3 + spread * w`` with ``w = max(q3 - q1, least width
of the rule)``.  The fences replace fixed cutoffs; ``least width`` only keeps a
group of identical values from rejecting everything else.  A group of fewer
than ``min_group`` documents uses the fences of the whole table.

Cases: a null text has no words and fails the base rule; null lang or source is
a group of its own; repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import apart, saved

_BLANK = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SPREAD = 6.0
MIN_GROUP = 50
#: rule -> (ratio, least width of its interquartile range)
RULES = {"word_length": ("word_chars / n_words", 0.5), "symbols": ("n_symbols / n_words", 0.02),
         "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.08), "repeats": ("n_repeat_words / n_words", 0.06),
         "capitals": ("n_upper / word_chars", 0.03)}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with word, symbol, line and repetition counts (long) of every whole text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("*", F.filter(F.split(text, _BLANK), lambda w: w != "").alias("_w"),
                       F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "").alias("_lines"))
    n = F.size("_w")
    # The hashes of all 3-word windows; a text without equal ones (most) is done here.
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("_h", hashes)
    # Equal neighbours in the sorted (hash, position) list are repeated windows.
    pairs = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(
        h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    base = base.withColumn("_p", pairs)
    last = F.size("_p") - 1
    at = lambda i: F.get(F.col("_p"), i)["h"]
    twice = F.filter("_p", lambda x, i: ((i > 0) & (at(i - 1) == x["h"])) | ((i < last) & (at(i + 1) == x["h"])))
    base = base.withColumn("_r", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_r", F.struct(F.lit(0).alias("c"), F.lit(0).alias("to")), lambda a, i: F.struct(
        (a["c"] + i + 3 - F.greatest(i, a["to"])).alias("c"), (i + 3).alias("to")))["c"]
    return base.select(*[docs[c] for c in docs.columns], n.cast("long").alias("n_words"),
                       _without(text, _BLANKS).cast("long").alias("word_chars"),
                       (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       covered.cast("long").alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
                       (F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"))


def fences(rows: DataFrame, spread: float = SPREAD, min_group: int = MIN_GROUP, accuracy: int = 1000) -> DataFrame:
    """(lang, source, <rule>_lo, <rule>_hi) from the quantile sketches of documents that pass the base rule."""
    good = rows.where(~F.col("base_failed"))
    quart = [F.percentile_approx(F.expr(r), [0.25, 0.75], accuracy).alias(k) for k, (r, _) in RULES.items()]
    whole = good.agg(*quart).select(*[F.col(k).alias(f"_{k}") for k in RULES])
    # A hot source is a group like any other here: each task sends one sketch per group.
    group = good.groupBy("lang", "source").agg(F.count("*").alias("_n"), *quart).crossJoin(F.broadcast(whole))  # one row
    out = []
    for k, (_, least) in RULES.items():
        q = F.when(F.col("_n") >= min_group, F.col(k)).otherwise(F.col(f"_{k}"))
        width = spread * F.greatest(q[1] - q[0], F.lit(least))
        out += [(q[0] - width).alias(f"{k}_lo"), (q[1] + width).alias(f"{k}_hi")]
    return group.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *out)


def quality_verdicts(docs: DataFrame, spread: float = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; the counts are written once and read twice."""
    rows = measures(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = saved(rows.withColumn("base_failed", failed), "quality")
    limits = fences(rows, spread, min_group)
    inside = F.lit(True)
    for k, (r, _) in RULES.items():
        inside = inside & F.expr(f"coalesce(({r}) between {k}_lo and {k}_hi, false)")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(inside)
    return rows.join(limits, same, "left").select(*rows.columns, kept.alias("kept"))


@apart
def quality_filter(docs: DataFrame, spread: float = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return quality_verdicts(docs, spread, min_group).where("kept").select(*docs.columns)


def op6_quality_rules(docs: DataFrame) -> DataFrame:
    out = quality_verdicts(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
