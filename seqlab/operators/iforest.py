"""Isolation forest outlier removal (O2).

Liu, Ting & Zhou (2008): each tree isolates a random sample of ``psi`` rows by
random axis-parallel splits; short average path lengths mean anomalies.

* samples: the rows in hash order, read round and round, ``psi`` per tree; with ``trees * psi`` rows or more no row is used twice;
* trees: built in parallel by ``groupBy(tree).applyInPandas``, one tree per group of ``psi`` rows; every cut is drawn by
  MD5 of (seed, tree, node), so every engine draws the same forest;
* scoring: the forest is a bounded model (trees x 2^(depth + 1) nodes); it is broadcast and each Arrow batch walks all trees
  together, without a shuffle.  (Native walks were slower: see README.);
* the anomaly score ``2^(-E[h] / c(psi))`` is min-max scaled over the scored
  rows and rows above the threshold are dropped.

A row without a value in a cut's column goes left when scored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.operators.sampling import hash_key, hash_rank
from seqlab.session import materialize

EULER_GAMMA = 0.5772156649015329


def avg_path_length(n: float) -> float:
    """c(n): average path length of an unsuccessful BST search over n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def levels_of(psi: int) -> int:
    return math.ceil(math.log2(max(psi, 2)))


def unit(*key) -> float:
    """Uniform [0, 1) from the first 13 hex digits of MD5."""
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / 16 ** 13


def tree_samples(df: DataFrame, features: Sequence[str], id_col: str | Column, n_trees: int, psi: int, seed: int) -> tuple[DataFrame, int]:
    """((tree, x), rows per tree): tree t takes the places t*psi .. (t+1)*psi - 1 of the rows in hash order, read round and round."""
    n = df.count()
    psi, x = max(1, min(psi, n)), F.array(*[F.col(f).cast("double") for f in features])
    places = n_trees * psi
    rows = df.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), x.alias("x"))
    if n > 4 * places:
        # The hashes are taken once: the rows below a hash that some twice the places lie under, if they are enough.
        key, share = hash_key("id", seed), f"{int(2 * places / n * 16 ** 12):012x}"
        head = materialize(rows.where(key.isNull() | (F.substring(key, 1, 12) < share)))
        rows = head if head.count() >= places else rows
    ranked = hash_rank(rows, "id", seed, rank_col="rk", limit=min(n, places))
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(places) - F.col("rk")) / F.lit(max(n, 1))))
    rows = ranked.withColumn("turn", F.explode(turns))
    return rows.select(F.floor((F.col("rk") - 1 + F.col("turn") * F.lit(n)) / F.lit(psi)).cast("int").alias("tree"), "x"), psi


WALK_ROWS = 4_096  # that walk a tree together
NODES = "tree int, node int, feature int, threshold double, size long"


def grow_tree(tree: int, x: np.ndarray, psi: int, seed: int) -> list[tuple]:
    """(tree, node, feature from 0 or -1 for a leaf, threshold, size) of the tree over the rows of ``x``.

    Nodes are numbered as in a heap from 1 (children 2i and 2i + 1); the column and the place of a cut within its range are drawn by MD5 of (seed, tree, node).
    """
    out, todo = [], [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        wide = np.flatnonzero(hi > lo)
        if node.bit_length() > levels_of(psi) or not wide.size:
            out.append((tree, node, -1, None, len(rows)))
            continue
        f = int(wide[int(unit(seed, tree, node, "f") * len(wide))])
        threshold = float(lo[f] + unit(seed, tree, node, "t") * (hi[f] - lo[f]))
        right = x[rows, f] >= threshold
        out.append((tree, node, f, threshold, len(rows)))
        todo += [(2 * node + side, part) for side, part in ((0, rows[~right]), (1, rows[right])) if len(part)]
    return out


def fit_forest(df: DataFrame, features: Sequence[str], id_col: str | Column, n_trees: int = 100, psi: int = 256, seed: int = 42) -> DataFrame:
    """Node table of the forest (one row per node); a tree's root is node 0, one less than its number in the heap."""
    rows, psi = tree_samples(df, features, id_col, n_trees, psi, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(grow_tree(int(pdf.tree.iloc[0]), np.stack(pdf.x.to_numpy()).astype(np.float64), psi, seed), columns=[c.split()[0] for c in NODES.split(", ")])

    return rows.groupBy("tree").applyInPandas(grow, NODES).withColumn("node", F.col("node") - 1)


class Forest:
    """Dense arrays of a fitted forest (trees x heap nodes), small enough to broadcast."""

    def __init__(self, nodes: Sequence) -> None:
        self.psi = max((r["size"] for r in nodes if r["node"] == 0), default=1)
        place = {t: i for i, t in enumerate(sorted({r["tree"] for r in nodes}))}
        shape = (len(place), 2 << levels_of(self.psi))
        self.feature, self.threshold = np.zeros(shape, np.int64), np.full(shape, np.inf)
        self.to = np.tile(np.arange(shape[1]), (shape[0], 1))
        self.length = np.zeros(shape)
        for r in nodes:
            node = r["node"] + 1
            at = place[r["tree"]], node
            if r["feature"] >= 0:
                self.feature[at], self.threshold[at], self.to[at] = r["feature"], r["threshold"], 2 * node
            else:  # a leaf leads to itself: no value reaches its threshold
                self.length[at] = node.bit_length() - 1 + avg_path_length(r["size"])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2^(-E[h(x)] / c(psi)) for the rows of ``x``, which walk one tree at a time: its tables stay in the cache."""
        out = np.empty(len(x))
        for s in range(0, len(x), WALK_ROWS):
            part = np.ascontiguousarray(x[s:s + WALK_ROWS])
            n, values, first = len(part), part.ravel(), np.arange(len(part)) * part.shape[1]
            length = np.empty((n, len(self.feature)))
            at, value, cut = np.empty(n, np.int64), np.empty(n), np.empty(n)
            node, then = np.empty(n, np.int64), np.empty(n, np.int64)
            for t in range(len(self.feature)):
                node.fill(1)
                for _ in range(levels_of(self.psi)):
                    np.take(self.feature[t], node, out=at, mode="clip")
                    at += first
                    np.take(values, at, out=value, mode="clip")
                    np.take(self.threshold[t], node, out=cut, mode="clip")
                    np.take(self.to[t], node, out=then, mode="clip")
                    then += value >= cut
                    node, then = then, node
                length[:, t] = self.length[t][node]
            out[s:s + n] = np.power(2.0, -(length.sum(axis=1) / max(1, len(self.feature))) / (avg_path_length(self.psi) or 1.0))
        return out


def score_rows(df: DataFrame, features: Sequence[str], nodes: DataFrame, out: str = "iforest_score") -> DataFrame:
    """``df`` with the anomaly score of each row under the forest of ``nodes``: a bounded model, collected and broadcast."""
    sc = df.sparkSession.sparkContext
    forest = sc.broadcast(Forest(nodes.collect()))
    if df.rdd.getNumPartitions() < sc.defaultParallelism:  # a table read as fewer splits than there are cores
        df = df.repartition(sc.defaultParallelism)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:  # only the columns of the forest cross to Python
        return pd.Series(forest.value.score(x.to_numpy(dtype=np.float64)))

    return df.withColumn(out, score(F.struct(*features)))


def iforest_probability(df: DataFrame, features: Sequence[str], id_col: str | Column, n_trees: int = 100, psi: int = 256,
                        seed: int = 42, out: str = "outlier_prob") -> DataFrame:
    """Outlier probability: anomaly score min-max scaled over the rows of ``df`` (the fitted data).

    ``id_col``: a column or an expression that only the samples need; then it is not written with the rows.
    """
    # Written once: the minimum and maximum and the rows themselves would each score everything.
    scored = materialize(score_rows(df, features, fit_forest(df, features, id_col, n_trees, psi, seed), "_s"))
    mm = F.broadcast(scored.agg(F.min("_s").alias("_mn"), F.max("_s").alias("_mx")))
    prob = F.when(F.col("_mx") > F.col("_mn"), (F.col("_s") - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))) \
        .otherwise(F.lit(0.0))
    return scored.crossJoin(mm).withColumn(out, F.least(F.greatest(prob, F.lit(0.0)), F.lit(1.0))) \
        .drop("_s", "_mn", "_mx")


def remove_outliers_iforest(df: DataFrame, features: Sequence[str], threshold: float, id_col: str | Column,
                            n_trees: int = 100, psi: int = 256, seed: int = 42) -> DataFrame:
    """Drop rows whose outlier probability exceeds ``threshold`` (O2)."""
    p = iforest_probability(df, features, id_col, n_trees, psi, seed)
    return p.where(F.col("outlier_prob") <= F.lit(threshold)).drop("outlier_prob")
