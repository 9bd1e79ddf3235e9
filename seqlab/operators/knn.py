"""Exact k nearest neighbours without a row-level cross join.

*Small references* (one block): queries are hashed into blocks of ``block_rows`` and each block meets the
references in one ``cogroup``.

*Large references* are cut into Voronoi cells around pivots (the first rows by hash).  Every cell keeps the
distances of its k references nearest to the pivot and its largest one, from which each query gets, by the triangle inequality, an upper bound
on its k-th distance; it is sent only to cells that may hold a row within that bound (ring and, for
the Euclidean metric, hyperplane bounds).  On clustered rows that is a few cells.  Where the bounds
do not help, which a few hundred queries show, nothing is sent to cells: blocks of ``block_rows`` queries meet chunks of
``CHUNK_BLOCKS`` times as many references.  A large cell is cut likewise, so
a hot cell (a third of all rows equal, say) spreads over tasks.

Within a task a tile of pairs is screened by lower bounds of their distances (a float32 product, or 16-bit sums for the
Manhattan metric); only pairs that may be among a query's k best get their distance.  Only each query's local top k leaves; a
window over those candidates keeps the global top k.  No task holds a whole side, and what the driver sees is the pivots and
one summary row per cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.session import materialize

BLOCK_ROWS = 20_000
CHUNK_BLOCKS = 4  # a chunk of references holds as many rows as so many blocks of queries
_QBATCH = 512
_TILE_ROWS = 2_048  # references that a query batch is screened against at once
TILE_BYTES = 32 << 20  # of differences held at once
COPY_PAIRS = 10_000  # a query's copy for one more cell is worth as much work as so many distances


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of ``a`` to the same rows of ``b``."""
    diff = a - b
    np.abs(diff, out=diff) if metric == "manhattan" else np.multiply(diff, diff, out=diff)
    return diff.sum(-1) if metric == "manhattan" else np.sqrt(diff.sum(-1))


class _Screen:
    """Cheap lower bounds: a pair within ``bound`` has ``low(...) <= cut(..., bound)``; only such pairs need their distance.

    Euclidean: half the squared distance less the query's part, one float32 matrix product, with its rounding
    error as slack.  Manhattan: sums of differences of 16-bit steps, each off by a step at most per column; values outside the
    references' inner 99.8 % count as its ends, which lowers a sum only.
    """

    def __init__(self, qv: np.ndarray, tv: np.ndarray, metric: str) -> None:
        self.metric, d = metric, qv.shape[1]
        if metric == "manhattan":
            self.levels = 32_767 // max(1, d) - 1
            lo, hi = np.quantile(tv, [0.001, 0.999], axis=0)
            self.step = float((hi - lo).max(initial=0)) / max(1, self.levels) or 1.0
            steps = lambda x: np.clip((x - lo) / self.step, 0, self.levels).astype(np.int16)
            self.q, self.t, self.d = steps(qv), np.ascontiguousarray(steps(tv).T), d
            return
        centre = tv.mean(axis=0)
        a, b = qv - centre, tv - centre
        far = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
        self.scale = float(far) or 1.0
        a, b = a / self.scale, b / self.scale
        self.an, bn = (a * a).sum(axis=1), (b * b).sum(axis=1)
        self.q = np.hstack([-a, np.ones((len(a), 1))]).astype(np.float32)
        self.t = np.hstack([b, bn[:, None] / 2]).astype(np.float32)
        reach = np.sqrt(self.an) + np.sqrt(bn.max(initial=0))
        shift = float(np.abs(centre).max(initial=0)) / self.scale  # rounding of the shift to the centre
        self.slack = (d + 8) * 2.0 ** -23 * reach ** 2 + 2.0 ** -48 * (1 + shift) * d * reach + 1e-30

    @staticmethod
    def fits(qv: np.ndarray, tv: np.ndarray, metric: str) -> bool:
        """Whether the bounds hold: finite values of ordinary size, and for Manhattan enough steps a column."""
        most = 1e150
        return bool((np.abs(qv) < most).all() and (np.abs(tv) < most).all()) and (metric != "manhattan" or qv.shape[1] <= 4_096)

    def low(self, q: slice, t: slice) -> np.ndarray:
        if self.metric != "manhattan":
            return self.q[q] @ self.t[t].T
        a, b = self.q[q], self.t[:, t]
        out = np.zeros((len(a), b.shape[1]), np.int16)
        diff = np.empty((8, b.shape[1]), np.int16)
        for i in range(0, len(a), 8):  # few rows at once: they stay in the cache
            rows, x = out[i:i + 8], diff[:len(a) - i]
            for j in range(self.d):
                np.subtract(a[i:i + 8, j, None], b[j], out=x)
                np.abs(x, out=x)
                np.add(rows, x, out=rows)
        return out

    def cut(self, q: slice, bound: np.ndarray) -> np.ndarray:
        if self.metric != "manhattan":
            return (((bound / self.scale) ** 2 * (1 + 1e-12) - self.an[q]) / 2 + self.slack[q]).astype(np.float32)
        return np.minimum(np.floor(bound / self.step * (1 + 1e-9)) + self.d + 1, 32_767).astype(np.int16)


def _search(qv: np.ndarray, tv: np.ndarray, qids: np.ndarray, tids: np.ndarray, k: int, metric: str, exclude_self: bool,
            ends: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference row, distance) of every query's ``k`` best among the first ``n`` references, for each n of ``ends``.

    Each pair is listed once.  Distances are those of the float64 differences; ties go to the smaller reference id.
    """
    screen, found = _Screen(qv, tv, metric), []
    per = max(1, TILE_BYTES // (8 * max(1, qv.shape[1])))
    for s in range(0, len(qv), _QBATCH):
        part = slice(s, min(s + _QBATCH, len(qv)))
        m = part.stop - s
        bound, cut = np.full(m, np.inf), None
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)]  # query, reference, distance, listed
        waiting: list[tuple] = []

        def distances(qi, ti):
            d = np.concatenate([np.zeros(0), *[_exact(qv[s + qi[i:i + per]], tv[ti[i:i + per]], metric) for i in range(0, len(qi), per)]])
            if exclude_self:
                d[qids[s + qi] == tids[ti]] = np.inf
            return d

        def merge():
            nonlocal best, cut
            if waiting:
                q, t, d = (np.concatenate([old, *new]) for old, new in zip(best, zip(*waiting)))
                listed = np.concatenate([best[3], np.zeros(len(q) - len(best[3]), bool)])
                waiting.clear()
                order = np.lexsort((tids[t], d, q))
                q = q[order]
                first = np.searchsorted(q, np.arange(m))
                keep = np.arange(len(q)) - first[q] < k
                order = order[keep]
                best = [q[keep], t[order], d[order], listed[order]]
                n = np.bincount(best[0], minlength=m)
                full = np.flatnonzero(n == k)
                last = np.cumsum(n)[full] - 1
                bound[full] = np.minimum(bound[full], best[2][last])
            cut = screen.cut(part, bound)[:, None]

        merge()
        start = 0
        for end in ends:
            for a in range(start, end, _TILE_ROWS):
                tile = slice(a, min(a + _TILE_ROWS, end))
                low = screen.low(part, tile)
                some = k + exclude_self
                if np.isinf(bound).any() and low.shape[1] > some:  # any k references bound the k-th distance
                    few = np.argpartition(low, some - 1, axis=1)[:, :some]
                    d = distances(np.repeat(np.arange(m), some), a + few.ravel()).reshape(m, some)
                    bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
                    cut = screen.cut(part, bound)[:, None]
                qi, ti = np.divmod(np.flatnonzero(low <= cut), low.shape[1])
                if len(qi):
                    ti += a
                    d = distances(qi, ti)
                    near = np.isfinite(d) & (d <= bound[qi])
                    waiting.append((qi[near], ti[near], d[near]))
                    if sum(len(x[0]) for x in waiting) > 2 * m * k:
                        merge()
            start = end
            merge()
            new = ~best[3]
            found.append((s + best[0][new], best[1][new], best[2][new]))
            best[3][:] = True
    return tuple(np.concatenate(x) for x in zip(*found))


def _search_directly(qv, tv, qids, tids, k, metric, exclude_self, ends):
    """``_search`` from all distances, for values that the screen does not take."""
    out_q, out_t, out_d = [], [], []
    for s in range(0, len(qv), _QBATCH):
        d = _distances(qv[s:s + _QBATCH], tv, metric)
        if exclude_self:
            d[qids[s:s + _QBATCH, None] == tids[None, :]] = np.inf
        kth = [np.partition(d[:, :n], min(k, n) - 1, axis=1)[:, min(k, n) - 1] for n in ends]
        for i in range(d.shape[0]):
            sel = []
            for n, bound in zip(ends, kth):
                cand = np.nonzero(d[i, :n] <= bound[i])[0]
                sel.append(cand[np.lexsort((tids[cand], d[i, cand]))[:k]])
            sel = sel[0] if len(sel) == 1 else np.unique(np.concatenate(sel)) if sel else np.zeros(0, int)
            sel = sel[np.isfinite(d[i, sel])]
            out_q.append(np.full(len(sel), s + i))
            out_t.append(sel)
            out_d.append(d[i, sel])
    return np.concatenate(out_q), np.concatenate(out_t), np.concatenate(out_d)


def _local_topk(k: int, qid: str, tid: str, vec: str, extra: Sequence[str], metric: str, exclude_self: bool,
                by: Sequence[str] = (), limits: tuple[str, Sequence[int]] | None = None):
    """The k best references of a chunk for each query of a block; with ``limits`` (column, values), those of every limit."""
    def fn(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, qid, tid, "dist", *extra]
        if q.empty or t.empty:
            return pd.DataFrame({c: [] for c in cols})
        ends = [len(t)]
        if limits:  # the rows within a limit come first
            t = t.sort_values(limits[0], kind="stable")
            ends = sorted(set(np.searchsorted(t[limits[0]].to_numpy(), limits[1], side="right").tolist()) - {0})
            if not ends:
                return pd.DataFrame({c: [] for c in cols})
        qv = np.stack(q["_qvec"].to_numpy()).astype(np.float64)
        tv = np.stack(t["_tvec"].to_numpy()).astype(np.float64)
        qids, tids = q[qid].to_numpy(), t[tid].to_numpy()
        search = _search if _Screen.fits(qv, tv, metric) else _search_directly
        sel_q, sel_t, dist = search(qv, tv, qids, tids, k, metric, exclude_self, ends)
        res = pd.DataFrame({qid: qids[sel_q], tid: tids[sel_t], "dist": dist})
        for c in by:
            res[c] = q[c].iloc[0]
        for c in extra:
            res[c] = t[c].to_numpy()[sel_t]
        return res
    return fn


MAX_CELLS = 4_096  # of all groups together: their summaries (k + 1 numbers each) go to every task
_TRIED = 512  # queries whose reach tells whether cells pay


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b``, in tiles of TILE_BYTES."""
    d = np.empty((len(a), len(b)))
    step = max(1, TILE_BYTES // (8 * max(1, a.size)))
    for s in range(0, len(b), step):
        diff = a[:, None, :] - b[None, s:s + step, :]
        np.abs(diff, out=diff) if metric == "manhattan" else np.multiply(diff, diff, out=diff)
        d[:, s:s + step] = diff.sum(-1)
    return d if metric == "manhattan" else np.sqrt(d)


def _cells_of(pivots: np.ndarray, metric: str):
    """(cell, distance to its pivot) columns for rows with ``_vec``."""
    def assign(batches):
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["_vec"].to_numpy()).astype(np.float64)
                if _Screen.fits(v, pivots, metric):
                    n = np.arange(len(pivots))
                    row, cell, radius = _search(v, pivots, np.arange(len(v)), n, 1, metric, False, [len(n)])
                    order = np.argsort(row)
                    pdf["_cell"], pdf["_radius"] = cell[order].astype(np.int32), radius[order]
                else:
                    d = np.concatenate([_distances(v[i:i + _QBATCH], pivots, metric) for i in range(0, len(v), _QBATCH)])
                    pdf["_cell"], pdf["_radius"] = d.argmin(axis=1).astype(np.int32), d.min(axis=1)
                yield pdf
    return assign


def _reached(pivots: np.ndarray, between: np.ndarray, cells: dict, k: int, metric: str, by: Sequence[str]):
    """``_cells``: the cells that may hold one of a query's k nearest references of its group."""
    def reach(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            out = np.empty(len(pdf), object)
            groups = pdf.groupby(list(by), dropna=False).indices if by else {(): np.arange(len(pdf))}
            for key, at in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                ids, far, near = cells.get(key, (np.zeros(0, int), np.zeros(0), np.zeros((0, k))))
                v = np.stack(pdf["_qvec"].to_numpy()[at]).astype(np.float64)
                for i in range(0, len(at), _QBATCH):
                    part = at[i:i + _QBATCH]
                    d = _distances(v[i:i + _QBATCH], pivots, metric)
                    # k references lie within the k-th least of "distance to the pivot plus theirs to it".
                    reach_of = (d[:, ids][:, :, None] + near[None]).reshape(len(part), -1)
                    bound = np.partition(reach_of, k - 1, axis=1)[:, k - 1] if reach_of.shape[1] >= k else np.full(len(part), np.inf)
                    bound = bound * (1 + 1e-9) + 1e-9  # rounding must not lose a tie
                    keep = d[:, ids] - far[None] <= bound[:, None]
                    if metric != "manhattan":
                        own = d.argmin(axis=1)
                        gap = between[own][:, ids]
                        plane = (d[:, ids] ** 2 - d.min(axis=1)[:, None] ** 2) / np.where(gap > 0, 2 * gap, np.inf)
                        keep &= plane <= bound[:, None]
                    for j, row in zip(part, keep):
                        out[j] = ids[row].astype(np.int32)
            pdf["_cells"] = out
            yield pdf
    return reach


def _pruned(queries: DataFrame, ref: DataFrame, k: int, metric: str, by: Sequence[str], n_pivots: int, chunk_rows: int | None = None):
    """(queries with ``_cell`` per cell they reach, references with their ``_cell``), or None where there are too many groups.

    With ``chunk_rows`` both come without ``_cell`` where chunks of so many rows cost less: some queries are tried first.
    """
    by = list(by)
    n_groups = ref.select(*by).distinct().limit(MAX_CELLS // n_pivots + 1).count() if by else 1
    if n_groups > MAX_CELLS // n_pivots:
        return None
    pivots = np.array([r[0] for r in ref.select("_vec").orderBy(F.xxhash64("_vec")).limit(n_pivots).collect()], np.float64)
    between = _distances(pivots, pivots, metric)
    fields = ", ".join(f"`{c}` {t}" for c, t in ref.dtypes)
    ref = materialize(ref.mapInPandas(_cells_of(pivots, metric), f"{fields}, _cell int, _radius double"))
    nearest = Window.partitionBy(*by, "_cell").orderBy("_radius")
    # The k least radii by a window would sort whole cells: the k-th least per hash slice first.
    some = ref.select(*by, "_cell", "_radius", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("_slice"))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_cell", "_slice").orderBy("_radius"))).where(F.col("_n") <= k)
    least = some.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k)
    least = least.groupBy(*by, "_cell").agg(F.array_sort(F.collect_list("_radius")).alias("near"))  # k numbers
    far = ref.groupBy(*by, "_cell").agg(F.max("_radius").alias("far"), F.count(F.lit(1)).alias("size"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_cell"]]
    summary: dict[tuple, list] = {}
    for r in far.alias("a").join(least.alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in [*by, "_cell"]], "far", "near", "size").collect():
        summary.setdefault(tuple(r[c] for c in by), []).append((r["_cell"], r["far"], r["near"] + [math.inf] * (k - len(r["near"])), r["size"]))
    cells = {g: (np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])) for g, rows in summary.items()}
    reach = _reached(pivots, between, cells, k, metric, by)
    if chunk_rows:
        some = queries.select(*by, "_qvec").orderBy(F.xxhash64("_qvec")).limit(_TRIED).toPandas()
        sizes = {g: {x[0]: x[3] for x in rows} for g, rows in summary.items()}
        cost = whole = 0
        for pdf in reach([some]):
            for key, hit in zip(zip(*[pdf[c] for c in by]) if by else [()] * len(pdf), pdf["_cells"]):
                mine = sizes.get(key, {})
                cost += sum(mine[c] for c in hit) + COPY_PAIRS * len(hit)
                whole += sum(mine.values()) + COPY_PAIRS * math.ceil(sum(mine.values()) / chunk_rows)
        if cost >= whole:
            return queries, ref.drop("_cell", "_radius")
    fields = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
    queries = materialize(queries.mapInPandas(reach, f"{fields}, _cells array<int>"))
    return queries.withColumn("_cell", F.explode("_cells")).drop("_cells"), ref.drop("_radius")


def _blocked(queries: DataFrame, ref: DataFrame, qid: str, tid: str, local, extra: Sequence[str], by: Sequence[str], block_rows: int) -> DataFrame:
    """``local`` over every block of queries and chunk of references of a group: (*by, qid, tid, dist, *extra)."""
    chunk_rows = CHUNK_BLOCKS * block_rows
    by, qtypes, ttypes = list(by), dict(queries.dtypes), dict(ref.dtypes)
    keys = [c for c in (*by, "_cell") if c in queries.columns]
    if keys:
        # Blocks and chunks of each group's own size.  A group without references has no neighbours.
        def parts(d: DataFrame, name: str, rows: int) -> DataFrame:
            return d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name))
        sizes = parts(queries, "_nb", block_rows).join(parts(ref, "_nc", chunk_rows), keys)
        queries, ref = queries.join(sizes, keys), ref.join(sizes, keys)
        n_blocks, n_chunks = F.col("_nb"), F.col("_nc")
    else:
        n_blocks = F.lit(max(1, math.ceil(queries.count() / block_rows)))
        n_chunks = F.lit(max(1, math.ceil(ref.count() / chunk_rows)))
    # Fresh aliases on both sides: the two inputs often share lineage (one
    # table split in two), and cogroup needs distinct attributes.
    q = queries.select(*[F.col(c).alias(c) for c in keys], F.col(qid).alias(qid), F.col("_qvec").alias("_qvec"),
                       F.pmod(F.xxhash64(qid), n_blocks).cast("int").alias("_qb"),
                       F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("_tc"))
    t = ref.select(*[F.col(c).alias(c) for c in keys], F.col(tid).alias(tid), F.col("_vec").alias("_tvec"),
                   *[F.col(c).alias(c) for c in extra],
                   F.pmod(F.xxhash64(tid), n_chunks).cast("int").alias("_tc"),
                   F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("_qb"))
    schema = ", ".join([*[f"`{c}` {qtypes[c]}" for c in by], f"`{qid}` {qtypes[qid]}", f"`{tid}` {ttypes[tid]}",
                        "dist double", *[f"`{c}` {ttypes[c]}" for c in extra]])
    return q.groupBy(*keys, "_qb", "_tc").cogroup(t.groupBy(*keys, "_qb", "_tc")).applyInPandas(local, schema)


def nearest_neighbours(queries: DataFrame, ref: DataFrame, k: int, qid: str, tid: str, vec: str,
                       extra: Sequence[str] = (), metric: str = "euclidean", exclude_self: bool = False,
                       block_rows: int = BLOCK_ROWS, by: Sequence[str] = (), pivots: int | None = None) -> DataFrame:
    """Top ``k`` reference rows per query row: (*by, qid, tid, dist, nn_rank, *extra).

    Ties in distance go to the smaller reference id.  ``exclude_self`` drops the
    pair ``qid == tid`` (neighbours within one table).  ``qid`` and ``tid`` must
    be distinct column names.  ``by``: group columns present on both sides;
    queries only meet references of their own group (many small kNN problems
    in one plan, e.g. every fold x setting of a sweep).  ``pivots``: number of cells; by default the square root of
    the references' number (1,024 at most), and none where all of them fit into one chunk.
    """
    by = list(by)
    queries = queries.select(*by, qid, F.col(vec).alias("_qvec"))
    ref = ref.select(*by, tid, F.col(vec).alias("_vec"), *extra)
    chunk_rows = None
    if pivots is None:
        n, chunk_rows = ref.count(), CHUNK_BLOCKS * block_rows
        pivots = min(1024, math.ceil(math.sqrt(n))) if n > chunk_rows else 0
    found = _pruned(queries, ref, k + exclude_self, metric, by, pivots, chunk_rows) if pivots else None
    queries, ref = found or (queries, ref)
    local = _local_topk(k, qid, tid, vec, extra, metric, exclude_self, by)
    found = _blocked(queries, ref, qid, tid, local, extra, by, block_rows)
    w = Window.partitionBy(*by, qid).orderBy(F.col("dist"), F.col(tid))
    return found.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)


def staircase_neighbours(queries: DataFrame, ref: DataFrame, k: int, limits: Sequence[int], rank: str, qid: str, tid: str, vec: str,
                         extra: Sequence[str] = (), metric: str = "euclidean", block_rows: int = BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Per query row an array ``near`` (dist, tid, rank, *extra; ascending) that holds, for every limit, its ``k`` nearest references
    whose ``rank`` is within that limit: the first k of ``near`` that pass ``rank <= limit``.

    Nested samples of one table need one search: the distances are taken once, and only rows that are among the
    k best of some limit leave a task (at most ``k * len(limits)`` per query and chunk).
    """
    by = list(by)
    queries = queries.select(*by, qid, F.col(vec).alias("_qvec"))
    ref = ref.where(F.col(rank) <= max(limits)).select(*by, tid, F.col(vec).alias("_vec"), rank, *extra)
    kept = [rank, *extra]
    found = _blocked(queries, ref, qid, tid, _local_topk(k, qid, tid, vec, kept, metric, False, by, (rank, sorted(set(limits)))), kept, by, block_rows)
    row = F.struct("dist", tid, *kept)
    return found.groupBy(*by, qid).agg(F.array_sort(F.collect_list(row)).alias("near"))


def knn_predict(neigh: DataFrame, qid: str, label: str, weights: str = "uniform", by: Sequence[str] = ()) -> DataFrame:
    """Vote of the neighbours: uniform or 1/distance (zero distances take all the weight);
    ties go to the smaller label (M8)."""
    by = list(by)
    if weights == "distance":
        has_zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(*by, qid)) == 1
        w = F.when(has_zero, (F.col("dist") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("dist"))
    else:
        w = F.lit(1.0)
    votes = neigh.withColumn("_w", w).groupBy(*by, qid, label).agg(F.sum("_w").alias("_votes"))
    return votes.groupBy(*by, qid).agg(
        F.min_by(F.col(label), F.struct(-F.col("_votes"), F.col(label))).alias("y_pred"))


def knn_vote(near: Column, label: str, weights: str = "uniform") -> Column:
    """``knn_predict`` of one query's neighbours, an array of structs that holds ``dist`` and ``label``."""
    zero = F.exists(near, lambda c: c["dist"] == 0)
    weight = (lambda c: F.when(zero, (c["dist"] == 0).cast("double")).otherwise(F.lit(1.0) / c["dist"])) if weights == "distance" else (lambda c: F.lit(1.0))
    labels = F.array_sort(F.array_distinct(F.transform(near, lambda c: c[label])))
    total = lambda y: F.aggregate(F.filter(near, lambda c: c[label] == y), F.lit(0.0), lambda a, c: a + weight(c))
    best = F.transform(labels, lambda y: F.struct((-total(y)).alias("votes"), y.alias("y")))  # ties: the smaller label
    return F.array_min(best)["y"]
