"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import itertools
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab.session import checkpoint_dir, ship_package

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)  # Python workers import this package
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Unlike an executor's cache the files outlive a lost executor, and unlike an
    RDD checkpoint they are compressed and let later reads pick columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(operator):
    """The operator with the further columns of its documents under names that no operator uses, and back after it.

    So a document column may be called what an operator calls one of its own.
    """
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        own = [c for c in docs.columns if c not in DOCUMENT_COLUMNS]
        hidden = {c: f"further_column_{i}" for i, c in enumerate(own)}
        out = operator(docs.withColumnsRenamed(hidden), *args, **options) if own else operator(docs, *args, **options)
        return out.withColumnsRenamed({h: c for c, h in hidden.items()})

    return run


def text_key(text: Column | str) -> Column:
    """128-bit key of a text (null: the key of the empty text), for joins that need no text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(7)).alias("k2"))


def once(value: Column) -> Column:
    """The value, computed once: neither a filter on a generator's output is pushed below it nor are
    uses of that output replaced by its expression."""
    return F.explode(F.array(value))


def word_pieces(data: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between blanks (space, tab to carriage return), about ``piece`` bytes at a time.

    A very long text never exists as one list of words.
    """
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + piece)
        if end < n:
            m = _SPACE.search(data, end)
            end = m.start() if m else n
        yield data[start:end].split()
        start = end


def block_masks(max_bits: int, blocks: int | None = None, width: int = 64) -> list[int]:
    """Masks of block subsets such that any two values at most ``max_bits`` apart agree under one.

    Of ``blocks`` blocks (2·d unless given, at least d + 1) any d can hold all d differing bits; the
    others are equal.  Longer keys than the plain d+1 blocks give: for d = 3, 20 keys of
    31-33 bits instead of 4 of 16, so buckets stay small on billions of rows.
    """
    blocks = blocks or max(1, 2 * max_bits)
    cuts = [width * i // blocks for i in range(blocks + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(bits, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]  # as signed longs


def hamming_links(fps: DataFrame, max_bits: int, block_rows: int = 20_000, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that join the distinct values of column ``fp`` (long) as "at most max_bits apart" does.

    Pigeonhole blocks: each value goes to one bucket per block subset, so two
    close values share a bucket; in a bucket every pair that is not connected
    yet is verified by its Hamming distance.  A bucket's key is one number, a hash of
    the masked bits; where two buckets fall together the check tells them apart.
    """
    masks = enumerate(block_masks(max_bits, blocks))
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in masks])
    rows = fps.select("fp", F.explode(keys).alias("bucket"))
    groups = _grouped(rows, "bucket", F.xxhash64("fp"), block_rows)

    def near(p, rest):
        import numpy as np

        return np.flatnonzero(np.bitwise_count(rest ^ p) <= max_bits)

    def link(batches):
        import numpy as np
        import pyarrow as pa

        for (fp, *_), starts, ends in _runs(batches, 1):
            fp = fp.view(np.uint64)  # bitwise_count takes signed numbers by their absolute value
            two = starts[ends - starts == 2]  # most runs: all at once
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            found = [np.stack([two, two + 1])]
            big = ends - starts > 2
            found += [_forest(fp[x:y], near) + x for x, y in zip(starts[big], ends[big])]
            found = fp[np.concatenate(found, axis=1)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return groups.mapInArrow(link, "a long, b long")


def spanning_links(texts: DataFrame, verified, block_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between the keys ``k`` of the rows (k, fp, comp, line) of equal ``comp``.

    ``verified(fp, fps, line, lines)`` gives the indices of the rows that the first one is linked to.
    """
    groups = _grouped(texts.select("line", "k.k1", "k.k2", "fp", "comp"), "comp", F.xxhash64("k1", "k2"), block_rows)

    def link(batches):
        import numpy as np
        import pyarrow as pa

        for (lines, k1, k2, fp, *_), starts, ends in _runs(batches, 4):
            found = [_forest(fp[x:y].view(np.uint64), verified, lines[x:y]) + x for x, y in zip(starts, ends)]
            for at in found:
                pair = [pa.StructArray.from_arrays([pa.array(k1[x]), pa.array(k2[x])], ["k1", "k2"]) for x in at]
                yield pa.RecordBatch.from_arrays(pair, ["a", "b"])

    return groups.mapInArrow(link, "a struct<k1:long,k2:long>, b struct<k1:long,k2:long>")


def _grouped(rows: DataFrame, by: str, spread: Column, block_rows: int, *then: str) -> DataFrame:
    """``rows``, whose last column is ``by``, dealt and sorted by group (and ``then``).

    Rows of a key that has more than ``block_rows`` are cut into blocks by ``spread``,
    and each pair of blocks is a group of its own, numbered in a further last column: every pair of
    rows meets in one, and no task holds more than two blocks of a group.
    """
    keys = [by]
    # Counts of 65,536 cells of keys first: where no cell holds so many rows, no key does.
    cells = rows.groupBy(F.xxhash64(by).bitwiseAND(F.lit(0xFFFF)).alias("cell")).count()
    hot = None
    if (cells.agg(F.max("count")).first()[0] or 0) > block_rows:
        hot = saved(rows.groupBy(by).count().where(F.col("count") > block_rows), "hot-groups")
    if hot is not None and not hot.isEmpty():
        blocks = F.ceil(F.coalesce("count", F.lit(1)) / F.lit(block_rows))
        rows = (rows.join(hot, by, "left").withColumn("_nb", blocks).withColumn("_own", F.pmod(spread, F.col("_nb")))
                .withColumn("_other", F.explode(F.expr("sequence(0L, _nb - 1)")))
                .withColumn("g", F.least("_own", "_other") * F.col("_nb") + F.greatest("_own", "_other"))
                .select(*rows.columns, "g"))
        keys = [by, "g"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *then)


def _runs(batches, first_key: int):
    """(columns, starts, ends) of the runs of two or more rows that agree in the columns from ``first_key`` on."""
    import numpy as np

    held = None  # the last run of a batch may go on in the next one
    for b in itertools.chain(batches, [None]):
        if b is not None:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if held is None or not held[0].size:
            continue
        keys = held[first_key:]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        starts, ends = np.r_[0, new], np.r_[new, held[0].size]
        if b is not None:
            starts, ends, rest = starts[:-1], ends[:-1], starts[-1]
        big = ends - starts > 1
        yield held, starts[big], ends[big]
        if b is not None:
            held = [x[rest:] for x in held]


def _forest(fp, near, lines=None):
    """Index pairs (2, n) of a spanning forest of the rows, linked as ``near`` says.

    Only rows that no tree holds yet are compared, so a dense group costs a few passes, not all pairs.
    """
    import numpy as np

    rest, out = np.arange(fp.size), []
    while rest.size > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            p = todo.pop()
            hit = near(fp[p], fp[rest]) if lines is None else near(fp[p], fp[rest], lines[p], lines[rest])
            if hit.size:
                out.append(np.stack([np.full(hit.size, p), rest[hit]]))
                todo.extend(rest[hit])
                rest = np.delete(rest, hit)
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of an undirected graph of edges (a, b): the smallest node reachable.

    Alternating large-star and small-star rounds on DataFrames; each round is a
    few joins and aggregations and is written to the shared folder.  Nodes
    without an edge to another node do not appear.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign == seen or sign.n == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = sign
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = saved(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place (from 0) among those of its ``group`` (not null) in ``order``.

    The rows are dealt by ranges of (group, order), so that a group of any size spreads over
    the tasks, and written once; a table of the first row and the number of rows of each group in each task
    (a row per group and a few per task) then gives the offsets.
    """
    spark = df.sparkSession
    at, part, first, n, off, g, p = fresh(df, "at_", "part_", "first_", "n_", "off_", "group_", "task_")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(tasks, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    rows = saved(rows.withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.shiftright(at, 33))  # the id holds the task above its 33 bits of row number
    runs = rows.groupBy(F.col(group).alias(g), F.col(part).alias(p)).agg(F.min(at).alias(first), F.count("*").alias(n))
    before = Window.partitionBy(g).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(off, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first))
    found = rows.join(runs, (F.col(group) == F.col(g)) & (F.col(part) == F.col(p)))
    return found.select(*df.columns, (F.col(at) + F.col(off)).alias(name))
