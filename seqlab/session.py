"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "seqlab") -> SparkSession:
    """Return the active session, or build a local one configured for tests/bench.

    On a cluster the session already exists (spark-submit); ``getOrCreate`` then
    returns it untouched apart from the SQL confs set below, which are safe there.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SEQLAB_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised stages.

    Read ``spark.checkpoint.dir`` from the session (the cluster names a shared,
    fault-tolerant folder there).  Only when it is unset -- local tests -- set a
    fresh scratch folder of our own.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="seqlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def materialize(df):
    """Cut lineage: a reliable checkpoint in the shared checkpoint folder.

    Used where one derived table feeds many jobs (folds x trials); a lost
    executor then re-reads the checkpoint instead of recomputing the lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def task_per_part(spark: SparkSession):
    """Within, a union of one-partition tables runs a task for each of them.

    Spark 4.1 otherwise takes the union of single partitions for a single partition, whose one task runs them one after another.
    """
    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``seqlab`` importable on the executors' Python workers.

    Pandas UDFs, ``applyInPandas`` functions and broadcast objects defined in
    this package are pickled by reference, so the workers must import it.  The
    package is zipped once per application and added with ``addPyFile`` (what
    ``--py-files`` does at submit time).  A no-op when already shipped.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="seqlab-pkg-")) / "seqlab.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("seqlab") / f.relative_to(root))
    sc.addPyFile(str(out))
    _SHIPPED.add(app)
