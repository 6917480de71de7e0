"""Session builder for local runs and the shared-folder lookup."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SHARED_DIR = "spark.checkpoint.dir"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cores: str = "8", memory: str = "8g", app: str = "deskspark") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The archive is built next to the driver; Spark's own file distribution takes it from there. Not
    needed when the job was submitted with --py-files or the package is installed on the nodes.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="deskspark-ship-"), "deskspark")
    spark.sparkContext.addPyFile(
        shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared folder named by the cluster.

    Only a local-mode session without that setting falls back to a temporary folder, because
    there driver and executors are one process; on a cluster the setting is required.
    """
    root = spark.conf.get(SHARED_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR} to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="deskspark-")
        root = _LOCAL_ROOTS[app]
    return os.path.join(root, f"deskspark-{uuid.uuid4().hex}")


@contextmanager
def writing(spark: SparkSession, free: bool = True, batch: int | None = None):
    """While a table is written: with `free`, Spark removes the shuffle files as soon as it is there; `batch` is the bytes of an Arrow batch."""
    conf = ({FREE_SHUFFLES: "true"} if free else {}) | ({BATCH_BYTES: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df, name: str, free: bool = False, batch: int | None = None):
    """Write a reused intermediate to the shared folder and read it back.

    Cuts the lineage with a table that survives the loss of executors. With `free`, Spark removes the shuffle files
    as soon as the table is written; for frames that are not run again. `batch` is the bytes of an Arrow batch while it
    is written.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), name)
    schema = df.schema
    with writing(spark, free, batch):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df):
    """Deal rows over all cores when the input comes in fewer partitions than there are cores.

    Meant for CPU-heavy work on a few small files; an input with enough splits is left alone, so a
    large table is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
