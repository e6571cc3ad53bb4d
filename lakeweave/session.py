"""Session helpers: a local builder for tests and shared scratch storage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "lakeweave", memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark. On a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Spark's setting for deleting the shuffles of a query with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session whose executor is the driver itself, as in tests, may do without the setting and gets a folder of its own. Anything
    with executors of its own, ``local-cluster`` included, has to name one, because a machine-local folder is lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    # Spark refuses to change the setting in a running session, so the folder is kept here, one for each application.
    application = spark.sparkContext.applicationId
    if application not in _own_dirs:
        _own_dirs[application] = tempfile.mkdtemp(prefix="lakeweave-")
    return _own_dirs[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files deleted, on all executors, as soon as it is written, without waiting for a collector."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and go on from the files. The shuffles that made it go at once.

    Used where one costly result feeds several branches. Losing an executor afterwards costs a file
    read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_end_with_the_write(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_at = path
    return written


def discard(*steps: DataFrame) -> None:
    """Delete the files of results of ``materialize`` that nothing will read again. Other frames are left alone."""
    for step in steps:
        path = getattr(step, "_written_at", None)
        if path:
            spark = step.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def give_back_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more.

    Spark's cleaner does so once the driver's collector has found a plan unused, and on a driver with room that may take hours. Between the stages of
    a long job, whose results are written, it is asked for. Plans still in use keep their files.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
