"""Session helpers: a tuned session for local runs, and scratch tables that cut
lineage through shared storage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}
_shipped: set[str] = set()
_scope: ContextVar[str | None] = ContextVar("scratch scope", default=None)


def build_session(app_name: str = "rankloom", cores: int | str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """Session for tests and benches. A cluster job brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needless where the package is installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='rankloom-ship-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back on a temporary folder, because there the
    driver and the executors are one process on one machine. The folder belongs
    to the application and goes when its JVM ends.
    """
    app = spark.sparkContext.applicationId
    if app in _scratch:
        return _scratch[app]
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        root = f"{shared.rstrip('/')}/{app}"
    elif spark.sparkContext.master.partition("[")[0] == "local":
        root = tempfile.mkdtemp(prefix="rankloom-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    _scratch[app] = root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scope.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder if there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Tables that the calling thread stores inside the block go when it ends, failed or not.

    For work whose result is written inside the block, such as a micro-batch: what is
    left after it is the result alone. A block inside another one ends first.
    """
    folder = scratch_path(spark, "scope")
    before = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(before)
        drop_folder(spark, folder)


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Used where a plan needs the same derived table several times: the work is
    done once, survives the loss of executors, and the reader gets true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only when a count proves the table small; otherwise
    leave the join strategy to the optimizer. For tables of short rows."""
    if df.count() <= max_rows:
        return F.broadcast(df)
    return df


def order_buckets(spark: SparkSession, most: int = 4_096) -> int:
    """How many slices a distributed ordering uses. Results do not depend on it."""
    return max(16, min(most, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def hash_buckets(spark: SparkSession) -> int:
    """Slices of a hash order: they need no quantiles, so there may be more of them."""
    return order_buckets(spark, 65_536)
