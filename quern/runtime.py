"""Session defaults and durable intermediate tables.

Every iterative operator cuts its lineage with :func:`durable`: the rows are written once, as Parquet, to the folder named by
``spark.checkpoint.dir`` (shared by all executors on a cluster) and read back.  A lost executor therefore costs a re-read, never
a recomputation of the loop, and the row count of the table is free (it is in the Parquet footers).
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Makes this package importable in the Python workers of all executors; once per application.

    Functions that run there import it.  Where it is not installed on the nodes, it is sent as one small archive.
    """
    context = (spark or SparkSession.active()).sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quern-package-")
    archive = os.path.join(folder, "quern_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(base, f)
                    z.write(path, os.path.join("quern", os.path.relpath(path, here)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
    atexit.register(lambda: __import__("shutil").rmtree(folder, ignore_errors=True))


def session(cpus: int = 8, name: str = "quern", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with.  Its ``spark.checkpoint.dir`` is the folder that QUERN_CHECKPOINT_DIR names,
    else one of its own, which local mode's only machine shares with itself."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    base["spark.checkpoint.dir"] = os.environ.get("QUERN_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="quern-")
    if "QUERN_CHECKPOINT_DIR" not in os.environ:
        atexit.register(lambda: __import__("shutil").rmtree(base["spark.checkpoint.dir"], ignore_errors=True))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", found)
    atexit.register(lambda: __import__("shutil").rmtree(found, ignore_errors=True))
    return found


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside delete their shuffle files when they end; else these stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back; removed when the program ends.  Its shuffle files are deleted once it is written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quern/{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{checkpoint_dir(spark)}/quern/{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def settles(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written once; the intermediate tables that it made are deleted as soon as it is."""

    @functools.wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        before = set(_written)
        made = durable(make(*args, **kwargs))
        result = next(reversed(_written))
        for path in list(_written):
            if path not in before and path != result:
                _remove(path)
        return made

    return run


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a table made by :func:`durable`; a no-op for any other table."""
    if df is None:
        return
    for f in df.inputFiles()[:1]:
        for path in list(_written):
            if path.split("://")[-1].lstrip("/") in f:
                _remove(path)


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and with it the right to clean up
        pass


@atexit.register
def _clean() -> None:
    for path in list(_written):
        _remove(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def default_parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
