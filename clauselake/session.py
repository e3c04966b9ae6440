"""Sessions, tables and written intermediate results."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("clauselake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below `sf_dir`; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir, as a full URI. Where that is unset a session on one
    machine gets a temporary folder; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="clauselake-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full).rstrip("/")


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear() deletes."""
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables that this process has written; results that still read them end with them."""
    while _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back, which cuts the lineage.

    The files outlive any executor, so a lost one costs a reread and no recomputation. The shuffles that made them are
    deleted when they are written.
    """
    return written(df, name)[0]


#: Tells Spark to delete the files of a query's shuffles when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """materialize() with the path, for discard()."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing is to read any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each SparkContext.

    Workers of a cluster may start without the repository on their path; functions given to mapInArrow are
    pickled by reference to it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_clauselake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("clauselake", os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="clauselake-"), "clauselake_package.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    sc.addPyFile(path)
    sc._clauselake_shipped = True


#: Rows, of some 50 bytes each, that a table is broadcast with at most.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, written, and marked for broadcast if it is known to have few rows; a larger one is left to sort-merge."""
    written = materialize(df, name)
    return F.broadcast(written) if written.count() <= rows else written


@contextlib.contextmanager
def traced(spark: SparkSession, name: str, sink=None):
    """ST10: tags the jobs that run inside with a trace id, by which they can be told apart or cancelled, and tells `sink`
    the name, the id, how long it took and whether it failed."""
    trace, began, sc = uuid.uuid4().hex, time.monotonic(), spark.sparkContext
    sc.addJobTag(trace)
    ok = False
    try:
        yield trace
        ok = True
    finally:
        sc.removeJobTag(trace)
        if sink is not None:
            sink({"name": name, "trace": trace, "seconds": time.monotonic() - began, "ok": ok})
