"""Tables cut to the folder that the driver and the executors share: lineage ends there, and losing an executor later costs a read."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()
_marked: set[str] = set()
_own = uuid.uuid4().hex[:12]
_collected = [0.0]
#: Seconds between two collections of the driver's garbage.
PAUSE = 4.0


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get()
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, with a folder for each value of the column `by` if one is named (which
    then comes last). What is written goes when the scope it was cut in ends, at the latest when the
    driver ends. What was shuffled on the way is of no more use; Spark lets it go once the driver has collected the plan, which is hastened here."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}-{_own}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    if top not in _marked:
        files, at = _file_system(spark, top)
        files.deleteOnExit(at)
        _marked.add(top)
    keep(path)
    if time.monotonic() - _collected[0] > PAUSE:
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def done_with(df: DataFrame, *parts: str) -> None:
    """Drop what `cut` wrote for `df`, or only those folders of it ("kind=1"), before its scope ends: for tables that nothing reads any more."""
    found = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in found:
        if not parts or folder.rsplit("/", 1)[1] in parts:
            drop(df.sparkSession, folder)


def keep(path: str) -> None:
    """Have the open scopes drop a path."""
    for held in getattr(_scopes, "open", []):
        held.append(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """What is cut inside is dropped at the end; results must be written elsewhere by then. Paths taken out of the list stay."""
    held: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), held]
    try:
        yield held
    finally:
        _scopes.open = _scopes.open[:-1]
        for path in held:
            drop(spark, path)


def settle(spark: SparkSession) -> None:
    """Have every executor collect its garbage, so that its heap shrinks to what it holds: otherwise it stays as large as the stage before left it,
    beside the Python workers of the next one. Two short tasks a core, so that none is left out."""
    many = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, many, 1, many).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()
