"""Object storage through Hadoop file systems (s3a://, hdfs://, file:), and the layout in which runs are kept there."""

from __future__ import annotations

import io
import os
import tarfile

from pyspark.sql import SparkSession

from spanloom.errors import OutputExists
from spanloom.functions.expr import plain_text


class Store:
    """Small objects under a root. Names are paths relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def put(self, name: str, content: bytes) -> None:
        out = self._files.create(self._path(name), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def get(self, name: str) -> bytes:
        if not self.exists(name):
            raise FileNotFoundError(f"{self.root}/{name}")
        stream = self._files.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self._files.getFileStatus(self._path(name)).isDirectory()

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted."""
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str) -> bool:
        return self._files.delete(self._path(name), True)


def run_path(service: str, operation: str, day: str, run: str = "") -> str:
    """Where the results of a run lie: service/operation/day[/run], with plain names."""
    return "/".join(plain_text(x) for x in (service, operation)) + f"/{day}" + (f"/{run}" if run else "")


def upload(store: Store, folder: str, service: str, operation: str, day: str, run: str, again: bool = False) -> list[str]:
    """Pack a local folder of results and keep it: under the run's path, where it must not lie yet (unless `again`), and, once a day, under the day's
    path, where the first run stays. Returns the names written. Tables of a run that are large are written by Spark itself, not packed."""
    first, daily = f"{run_path(service, operation, day, run)}/results.tar.gz", f"{run_path(service, operation, day)}/results.tar.gz"
    if store.exists(first) and not again:
        raise OutputExists(first)
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as out:
        for name in sorted(os.listdir(folder)):
            out.add(os.path.join(folder, name), arcname=name)
    written = [first] + ([] if store.exists(daily) else [daily])
    for name in written:
        store.put(name, raw.getvalue())
    return written
