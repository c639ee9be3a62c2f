"""Send this package to executors that have no copy of it."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure(spark: SparkSession) -> SparkSession:
    """Add the package as a zip to the application's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as out:
        for folder, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    with open(path, "rb") as f:
                        out.writestr(zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(root))), f.read())
    target = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), f"spanloom-{hashlib.sha256(raw.getvalue()).hexdigest()[:16]}.zip")
    with open(target, "wb") as f:
        f.write(raw.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
    return spark
