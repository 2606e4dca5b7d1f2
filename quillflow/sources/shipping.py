"""The package itself for a session whose workers do not have it on their path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

import quillflow
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def packed() -> bytes:
    """The package's modules as a zip that Python imports from; the same bytes for the same modules."""
    root, out = os.path.dirname(os.path.abspath(quillflow.__file__)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    z.writestr(zipfile.ZipInfo(os.path.join("quillflow", os.path.relpath(path, root))), f.read())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Sends the package to the session's workers, once an application. Spark hands the file to every executor, also to those that come later."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "quillflow.zip")
        with open(path, "wb") as f:
            f.write(packed())
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
