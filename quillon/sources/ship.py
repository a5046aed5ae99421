"""Ship this package to the Python workers, wherever they run."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def _archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, str(Path(PACKAGE.name) / f.relative_to(PACKAGE)))
    return out.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the workers' import path, once per Spark context.

    The archive lies in the shared folder named by spark.checkpoint.dir; where that is unset, as in
    tests, in a temporary one.
    """
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        jvm, name = spark._jvm, f"{folder}/quillon/src-{uuid.uuid4().hex}.zip"
        path = jvm.org.apache.hadoop.fs.Path(name)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(_archive())
        out.close()
    elif not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    else:
        name = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "src.zip")
        Path(name).write_bytes(_archive())
    context.addPyFile(name)
    context._quillon_shipped = True
