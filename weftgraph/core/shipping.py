"""Handing files to all executors through the shared folder."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from weftgraph.core.session import checkpoint_dir


def put_shared(spark: SparkSession, stem: str, suffix: str, blob: bytes) -> tuple[str, str]:
    """Write `blob` once to the shared folder, under a name with its digest; (name, full path)."""
    name = f"{stem}-{hashlib.sha256(blob).hexdigest()[:16]}{suffix}"
    sc = spark.sparkContext
    folder = checkpoint_dir(spark)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(blob))
        finally:
            out.close()
        fs.rename(part, path)
    return name, path.toString()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors (once a context)."""
    sc = spark.sparkContext
    if getattr(sc, "_weftgraph_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            info = zipfile.ZipInfo(str(p.relative_to(root.parent)))  # a fixed date: same code, same name
            z.writestr(info, p.read_bytes())
    sc.addPyFile(put_shared(spark, root.name, ".zip", buffer.getvalue())[1])
    sc._weftgraph_shipped = True
