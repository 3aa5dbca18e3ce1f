"""Giving this package to the executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives this package's modules to the executors, once for each application, through Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_tomeforge_shipped", False):
        return
    top, packed = Path(__file__).resolve().parent, io.BytesIO()
    if top.is_dir():  # else this already runs from such an archive
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        out = Path(tempfile.mkdtemp()) / "tomeforge.zip"
        out.write_bytes(packed.getvalue())
        sc.addPyFile(str(out))
    sc._tomeforge_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below a local one only where that is unset and Spark runs in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tomeforge-")
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"
