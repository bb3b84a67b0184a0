"""Intermediate tables in the folder that the session shares (spark.checkpoint.dir), and the package on its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir. Without that setting one machine gets a temporary folder; a cluster is refused, as its machines share none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_tracemill_folder", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.sparkContext._tracemill_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/tracemill-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, has known size."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that no later result reads."""
    for df in written:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once a context: Spark serves the archive to every worker."""
    context = spark.sparkContext
    if getattr(context, "_tracemill_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tracemill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tracemill_shipped = True
