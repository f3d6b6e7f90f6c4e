"""Session services shared by the operators: code shipping, scratch tables, sizes."""

from __future__ import annotations

import gc
import io
import os
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``.

    Workers get the driver's files through Spark's own file service, so the
    package need not be installed on the machines of the cluster.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="fabula-"), "fabula_pkg.zip")
    Path(path).write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file to the workers, once in a session; the name under which ``SparkFiles.get`` finds it there."""
    key = f"{spark.sparkContext.applicationId}:{path}"
    if key not in _SHIPPED:
        spark.sparkContext.addFile(path)
        _SHIPPED.add(key)
    return os.path.basename(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, named by ``spark.checkpoint.dir``.

    Only where that setting is absent in local mode (tests) a temporary folder
    is chosen and set; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="fabula-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Intermediate tables written to the shared folder.

    Writing a table cuts its lineage, and a lost executor never loses it.
    ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._fabula_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._fabula_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(table: DataFrame, rows: int) -> DataFrame:
    """A written table with the hint to broadcast it if it has at most ``rows`` rows; larger ones are joined by a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which an idle
    driver puts off; between the steps of a long operator they would add up.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``, from file sizes; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is an error that names it."""
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"missing column(s): {', '.join(lost)}")
    return df.select(*[df[n] for n in names])
