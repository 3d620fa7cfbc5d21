"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where a local session names none, as in tests.

    On a cluster, whose executors share no local folder, a session without that setting is refused with ValueError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = f"file://{tempfile.gettempdir()}/cresset-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back, so that a lost executor costs no recomputation.

    The table is removed when the driver's process ends, or by ``forget_written``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    return spark.read.schema(df.schema).parquet(path)


#: Tables written so far, each with what is needed to remove it, also once its session has been stopped.
_WRITTEN: list[tuple] = []


def forget_written() -> int:
    """Removes the tables written so far; for long sessions, once the results that came from them are stored elsewhere."""
    n = len(_WRITTEN)
    while _WRITTEN:
        jvm, conf, path = _WRITTEN.pop()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return n


@atexit.register
def _forget_at_exit() -> None:
    try:
        forget_written()
    except Exception:  # the JVM may be gone by then
        pass


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, so that they need no copy of their own. Once per context."""
    context = spark.sparkContext
    if getattr(context, "_cresset_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="cresset-")) / "cresset.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._cresset_shipped = True
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)

