"""Sessions and durable cuts of lineage.

Every cut goes to a folder that all executors share: the one named by ``spark.checkpoint.dir``.
Only where that setting is missing (tests, a laptop) a private temporary folder is set instead.
Blocks kept on one executor only are never used, so a lost executor costs a re-read, not the job.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(name: str = "lattica", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_lattica_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lattica-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    archive = Path(folder, "lattica.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._lattica_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lattica-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        current = f"file://{own}"
    return current.rstrip("/")


def checkpointed(df: DataFrame, fewer: int = 1) -> DataFrame:
    """Cut the lineage of a small or medium frame (row format, cleaned up once unreferenced).

    ``fewer`` divides the number of shuffle partitions for the frame's own: for frames that are much
    smaller than what they come from, of which every part would be a nearly empty file.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if fewer > 1:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // fewer))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "cut", partition_by: str | None = None) -> DataFrame:
    """Cut the lineage of a large frame: columnar, compressed, prunable. Written once, then re-read.

    The folder goes when the driver ends: until then frames that read it may be in use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context drop shuffle and checkpoint files of frames that are no longer held.

    It learns of them when the driver's garbage is collected, which may otherwise not happen for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that go to a Python worker at a time where the session has Spark's own setting, of 10,000. So many long
#: texts are tens of MB, held by the executor's JVM outside its heap and by the worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once; a session that names a number itself keeps it."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))


def rest_executors(spark: SparkSession) -> None:
    """Let executors collect their garbage, whereupon their heaps shrink to what is in use.

    Otherwise a heap keeps the size it once grew to, and a step's Python workers need room beside it.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
