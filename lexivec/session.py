"""Session construction and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexivec.schema import LexivecError


def build_session(cores: str | int | None = None, app: str = "lexivec") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("LEXIVEC_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXIVEC_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


#: Folders that this process has written and that lazy results may still read.
_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of this machine only where it is the whole cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise LexivecError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
        root = "file://" + tempfile.mkdtemp(prefix="lexivec-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors: the files are the only copy that later
    stages read, and every executor can reach them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lexivec-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lexivec_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` gave, once all that reads them is itself written."""
    for df in tables:
        path = getattr(df, "_lexivec_path", None)
        if path in _written:
            _written.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what ``materialise`` wrote; call it once results are stored. Returns how many folders went."""
    gone = 0
    while _written:
        gone += _delete(spark, _written.pop())
    return gone
