"""Session and scratch-folder helpers shared by every operator."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's setting. Only a local master may do without; it gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get(_CHECKPOINT, None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {_CHECKPOINT} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="galena-")
        atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later plans start from the written table.

    Unlike a persisted frame it outlives lost executors, and unlike checkpoint() it is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/galena/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries that nothing refers to any more.

    It does so when the driver's garbage collector finds them, which may be long after they were last needed; called between
    a written table and a large shuffle, the two need not fit on the disks together. No result depends on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
