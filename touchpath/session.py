"""Session helpers: settings the plans rely on, and reliable lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the plans count on. Partition counts are left to the cluster: AQE
#: coalesces from whatever ``spark.sql.shuffle.partitions`` the operator sets.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, **extra: str) -> SparkSession:
    """Session for tests and ``bench.py``; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("touchpath")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is not set, a local session takes its warehouse; on a cluster a warehouse
    that is a folder of one machine is an error, since it would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if not sc.master.startswith("local") and warehouse.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"{warehouse}/_intermediate"
        sc.setCheckpointDir(folder)
        _delete_on_exit(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder, where later reads prune its columns.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    _delete_on_exit(spark, folder)
    return spark.read.parquet(folder)
