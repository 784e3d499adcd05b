"""Sessions, table access and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER_SEQUENCE = "meridion"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    spark = SparkSession.builder.master(master).appName("meridion").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local run takes a temporary folder of the machine; on a cluster, whose executors could not read
    that, it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(known)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class ScratchTables:
    """Parquet tables in the shared folder that one job writes once and reads several times."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{_FOLDER_SEQUENCE}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, number: int) -> None:
        """Delete one table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
