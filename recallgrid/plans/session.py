"""Session settings that operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir, which a cluster's
    executors share; where that is unset on one machine (tests) to a temporary
    one. A cluster without that setting is refused."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="recallgrid-"))


class Rounds:
    """Tables in the checkpoint folder that rounds leave to each other. A
    checkpoint would carry on the estimated size of what it was made from,
    which each round's joins raise to a power: the driver runs out of memory
    over the digits."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.made.append(f"{self.root}/t{len(self.made)}")
        df.write.parquet(self.made[-1])
        return self.spark.read.schema(df.schema).parquet(self.made[-1])

    def drop_all_but_last(self) -> None:
        for at in self.made[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
