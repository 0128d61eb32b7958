"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalogue import checkpoint_dir as shared_dir
from ..sources.catalogue import checkpointed
from ..tables import table

__all__ = ["BROADCAST_IDS", "Scratch", "checkpointed", "having_ids", "shared_dir", "table", "written"]

#: Most rows of 64-bit ids that are broadcast; beyond it the ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and
    the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that can be dropped once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = f"{shared_dir(self.spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        df.write.parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def having_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is (``left_semi``) or is not
    (``left_anti``) in the one column of ``ids``.

    The ids are counted first: up to ``BROADCAST_IDS`` are broadcast, so that
    wide rows stay where they are; more go through a shuffled join.
    """
    name = ids.columns[0]
    key = "__id_of_" + column
    ids = checkpointed(ids.where(F.col(name).isNotNull()).distinct().select(F.col(name).alias(key)))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, df[column] == F.col(key), how)
