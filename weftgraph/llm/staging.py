"""Tables that cut a lineage: written once to the folder all executors share, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.staging import shared_dir


class Staging:
    """Parquet tables below one folder of the shared directory; drop() frees those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_staged_at"] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = t.__dict__.pop("_staged_at", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most so many rows, so that a batch of long texts stays small in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
