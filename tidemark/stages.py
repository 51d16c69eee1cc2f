"""Tables between the steps of an operator that runs in rounds."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder


class Stages:
    """Tables below the shared folder: written and read again they cut lineage, and survive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/tidemark-{tag}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.base}/{name}", df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets the context cleaner find the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        # Events that wait in the listeners' queues still refer to their plans.
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark._jvm.System.gc()
