"""Tables written to the shared checkpoint folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trim() -> None:
    """Give freed memory of this process back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at its end the worker gives back what it freed, since workers stay for later tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def collect_garbage(spark: SparkSession) -> None:
    """A full collection on the executors, as a task for each of their cores: a heap that a step has grown is given back
    before the next one starts. Without effect where explicit collections are switched off."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = tempfile.mkdtemp(prefix="logspark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Scratch:
    """Tables of one run, under names of its own."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, f"{folder(spark)}/llm-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table."""
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        """Tables that no later step reads."""
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(hadoop).delete(path, True)
