"""The log tables: records, segments, control records.

``log_records`` reads a partitioned log out of the event table; the other tables follow from it or are small literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = ["topic", "partition"]
SEGMENT_ROWS = 64


def dense_offsets(df: DataFrame, order: list[str], slice_: Column, keys: list[str] = PART, start: Column | None = None) -> DataFrame:
    """Adds ``offset``: dense numbers from 0 (or ``start``) for each key in the given order.

    ``slice_`` must not decrease with the order.  Rows are numbered inside a slice and slices by running counts, so one
    busy partition of the log is spread over as many tasks as it has slices instead of one."""
    cut = df.withColumn("_slice", slice_)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    base = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    offset = within + F.col("_base") + (start if start is not None else F.lit(0))
    return cut.join(base, [*keys, "_slice"]).withColumn("offset", offset.cast("long")).drop("_slice", "_base")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, partition, offset, timestamp, key, value, size."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("ts").alias("timestamp"), F.col("user_id").alias("key"), F.col("props").alias("value"), (F.length("props") + 12).cast("long").alias("size")
    )
    return dense_offsets(e, ["timestamp", "event_id"], F.date_trunc("day", F.col("timestamp"))).select(*PART, "offset", "timestamp", "key", "value", "size")


def seconds(ts: str) -> Column:
    """Unix seconds of a timestamp without a zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})").cast("long")


def segments(log: DataFrame) -> DataFrame:
    """Segment index of a log: runs of offsets with epoch, size, modified; some runs have a superseded copy."""
    run = F.floor(F.col("offset") / SEGMENT_ROWS)
    live = log.groupBy(*PART, (run * SEGMENT_ROWS).cast("long").alias("base")).agg(F.sum("size").alias("size"), F.max("timestamp").alias("_t"))
    live = live.withColumns({"modified": seconds("_t"), "_k": (F.col("base") / SEGMENT_ROWS).cast("long") % 3}).drop("_t")
    out = [*PART, "base", "epoch", "size", "modified"]
    old = live.filter("_k = 1").withColumns({"epoch": F.col("_k"), "size": F.floor(F.col("size") / 2)})
    return live.withColumn("epoch", F.col("_k") + 1).select(*out).unionByName(old.select(*out))


def partition_state(log: DataFrame) -> DataFrame:
    """log_start_offset, log_end_offset, high_watermark of each partition."""
    return log.groupBy(*PART).agg(F.min("offset").alias("log_start_offset"), (F.max("offset") + 1).alias("log_end_offset")).withColumn("high_watermark", F.col("log_end_offset"))


def committed(log: DataFrame) -> DataFrame:
    """Commits of three groups: an early one, then the quarter (g + 1) of each partition's log end."""
    end = partition_state(log).select(*PART, F.col("log_end_offset").alias("e"))
    g = end.crossJoin(log.sparkSession.range(3).withColumnRenamed("id", "g"))  # three rows: groups of the view, not data
    one = g.select(F.concat(F.lit("group-"), F.col("g").cast("string")).alias("group_id"), *PART, F.expr("e * (g + 1) div 4").alias("offset"), F.lit(2).cast("long").alias("commit_seq"))
    return one.unionByName(one.withColumns({"offset": F.expr("offset div 2"), "commit_seq": F.lit(1).cast("long")}))


def values(spark: SparkSession, sql: str, schema: str) -> DataFrame:
    """Literal rows with the types of a schema such as ``a string, b long``."""
    cols = [c.strip().split(" ", 1) for c in schema.split(",")]
    return spark.sql(f"SELECT * FROM VALUES {sql} AS t({', '.join(c for c, _ in cols)})").select(*[F.col(c).cast(t).alias(c) for c, t in cols])
