"""The segment index: winners by epoch, floor lookups, buckets and their checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspark.sources.log_view import PART

BUCKET = 4096


def _by_epoch() -> W:
    return W.partitionBy(*PART, "base").orderBy(F.desc("epoch"))


def live(segments: DataFrame) -> DataFrame:
    """Of segments with one base the one of highest epoch."""
    return segments.withColumn("_rn", F.row_number().over(_by_epoch())).filter("_rn = 1").drop("_rn")


def superseded(segments: DataFrame) -> DataFrame:
    """The others."""
    return segments.withColumn("_rn", F.row_number().over(_by_epoch())).filter("_rn > 1").drop("_rn")


def ranges(winners: DataFrame) -> DataFrame:
    """Live segments with ``next_base``; the newest of a partition has none."""
    return winners.withColumn("next_base", F.lead("base").over(W.partitionBy(*PART).orderBy("base")))


def floor_lookup(offsets: DataFrame, winners: DataFrame) -> DataFrame:
    """Segment that holds each (topic, partition, offset): the greatest base not above it; null below the first.

    As-of join by one sorted pass: both sides go to their partition's window, tagged, and each offset takes the last
    base before it.  No pair of offset and segment is ever formed."""
    tag = offsets.select(*PART, F.col("offset").alias("at"), F.lit(1).alias("_q"), F.lit(None).cast("struct<base:bigint,epoch:bigint>").alias("s"))
    seg = winners.select(*PART, F.col("base").alias("at"), F.lit(0).alias("_q"), F.struct(F.col("base").cast("long").alias("base"), F.col("epoch").cast("long").alias("epoch")).alias("s"))
    w = W.partitionBy(*PART).orderBy("at", "_q").rowsBetween(W.unboundedPreceding, 0)
    found = tag.unionByName(seg).withColumn("s", F.last("s", ignorenulls=True).over(w)).filter("_q = 1")
    return found.select(*PART, F.col("at").alias("offset"), F.col("s.base").alias("base"), F.col("s.epoch").alias("epoch"))


def buckets(winners: DataFrame, size: int = BUCKET) -> DataFrame:
    """Runs of ``size`` consecutive segments: first and last base, bytes, newest, number."""
    n = F.row_number().over(W.partitionBy(*PART).orderBy("base")) - 1
    b = winners.withColumn("bucket", F.floor(n / size).cast("long"))
    return b.groupBy(*PART, "bucket").agg(F.min("base").alias("first"), F.max("base").alias("last"), F.sum("size").alias("bytes"), F.max("modified").alias("newest"), F.count("*").alias("n"))


def bucket_audit(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Buckets whose recorded bytes differ from the sum over their segments."""
    a = actual.select(*PART, "bucket", F.col("bytes").alias("actual"))
    return recorded.join(a, [*PART, "bucket"]).filter(F.col("bytes") != F.col("actual")).select(*PART, "bucket", F.col("bytes").alias("recorded"), "actual")


def order_violations(entries: DataFrame) -> DataFrame:
    """Entries that do not come after the one before them in merge order (gaps are fine)."""
    prev = F.lag("offset").over(W.partitionBy(*PART).orderBy("ord"))
    return entries.withColumn("prev", prev).filter("prev >= offset").select(*PART, "ord", "offset", "prev")


def sealed_islands(buckets_: DataFrame) -> DataFrame:
    """Maximal runs of buckets in which each begins right after the last offset of the one before."""
    w = W.partitionBy(*PART).orderBy("first")
    new = F.when(F.lag("last_offset").over(w) + 1 == F.col("first"), 0).otherwise(1)
    run = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    return buckets_.withColumn("_new", new).withColumn("island", run).groupBy(*PART, "island").agg(F.min("first").alias("first"), F.max("last_offset").alias("last"), F.count("*").alias("n")).drop("island")


def time_ranges(log: DataFrame, rows: int = 64) -> DataFrame:
    """First and last time and number of records of each segment."""
    base = (F.floor(F.col("offset") / rows) * rows).cast("long")
    return log.groupBy(*PART, base.alias("base")).agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("*").alias("records"))


def coverage_gaps(blocks: DataFrame, seconds: int, by: list[str] = PART) -> DataFrame:
    """Stretches between blocks (min_time, max_time in seconds) longer than the limit."""
    w = W.partitionBy(*by).orderBy("min_time", "max_time")
    reach = F.max("max_time").over(w.rowsBetween(W.unboundedPreceding, 0))
    return blocks.withColumns({"_to": F.lead("min_time").over(w), "_reach": reach}).filter(F.col("_to") - F.col("_reach") > seconds).select(*by, F.col("_reach").alias("gap_from"), F.col("_to").alias("gap_to"))


def rolls(entries: DataFrame, cap: int) -> DataFrame:
    """Segment base of each entry (offset, size): a new one begins before an entry if the one in use is over the cap.

    The running size starts anew at each roll, which no window frame says, so a partition's entries, in order, are
    streamed through a fold that holds two numbers a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, used = None, 0, 0
        for b in batches:
            out = []
            for t, p, offset, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (t, p) != key or used > cap:
                    key, base, used = (t, p), offset, 0
                used += size
                out.append(base)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.int64())], [*PART, "offset", "base"])

    rows = entries.select(*PART, F.col("offset").cast("long"), F.col("size").cast("long"))
    return rows.repartition(*PART).sortWithinPartitions(*PART, "offset").mapInArrow(run, "topic string, partition int, offset long, base long")
