"""Range scans, point reads and boundary lookups over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspark.sources.log_view import PART

OK, OUT_OF_RANGE, UNKNOWN = 0, 1, 5
RESPONSE_BYTES = 50 * 1024 * 1024
#: The least size of a record: the header of an entry.
LEAST_BYTES = 12


def list_offsets(state: DataFrame) -> DataFrame:
    """Earliest and latest offset of every partition, from the state table alone."""
    return state.select(*PART, F.col("log_start_offset").alias("earliest"), F.col("log_end_offset").alias("latest"))


def offsets_for_time(log: DataFrame, at: Column) -> DataFrame:
    """First offset at or after a time, or the log end (an extension: the service itself answers the log end)."""
    return log.groupBy(*PART).agg(F.coalesce(F.min(F.when(F.col("timestamp") >= at, F.col("offset"))), F.max("offset") + 1).alias("offset"))


def fetch_status(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests with log bounds and status: unknown partition 5, outside the log 1, else 0 (caught up included)."""
    s = requests.join(state, PART, "left")
    o, start, hw = F.col("fetch_offset"), F.col("log_start_offset"), F.col("high_watermark")
    status = F.when(hw.isNull(), UNKNOWN).when((o > hw) | ((start > 0) & (o < start)), OUT_OF_RANGE).otherwise(OK)
    return s.withColumn("status", status.cast("int"))


def fetch(log: DataFrame, state: DataFrame, requests: DataFrame) -> DataFrame:
    """Records for (request_id, ord, topic, partition, fetch_offset, partition_max_bytes, max_bytes).

    A null or non-positive max_bytes stands for the default budget, such a partition_max_bytes for all that is left of it.
    A partition's rows stop when its byte budget is used up; its first row comes anyway.  The rest of the response
    budget is taken in request order: each partition gets what those before it left, one byte at least.  The running
    sum is per request and partition, over no more records than the budget can hold: offsets are dense and a record
    has ``LEAST_BYTES`` or more, so a request's window is bounded by its budget, not by the log."""
    whole = F.when(F.col("max_bytes") > 0, F.col("max_bytes")).otherwise(F.lit(RESPONSE_BYTES)).cast("long")
    asked = fetch_status(requests, state).filter("status = 0 and fetch_offset < high_watermark").withColumn("max_bytes", whole)
    asked = asked.withColumn("partition_max_bytes", F.least(F.when(F.col("partition_max_bytes") > 0, F.col("partition_max_bytes")).cast("long"), "max_bytes"))
    hits = log.join(asked.select("request_id", "ord", *PART, "fetch_offset", "partition_max_bytes", "max_bytes"), PART).filter(F.col("offset").between(F.col("fetch_offset"), F.col("fetch_offset") + F.floor(F.col("partition_max_bytes") / LEAST_BYTES)))
    w = W.partitionBy("request_id", "ord").orderBy("offset")
    hits = hits.withColumns({"_sum": F.sum("size").over(w), "_rn": F.row_number().over(w)}).filter("_sum <= partition_max_bytes or _rn = 1")
    used = hits.groupBy("request_id", "ord", F.col("max_bytes").alias("_m")).agg(F.collect_list(F.struct("_rn", "_sum")).alias("rows"))
    # what is left for a partition depends on what was returned before it: an ordered fold over one request's partitions
    folded = used.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("ord", "_m", F.array_sort("rows").alias("rows")))).alias("parts"))
    start = F.struct(F.lit(None).cast("long").alias("left"), F.array().cast("array<struct<ord:int,n:int>>").alias("take"))

    def step(acc: Column, p: Column) -> Column:
        left = F.greatest(F.coalesce(acc["left"], p["_m"].cast("long")), F.lit(1).cast("long"))
        n = F.greatest(F.size(F.filter(p["rows"], lambda r: r["_sum"] <= left)), F.lit(1))
        spent = F.get(p["rows"], n - 1)["_sum"]
        return F.struct((left - spent).alias("left"), F.concat(acc["take"], F.array(F.struct(p["ord"].alias("ord"), n.alias("n")))).alias("take"))

    take = folded.select("request_id", F.explode(F.aggregate("parts", start, step)["take"]).alias("t")).select("request_id", F.col("t.ord").alias("ord"), F.col("t.n").alias("_take"))
    return hits.join(take, ["request_id", "ord"]).filter("_rn <= _take").select("request_id", "ord", *PART, "offset", "key", "value", "size")


def truncate(rows: DataFrame, most: int, by: list[str]) -> DataFrame:
    """The first ``most`` rows of each group by offset (0: all)."""
    if most <= 0:
        return rows
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy("offset"))).filter(F.col("_rn") <= most).drop("_rn")


def point_read(log: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    """The record at one place."""
    return log.filter((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") == offset))
