"""Appends: offset numbering and idempotent producers."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.sources.log_view import PART, dense_offsets

#: Batches of a producer that are remembered.
REMEMBERED = 5
APPENDED = "topic string, partition int, seq long, producer_id long, result string, offset long"


def assign_offsets(arrivals: DataFrame, state: DataFrame, order: list[str], slice_: Any) -> DataFrame:
    """Numbers new records from each partition's log end on (0 for a new one)."""
    end = state.select(*PART, F.col("log_end_offset").alias("_end"))
    return dense_offsets(arrivals.join(end, PART, "left"), order, slice_, start=F.coalesce("_end", F.lit(0))).drop("_end")


class Producer:
    """What a partition knows of one producer."""

    def __init__(self) -> None:
        self.epoch, self.next_seq = -1, 0
        self.recent: list[tuple[int, int, int]] = []  # first sequence, records, offset

    def check(self, epoch: int, seq: int, n: int) -> tuple[str, int]:
        """Result, and the earlier offset of a duplicate; an accepted batch is noted by ``note``."""
        if self.epoch < 0:
            return ("append", -1) if seq == 0 else ("unknown producer", -1)
        if epoch < self.epoch:
            return "fenced", -1
        if epoch > self.epoch:
            return ("append", -1) if seq == 0 else ("out of order", -1)
        if seq < self.next_seq:
            at = next((o for s, _, o in self.recent if s == seq), -1)
            return ("duplicate", at) if at >= 0 else ("duplicate outside window", -1)
        return ("append", -1) if seq == self.next_seq else ("out of order", -1)

    def note(self, epoch: int, seq: int, n: int, offset: int) -> None:
        if epoch != self.epoch:
            self.recent = []
        self.epoch, self.next_seq = epoch, seq + n
        self.recent = [*self.recent, (seq, n, offset)][-REMEMBERED:]


def fold(batches: pd.DataFrame, end: int = 0, producers: dict[int, Producer] | None = None) -> tuple[pd.DataFrame, int]:
    """Results of a partition's batches (seq, producer_id, epoch, base_seq, n) in order, and its new log end."""
    producers = {} if producers is None else producers
    rows = []
    for b in batches.sort_values("seq").itertuples():
        p = producers.setdefault(int(b.producer_id), Producer())
        result, offset = p.check(int(b.epoch), int(b.base_seq), int(b.n))
        if result == "append":
            offset, end = end, end + int(b.n)
            p.note(int(b.epoch), int(b.base_seq), int(b.n), offset)
        rows.append((b.seq, b.producer_id, result, offset))
    return pd.DataFrame(rows, columns=["seq", "producer_id", "result", "offset"]), end


def idempotent_append(batches: DataFrame) -> DataFrame:
    """Batch replay of appends (seq, topic, partition, producer_id, epoch, base_seq, n), partition by partition.

    A partition has one writer, so its batches are an ordered fold; partitions are the unit of parallelism."""

    def run(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = fold(pdf)
        return out.assign(topic=key[0], partition=key[1])[[c.split()[0] for c in APPENDED.split(", ")]]

    return batches.groupBy(*PART).applyInPandas(run, APPENDED)


def allocate_producer_ids(table: str, n: int, spark: Any) -> list[int]:
    """The next n producer ids; the new mark is written before they are given out, so none is given twice.

    ``table`` is a folder of numbered marks with one writer, as ids come from one coordinator."""
    last = 0
    try:
        last = spark.read.parquet(table).agg(F.max("next_id")).first()[0] or 0
    except Exception as e:  # no mark yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    spark.range(1).select(F.lit(last + n).cast("long").alias("next_id")).write.mode("append").parquet(table)
    return list(range(last, last + n))


def recent_batches(batches: DataFrame, most: int = REMEMBERED) -> DataFrame:
    """The last batches of each producer."""
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("producer_id").orderBy(F.desc("base_seq")))
    return batches.withColumn("_rn", rn).filter(F.col("_rn") <= most).drop("_rn")
