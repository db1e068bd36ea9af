"""Streaming ingestion: producers' batches in, accepted appends out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logspark.operators.groups import REPLAYED, Group
from logspark.operators.ingest import APPENDED, Producer, fold

_STATE = "end long, producers string"


def _load(text: str) -> dict[int, Producer]:
    out = {}
    for pid, (epoch, next_seq, recent) in json.loads(text).items():
        p = out[int(pid)] = Producer()
        p.epoch, p.next_seq, p.recent = epoch, next_seq, [tuple(r) for r in recent]
    return out


def _dump(producers: dict[int, Producer]) -> str:
    return json.dumps({k: (p.epoch, p.next_seq, p.recent) for k, p in producers.items() if p.epoch >= 0})


def idempotent_appends(batches: DataFrame) -> DataFrame:
    """Stream of appends (seq, topic, partition, producer_id, epoch, base_seq, n) with result and offset.

    A partition's log end and its producers live in the state store, so a restart goes on where it was; batches of one
    trigger are taken in ``seq`` order, and one that is still ahead of its producer is refused."""

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, producers = (state.get[0], _load(state.get[1])) if state.exists else (0, {})
        rows = pd.concat(list(parts), ignore_index=True)
        out, end = fold(rows, end, producers)
        state.update((int(end), _dump(producers)))
        yield out.assign(topic=key[0], partition=key[1])[[c.split()[0] for c in APPENDED.split(", ")]]

    return batches.groupBy("topic", "partition").applyInPandasWithState(run, APPENDED, _STATE, "append", GroupStateTimeout.NoTimeout)


def group_sessions(events: DataFrame) -> DataFrame:
    """Stream of group events with results and the group after each; time is that of the events."""

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = Group()
        if state.exists:
            g.state, g.generation, g.leader = state.get[:3]
            g.members = {k: tuple(v) for k, v in json.loads(state.get[3]).items()}
        rows = []
        for e in pd.concat(list(parts), ignore_index=True).sort_values("seq").itertuples():
            g.expire(int(e.at_ms))
            result = "ok" if e.event == "tick" else g.apply(e.event, e.member_id, int(e.generation), int(e.session_ms), int(e.rebalance_ms), int(e.at_ms))
            rows.append((key[0], e.seq, e.event, e.member_id, result, g.state, g.generation, g.leader, len(g.members)))
        state.update((g.state, g.generation, g.leader, json.dumps(g.members)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPLAYED.split(", ")])

    return events.groupBy("group_id").applyInPandasWithState(run, REPLAYED, "state string, generation int, leader string, members string", "append", GroupStateTimeout.NoTimeout)


def write_log(appends: DataFrame, path: str, checkpoint: str) -> Any:
    """Writes accepted appends as a table by topic and partition, each trigger's files sorted by offset; a repeated
    trigger after a failure overwrites its own folder."""

    def put(df: DataFrame, batch: int) -> None:
        rows = df.filter("result = 'append'").withColumn("trigger", F.lit(batch))
        rows.sortWithinPartitions("topic", "partition", "offset").write.mode("overwrite").partitionBy("topic", "partition").parquet(f"{path}/trigger={batch}")

    return appends.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(log: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrites a log table in few files, dealt by partition and offset range and sorted, for pruned range scans."""
    ranged = log.withColumn("_r", F.floor(F.col("offset") / rows_per_file))
    ranged.repartition("topic", "partition", "_r").sortWithinPartitions("topic", "partition", "offset").drop("_r").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("topic", "partition").parquet(path)
