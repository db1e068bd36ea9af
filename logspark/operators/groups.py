"""Consumer groups: positions, lag, placement by rendezvous hashing and membership."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.scalar import rendezvous_score
from logspark.sources.log_view import PART

KEY = ["group_id", *PART]


def latest_commits(commits: DataFrame) -> DataFrame:
    """Last write of each key; ``regressed`` marks one below an earlier position."""
    return commits.groupBy(*KEY).agg(F.max_by("offset", "commit_seq").alias("offset"), (F.max_by("offset", "commit_seq") < F.max("offset")).alias("regressed"))


def offset_fetch(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions of the named partitions, -1 without one."""
    return requests.join(positions.select(*KEY, "offset"), KEY, "left").select(*KEY, F.coalesce("offset", F.lit(-1)).cast("long").alias("offset"))


def offset_fetch_all(positions: DataFrame, group: str) -> DataFrame:
    """All positions of a group."""
    return positions.filter(F.col("group_id") == group).select(*KEY, "offset")


def lag(positions: DataFrame, state: DataFrame) -> DataFrame:
    """Log end less position."""
    return positions.join(state, PART).select(*KEY, (F.col("log_end_offset") - F.col("offset")).alias("lag"))


def floor(positions: DataFrame, state: DataFrame) -> DataFrame:
    """Least position over groups of each partition, -1 without any."""
    return state.select(*PART).join(positions.groupBy(*PART).agg(F.min("offset").alias("floor")), PART, "left").select(*PART, F.coalesce("floor", F.lit(-1)).cast("long").alias("floor"))


def rendezvous(keys: DataFrame, agents: DataFrame) -> DataFrame:
    """Owner of each ``key``: the agent of highest score.  Agents are a cluster's live members (few); each row carries
    their list, so keys are scored where they are and nothing is paired or shuffled."""
    all_ = agents.agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    scored = keys.crossJoin(F.broadcast(all_))  # one row on that side
    return scored.select(*keys.columns, F.get("agents", rendezvous_score("key", "agents")).alias("owner"))


def assignment_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose owner changes, appears or goes."""
    b, a = before.select("key", F.col("owner").alias("before")), after.select("key", F.col("owner").alias("after"))
    return b.join(a, "key", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def merge_positions(checkpoint: DataFrame, live: DataFrame) -> DataFrame:
    """Positions of both; a live one wins."""
    c, n = checkpoint.select(*KEY, F.col("offset").alias("_c")), live.select(*KEY, F.col("offset").alias("_n"))
    return c.join(n, KEY, "full_outer").select(*KEY, F.coalesce("_n", "_c").alias("offset"))


def list_groups(members: DataFrame) -> DataFrame:
    """Groups with members or a protocol type."""
    g = members.groupBy("group_id").agg(F.count("member_id").alias("members"), F.max("protocol_type").alias("protocol_type"))
    return g.filter((F.col("members") > 0) | (F.coalesce("protocol_type", F.lit("")) != ""))


def describe_groups(requests: DataFrame, groups: DataFrame) -> DataFrame:
    """State of the named groups; unknown ones are Dead."""
    return requests.join(groups, "group_id", "left").select("group_id", F.coalesce("state", F.lit("Dead")).alias("state"), F.coalesce("members", F.lit(0)).cast("long").alias("members"))


class Group:
    """One group's membership; times are milliseconds of the replay."""

    EMPTY, PREPARING, COMPLETING, STABLE = "Empty", "PreparingRebalance", "CompletingRebalance", "Stable"

    def __init__(self) -> None:
        self.state, self.generation, self.leader = self.EMPTY, 0, ""
        self.members: dict[str, tuple[int, int, int]] = {}  # last beat, session, rebalance

    def expire(self, now: int) -> bool:
        """Drops members not heard of within their time and a second."""
        waiting = self.state in (self.PREPARING, self.COMPLETING)
        gone = [m for m, (beat, session, rebalance) in self.members.items() if now - beat > max(session, rebalance if waiting else 0, 1000) + 1000]
        for m in gone:
            del self.members[m]
        if gone:
            self._changed()
        return bool(gone)

    def _changed(self) -> None:
        self.generation += 1
        if self.leader not in self.members:
            self.leader = min(self.members, default="")
        self.state = self.PREPARING if self.members else self.EMPTY

    def apply(self, event: str, member: str, generation: int, session: int, rebalance: int, now: int) -> str:
        """Result of one event: ok, unknown member, illegal generation or rebalance in progress."""
        if event == "join":
            if not self.members or self.state in (self.EMPTY, self.STABLE):
                self.generation += 1
            self.members[member] = (now, session, rebalance)
            self.leader = self.leader if self.leader in self.members else member
            self.state = self.COMPLETING
            return "ok"
        if event == "leave":
            if member in self.members:
                del self.members[member]
                self._changed()
            return "ok"
        if member not in self.members:
            return "unknown member"
        if event == "heartbeat":
            self.members[member] = (now, *self.members[member][1:])
        if generation != self.generation:
            return "illegal generation"
        if event == "sync":
            if member == self.leader:
                self.state = self.STABLE
            return "ok" if self.state == self.STABLE else "rebalance in progress"
        return "ok" if self.state == self.STABLE else "rebalance in progress"


REPLAYED = "group_id string, seq long, event string, member_id string, result string, state string, generation int, leader string, members int"


def replay(events: DataFrame) -> DataFrame:
    """Fold of group events (seq, at_ms, group_id, event, member_id, generation, session_ms, rebalance_ms), group by
    group in order; a ``tick`` only lets time pass."""

    def run(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        group, rows = Group(), []
        for e in pdf.sort_values("seq").itertuples():
            group.expire(int(e.at_ms))
            result = "ok" if e.event == "tick" else group.apply(e.event, e.member_id, int(e.generation), int(e.session_ms), int(e.rebalance_ms), int(e.at_ms))
            rows.append((key[0], e.seq, e.event, e.member_id, result, group.state, group.generation, group.leader, len(group.members)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REPLAYED.split(", ")])

    return events.groupBy("group_id").applyInPandas(run, REPLAYED)
