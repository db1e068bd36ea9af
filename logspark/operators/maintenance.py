"""Background plans: durable frontier, retention, compaction, recovery and index audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspark.operators.segments import ranges
from logspark.sources.log_view import PART


def durable_frontier(uploads: DataFrame, baseline: DataFrame) -> DataFrame:
    """Highest offset up to which uploads (base, end) cover the log from each partition's baseline without a gap."""
    u = uploads.select(*PART, "base", "end").unionByName(baseline.select(*PART, F.col("baseline").alias("base"), F.col("baseline").alias("end")))
    u = u.join(baseline, PART).filter("end >= baseline")
    before = W.partitionBy(*PART).orderBy("base", "end").rowsBetween(W.unboundedPreceding, -1)
    u = u.withColumn("reach", F.greatest("baseline", F.coalesce(F.max("end").over(before), F.col("baseline"))))
    gap = F.max((F.col("base") > F.col("reach")).cast("int")).over(W.partitionBy(*PART).orderBy("base", "end").rowsBetween(W.unboundedPreceding, 0))
    return u.withColumn("_gap", gap).filter("_gap = 0").groupBy(*PART).agg(F.max("end").alias("frontier"))


def time_boundary(winners: DataFrame, older_than: int) -> DataFrame:
    """Last base of the leading run of segments that are older than a unix second (0, unknown, ends the run)."""
    fresh = ((F.col("modified") >= older_than) | (F.col("modified") == 0)).cast("int")
    seen = F.max(fresh).over(W.partitionBy(*PART).orderBy("base").rowsBetween(W.unboundedPreceding, 0))
    return winners.withColumn("_fresh", seen).filter("_fresh = 0").groupBy(*PART).agg(F.max("base").alias("boundary"))


def bytes_boundary(winners: DataFrame, budget: int) -> DataFrame:
    """Base above the first segment, newest first, whose running size is over the budget; an unknown size is over it."""
    w = W.partitionBy(*PART).orderBy(F.desc("base"))
    known = F.sum(F.when(F.col("size") > 0, F.col("size")).otherwise(budget + 1)).over(w)
    over = winners.withColumns({"_sum": known, "_newer": F.lag("base").over(w)}).filter(F.col("_sum") > budget)
    return over.groupBy(*PART).agg(F.coalesce(F.max_by("_newer", "base"), F.max("base")).alias("boundary"))


def retention_plan(winners: DataFrame, boundaries: list[DataFrame], floor: DataFrame | None) -> DataFrame:
    """Segments to delete: all of their offsets lie below every boundary and the consumers' floor; never the newest.

    ``boundaries`` are the policies that are on (none: nothing goes).  A partition needs a boundary of each."""
    if not boundaries:
        return ranges(winners).limit(0).select(*PART, "base", "next_base")
    plan = ranges(winners)
    for k, b in enumerate(boundaries):
        plan = plan.join(b.withColumnRenamed("boundary", f"_b{k}"), PART)
    limit = F.least(*[f"_b{k}" for k in range(len(boundaries))]) if len(boundaries) > 1 else F.col("_b0")
    if floor is not None:
        plan = plan.join(floor.withColumnRenamed("floor", "_f"), PART, "left")
        limit = F.least(limit, F.when(F.col("_f") >= 0, F.col("_f")).otherwise(limit))
    return plan.filter(F.col("next_base").isNotNull() & (F.col("next_base") <= limit)).select(*PART, "base", "next_base")


def log_start_after(winners: DataFrame, plan: DataFrame) -> DataFrame:
    """Oldest base that stays."""
    return winners.join(plan.select(*PART, "base"), [*PART, "base"], "left_anti").groupBy(*PART).agg(F.min("base").alias("log_start_offset"))


def compaction_pick(bucketed: DataFrame, cap: int) -> DataFrame:
    """Segments of each bucket to merge, oldest first: those under half the cap while their sum stays within it."""
    small = bucketed.filter(F.col("size") * 2 < cap)
    total = F.sum("size").over(W.partitionBy(*PART, "bucket").orderBy("base"))
    return small.withColumn("_sum", total).filter(F.col("_sum") <= cap).drop("_sum")


def compaction_candidates(bucketed: DataFrame, cap: int, least: int) -> DataFrame:
    """The first bucket of each partition worth merging: not the newest, all sizes known, ``least`` picks or more.
    Gives the merged base, epoch and size."""
    newest = F.max("bucket").over(W.partitionBy(*PART))
    sized = F.min("size").over(W.partitionBy(*PART, "bucket"))
    ready = bucketed.withColumns({"_newest": newest, "_sized": sized}).filter("bucket < _newest and _sized > 0").drop("_newest", "_sized")
    made = compaction_pick(ready, cap).groupBy(*PART, "bucket").agg(F.count("*").alias("n"), F.min("base").alias("base"), (F.max("epoch") + 1).alias("epoch"), F.sum("size").alias("size")).filter(F.col("n") >= least)
    first = F.row_number().over(W.partitionBy(*PART).orderBy("bucket"))
    return made.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def recovery(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """End and start after a restart: the later end of manifest and objects, the oldest object as start."""
    j = manifest.join(objects, PART, "full_outer")
    return j.select(*PART, F.greatest("manifest_end", "objects_end").alias("log_end_offset"), F.coalesce(F.least("manifest_start", "objects_start"), F.lit(0)).cast("long").alias("log_start_offset"))


def orphans(objects: DataFrame, index: DataFrame) -> DataFrame:
    """Stored objects that no index entry names."""
    return objects.join(index, [*PART, "base", "epoch"], "left_anti")


def dangling(objects: DataFrame, index: DataFrame) -> DataFrame:
    """Index entries without an object."""
    return index.join(objects, [*PART, "base", "epoch"], "left_anti")


def reclaimable(orphans_: DataFrame, winners: DataFrame) -> DataFrame:
    """Orphans whose base an index entry covers: it is at or above the oldest one."""
    oldest = winners.groupBy(*PART).agg(F.min("base").alias("_o"))
    return orphans_.join(oldest, PART).filter("base >= _o").drop("_o")


def quarantine_conflicts(quarantined: DataFrame, index: DataFrame) -> DataFrame:
    """Objects set aside for deletion that the index still names: any row forbids the deletion."""
    return quarantined.join(index, [*PART, "base", "epoch"], "left_semi")


def readiness(agents: DataFrame, now: int, ttl: int) -> DataFrame:
    """Whether each agent's record was renewed within the time to live and has not expired."""
    return agents.select("agent", ((F.col("updated_at") + ttl > now) & (F.col("expires_at") > now)).alias("ready"))


CLAIMED = "topic string, partition int, seq long, agent string, result string, epoch long"


def replay_claims(claims: DataFrame, ttl: int) -> DataFrame:
    """Ordered claims (seq, at, topic, partition, agent, held_epoch): a free or expired partition goes to whoever asks, with
    the next epoch; a live owner is refused to others, and to itself with an older epoch than the stored one."""

    def run(key, pdf):
        import pandas as pd

        owner, epoch, until, rows = None, 0, -1, []
        for c in pdf.sort_values("seq").itertuples():
            live = owner is not None and until > c.at
            if live and (owner != c.agent or c.held_epoch < epoch):
                rows.append((*key, c.seq, c.agent, "refused", epoch))
                continue
            result = "renewed" if live else "claimed"
            owner, epoch, until = c.agent, epoch if live else epoch + 1, c.at + ttl
            rows.append((*key, c.seq, c.agent, result, epoch))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in CLAIMED.split(", ")])

    return claims.groupBy(*PART).applyInPandas(run, CLAIMED)
