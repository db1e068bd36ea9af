"""Catalog answers: brokers, topics, leaders, capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspark.sources.log_view import PART

# API keys with the versions served.
APIS = (
    (0, "Produce", 0, 3), (1, "Fetch", 0, 5), (2, "ListOffsets", 0, 2), (3, "Metadata", 0, 7), (8, "OffsetCommit", 0, 0), (9, "OffsetFetch", 0, 1), (10, "FindCoordinator", 0, 0), (11, "JoinGroup", 0, 1), (12, "Heartbeat", 0, 0), (13, "LeaveGroup", 0, 0),
    (14, "SyncGroup", 0, 0), (15, "DescribeGroups", 0, 0), (16, "ListGroups", 0, 0), (17, "SaslHandshake", 0, 1), (18, "ApiVersions", 0, 0), (19, "CreateTopics", 0, 0), (20, "DeleteTopics", 0, 0), (22, "InitProducerId", 0, 1), (36, "SaslAuthenticate", 0, 1),
)


def api_versions(spark: SparkSession, sasl: bool = True) -> DataFrame:
    """The capability table, without the SASL rows if none is configured."""
    rows = ", ".join(f"({k}, '{n}', {a}, {b})" for k, n, a, b in APIS if sasl or not n.startswith("Sasl"))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(api_key, name, min_version, max_version)")


def brokers(agents: DataFrame, routing: DataFrame, now: int) -> DataFrame:
    """Live agents whose routing record names the same node; of one node id the first agent."""
    live = agents.filter(F.col("expires_at") > now).join(routing.select("agent", F.col("node_id").alias("_n")), "agent").filter("node_id = _n")
    first = F.row_number().over(W.partitionBy("node_id").orderBy("agent"))
    return live.withColumn("_rn", first).filter("_rn = 1").select("node_id", "agent", "host", "port")


def owners(routing: DataFrame, brokers_: DataFrame) -> DataFrame:
    """Partition owners by the routing of brokers; the highest epoch wins."""
    r = routing.join(brokers_.select("agent"), "agent").select("node_id", F.explode("partitions").alias("p"))
    return r.groupBy("p.topic", "p.partition").agg(F.max_by("node_id", F.struct("p.epoch", -F.col("node_id"))).alias("leader"), F.max("p.epoch").alias("leader_epoch"))


def topic_metadata(inventory: DataFrame, owners_: DataFrame) -> DataFrame:
    """Leader of every partition; -1 with code 5 where there is none."""
    return inventory.join(owners_, PART, "left").select(*PART, F.coalesce("leader", F.lit(-1)).cast("int").alias("leader"), F.when(F.col("leader").isNull(), 5).otherwise(0).alias("error_code"))


def create_topics(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Partitions of the new topics (one at least); an existing name gets code 36 and none."""
    r = requests.join(existing.select("topic").distinct().withColumn("_old", F.lit(True)), "topic", "left")
    n = F.when(F.col("_old"), 0).otherwise(F.greatest("partitions", F.lit(1)))
    return r.select("topic", F.when(F.col("_old"), 36).otherwise(0).alias("error_code"), F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("partition"))


def delete_topics(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """What stays of any table with a topic column."""
    return rows.join(topics.select("topic"), "topic", "left_anti")


def inventory(*sources: DataFrame) -> DataFrame:
    """Union of partition lists."""
    out = sources[0].select(*PART)
    for s in sources[1:]:
        out = out.union(s.select(*PART))
    return out.distinct()
