"""The named queries, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import scalar
from logspark.operators import authz, groups, ingest, maintenance, metadata, scan, segments, timeseries
from logspark.plans import literals as lit
from logspark.sources import log_view as view


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


QUERIES: dict[str, Query] = {}

# Common table expressions of the oracles: the log and what follows from it.
LOG = """log AS (SELECT event_type AS topic, CAST(user_id % 4 AS INT) AS "partition", row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset", ts AS "timestamp", user_id AS "key", props AS "value", CAST(12 + length(props) AS BIGINT) AS size FROM events)"""
STATE = LOG + """, state AS (SELECT topic, "partition", min("offset") AS log_start_offset, max("offset") + 1 AS log_end_offset FROM log GROUP BY ALL)"""
COMMITTED = STATE + """, one AS (SELECT 'group-' || g AS group_id, topic, "partition", log_end_offset * (g + 1) // 4 AS "offset", 2 AS commit_seq FROM state, (VALUES (0), (1), (2)) AS x(g)), commits AS (SELECT * FROM one UNION ALL SELECT group_id, topic, "partition", "offset" // 2, 1 FROM one), positions AS (SELECT group_id, topic, "partition", arg_max("offset", commit_seq) AS "offset" FROM commits GROUP BY ALL)"""
SEGMENTS = LOG + """, l0 AS (SELECT topic, "partition", "offset" // 64 * 64 AS base, CAST(sum(size) AS BIGINT) AS size, CAST(floor(epoch(max("timestamp"))) AS BIGINT) AS modified FROM log GROUP BY ALL), segs AS (SELECT topic, "partition", base, base // 64 % 3 + 1 AS epoch, size, modified FROM l0 UNION ALL SELECT topic, "partition", base, base // 64 % 3, size // 2, modified FROM l0 WHERE base // 64 % 3 = 1), live AS (SELECT * FROM segs QUALIFY row_number() OVER (PARTITION BY topic, "partition", base ORDER BY epoch DESC) = 1)"""
BUCKETED = SEGMENTS + """, bucketed AS (SELECT *, (row_number() OVER (PARTITION BY topic, "partition" ORDER BY base) - 1) // 4 AS bucket FROM live)"""


def _values(name: str, rows: tuple[str, str]) -> str:
    cols = [c.strip().split(" ", 1) for c in rows[1].split(",")]
    kinds = {"string": "VARCHAR", "int": "INT", "long": "BIGINT"}
    return f"{name} AS (SELECT " + ", ".join(f'CAST("{c}" AS {kinds[t]}) AS "{c}"' for c, t in cols) + f" FROM (VALUES {rows[0]}) AS v(" + ", ".join(f'"{c}"' for c, _ in cols) + "))"


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = Query(f, oracle)
        return f

    return put


def _literal(spark: SparkSession, rows: tuple[str, str]) -> DataFrame:
    return view.values(spark, *rows)


def _log(spark: SparkSession, d: str) -> DataFrame:
    return view.log_records(spark, d)


def _live(spark: SparkSession, d: str) -> DataFrame:
    return segments.live(view.segments(_log(spark, d)))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return groups.latest_commits(view.committed(_log(spark, d)))


def _state(spark: SparkSession, d: str) -> DataFrame:
    return view.partition_state(_log(spark, d))


def _routing(spark: SparkSession) -> DataFrame:
    return _literal(spark, lit.ROUTING).groupBy("agent", "node_id").agg(F.collect_list(F.struct("topic", "partition", "epoch")).alias("partitions"))


# log and scans


@query(f"WITH {LOG} SELECT * FROM log")
def log_view(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d)


@query(f'WITH {STATE} SELECT topic, "partition", log_start_offset AS earliest, log_end_offset AS latest FROM state')
def list_offsets_earliest_latest(spark: SparkSession, d: str) -> DataFrame:
    return scan.list_offsets(_state(spark, d))


@query(f"""WITH {LOG} SELECT topic, "partition", coalesce(min(CASE WHEN "timestamp" >= (SELECT min(ts) + INTERVAL 10 DAY FROM events) THEN "offset" END), max("offset") + 1) AS "offset" FROM log GROUP BY ALL""")
def list_offsets_for_time(spark: SparkSession, d: str) -> DataFrame:
    start = spark.read.parquet(f"{d}/events.parquet").agg(F.min("ts")).first()[0]
    return scan.offsets_for_time(_log(spark, d), F.lit(start).cast("timestamp_ntz") + F.expr("interval 10 days"))


FETCH = f"""WITH RECURSIVE {STATE}, {_values("req", lit.REQUESTS)}, hits AS (SELECT r.request_id, r.ord, l.topic, l."partition", l."offset", l."key", l."value", l.size, r.partition_max_bytes AS pm, coalesce(r.max_bytes, 52428800) AS m, sum(l.size) OVER w AS s, row_number() OVER w AS rn FROM req r JOIN state t USING (topic, "partition") JOIN log l USING (topic, "partition") WHERE r.fetch_offset < t.log_end_offset AND NOT (t.log_start_offset > 0 AND r.fetch_offset < t.log_start_offset) AND l."offset" >= r.fetch_offset WINDOW w AS (PARTITION BY r.request_id, r.ord ORDER BY l."offset")),
own AS (SELECT * FROM hits WHERE s <= pm OR rn = 1), parts AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS k FROM (SELECT DISTINCT request_id, ord, m FROM own)),
taken AS (SELECT request_id, k, ord, greatest(m, 1) AS have, (SELECT max(o.s) FROM own o WHERE o.request_id = p.request_id AND o.ord = p.ord AND (o.s <= greatest(p.m, 1) OR o.rn = 1)) AS spent FROM parts p WHERE k = 1
UNION ALL SELECT p.request_id, p.k, p.ord, greatest(t.have - t.spent, 1), (SELECT max(o.s) FROM own o WHERE o.request_id = p.request_id AND o.ord = p.ord AND (o.s <= greatest(t.have - t.spent, 1) OR o.rn = 1)) FROM taken t JOIN parts p ON p.request_id = t.request_id AND p.k = t.k + 1)
SELECT o.request_id, o.ord, o.topic, o."partition", o."offset", o."key", o."value", o.size FROM own o JOIN taken t USING (request_id, ord) WHERE o.s <= t.have OR o.rn = 1"""


@query(FETCH)
def fetch_range(spark: SparkSession, d: str) -> DataFrame:
    return scan.fetch(_log(spark, d), _state(spark, d), _literal(spark, lit.REQUESTS))


@query(f"""WITH {STATE}, {_values("req", lit.REQUESTS)} SELECT request_id, ord, topic, "partition", fetch_offset, CAST(CASE WHEN log_end_offset IS NULL THEN 5 WHEN fetch_offset > log_end_offset OR (log_start_offset > 0 AND fetch_offset < log_start_offset) THEN 1 ELSE 0 END AS INT) AS status FROM req LEFT JOIN state USING (topic, "partition")""")
def fetch_status_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scan.fetch_status(_literal(spark, lit.REQUESTS), _state(spark, d)).select("request_id", "ord", "topic", "partition", "fetch_offset", "status")


@query(f"""WITH {LOG} SELECT * FROM log WHERE topic = 'click' AND "partition" = 1 AND "offset" = 7""")
def point_read(spark: SparkSession, d: str) -> DataFrame:
    return scan.point_read(_log(spark, d), "click", 1, 7)


@query(f"""WITH {LOG} SELECT topic, "partition", "offset", size FROM log QUALIFY row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") <= 3""")
def fetch_row_cap(spark: SparkSession, d: str) -> DataFrame:
    return scan.truncate(_log(spark, d).select("topic", "partition", "offset", "size"), 3, view.PART)


# metadata


BROKERS = f"""{_values("agents", lit.AGENTS)}, {_values("routing", lit.ROUTING)}, brokers AS (SELECT DISTINCT a.node_id, a.agent, a.host, a.port FROM agents a JOIN routing r ON a.agent = r.agent AND a.node_id = r.node_id WHERE expires_at > 150 QUALIFY dense_rank() OVER (PARTITION BY a.node_id ORDER BY a.agent) = 1), owners AS (SELECT topic, "partition", arg_max(b.node_id, struct_pack(e := epoch, n := -b.node_id)) AS leader FROM routing r JOIN brokers b ON r.agent = b.agent GROUP BY ALL)"""


@query(f"WITH {BROKERS} SELECT * FROM brokers")
def metadata_brokers(spark: SparkSession, d: str) -> DataFrame:
    return metadata.brokers(_literal(spark, lit.AGENTS), _routing(spark), 150)


@query(f"""WITH {LOG}, {BROKERS}, parts AS (SELECT DISTINCT topic, "partition" FROM log UNION SELECT topic, "partition" FROM routing) SELECT topic, "partition", coalesce(leader, -1) AS leader, CASE WHEN leader IS NULL THEN 5 ELSE 0 END AS error_code FROM parts LEFT JOIN owners USING (topic, "partition")""")
def topic_metadata(spark: SparkSession, d: str) -> DataFrame:
    b = metadata.brokers(_literal(spark, lit.AGENTS), _routing(spark), 150)
    return metadata.topic_metadata(metadata.inventory(_state(spark, d), _literal(spark, lit.ROUTING)), metadata.owners(_routing(spark), b))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {a}, {b})" for k, n, a, b in metadata.APIS if not n.startswith("Sasl")) + ") AS t(api_key, name, min_version, max_version)")
def api_versions(spark: SparkSession, d: str) -> DataFrame:
    return metadata.api_versions(spark, sasl=False)


@query(f"""WITH {LOG}, {_values("req", lit.TOPIC_REQUESTS)}, r AS (SELECT topic, partitions, topic IN (SELECT topic FROM log) AS old FROM req) SELECT topic, CASE WHEN old THEN 36 ELSE 0 END AS error_code, CAST(unnest(CASE WHEN old THEN [NULL] ELSE range(greatest(partitions, 1)) END) AS INT) AS "partition" FROM r""")
def create_topics(spark: SparkSession, d: str) -> DataFrame:
    return metadata.create_topics(_state(spark, d), _literal(spark, lit.TOPIC_REQUESTS))


@query(f"""WITH {COMMITTED} SELECT * FROM positions WHERE topic <> 'click'""")
def delete_topic_positions(spark: SparkSession, d: str) -> DataFrame:
    return metadata.delete_topics(_positions(spark, d).select(*groups.KEY, "offset"), spark.sql("SELECT 'click' AS topic"))


# segments


@query(f"WITH {SEGMENTS} SELECT * FROM live")
def segments_live(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d)


@query(f'WITH {SEGMENTS} SELECT * FROM segs QUALIFY row_number() OVER (PARTITION BY topic, "partition", base ORDER BY epoch DESC) > 1')
def segments_superseded(spark: SparkSession, d: str) -> DataFrame:
    return segments.superseded(view.segments(_log(spark, d)))


@query(f'WITH {SEGMENTS} SELECT *, lead(base) OVER (PARTITION BY topic, "partition" ORDER BY base) AS next_base FROM live')
def segment_ranges(spark: SparkSession, d: str) -> DataFrame:
    return segments.ranges(_live(spark, d))


@query(f"""WITH {SEGMENTS}, q AS (SELECT topic, "partition", "offset" - 5 AS "offset" FROM log WHERE "offset" % 37 = 0) SELECT q.topic, q."partition", q."offset", l.base, l.epoch FROM q ASOF LEFT JOIN live l ON q.topic = l.topic AND q."partition" = l."partition" AND q."offset" >= l.base""")
def segment_floor_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = _log(spark, d).filter("offset % 37 = 0").select("topic", "partition", (F.col("offset") - 5).alias("offset"))
    return segments.floor_lookup(q, _live(spark, d))


@query(f"""WITH {SEGMENTS}, q AS (SELECT topic, "partition", "offset" - 5 AS "offset" FROM log) SELECT q.topic, q."partition", q."offset", l.base, l.epoch FROM q ASOF LEFT JOIN live l ON q.topic = l.topic AND q."partition" = l."partition" AND q."offset" >= l.base""")
def segment_floor_lookup_all(spark: SparkSession, d: str) -> DataFrame:
    q = _log(spark, d).select("topic", "partition", (F.col("offset") - 5).alias("offset"))
    return segments.floor_lookup(q, _live(spark, d))


@query(f'WITH {BUCKETED} SELECT topic, "partition", bucket, min(base) AS "first", max(base) AS "last", CAST(sum(size) AS BIGINT) AS bytes, max(modified) AS newest, count(*) AS n FROM bucketed GROUP BY ALL')
def bucket_summary(spark: SparkSession, d: str) -> DataFrame:
    return segments.buckets(_live(spark, d), 4)


@query(f'WITH {BUCKETED}, b AS (SELECT topic, "partition", bucket, CAST(sum(size) AS BIGINT) AS bytes FROM bucketed GROUP BY ALL) SELECT topic, "partition", bucket, bytes // 2 AS recorded, bytes AS actual FROM b WHERE bucket % 2 = 1 AND bytes // 2 <> bytes')
def bucket_bytes_audit(spark: SparkSession, d: str) -> DataFrame:
    actual = segments.buckets(_live(spark, d), 4)
    recorded = actual.withColumn("bytes", F.expr("if(bucket % 2 = 1, bytes div 2, bytes)"))
    return segments.bucket_audit(recorded, actual)


@query(f"""WITH {_values("m", lit.MERGE)}, x AS (SELECT *, lag("offset") OVER (PARTITION BY topic, "partition" ORDER BY ord) AS prev FROM m) SELECT topic, "partition", ord, "offset", prev FROM x WHERE prev >= "offset" """)
def merge_order_violations(spark: SparkSession, d: str) -> DataFrame:
    return segments.order_violations(_literal(spark, lit.MERGE))


@query(f"""WITH {_values("b", lit.ISLANDS)}, x AS (SELECT *, CASE WHEN lag(last_offset) OVER w + 1 = "first" THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY topic, "partition" ORDER BY "first")), y AS (SELECT *, sum(new) OVER (PARTITION BY topic, "partition" ORDER BY "first") AS i FROM x) SELECT topic, "partition", min("first") AS "first", max(last_offset) AS "last", count(*) AS n FROM y GROUP BY topic, "partition", i""")
def sealed_coverage(spark: SparkSession, d: str) -> DataFrame:
    return segments.sealed_islands(_literal(spark, lit.ISLANDS))


# maintenance


@query(f"""WITH RECURSIVE {_values("u", lit.UPLOADS)}, {_values("b", lit.BASELINE)}, f AS (SELECT topic, "partition", baseline AS frontier, 0 AS k FROM b UNION ALL SELECT f.topic, f."partition", (SELECT max(u."end") FROM u WHERE u.topic = f.topic AND u."partition" = f."partition" AND u.base <= f.frontier AND u."end" > f.frontier), k + 1 FROM f WHERE EXISTS (SELECT 1 FROM u WHERE u.topic = f.topic AND u."partition" = f."partition" AND u.base <= f.frontier AND u."end" > f.frontier)) SELECT topic, "partition", max(frontier) AS frontier FROM f GROUP BY ALL""")
def durable_frontier(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.durable_frontier(_literal(spark, lit.UPLOADS), _literal(spark, lit.BASELINE))


BUDGET, CAP = 5_000, 3_500
# a time policy cuts at the middle of the segments' times, a byte policy at 5 kB
CUT = "(SELECT CAST((min(modified) + max(modified)) // 2 AS BIGINT) FROM live)"
TIME_B = f"""tb AS (SELECT topic, "partition", max(base) AS boundary FROM (SELECT *, max(CASE WHEN modified >= {CUT} THEN 1 ELSE 0 END) OVER (PARTITION BY topic, "partition" ORDER BY base) AS fresh FROM live) WHERE fresh = 0 GROUP BY ALL)"""
BYTES_B = """bb AS (SELECT topic, "partition", coalesce(arg_max(newer, base) FILTER (newer IS NOT NULL AND base = mb), max(base)) AS boundary FROM (SELECT *, max(base) OVER (PARTITION BY topic, "partition") AS mb FROM (SELECT *, sum(size) OVER w AS s, lag(base) OVER w AS newer FROM live WINDOW w AS (PARTITION BY topic, "partition" ORDER BY base DESC)) WHERE s > 5000) GROUP BY ALL)"""


def _cut(winners: DataFrame) -> int:
    return int(winners.agg(F.expr("(min(modified) + max(modified)) div 2")).first()[0] or 0)


@query(f"WITH {SEGMENTS}, {TIME_B} SELECT * FROM tb")
def retention_time_boundary(spark: SparkSession, d: str) -> DataFrame:
    winners = _live(spark, d)
    return maintenance.time_boundary(winners, _cut(winners))


@query(f"WITH {SEGMENTS}, {BYTES_B} SELECT * FROM bb")
def retention_bytes_boundary(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.bytes_boundary(_live(spark, d), BUDGET)


PLAN = f"""{TIME_B}, {BYTES_B}, flr AS (SELECT topic, "partition", min("offset") AS f FROM positions GROUP BY ALL), plan AS (SELECT r.topic, r."partition", r.base, r.next_base FROM (SELECT *, lead(base) OVER (PARTITION BY topic, "partition" ORDER BY base) AS next_base FROM live) r JOIN tb USING (topic, "partition") JOIN bb USING (topic, "partition") LEFT JOIN flr USING (topic, "partition") WHERE r.next_base <= least(tb.boundary, bb.boundary, coalesce(f, 9223372036854775807)))"""
PLANNED = COMMITTED + SEGMENTS[len(LOG) :] + ", " + PLAN


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    winners = _live(spark, d)
    floor = groups.floor(_positions(spark, d), _state(spark, d))
    return winners, maintenance.retention_plan(winners, [maintenance.time_boundary(winners, _cut(winners)), maintenance.bytes_boundary(winners, BUDGET)], floor)


@query(f"WITH {PLANNED} SELECT * FROM plan")
def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[1]


@query(f"""WITH {PLANNED} SELECT topic, "partition", min(base) AS log_start_offset FROM live ANTI JOIN plan USING (topic, "partition", base) GROUP BY ALL""")
def retention_log_start(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.log_start_after(*_plan(spark, d))


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(*view.PART).orderBy("base")) - 1
    return _live(spark, d).withColumn("bucket", F.floor(n / 4).cast("long"))


PICK = """pick AS (SELECT * FROM (SELECT *, sum(size) OVER (PARTITION BY topic, "partition", bucket ORDER BY base) AS s FROM bucketed WHERE size * 2 < 3500) WHERE s <= 3500)"""


@query(f'WITH {BUCKETED}, {PICK} SELECT topic, "partition", base, epoch, size, modified, bucket FROM pick')
def compaction_pick(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.compaction_pick(_bucketed(spark, d), CAP)


@query(f"""WITH {BUCKETED}, {PICK}, c AS (SELECT topic, "partition", bucket, count(*) AS n, min(base) AS base, max(epoch) + 1 AS epoch, CAST(sum(size) AS BIGINT) AS size FROM pick p WHERE bucket < (SELECT max(bucket) FROM bucketed b WHERE b.topic = p.topic AND b."partition" = p."partition") GROUP BY ALL) SELECT * FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY topic, "partition" ORDER BY bucket) = 1""")
def compaction_candidates(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.compaction_candidates(_bucketed(spark, d), CAP, 2)


# the store lacks each fifth segment and has the superseded ones and some of an unknown epoch
STORE = SEGMENTS + """, store AS (SELECT topic, "partition", base, epoch FROM segs WHERE base // 64 % 5 <> 0 UNION ALL SELECT topic, "partition", base + 1, epoch FROM live WHERE base // 64 % 7 = 0)"""


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    all_ = view.segments(_log(spark, d))
    winners = segments.live(all_)
    key = ["topic", "partition", "base", "epoch"]
    stored = all_.filter("(base div 64) % 5 <> 0").select(*key).unionByName(winners.filter("(base div 64) % 7 = 0").withColumn("base", F.col("base") + 1).select(*key))
    return stored, winners.select(*key)


@query(f'WITH {STORE} SELECT * FROM store ANTI JOIN live USING (topic, "partition", base, epoch)')
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.orphans(*_store(spark, d))


@query(f'WITH {STORE} SELECT topic, "partition", base, epoch FROM live ANTI JOIN store USING (topic, "partition", base, epoch)')
def dangling(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.dangling(*_store(spark, d))


@query(f'WITH {STORE}, o AS (SELECT * FROM store ANTI JOIN live USING (topic, "partition", base, epoch)) SELECT o.* FROM o JOIN (SELECT topic, "partition", min(base) AS m FROM live GROUP BY ALL) USING (topic, "partition") WHERE o.base >= m')
def reclaimable_orphans(spark: SparkSession, d: str) -> DataFrame:
    stored, index = _store(spark, d)
    return maintenance.reclaimable(maintenance.orphans(stored, index), index)


@query(f"""WITH {_values("m", lit.MANIFEST)}, {_values("o", lit.OBJECTS)} SELECT topic, "partition", greatest(manifest_end, objects_end) AS log_end_offset, coalesce(least(manifest_start, objects_start), 0) AS log_start_offset FROM m FULL JOIN o USING (topic, "partition")""")
def recovery_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.recovery(_literal(spark, lit.MANIFEST), _literal(spark, lit.OBJECTS))


# groups


@query(f'WITH {COMMITTED} SELECT group_id, topic, "partition", arg_max("offset", commit_seq) AS "offset", arg_max("offset", commit_seq) < max("offset") AS regressed FROM commits GROUP BY ALL')
def offset_commit_latest(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d)


NAMED = "VALUES ('group-0', 'click', 0), ('group-2', 'view', 3), ('group-9', 'click', 0), ('group-1', 'nosuch', 1)"


@query(f'WITH {COMMITTED}, r AS (SELECT * FROM ({NAMED}) AS t(group_id, topic, "partition")) SELECT group_id, topic, "partition", coalesce("offset", -1) AS "offset" FROM r LEFT JOIN positions USING (group_id, topic, "partition")')
def offset_fetch_named(spark: SparkSession, d: str) -> DataFrame:
    return groups.offset_fetch(spark.sql(f"SELECT * FROM {NAMED} AS t(group_id, topic, partition)"), _positions(spark, d))


@query(f"WITH {COMMITTED} SELECT * FROM positions WHERE group_id = 'group-1'")
def offset_fetch_all(spark: SparkSession, d: str) -> DataFrame:
    return groups.offset_fetch_all(_positions(spark, d), "group-1")


@query(f'WITH {COMMITTED} SELECT group_id, topic, "partition", log_end_offset - "offset" AS lag FROM positions JOIN state USING (topic, "partition")')
def consumer_lag(spark: SparkSession, d: str) -> DataFrame:
    return groups.lag(_positions(spark, d), _state(spark, d))


@query(f'WITH {COMMITTED} SELECT s.topic, s."partition", coalesce(min("offset"), -1) AS floor FROM state s LEFT JOIN positions p USING (topic, "partition") GROUP BY ALL')
def consumer_floor(spark: SparkSession, d: str) -> DataFrame:
    return groups.floor(_positions(spark, d), _state(spark, d))


def _rendezvous_sql(agents: str) -> str:
    """FNV-1a of 64 bits over length, key, length, agent."""
    step = "CAST(xor(h, CAST(b AS HUGEINT)) AS HUGEINT) * 1099511628211 % 18446744073709551616"
    eight = "[0, 0, 0, 0, 0, 0, 0, length(x)]"
    chars = "list_transform(string_split(x, ''), lambda c: ascii(c))"
    return f"""b(x, l) AS (SELECT x, list_concat({eight.replace("length(x)", "length(x)")}, {chars}) FROM (SELECT "key" AS x FROM k UNION SELECT agent FROM a)), s AS (SELECT k."key", a.agent, list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], list_transform(list_concat(bk.l, ba.l), lambda v: CAST(v AS HUGEINT))), lambda h, b: {step}) AS score FROM k, a JOIN b ba ON ba.x = a.agent JOIN b bk ON TRUE WHERE bk.x = k."key")"""


RENDEZVOUS = f"""{_values("k", lit.KEYS)}, a AS (SELECT * FROM (VALUES ('agent-a'), ('agent-b'), ('agent-c'), ('agent-d')) AS v(agent)), {_rendezvous_sql("a")}"""
_FOUR = "SELECT * FROM VALUES ('agent-a'), ('agent-b'), ('agent-c'), ('agent-d') AS v(agent)"


@query(f'WITH {RENDEZVOUS} SELECT "key", arg_max(agent, score) AS owner FROM s GROUP BY ALL')
def rendezvous_owner(spark: SparkSession, d: str) -> DataFrame:
    return groups.rendezvous(_literal(spark, lit.KEYS), spark.sql(_FOUR))


@query(f"""WITH {RENDEZVOUS}, x AS (SELECT "key", arg_max(agent, score) AS "before", arg_max(agent, score) FILTER (agent <> 'agent-b') AS "after" FROM s GROUP BY ALL) SELECT * FROM x WHERE "before" <> "after" """)
def assignment_diff(spark: SparkSession, d: str) -> DataFrame:
    keys = _literal(spark, lit.KEYS)
    return groups.assignment_diff(groups.rendezvous(keys, spark.sql(_FOUR)), groups.rendezvous(keys, spark.sql(_FOUR).filter("agent <> 'agent-b'")))


MEMBERS = "('g1', 'm1', 'consumer'), ('g1', 'm2', 'consumer'), ('g2', NULL, 'consumer'), ('g3', NULL, NULL)"


@query(f"""SELECT group_id, count(member_id) AS members, max(protocol_type) AS protocol_type FROM (VALUES {MEMBERS}) AS t(group_id, member_id, protocol_type) GROUP BY ALL HAVING members > 0 OR coalesce(protocol_type, '') <> ''""")
def list_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.list_groups(spark.sql(f"SELECT * FROM VALUES {MEMBERS} AS t(group_id, member_id, protocol_type)"))


@query("""SELECT * FROM (VALUES ('g1', 'Stable', 2::BIGINT), ('g8', 'Dead', 0)) AS t(group_id, state, members)""")
def describe_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.describe_groups(spark.sql("SELECT * FROM VALUES ('g1'), ('g8') AS t(group_id)"), spark.sql("SELECT * FROM VALUES ('g1', 'Stable', 2L) AS t(group_id, state, members)"))


@query(None)
def group_fsm_replay(spark: SparkSession, d: str) -> DataFrame:
    return groups.replay(_literal(spark, lit.GROUP_EVENTS))


# ingest


@query(f"""WITH {STATE}, fresh AS (SELECT topic, "partition", "offset" AS o FROM log WHERE "offset" < 5) SELECT topic, "partition", log_end_offset + o AS "offset" FROM fresh JOIN state USING (topic, "partition")""")
def offset_assignment(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    arrivals = log.filter("offset < 5").select("topic", "partition", F.col("offset").alias("seq"))
    return ingest.assign_offsets(arrivals, view.partition_state(log), ["seq"], F.lit(0)).select("topic", "partition", "offset")


@query(f"""WITH {STATE} SELECT topic, "partition", log_end_offset + l."offset" AS "offset" FROM log l JOIN state USING (topic, "partition")""")
def offset_assignment_all(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    arrivals = log.select("topic", "partition", F.col("offset").alias("seq"))
    return ingest.assign_offsets(arrivals, view.partition_state(log), ["seq"], F.floor(F.col("seq") / 4096)).select("topic", "partition", "offset")


@query(None)
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    return ingest.idempotent_append(_literal(spark, lit.APPENDS))


@query("""SELECT CAST(conv_id % 8 AS INT) AS "partition", 'append' AS result, count(*) AS n, max(o) AS last_offset FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY turn, conv_id) - 1 AS o FROM conversations) GROUP BY ALL""")
def idempotent_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("turn") * 1_000_000_000 + F.col("conv_id")).alias("seq"), F.lit("conversations").alias("topic"), (F.col("conv_id") % 8).cast("int").alias("partition"), F.col("conv_id").alias("producer_id"), F.lit(0).alias("epoch"), F.col("turn").cast("int").alias("base_seq"), F.lit(1).alias("n"))
    return ingest.idempotent_append(c).groupBy("partition", "result").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


# access


DECIDED = f"""{_values("rules", lit.RULES)}, {_values("req", lit.ACCESS)}, dec AS (SELECT q.request_id, q.principal, q.operation, q.kind, q.name, NOT coalesce(bool_or(r.permission = 'Deny'), FALSE) AND coalesce(bool_or(r.permission = 'Allow'), FALSE) AS allowed FROM req q LEFT JOIN rules r ON r.kind = q.kind AND (r.name IS NULL OR r.name = q.name) AND (r.operation = q.operation OR r.operation = 'All') AND (r.principal = '*' OR lower(r.principal) = lower(q.principal)) GROUP BY ALL)"""


@query(f"WITH {DECIDED} SELECT * FROM dec")
def acl_decisions(spark: SparkSession, d: str) -> DataFrame:
    return authz.decisions(_literal(spark, lit.ACCESS), _literal(spark, lit.RULES))


@query(f"WITH {DECIDED} SELECT request_id, bool_and(allowed) AS allowed FROM dec GROUP BY ALL")
def acl_request_decisions(spark: SparkSession, d: str) -> DataFrame:
    return authz.request_decisions(authz.decisions(_literal(spark, lit.ACCESS), _literal(spark, lit.RULES)))


# series


STEP = """(SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS dv FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts) AS p FROM c))"""


@query(f"WITH {_values('c', lit.COUNTER)} SELECT series, CAST(sum(dv) AS BIGINT) AS increase, max(ts) - min(ts) AS seconds FROM {STEP} GROUP BY ALL")
def counter_increase(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.increase(_literal(spark, lit.COUNTER))


@query(f'WITH {_values("c", lit.COUNTER)} SELECT series, ts // 120 * 120 AS "window", CAST(sum(dv) AS DOUBLE) / 120 AS rate FROM {STEP} GROUP BY ALL')
def counter_rate(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.windowed_rate(_literal(spark, lit.COUNTER), 120)


BOUNDS = (60, 80, 100, 120, 140)
HIST = "h AS (SELECT topic, unnest([" + ", ".join(f"{{'le': {b}.0::DOUBLE, 'n': count(*) FILTER (size <= {b})}}" for b in BOUNDS) + ", {'le': 'inf'::DOUBLE, 'n': count(*)}]) AS r FROM log GROUP BY topic), b AS (SELECT topic, r.le AS le, r.n AS n, coalesce(lag(r.le) OVER w, 0.0) AS lo, coalesce(lag(r.n) OVER w, 0) AS below, max(r.n) OVER (PARTITION BY topic) * 0.95::DOUBLE AS rk FROM h WINDOW w AS (PARTITION BY topic ORDER BY r.le))"


@query(f"WITH {LOG}, {HIST} SELECT topic, round(arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rk - below) / greatest(n - below, 1) END, le), 6) AS value FROM b WHERE n >= rk GROUP BY ALL")
def hist_quantile(spark: SparkSession, d: str) -> DataFrame:
    h = timeseries.histogram(_log(spark, d), "size", list(BOUNDS), ["topic"])
    return timeseries.histogram_quantile(0.95, h, ["topic"]).withColumn("value", F.round("value", 6))


@query(f'WITH {_values("m", lit.MISSING)}, x AS (SELECT *, sum(CASE WHEN ts - p > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts) AS i FROM (SELECT *, lag(ts) OVER (PARTITION BY series ORDER BY ts) AS p FROM m)) SELECT series, min(ts) AS "first", max(ts) AS "last", count(*) AS n FROM x GROUP BY series, i')
def missing_step_runs(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.runs(_literal(spark, lit.MISSING), 120)


@query(f"WITH {_values('m', lit.MISSING)} SELECT 's' AS series, 100.0::DOUBLE * count(m.ts) / count(*) AS coverage FROM (SELECT unnest(range(0, 721, 60)) AS ts) e LEFT JOIN m USING (ts)")
def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.range(0, 721, 60).select(F.lit("s").alias("series"), F.col("id").alias("ts"))
    return timeseries.coverage(expected, _literal(spark, lit.MISSING), ["series", "ts"], ["series"])


@query(f"WITH {_values('s', lit.STEPS)}, x AS (SELECT *, lag(value IS NULL) OVER (PARTITION BY series ORDER BY ts) AS b FROM s) SELECT series, ts, CASE WHEN value IS NULL THEN 'gone' ELSE 'back' END AS flip FROM x WHERE b IS NOT NULL AND b <> (value IS NULL)")
def boundary_flips(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.flips(_literal(spark, lit.STEPS))


@query(f"WITH {_values('s', lit.ALERT)}, x AS (SELECT *, sum(CASE WHEN value > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS i FROM s) SELECT series, min(ts) AS from_ts, max(ts) AS to_ts FROM x WHERE value > 0 GROUP BY series, i HAVING max(ts) - min(ts) >= 120")
def alert_for_duration(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.alerts(_literal(spark, lit.ALERT), F.col("value") > 0, 120)


@query("SELECT s AS series, 400::BIGINT AS n, 400 * s * 100 + 400 * 399 // 2 AS total, TRUE AS intact FROM range(60) AS t(s)")
def integrity_closed_form(spark: SparkSession, d: str) -> DataFrame:
    samples = spark.range(60 * 400).select(F.expr("id div 400").alias("series"), F.expr("id div 400 * 100 + id % 400").alias("value"))
    return timeseries.integrity(samples, F.lit(400))


@query(f'WITH {LOG} SELECT topic, CAST(max("offset") AS BIGINT) AS value, CAST(floor(epoch(max("timestamp"))) AS BIGINT) AS ts FROM log WHERE "partition" = 0 GROUP BY ALL')
def latest_sample(spark: SparkSession, d: str) -> DataFrame:
    s = _log(spark, d).filter("partition = 0").select("topic", view.seconds("timestamp").alias("ts"), F.col("offset").alias("value"))
    return timeseries.latest(s, ["topic"])


@query(f'WITH {LOG} SELECT topic, "partition", CAST(max("offset") AS BIGINT) AS value, CAST(floor(epoch(max("timestamp"))) AS BIGINT) AS ts FROM log GROUP BY ALL')
def latest_sample_all(spark: SparkSession, d: str) -> DataFrame:
    s = _log(spark, d).select("topic", "partition", view.seconds("timestamp").alias("ts"), F.col("offset").alias("value"))
    return timeseries.latest(s, ["topic", "partition"])


# scalars


@query(f"WITH {_values('s', lit.SIZES)} SELECT input, expected AS bytes FROM s")
def parse_byte_size(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, lit.SIZES).select("input", scalar.parse_byte_size(F.col("input")).alias("bytes"))


@query(f"WITH {_values('s', lit.DURATIONS)} SELECT input, expected AS millis FROM s")
def parse_duration(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, lit.DURATIONS).select("input", scalar.parse_duration(F.col("input")).alias("millis"))


@query(f"WITH {_values('s', lit.NAMES)} SELECT name, base, epoch, CASE WHEN base IS NOT NULL THEN lpad(base::VARCHAR, 20, '0') || CASE WHEN epoch > 0 THEN '-e' || epoch ELSE '' END || '.log' END AS again FROM s")
def segment_name_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = _literal(spark, lit.NAMES).select("name", scalar.segment_base(F.col("name")).alias("base"), scalar.segment_epoch(F.col("name")).alias("epoch"))
    return n.withColumn("again", scalar.segment_name(F.col("base"), F.col("epoch")))


@query(f"""WITH {_values("k", lit.OFFSET_KEYS)}, x AS (SELECT "key", string_split("key", '/') AS p FROM k) SELECT "key", CASE WHEN ok THEN array_to_string(p[1:len(p) - 2], '/') END AS group_id, CASE WHEN ok THEN p[len(p) - 1] END AS topic, CASE WHEN ok THEN CAST(p[len(p)] AS INT) END AS "partition" FROM (SELECT *, len(p) >= 3 AND regexp_full_match(p[len(p)], '[0-9]+') AS ok FROM x)""")
def offset_key_parse(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, lit.OFFSET_KEYS).withColumn("k", scalar.offset_key(F.col("key"))).select("key", "k.*")


@query("""WITH RECURSIVE a AS (SELECT * FROM (VALUES ('abc'), ('agent-a'), ('x')) AS v(agent)), f AS (SELECT agent, list_reduce(list_concat([2166136261::HUGEINT], list_transform(string_split(agent, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296) AS h FROM a) SELECT agent, CAST(h AS BIGINT) & 2147483647 AS node_id, CAST(h % 4 AS INT) AS shard FROM f""")
def derived_node_id(spark: SparkSession, d: str) -> DataFrame:
    a = spark.sql("SELECT * FROM VALUES ('abc'), ('agent-a'), ('x') AS v(agent)")
    return a.select("agent", scalar.node_id(F.col("agent")).alias("node_id"), scalar.acl_shard(F.col("agent")).alias("shard"))


@query("SELECT '01ARZ3NDEKTSV4RRFFQ69G5FAV' AS ulid, 1469922850259::BIGINT AS millis")
def ulid_time(spark: SparkSession, d: str) -> DataFrame:
    u = spark.sql("SELECT '01ARZ3NDEKTSV4RRFFQ69G5FAV' AS ulid")
    return u.select("ulid", scalar.ulid_millis(F.col("ulid")).alias("millis"))


# more of the index, the store and series


@query(f'WITH {LOG} SELECT topic, "partition", "offset" // 64 * 64 AS base, min("timestamp") AS first_ts, max("timestamp") AS last_ts, count(*) AS records FROM log GROUP BY ALL')
def segment_time_range(spark: SparkSession, d: str) -> DataFrame:
    return segments.time_ranges(_log(spark, d))


BLOCKS = f"""{LOG}, blk AS (SELECT topic, "partition", "offset" // 16 AS b, CAST(floor(epoch(min("timestamp"))) AS BIGINT) AS min_time, CAST(floor(epoch(max("timestamp"))) AS BIGINT) AS max_time FROM log GROUP BY ALL)"""


@query(f'WITH {BLOCKS}, x AS (SELECT *, lead(min_time) OVER w AS nx, max(max_time) OVER (w ROWS UNBOUNDED PRECEDING) AS reach FROM blk WINDOW w AS (PARTITION BY topic, "partition" ORDER BY min_time, max_time)) SELECT topic, "partition", reach AS gap_from, nx AS gap_to FROM x WHERE nx - reach > 60')
def block_coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    b = segments.time_ranges(_log(spark, d), 16).select("topic", "partition", view.seconds("first_ts").alias("min_time"), view.seconds("last_ts").alias("max_time"))
    return segments.coverage_gaps(b, 60)


@query(f"""WITH RECURSIVE {LOG}, r AS (SELECT topic, "partition", "offset", "offset" AS base, size AS used FROM log WHERE "offset" = 0 UNION ALL SELECT l.topic, l."partition", l."offset", CASE WHEN r.used > 1500 THEN l."offset" ELSE r.base END, CASE WHEN r.used > 1500 THEN 0 ELSE r.used END + l.size FROM r JOIN log l ON l.topic = r.topic AND l."partition" = r."partition" AND l."offset" = r."offset" + 1 WHERE l.topic = 'click') SELECT topic, "partition", "offset", base FROM r WHERE topic = 'click'""")
def segment_rolls(spark: SparkSession, d: str) -> DataFrame:
    return segments.rolls(_log(spark, d).filter("topic = 'click'"), 1500)


@query(None)
def segment_rolls_all(spark: SparkSession, d: str) -> DataFrame:
    return segments.rolls(_log(spark, d), 1500)


@query(f'WITH {STORE}, q AS (SELECT * FROM store WHERE base // 64 % 2 = 0) SELECT * FROM q SEMI JOIN live USING (topic, "partition", base, epoch)')
def quarantine_conflicts(spark: SparkSession, d: str) -> DataFrame:
    stored, index = _store(spark, d)
    return maintenance.quarantine_conflicts(stored.filter("(base div 64) % 2 = 0"), index)


@query(f"WITH {_values('a', lit.AGENTS)} SELECT agent, updated_at + 60 > 150 AND expires_at > 150 AS ready FROM a")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.readiness(_literal(spark, lit.AGENTS), 150, 60)


@query(None)
def ownership_claims(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.replay_claims(_literal(spark, lit.CLAIMS), 60)


@query(f"""WITH {COMMITTED} SELECT group_id, topic, "partition", coalesce(n."offset", c."offset") AS "offset" FROM (SELECT * FROM commits WHERE commit_seq = 1) c FULL JOIN (SELECT * FROM positions WHERE group_id <> 'group-1') n USING (group_id, topic, "partition")""")
def positions_merged(spark: SparkSession, d: str) -> DataFrame:
    commits = view.committed(_log(spark, d))
    return groups.merge_positions(commits.filter("commit_seq = 1"), groups.latest_commits(commits).filter("group_id <> 'group-1'"))


@query("SELECT conv_id AS producer_id, turn AS base_seq FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def producer_recent_batches(spark: SparkSession, d: str) -> DataFrame:
    return ingest.recent_batches(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("producer_id"), F.col("turn").alias("base_seq")))


@query(f'WITH {LOG} SELECT topic, count(DISTINCT "partition") AS partitions, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM log GROUP BY ALL')
def topic_totals(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("topic").agg(F.count_distinct("partition").alias("partitions"), F.count("*").alias("records"), F.sum("size").alias("bytes"))


@query(f'WITH {STATE} SELECT topic, "partition", log_end_offset - log_start_offset = (SELECT count(*) FROM log l WHERE l.topic = s.topic AND l."partition" = s."partition") AS complete FROM state s')
def log_walk(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    n = log.groupBy("topic", "partition").agg(F.count("*").alias("_n"))
    return view.partition_state(log).join(n, view.PART).select("topic", "partition", (F.col("log_end_offset") - F.col("log_start_offset") == F.col("_n")).alias("complete"))


@query("SELECT * FROM (VALUES ('c', 190.0::DOUBLE / 4), ('d', 3.0::DOUBLE / 1e-9)) AS t(series, mean)")
def counter_mean(spark: SparkSession, d: str) -> DataFrame:
    counts = view.values(spark, "('c',0,0),('c',60,4),('d',0,7),('d',60,7)", "series string, ts long, value long")
    return timeseries.mean_from_counters(_literal(spark, lit.COUNTER), counts)


@query("SELECT 'disk' AS series, 0.75::DOUBLE AS used")
def used_share(spark: SparkSession, d: str) -> DataFrame:
    rows = "series string, ts long, value long"
    return timeseries.used_share(view.values(spark, "('disk',0,900),('disk',60,250)", rows), view.values(spark, "('disk',0,1000),('disk',60,1000)", rows))


@query(f"WITH {_values('c', lit.COUNTER)}, g AS (SELECT unnest(range(0, 301, 60)) AS step) SELECT series, step, count(value) AS count, CAST(sum(value) AS BIGINT) AS sum FROM c JOIN g ON ts > step - 120 AND ts <= step GROUP BY ALL")
def over_steps(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.over_steps(_literal(spark, lit.COUNTER), 0, 300, 60, 120)
