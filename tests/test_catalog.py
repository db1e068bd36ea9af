"""Every SQL-expressible query against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from logspark.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [k for k, q in QUERIES.items() if q.oracle])
def test_equals_sql(spark, data, con, name):
    df = QUERIES[name].run(spark, data)
    cols = sorted(df.columns)
    got = sorted(str([_plain(r[c]) for c in cols]) for r in df.collect())
    r = con.execute(QUERIES[name].oracle)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(str([_plain(x[names.index(c)]) for c in cols]) for x in r.fetchall())
    assert got == want


def test_idempotent_append_fixture(spark, data):
    got = {r.seq: (r.result, r.offset) for r in QUERIES["idempotent_append"].run(spark, data).collect() if r.partition == 0}
    assert got == {1: ("append", 0), 2: ("duplicate", 0), 3: ("unknown producer", -1), 4: ("out of order", -1), 5: ("append", 3), 6: ("fenced", -1)}


def test_duplicates_outside_the_window():
    import pandas as pd

    from logspark.operators.ingest import fold

    rows = [(k, 1, 0, k, 1) for k in range(8)] + [(8, 1, 0, 1, 1), (9, 1, 0, 6, 1)]
    out, end = fold(pd.DataFrame(rows, columns=["seq", "producer_id", "epoch", "base_seq", "n"]))
    assert out["result"].tolist()[8:] == ["duplicate outside window", "duplicate"]
    assert end == 8 and out["offset"].tolist()[9] == 6


def test_group_replay(spark, data):
    rows = {r.seq: r for r in QUERIES["group_fsm_replay"].run(spark, data).collect()}
    assert (rows[1].generation, rows[1].leader) == (1, "A")
    assert rows[2].generation == 1 and rows[3].state == "Stable"
    assert (rows[5].generation, rows[5].leader) == (2, "B")  # A is gone after its session and a second
    assert rows[6].result == "unknown member"
    assert rows[7].state == "Empty" and rows[7].leader == ""
    assert rows[9].result == "rebalance in progress" and rows[10].state == "Empty"


def test_frontier_fixture(spark, data):
    got = {r.topic: r.frontier for r in QUERIES["durable_frontier"].run(spark, data).collect()}
    assert got == {"gap": 200, "stale": 130, "real": 43, "chain": 30}


def test_rendezvous_invariants(spark):
    from logspark.operators import groups

    keys = spark.range(500).selectExpr("format_string('group-%03d', id) AS key")
    agents = spark.createDataFrame([(f"agent-{c}",) for c in "abcde"], "agent string")
    before = groups.rendezvous(keys, agents)
    after = groups.rendezvous(keys, agents.filter("agent <> 'agent-b'"))
    counts = {r.owner: r["count"] for r in before.groupBy("owner").count().collect()}
    assert len(counts) == 5 and all(50 <= n <= 200 for n in counts.values())
    assert {r.before for r in groups.assignment_diff(before, after).collect()} == {"agent-b"}


def test_retention_fixtures(spark):
    from logspark.operators import maintenance as m

    def table(rows):
        return spark.createDataFrame([("t", 0, b, 1, s, t) for b, s, t in rows], "topic string, partition int, base long, epoch long, size long, modified long")

    def boundary(df):
        return [r.boundary for r in df.collect()]

    assert boundary(m.time_boundary(table([(300, 10, 100), (100, 10, 10), (200, 10, 20)]), 50)) == [200]
    assert boundary(m.time_boundary(table([(100, 10, 10), (200, 10, 0), (300, 10, 20)]), 50)) == [100]
    assert boundary(m.bytes_boundary(table([(0, 100, 1), (100, 100, 1), (200, 100, 1), (300, 100, 1)]), 250)) == [200]
    assert boundary(m.bytes_boundary(table([(100, 0, 1), (200, 0, 1), (300, 1000, 1), (400, 1000, 1)]), 1 << 30)) == [300]
    assert boundary(m.bytes_boundary(table([(0, 1000, 1), (100, 1000, 1)]), 1 << 30)) == []
    winners = table([(0, 1000, 1), (100, 1000, 1), (200, 1000, 1)])
    floor = lambda f: spark.createDataFrame([("t", 0, f)], "topic string, partition int, floor long")
    plan = lambda f: sorted(r.base for r in m.retention_plan(winners, [m.bytes_boundary(winners, 1)], floor(f)).collect())
    assert plan(50) == [] and plan(250) == [0, 100]
    assert m.retention_plan(winners, [], floor(250)).count() == 0


def test_compaction_pick_fixture(spark):
    from logspark.operators import maintenance as m

    rows = [("t", 0, k * 10, 1, s, 1, 0) for k, s in enumerate((60, 30, 30, 50, 30, 20))]
    df = spark.createDataFrame(rows, "topic string, partition int, base long, epoch long, size long, modified long, bucket long")
    assert sorted(r.base for r in m.compaction_pick(df, 100).collect()) == [10, 20, 40]


def test_no_rules_allow_all(spark):
    from logspark.operators import authz

    asked = spark.createDataFrame([(1, "x", "Read", "Topic", "t")], "request_id int, principal string, operation string, kind string, name string")
    rules = spark.createDataFrame([], "principal string, operation string, kind string, name string, permission string")
    assert authz.decisions(asked, rules).first().allowed


def test_ownership_claims(spark, data):
    got = {r.seq: (r.result, r.epoch) for r in QUERIES["ownership_claims"].run(spark, data).collect()}
    assert got == {1: ("claimed", 1), 2: ("refused", 1), 3: ("renewed", 1), 4: ("refused", 1), 5: ("claimed", 2), 6: ("refused", 2), 7: ("claimed", 1)}


def test_producer_ids_are_given_once(spark, tmp_path):
    from logspark.operators.ingest import allocate_producer_ids

    at = str(tmp_path / "ids")
    assert allocate_producer_ids(at, 3, spark) + allocate_producer_ids(at, 2, spark) == [0, 1, 2, 3, 4]


def test_floor_lookup_of_every_offset(spark, data):
    got = QUERIES["segment_floor_lookup_all"].run(spark, data)
    assert got.count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_rolls_of_every_topic(spark, data):
    from logspark.sources.log_view import log_records

    want, last, base, used = set(), None, 0, 0
    for r in sorted(log_records(spark, data).select("topic", "partition", "offset", "size").collect()):
        if (r.topic, r.partition) != last or used > 1500:
            last, base, used = (r.topic, r.partition), r.offset, 0
        used += r.size
        want.add((r.topic, r.partition, r.offset, base))
    got = [(r.topic, r.partition, r.offset, r.base) for r in QUERIES["segment_rolls_all"].run(spark, data).collect()]
    assert len(got) == len(want) and set(got) == want and len({t for t, *_ in got}) > 1


def test_whole_log_is_read(spark, data):
    parts = {(r.topic, r.partition) for r in QUERIES["log_walk"].run(spark, data).collect()}
    assert {(r.topic, r.partition) for r in QUERIES["latest_sample_all"].run(spark, data).collect()} == parts
    assert QUERIES["offset_assignment_all"].run(spark, data).count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_sizes_and_durations_of_every_form(spark):
    """Values worked out by hand: long fractions, signs, large units, overflow; several terms, upper case, microseconds."""
    from pyspark.sql import functions as F

    from logspark.functions import scalar

    sizes = {"1.23456K": 1234, "2P": 2 * 10**15, "1PiB": 2**50, "+5": 5, "-5b": -5, "-5K": None, "9999999999G": None, "9223372036854775808": None, "-1.5": -1, "1.": None}
    spans = {"1h30m": 5_400_000, "7D": 604_800_000, "10us": 0, "1500us": 2, "+5": 5, "1d12h": None, ".5s": 500, "99999999999w": None, "99999999999999999999": None}
    for values, f in ((sizes, scalar.parse_byte_size), (spans, scalar.parse_duration)):
        rows = spark.createDataFrame([(x,) for x in values], "t string").select("t", f(F.col("t")).alias("v")).collect()
        assert {r.t: r.v for r in rows} == values


def test_retry_is_known_by_its_first_sequence():
    from logspark.operators.ingest import Producer

    p = Producer()
    p.note(0, 0, 3, 100)
    assert p.check(0, 0, 2) == ("duplicate", 100)


def test_budgets_that_are_not_positive_stand_for_the_default(spark):
    from logspark.operators import scan

    log = spark.createDataFrame([("t", 0, k, "k", "v", 100) for k in range(20)], "topic string, partition int, offset long, key string, value string, size int")
    state = spark.createDataFrame([("t", 0, 0, 20)], "topic string, partition int, log_start_offset long, high_watermark long")
    asked = [(1, 1, "t", 0, 0, 0, 0), (2, 1, "t", 0, 0, -1, 550), (3, 1, "t", 0, 0, 250, -1), (4, 1, "t", 0, 0, None, None)]
    requests = spark.createDataFrame(asked, "request_id int, ord int, topic string, partition int, fetch_offset long, partition_max_bytes int, max_bytes int")
    got = {r.request_id: r["count"] for r in scan.fetch(log, state, requests).groupBy("request_id").count().collect()}
    assert got == {1: 20, 2: 5, 3: 2, 4: 20}
