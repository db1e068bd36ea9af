"""Segment decoder, streaming jobs and layout."""

import pytest

from logspark.operators import scan
from logspark.plans import literals as lit
from logspark.sources import log_view as view
from logspark.sources import segment_decoder as sd
from logspark.streaming import ingest


def rows(n, start=1000):
    return [(start + 7 * k, None if k % 3 == 0 else f"k{k}".encode(), None if k % 5 == 4 else b"v" * k) for k in range(n)]


@pytest.mark.parametrize("codec", [sd.NONE, sd.GZIP, sd.SNAPPY, sd.LZ4])
@pytest.mark.parametrize("wrapped", [False, True])
def test_batches_round_trip(codec, wrapped):
    for n in (1, 3, 5, 100, 1000):
        data = sd.encode_batch(42, rows(n), codec, (9, 1, 5), wrapped) + sd.encode_batch(42 + n, rows(2))
        got = list(sd.records(data))
        assert [r["offset"] for r in got] == [*range(42, 42 + n + 2)]
        assert [(r["timestamp"], r["key"], r["value"]) for r in got[:n]] == rows(n)
        b = next(sd.batches(data))
        assert (b.base_offset, b.records_count, b.codec, b.producer_id, b.base_sequence, b.crc) == (42, n, codec, 9, 5, 1)
        assert (b.first_ts, b.max_ts) == (1000, 1000 + 7 * (n - 1))


def test_older_messages():
    plain = b"".join(sd.encode_message(k, 5, b"k", b"v") for k in range(3))
    assert sum(b.records_count for b in sd.batches(plain)) == 3
    assert sum(b.records_count for b in sd.batches(b"")) == 0
    assert list(sd.records(sd.encode_message(4, None, None, b"x")))[0]["timestamp"] is None
    for codec in (sd.GZIP, sd.SNAPPY, sd.LZ4):
        wrapper = sd.encode_message(12, 5, None, sd.compress(codec, plain), codec)
        assert [b.records_count for b in sd.batches(wrapper)] == [3]
        assert [r["offset"] for r in sd.records(wrapper)] == [10, 11, 12]
    mixed = sd.encode_message(0, 1, None, b"a") + sd.encode_batch(1, rows(3))
    assert sum(b.records_count for b in sd.batches(mixed)) == 4
    with pytest.raises(ValueError):
        sd.decompress(7, b"")


def test_torn_tail_and_files(spark, tmp_path):
    d = tmp_path / "t" / "0"
    d.mkdir(parents=True)
    (d / "00000000000000000000.log").write_bytes(sd.encode_batch(0, rows(4), sd.LZ4))
    (d / "00000000000000000004-e2.log").write_bytes(sd.encode_batch(4, rows(3)) + sd.encode_batch(7, rows(3))[:-5])
    (d / "active.txt").write_bytes(b"x")
    got = sd.read_records(spark, str(tmp_path))
    assert sorted(r.offset for r in got.collect()) == [*range(7)]
    assert sd.read_batches(spark, str(tmp_path)).filter("crc_ok").count() == 2
    with pytest.raises(Exception, match="Torn"):
        sd.read_records(spark, str(tmp_path), torn="fail").collect()
    assert sorted((r.topic, r.partition, r.base, r.epoch) for r in sd.read_objects(spark, str(tmp_path)).collect()) == [("t", 0, 0, 0), ("t", 0, 4, 2)]


def run_stream(spark, df, make, tmp_path, name):
    parts = df.orderBy("seq").collect()
    src = str(tmp_path / f"{name}-in")
    for k in (0, 1):  # two arrivals: state carries over
        half = parts[: len(parts) // 2] if k == 0 else parts[len(parts) // 2 :]
        spark.createDataFrame(half, df.schema).coalesce(1).write.mode("append").parquet(src)
        q = make(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_stream_equals_batch(spark, tmp_path):
    from logspark.operators import groups
    from logspark.operators.ingest import idempotent_append

    a = view.values(spark, *lit.APPENDS)
    got = run_stream(spark, a, ingest.idempotent_appends, tmp_path, "a")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, idempotent_append(a).collect()))
    g = view.values(spark, *lit.GROUP_EVENTS)
    got = run_stream(spark, g, ingest.group_sessions, tmp_path, "g")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, groups.replay(g).collect()))


def test_layout_prunes(spark, data, tmp_path):
    log = view.log_records(spark, data)
    ingest.compact(log, str(tmp_path / "log"), 16)
    t = spark.read.parquet(str(tmp_path / "log"))
    assert t.count() == log.count()
    one = scan.point_read(t, "click", 1, 7)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "EqualTo(offset,7)" in plan
    assert one.count() == 1


def test_offsets_are_dense(spark, data):
    bad = view.partition_state(view.log_records(spark, data)).join(view.log_records(spark, data).groupBy("topic", "partition").count(), view.PART).filter("log_end_offset <> count or log_start_offset <> 0")
    assert bad.count() == 0
