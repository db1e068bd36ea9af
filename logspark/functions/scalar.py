"""Scalar functions over columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Units of byte sizes and of durations (milliseconds; nanoseconds).
BYTES = {"": 1, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "P": 10**15, "KI": 2**10, "MI": 2**20, "GI": 2**30, "TI": 2**40, "PI": 2**50}
NANOS = {"ns": 1, "us": 1000, "\u00b5s": 1000, "\u03bcs": 1000, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86_400 * 10**9, "w": 604_800 * 10**9}
FNV32, FNV32_PRIME = 2166136261, 16777619
FNV64, FNV64_PRIME = 14695981039346656037, 1099511628211
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _map(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for kv in table.items() for x in kv])


def parse_byte_size(text: Column) -> Column:
    """Bytes of 30G, 1.5GiB, -1, +5b; decimals count to the third, a minus sign only without a unit; else null, also for
    what 64 bits can't hold."""
    m = lambda k: F.regexp_extract(text, r"^\s*([+-]?)(\d+)(?:\.(\d+))?(?i:(k|m|g|t|p|ki|mi|gi|ti|pi)?b?)\s*$", k)
    scaled = F.element_at(_map(BYTES), F.upper(m(4)))
    part = F.call_function("div", F.rpad(F.left(m(3), F.lit(3)), 3, "0").try_cast("long") * scaled, F.lit(1000))
    size = F.try_add(F.try_multiply(m(2).try_cast("long"), scaled), part)
    return F.when((m(1) == "-") & (scaled == 1), -size).when((m(1) != "-") & (m(2) != ""), size).cast("long")


def parse_duration(text: Column) -> Column:
    """Milliseconds (rounded) of 7d, 1.5w, or of 90m, 1h30m, 500ms, 10us; a bare number counts as milliseconds; letters
    in either case; else null, also for more nanoseconds than 64 bits hold."""
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    term = r"(\d+\.?\d*|\.\d+)(ns|us|\u00b5s|\u03bcs|ms|s|m|h)"
    days = r"^(\d+\.?\d*|\.\d+)([dw])$"
    of = lambda pattern: F.zip_with(F.regexp_extract_all(t, F.lit(pattern), 1), F.regexp_extract_all(t, F.lit(pattern), 2), lambda n, u: n.try_cast("double") * F.element_at(_map(NANOS), u))
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    nanos = F.when(t.rlike(days), total(of(days))).when(t.rlike(f"^(?:{term})+$"), total(of(term)))
    bare = t.try_cast("long")
    return F.when(t.rlike(r"^\+?\d+$"), F.when(bare <= (2**63 - 1) // 10**6, bare)).when(nanos < float(2**63), F.round(nanos / 1e6).cast("long"))


def segment_name(base: Column, epoch: Column) -> Column:
    """Twenty digits, -e and the epoch if above 0, .log."""
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.when(epoch > 0, F.concat(F.lit("-e"), epoch.cast("string"))).otherwise(F.lit("")), F.lit(".log"))


def segment_base(name: Column) -> Column:
    """Base of a segment name, null if it is none."""
    return F.regexp_extract(name, r"^(\d+)(?:-e\d+)?\.log$", 1).try_cast("long")


def segment_epoch(name: Column) -> Column:
    """Epoch of a segment name (0 without one), null if it is none."""
    return F.when(segment_base(name).isNotNull(), F.coalesce(F.regexp_extract(name, r"-e(\d+)\.log$", 1).try_cast("long"), F.lit(0)))


def bucket_key(first: Column, last: Column) -> Column:
    """Key of a bucket object."""
    return F.concat(F.lpad(first.cast("string"), 20, "0"), F.lit("-"), F.lpad(last.cast("string"), 20, "0"), F.lit(".idx"))


def partition_key(topic: Column, partition: Column) -> Column:
    return F.concat_ws("/", topic, partition.cast("string"))


def offset_key(key: Column) -> Column:
    """group, topic, partition of a position's key: the last two parts are topic and partition, the group may hold /."""
    p = F.split(key, "/")
    n = F.size(p)
    return F.when((n >= 3) & F.element_at(p, -1).rlike(r"^\d+$"), F.struct(F.array_join(F.slice(p, 1, F.greatest(n - 2, F.lit(1))), "/").alias("group_id"), F.get(p, n - 2).alias("topic"), F.element_at(p, -1).try_cast("int").alias("partition")))


def manifest_key(key: Column) -> Column:
    """topic, partition of a manifest's key: topic/_manifest/partition."""
    p = F.split(key, "/")
    return F.when((F.size(p) == 3) & (F.get(p, F.lit(1)) == "_manifest"), F.struct(F.get(p, F.lit(0)).alias("topic"), F.get(p, F.lit(2)).try_cast("int").alias("partition")))


def agent_namespace(name: Column, hostname: Column) -> Column:
    """Name as a path part; the host's name if blank."""
    return F.replace(F.coalesce(F.nullif(F.trim(name), F.lit("")), hostname), F.lit("/"), F.lit("_"))


def _bytes(text: Column) -> Column:
    h = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))


def fnv32(text: Column) -> Column:
    """FNV-1a of 32 bits, inside 64-bit integers: a step's product stays below 2**57."""
    fold = F.aggregate(_bytes(text), F.lit(FNV32).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * FNV32_PRIME, F.lit(2**32)))
    return F.when(F.length(text) == 0, F.lit(FNV32).cast("long")).otherwise(fold)


def node_id(agent: Column) -> Column:
    """A positive node number derived from an agent's name."""
    return fnv32(agent).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long")


def acl_shard(principal: Column, shards: int = 4) -> Column:
    return F.pmod(fnv32(F.lower(principal)), F.lit(shards)).cast("int")


def fnv64_bytes(data: bytes) -> int:
    """FNV-1a of 64 bits, unsigned."""
    h = FNV64
    for b in data:
        h = (h ^ b) * FNV64_PRIME % 2**64
    return h


def score_bytes(key: str, agent: str) -> int:
    """Rendezvous score: both names with their lengths (eight bytes, big endian) before them."""
    parts = [s.encode() for s in (key, agent)]
    return fnv64_bytes(b"".join(len(p).to_bytes(8, "big") + p for p in parts))


@F.pandas_udf(IntegerType())
def rendezvous_score(key: pd.Series, agents: pd.Series) -> pd.Series:
    """Index of the best agent; the first of equal ones.  Unsigned 64-bit products overflow SQL's integers."""
    return pd.Series([max(range(len(a)), key=lambda i: (score_bytes(k, a[i]), -i), default=-1) for k, a in zip(key, agents, strict=True)])


def ulid_millis(ulid: Column) -> Column:
    """Milliseconds in the first ten characters."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for i, c in enumerate(CROCKFORD) for x in (c, i)])
    return F.aggregate(F.split(F.upper(F.left(ulid, F.lit(10))), ""), F.lit(0).cast("long"), lambda s, c: s * 32 + F.element_at(table, c))
