"""Counters, histograms, runs and alerts over samples (series, ts in seconds, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def increase(samples: DataFrame, by: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """Sum of rises of each counter; a fall is a reset, after which the new value counts whole."""
    prev = F.lag("value").over(W.partitionBy(*by).orderBy("ts"))
    step = F.when(prev.isNull(), 0).when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev)
    return samples.withColumn("_d", step).groupBy(*by).agg(F.sum("_d").alias("increase"), (F.max("ts") - F.min("ts")).alias("seconds"))


def windowed_rate(samples: DataFrame, width: int, by: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """Rate a second in each window of ``width`` seconds; a rise belongs to the window of its later sample."""
    prev = F.lag("value").over(W.partitionBy(*by).orderBy("ts"))
    step = F.when(prev.isNull(), 0).when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev)
    start = (F.floor(F.col("ts") / width) * width).cast("long")
    return samples.withColumns({"_d": step, "window": start}).groupBy(*by, "window").agg((F.sum("_d") / width).alias("rate"))


def histogram(values: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative counts by upper bound (the last one is infinite), long form: le, count."""
    counts = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{k}") for k, b in enumerate(bounds)]
    wide = values.groupBy(*by).agg(*counts, F.count(value).alias("b_all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("count")))
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.le", "r.count")


def histogram_quantile(q: float, buckets: DataFrame, by: list[str]) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds it; the last finite bound above them."""
    w = W.partitionBy(*by).orderBy("le")
    b = buckets.withColumns({"_lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "_below": F.coalesce(F.lag("count").over(w), F.lit(0)), "_rank": F.max("count").over(W.partitionBy(*by)) * q})
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (F.col("_rank") - F.col("_below")) / F.greatest(F.col("count") - F.col("_below"), F.lit(1))
    value = F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(inside)
    return b.filter("count >= _rank").groupBy(*by).agg(F.min_by(value, "le").alias("value"))


def latest(samples: DataFrame, by: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """Last sample of each series (of equal times the greatest value)."""
    return samples.groupBy(*by).agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


def runs(points: DataFrame, gap: Column | int, by: list[str] = ["series"], at: str = "ts") -> DataFrame:  # noqa: B006
    """Islands of points no further apart than the gap: first, last and number."""
    w = W.partitionBy(*by).orderBy(at)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    island = F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return points.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_i")


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Steps of one side that the other lacks."""
    return expected.join(present, on, "left_anti")


def coverage(expected: DataFrame, present: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Per cent of expected steps that are present."""
    j = expected.join(present.select(*on).distinct().withColumn("_p", F.lit(1)), on, "left")
    return j.groupBy(*by).agg((F.lit(100.0) * F.count("_p") / F.count("*")).alias("coverage"))


def flips(steps: DataFrame, by: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """Steps at which a value appears or goes."""
    w = W.partitionBy(*by).orderBy("ts")
    now = F.col("value").isNull()
    before = F.lag(now).over(w)
    return steps.withColumn("_b", before).filter(F.col("_b").isNotNull() & (F.col("_b") != now)).select(*by, "ts", F.when(now, "gone").otherwise("back").alias("flip"))


def alerts(samples: DataFrame, condition: Column, seconds: int, by: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """Stretches of samples that all meet a condition for the given time or longer: from, to."""
    w = W.partitionBy(*by).orderBy("ts")
    bad = F.coalesce(condition, F.lit(False))
    # a run's number is how many samples before it did not meet the condition
    s = samples.withColumn("_bad", bad).withColumn("_i", F.sum((~F.col("_bad")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.filter("_bad").groupBy(*by, "_i").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts")).filter(F.col("to_ts") - F.col("from_ts") >= seconds).drop("_i")


def integrity(samples: DataFrame, points: Column) -> DataFrame:
    """Series whose count or sum is not that of values series * 100 + 0, 1, 2, ..."""
    got = samples.groupBy("series").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    want = points * F.col("series") * 100 + points * (points - 1) / 2
    return got.select("series", "n", "total", ((F.col("n") == points) & (F.col("total") == want)).alias("intact"))


def mean_from_counters(sums: DataFrame, counts: DataFrame, by: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """Rise of the sum over rise of the count (kept from 0)."""
    s = increase(sums, by).select(*by, F.col("increase").alias("_s"))
    n = increase(counts, by).select(*by, F.col("increase").alias("_n"))
    return s.join(n, by).select(*by, (F.col("_s") / F.greatest(F.col("_n").cast("double"), F.lit(1e-9))).alias("mean"))


def used_share(available: DataFrame, size: DataFrame, by: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """1 - available / size at each series' last samples."""
    a, t = latest(available, by).select(*by, F.col("value").alias("_a")), latest(size, by).select(*by, F.col("value").alias("_t"))
    return a.join(t, by).select(*by, (1 - F.col("_a") / F.col("_t")).alias("used"))


def over_steps(samples: DataFrame, start: int, stop: int, step: int, lookback: int, by: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """Count and sum of the samples in the lookback before each step: a sample goes to the steps it can count for (a
    fixed number of them), so steps and samples are never paired."""
    first = F.greatest(F.ceil((F.col("ts") - start) / step), F.lit(0))
    last = F.least(F.floor((F.col("ts") + lookback - 1 - start) / step), F.lit((stop - start) // step))
    to = samples.filter(F.col("ts") > start - lookback).filter(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    return to.groupBy(*by, (F.col("_k") * step + start).cast("long").alias("step")).agg(F.count("value").alias("count"), F.sum("value").alias("sum"))
