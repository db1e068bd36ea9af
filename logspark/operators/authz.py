"""Access decisions over rules (principal, operation, kind, name, permission)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The operation that each API needs.
OPERATION = {"Produce": "Write", "Fetch": "Read", "Metadata": "Describe", "CreateTopics": "Create", "DeleteTopics": "Delete"}


def decisions(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """allowed of each (principal, operation, kind, name): without rules all, else no match denies and one yes allows.

    A rule for a name matches by equality and one without a name by kind, so the theta match becomes one equi-join on
    kind, name and principal after each request lists the few forms a rule can have."""
    forms = F.explode(F.expr("flatten(transform(array('', name), n -> transform(array('*', lower(principal)), p -> struct(n as rn, p as rp))))"))
    asked = requests.withColumn("_id", F.struct("principal", "operation", "kind", "name"))
    listed = asked.select("_id", "operation", "kind", forms.alias("f")).select("_id", F.col("operation").alias("op"), "kind", "f.rn", "f.rp")
    r = rules.select(F.coalesce("name", F.lit("")).alias("rn"), F.lower("principal").alias("rp"), F.col("kind"), F.col("operation").alias("rop"), F.col("permission"))
    hit = listed.join(r, ["kind", "rn", "rp"]).filter("rop = op or rop = 'All'").groupBy("_id").agg(F.bool_or(F.col("permission") == "Deny").alias("deny"), F.bool_or(F.col("permission") == "Allow").alias("allow"))
    open_ = rules.isEmpty()
    allowed = F.lit(True) if open_ else ~F.coalesce("deny", F.lit(False)) & F.coalesce("allow", F.lit(False))
    return asked.join(hit, "_id", "left").select(*requests.columns, allowed.alias("allowed"))


def request_decisions(decided: DataFrame, by: str = "request_id") -> DataFrame:
    """A request is allowed if all that it names is."""
    return decided.groupBy(by).agg(F.bool_and("allowed").alias("allowed"))
