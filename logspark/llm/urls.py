"""Operator 6: URL filtering by fixed host and path rules, and by mined association rules beyond them.

Fixed rules fit a host, its subdomains and a path prefix; the longest one wins.  For what no fixed rule fits, FP-growth
(Spark ML) mines combinations of URL tokens among URLs that the fixed rules label; rules ``tokens -> block`` or
``tokens -> allow`` survive by support and confidence, the rest by an inverted index: a rule is looked up under its
rarest token and holds if all its tokens are in the URL.  The most confident rule decides, and without one the URL is
allowed.

Mining counts over all labelled URLs.  Rules are at most ``MOST_RULES`` (those of most confidence and support), so the
index that goes to all tasks has a fixed bound; tokens of fewer URLs than the support never enter.

Edge cases: a null URL or one without ``://`` has empty host and path, no rule and is allowed unless mined rules say
otherwise; hosts keep ports and user parts as written; no labelled URL means no mined rule; repeated rows are judged
each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Host, path prefix, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SUPPORT, CONFIDENCE, MOST_ITEMS, MOST_RULES = 0.002, 0.9, 3, 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From after the first :// to the next /, ?, # or the end; A-Z lower-cased; else empty."""
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "/", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, to the next ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host_: Column, path_: Column) -> Column:
    """Distinct tokens: labels and suffixes of the host, words of the path; numbers as one token."""
    labels = F.split(host_, r"\.")
    parts = F.transform(F.filter(F.split(path_, r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0), lambda t: F.when(t.rlike("^[0-9]+$"), F.lit("#")).otherwise(F.lower(t)))
    tagged = F.concat(F.transform(labels, lambda t: F.concat(F.lit("h:"), t)), F.array(F.concat(F.lit("t:"), F.element_at(labels, -1))), F.transform(parts, lambda t: F.concat(F.lit("p:"), t)))
    return F.array_distinct(F.filter(tagged, lambda t: F.length(t) > 2))


def fixed_rule(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits (as host and path), and its verdict; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST_RULES) -> list[tuple[list[str], str, float]]:
    """Rules tokens -> verdict from rows (tokens, verdict): by FP-growth on tokens with the verdict as one more item.
    A rule stays if no rule of fewer of its tokens says the same with as much confidence."""
    from pyspark.ml.fpm import FPGrowth

    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    if baskets.isEmpty():
        return []
    common = _common(baskets, support)  # tokens too rare for any rule go first: baskets get short
    baskets = baskets.select(F.array_intersect("items", F.array(*[F.lit(t) for t in common])).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("="))).filter(F.size("antecedent") <= MOST_ITEMS)
    found = rules.orderBy(F.desc("confidence"), F.desc("support"), F.size("antecedent"), F.array_join(F.array_sort("antecedent"), " ")).limit(most).collect()
    kept: list[tuple[frozenset[str], str, float]] = []
    for r in sorted(found, key=lambda r: len(r["antecedent"])):
        a, v = frozenset(r["antecedent"]), r["consequent"][0][1:]
        if not any(b < a and w == v and c >= r["confidence"] for b, w, c in kept):
            kept.append((a, v, r["confidence"]))
    return [(sorted(a), v, c) for a, v, c in kept]


def _common(baskets: DataFrame, support: float, most: int = 2000) -> list[str]:
    """Items of at least the support; there are at most (items of a basket / support) of them."""
    least = max(1, int(support * baskets.count()))
    rows = baskets.select(F.explode("items").alias("t")).groupBy("t").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "t").limit(most).collect()
    return [r[0] for r in rows]


def mined_verdict(tokens_: Column, rules: list[tuple[list[str], str, float]]) -> Column:
    """Verdict of the most confident rule all of whose tokens are there, by an index from one token to rules."""
    if not rules:
        return F.lit(None).cast("string")
    often: dict[str, int] = {}
    for a, _, _ in rules:
        for t in a:
            often[t] = often.get(t, 0) + 1
    index: dict[str, list[tuple[list[str], str, float]]] = {}
    for a, v, c in rules:
        index.setdefault(min(a, key=lambda t: (often[t], t)), []).append((a, v, c))
    entry = lambda a, v, c: F.struct(F.lit(float(c)).alias("c"), F.lit(v).alias("v"), F.array(*[F.lit(t) for t in a]).alias("a"))
    table = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*[entry(*r) for r in rs]))])
    hit = F.filter(F.flatten(F.transform(F.filter(tokens_, lambda t: F.map_contains_key(table, t)), lambda t: F.element_at(table, t))), lambda r: F.size(F.array_except(r["a"], tokens_)) == 0)
    return F.get(F.sort_array(hit, asc=False), F.lit(0))["v"]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (fixed; else null), verdict, mined (whether a mined rule gave it)."""
    rows = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("_u")).select(id_col, host(F.col("_u")).alias("host"), path(F.col("_u")).alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "_fixed": verdict, "tokens": tokens(F.col("host"), F.col("path"))})
    rules = mine(rows.filter("_fixed is not null").select("tokens", F.col("_fixed").alias("verdict")))
    mined = mined_verdict(F.col("tokens"), rules)
    rows = rows.withColumn("_mined", F.when(F.col("_fixed").isNull(), mined))
    return rows.select(id_col, "host", "path", "rule", F.coalesce("_fixed", "_mined", F.lit("allow")).alias("verdict"), F.col("_mined").isNotNull().alias("mined"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
