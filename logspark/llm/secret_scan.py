"""Operator 4: secret scan with false-positive removal by a random forest, in DataFrame functions only.

Candidates are the matches of one pattern (known key shapes, values assigned to credential names, long mixed strings).
Text splits at the same matches, so the pieces in between give places and neighbouring words.  Features: length,
character transitions, dictionary coverage, path and neighbouring words.  A random forest (Spark ML) is trained from
labelled findings and evaluated inside the row as array expressions, so a document's findings, and its text without
its secrets, come from one pass without a shuffle, a join or a Python worker.

``labelled`` may be any findings table with value, before, after, path, label; without one, ``example_findings`` gives
generated ones (a bounded number, by rule).

Edge cases: null and empty texts have no findings; a null path counts as none; repeated rows are scanned each; an
empty table gives no rows; a match runs to the end of its token, however long, and is scored as its likeliest piece of
200 characters, over pieces that start every 100 and reach its end; other columns are kept by ``redact`` and not read by
``scan``.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that credentials are assigned to, known key prefixes, and words around false positives.
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "AIza", "eyJ")
BENIGN = ("sha", "hash", "commit", "checksum", "md5", "uuid", "guid", "revision", "order", "invoice", "isbn", "phone", "tel", "card", "digest", "version", "id")
PLACEHOLDER = ("example", "sample", "dummy", "test", "placeholder", "changeme", "your", "fake", "redacted", "xxxx", "todo")
PATHS = ("test", "example", "sample", "fixture", "mock", "doc", "spec", "demo")
# Common words for dictionary coverage and for the transition table.
WORDS = (
    "about access account action after again archive assets backup banner because before between build button center chapter child client color config content control country create data date default delete detail document "
    "down download english error event example field file final first folder format front game general global group header height house image index input item journal kernel label language large layout letter level library "
    "light line link list local login long main manager market master member menu message method mobile model module month music name network never news node note number object office online open option order other output "
    "page paper part password people person photo picture place plan player point post press price private process product profile program project public question radio record release report request result return right river "
    "sample school screen search second section secret server service session setting simple site small source space special standard start state station status story street string style summer system table team test text "
    "that theme there thing this time title today token tool total track travel type update upload user value version video view water website week white width window winter word work world write year your"
).split()

#: Candidates: a value after a credential name and an assignment, else a token with a known prefix (a web token with its
#: parts), else a long mixed string with a digit.
_ASSIGNED = r"(?<=[:=]\s{0,2}[\"']?)(?<=(?i:" + "|".join(NAMES) + r")[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[^\s\"',;<>]{8,}+"
_MIXED = r"(?<![\w+/-])(?=[A-Za-z_+/-]*+[0-9])[\w+/-]{16,}+={0,2}"
_SHAPED = r"(?<![A-Za-z0-9])(?:eyJ[\w+/-]{12,}+={0,2}(?:\.[\w+/-]++={0,2}){0,2}|(?:A[KS]IA(?=[A-Z0-9]{16})|" + "|".join(p for p in PREFIXES if p not in ("AKIA", "ASIA", "eyJ")) + r")[\w+/-]{12,}+={0,2})"
PATTERN = f"{_ASSIGNED}|{_SHAPED}|{_MIXED}"
#: Characters that features read at once: a longer candidate is read in overlapping pieces, all of it.
FEATURE_CHARS = 200
TREES, DEPTH = 25, 6
FEATURES = 15
#: Generated labelled findings.
EXAMPLES = 6000


def _transitions() -> list[float]:
    """Log probability of a character kind (a-z, digit, other) after another, from the common words."""
    kind = lambda c: ord(c) - 97 if "a" <= c <= "z" else 27
    pairs = Counter((kind(a), kind(b)) for w in WORDS for a, b in zip(w, w[1:]))
    total = Counter(a for a, _ in pairs.elements())
    return [math.log((pairs[a, b] + 0.2) / (total[a] + 0.2 * 28)) for a in range(28) for b in range(28)]


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """Array of doubles."""
    low = F.lower(value)
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda drop: F.length(F.regexp_replace(value, drop, "")) / n
    near = F.lower(F.concat_ws(" ", before, after))
    flag = lambda c: c.cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    table = F.array(*[F.lit(x) for x in _transitions()])
    codes = F.transform(F.split(F.regexp_replace(F.regexp_replace(low, "[0-9]", "{"), "[^a-z{]", "|"), ""), lambda c: F.least(F.ascii(c) - 97, F.lit(27)))
    steps = F.aggregate(F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(1))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(1))), lambda a, b: F.coalesce(F.get(table, F.coalesce(a, F.lit(27)) * 28 + F.coalesce(b, F.lit(27))), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.array(
        n,
        F.length(kinds) / n,
        share("[^0-9]"),
        share("[^A-Z]"),
        F.size(F.array_distinct(F.split(value, ""))) / n,
        steps / n,
        F.lit(1.0) - F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=len, reverse=True)), "")) / n,
        (F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit("")))).cast("double") + flag(value.rlike(r"\.[a-z]{2,4}$")),
        flag(F.lower(F.coalesce(path, F.lit(""))).rlike("|".join(PATHS))),
        flag(value.rlike("^(?:" + "|".join(PREFIXES) + ")")),
        flag(F.lower(before).rlike("(?:" + "|".join(NAMES) + r")[\"']?\s{0,2}[:=]\s{0,2}[\"']?$")),
        flag(near.rlike(r"\b(?:" + "|".join(BENIGN) + r")\b")),
        flag(near.rlike("|".join(PLACEHOLDER)) | low.rlike("|".join(PLACEHOLDER))),
        flag(value.rlike("^[0-9a-f]+$")),
        flag(value.rlike("^[0-9_+/-]+$")),
    )


def pieces(value: Column) -> Column:
    """value in pieces of at most FEATURE_CHARS, each of which starts half of that after the one before."""
    half = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{FEATURE_CHARS // 2}}}"), F.lit(0))
    most = F.greatest(F.size(half) - 1, F.lit(1))
    both = F.zip_with(F.slice(half, 1, most), F.slice(half, 2, most), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.length(value) > FEATURE_CHARS, both).otherwise(F.array(value))


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Labelled findings made by rule: keys of known shapes, random values and their look-alikes."""
    i = F.col("id")
    pick = lambda salt, options: F.get(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))).cast("int"))
    size = lambda least, most: (F.pmod(F.xxhash64(i, F.lit(5)), F.lit(most - least + 1)) + least).cast("int")
    code = lambda salt: F.sha2(F.concat_ws("-", i.cast("string"), F.lit(salt)), 512)
    rows = spark.range(n).select(
        "id",
        F.pmod(F.xxhash64(i, F.lit(1)), F.lit(14)).cast("int").alias("kind"),
        F.translate(F.base64(F.unhex(code("b"))), "/+=", "xyz").alias("base"),
        F.regexp_replace(F.upper(F.base64(F.unhex(code("u")))), "[^A-Z0-9]", "7").alias("upper"),
        F.regexp_replace(F.concat(F.conv(F.substring(code("d"), 1, 12), 16, 10), F.conv(F.substring(code("e"), 1, 12), 16, 10)), "^0", "4").alias("digits"),
        code("h").alias("hex"),
        *[pick(20 + k, WORDS).alias(f"w{k}") for k in range(5)],
    )
    h, base, word = F.col("hex"), F.col("base"), [F.col(f"w{k}") for k in range(5)]
    rows = rows.withColumns({
        "prose": F.concat_ws(" ", *word[3:], pick(33, ("the", "of", "and", "", "in", "is"))),
        "name": F.concat(pick(34, NAMES), pick(35, ("=", ": ", ' = "', "='", ":"))),
        "other": F.concat(pick(36, BENIGN), pick(37, (" ", ": ", "=", " = "))),
        "words": F.concat_ws("_", *word[:3], pick(24, ("2021", "v2", "01", "2024", "x64", "99"))),
        "uuid": F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
    }).repartition(2, "id")
    prose, given, benign = F.col("prose"), F.concat_ws(" ", "prose", "name"), F.concat_ws(" ", "prose", "other")
    shapes = [  # value, words before, secret
        (F.concat(F.lit("AKIA"), F.substring("upper", 1, 16)), prose, 1),
        (F.concat(pick(41, PREFIXES[2:]), F.substr(base, F.lit(1), size(20, 40))), prose, 1),
        (F.substr(h, F.lit(1), size(16, 40)), given, 1),
        (F.substr(base, F.lit(1), size(12, 64)), given, 1),
        (F.concat(word[0], F.substr(base, F.lit(1), size(6, 12))), given, 1),
        (F.substr(base, F.lit(1), size(24, 64)), prose, 1),
        (F.substr(h, F.lit(1), size(32, 64)), benign, 0),
        (F.substr(F.col("digits"), F.lit(1), size(16, 24)), prose, 0),
        (F.col("words"), prose, 0),
        (F.concat(word[1], F.lit("/"), F.col("words")), prose, 0),
        (F.col("uuid"), F.when(i % 2 == 0, benign).otherwise(prose), 0),
        (F.concat(pick(44, PLACEHOLDER), F.lit("_"), word[0], F.lit("1234567890")), given, 0),
        (F.concat_ws("-", word[0], word[1], F.substr(F.col("digits"), F.lit(1), size(4, 12))), prose, 0),
        (F.concat(pick(48, PREFIXES), F.lit("EXAMPLEKEY0000"), pick(49, PLACEHOLDER)), F.concat(prose, F.lit(" example ")), 0),
    ]
    made = F.get(F.array(*[F.struct(v.alias("value"), b.alias("before"), F.lit(float(y)).alias("label")) for v, b, y in shapes]), F.col("kind"))
    near = F.pmod(F.xxhash64(i, F.lit(52)), F.lit(8)) == 0
    out = rows.select("id", made.alias("o"), pick(51, (" and", " the", '" of', " in", "' was", "")).alias("after"), F.when(near, pick(53, PATHS)).otherwise(F.col("w2")).alias("path"), near.alias("near"))
    label = F.when(F.col("near") & (F.pmod(i, F.lit(3)) > 0), 0.0).otherwise(F.col("o.label"))
    return out.select("o.value", "o.before", "after", "path", label.alias("label")).repartition(2, "value")


class Forest:
    """Complete binary trees in heap order: feature, threshold of the inner nodes; probability of the leaves."""

    def __init__(self, feature: list[int], threshold: list[float], leaf: list[float], trees: int, depth: int) -> None:
        self.feature, self.threshold, self.leaf, self.trees, self.depth = feature, threshold, leaf, trees, depth

    def score(self, x: Column) -> Column:
        """Mean leaf probability, as an expression over the feature array."""
        inner, ends = (1 << self.depth) - 1, 1 << self.depth
        feature, threshold, leaf = (F.array(*[F.lit(v) for v in side]) for side in (self.feature, self.threshold, self.leaf))

        def one(tree: Column) -> Column:
            step = lambda i, _: i * 2 + 1 + (F.get(x, F.get(feature, tree * inner + i)) > F.get(threshold, tree * inner + i)).cast("int")
            at = F.aggregate(F.array(*[F.lit(k) for k in range(self.depth)]), F.lit(0), step)
            return F.get(leaf, tree * ends + at - inner)

        return F.aggregate(F.array(*[F.lit(k) for k in range(self.trees)]), F.lit(0.0), lambda s, t: s + one(t)) / self.trees


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit a random forest on labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    x = features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path"))
    rows = labelled.filter("value is not null and label is not null").select(array_to_vector(x).alias("features"), F.col("label").cast("double").alias("label")).persist()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(rows)
    rows.unpersist()
    feature, threshold, leaf = [], [], []
    for tree in model.trees:
        f, t = [0] * ((1 << depth) - 1), [0.0] * ((1 << depth) - 1)
        ends = [0.0] * (1 << depth)

        def fill(node, i: int, level: int) -> None:
            if node.getClass().getSimpleName() == "LeafNode" or level == depth:
                stats = node.impurityStats().stats()
                p = stats[1] / max(stats[0] + stats[1], 1e-9) if len(stats) > 1 else 0.0
                width = 1 << (depth - level)
                first = (i + 1) * width - (1 << depth)
                ends[first : first + width] = [float(p)] * width
                return
            f[i], t[i] = node.split().featureIndex(), float(node.split().threshold())
            fill(node.leftChild(), 2 * i + 1, level + 1)
            fill(node.rightChild(), 2 * i + 2, level + 1)

        fill(tree._java_obj.rootNode(), 0, 0)
        feature += f
        threshold += t
        leaf += ends
    return Forest(feature, threshold, leaf, len(model.trees), depth)


def with_findings(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, threshold: float = 0.5, mark: str = "_") -> DataFrame:
    """docs with two more columns: ``_gaps``, the text between candidates, and ``_findings``, the candidates in order.
    Their names start with ``mark`` instead, which no column of docs may."""
    values, gaps, starts, found, findings = (f"{mark}{n}" for n in ("values", "gaps", "starts", "found", "findings"))
    t = F.col(text_col)
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    has = t.rlike(PATTERN)
    cut = docs.withColumns({values: F.when(has, F.regexp_extract_all(t, F.lit(PATTERN), 0)), gaps: F.when(has, F.split(t, PATTERN, -1))})
    ahead = F.transform(gaps, lambda g: F.length(g))
    cut = cut.withColumn(starts, F.aggregate(F.zip_with(ahead, F.transform(values, lambda v: F.length(v)), lambda g, v: F.struct(g.alias("g"), F.coalesce(v, F.lit(0)).alias("v"))), F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")), lambda s, x: F.struct(F.concat(s["at"], F.array(s["n"] + x["g"])).alias("at"), (s["n"] + x["g"] + x["v"]).alias("n")))["at"])

    def finding(v: Column, k: Column) -> Column:
        before, after = F.right(F.get(gaps, k), F.lit(60)), F.left(F.get(gaps, k + 1), F.lit(40))
        return F.struct(F.get(starts, k).cast("long").alias("start"), v.alias("value"), before.alias("before"), after.alias("after"))

    cut = cut.withColumn(found, F.transform(values, finding))
    cut = cut.withColumn(found, F.transform(found, lambda f: f.withField("x", F.transform(pieces(f["value"]), lambda p: features(p, f["before"], f["after"], path)))))
    rule = lambda v: F.when(v.rlike("^(?:" + "|".join(PREFIXES) + ")"), F.lit("known shape")).otherwise(F.lit("value"))
    scored = cut.withColumn(findings, F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["value"].alias("value"), rule(f["value"]).alias("rule"), F.array_max(F.transform(f["x"], forest.score)).alias("score"))))
    return scored.withColumn(findings, F.transform(findings, lambda f: f.withField("is_secret", f["score"] >= threshold))).drop(values, starts, found)


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: id, start (code points), length, rule, digest of the value, score, is_secret."""
    cols = [F.col(id_col).alias("i"), F.col(text_col).alias("t"), (F.col(path_col) if path_col else F.lit(None).cast("string")).alias("p")]
    f = with_findings(docs.select(*cols), forest, "t", "p").filter(F.size("_findings") > 0).select("i", F.explode("_findings").alias("f"))
    return f.select(F.col("i").alias(id_col), "f.start", F.length("f.value").cast("long").alias("length"), "f.rule", F.sha2("f.value", 256).alias("value_sha256"), F.round("f.score", 6).alias("score"), "f.is_secret")


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs, all rows and columns, with every secret in the text replaced by the mark."""
    own = "_"
    while any(c.startswith(own) for c in docs.columns):  # names of the steps in between, which no column has
        own += "_"
    gaps, findings = f"{own}gaps", f"{own}findings"
    f = with_findings(docs, forest, text_col, path_col, mark=own)
    parts = F.zip_with(gaps, findings, lambda g, x: F.concat(g, F.when(x["is_secret"], F.lit(mark)).otherwise(F.coalesce(x["value"], F.lit("")))))
    return f.withColumn(text_col, F.when(F.exists(findings, lambda x: x["is_secret"]), F.array_join(parts, "")).otherwise(F.col(text_col))).select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's verdict."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(example_findings(spark)), path_col="source")
