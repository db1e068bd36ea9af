"""Operator 3: exact self-join of documents on the Jaccard similarity of their word shingles, and its components.

1. Every document's set of shingle hashes gives its size and a 128-bit signature; documents of equal sets form a class
   (a partial minimum before the shuffle, so a hot class costs a row a task).
2. A count sketch over all shingles of all documents, of a size that follows their number up to ``MOST_BITS``, orders
   them rare first.  Any order gives exact results; this one keeps common shingles out of the prefixes.
3. Documents are posted under their prefix shingles; of lists with equal members one stays.  Each posting list tries its members with one of them (a star, not
   all pairs), first with the one that has the fewest rarer shingles, then, as long as that joins components, with
   others by turns.  Candidates pass length, positional and suffix filters and are verified once per pair on texts.
4. Posting lists whose members are then not all in one component give the pairs that still can matter: members of
   different components, by the same filters, verified once per pair.  Pairs left out can't change the components.
5. For the number of links, which needs all pairs, each component's classes (every link is inside one) are dealt to
   blocks and every two blocks are compared whole by a matrix product over the shingles they share; a block's classes
   give their counts, so no pair becomes a row.

Edge cases: null text, empty text or text without words has no shingles and links with nothing; fewer words than a
shingle count as one; rows with a null id are returned with a null component; rows of one id are one document with
links of each of its texts (its number of links is then the sum over its different sets, each of which counts as a
document); repeated rows come back each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspark.llm.components import components
from logspark.llm.shared import Scratch, lean
from logspark.llm.text import LOWER, chunks, mix, shingles, words_of

#: Counters of the sketch: about one for 64 shingles, between these powers of two (a byte each once ranked).
LEAST_BITS, MOST_BITS = 20, 26
BLOCK_BITS = 14
#: Hash ranges whose sizes bound an overlap (the suffix filter).
RANGES = 64
#: Turns in which posting lists try one of their members with the others, before all pairs that still can matter.
MOST_TURNS = 6
#: Ids of candidates that are broadcast to the scan of texts; more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000
#: Classes and shingles of a block of a component, about, and columns of a matrix product.
BLOCK_CLASSES, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 2048
_SALT = np.uint64(0xA5A5A5A55A5A5A5A)


def sets_of(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = words_of([(t or b"").translate(LOWER) for t in texts])
    ends = np.cumsum(counts)
    return [np.unique(shingles(hashes[e - c : e], size)) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _each(batches: Iterator[pa.RecordBatch], size: int, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        raw = b.column(column).cast(pa.binary())
        for lo, hi in chunks(b.column(column)):
            yield b.slice(lo, hi - lo), sets_of(raw.slice(lo, hi - lo).to_pylist(), size)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _each(batches, size):
            n = [len(s) for s in sets]
            s0 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            s1 = np.array([mix(s ^ _SALT).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            parts = [np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES), 32767).astype(np.int16) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s0), pa.array(s1), pa.array(parts, pa.list_(pa.int16()))], ["doc", "n", "s0", "s1", "parts"])

    return run


def _sketch(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Rank of every counter by how many documents' shingles it counts (0: fewest); 2**bits bytes."""
    block = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for _, sets in _each(batches, size):
            if sets:
                cell, n = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                total[cell] += n.astype(np.uint32)
        if total.any():
            for k in range(0, 1 << bits, block):
                planes = total[k : k + block].view(np.uint8).reshape(-1, 4).T.tobytes()  # high bytes are zeros, which compress
                yield pa.RecordBatch.from_arrays([pa.array([k // block], pa.int32()), pa.array([planes], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, planes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                sums[k] = sums[k] + c if k in sums else c.astype(np.uint64)
        for k, c in sums.items():
            rank = np.minimum(255, np.floor(8 * np.log2(c.astype(np.float64) + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["block", "counts"])

    parts = max(8, 1 << max(0, bits - 18))
    rows = docs.select(F.lit(0), "text").mapInArrow(lean(count), "block int, counts binary").repartition(parts, "block").mapInArrow(lean(add), "block int, counts binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for k, ranks in rows:
        out[k * block : (k + 1) * block] = np.frombuffer(ranks, np.uint8)
    return out


def _postings(size: int, num: int, den: int, held, bits: int):
    """Prefix shingles of every document, rarest first; equal sets of one task are posted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = held.value, set()
        for b, sets in _each(batches, size):
            hs, docs, ns, at = [], [], [], []
            for d, s in zip(b.column(0).to_pylist(), sets, strict=True):
                n = len(s)
                if n == 0 or (key := int(mix(s).sum(dtype=np.uint64))) in seen:
                    continue
                seen.add(key)
                p = n - (num * n + den - 1) // den + 1
                order = np.lexsort((s, rank[(s >> np.uint64(64 - bits)).astype(np.int64)]))[:p] if p < n else np.lexsort((s, rank[(s >> np.uint64(64 - bits)).astype(np.int64)]))
                hs.append(s[order])
                docs.append(np.full(len(order), d, np.int64))
                ns.append(np.full(len(order), n, np.int32))
                at.append(np.arange(len(order), dtype=np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (docs, ns, at))], ["h", "doc", "n", "pos"])

    return run


def _may_link(n: Column, m: Column, i: Column, j: Column, num: int, den: int) -> Column:
    """Length and positional filters: sizes n and m, first common shingle at i and j of the common order."""
    length = (F.least(n, m) * den >= F.greatest(n, m) * num)
    common = F.least(n - i, m - j)  # the shingle itself and what follows it
    return length & (common * (den + num) >= (n + m) * num)


def _verified(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        known: dict[int, np.ndarray] = {}  # sets of texts seen lately
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            left, right = b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary())
            ok = np.zeros(len(a), bool)
            for lo, hi in chunks(b.column(3)):
                if len(known) > 2000:
                    known.clear()
                new = [k for k in range(lo, hi) if c[k] not in known]
                new = list({c[k]: k for k in new}.values())
                known.update(zip([c[k] for k in new], sets_of([right[k].as_py() for k in new], size), strict=True))
                for k in range(lo, hi):
                    if hub != a[k]:
                        hub, own = a[k], sets_of([left[k].as_py()], size)[0]
                    s = known[c[k]]
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    ok[k] = den * both >= num * (len(own) + len(s) - both)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a)[ok]), pa.array(np.array(c)[ok])], ["a", "b"])

    return run


def similarity_classes(docs: DataFrame, num: int = 80, den: int = 100, size: int = 5, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, links: bool = False) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, class_id (smallest id with the same set); with links also n_links,
    the number of other documents it is similar to."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sig = scratch.write(texts.mapInArrow(lean(_signatures(size)), "doc long, n long, s0 long, s1 long, parts array<short>"), "sig")
    real = sig.filter("n > 0 and doc is not null")
    classes = scratch.write(real.groupBy("s0", "s1", "n").agg(F.min("doc").alias("rep"), F.first("parts").alias("parts")), "classes")
    of = scratch.write(real.join(classes.drop("parts"), ["s0", "s1", "n"]).groupBy("doc").agg(F.min("rep").alias("rep"), F.countDistinct("s0", "s1", "n").alias("sets")), "of")
    known = texts.filter("doc is not null")
    if not of.filter("sets > 1").isEmpty():
        return _several_texts(texts, sig, num, den, size, id_col, scratch, links)
    if of.count() < real.count():  # rows of one id have one set: one of its texts is enough
        known = scratch.write(known.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(["doc"]), "known")
    total = sig.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (total // 64).bit_length()))
    rank = spark.sparkContext.broadcast(_sketch(texts.select("text"), size, bits))

    posted = known.mapInArrow(lean(_postings(size, num, den, rank, bits)), "h long, doc long, n int, pos int")
    w = W.partitionBy("h").orderBy("pos", "doc")
    first = F.first(F.struct("doc", "n", "pos")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = W.partitionBy("h")
    seal = [F.bit_xor(F.xxhash64("doc", F.lit(k))).over(whole).alias(f"x{k}") for k in (1, 2)]
    every = posted.select("h", "doc", "n", "pos", first.alias("f"), F.count("*").over(whole).alias("c"), *seal).filter("c > 1")
    every = scratch.write(every, "every")
    rank.destroy()
    # lists of equal members tell the same: the one of the first shingle in the common order stays, whose positions are
    # the least for all members, so the filters pass whatever they would pass for the others
    best = every.filter("doc = f.doc").groupBy("c", "x1", "x2").agg(F.min_by("h", F.struct("pos", "h")).alias("h")).select("h")
    lists = scratch.write(every.join(best, "h", "left_semi").select("h", "doc", "n", "pos", "f"), "lists")
    scratch.drop("every")
    star = lists.filter(F.col("doc") != F.col("f.doc")).filter(_may_link(F.col("n"), F.col("f.n"), F.col("pos"), F.col("f.pos"), num, den))
    pairs = star.select(F.col("doc").alias("x"), F.col("f.doc").alias("y")).distinct()
    for side in ("x", "y"):  # documents to their classes
        pairs = pairs.join(of.select(F.col("doc").alias(side), F.col("rep").alias(side + "r")), side)
    pairs = pairs.filter("xr <> yr").select(F.least("xr", "yr").alias("a"), F.greatest("xr", "yr").alias("b")).distinct()
    tried = scratch.write(_filtered(scratch.write(pairs, "raw0"), classes, num, den), "tried0")
    root = components(_links(tried, known, size, num, den), scratch, "a")
    left = scratch.write(lists.select("h", "doc", "n", "pos").join(of.select("doc", "rep"), "doc").select("h", "rep", "n", "pos").distinct(), "left")
    scratch.drop("lists")

    turn = 0
    while True:
        turn += 1
        member = left.join(root, F.col("rep") == F.col("node"), "left").select("h", "rep", "n", "pos", F.coalesce("root", "rep").alias("c"))
        mixed = scratch.write(_mixed(member), f"mixed{turn}")
        left = mixed.drop("c")  # a list within one component stays so
        x, y = mixed.alias("x"), mixed.alias("y")
        on = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & _may_link(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"), num, den)
        if turn <= MOST_TURNS:  # one member of each list, another one each turn, with the rest of it
            one = mixed.groupBy("h").agg(F.min_by(F.struct("rep", "n", "pos", "c"), F.xxhash64("rep", F.lit(turn))).alias("o")).select("h", "o.*")
            across = x.join(one.alias("y"), on)
        else:  # all that still can matter
            across = x.join(y, on & (F.col("x.rep") < F.col("y.rep")))
        pairs = across.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = scratch.write(_filtered(scratch.write(pairs, f"raw{turn}"), classes, num, den), f"tried{turn}")
        tried = tried.union(pairs)
        new = scratch.write(_links(pairs, known, size, num, den), f"links{turn}")
        some = not new.isEmpty()
        if some:
            root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new), scratch, f"b{turn}")
        scratch.drop(f"links{turn}")
        if turn > MOST_TURNS:
            break
        if not some:
            turn = MOST_TURNS
    scratch.drop("left", *(f"{name}{k}" for name in ("raw", "tried", "mixed") for k in range(MOST_TURNS + 2)))

    found = of.join(root, F.col("rep") == F.col("node"), "left").select(F.col("doc").alias("d"), F.col("rep"), F.coalesce("root", "rep").alias("component"))
    out = sig.select("doc", "n").join(found, F.col("doc") == F.col("d"), "left")
    cols = [F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), F.coalesce("rep", "doc").alias("class_id")]
    if links:
        inside = of.groupBy("rep").agg(F.count("*").alias("w"))
        across = scratch.write(_across(root, classes, inside, known, size, num, den), "across")
        n = inside.join(across, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("r"), (F.col("w") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        out = out.join(n, F.col("rep") == F.col("r"), "left")
        cols.append(F.when(F.col("doc").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return out.select(*cols)


def _several_texts(texts: DataFrame, sig: DataFrame, num: int, den: int, size: int, id_col: str, scratch: Scratch, links: bool) -> DataFrame:
    """similarity_classes where an id has texts of different sets: each set of an id is compared as a document of its
    own, then an id's sets are one."""
    every = texts.filter("doc is not null").dropDuplicates(["doc", "text"])
    every = scratch.write(every.select(F.monotonically_increasing_id().alias("unit"), "doc", "text"), "every_text")
    set_of = every.select("unit", "text").mapInArrow(lean(_signatures(size)), "unit long, n long, s0 long, s1 long, parts array<short>").drop("parts")
    one = every.select("unit", "doc").join(set_of, "unit").groupBy("doc", "s0", "s1", "n").agg(F.min("unit").alias("unit")).select("unit")
    units = scratch.write(every.join(one, "unit", "left_semi"), "units")
    found = similarity_classes(units.select("unit", "text"), num, den, size, "unit", "text", Scratch(scratch.spark), links)
    found = scratch.write(found.drop("n_shingles").join(units.select("unit", "doc"), "unit"), "by_unit")
    least = lambda key: found.groupBy(key).agg(F.min("doc").alias("least"))
    root = components(found.join(least("component_id"), "component_id").select(F.col("doc").alias("a"), F.col("least").alias("b")), scratch, "ids")
    by_id = found.join(least("class_id"), "class_id").groupBy(F.col("doc").alias("d")).agg(F.min("least").alias("rep"), *([F.sum("n_links").alias("n_links")] if links else []))
    out = sig.select("doc", "n").join(by_id, F.col("doc") == F.col("d"), "left").join(root, F.col("doc") == F.col("node"), "left")
    cols = [F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"), F.col("rep").alias("class_id")]
    return out.select(*cols, *(["n_links"] if links else []))


def _across(root: DataFrame, classes: DataFrame, inside: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """node, linked: how many documents of other classes each class is linked to, of classes that share a component."""
    member = root.select("node", "root").union(root.select(F.col("root").alias("node"), "root").distinct())
    n = classes.groupBy("rep").agg(F.max("n").alias("n"))
    member = member.join(n, F.col("node") == F.col("rep")).drop("rep").join(inside, F.col("node") == F.col("rep")).drop("rep")
    blocks = member.groupBy(F.col("root").alias("r")).agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = member.join(blocks, F.col("root") == F.col("r")).select("node", "root", "w", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    held = texts.join(member, F.col("doc") == F.col("node"))
    each = held.select("root", "own", "node", "w", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    key = ["root", "lo", "hi"]
    each = each.select("root", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), "own", "node", "w", "text")
    counts = each.repartition(*key).sortWithinPartitions(*key, "own", "node").mapInArrow(lean(_counted(size, num, den)), "node long, linked long")
    return counts.groupBy("node").agg(F.sum("linked").alias("linked"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each set of a shares with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    shared = np.intersect1d(flat[0], flat[1])
    if not len(shared):
        return out
    cells = []
    for h, r in zip(flat, rows, strict=True):
        c = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        keep = shared[c] == h
        c, r = c[keep], r[keep]
        order = np.argsort(c, kind="stable")
        cells.append((c[order], r[order]))
    for lo in range(0, len(shared), COLUMNS):
        hi, sides = min(lo + COLUMNS, len(shared)), []
        for (c, r), x in zip(cells, (a, b), strict=True):
            i, j = np.searchsorted(c, [lo, hi])
            m = np.zeros((len(x), hi - lo), np.float32)
            m[r[i:j], c[i:j] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T  # whole numbers below 2**24 are exact
    return out


def _linked(a: list[np.ndarray], b: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of a are similar to which of b."""
    both = _common(a, b).astype(np.int64)
    total = np.array([len(s) for s in a], np.int64)[:, None] + np.array([len(s) for s in b], np.int64)[None, :]
    return den * both >= num * (total - both)


def _counted(size: int, num: int, den: int):
    """Counts of linked documents, from rows root, lo, hi, own, node, w, text in the order of the first five."""

    def of_group(rows: list[tuple], lo: int, hi: int) -> pa.RecordBatch:
        sets = sets_of([r[3] for r in rows], size)
        own, node, w = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        first = own == lo
        ia, ib = np.flatnonzero(first), np.flatnonzero(first if lo == hi else ~first)
        if not len(ia) or not len(ib):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["node", "linked"])
        hit = _linked([sets[i] for i in ia], [sets[i] for i in ib], num, den)
        (na, fa), (nb, fb) = np.unique(node[ia], return_index=True), np.unique(node[ib], return_index=True)
        # an id's texts are next to each other: any of them links
        hit = np.logical_or.reduceat(np.logical_or.reduceat(hit, fa, axis=0), fb, axis=1)
        hit &= na[:, None] != nb[None, :]
        out = [(na, hit @ w[ib][fb])] + ([] if lo == hi else [(nb, w[ia][fa] @ hit)])
        nodes, linked = (np.concatenate([x[k] for x in out]).astype(np.int64) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(linked)], ["node", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            more = zip(*(b.column(k).to_pylist() for k in range(3, 6)), b.column(6).cast(pa.binary()).to_pylist(), strict=True)
            for key, row in zip(keys, more, strict=True):
                if key != at:
                    if rows:
                        yield of_group(rows, *at[1:])
                    at, rows = key, []
                rows.append(row)
        if rows:
            yield of_group(rows, *at[1:])

    return run


def _mixed(member: DataFrame) -> DataFrame:
    """Members of lists that hold more than one component."""
    more = member.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h")
    return member.join(more, "h", "left_semi")


def _of_pairs(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a pair.  Few ids are broadcast to the rows; more meet them by a shuffle."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    few = ids.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def _filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Suffix filter: shingles of one hash range can only meet those of the same range."""
    some = _of_pairs(pairs, classes.select("rep", "n", "parts"), "rep")
    side = lambda i, k: some.select(F.col("rep").alias(i), F.struct("n", "parts").alias(k))
    both = pairs.join(side("a", "k"), "a").join(side("b", "m"), "b")
    bound = F.aggregate(F.zip_with("k.parts", "m.parts", lambda p, q: F.least(p, q).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    capped = F.exists("k.parts", lambda p: p == 32767) | F.exists("m.parts", lambda p: p == 32767)
    return both.filter(capped | (bound * (den + num) >= (F.col("k.n") + F.col("m.n")) * num)).select("a", "b").distinct()


def _links(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that hold on the texts; a's text travels once, b's with the pair."""
    some = _of_pairs(pairs, texts, "doc")
    a = some.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    b = some.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(lean(_verified(size, num, den)), "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component (and rows with a null id).  Of rows with
    the id and text of the first document only one stays."""
    found = similarity_classes(docs, id_col=id_col, **how)
    gone = found.filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    few = gone.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
    again = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    if again.isEmpty():
        return kept
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(once)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by links of Jaccard similarity 0.8 on five-word shingles."""
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_ngram_join's rows with each document's number of links, over all pairs."""
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True)


#: DuckDB SQL of the same rows.
ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS x FROM s), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b, k = na.n AND k = nb.n AS same FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, y.b FROM r JOIN both_ways y ON y.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = n.doc_id) AS component_id, least(n.doc_id, coalesce((SELECT min(b) FROM both_ways y WHERE y.a = n.doc_id AND same), n.doc_id)) AS class_id FROM n
"""

#: The same with the number of links.
LINKS_SQL = ORACLE_SQL.rstrip().removesuffix(" FROM n") + ", (SELECT count(*) FROM both_ways y WHERE y.a = n.doc_id) AS n_links FROM n\n"
