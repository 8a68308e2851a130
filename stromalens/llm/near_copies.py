"""Near copies by Jaccard similarity of word shingles: min-hash candidates, exact confirmation.

Texts with one set of shingles are one node. Nodes whose ``ROWS`` minima agree in one of
``BANDS`` bands are candidates; two sets of similarity 0.8 miss each other in all bands in 6 of
100 000 cases, more alike ones less often. Candidates are linked only if their sets, compared
whole, are alike enough.

Where many nodes share a band, a few pairs each are tried first, which join most of a group of
copies. What these leave apart is then compared pair by pair, block against block, so every
candidate pair is either compared or joined already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from .graph import components
from .shared import binaries, lists, slices

BANDS, ROWS = 32, 6
#: Nodes of a band's value that are all compared with each other at once. Of more, each is first compared
#: with the first and the next one in an order of that band, so that pairs differ from band to band.
GROUP = 12
#: Nodes of a block of a larger group, and shingles that two blocks are compared by at a time.
BLOCK, SHARED = 128, 1 << 12
_MIX = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words where there are fewer."""
    words = text.lower().split()  # A-Z only, and ASCII white space only, as these are bytes
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(s) for s in runs], np.uint64))


def bands(grams: np.ndarray) -> list[int]:
    """A signed 64-bit value for each band."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(grams), 1 << 11):  # a very long text must not need all products at once
        low = np.minimum(low, (grams[i:i + (1 << 11), None] * _MIX[0] + _MIX[1]).min(axis=0))
    raw = low.astype("<u8").tobytes()
    return [_signed(xxhash.xxh64_intdigest(raw[8 * ROWS * k:8 * ROWS * (k + 1)])) for k in range(BANDS)]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _node(grams: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(grams.astype("<u8").tobytes()))


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, node (hash of the set of shingles) and bands of every row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, width) for t in binaries(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(_node, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))], ["doc_id", "key", "node", "bands"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return picked.mapInArrow(rows, "doc_id long, key long, node long, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node, grams of each row of ``docs(node, text)``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                sets = [shingles(t, width) for t in binaries(part, "text")]
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(flat, np.array([len(s) for s in sets]), pa.int64())], ["node", "grams"])

    return docs.select("node", "text").mapInArrow(rows, "node long, grams array<long>")


def _neighbours(nodes: DataFrame) -> DataFrame:
    """band, value, node, n of all of ``nodes(node, bands)`` that share the value of a band with others, n in all; and the others to try first."""
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "value")).withColumn("place", F.xxhash64("node", "band"))
    group = Window.partitionBy("band", "value")
    ordered = group.orderBy("place", "node")
    seen = keyed.select("band", "value", "node", F.count(F.lit(1)).over(group).alias("n"), F.first("node").over(ordered).alias("first"),
                        F.collect_list("node").over(ordered.rowsBetween(-GROUP, -1)).alias("before")).where("n > 1")
    others = F.when(F.col("n") <= GROUP, F.col("before")).when(F.size("before") > 0, F.array("first", F.element_at("before", -1))).otherwise(F.array())
    return seen.select("band", "value", "node", "n", others.alias("others"))


def _alike(n, shared, percent: int):
    """Whether sets of ``n`` shingles together, ``shared`` of them in both, are alike enough."""
    return 100 * shared >= percent * (n - shared)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a Jaccard similarity of ``percent`` % or more."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
            .select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared")))
    return both.where(_alike(F.col("n"), F.col("shared"), percent)).select("a", "b")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of one side has in common with each of the other."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), SHARED):
        part = common[at:at + SHARED]
        tables = []
        for (grams, owner), n in zip(sides, (len(left), len(right))):
            place = np.minimum(np.searchsorted(part, grams), len(part) - 1)
            held = part[place] == grams
            table = np.zeros((n, len(part)), np.float32)
            table[owner[held], place[held]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return np.rint(out).astype(np.int64)


def _meet(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join roots of two blocks of (node, root, set), no more than connect them."""
    if not left or len({root for _, root, _ in left + right}) < 2:
        return []
    up: dict[int, int] = {}

    def top(i):
        while i in up:
            i = up[i]
        return i
    shared = _shared([s for _, _, s in left], [s for _, _, s in right])
    n = np.array([len(s) for _, _, s in left])[:, None] + np.array([len(s) for _, _, s in right])
    apart = np.array([root for _, root, _ in left])[:, None] != np.array([root for _, root, _ in right])
    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(_alike(n, shared, percent) & apart))):
        x, y = top(left[i][1]), top(right[j][1])
        if x != y:
            up[max(x, y)] = min(x, y)
            found.append((left[i][1], right[j][1]))
    return found


def _crowded(seen: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """Pairs (a, b) of roots in ``found(node, root)`` that links within the larger groups of ``seen`` join.

    Nodes under a group's commonest root need no comparison with each other. The others meet all,
    in pairs of blocks by hash: a task holds two blocks at a time. None if no group is left apart.
    """
    large = seen.where(F.col("n") > GROUP).select("band", "value", "node").join(found, "node", "left").select("band", "value", "node", F.coalesce("root", "node").alias("root"))
    large = materialize(large)
    per_root = large.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("n"))
    apart = per_root.groupBy("band", "value").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    apart = materialize(apart.select("band", "value", F.col("most.root").alias("main"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("n") - F.col("most.n")).alias("rests")))
    if apart.isEmpty():
        return None
    dealt = large.join(apart, ["band", "value"]).withColumn("in_main", F.col("root") == F.col("main"))
    block = F.pmod(F.xxhash64("node", "band"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    every = lambda n, unit: F.transform(F.sequence(F.lit(0), F.col(n) - 1), unit)
    unit = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    met = F.concat(every("rests", lambda k: unit(F.least(k, F.col("block")), F.greatest(k, F.col("block")))), every("mains", lambda m: unit(F.col("block"), F.col("rests") + m)))
    units = F.when(F.col("in_main"), every("rests", lambda k: unit(k, F.col("rests") + F.col("block")))).otherwise(met)
    dealt = dealt.withColumn("block", block).withColumn("u", F.explode(units))
    key = ["band", "value", "i", "j"]
    left = (~F.col("in_main") & (F.col("block") == F.col("u.i"))).alias("left")
    rows = dealt.select("band", "value", "u.i", "u.j", left, "node", "root").join(sets, "node").select(*key, "left", "node", "root", "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def result():
            left, right = sides
            links = _meet(left, right or left, percent) if now is not None else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
            is_left, node, root, grams = (batch.column(c) for c in ("left", "node", "root", "grams"))
            for at, k in enumerate(keys):
                if k != now:
                    yield result()
                    now, sides = k, ([], [])
                sides[0 if is_left[at].as_py() else 1].append((node[at].as_py(), root[at].as_py(), np.array(grams[at].values)))
        yield result()

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long").distinct()


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, groups: DataFrame | None = None) -> DataFrame:
    """One row of each group of linked texts, all columns kept: the smallest doc_id (null after all
    others), of several texts under one doc_id the one with the smaller hash, of repeated rows any.

    Rows with one root in ``groups(key, root)`` (key: hash of doc_id and text) are linked too.
    """
    prints = materialize(_prints(docs, width))
    nodes = prints.groupBy("node").agg(F.min(F.struct("key", "bands")).alias("any")).select("node", "any.*")
    seen = materialize(_neighbours(nodes))
    pairs = seen.select("node", F.explode("others").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a < b").distinct()
    wanted = nodes.select("node", "key").join(seen.select("node").distinct(), "node", "left_semi")
    text = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").join(wanted, "key").dropDuplicates(["node"])
    sets = materialize(_sets(text, width))
    edges = _links(pairs, sets, percent)
    if groups is not None:
        tied = materialize(prints.select("key", "node").join(groups, "key").select("node", "root").distinct())
        first = tied.groupBy("root").agg(F.min("node").alias("b"))
        edges = edges.unionByName(tied.join(first, "root").where("node <> b").select(F.col("node").alias("a"), "b"))
    found = materialize(components(edges))
    more = _crowded(seen, sets, found, percent)
    if more is not None:
        joined = components(more).select(F.col("node").alias("up"), F.col("root").alias("top"))
        linked = found.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
        found = materialize(linked.join(joined, linked["root"] == joined["up"], "left").select("node", F.coalesce("top", "root").alias("root")))
    own = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
    keep = own.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.key").alias("_key"))
    named = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    return named.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
