"""Near-duplicates by SimHash: fingerprints, linked pairs within a Hamming radius, groups.

Equal fingerprints are one node. Two fingerprints that differ in at most ``radius`` bits are
equal in one of ``radius + 1`` blocks of bits, so candidates share a block (an equi-join on
the block's bits, written as grouping). A block value shared by more than ``GROUP`` nodes is
split again: inside it the pairs still differ in at most ``radius`` of the other bits, which
are cut into as many blocks anew. This goes on until all groups are small or no bits are
left, so no pair is lost and no group is bounded by a cap. Groups are compared in whole
arrays, and of the links of a group only a spanning star per linked set leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from .graph import components
from .shared import binaries, slices

BITS = 64
#: Nodes that are compared with each other directly.
GROUP = 1500


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """Bits that are set in over half of the shingles' hashes, as a signed 64-bit number."""
    words = text.lower().split()  # A-Z only, and ASCII white space only, as these are bytes
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text must not need its bits at once
        set_bits += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, key (hash of doc_id and text) and fp (signed 64-bit) of every row; a text without
    words, or null, has fp 0."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([fingerprint(t, width, seed) for t in binaries(part, "text")], pa.int64())], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), "text").mapInArrow(rows, "doc_id long, key long, fp long")


def _key():
    return F.xxhash64("doc_id", "text").alias("key")


def _cuts(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` cut into ``parts`` blocks, each joined to ``mask``."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[len(free) * k // parts:len(free) * (k + 1) // parts]) for k in range(parts) if len(free) * (k + 1) // parts > len(free) * k // parts]


def _stars(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group`` as (member, root) pairs."""
    n = len(fp)
    root = np.arange(n)

    def top(i):
        while True:
            up = root[i]
            if (up == i).all():
                return i
            i = root[up]

    at = np.arange(n)
    for shift in range(1, n):
        at = at[at < n - shift]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius]
        a, b = near, near + shift
        while len(a):  # hook roots to smaller roots until the two ends agree
            a, b = top(a), top(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    root = top(at_all := np.arange(n))
    linked = root != at_all
    return at_all[linked], root[linked]


def _keyed(rows: DataFrame, parts: int) -> DataFrame:
    """A row (mask, part, fp) for each block of the bits that the row's ``mask`` leaves."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, fp = (np.asarray(batch.column(i), np.int64) for i in range(2))
            for m in np.unique(mask).tolist():
                own = fp[mask == m]
                for finer in _cuts(m % (1 << 64), parts):
                    signed = finer - (1 << 64) if finer >> 63 else finer
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), signed)), pa.array(own & signed), pa.array(own)], ["mask", "part", "fp"])

    return materialize(rows.select("mask", "fp").mapInArrow(cut, "mask long, part long, fp long"))


def links(nodes: DataFrame, radius: int = 3, group: int = GROUP) -> DataFrame:
    """Edges (a, b) of distinct fingerprints ``fp`` that connect whatever is within ``radius``."""
    keyed, ready = _keyed(nodes.select(F.lit(0).cast("long").alias("mask"), "fp"), radius + 1), []
    while True:
        heavy = keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
        heavy = materialize(heavy.select("mask", "part"))
        if heavy.isEmpty():
            ready.append(keyed)
            break
        ready.append(keyed.join(heavy, ["mask", "part"], "left_anti"))
        keyed = _keyed(keyed.join(heavy, ["mask", "part"], "left_semi"), radius + 1)
    rows = ready[0]
    for r in ready[1:]:
        rows = rows.unionByName(r)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in _with_end(batches):
            if batch is not None:
                held = np.concatenate([held, np.stack([np.asarray(batch.column(i), np.int64) for i in range(3)], axis=1)])
                same = (held[:, :2] == held[-1, :2]).all(axis=1)
                cut = len(held) - (len(held) if same.all() else int(np.argmin(same[::-1])))  # the last group may go on
            else:
                cut = len(held)
            done, held = held[:cut], held[cut:]
            if len(done):
                starts = np.append(True, (done[1:, :2] != done[:-1, :2]).any(axis=1))
                fp = done[:, 2].astype(np.uint64)
                a, b = _stars(np.cumsum(starts), fp, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(done[a, 2]), pa.array(done[b, 2])], ["a", "b"])

    return rows.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(compare, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """fp, root: the smallest fingerprint reachable from each fingerprint."""
    nodes = materialize(prints.select("fp").distinct())
    found = components(links(nodes, radius))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row.

    Rows that repeat a doc_id count as further documents under that id; a null doc_id takes no
    part in the smallest id, and a group of null ids alone has none. An empty table gives none.
    """
    prints = materialize(fingerprints(docs, width, seed))
    rooted = _rooted(prints, radius)
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(rooted, "fp")
    labels = materialize(rooted.join(low.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def roots(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """key (hash of doc_id and text) and root (the smallest fingerprint of its group) of every row."""
    prints = materialize(fingerprints(docs, width, seed))
    return prints.join(_rooted(prints, radius), "fp").select("key", "root")


def one_of_each(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """One row of each group, all columns kept: the smallest doc_id (null after all others), of
    several texts under one doc_id the one with the smaller hash, of repeated rows any."""
    prints = materialize(fingerprints(docs, width, seed))
    own = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
    keep = own.join(_rooted(prints, radius), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_key"))
    named = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    return named.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
