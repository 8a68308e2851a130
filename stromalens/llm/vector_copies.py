"""Near-duplicate vectors by an inverted multi-index over two halves of their components.

Each half of the unit vectors has a codebook of its own; a pair of centroids is a cell, so two
small codebooks give their product of cells. Every vector lives in its nearest cell and
visits further ones in the order of a multi-sequence traversal: by growing sum of the two
halves' distances. How many it visits follows from a target recall, measured on partners
made at exactly the threshold. A pair is met if either of the two visits the other's cell;
whatever is met is verified by the cosine itself.

Equal vectors of a label are one node with a weight. A cell with many residents or visitors
is cut into parts by hash, and each pair of parts is a unit of work of bounded size. A unit
passes on sums per node and a star per linked set, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..functions.lineage import materialize
from .graph import components

#: Rows the codebooks are fitted on (those with the smallest hashes), and rows the recall is measured on.
SAMPLE_ROWS, TRIAL_ROWS = 20_000, 2_000
#: Fewest and most centroids of a codebook, and nodes for each cell before it grows.
LEAST, MOST, PER_CELL = 4, 256, 800
#: Residents and visitors of a unit of work; visitors compared at a time.
RESIDENTS, VISITORS, STEP = 1500, 6000, 1000


class MultiIndex:
    """Codebooks of the two halves of unit vectors of one length, and how many cells to visit."""

    def __init__(self, sample: np.ndarray, size: int, threshold: float, recall: float, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [_centroids(h, size, rng) for h in (sample[:, :self.half], sample[:, self.half:])]
        self.visits = self._calibrated(sample[:TRIAL_ROWS], threshold, recall, rng)

    def distances(self, u: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to the centroids of its codebook."""
        return [(h ** 2).sum(axis=1)[:, None] - 2 * h @ c.T + (c ** 2).sum(axis=1) for h, c in zip((u[:, :self.half], u[:, self.half:]), self.books)]

    def cells(self, u: np.ndarray, n: int | None = None) -> np.ndarray:
        """The nearest ``n`` cells of each vector, nearest first.

        A pair that is i-th nearest on one side and j-th on the other has i * j pairs at least
        as near, itself among them, so pairs with i * j over ``n`` need no look.
        """
        n = n or self.visits
        left, right = self.distances(u)
        a, b = (np.argsort(d, axis=1, kind="stable")[:, :n] for d in (left, right))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij"))
        near = (i + 1) * (j + 1) <= n
        i, j = i[near], j[near]
        total = np.take_along_axis(left, a, 1)[:, i] + np.take_along_axis(right, b, 1)[:, j]
        first = np.argsort(total, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(a[:, i], first, 1) * len(self.books[1]) + np.take_along_axis(b[:, j], first, 1)

    def _calibrated(self, u: np.ndarray, threshold: float, recall: float, rng: np.random.Generator) -> int:
        """Cells to visit so that one of two vectors at the threshold meets the other with the given chance."""
        every = len(self.books[0]) * len(self.books[1])
        if u.shape[1] < 2 or not len(u):
            return every
        away = rng.normal(size=u.shape)
        away -= (away * u).sum(axis=1, keepdims=True) * u
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        v = threshold * u + np.sqrt(max(0.0, 1 - threshold ** 2)) * away

        def rank(x, y):
            at = self.cells(y, 1)
            (xl, xr), (k, m) = self.distances(x), np.divmod(at[:, 0], len(self.books[1]))
            rows = np.arange(len(x))
            own = xl[rows, k] + xr[rows, m]
            return np.array([(xl[r][:, None] + xr[r] < own[r]).sum() + 1 for r in rows])
        met = np.sort(np.minimum(rank(u, v), rank(v, u)))
        return int(min(every, met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]))


def _centroids(h: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Lloyd's means of at most ``size`` groups."""
    distinct = np.unique(h, axis=0)
    c = distinct[rng.permutation(len(distinct))[:size]]
    for _ in range(rounds):
        own = ((h ** 2).sum(axis=1)[:, None] - 2 * h @ c.T + (c ** 2).sum(axis=1)).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, h)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _indexes(nodes: DataFrame, threshold: float, recall: float) -> dict[int, MultiIndex]:
    """An index for each vector length in a bounded sample."""
    n = nodes.count()
    size = int(np.clip(round((n / PER_CELL) ** 0.5), LEAST, MOST))
    rows = nodes.select("vec").orderBy(F.xxhash64("node", F.lit(5)), "node").limit(SAMPLE_ROWS).toArrow().column("vec").to_pylist()
    by_length: dict[int, list] = {}
    for v in rows:
        by_length.setdefault(len(v), []).append(v)
    return {k: MultiIndex(_unit(np.array(v)), size, threshold, recall) for k, v in by_length.items()}


def _listed(nodes: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """A row per node: its own cell and, in order, all it visits (its own first)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                vec = part.column(part.schema.get_field_index("vec"))
                sizes = np.asarray(vec.value_lengths())
                cells = [None] * part.num_rows
                for k in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == k)
                    found = np.zeros((len(at), 1), np.int64)  # lengths outside the sample share one cell
                    if k in indexes:
                        found = indexes[k].cells(_unit(np.array(vec.take(pa.array(at)).to_pylist())))
                    for i, c in zip(at.tolist(), found.tolist()):
                        cells[i] = c
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int32()))], [*part.schema.names, "visits"])

    kind = nodes.schema["vec"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "vec", "weight").mapInArrow(rows, f"node long, label {label}, vec {kind}, weight long, visits array<int>")


def _meet(threshold: float):
    """Compare the visitors of a unit with its residents: node, n (links), root (smallest node of its linked set)."""
    def unit(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        resident = np.asarray(rows.column("resident"))
        node, weight = np.asarray(rows.column("node"), np.int64), np.asarray(rows.column("weight"), np.int64)
        who = np.flatnonzero(resident), np.flatnonzero(~resident)
        none = pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(who[0]) or not len(who[1]):
            return none
        size = len(rows.column("vec")[0])
        flat = np.asarray(rows.column("vec").combine_chunks().flatten()).reshape(-1, size)
        visits = rows.column("visits").combine_chunks()
        width = np.asarray(visits.value_lengths())
        visits = np.asarray(visits.flatten()).reshape(len(node), width[0])
        own, here = visits[:, 0], int(rows.column("cell")[0].as_py())
        u, places, back = _unit(flat), *np.unique(node, return_inverse=True)
        links, root = np.zeros(len(places)), np.arange(len(places))
        r = who[0]
        for start in range(0, len(who[1]), STEP):
            v = who[1][start:start + STEP]
            i, j = np.nonzero(u[v] @ u[r].T >= threshold)
            i, j = v[i], r[j]
            # inside a cell each pair once; between cells once, though both may visit each other
            mutual = np.zeros(len(i), bool)
            for k in range(visits.shape[1]):
                mutual |= visits[j, k] == own[i]
            once = np.where(own[i] == here, node[i] < node[j], ~mutual | (own[i] < here))
            i, j = i[once], j[once]
            a, b = back[i], back[j]
            links += np.bincount(a, weight[j], len(places)) + np.bincount(b, weight[i], len(places))
            while len(a):  # hook larger roots on smaller ones until both ends agree
                a, b = _top(root, a), _top(root, b)
                apart = a != b
                a, b = a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        linked = np.flatnonzero(links)
        return pa.table({"node": places[linked], "n": links[linked].astype(np.int64), "root": places[_top(root, linked)]})
    return unit


def _top(root: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = root[i]
        if (up == i).all():
            return i
        i = root[up]


def _found(nodes: DataFrame, threshold: float, recall: float, residents: int, visitors: int) -> DataFrame:
    """node, n, root from every unit that linked it."""
    listed = materialize(_listed(nodes, _indexes(nodes, threshold, recall)))
    place = ["label", "dim", "cell"]
    dim = F.size("vec").alias("dim")
    living = listed.groupBy("label", dim, F.element_at("visits", 1).alias("cell")).agg(F.count(F.lit(1)).alias("r"))
    coming = listed.select("label", dim, F.explode("visits").alias("cell")).groupBy(*place).agg(F.count(F.lit(1)).alias("v"))
    parts = living.join(coming, place).select(*place, F.ceil(F.col("r") / residents).cast("int").alias("r_parts"), F.ceil(F.col("v") / visitors).cast("int").alias("v_parts"))
    split = materialize(parts.where("r_parts > 1 or v_parts > 1"))
    same = [F.col(c) for c in ("node", "label", "vec", "weight", "visits")]
    rows = listed.select(*same, dim, F.element_at("visits", 1).alias("cell"), F.lit(True).alias("resident")).unionByName(
        listed.select(*same, dim, F.explode("visits").alias("cell"), F.lit(False).alias("resident")))
    rows = rows.join(split, place, "left").fillna(1, ["r_parts", "v_parts"])
    own = lambda n: F.array(F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # each part of the residents meets each part of the visitors
    rows = rows.withColumn("rp", F.explode(F.when(F.col("resident"), own("r_parts")).otherwise(every("r_parts"))))
    rows = rows.withColumn("vp", F.explode(F.when(F.col("resident"), every("v_parts")).otherwise(own("v_parts"))))
    return rows.groupBy(*place, "rp", "vp").applyInArrow(_meet(threshold), "node long, n long, root long")


def near_copies(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99, key: str = "vec_id", vec: str = "embedding", label: str = "label",
                residents: int = RESIDENTS, visitors: int = VISITORS) -> DataFrame:
    """key, n_links, component_id and kept of every row.

    Rows of one label whose vectors have a cosine of at least ``threshold`` are linked:
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest key
    reachable, ``kept`` tells whether that is the row's own. Rows with a null label, or a
    vector that is null, empty, zero, or holds a null or non-finite component, link with
    nothing, nor do vectors of different lengths. Equal rows link with each other and keep one
    row each in the result; a null key is never the smallest and never kept. Other columns
    are not read. ``recall`` is the chance that a pair at the threshold is met; nearer pairs
    are met more surely, and none below the threshold is linked.
    """
    kind = vectors.schema[vec].dataType
    exact = kind if isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType)) else ArrayType(DoubleType())
    v = F.col(vec).cast(exact)
    usable = F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(usable, v).alias("vec"))
    grouped = rows.where("vec is not null").groupBy("label", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()))
    found = materialize(_found(nodes, threshold, recall, residents, visitors))
    tree = materialize(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    told = nodes.join(links, "node", "left").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = materialize(told.select("label", "vec", "root", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    low = told.groupBy("root").agg(F.min("low").alias("component_id"))
    told = told.join(low, "root").select("label", "vec", "n_links", "component_id")
    out = rows.join(told, ["label", "vec"], "left")
    linked = F.col("n_links").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
