"""Packed spatial blocks for neighbour searches.

Spark has no spatial join: a distance condition becomes a nested loop over all
pairs. Here points are sorted along a Z-order curve and cut into blocks, each inside one
square of a quadtree and bounded in points whatever the density, so a crowded spot makes more
blocks rather than a bigger one. A block is one row that holds its points as arrays. Every
``FAN`` blocks form a node of the next level. Searches pair wide blocks of one side with nodes
of the other from the top down, as equi-joins on numeric node keys, and keep the pairs whose
bounding boxes can still matter. The remaining block pairs are sorted by searching block and
distance and streamed through numpy, so that a task holds one searching block at a time and
single points never go through a shuffle as rows.

Callers merge points at the same place first where they can, so piles of equal coordinates
do not meet each other pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from ..functions.lineage import materialize

#: Points of a block that is searched, and of one that searches.
BLOCK, SEARCH = 64, 1024
FAN = 16
#: Distances that a task holds at a time.
TILE = 1 << 18
SLACK = 1e-9  # bounding-box tests only prune when clear of rounding
BOX = ("x0", "x1", "y0", "y1")
_A = ("ablock", "ax0", "ax1", "ay0", "ay1")


def _spread16(c: Column) -> Column:
    """Bits of a 16-bit number moved to the even places: its binary digits read in base 4.

    Shifts and masks would name the number twice a step, 16 times in all, and code of that size is not compiled.
    """
    return F.conv(F.bin(c.cast("bigint")), 4, 10).cast("bigint")


def z_order(points: DataFrame) -> Column:
    """Z-order key of ``x, y`` on a 65536 x 65536 raster with square pixels over the extent of ``points``."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-300))
    b = box.select(F.struct("x0", "y0", side.alias("side"))).scalar()

    def scaled(c, lo):
        return F.least(F.floor((F.col(c) - lo) / b["side"] * 65536), F.lit(65535))
    return _spread16(scaled("x", b["x0"])).bitwiseOR(F.shiftleft(_spread16(scaled("y", b["y0"])), 1))


@dataclass
class Packed:
    """``blocks(leaf, by…, x[], y[], …[])``, ``leaves(g, node, leaf, box, n, sums)``, ``groups(by…, g)``.

    ``g`` numbers the groups, ``leaf`` the blocks and ``node`` the blocks without gaps.
    """

    blocks: DataFrame
    leaves: DataFrame
    groups: DataFrame
    by: tuple[str, ...]
    sums: tuple[str, ...]
    depth: int

    def level(self, n: int) -> DataFrame:
        """Nodes ``FAN**n`` blocks wide: ``g, node, leaf, box, n, sums…`` (``leaf`` names a block on level 0 only)."""
        if n == 0:
            return self.leaves
        node = F.floor(F.col("node") / FAN**n).cast("bigint")
        return self.leaves.groupBy("g", node.alias("node")).agg(
            F.min("leaf").alias("leaf"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
            F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in self.sums])


def _starts(z: np.ndarray, ends: np.ndarray, block: int, last: bool) -> tuple[list[int], int]:
    """Where blocks start among rows sorted by group and ``z``, and the row up to which they are settled.

    ``ends`` are the ends of the groups. A block takes what follows up to ``block`` rows, but not
    beyond the square of the quadtree in which it starts and that splits it.
    """
    starts, at, n = [], 0, len(z)
    for group in ends.tolist():
        while at < group:
            stop = min(at + block, group)
            if stop == n and not last:
                return starts, at  # what comes next may belong here
            first = int(z[at])
            apart = (first ^ int(z[stop - 1])).bit_length()
            if apart:
                shift = (apart - 1) // 2 * 2
                stop = at + int(np.searchsorted(z[at:stop], ((first >> shift) + 1) << shift))
            starts.append(at)
            at = stop
    return starts, n


def _cut(by: Sequence[str], sums: Sequence[str], block: int, names: Sequence[str], schema: pa.Schema):
    """Rows sorted by group and ``_z`` to one row per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId() << 33, 0, None
        for batch in _with_end(batches):
            if batch is None and held is None:
                return
            rows = held if batch is None else batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = rows.num_rows
            if not n:
                continue
            new = np.zeros(n - 1, bool)
            for c in by:
                col = rows.column(c)
                new |= np.asarray(pc.not_equal(col.slice(1), col.slice(0, n - 1)), bool)
            starts, done = _starts(np.asarray(rows.column("_z")), np.append(np.flatnonzero(new) + 1, n), block, batch is None)
            held = rows.slice(done) if done < n else None
            if not starts:
                continue
            x, y, s = np.asarray(rows.column("x"))[:done], np.asarray(rows.column("y"))[:done], np.array(starts)
            offsets = pa.array(np.append(s, done).astype(np.int32))
            out = {"leaf": pa.array(part + made + np.arange(len(s))), **{c: rows.column(c).take(pa.array(s)) for c in by},
                   "x0": np.minimum.reduceat(x, s), "x1": np.maximum.reduceat(x, s), "y0": np.minimum.reduceat(y, s), "y1": np.maximum.reduceat(y, s), "n": np.diff(np.append(s, done))}
            for c in sums:
                out[f"_sum_{c}"] = np.add.reduceat(np.asarray(pc.fill_null(rows.column(c), 0))[:done], s)
            for c in names:
                out[c] = pa.ListArray.from_arrays(offsets, rows.column(c).slice(0, done))
            made += len(s)
            yield pa.RecordBatch.from_pydict(out).cast(schema)
    return run


def _with_end(batches):
    yield from batches
    yield None


def pack(points: DataFrame, by: Sequence[str], sums: Sequence[str] = (), block: int = BLOCK) -> Packed:
    """Cut ``points(by…, x, y, …)`` into blocks; blocks never mix groups of ``by``.

    Points without finite coordinates or with a null in ``by`` take no part.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    points = points.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))
    for c in ("x", "y"):
        points = points.filter(F.abs(c) < F.lit(float("inf")))
    points = points.dropna(subset=list(by))
    names = [c for c in points.columns if c not in by]
    kinds = {f.name: f.dataType for f in points.schema}
    schema = StructType([StructField("leaf", LongType()), *[StructField(c, kinds[c]) for c in by], *[StructField(c, DoubleType()) for c in BOX], StructField("n", LongType()),
                         *[StructField(f"_sum_{c}", kinds[c]) for c in sums], *[StructField(c, ArrayType(kinds[c])) for c in names]])
    arrow = pa.schema([(f.name, f.type) for f in to_arrow_schema(schema)])
    order = [*by, "_z", "x", "y"]
    rows = points.withColumn("_z", z_order(points)).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = materialize(rows.mapInArrow(_cut(by, sums, block, names, arrow), schema))
    part = F.shiftright("leaf", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    placed = blocks.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    node = F.col("leaf") - F.shiftleft(F.col("_part"), 33) + F.col("_offset")
    leaves = placed.select(*by, "leaf", node.alias("node"), *BOX, "n", *[F.col(f"_sum_{c}").alias(c) for c in sums])
    groups = materialize(leaves.groupBy(*by).agg(F.min("node").alias("g")))
    leaves = materialize(leaves.join(groups, list(by)).select("g", "node", "leaf", *BOX, "n", *sums))
    total = (leaves.agg(F.max("node")).first()[0] or 0) + 1
    depth = 1
    while FAN**depth < total:
        depth += 1
    return Packed(blocks.select("leaf", *by, *names), leaves, groups, tuple(by), tuple(sums), depth)


def _box_pair(frame: DataFrame) -> DataFrame:
    """Add squared smallest and largest distance between the searching box and the node box."""
    def gap(lo, hi, n0, n1):
        return F.greatest(F.col(n0) - F.col(hi), F.col(lo) - F.col(n1), F.lit(0.0))

    def reach(lo, hi, n0, n1):
        return F.greatest(F.col(n1) - F.col(lo), F.col(hi) - F.col(n0))
    dx, dy = gap("ax0", "ax1", "x0", "x1"), gap("ay0", "ay1", "y0", "y1")
    fx, fy = reach("ax0", "ax1", "x0", "x1"), reach("ay0", "ay1", "y0", "y1")
    return frame.withColumn("near2", dx * dx + dy * dy).withColumn("far2", fx * fx + fy * fy)


def _roots(a: Packed, b: Packed, on: Sequence[str]) -> DataFrame:
    """Each searching block with the top node of every group that shares its ``on`` key."""
    reach = a.groups.select(*on, F.col("g").alias("ag")).join(b.groups.select(*on, "g"), list(on)).select("ag", "g")
    boxes = a.leaves.select(F.col("g").alias("ag"), F.col("leaf").alias("ablock"), *[F.col(c).alias(f"a{c}") for c in BOX])
    return boxes.join(reach, "ag").select("g", F.lit(0).cast("bigint").alias("node"), *_A)


def _descend(frontier: DataFrame, b: Packed, level: int) -> DataFrame:
    """Replace frontier nodes by their children on ``level`` with pair distances."""
    children = b.level(level).withColumn("parent", F.floor(F.col("node") / FAN).cast("bigint"))
    up = frontier.select("g", F.col("node").alias("parent"), *_A, *[c for c in ("ri", "r2") if c in frontier.columns])
    return _box_pair(up.join(children, ["g", "parent"]).drop("parent"))


def nearest_blocks(a: Packed, b: Packed, on: Sequence[str], k: int = 1) -> DataFrame:
    """Block pairs ``(g, ablock, bblock, near2)`` that hold the ``k`` nearest ``b`` points of any ``a`` point."""
    frontier = _roots(a, b, on)
    one = Window.partitionBy("ablock", "g")
    for level in range(b.depth - 1, -1, -1):
        f = _descend(frontier, b, level)
        if k == 1:
            limit = F.min("far2").over(one)
        else:
            # the boxes with the nearest far side that together hold k points bound the search
            f = f.withColumn("_have", F.sum("n").over(one.orderBy("far2").rangeBetween(Window.unboundedPreceding, 0)))
            limit = F.coalesce(F.min(F.when(F.col("_have") >= k, F.col("far2"))).over(one), F.lit(float("inf")))
        f = f.withColumn("_limit", limit).filter(F.col("near2") <= F.col("_limit") * (1 + SLACK))
        frontier = f.select("g", "node", *_A, "leaf", "near2")
    return frontier.select("g", "ablock", F.col("leaf").alias("bblock"), "near2")



def _element(p: Packed, c: str):
    """Type of a column of the points."""
    kind = p.blocks.schema[c].dataType
    return kind if c in p.by else kind.elementType


def _rows(pairs: DataFrame, a: Packed, b: Packed, a_id: Sequence[str], b_carry: Sequence[str], order: Sequence[str], more: DataFrame | None = None) -> DataFrame:
    """Searching blocks (kind 0), each followed by the rows ``more`` (kind 1) and the blocks of its pairs (kind 2) in ``order``."""
    own = a.blocks.select(F.lit(0).alias("kind"), F.col("leaf").alias("ablock"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), *[F.col(c).alias(f"a_id_{c}") for c in a_id])
    points = b.blocks.select(F.col("leaf").alias("bblock"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), *[F.col(c).alias(f"b_id_{c}") for c in b_carry])
    rows = own.unionByName(pairs.join(points, "bblock").withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if more is not None:
        rows = rows.unionByName(more.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return rows.repartition("ablock").sortWithinPartitions("ablock", "kind", *order)


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of rows that agree in all columns."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
    return ((i, j) for i, j in zip(cuts, cuts[1:]) if i < j)


class _Searching:
    """Points of a searching block."""

    def __init__(self, row: pa.RecordBatch, a_id: Sequence[str]):
        self.block = row.column("ablock")[0].as_py()
        self.x, self.y = (np.asarray(row.column(c)[0].values) for c in ("a_x", "a_y"))
        self.n = len(self.x)
        self.id = {c: row.column(f"a_id_{c}")[0] for c in a_id}

    def named(self, rows: np.ndarray) -> dict:
        """The caller's columns of these points."""
        return {c: v.values.take(pa.array(rows)) if isinstance(v, pa.ListScalar) else pa.array([v.as_py()] * len(rows), v.type) for c, v in self.id.items()}


class _Blocks:
    """Points of some blocks, laid end to end."""

    def __init__(self, rows: pa.RecordBatch, carry: Sequence[str]):
        self.x, self.y = (np.asarray(pc.list_flatten(rows.column(c))) for c in ("b_x", "b_y"))
        self.at = np.append(0, np.cumsum(np.asarray(pc.list_value_length(rows.column("b_x")))))
        self.carry = {c: pc.list_flatten(rows.column(f"b_id_{c}")) for c in carry}

    def steps(self, points: int) -> Iterator[tuple[int, slice]]:
        """First block and points of runs of blocks with about this many points."""
        i = 0
        while i < len(self.at) - 1:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + points, "right")) - 1)
            yield i, slice(int(self.at[i]), int(self.at[j]))
            i = j


def _squares(a: _Searching, b: _Blocks, cut: slice) -> np.ndarray:
    dx, dy = a.x[:, None] - b.x[cut], a.y[:, None] - b.y[cut]
    return dx * dx + dy * dy


def _streamed(batches: Iterator[pa.RecordBatch], a_id: Sequence[str]) -> Iterator[tuple[_Searching, int, pa.RecordBatch | None]]:
    """Each searching block, then again with the kind and rows that follow it."""
    a = None
    for batch in batches:
        kind, ablock = (np.asarray(batch.column(c)) for c in ("kind", "ablock"))
        for i, j in _runs(ablock, kind):
            if kind[i] == 0:
                a = _Searching(batch.slice(i, 1), a_id)
                yield a, 0, None
            else:
                yield a, int(kind[i]), batch.slice(i, j - i)


def _search(rows: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def out(batches):
        for columns in run(batches):
            yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in arrow}).cast(arrow)
    return rows.mapInArrow(out, schema)


def _with_groups(rows: DataFrame, b: Packed, on: Sequence[str], a_id: Sequence[str]) -> DataFrame:
    """Group numbers back to the groups' keys."""
    groups = [c for c in b.by if c not in on]
    clash = set(groups) & set(a_id)
    if clash:
        raise ValueError(f"rename {clash}: used by both sides")
    return rows.join(b.groups.select("g", *groups), "g").drop("g")


def _sort_key(v):
    return (v is not None, v)


def nearest(a: Packed, b: Packed, on: Sequence[str], a_id: Sequence[str], b_carry: Sequence[str] = ()) -> DataFrame:
    """``(a_id…, by of b…, d[, b_carry…])``: distance from each ``a`` point to the nearest ``b`` point of every group.

    Ties go to the smallest carried values.
    """
    def nearer(p: _Searching, blocks: _Blocks, near2: np.ndarray, best: np.ndarray, carried: list) -> None:
        for first, cut in blocks.steps(max(1, TILE // p.n)):
            if near2[first] > best.max() * (1 + SLACK):
                return
            d2 = _squares(p, blocks, cut)
            least = d2.min(axis=1)
            if b_carry:
                values = list(zip(*(blocks.carry[c].slice(cut.start, cut.stop - cut.start).to_pylist() for c in b_carry)))
                order = sorted(range(len(values)), key=lambda i: [_sort_key(v) for v in values[i]])
                at = np.array(order)[d2[:, order].argmin(axis=1)]
                for i in np.flatnonzero(least <= best).tolist():
                    new = values[at[i]]
                    if least[i] < best[i] or [_sort_key(v) for v in new] < [_sort_key(v) for v in carried[i]]:
                        carried[i] = new
            np.minimum(best, least, out=best)

    def run(batches):
        p = g = best = None
        carried: list = []

        def result():
            return {**p.named(np.arange(p.n)), "g": np.full(p.n, g), "d": np.sqrt(best), **dict(zip(b_carry, map(list, zip(*carried)) if b_carry else ()))}
        for a_now, kind, rows in _streamed(batches, a_id):
            if kind == 0:
                if best is not None:
                    yield result()
                p, best = a_now, None
                continue
            groups, near2 = np.asarray(rows.column("g")), np.asarray(rows.column("near2"))
            for i, j in _runs(groups):
                if best is None or g != groups[i]:
                    if best is not None:
                        yield result()
                    g, best, carried = groups[i], np.full(p.n, np.inf), [None] * p.n
                nearer(p, _Blocks(rows.slice(i, j - i), b_carry), near2[i:j], best, carried)
        if best is not None:
            yield result()
    schema = StructType([*[StructField(c, _element(a, c)) for c in a_id], StructField("g", LongType()), StructField("d", DoubleType()), *[StructField(c, _element(b, c)) for c in b_carry]])
    rows = _rows(nearest_blocks(a, b, on), a, b, a_id, b_carry, ["g", "near2"])
    return _with_groups(_search(rows, run, schema), b, on, a_id)


def k_nearest(p: Packed, on: Sequence[str], id_: str, k: int, carry: Sequence[str] = ()) -> DataFrame:
    """``(on…, id, near_id, rank, d, carry…)`` for the ``k`` nearest other points of each point of ``p``, packed by ``on``.

    Ties go to the smaller id.
    """
    if set(p.by) != set(on):
        raise ValueError("points must be packed by the key that they are searched in")
    wanted = [id_, *carry]

    def run(batches):
        a = d2 = ids = None
        found: dict = {}

        def result():
            at, col = np.nonzero(np.isfinite(d2))
            return {**a.named(at), f"near_{id_}": ids[at, col], "rank": col + 1, "d": np.sqrt(d2[at, col]),
                    **{c: pa.array(found[c][at, col].tolist()) if found[c].dtype == object else found[c][at, col] for c in carry}}
        for a_now, kind, rows in _streamed(batches, [*on, id_]):
            if kind == 0:
                if d2 is not None:
                    yield result()
                a, d2 = a_now, None
                continue
            blocks, near2, names = _Blocks(rows, wanted), np.asarray(rows.column("near2")), np.asarray(rows.column("bblock"))
            other = blocks.carry[id_].to_numpy(zero_copy_only=False)
            if other.dtype == object:
                other = other.astype(str)
            if d2 is None:
                d2, ids = np.full((a.n, k), np.inf), np.zeros((a.n, k), other.dtype)
                found = {c: np.zeros((a.n, k), blocks.carry[c].to_numpy(zero_copy_only=False).dtype) for c in carry}
            if other.dtype.kind == "U" and other.dtype != ids.dtype:
                ids = ids.astype(np.promote_types(ids.dtype, other.dtype))
            for i, cut in blocks.steps(1):
                if near2[i] > d2[:, -1].max() * (1 + SLACK):
                    break
                new = _squares(a, blocks, cut)
                if names[i] == a.block:
                    np.fill_diagonal(new, np.inf)
                at = np.flatnonzero((new <= d2[:, -1:]).any(axis=1))
                if not len(at):
                    continue
                new = np.concatenate([d2[at], new[at]], axis=1)
                both = np.concatenate([ids[at], np.broadcast_to(other[cut], (len(at), cut.stop - cut.start))], axis=1)
                best = np.lexsort((both, new), axis=1)[:, :k]
                d2[at], ids[at] = np.take_along_axis(new, best, 1), np.take_along_axis(both, best, 1)
                for c in carry:
                    value = blocks.carry[c].to_numpy(zero_copy_only=False)[cut]
                    value = np.concatenate([found[c][at], np.broadcast_to(value, (len(at), len(value)))], axis=1)
                    found[c][at] = np.take_along_axis(value, best, 1)
        if d2 is not None:
            yield result()
    schema = StructType([*[StructField(c, _element(p, c)) for c in (*on, id_)], StructField(f"near_{id_}", _element(p, id_)), StructField("rank", IntegerType()), StructField("d", DoubleType()),
                         *[StructField(c, _element(p, c)) for c in carry]])
    return _search(_rows(nearest_blocks(p, p, on, k + 1), p, p, [*on, id_], wanted, ["near2"]), run, schema)


def radius_pairs(a: Packed, b: Packed, on: Sequence[str], r: float, a_id: Sequence[str], b_carry: Sequence[str]) -> DataFrame:
    """``(a_id…, by of b…, b_carry…, d)`` for points no further apart than ``r``.

    The output is the pairs; they leave the task that finds them as they are and are not shuffled.
    """
    frontier = _roots(a, b, on)
    for level in range(b.depth - 1, -1, -1):
        frontier = _descend(frontier, b, level).filter(F.col("near2") <= r * r * (1 + SLACK)).select("g", "node", *_A, "leaf")

    def run(batches):
        for p, kind, rows in _streamed(batches, a_id):
            if kind == 0:
                continue
            blocks, g = _Blocks(rows, b_carry), np.asarray(rows.column("g"))
            for _, cut in blocks.steps(max(1, TILE // p.n)):
                d2 = _squares(p, blocks, cut)
                i, j = np.nonzero(np.sqrt(d2) <= r)
                if len(i):
                    at = j + cut.start
                    yield {**p.named(i), "g": g[np.searchsorted(blocks.at, at, "right") - 1], **{f"b_{c}": blocks.carry[c].take(pa.array(at)) for c in b_carry}, "d": np.sqrt(d2[i, j])}
    schema = StructType([*[StructField(c, _element(a, c)) for c in a_id], StructField("g", LongType()), *[StructField(f"b_{c}", _element(b, c)) for c in b_carry], StructField("d", DoubleType())])
    pairs = frontier.select("g", "ablock", F.col("leaf").alias("bblock"))
    return _with_groups(_search(_rows(pairs, a, b, a_id, b_carry, []), run, schema), b, on, a_id)


def circle_sums(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, values: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and what to add to them: in all the sums of ``values`` of the ``b`` points within ``r``."""
    width, height = (float(v.max() - v.min()) for v in (bx, by))
    if width * 64 < height:  # strips along a line would hold a point each
        ax, ay, bx, by, width, height = ay, ax, by, bx, height, width
    a_order, b_order = np.lexsort((ax, ay)), np.argsort(by, kind="stable")
    ax, ay, by = ax[a_order], ay[a_order], by[b_order]
    each = max(16, int(2 * (len(bx) * width / height) ** 0.5)) if height else len(bx)
    starts = np.unique(np.searchsorted(by, by[::each]))
    bx, values = bx[b_order], values[b_order]
    slack = 8 * np.spacing(max(np.abs(ax).max(), np.abs(bx).max(), np.abs(by).max(), r))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(bx)]):
        low, high = by[i], by[j - 1]
        first, last = (int(np.searchsorted(ay, v, side)) for v, side in ((low - r - slack, "left"), (high + r + slack, "right")))
        if first == last:
            continue
        order = i + np.argsort(bx[i:j], kind="stable")
        x, y, held = bx[order], by[order], values[order]
        running = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(held, axis=0)])
        for at in range(first, last, TILE):
            px, py = ax[at:min(at + TILE, last)], ay[at:min(at + TILE, last)]
            near, far = np.maximum(np.maximum(low - py, py - high), 0), np.maximum(high - py, py - low)
            most = np.sqrt(np.maximum(r * r * (1 + SLACK) - near * near, 0)) + slack
            if low == high:  # inside is a run, and only rounding can move its ends
                begin, end = np.searchsorted(x, px - most), np.searchsorted(x, px + most, "right")
                dy2 = (py - low) ** 2
                for bound, step, move in ((begin, 0, 1), (end, -1, -1)):
                    open_ = np.flatnonzero(begin < end)
                    while len(open_):
                        dx = px[open_] - x[bound[open_] + step]
                        open_ = open_[np.sqrt(dx * dx + dy2[open_]) > r]
                        bound[open_] += move
                        open_ = open_[begin[open_] < end[open_]]
                yield a_order[at:at + len(px)], running[end] - running[begin]
                continue
            least = np.sqrt(np.maximum(r * r * (1 - SLACK) - far * far, 0)) - slack
            begin, end = np.searchsorted(x, px - most), np.searchsorted(x, px + most, "right")
            sure, until = np.searchsorted(x, px - least), np.searchsorted(x, px + least, "right")
            sure = np.where(least > 0, np.clip(sure, begin, end), end)
            until = np.where(least > 0, np.clip(until, sure, end), end)
            found = running[until] - running[sure]
            for lo, hi in ((begin, sure), (until, end)):
                some = np.flatnonzero(hi > lo)
                ends = np.cumsum(hi[some] - lo[some])
                cut = 0
                while cut < len(some):
                    before = int(ends[cut - 1]) if cut else 0
                    stop = max(cut + 1, int(np.searchsorted(ends, before + 4 * TILE, "right")))
                    own = some[cut:stop]
                    n = hi[own] - lo[own]
                    point = np.repeat(own, n)
                    other = np.arange(int(n.sum())) + np.repeat(lo[own] - (np.cumsum(n) - n), n)
                    dx, dy = px[point] - x[other], py[point] - y[other]
                    inside = np.sqrt(dx * dx + dy * dy) <= r
                    point, other = point[inside], other[inside]
                    for k in range(values.shape[1]):
                        found[:, k] += np.bincount(point, held[other, k], len(px))
                    cut = stop
            yield a_order[at:at + len(px)], found


def radius_sums(a: Packed, b: Packed, on: Sequence[str], a_id: Sequence[str], radii: Sequence[float]) -> DataFrame:
    """Sums of ``b.sums`` over the ``b`` points within each radius of each ``a`` point.

    A node wholly inside the circles of a whole searching block adds its stored sums at
    once. The others are cut into strips along y and sorted by x in each: what a circle holds of a
    strip is a run whose sum is the difference of two running totals, and only points between the
    nearest and the farthest edge of the strip are compared one by one. Where places stand on
    rows, as days do, a strip is a row and hardly any is compared.
    """
    sums, radii = list(b.sums), [float(r) for r in radii]
    table = F.array(*[F.struct(F.lit(i).alias("ri"), F.lit(r * r).alias("r2")) for i, r in enumerate(radii)])
    frontier = _roots(a, b, on).select("*", F.explode(table).alias("_r")).select("g", "node", *_A, "_r.ri", "_r.r2")
    parts = []
    for level in range(b.depth - 1, -1, -1):
        f = _descend(frontier, b, level).filter(F.col("near2") <= F.col("r2") * (1 + SLACK))
        if level == 0:
            f = materialize(f)  # the largest step, read by both branches below
        inside = F.col("far2") <= F.col("r2") * (1 - SLACK)
        parts.append(f.filter(inside).select("g", "ri", "ablock", "n", *sums))
        frontier = f.filter(~inside).select("g", "node", *_A, "ri", "r2", "leaf")
    core = parts[0]
    for p in parts[1:]:
        core = core.unionByName(p)
    core = core.groupBy("ablock", "g", "ri").agg(F.sum("n").alias("n"), *[F.sum(s).alias(f"s_{s}") for s in sums])
    whole_numbers = [0, *[i + 1 for i, s in enumerate(sums) if not isinstance(_element(b, s), (DoubleType, FloatType))]]
    fractions = [i for i in range(len(sums) + 1) if i not in whole_numbers]

    def add(total, exact, at, values):
        """Sums of floats, and of whole numbers beside them as such."""
        total[at] += values
        exact[at] += np.rint(values[..., whole_numbers]).astype(np.int64)

    def rim(p, blocks, r, total, exact):
        values = np.column_stack([np.ones(len(blocks.x)), *[np.asarray(pc.fill_null(blocks.carry[s], 0), float) for s in sums]])
        for at, found in circle_sums(p.x, p.y, blocks.x, blocks.y, values, r):
            add(total, exact, at, found)

    def run(batches):
        p, held = None, {}

        def results():
            for (g, ri), (total, exact) in held.items():
                at = np.flatnonzero(exact[:, 0] > 0)
                if len(at):
                    columns = {**{i: total[at, i] for i in fractions}, **{i: exact[at, k] for k, i in enumerate(whole_numbers)}}
                    yield {**p.named(at), "g": np.full(len(at), g), "radius": np.full(len(at), radii[ri]), **{s: columns[i + 1] for i, s in enumerate(sums)}}
        for now, kind, rows in _streamed(batches, a_id):
            if kind == 0:
                yield from results()
                p, held = now, {}
                continue
            g, ri = (np.asarray(rows.column(c)) for c in ("g", "ri"))
            for i, j in _runs(g, ri):
                total, exact = held.setdefault((int(g[i]), int(ri[i])), (np.zeros((p.n, len(sums) + 1)), np.zeros((p.n, len(whole_numbers)), np.int64)))
                part = rows.slice(i, j - i)
                if kind == 1:
                    columns = [np.asarray(pc.fill_null(part.column(c), 0)) for c in ("n", *[f"s_{s}" for s in sums])]
                    total += np.array([c.sum() for c in columns], float)
                    exact += np.array([columns[k].sum() for k in whole_numbers], np.int64)
                else:
                    rim(p, _Blocks(part, sums), radii[ri[i]], total, exact)
        yield from results()
    kinds = [StructField(s, DoubleType() if i + 1 in fractions else LongType()) for i, s in enumerate(sums)]
    schema = StructType([*[StructField(c, _element(a, c)) for c in a_id], StructField("g", LongType()), StructField("radius", DoubleType()), *kinds])
    pairs = frontier.select("g", "ri", "ablock", F.col("leaf").alias("bblock"))
    return _with_groups(_search(_rows(pairs, a, b, a_id, sums, ["g", "ri", "bblock"], more=core), run, schema), b, on, a_id)
