"""Connected components, holes and morphology of sparse masks.

A mask is the table of its set pixels ``(keys…, ix, iy)``; ``keys`` may hold many
slides and layers, all handled in one job. Components work on row runs, which are
far fewer than pixels, and merge labels by star contraction, whose number of rounds
grows with the logarithm of the component size (a spiral is no worse than a blob).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.lineage import materialize


def diamond(n: int) -> list[tuple[int, int]]:
    """Offsets reached by ``n`` steps between 4-neighbours."""
    return [(dx, dy) for dx in range(-n, n + 1) for dy in range(-n, n + 1) if abs(dx) + abs(dy) <= n]


def inside(width: int, height: int) -> Column:
    return F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1)


def _spread(mask: DataFrame, keys: Sequence[str], offsets) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    return (mask.select(*keys, "ix", "iy", F.explode(steps).alias("o"))
            .select(*keys, (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy")))


def dilate(mask: DataFrame, keys: Sequence[str], n: int, width: int, height: int) -> DataFrame:
    return _spread(mask, keys, diamond(n)).filter(inside(width, height)).distinct()


def erode(mask: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Pixels whose whole diamond is set; outside the grid nothing is."""
    ball = diamond(n)
    return _spread(mask, keys, ball).groupBy(*keys, "ix", "iy").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(ball)).drop("_n")


def binary_close(mask: DataFrame, keys: Sequence[str], n: int, width: int, height: int) -> DataFrame:
    return erode(dilate(mask, keys, n, width, height), keys, n) if n > 0 else mask


def binary_open(mask: DataFrame, keys: Sequence[str], n: int, width: int, height: int) -> DataFrame:
    return dilate(erode(mask, keys, n), keys, n, width, height) if n > 0 else mask


def row_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs ``(keys…, iy, x0, x1)``; a window never holds more than one grid row."""
    w = Window.partitionBy(*keys, "iy").orderBy("ix")
    island = F.col("ix") - F.row_number().over(w)
    return (mask.select(*keys, "iy", "ix", island.alias("_g")).groupBy(*keys, "iy", "_g")
            .agg(F.min("ix").alias("x0"), F.max("ix").alias("x1")).drop("_g"))


def background_runs(runs: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Runs of unset pixels of every layer that has a set pixel."""
    rows = runs.select(*keys).distinct().withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    marks = (runs.select(*keys, "iy", "x0", "x1")
             .unionByName(rows.select(*keys, "iy", F.lit(-1).alias("x0"), F.lit(-1).alias("x1")))
             .unionByName(rows.select(*keys, "iy", F.lit(width).alias("x0"), F.lit(width).alias("x1"))))
    w = Window.partitionBy(*keys, "iy").orderBy("x0")
    gaps = marks.select(*keys, "iy", (F.lag("x1").over(w) + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    return gaps.filter("x0 <= x1")


def connected_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, u, root)`` for every node that has an edge ``(keys…, u, v)``; root is the smallest node reached.

    Large-star and small-star steps alternate until the edges stop changing. Each is an
    aggregate and an equi-join: no neighbour list is ever gathered. Every round is
    written to the shared folder, so lost executors cost one round at most.
    """
    k = list(keys)
    current = materialize(edges.filter("u <> v").select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = current.unionByName(current.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*k, "u").agg(F.min("v").alias("_m")).select(*k, "u", F.least("u", "_m").alias("m"))
        large = both.join(low, [*k, "u"]).filter("v > u").select(*k, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = (large.join(low, [*k, "u"]).filter("v <> m").select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select(*k, "u", F.col("m").alias("v"))).distinct())
        current = materialize(small)
        mark = tuple(current.agg(F.count("*"), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    root = current.withColumnRenamed("v", "root")
    roots = root.select(*k, F.col("root").alias("u"), "root").distinct()
    return root.unionByName(roots)


STRIP_PIXELS = 65536  # size limit of the part of a grid that one task labels


def _join_strips(runs: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Add ``local``: the first run connected to a run inside its strip of ``rows`` grid rows.

    A strip has at most ``STRIP_PIXELS`` pixels, however large the grid or skewed the keys.
    """
    def label(pdf):
        import numpy as np
        pdf = pdf.sort_values(["iy", "x0"], ignore_index=True)
        y, x0, x1 = (pdf[c].to_numpy() for c in ("iy", "x0", "x1"))
        parent = list(range(len(pdf)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i
        above = 0  # first run of the row above that may still overlap
        for i in range(len(pdf)):
            while above < i and (y[above] < y[i] - 1 or (y[above] == y[i] - 1 and x1[above] < x0[i])):
                above += 1
            j = above
            while j < i and y[j] == y[i] - 1 and x0[j] <= x1[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
                j += 1
        first = np.array([find(i) for i in range(len(pdf))], dtype="int64")
        return pdf.assign(local=pdf["run"].to_numpy()[first])

    out = runs.withColumn("_strip", F.floor(F.col("iy") / rows))
    schema = T.StructType([*out.schema.fields, T.StructField("local", T.LongType())])
    return out.groupBy(*keys, "_strip").applyInPandas(label, schema).drop("_strip")


def label_runs(runs: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Runs with ``component``: the grid position of the first pixel of their component.

    Strips of bounded size are labelled inside tasks; only components meeting at a strip
    border are merged across tasks.
    """
    rows = max(1, STRIP_PIXELS // width)
    runs = runs.withColumn("run", (F.col("iy") * width + F.col("x0")).cast("bigint"))
    runs = materialize(_join_strips(runs, keys, rows))
    lower = runs.filter(F.pmod("iy", F.lit(rows)) == 0).select(
        *keys, (F.col("iy") - 1).alias("iy"), F.col("x0").alias("_b0"), F.col("x1").alias("_b1"), F.col("local").alias("v"))
    upper = runs.filter(F.pmod("iy", F.lit(rows)) == rows - 1)
    edges = materialize(upper.join(lower, [*keys, "iy"]).filter("x0 <= _b1 AND _b0 <= x1").select(*keys, F.col("local").alias("u"), "v").distinct())
    runs = runs.drop("run")
    if edges.isEmpty():
        return runs.withColumnRenamed("local", "component")
    roots = connected_components(edges, keys).withColumnRenamed("u", "local")
    return runs.join(roots, [*keys, "local"], "left").withColumn("component", F.coalesce("root", "local")).drop("root", "local")


def run_pixels(runs: DataFrame) -> DataFrame:
    """Runs back to pixels."""
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*rest, F.explode(F.sequence("x0", "x1")).alias("ix"))


def label_components(mask: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pixels with their 4-connected ``component``."""
    return run_pixels(label_runs(row_runs(mask, keys), keys, width))


def fill_holes(mask: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Add background components that do not touch the border of the grid."""
    runs = materialize(row_runs(mask, keys))
    gaps = label_runs(background_runs(runs, keys, width, height), keys, width)
    border = F.col("iy").isin(0, height - 1) | (F.col("x0") == 0) | (F.col("x1") == width - 1)
    open_ = gaps.filter(border).select(*keys, "component").distinct()
    holes = gaps.join(open_, [*keys, "component"], "left_anti").select(*keys, "iy", "x0", "x1")
    return run_pixels(runs.unionByName(holes)).select(*keys, "ix", "iy")


def component_sizes(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))


def remove_small_components(mask: DataFrame, keys: Sequence[str], min_pixels: int, width: int) -> DataFrame:
    runs = label_runs(row_runs(mask, keys), keys, width)
    keep = component_sizes(runs, keys).filter(F.col("pixels") >= min_pixels).drop("pixels")
    return run_pixels(runs.join(keep, [*keys, "component"], "left_semi")).select(*keys, "ix", "iy")


def clean_mask(mask: DataFrame, keys: Sequence[str], width: int, height: int, closing: int, opening: int, fill: bool,
               min_pixels: int) -> DataFrame:
    """Close, open, fill holes, drop small components."""
    m = binary_open(binary_close(mask, keys, closing, width, height), keys, opening, width, height)
    if fill:
        m = fill_holes(m, keys, width, height)
    return remove_small_components(m, keys, min_pixels, width)


# Sides of a pixel walked with the inside on the left: name, outward step, walking step.
_SIDES = ((0, (1, 0), (0, 1)), (1, (0, 1), (-1, 0)), (2, (-1, 0), (0, -1)), (3, (0, -1), (1, 0)))


def boundary_sides(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Directed boundary sides ``(keys…, side, next, x, y)`` in pixel units.

    Each pixel hears from its eight neighbours in one shuffle; which sides are open and
    where the walk goes next is then local. Pixels touching only at a corner are apart.
    """
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    bit = {d: 1 << i for i, d in enumerate(around)}
    # a pixel at offset -d from its neighbour's view sets the neighbour's bit d
    steps = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(bit[(dx, dy)]).alias("b")) for dx, dy in around])
    near = (mask.select(*keys, "ix", "iy", F.explode(steps).alias("o"))
            .select(*keys, (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), "o.b")
            .groupBy(*keys, "ix", "iy").agg(F.sum("b").cast("int").alias("m")).filter(F.col("m").bitwiseAND(bit[(0, 0)]) != 0))

    def has(d):
        return F.col("m").bitwiseAND(bit[d]) != 0

    def side_id(ix, iy, s):
        return F.struct(ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), F.lit(s).alias("s"))
    out = []
    for s, (ox, oy), (wx, wy) in _SIDES:
        ahead, corner = (wx, wy), (wx + ox, wy + oy)
        left, right = (s + 1) % 4, (s + 3) % 4
        nxt = (F.when(~has(ahead), side_id(F.col("ix"), F.col("iy"), left))
               .when(~has(corner), side_id(F.col("ix") + wx, F.col("iy") + wy, s))
               .otherwise(side_id(F.col("ix") + corner[0], F.col("iy") + corner[1], right)))
        out.append(F.when(~has((ox, oy)), F.struct(side_id(F.col("ix"), F.col("iy"), s).alias("side"), nxt.alias("next"),
                                                   (F.col("ix") + 0.5 + ox / 2).alias("x"), (F.col("iy") + 0.5 + oy / 2).alias("y"))))
    return near.select(*keys, F.explode(F.array_compact(F.array(*out))).alias("e")).select(*keys, "e.side", "e.next", "e.x", "e.y")


def _code(side: Column, width: int) -> Column:
    return ((side["iy"].cast("bigint") * width + side["ix"]) * 4 + side["s"]).cast("bigint")


def trace_rings(mask: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Boundary vertices in walking order: ``(keys…, ring, seq, x, y)``, ``ring`` the smallest side on it.

    A ring is a linked list over sides. Doubling the reach of every side each round
    finds the ring's first side and the distance to it in about log2(length) joins,
    however long the ring is.
    """
    k = list(keys)
    sides = boundary_sides(mask, k).select(*k, _code(F.col("side"), width).alias("e"), _code(F.col("next"), width).alias("nxt"), "x", "y")
    sides = materialize(sides)
    state = sides.select(*k, "e", "nxt", F.col("e").alias("low"), F.lit(0).cast("bigint").alias("off"))
    reach = 1
    while True:
        other = state.select(*k, F.col("e").alias("nxt"), F.col("nxt").alias("_nxt"), F.col("low").alias("_low"), F.col("off").alias("_off"))
        step = state.join(other, [*k, "nxt"])
        better = F.col("_low") < F.col("low")
        state = materialize(step.select(*k, "e", F.col("_nxt").alias("nxt"), F.when(better, F.col("_low")).otherwise(F.col("low")).alias("low"),
                                        F.when(better, F.col("_off") + reach).otherwise(F.col("off")).alias("off"), better.alias("moved")))
        reach *= 2
        if state.filter("moved").isEmpty():
            break
    length = state.groupBy(*k, "low").agg(F.count("*").alias("_len"))
    seq = F.pmod(F.col("_len") - F.col("off"), F.col("_len"))
    return (sides.drop("nxt").join(state.select(*k, "e", "low", "off"), [*k, "e"]).join(length, [*k, "low"])
            .select(*k, F.col("low").alias("ring"), seq.alias("seq"), "x", "y"))
