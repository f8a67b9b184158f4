"""Overlap of polygons, and the polygon that each one lies in most.

Polygons are met through a grid: each stands in the cells of its bounding box, and a pair is worked out in one
cell only, the first that both boxes have. The area of an intersection needs no general clipping: a simple ring,
convex or not, is a sum of signed triangles from its first corner, so the intersection of two rings is the signed sum
of the intersections of their triangles, and those are convex.

Large polygons: a box of more than ``CELLS`` cells is put into a coarser grid, whose cells are as many times larger as it
needs; polygons of the finer grids go there as well, but only into the cells that hold such large ones.

Defined results: rings of fewer than three different corners, null rings and rings with a null corner have no area and
overlap nothing; a last corner equal to the first counts once; the direction of a ring does not matter; rings that only
touch do not overlap. Rings that cross themselves count parts that they wind around twice as often.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.resolve import written

Point = tuple[float, float]
#: Most cells in which a polygon stands.
CELLS = 64
#: Overlaps under this part of the smaller polygon are rounding, not overlap.
LEAST = 1e-9


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def triangles(ring: list[Point]) -> list[tuple[float, list[Point]]]:
    """The signed triangles of a ring, each turned to the left."""
    corners = [p for k, p in enumerate(ring) if p != ring[k - 1] or len(ring) == 1]
    out = []
    for a, b in zip(corners[1:], corners[2:], strict=False):
        turn = _cross(corners[0], a, b)
        if turn:
            out.append((1.0 if turn > 0 else -1.0, [corners[0], a, b] if turn > 0 else [corners[0], b, a]))
    return out


def _area(ring: list[Point]) -> float:
    return sum(_cross(ring[0], a, b) for a, b in zip(ring[1:], ring[2:], strict=False)) / 2


def _clipped(ring: list[Point], a: Point, b: Point) -> list[Point]:
    """What of a convex ring lies to the left of a-b."""
    out: list[Point] = []
    for k, q in enumerate(ring):
        p = ring[k - 1]
        at, to = _cross(a, b, p), _cross(a, b, q)
        if (at > 0) != (to > 0) and at != to:
            t = at / (at - to)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if to > 0:
            out.append(q)
    return out


def shared_area(one: list[Point], two: list[Point]) -> float:
    """The area of the intersection of two simple rings."""
    total, other = 0.0, triangles(two)
    for s, first in triangles(one):
        for t, second in other:
            piece = first
            for k in range(3):
                piece = _clipped(piece, second[k - 1], second[k]) if len(piece) > 2 else []
            if len(piece) > 2:
                total += s * t * _area(piece)
    return abs(total)


def _points(ring: list[dict] | None) -> list[Point]:
    return [(p["x"], p["y"]) for p in ring] if ring and all(p and p["x"] is not None and p["y"] is not None for p in ring) else []


def _areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared area of two rings, and each ring's own; both moved to the first one's corner, where little is lost."""
    for batch in batches:
        rows = []
        for a, b in zip(batch.column("ring_a").to_pylist(), batch.column("ring_b").to_pylist(), strict=True):
            one, two = _points(a), _points(b)
            if not one or not two:
                rows.append((0.0, 0.0, 0.0))
                continue
            x, y = one[0]
            one, two = ([(p - x, q - y) for p, q in r] for r in (one, two))
            rows.append((shared_area(one, two), *(abs(sum(s * _area(t) for s, t in triangles(r))) for r in (one, two))))
        columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], ["a", "b", "area", "area_a", "area_b"])


def _boxes(polygons: DataFrame, name: str, cell: float) -> DataFrame:
    values = lambda c: F.transform("ring", lambda v: v[c])
    lo, hi = (lambda c: F.floor(F.array_min(values(c)) / cell)), (lambda c: F.floor(F.array_max(values(c)) / cell))
    sound = polygons.filter((F.size("ring") > 2) & F.forall("ring", lambda v: v.isNotNull() & v["x"].isNotNull() & v["y"].isNotNull()))
    rows = sound.select(F.col("polygon_id").alias(name), F.col("ring").alias(f"ring_{name}"), lo("x").alias("lx"), hi("x").alias("hx"), lo("y").alias("ly"), hi("y").alias("hy"))
    side = F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly")) + 1
    return rows.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(side / CELLS**0.5))).cast("int"))


def _in_cells(boxes: DataFrame, level: Column, name: str) -> DataFrame:
    """A row for each cell of a level in which a box stands."""
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    rows = boxes.withColumn("at", level).select(name, f"ring_{name}", F.col("level").alias(f"level_{name}"), "at", at("lx").alias(f"lx_{name}"), at("hx").alias("hx"), at("ly").alias(f"ly_{name}"), at("hy").alias("hy"))
    rows = rows.withColumn("ci", F.explode(F.sequence(f"lx_{name}", "hx"))).withColumn("cj", F.explode(F.sequence(f"ly_{name}", "hy")))
    return rows.drop("hx", "hy")


def overlaps(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """a, b, area, area_a, area_b: the polygons (polygon_id, ring of x, y) that overlap, in square units of x and y."""
    a, b = written(_boxes(left, "a", cell)), written(_boxes(right, "b", cell))
    levels = sorted({r.level for r in a.select("level").union(b.select("level")).distinct().collect()})  # the logarithm of a size: few
    cells = None
    for k in levels:  # a pair meets at the higher of its two levels
        one, two = _in_cells(a.filter(F.col("level") <= k), F.lit(k), "a"), _in_cells(b.filter(F.col("level") <= k), F.lit(k), "b")
        met = one.join(two, ["at", "ci", "cj"]).filter((F.greatest("level_a", "level_b") == k) & (F.col("ci") == F.greatest("lx_a", "lx_b")) & (F.col("cj") == F.greatest("ly_a", "ly_b")))
        met = met.select("a", "b", "ring_a", "ring_b")
        cells = met if cells is None else cells.unionAll(met)
    kinds = [f"{n} {x.schema[n].dataType.simpleString()}" for n, x in (("a", a), ("b", b))]
    if cells is None:
        return left.sparkSession.createDataFrame([], f"{kinds[0]}, {kinds[1]}, area double, area_a double, area_b double")
    out = cells.mapInArrow(_areas, f"{kinds[0]}, {kinds[1]}, area double, area_a double, area_b double")
    return out.filter(F.col("area") > LEAST * F.least("area_a", "area_b"))


def _convex(ring: list[Point]) -> bool:
    """Whether a ring of different neighbours always turns to one side and goes around once."""
    steps = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    turns = [a[0] * b[1] - a[1] * b[0] for a, b in zip(steps, steps[1:] + steps[:1], strict=True)]
    right = [x > (0.0, 0.0) for x in steps]
    return (min(turns) >= 0 or max(turns) <= 0) and sum(x != y for x, y in zip(right, right[1:] + right[:1], strict=True)) == 2


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each ring's area, and how often it goes around a place at most: once, if it is convex."""
    for batch in batches:
        rows = []
        for ring in map(_points, batch.column("ring").to_pylist()):
            moved = [(p - ring[0][0], q - ring[0][1]) for p, q in ring]
            corners = [p for k, p in enumerate(moved) if p != moved[k - 1]]
            signs = triangles(moved)
            around = 1.0 if len(corners) > 2 and _convex(corners) else float(max(sum(s > 0 for s, _ in signs), sum(s < 0 for s, _ in signs)))
            rows.append((abs(sum(s * _area(t) for s, t in signs)), around))
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(2))], ["key", "own", "around"])


def _sized(polygons: DataFrame, name: str, cell: float) -> DataFrame:
    """The boxes of polygons with a key, the ends of each, its area and how often it goes around a place at most."""
    rows = written(_boxes(polygons, name, cell).withColumn("key", F.monotonically_increasing_id()))
    sizes = rows.select("key", F.col(f"ring_{name}").alias("ring")).mapInArrow(_sizes, "key long, own double, around double")
    ends = [f(F.col(f"ring_{name}").getField(c)).alias(f"{c}{k}") for c in "xy" for k, f in ((1, F.array_min), (2, F.array_max))]
    return written(rows.select("*", *ends).join(sizes, "key").filter("own > 0"))


def _may_share(a: DataFrame, b: DataFrame, levels: list[int], more: list[str]) -> DataFrame:
    """key_a, key_b, b, most: the pairs whose boxes overlap, and what part of a lies in b at most, to nine digits and
    rounded up by far less than one of them."""
    out = None
    kept = ["a", "b", "x1", "x2", "y1", "y2", "own", "around", "key"]
    for k in levels:
        sides = []
        for df, name in ((a, "a"), (b, "b")):
            at = lambda c, k=k: F.floor(F.col(c) / 2.0**k).cast("long")
            rows = df.filter(F.col("level") <= k).select("level", *[c for c in [*kept, *more] if c in df.columns], at("lx").alias("lx"), at("ly").alias("ly"), F.sequence(at("lx"), at("hx")).alias("_x"), F.sequence(at("ly"), at("hy")).alias("_y"))
            rows = rows.withColumn("ci", F.explode("_x")).withColumn("cj", F.explode("_y")).drop("_x", "_y")
            sides.append(rows.select("ci", "cj", *[F.col(c).alias(c if c in ("a", "b", *more) else f"{c}_{name}") for c in rows.columns if c not in ("ci", "cj")]))
        met = sides[0].join(sides[1], ["ci", "cj"]).filter((F.greatest("level_a", "level_b") == k) & (F.col("ci") == F.greatest("lx_a", "lx_b")) & (F.col("cj") == F.greatest("ly_a", "ly_b")))
        met = met.filter("x1_a < x2_b and x1_b < x2_a and y1_a < y2_b and y1_b < y2_a")
        out = met if out is None else out.unionAll(met)
    both = F.expr("(least(x2_a, x2_b) - greatest(x1_a, x1_b)) * (least(y2_a, y2_b) - greatest(y1_a, y1_b))")
    area = F.when((F.col("around_a") == 1) & (F.col("around_b") == 1), F.least(both, "own_a", "own_b")).otherwise(both * F.col("around_a") * F.col("around_b"))
    return out.select("key_a", "key_b", "b", *more, F.round(area / F.col("own_a") + 1e-11, 9).alias("most"))


def most_overlapped(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """a, b, area, share: for each left polygon the right one it overlaps most, the smaller id on ties (to nine digits of
    the share), and the part of it that lies there. Polygons without an overlap are left out.

    Boxes and areas tell what two polygons share at most, so areas are cut out only for the pair of each left polygon
    that may share most, and then for those that may share more than it does."""
    a, b = _sized(left, "a", cell), _sized(right, "b", cell)
    levels = sorted({r.level for r in a.select("level").union(b.select("level")).distinct().collect()})  # the logarithm of a size: few
    kinds = [f"{n} {x.schema[n].dataType.simpleString()}" for n, x in (("a", a), ("b", b))]
    if not levels:
        return left.sparkSession.createDataFrame([], f"{kinds[0]}, {kinds[1]}, area double, share double")

    def cut_out(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(a.select(F.col("key").alias("key_a"), "ring_a"), "key_a").join(b.select(F.col("key").alias("key_b"), "ring_b"), "key_b")
        rows = rows.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "ring_a", "ring_b").mapInArrow(_areas, "a long, b long, area double, area_a double, area_b double")
        rows = rows.filter(F.col("area") > LEAST * F.least("area_a", "area_b")).select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), "area", (F.col("area") / F.col("area_a")).alias("share"))
        return rows.join(b.select(F.col("key").alias("key_b"), "b"), "key_b")

    first = written(_may_share(a, b, levels, []).groupBy("key_a").agg(F.min_by(F.struct("key_b", "b"), F.struct(-F.col("most"), "b")).alias("f")).select("key_a", "f.key_b", F.col("f.b").alias("b_first")))
    best = written(cut_out(first.select("key_a", "key_b")))
    known = first.join(best.select("key_a", F.round("share", 9).alias("at_least")), "key_a", "left").select(F.col("key_a").alias("key"), F.col("key_b").alias("seen"), "b_first", F.coalesce("at_least", F.lit(-1.0)).alias("at_least"))
    rest = _may_share(written(a.join(known, "key")), b, levels, ["seen", "b_first", "at_least"]).filter("key_b <> seen and (most > at_least or most = at_least and b < b_first)")
    rows = best.unionByName(cut_out(written(rest.select("key_a", "key_b")))).join(a.select(F.col("key").alias("key_a"), "a"), "key_a")
    return rows.groupBy("a").agg(F.min_by(F.struct("b", "area", "share"), F.struct(-F.round("share", 9), "b")).alias("m")).select("a", "m.b", "m.area", "m.share")
