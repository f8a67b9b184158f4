"""Entity resolution: edges from shared attributes, components, spatial and fuzzy joins, diffs, state."""

from __future__ import annotations

import math
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import alike, inside

_own: list[str] = []
EARTH_M = 6_371_000.0


def new_folder(spark: SparkSession) -> str:
    """A folder of the shared one that ``spark.checkpoint.dir`` names, that nobody else has."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-"))
        base = _own[0]
    return posixpath.join(base, f"step-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder ``spark.checkpoint.dir``, its lineage cut."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later step reads."""
    spark = df.sparkSession
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def star_edges(rows: DataFrame, key: str, item: str, cap: int | None = None, capped: str | None = None) -> DataFrame:
    """Edges from the smallest item of each key to its others; keys of ``cap`` or more items, or else
    different values of ``capped``, link nothing."""
    counts = [F.min(item).alias("a"), F.count_distinct(item).alias("_members"), F.count_distinct(capped or item).alias("_capped")]
    centre = rows.groupBy(key).agg(*counts).filter("_members > 1")
    if cap is not None:
        centre = centre.filter(F.col("_capped") < cap)
    return rows.join(centre, key).select("a", F.col(item).alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) by minimum labels and pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(now.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = now.join(near, "id").select("id", "component", F.least("component", "c").alias("to"))
        jump = now.select(F.col("id").alias("to"), F.col("component").alias("far"))
        step = written(step.join(jump, "to").select("id", F.col("component").alias("was"), F.least("to", "far").alias("component")))
        dropped(now)
        now = step.select("id", "component")
        if step.filter("was <> component").isEmpty():
            dropped(both)
            return now


def components_after(edges: DataFrame, now: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, components) after edges (a, b) were removed and added, from the edges and the components (id, component)
    before. An edge that is removed and added is there; removing what is not there does nothing.

    Only components with an end of a changed edge are made anew, from their own edges; all others are carried over as
    they are, so the work grows with the components that are touched. A component that falls apart gives several, and
    ids without an edge have none, as in ``components``.
    """
    tidy = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropna().filter("a <> b").distinct()
    old, gone, fresh = tidy(edges), tidy(removed), tidy(added)
    ends = gone.union(fresh).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    touched = written(ends.join(now, "id").select("component").distinct())
    members = written(now.join(touched, "component", "left_semi").select("id"))
    own = old.join(members.withColumnRenamed("id", "a"), "a", "left_semi")  # both ends of an edge are in one component
    left = own.join(gone, ["a", "b"], "left_anti").union(fresh).distinct()
    anew = components(left)
    after = now.join(touched, "component", "left_anti").select("id", "component").unionByName(anew)
    return old.join(gone, ["a", "b"], "left_anti").union(fresh).distinct(), after


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def _nearest(metres: float):
    """Of packs of two cells, for each point of the first its nearest one of the second within ``metres``, and how many
    there are. Points of a pack are in the order of their ids."""
    high = metres / (EARTH_M * math.radians(1)) * 1.001

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                probes, builds = (batch.column(n).slice(k, 1).flatten() for n in ("probes", "builds"))
                (a, alat, alng), (b, blat, blng) = ([np.array(p.field(c).to_pylist()) for c in ("id", "lat", "lng")] for p in (probes, builds))
                order, found = np.argsort(alat), []
                for at in np.split(order, range(64, len(order), 64)):
                    of = np.flatnonzero((blat >= alat[at[0]] - high) & (blat <= alat[at[-1]] + high))
                    if len(of):
                        d = _metres(alat[at, None], alng[at, None], blat[of], blng[of])
                        near = (d <= metres) & (a[at, None] != b[of])
                        d = np.where(near, d, np.inf)
                        j, n = d.argmin(1), near.sum(1)
                        met = n > 0
                        found.append((at[met], of[j[met]], d[np.arange(len(at)), j][met], n[met]))
                if found:
                    p, q, d, n = (np.concatenate([f[c] for f in found]) for c in range(4))
                    yield pa.RecordBatch.from_arrays([probes.field("id").take(pa.array(p)), builds.field("id").take(pa.array(q)), pa.array(d, pa.float64()), pa.array(n, pa.int64())], ["probe_id", "build_id", "d", "n"])

    return run


def nearest_within(probe: DataFrame, build: DataFrame, metres: float, max_lat: float = 60.0) -> DataFrame:
    """For each probe row its nearest build row within ``metres``, and how many others there are. Both sides
    have id, lat, lng, up to ``max_lat`` degrees north or south; ties go to the smaller id.

    Points meet in packs of a cell and the cells around it, as wide as ``metres`` at ``max_lat``; no row is made for a
    pair, only for each point and pack that it meets."""
    cell = metres / (111_000 * math.cos(math.radians(max_lat)))
    at = lambda c: F.floor(F.col(c) / cell)
    packs = lambda df, name: _packed(df.select("id", "lat", "lng", at("lat").alias("ci"), at("lng").alias("cj")).dropna(), ["ci", "cj"], POINTS, F.struct("id", "lat", "lng"), "id", name)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = packs(probe, "probes").withColumn("step", F.explode(around)).select("probes", (F.col("ci") + F.col("step.i")).alias("ci"), (F.col("cj") + F.col("step.j")).alias("cj"))
    tasks = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{n} {df.schema['id'].dataType.simpleString()}" for n, df in (("probe_id", probe), ("build_id", build)))
    met = p.join(packs(build, "builds"), ["ci", "cj"]).select("probes", "builds").repartition(tasks).mapInArrow(_nearest(metres), f"{kinds}, d double, n long")
    best = met.groupBy("probe_id").agg(F.min_by("build_id", F.struct("d", "build_id")).alias("build_id"), F.min("d").alias("d"), (F.sum("n") - 1).alias("alternatives"))
    return best.select("probe_id", "build_id", F.round("d", 3).alias("metres"), "alternatives")


def _near_cells(metres: float):
    """Of packs of two cells, a point of each that are near each other, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                (a, alat, alng), (b, blat, blng) = ([np.array(p.field(c).to_pylist()) for c in ("id", "lat", "lng")] for p in (batch.column(n).slice(k, 1).flatten() for n in ("points", "others")))
                at = next(((i + x, y) for i in range(0, len(a), 64) for x, y in np.argwhere(_metres(alat[i : i + 64, None], alng[i : i + 64, None], blat, blng) <= metres)[:1]), None)
                rows += [(a[at[0]], b[at[1]])] if at else []
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], batch.column("points").type.value_type.field("id").type) for c in range(2)], ["a", "b"])

    return run


def _metres(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """As ``haversine_m``."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(a))


def spatial_clusters(points: DataFrame, metres: float, max_lat: float = 60.0) -> DataFrame:
    """id, component: points (id, lat, lng) linked by steps of at most ``metres``; lone points are left out.

    All points of a cell are near each other, as its diagonal is shorter than that, so a star links them. Two cells need
    one link, from any two points of theirs that are near, so links grow with points and cells, not with pairs."""
    side = 0.999 * metres / math.sqrt(2) / (EARTH_M * math.radians(1))
    up = math.ceil(metres / (EARTH_M * math.radians(1)) / side)
    across = math.ceil(metres / (EARTH_M * math.radians(1)) / math.cos(math.radians(max_lat)) / side * 1.001)
    at = lambda c: F.floor(F.col(c) / side)
    rows = written(points.select("id", "lat", "lng", at("lat").alias("ci"), at("lng").alias("cj")).dropna().withColumn("cell", F.concat_ws(" ", "ci", "cj")))
    stars = star_edges(rows, "cell", "id")
    packs = written(_packed(rows, ["ci", "cj"], POINTS, F.struct("id", "lat", "lng"), "id", "points"))
    steps = [(i, j) for i in range(up + 1) for j in range(-across, across + 1) if (i, j) > (0, 0)]
    asked = packs.withColumn("step", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    asked = asked.select(F.col("points").alias("others"), (F.col("ci") + F.col("step.i")).alias("ci"), (F.col("cj") + F.col("step.j")).alias("cj"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = points.schema["id"].dataType.simpleString()
    links = packs.join(asked, ["ci", "cj"]).select("points", "others").repartition(tasks).mapInArrow(_near_cells(metres), f"a {kind}, b {kind}")
    return components(stars.select("a", "b").union(links.filter("a <> b")))


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices of a ring of (x, y), the closing one left out."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    open_ring = F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    mean = lambda name: F.aggregate(open_ring, F.lit(0.0), lambda s, v: s + v[name]) / F.size(open_ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def _edges(ring: Column) -> Column:
    """Each vertex with the next; the last goes back to the first."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def ring_area_m2(ring: Column) -> Column:
    """Area of a ring of (longitude, latitude) by the shoelace formula on a local plane, in square metres."""
    lat = F.aggregate(ring, F.lit(0.0), lambda s, v: s + v["y"]) / F.size(ring)
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.round(F.abs(twice) / 2 * 111_320.0 * 111_320.0 * F.cos(F.radians(lat)), 1)


def _packed(rows: DataFrame, keys: list[str], size: int, value: Column | str, by: Column | str, name: str) -> DataFrame:
    """The rows of each key in sorted arrays of some ``size`` values."""
    of = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_packs"))
    packs = rows.join(of, keys).withColumn("_pack", F.pmod(F.xxhash64(by), F.col("_packs")))
    return packs.groupBy(*keys, "_pack").agg(F.sort_array(F.collect_list(value)).alias(name)).drop("_pack")


#: Points and polygons of a cell that meet at once.
POINTS, POLYGONS = 2048, 256


def _meeting(points: DataFrame, polygons: DataFrame, cell: float, found: Callable, margin: float = 0.0) -> DataFrame:
    """id, polygon_id, away: what ``found`` finds of points (id, lat, lng) and the polygons (polygon_id, ring of x, y) that
    may hold them. A polygon stands in every cell of its bounding box and ``margin`` degrees around it, so points meet the
    polygons of their own cell only. Both come in packs, and those that meet are dealt out, however full a cell is."""
    at = lambda c: F.floor(c / cell)
    values = lambda name: F.transform("ring", lambda v: v[name])
    ends = {f"{n}{d}": at(f(values(d)) + by) for d in "xy" for n, f, by in (("lo", F.array_min, -margin), ("hi", F.array_max, margin))}
    boxes = polygons.select("polygon_id", "ring", *[c.alias(n) for n, c in ends.items()])
    boxes = boxes.withColumn("ci", F.explode(F.sequence("lox", "hix"))).withColumn("cj", F.explode(F.sequence("loy", "hiy")))
    placed = points.select("id", "lat", "lng", at(F.col("lng")).alias("ci"), at(F.col("lat")).alias("cj")).dropna(subset=["ci", "cj"])
    a = _packed(placed, ["ci", "cj"], POINTS, F.struct("id", "lat", "lng"), "id", "points")
    b = _packed(boxes, ["ci", "cj"], POLYGONS, F.struct("polygon_id", "ring"), "polygon_id", "polygons")
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.join(b, ["ci", "cj"]).select("points", "polygons").repartition(tasks)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((points, "id"), (polygons, "polygon_id")))
    return met.mapInArrow(found, f"{kinds}, away double")


def containing(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """id, polygon_id: points and the polygons that hold them."""
    return _meeting(points, polygons, cell, inside.every()).select("id", "polygon_id")


def first_containing(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """id, polygon_id: points and the smallest of the polygons that hold them."""
    return _meeting(points, polygons, cell, inside.one()).groupBy("id").agg(F.min("polygon_id").alias("polygon_id"))


#: Metres of a degree in distances to polygons, and in the margin around them.
DEGREE_M, MARGIN_M = 95_000.0, 79_000.0


def nearest_polygon(points: DataFrame, polygons: DataFrame, metres: float, cell: float) -> DataFrame:
    """id, polygon_id, metres: each point's nearest polygon within ``metres``, 0 if it lies inside; the smaller id on
    ties. Points without one are left out."""
    met = _meeting(points, polygons, cell, inside.one(metres, DEGREE_M), metres / MARGIN_M)
    return met.groupBy("id").agg(F.min_by("polygon_id", F.struct("away", "polygon_id")).alias("polygon_id"), F.round(F.min("away"), 2).alias("metres"))


def in_polygon(lng: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a closed ring, by crossings; the ring is a constant."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            crossings = crossings + F.when(spans & (lng < F.lit(x2 - x1) * (lat - y1) / F.lit(y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def upper_median(values: Column) -> Column:
    """The middle value, the upper of two."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def divergence(rows: DataFrame, key: str, providers: list[tuple[str, int, int]], metres: float) -> DataFrame:
    """key, pair, metres: the two providers that disagree most on a place, where they are at least so far apart.
    Providers are (name, index of latitude, index of longitude) in an offset vector; pairs are built inside
    the row, so nothing is shuffled. Ties go to the first pair."""
    at = lambda i, origin: F.lit(origin) + F.get("embedding", F.lit(i)).cast("double") * 0.05
    pairs = [
        F.struct(F.round(haversine_m(at(p[1], 43.6), at(p[2], -79.5), at(q[1], 43.6), at(q[2], -79.5)), 2).alias("metres"), F.lit(-k).alias("place"), F.lit(f"{p[0]}-{q[0]}").alias("pair"))
        for k, (p, q) in enumerate((p, q) for i, p in enumerate(providers) for q in providers[i + 1 :])
    ]
    worst = rows.select(key, F.array_max(F.array(*pairs)).alias("worst"))
    return worst.filter(F.col("worst.metres") >= metres).select(key, "worst.pair", "worst.metres")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, status, field: one row for each changed field, and for each row that came or went."""
    fields = [c for c in old.columns if c != key]
    pack = lambda df, name: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(name))
    both = pack(old, "old").join(pack(new, "new"), key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in fields]), lambda c: c.isNotNull())
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.size("changed") > 0, "changed").otherwise("unchanged")
    both = both.withColumn("changed", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    return both.select(key, status.alias("status"), F.explode_outer("changed").alias("field"))


def _ratio():
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(alike.ratios(a.tolist(), b.tolist()))

    return ratio


#: Left and right texts of a block that are met at once.
LEFT, MET = 64, 256


def _worth(least: float):
    """Of packed texts, for each left one the right one of the greatest bound, scored, and those that may be better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, left, right = (batch.column(c).slice(k, 1) for c in ("block", "left", "right"))
                left, right = left.flatten(), right.flatten()
                told, ids, a = right.field("tb"), right.field("match_id"), left.to_pylist()
                b, bound = told.to_pylist(), alike.bounds(a, told.to_pylist())
                first = bound.argmax(1)  # texts are in the order of their ids
                score = alike.ratios(a, [b[j] for j in first])
                at_least = np.maximum(score, least)[:, None]
                places = np.arange(len(b))[None]
                rest = (bound >= at_least) & (places != first[:, None]) & ((bound > at_least) | (places < first[:, None]) | (score[:, None] < least))
                i, j = np.nonzero(rest)
                met = np.flatnonzero(bound.max(1) >= least)
                rows, columns = np.concatenate([met, i]), np.concatenate([first[met], j])
                blocks = pa.concat_arrays([block]).take(pa.array(np.zeros(len(rows), np.int64)))
                scores = pa.concat_arrays([pa.array(score[met], pa.float64()), pa.nulls(len(i), pa.float64())])
                yield pa.RecordBatch.from_arrays([blocks, left.take(pa.array(rows)), told.take(pa.array(columns)), ids.take(pa.array(columns)), pa.array(bound[rows, columns], pa.float64()), scores], ["block", "ta", "tb", "match_id", "bound", "score"])

    return run


def fuzzy_candidates(left: DataFrame, right: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """What has to be compared character by character to find the best match of every left text (block, ta) among the
    right ones (block, tb, match_id): first, for each left text, the right text of the greatest bound among those that it
    meets at once, scored; then the other right texts whose bound is not below its best score. All others can't be the
    best: a bound that only equals the score counts for smaller ids alone."""
    a = _packed(left, ["block"], LEFT, "ta", "ta", "left")
    b = _packed(right, ["block"], MET, F.struct("match_id", "tb"), "tb", "right")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((left, "block"), (left, "ta"), (right, "tb"), (right, "match_id")))
    met = written(a.join(b, "block").mapInArrow(_worth(least), f"{kinds}, bound double, score double"))
    first = met.filter("score is not null").select("block", "ta", "tb", "match_id", "score")
    known = first.groupBy("block", "ta").agg(F.max("score").alias("at_least"))
    rest = met.filter("score is null").join(known, ["block", "ta"]).filter("bound >= at_least")
    return first, rest.select("block", "ta", "tb", "match_id")


def fuzzy_best(left: DataFrame, right: DataFrame, block: str, least: float = 0.6, digits: int = 6) -> DataFrame:
    """For each left row the right row of the same block whose text is most alike (id, text, block on both sides), if it
    is ``least`` alike; the smaller id on ties. Equal texts of a block are compared once, and only where a bound
    allows it. Null texts and blocks match nothing."""
    a = left.select(F.col(block).alias("block"), F.col("text").alias("ta")).dropna().distinct()
    b = right.filter(F.col("text").isNotNull() & F.col(block).isNotNull()).groupBy(F.col(block).alias("block"), F.col("text").alias("tb")).agg(F.min("id").alias("match_id"))
    first, rest = fuzzy_candidates(a, b, least)
    scored = first.unionByName(rest.withColumn("score", _ratio()("ta", "tb"))).filter(F.col("score") >= least)
    best = scored.groupBy("block", "ta").agg(F.max_by(F.struct("match_id", "score"), F.struct("score", -F.col("match_id"))).alias("m"))
    return left.join(best, (left[block] == best["block"]) & (left["text"] == best["ta"])).select(left["id"], "m.match_id", F.round("m.score", digits).alias("score"))


def admitted(events: DataFrame, daily: int) -> DataFrame:
    """Uses of each kind and day, and how many the daily limit admits."""
    n = events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("used"))
    return n.withColumn("admitted", F.least("used", F.lit(daily).cast("long")))


def first_seen(events: DataFrame) -> DataFrame:
    """The first event of each user and kind."""
    return events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def sessions(events: DataFrame, gap_seconds: int = 86_400) -> DataFrame:
    """Sessions of users: a new one after a pause. One window over each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))
    rows = events.select("user_id", "ts", "event_id", F.coalesce((pause > gap_seconds).cast("int"), F.lit(1)).alias("new"))
    return rows.select("user_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session")).groupBy("user_id", "session").agg(F.count("*").alias("events"))
