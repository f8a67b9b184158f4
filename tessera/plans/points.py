"""Queries over points, and over rings around them, derived from the embeddings; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import addresses as A
from tessera.operators import overlap as O
from tessera.operators import resolve as R
from tessera.sources.tables import table

DISTANCE = 150.0
NEAR_M = 900.0


def _points(s, d) -> DataFrame:
    e = F.col("embedding")
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (43.60 + e[0].cast("double") * 0.05).alias("lat"), (-79.50 + e[1].cast("double") * 0.05).alias("lng"))


_PTS = "pts AS (SELECT vec_id AS id, 43.60::DOUBLE + embedding[1]::DOUBLE * 0.05::DOUBLE AS lat, -79.50::DOUBLE + embedding[2]::DOUBLE * 0.05::DOUBLE AS lng FROM embeddings)"
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - p.lng) / 2), 2)))"


#: Every tenth point has a ring around it: where its corners stand from it, in units of its own width and height. The
#: second form is concave, the third repeats its first corner.
SHAPES = [[(-1, -1), (1, -1), (1, 1), (-1, 1)], [(-1, -1), (1, -1), (1, 1), (0, 0), (-1, 1)], [(-1, -1), (1, -1), (0, 1), (-1, -1)]]
_RINGED, _WIDE, _HIGH = "id % 10 = 3", "(0.005 + (id % 7) * 0.001)", "(0.004 + (id % 5) * 0.001)"


def _corner(shape: int, k: int, double: str) -> tuple[str, str]:
    x, y = SHAPES[shape][k % len(SHAPES[shape])]
    return f"(lng + ({x}) * CAST({_WIDE} AS {double}))", f"(lat + ({y}) * CAST({_HIGH} AS {double}))"


def rings(s, d) -> DataFrame:
    """polygon_id, ring."""
    shape = "CASE " + " ".join(f"WHEN (id DIV 10) % {len(SHAPES)} = {k} THEN array({', '.join('struct({} AS x, {} AS y)'.format(*_corner(k, c, 'DOUBLE')) for c in range(len(v)))})" for k, v in enumerate(SHAPES)) + " END"
    return _points(s, d).filter(_RINGED).select(F.col("id").alias("polygon_id"), F.expr(shape).cast("array<struct<x:double,y:double>>").alias("ring"))


_CORNERS = "c AS (" + " UNION ALL ".join(
    f"SELECT id AS polygon_id, {c} AS k, {_corner(k, c, 'DOUBLE')[0]} AS x1, {_corner(k, c, 'DOUBLE')[1]} AS y1, {_corner(k, c + 1, 'DOUBLE')[0]} AS x2, {_corner(k, c + 1, 'DOUBLE')[1]} AS y2 FROM pts WHERE {_RINGED} AND (id // 10) % {len(SHAPES)} = {k}"
    for k, v in enumerate(SHAPES) for c in range(len(v))
) + ")"
def _mercator(s, d) -> DataFrame:
    x, y = A.to_mercator(F.col("lng"), F.col("lat"))
    rows = _points(s, d).select("id", x.alias("x"), y.alias("y"))
    lng, lat = A.from_mercator(F.col("x"), F.col("y"))
    return rows.select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


def _utm(s, d) -> DataFrame:
    x, y = A.to_utm(F.col("lng"), F.col("lat"))
    lng, lat = A.from_utm(F.col("x"), F.col("y"))
    return _points(s, d).select("id", x.alias("x"), y.alias("y")).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


_D = f"{A.E2!r}::DOUBLE", f"{A.EP2!r}::DOUBLE"
_UTM = f"""WITH {_PTS}, r AS (SELECT *, radians(lat) AS f FROM pts),
q AS (SELECT *, {A.AXIS!r}::DOUBLE / sqrt(1 - {_D[0]} * sin(f) ^ 2) AS n, tan(f) ^ 2 AS t, {_D[1]} * cos(f) ^ 2 AS c, cos(f) * radians(lng + 81) AS a,
  {A.AXIS!r}::DOUBLE * ({A.MERIDIAN[0]!r}::DOUBLE * f - {A.MERIDIAN[1]!r}::DOUBLE * sin(2 * f) + {A.MERIDIAN[2]!r}::DOUBLE * sin(4 * f) - {A.MERIDIAN[3]!r}::DOUBLE * sin(6 * f)) AS m FROM r)
SELECT id, round(0.9996::DOUBLE * n * (a + (1 - t + c) * a ^ 3 / 6 + (5 - 18 * t + t ^ 2 + 72 * c - 58 * {_D[1]}) * a ^ 5 / 120) + 500000, 3) AS x,
  round(0.9996::DOUBLE * (m + n * tan(f) * (a ^ 2 / 2 + (5 - t + 9 * c + 4 * c ^ 2) * a ^ 4 / 24 + (61 - 58 * t + t ^ 2 + 600 * c - 330 * {_D[1]}) * a ^ 6 / 720)), 3) AS y, round(lng, 6) AS lng, round(lat, 6) AS lat FROM q"""

def plots(s, d) -> DataFrame:
    """polygon_id, ring: an upright rectangle around every point."""
    x, y = (lambda e: F.expr(f"CAST(lng + ({e}) * CAST({_PLOT_W} AS DOUBLE) AS DOUBLE)")), (lambda e: F.expr(f"CAST(lat + ({e}) * CAST({_PLOT_H} AS DOUBLE) AS DOUBLE)"))
    corner = lambda i, j: F.struct(x(i).alias("x"), y(j).alias("y"))
    return _points(s, d).select(F.col("id").alias("polygon_id"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))


_PLOT_W, _PLOT_H = "((1 + id % 4) * 0.0005)", "((1 + id % 3) * 0.0004)"


def _plot_overlaps(s, d) -> DataFrame:
    """Of plots that overlap plots of even numbers, the one they share most with."""
    rows = plots(s, d)
    out = O.most_overlapped(rows.filter("polygon_id % 2 = 1"), rows.filter("polygon_id % 2 = 0"), 0.002)
    return out.select("a", "b", F.round(F.col("area") * 1e6, 6).alias("area"), F.round("share", 6).alias("share"))


#: name: (query, SQL or None)
ALL = {
    "plot_overlaps": (
        _plot_overlaps,
        f"""WITH {_PTS}, r AS (SELECT id, lng - CAST({_PLOT_W} AS DOUBLE) AS x1, lng + CAST({_PLOT_W} AS DOUBLE) AS x2, lat - CAST({_PLOT_H} AS DOUBLE) AS y1, lat + CAST({_PLOT_H} AS DOUBLE) AS y2 FROM pts),
        o AS (SELECT a.id AS a, b.id AS b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS area, (a.x2 - a.x1) * (a.y2 - a.y1) AS own
              FROM r a JOIN r b ON a.id % 2 = 1 AND b.id % 2 = 0 AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)
        SELECT a, b, round(area * 1e6, 6) AS area, round(area / own, 6) AS share FROM o QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(area / own, 9) DESC, b) = 1""",
    ),
    "utm": (_utm, _UTM),
    "polygons_of_points": (
        lambda s, d: R.containing(_points(s, d), rings(s, d), 0.02),
        f"WITH {_PTS}, {_CORNERS} SELECT id, polygon_id FROM pts, c WHERE y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1",
    ),
    "nearest_parcel": (
        lambda s, d: R.nearest_polygon(_points(s, d), rings(s, d), NEAR_M, 0.02),
        f"""WITH {_PTS}, {_CORNERS}, g AS (SELECT id, lng, lat, polygon_id, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM pts, c),
        f AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, ((lng - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy))) END AS u FROM g),
        h AS (SELECT id, polygon_id, CASE WHEN count(*) FILTER (WHERE dy <> 0 AND (y1 > lat) <> (y1 + dy > lat) AND lng < dx * (lat - y1) / dy + x1) % 2 = 1 THEN 0 ELSE min(sqrt((x1 + u * dx - lng) ^ 2 + (y1 + u * dy - lat) ^ 2)) * 95000 END AS m FROM f GROUP BY 1, 2)
        SELECT id, polygon_id, round(m, 2) AS metres FROM h WHERE m <= {NEAR_M} QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, polygon_id) = 1""",
    ),
    "ring_measures": (
        lambda s, d: rings(s, d).select("polygon_id", F.round(R.ring_centroid(F.col("ring"))["x"], 7).alias("x"), F.round(R.ring_centroid(F.col("ring"))["y"], 7).alias("y")),
        f"WITH {_PTS}, {_CORNERS} SELECT polygon_id, round(avg(x1), 7) AS x, round(avg(y1), 7) AS y FROM c WHERE x1 <> x2 OR y1 <> y2 GROUP BY 1",
    ),
    "spatial_clusters": (
        lambda s, d: R.spatial_clusters(_points(s, d), DISTANCE),
        f"WITH RECURSIVE {_PTS}, e AS (SELECT p.id AS a, b.id AS b FROM pts p JOIN pts b ON p.id <> b.id AND abs(p.lat - b.lat) < 0.0075 AND abs(p.lng - b.lng) < 0.0075 WHERE {_HAV} <= {DISTANCE}), r AS (SELECT DISTINCT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.id = e.a) SELECT id, min(m) AS component FROM r GROUP BY 1",
    ),
    "mercator": (_mercator, f"WITH {_PTS} SELECT id, round(lng * 20037508.34::DOUBLE / 180, 2) AS x, round(ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * 20037508.34::DOUBLE / 180, 2) AS y, round(lng, 6) AS lng, round(lat, 6) AS lat FROM pts"),
}
