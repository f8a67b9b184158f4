"""Points and rings, many of each at once: which rings hold a point, and which is nearest.

A point lies in a ring if an odd number of the ring's edges crosses the line that goes right from it. Points are in the
order of their latitude, so a ring meets only those between its lowest and highest corner. Where one ring a point is
asked for, rings come in the order of their ids, and a point that a ring holds meets none of the later ones.

A null corner has no edges; a ring of none holds nothing and is near nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def _holds(x: np.ndarray, y: np.ndarray, lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Which of the points lie in a ring."""
    x1, y1, x2, y2 = (v[:, None] for v in (x, y, np.roll(x, -1), np.roll(y, -1)))
    crossed = ((y1 > lat) != (y2 > lat)) & (lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    return np.logical_xor.reduce(crossed, 0)


def _away(x: np.ndarray, y: np.ndarray, lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """How far points are from the edges of a ring."""
    x1, y1, x2, y2 = (v[:, None] for v in (x, y, np.roll(x, -1), np.roll(y, -1)))
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = np.where(length == 0, 0.0, ((lng - x1) * dx + (lat - y1) * dy) / length)
    along = np.maximum(0.0, np.minimum(1.0, along))
    return np.fmin.reduce(np.sqrt((x1 + along * dx - lng) ** 2 + (y1 + along * dy - lat) ** 2), 0)


def _rings(polygons: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
    rings = polygons.field("ring")
    corners = rings.flatten()
    x, y = (corners.flatten()[corners.type.get_field_index(c)].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")
    ends = np.cumsum(rings.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    return [(x[a:b], y[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _every(rings: list[tuple[np.ndarray, np.ndarray]], lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points and rings that hold them."""
    at, of = [], []
    for k, (x, y) in enumerate(rings):
        if len(x):
            low, high = np.searchsorted(lat, [np.nanmin(y), np.nanmax(y)])
            at.append(low + np.flatnonzero(_holds(x, y, lng[low:high], lat[low:high])))
            of.append(np.full(len(at[-1]), k))
    at, of = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (at, of))
    return at, of, np.zeros(len(at))


def _one(reach: float | None, unit: float):
    """Of each point the first ring that holds it or else, with a reach, the nearest one within it, in units of a degree."""
    around = (reach or 0.0) / unit * (1 + 1e-9)

    def run(rings: list[tuple[np.ndarray, np.ndarray]], lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, owner, left = np.full(len(lat), np.inf), np.full(len(lat), -1), np.arange(len(lat))
        for k, (x, y) in enumerate(rings):
            if not len(x):
                continue
            some = left[np.searchsorted(lat[left], np.nanmin(y) - around) : np.searchsorted(lat[left], np.nanmax(y) + around, "right")]
            some = some[(lng[some] >= np.nanmin(x) - around) & (lng[some] <= np.nanmax(x) + around)]
            held = _holds(x, y, lng[some], lat[some])
            best[some[held]], owner[some[held]] = 0.0, k
            if reach is not None:
                some = some[~held]
                away = _away(x, y, lng[some], lat[some]) * unit
                nearer = (away < best[some]) & (away <= reach)
                best[some[nearer]], owner[some[nearer]] = away[nearer], k
            if held.any():
                left = left[best[left] > 0]
        at = np.flatnonzero(owner >= 0)
        return at, owner[at], best[at]

    return run


def met(found: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, polygon_id, away of packed points (id, lat, lng) and polygons (polygon_id, ring)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                points, polygons = (batch.column(c).slice(k, 1).flatten() for c in ("points", "polygons"))
                lat, lng = (points.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("lat", "lng"))
                order = np.argsort(lat, kind="stable")
                with np.errstate(all="ignore"):
                    at, of, away = found(_rings(polygons), lng[order], lat[order])
                yield pa.RecordBatch.from_arrays([points.field("id").take(pa.array(order[at])), polygons.field("polygon_id").take(pa.array(of)), pa.array(away, pa.float64())], ["id", "polygon_id", "away"])

    return run


def every() -> Callable:
    return met(_every)


def one(reach: float | None = None, unit: float = 1.0) -> Callable:
    return met(_one(reach, unit))
