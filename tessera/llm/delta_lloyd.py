"""Centroid clustering as delta Lloyd: exact integer k-means that works on changes only.

Vectors become integers once, floor(``scale`` * x). What is kept from round to round, as
tables of the shared folder, is each vector's owner and distance, and each cluster's count
and sums. A round then needs

* comparisons: a vector whose owner did not change is compared with the changed centroids
  alone, as all others were no nearer before; one whose owner changed is compared with all;
* signed transfers: a vector that changes its owner is taken from the sums of the old one and
  added to the new one's. Each task adds its own up; only its few rows of clusters by
  components are shuffled. A round in which no centroid changed costs nothing.

Exact: squared distances come from products of doubles while all components are below 2^22,
where no sum reaches 2^53, and from Python integers beyond. Sums travel as decimals of 38 digits.

Defined results: vectors that are null, have another number of components, or hold null or
non-finite ones take no part and get no row. Repeated rows are vectors of their own. The
starts are the rows with the smallest sha256 of "1:<id>" (rows without id last, ties by the
vector); with fewer rows than ``k`` there are fewer centroids. A component beyond a long is held
at its ends; a distance or inertia beyond one is null. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import release, stored

K, DIMS, SCALE, ROUNDS = 16, 64, 64, 3
#: Components below this keep all arithmetic of a distance exact in doubles.
_EXACT = 1 << 22
_LONG = (1 << 63) - 1


def _to_integers(dims: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(-1))
            at = np.flatnonzero(sizes == dims)
            flat = lists.take(pa.array(at)).flatten()
            known = ~np.asarray(flat.is_null()).reshape(-1, dims).any(axis=1)
            x = np.asarray(flat.fill_null(0.0), dtype=np.float64).reshape(-1, dims)
            ok = known & np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                x = np.floor(x[ok] * scale)
            v = np.where(x >= 2.0**63, _LONG, np.where(x < -(2.0**63), -_LONG - 1, np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)))
            ids = batch.column(0).take(pa.array(at[ok]))
            yield pa.RecordBatch.from_arrays([ids, _lists(v.astype(np.int64))], names=["id", "v"])

    return run


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dims)


def _small(x: np.ndarray, centroids: list[list[int]]) -> bool:
    return max([int(x.max(initial=0)), -int(x.min(initial=0)), *(abs(c) for row in centroids for c in row)]) < _EXACT


def _distances(x: np.ndarray, centroids: list[list[int]], small: bool) -> np.ndarray:
    """Squared distances of rows of ``x`` to ``centroids``, exact: of doubles if ``small``, else Python integers."""
    if small:
        a, c = x.astype(np.float64), np.array(centroids, dtype=np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    a, c = x.astype(object), np.array(centroids, dtype=object)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in c], axis=1)


def _assigned(centroids: list[list[int]], changed: list[int] | None, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Owners after ``changed`` (numbers of centroids) were replaced; None: nothing has an owner yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            small = _small(x, centroids)
            kind = np.int64 if small else object
            if changed is None:
                was, owner, best = None, np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=kind)
                afresh = np.ones(len(x), dtype=bool)
            else:
                was = np.asarray(batch.column("cluster"), dtype=np.int64)
                far = batch.column("distance")
                afresh = np.isin(was, changed) | np.asarray(far.is_null())
                owner, best = was.copy(), np.asarray(far.fill_null(0), dtype=np.int64).astype(kind)
                near = np.flatnonzero(~afresh)
                if len(near):
                    d = _distances(x[near], [centroids[k] for k in changed], small)
                    pick = d.argmin(axis=1)
                    least, number = d[np.arange(len(near)), pick], np.array(changed)[pick]
                    better = (least < best[near]) | ((least == best[near]) & (number < owner[near]))
                    owner[near[better]], best[near[better]] = number[better], least[better]
            rest = np.flatnonzero(afresh)
            if len(rest):
                d = _distances(x[rest], centroids, small)
                owner[rest] = d.argmin(axis=1)
                best[rest] = d[np.arange(len(rest)), owner[rest]]
            distance = pa.array(best if small else [int(d) if d <= _LONG else None for d in best], pa.int64())
            moved = np.ones(len(x), dtype=bool) if was is None else was != owner
            before = pa.nulls(len(x), pa.int32()) if was is None else pa.array(was.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(owner.astype(np.int32)), distance, before, pa.array(moved)], names=["id", "v", "cluster", "distance", "was", "moved"]
            )

    return run


def _transfers(k: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the vectors that moved: for each cluster, the change of its count and of its sums, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            if not len(x):
                continue
            x = x if max(int(x.max()), -int(x.min())) < 1 << 40 else x.astype(object)
            x = np.concatenate([np.ones((len(x), 1), dtype=x.dtype), x], axis=1)
            for column, sign in (("cluster", 1), ("was", -1)):
                of = np.asarray(batch.column(column).fill_null(-1))
                for c in np.unique(of[of >= 0]):
                    total[c] += sign * x[of == c].sum(axis=0).astype(object)
        moved = [c for c in range(k) if any(total[c])]
        sums = pa.array([[Decimal(int(s)) for s in total[c]] for c in moved], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), sums], names=["cluster", "sums"])

    return run


def assign(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS
) -> tuple[DataFrame, list[list[int]]]:
    """id, v (integers), cluster, distance after ``rounds`` updates and a last assignment; the centroids."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    state = stored(rows.mapInArrow(_to_integers(dims, scale), f"id {kind}, v array<bigint>"), "vectors")
    chosen = state.select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("h"), "v")
    centroids = [list(r.v) for r in chosen.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]
    full = f"id {kind}, v array<bigint>, cluster int, distance bigint, was int, moved boolean"
    if not centroids:
        return state.mapInArrow(_assigned([], None, dims), full).drop("was", "moved"), []
    changed, sums = None, None
    for turn in range(rounds + 1):
        if changed == []:
            break
        before, state = state, stored(state.mapInArrow(_assigned(centroids, changed, dims), full), f"owners-{turn}")
        release(before)
        if turn == rounds:
            break
        change = state.filter("moved").mapInArrow(_transfers(len(centroids), dims), "cluster int, sums array<decimal(38,0)>").select("cluster", F.posexplode("sums").alias("part", "amount"))
        old, change = sums, change if sums is None else change.unionByName(sums)
        sums = stored(change.groupBy("cluster", "part").agg(F.sum("amount").cast("decimal(38,0)").alias("amount")), f"sums-{turn}")
        if old is not None:
            release(old)
        now = {(r.cluster, r.part): int(r.amount) for r in sums.collect()}  # clusters by components, whatever the input
        fresh = [[now[c, 1 + i] // now[c, 0] for i in range(dims)] if now.get((c, 0)) else row for c, row in enumerate(centroids)]
        changed = [c for c, (a, b) in enumerate(zip(centroids, fresh, strict=True)) if a != b]
        centroids = fresh
    return state.drop("was", "moved"), centroids


def cluster_report(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS
) -> DataFrame:
    """Per vector that takes part: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    state, centroids = assign(vectors, id_col, vec_col, k, dims, scale, rounds)
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    found = {r.cluster: None if r.beyond else int(r.s) for r in sums.collect()} if centroids else {}  # one row per cluster
    held = lambda x: x if x is not None and x <= _LONG else None
    whole = held(None if None in found.values() else sum(found.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame([(c, held(found.get(c)), whole, digest[c]) for c in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.join(F.broadcast(named), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
