"""Sharding by a k-d tree over metadata.

The tree is split until it has as many leaves as shards are wanted, each leaf
holding its share of the bytes. A node is split along its widest dimension, width
measured against the whole corpus, at the weighted median: the place where its
bytes divide as its leaves do. The median is found exactly by counting: a search
over 63-bit positions in five passes, each summing bytes by node and by the next
13 bits, for all nodes of a level at once.

Dimensions are functions of the text (bytes, words, bytes beyond ASCII), and ties
are broken by the text's hash, so equal texts have one position and stay together.
A group of equal texts of more than ``TOLERANCE`` of a shard (there are at most
shards / ``TOLERANCE`` such groups) is placed as a whole: it goes to the side of the
cut on which less has to be moved, and the cut through the rest moves to make up for
it; where the rest is too small for that, the groups of the node are dealt to its two
sides, the largest first. Only a group that is larger than a whole shard is divided, by a hash of the ids.

Slots number each shard from 0; they are counted in parts of a shard, so no task
holds a shard.

Defined results: null texts have no bytes and checksum 0; repeated rows go to the
same shard and have slots of their own; shards may be empty if there is too
little to divide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import broadcast_if_small, stored

SHARDS = 24
#: Bytes that a document costs besides its text.
OVERHEAD = 8
TOLERANCE = 0.005
ROWS_PER_PART = 100_000
_DIGIT, _PASSES = 13, 5
_LEAST, _MOST = -1, 2**63 - 1


DIMENSIONS = ("by_size", "by_words", "by_wide")


@dataclass
class Group:
    """Equal texts that are placed as a whole: their hash, bytes and positions."""

    hash: int
    weight: int
    at: dict[str, int]


@dataclass
class Split:
    """Rows left of a cut: position under ``at``, or at it with a sub-position up to ``sub``."""

    leaves: int
    first: int
    dim: str = ""
    at: int = 0
    sub: int = _MOST
    left: Split | None = None
    right: Split | None = None
    groups: list[Group] = field(default_factory=list)

    def shard(self) -> Column:
        if self.left is None:
            return F.lit(self.first)
        here = (F.col(self.dim) < self.at) | ((F.col(self.dim) == self.at) & (F.col("sub") <= self.sub))
        return F.when(here, self.left.shard()).otherwise(self.right.shard())

    def placed(self) -> dict[int, int]:
        """The shard of each group that is placed as a whole, by hash."""
        if self.left is None:
            return {g.hash: self.first for g in self.groups}
        return self.left.placed() | self.right.placed()

    def assigned(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with column ``name``: their shard."""
        known = rows.sparkSession.createDataFrame(list(self.placed().items()), "placed_hash long, placed_shard int")
        rows = rows.join(F.broadcast(known), F.col("hash") == F.col("placed_hash"), "left")  # at most shards / TOLERANCE rows
        return rows.withColumn(name, F.coalesce("placed_shard", self.shard().cast("int"))).drop("placed_hash", "placed_shard")


def _dimensions(text: Column, key: Column) -> list[Column]:
    """hash, the dimensions (positions of 63 bits, the same for equal texts), and sub."""
    low = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))
    words = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    values = (F.octet_length(text), words, F.octet_length(text) - F.length(text))
    at = [F.shiftleft(v.cast("long"), 32).bitwiseOR(low).alias(d) for d, v in zip(DIMENSIONS, values, strict=True)]
    return [F.xxhash64(text).alias("hash"), *at, F.shiftrightunsigned(F.xxhash64(key, F.lit(3)), 1).alias("sub")]


def _points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, crc, hash and the dimensions; no texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = (F.octet_length("text") + OVERHEAD).cast("long")
    return rows.select("id", size.alias("size"), F.crc32(F.col("text").cast("binary")).cast("long").alias("crc"), *_dimensions(F.col("text"), F.col("id")))


def _descend(rows: DataFrame, keys: dict[int, str], targets: dict[int, float], groups: dict[int, list[Group]] | None = None) -> dict[int, tuple[int, int, int]]:
    """For each node the position at which its running weight reaches the target, the
    weight before that position, and the weight on it; ``groups`` count with the rows."""
    groups = groups or {}
    rows = rows.select("node", "size", F.coalesce(*[F.when(F.col("node") == n, F.col(k)) for n, k in keys.items()]).alias("key"))
    state = {n: (0, 0, 0) for n in keys}  # leading digits, weight before them, weight on them
    bits = _DIGIT * _PASSES
    for left in range(bits - _DIGIT, -1, -_DIGIT):
        inside = F.lit(False)
        for n, (prefix, _, _) in state.items():
            inside = inside | ((F.col("node") == n) & (F.lit(True) if left + _DIGIT == bits else F.shiftrightunsigned("key", left + _DIGIT) == prefix))
        digit = F.shiftrightunsigned("key", left).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        sums: dict[int, dict[int, int]] = {n: {} for n in keys}
        for n, held in groups.items():
            for g in held:
                at = g.at[keys[n]]
                if left + _DIGIT == bits or at >> (left + _DIGIT) == state[n][0]:
                    d = at >> left & (1 << _DIGIT) - 1
                    sums[n][d] = sums[n].get(d, 0) + g.weight
        for r in rows.filter(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("w")).collect():  # nodes x 2^13 at most
            sums[r.node][r.digit] = sums[r.node].get(r.digit, 0) + r.w
        for n, found in sums.items():
            prefix, before, on = state[n]
            for i, (d, w) in enumerate(sorted(found.items()), 1):
                if before + w >= targets[n] or i == len(found):
                    state[n] = (prefix << _DIGIT | d, before, w)
                    break
                before += w
    return state


def _whole_groups(points: DataFrame, share: float, tolerance: float) -> tuple[list[Group], list[int]]:
    """The groups of equal texts that hold more than ``tolerance`` of a shard's ``share`` of the bytes, and of
    them the hashes of those that hold more than the share."""
    sums = points.groupBy("hash").agg(F.sum("size").alias("w"), *[F.first(d).alias(d) for d in DIMENSIONS]).filter(F.col("w") > tolerance * share)
    found = [Group(r.hash, r.w, {d: r[d] for d in DIMENSIONS}) for r in sums.collect()]  # fewer than shards / tolerance
    return [g for g in found if g.weight <= share], [g.hash for g in found if g.weight > share]


def plan(points: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Split:
    root, dims = Split(shards, 0), DIMENSIONS
    ranges = points.agg(F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ranges.w is None:
        return root
    spans = {d: max(1, ranges[f"hi_{d}"] - ranges[f"lo_{d}"]) for d in dims}
    root.groups, giants = _whole_groups(points, ranges.w / shards, tolerance)
    if root.groups:
        whole = points.sparkSession.createDataFrame([(g.hash,) for g in root.groups], "whole_hash long")
        points = points.join(F.broadcast(whole), F.col("hash") == F.col("whole_hash"), "left_anti")
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        of = {n.first: n for n in level}
        rows = points.withColumn("node", root.shard()).filter(F.col("node").isin(*of))
        ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}
        weights, targets, light = {}, {}, {}
        for i, n in of.items():
            light[i] = stats[i].w if i in stats else 0
            weights[i] = light[i] + sum(g.weight for g in n.groups)
            targets[i] = weights[i] * (n.leaves // 2) / n.leaves

            def width(d: str, i: int = i, n: Split = n) -> float:
                at = [g.at[d] for g in n.groups] + ([stats[i][f"lo_{d}"], stats[i][f"hi_{d}"]] if i in stats else [])
                return (max(at) - min(at)) / spans[d]

            n.dim = max(dims, key=width) if weights[i] else dims[0]
        busy = [i for i in of if weights[i]]
        found = _descend(rows, {i: of[i].dim for i in busy}, {i: targets[i] for i in busy}, {i: of[i].groups for i in busy}) if busy else {}
        sides: dict[int, tuple[list[Group], list[Group]]] = {i: ([], []) for i in of}
        moved = {}
        for i in busy:
            n, (at, before, on) = of[i], found[i]
            for g in n.groups:
                if g.at[n.dim] != at:
                    sides[i][g.at[n.dim] > at].append(g)
            for g in (g for g in n.groups if g.at[n.dim] == at):
                rest = targets[i] - sum(x.weight for x in sides[i][0])  # what the left has to hold besides
                short = [max(0, -t, t - light[i]) for t in (rest - g.weight, rest)]  # bytes amiss if the group goes left, right
                sides[i][short[1] < short[0] if short[0] != short[1] else before + on - targets[i] > targets[i] - before].append(g)
                moved[i] = targets[i] - sum(x.weight for x in sides[i][0])
            if i in moved and min(short) > tolerance * weights[i] / n.leaves:  # too little besides the groups to make up: deal them, the largest first
                sides[i], left = ([], []), [targets[i], weights[i] - targets[i]]
                for g in sorted(n.groups, key=lambda g: (-g.weight, g.hash)):
                    side = left[1] > left[0]
                    sides[i][side].append(g)
                    left[side] -= g.weight
                moved[i] = left[0]
        for i, target in moved.items():  # the cut through the rest makes up for a group that stood across it
            found[i] = (_LEAST, 0, 0) if target <= 0 else (_MOST, light[i], 0) if target >= light[i] else found[i]
        again = {i: t for i, t in moved.items() if 0 < t < light[i]}
        if again:
            found |= _descend(rows, {i: of[i].dim for i in again}, again)
        inner = {}
        for i in busy:
            n, (at, before, on) = of[i], found[i]
            target = moved.get(i, targets[i] - sum(g.weight for g in sides[i][0]))
            if i not in moved:
                before -= sum(g.weight for g in sides[i][0])
            n.at, off = at, {_MOST: before + on - target, _LEAST: before - target}
            n.sub = min(off, key=lambda s, off=off: abs(off[s]))
            if abs(off[n.sub]) > tolerance * weights[i] / n.leaves:
                inner[i] = target - before
        inner = {i: t for i, t in inner.items() if t > 0} if giants else {}
        if inner:
            held = F.lit(False)
            for i in inner:
                held = held | ((F.col("node") == i) & (F.col(of[i].dim) == of[i].at))
            cut = rows.filter(held & F.col("hash").isin(*giants))  # at most as many as shards
            for i, (key, _, _) in _descend(cut, dict.fromkeys(inner, "sub"), inner).items():
                of[i].sub = key
        level = []
        for i, n in of.items():
            half = n.leaves // 2
            if weights[i]:
                n.left, n.right = Split(half, n.first, groups=sides[i][0]), Split(n.leaves - half, n.first + half, groups=sides[i][1])
                level += [n.left, n.right]
    return root


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard."""
    points = stored(_points(docs, id_col, text_col), "points")
    tree = plan(points, shards)
    placed = tree.assigned(points, "shard").select("id", "size", "crc", "hash", "shard")
    parts = max(1, -(-points.count() // (shards * ROWS_PER_PART)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "hash"), F.lit(parts)))
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = broadcast_if_small(stored(sizes.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset")), "offsets"), 32)
    order = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "hash"))
    out = placed.withColumn("order", order).join(offsets, ["shard", "part"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("order") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """Write ``docs`` as Parquet, one folder ``shard=N`` for each shard. Where ``docs`` has a column of
    that name, the folders are named by ``shard_``, with as many more underscores as it takes."""
    name, taken = "shard", {c.lower() for c in docs.columns}
    while name in taken:
        name = f"{name}_"
    tree = plan(stored(_points(docs, id_col, text_col), "points"), shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_dimensions(text, F.col(id_col)))
    rows = tree.assigned(rows, "placed")
    rows.select(F.col("placed").alias(name), *[F.col("row").getField(c).alias(c) for c in docs.columns]).write.partitionBy(name).parquet(path)
