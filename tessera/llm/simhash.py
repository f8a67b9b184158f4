"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Fingerprints are made per text and then counted once each. Two that differ in at most
``radius`` bits agree in one of ``radius`` + 1 bands of bits, so a *shard* is a band with its
value, and only fingerprints of one shard are ever compared. A shard's members make a
BK-tree (children keyed by their Hamming distance to the parent), and a search follows only
edges between d - radius and d + radius. A shard of over ``TREE`` members has several trees,
dealt by a hash; these are sent to wherever the other trees' members are, by broadcast if all
of them are measured to be small, in slices of a shuffle otherwise. So a task holds single trees
of bounded size, whatever the shard. Each search hands on the components it found, at most one
row per member, never all its pairs; connected components join them over all shards.

Words are runs outside space, tab and ``[\\x0A-\\x0D]``, A-Z lower-cased; shingles are ``size``
consecutive words, repeats included, joined by one space (the whole of a shorter text). A bit is
set if over half of the shingles' XXH64 (UTF-8, seed 42) have it.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any
other. Every row gets a row; repeated rows get equal results. A row without id can't name a
component; one of such rows alone has component_id null. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import BROADCAST_BYTES, broadcast_if_small, python_batches, release, stored
from tessera.operators import resolve

SIZE, RADIUS, SEED = 3, 2, 42
#: Most members of one BK-tree, on average over the trees of a shard.
TREE = 4096
#: A fingerprint of over this share of all rows is met by broadcast; there are at most as many as its inverse.
HOT = 0.001
_EDGES = 65  # distances of 64 bits
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_AT_ONCE = 1 << 16


def fingerprint(text: bytes, size: int = SIZE) -> int:
    """Of UTF-8 ``text``, unsigned."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    hashes, ones = map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.zeros(64, dtype=np.int64)
    for _ in range(0, count, _AT_ONCE):
        part = np.array(list(islice(hashes, _AT_ONCE)), dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            prints = np.fromiter((fingerprint(t.as_py() or b"", size) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return run


# BK-trees as arrays: the keys of the nodes breadth first, and for each node its code, 65 times the place of
# its parent plus its distance to it (root: 0). Codes ascend, so children between two distances are a range.
# Trees laid one behind another, with codes counted on, are a forest of the same form.


def build_trees(keys: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees over different ``keys`` (uint64), where ``tree`` (ascending) says which tree a key goes to:
    keys and codes of the nodes, tree by tree, codes counted within a tree."""
    first = np.flatnonzero(np.diff(tree, prepend=-1))
    node_key, node_parent, node_edge, node_tree = [keys[first]], [np.zeros(len(first), np.int64)], [np.zeros(len(first), np.int64)], [tree[first]]
    rest = np.setdiff1d(np.arange(len(keys)), first, assume_unique=True)
    at = np.searchsorted(tree[first], tree[rest])  # the node under which a key goes
    level, below = keys[first], 0
    while len(rest):
        distance = np.bitwise_count(level[at - below] ^ keys[rest]).astype(np.int64)
        order = np.lexsort((rest, distance, at))
        rest, at, distance = rest[order], at[order], distance[order]
        fresh = np.diff(at * _EDGES + distance, prepend=-1) != 0
        below += len(level)
        level = keys[rest[fresh]]
        node_key.append(level)
        node_parent.append(at[fresh])
        node_edge.append(distance[fresh])
        node_tree.append(tree[rest[fresh]])
        at = below + np.cumsum(fresh) - 1
        rest, at = rest[~fresh], at[~fresh]
    key, parent, edge, of = (np.concatenate(x) for x in (node_key, node_parent, node_edge, node_tree))
    order = np.argsort(of, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    base = np.searchsorted(of[order], of)  # where a node's tree begins
    code = (place[parent] - base) * _EDGES + edge
    code[edge == 0] = 0
    return key[order], code[order]


def search(keys: np.ndarray, codes: np.ndarray, roots: np.ndarray, asked: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``asked``, node) within ``radius``; ``codes`` are counted on over the forest, and
    asked[k] is looked up in the tree that begins at roots[k]."""
    who, node, found = np.arange(len(asked)), roots, []
    while len(who):
        distance = np.bitwise_count(keys[node] ^ asked[who]).astype(np.int64)
        near = distance <= radius
        found.append((who[near], node[near]))
        lo = np.searchsorted(codes, node * _EDGES + np.maximum(distance - radius, 1), "left")
        n = np.searchsorted(codes, node * _EDGES + np.minimum(distance + radius, _EDGES - 1), "right") - lo
        who = np.repeat(who, n)
        node = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (who, node)


def _joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over edges a-b."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (further := label[label]).tobytes() != label.tobytes():
            label = further


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    return np.asarray(column.flatten()), np.asarray(column.value_lengths()).astype(np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members, sizes = _lists(batch.column("members"))
        keys, codes = build_trees(members.view(np.uint64), np.repeat(np.arange(len(sizes)), sizes))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        trees = [pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("band", "value", "part", "parts")] + trees, names=["band", "value", "part", "parts", "keys", "codes"])


def _links(radius: int, crossed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b: each member that reaches another within its row, with the least member it reaches. A row is a tree
    (keys, codes), looked up by its own keys or, if ``crossed``, by those of another tree (asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = _lists(batch.column("keys"))
            keys = keys.view(np.uint64)
            base = np.cumsum(sizes) - sizes
            codes = _lists(batch.column("codes"))[0].astype(np.int64) + np.repeat(base, sizes) * _EDGES
            asked, counts = _lists(batch.column("asked")) if crossed else (keys, sizes)
            asked, roots = asked.view(np.uint64), np.repeat(base, counts)
            places = np.concatenate([keys, asked]) if crossed else keys
            shift = len(keys) if crossed else 0
            label = np.arange(len(places))
            load = np.cumsum(np.repeat(sizes, counts)) // (1 << 22)  # a search visits at most all nodes of its tree
            for part in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(load)) + 1):
                who, node = search(keys, codes, roots[part], asked[part], radius)
                label = _joined(len(places), part[who] + shift, node, label)
            far = np.flatnonzero(label != np.arange(len(places)))
            yield pa.RecordBatch.from_arrays([pa.array(places[label[far]].view(np.int64)), pa.array(places[far].view(np.int64))], names=["a", "b"])

    return run


def _bands(fp: Column, radius: int) -> Column:
    """band, value: ``radius`` + 1 runs of bits that together make ``fp``."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    runs = [F.shiftrightunsigned(F.shiftleft(fp, 64 - hi), 64 - hi + lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.struct(F.lit(k).alias("band"), r.alias("value")) for k, r in enumerate(runs)])


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, tree: int = TREE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """fp, component (its smallest fingerprint) of all that have another within reach, from different ``fp``."""
    dealt = prints.select("fp", F.inline(_bands(F.col("fp"), radius)))
    large = dealt.groupBy("band", "value").agg(F.count("*").alias("n")).filter(F.col("n") > tree)
    large = stored(large.select("band", "value", F.ceil(F.col("n") / tree).cast("int").alias("parts")), "large-shards")
    dealt = dealt.join(broadcast_if_small(large, 40, broadcast_bytes), ["band", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    shards = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).groupBy("band", "value", "part", "parts").agg(F.collect_list("fp").alias("members"))
    trees = shards.filter((F.size("members") > 1) | (F.col("parts") > 1))
    trees = stored(trees.mapInArrow(_build, "band int, value bigint, part int, parts int, keys array<bigint>, codes array<int>"), "trees")
    links = trees.select("keys", "codes").mapInArrow(_links(radius, False), "a bigint, b bigint")
    split = trees.filter("parts > 1")
    slices = F.ceil(F.col("parts") / 8).cast("int")  # parts of a shard that meet its trees in one task, where these are not broadcast
    left = split.select("band", "value", "part", "keys", "codes", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    asked = split.select("band", "value", F.col("part").alias("other"), F.col("keys").alias("asked"), F.pmod("part", slices).alias("slice")).repartition("band", "value", "other")
    met = asked.join(broadcast_if_small(left, F.size("keys") * 12 + 64, broadcast_bytes), ["band", "value", "slice"]).filter("part < other")
    links = links.unionAll(met.select("keys", "codes", "asked").mapInArrow(_links(radius, True), "a bigint, b bigint"))
    links = stored(links.distinct(), "links")
    groups = resolve.components(links).withColumnRenamed("id", "fp")
    for old in (large, trees, links):
        release(old)
    return groups


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, radius: int = RADIUS, tree: int = TREE, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row: id, fingerprint (16 hexadecimal digits), component_id (the smallest id that links reach)."""
    python_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    bare = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = stored(bare.mapInArrow(_fingerprints(size), f"id {kind}, fp bigint"), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "prints")
    groups = link_fingerprints(prints.select("fp"), radius, tree, broadcast_bytes)
    placed = prints.join(groups, "fp", "left")
    linked = placed.filter("component is not null")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = linked.select("fp", "n", "component").join(broadcast_if_small(stored(least, "least"), 48, broadcast_bytes), "component")
    named = linked.select("fp", "n", "component_id").unionAll(placed.filter("component is null").select("fp", "n", "first"))
    named = stored(named, "named")
    most = (prints.agg(F.sum("n")).first()[0] or 0) * HOT
    hot = named.filter(F.col("n") > most).select("fp", "component_id")  # fewer than 1 / HOT
    often = rows.join(F.broadcast(hot), "fp")
    rare = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named.filter(F.col("n") <= most).select("fp", "component_id"), "fp")
    both = often.select("id", "fp", "component_id").unionAll(rare.select("id", "fp", "component_id"))
    return both.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
