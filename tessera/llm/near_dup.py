"""Near-duplicate documents by ProbMinHash.

A text is its shingles of five words (lower-cased runs of letters, digits and
underscores; a shorter text is one shingle), each weighted 1 + log2 of how often
it occurs. Every shingle sends arrivals of a Poisson process whose rate is its
weight; an arrival goes to a random component of the signature, and a component
keeps the shingle that arrived first. A shingle stops as soon as its time passes
the latest component of its document. Two components agree with the probability
Jaccard similarity of the weighted shingles.

Equal word sequences are one text from here on. Texts that agree in a band of
``ROWS`` components are candidates: all members of a bucket are compared with the
smallest one. Texts of buckets whose members are then still in different groups
go through an exact prefix-filtered join (``across``), so no bucket is expanded
into all pairs, and no link between groups is lost. Candidates are verified exactly: the larger of the
Jaccard similarity of the shingle sets and the probability Jaccard similarity of
the weighted shingles must reach ``threshold``. At similarity 0.8 a pair shares
no band with probability 3e-5. Groups are the connected components of the links.

What is linked are different word sequences, each under a number of its own (``node``);
ids only name the groups at the end.

Defined results: texts without words are groups of their own; rows without id belong
to groups like any others; repeated rows are copies; class_id is the smallest id of
the group, null if no row of it has one. If an id stands on rows of several groups, a
group takes its smallest id that stands on rows of no other text, if it has one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import chunks
from tessera.llm.scratch import BROADCAST_BYTES, broadcast_if_small, fits, python_batches, release, stored
from tessera.operators import resolve

SHINGLE = 5
BANDS, ROWS = 20, 4
THRESHOLD = 0.8
#: 64-bit words of a text's parity sketch.
SKETCH = 8
_WORDS = re.compile(r"\w+").findall
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, hashes, counts, keys): each text's different shingles in order of
    hash with how often they occur, and a 128-bit key of its word sequence (two columns)."""
    digest = xxhash.xxh3_64_intdigest
    words = [_WORDS(t.lower()) if t else [] for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((digest(x) for w in words for x in w), dtype=np.uint64, count=int(n.sum()))
    keys = np.array([(lambda d: (d >> 64, d & (2**64 - 1)))(xxhash.xxh3_128_intdigest("\n".join(w))) for w in words], dtype=np.uint64).reshape(-1, 2)
    starts = np.cumsum(n) - n
    each = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    doc = np.repeat(np.arange(len(texts)), each)
    at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts, each)
    h = np.zeros(len(at), dtype=np.uint64)
    stop = np.repeat(starts + n, each)
    for k in range(size):
        inside = at + k < stop
        word = flat[np.minimum(at + k, max(len(flat) - 1, 0))] if len(flat) else h
        h = np.where(inside, _mix(h * _U(0x9E3779B97F4A7C15) + word + _U(k + 1)), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(h)))
    bounds = np.searchsorted(doc[first], np.arange(len(texts) + 1))
    return bounds, h[first], counts, keys


def prob_minhash(bounds: np.ndarray, hashes: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The signatures of many documents; rows of documents without shingles are 0."""
    docs = len(bounds) - 1
    sig = np.zeros(docs * m, dtype=np.uint64)
    best = np.full(docs * m, np.inf)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    h, rate, time, turn = hashes, weights.astype(np.float64), np.zeros(len(hashes)), 0
    while len(h):
        turn += 1
        r = _mix(h + _U((turn * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        time = time - np.log(((r >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
        slot = doc * m + (_mix(r) % _U(m)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        sig[slot[won]] = h[won]
        latest = best.reshape(docs, m).max(axis=1)
        on = time < latest[doc]
        h, rate, time, doc = h[on], rate[on], time[on], doc[on]
    return sig.reshape(docs, m)


def similarity(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray) -> float:
    """The larger of set Jaccard and probability Jaccard of two texts' shingles (sorted hashes, counts)."""
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(ha) + len(hb) - len(both))
    wa, wb = 1 + np.log2(ca), 1 + np.log2(cb)
    rest = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    xa, xb = wa[ia], wb[ib]
    total = 0.0
    ratios, which = np.unique(xa / xb, return_inverse=True)
    for k, t in enumerate(ratios):  # few, as counts are small
        total += xa[which == k].sum() / (rest[0] + t * rest[1] + np.maximum(xa, t * xb).sum())
    return max(plain, float(total))


def _short_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks.runs(batch.column("text")):
            yield batch.slice(a, b - a)


def _signatures(bands: int, rows: int, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short_batches(batches):
            bounds, h, counts, keys = shingles(batch.column("text").to_pylist(), size)
            sig = prob_minhash(bounds, h, 1 + np.log2(counts), bands * rows)
            band = np.zeros((len(sig), bands), dtype=np.uint64)
            for b in range(bands):
                x = np.full(len(sig), b + 1, dtype=np.uint64)
                for c in range(rows):
                    x = _mix(x * _U(0x9E3779B97F4A7C15) + sig[:, b * rows + c])
                band[:, b] = x
            wordless = np.diff(bounds) == 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * bands, pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
            k = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sum"), pa.array(k[:, 0], mask=wordless), pa.array(k[:, 1], mask=wordless), lists], ["id", "sum", "k1", "k2", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short_batches(batches):
            bounds, h, counts, _ = shingles(batch.column("text").to_pylist(), size)
            parts = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], [counts[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], ["id", "h", "c"])

    return run


def _verify(threshold: float):
    """Rows come sorted by pivot and part; the row without other holds the pivot's own shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ha, ca = None, None, None
        for batch in batches:
            a, b = [], []
            for pivot, other, h, c in zip(*(batch.column(x).to_pylist() for x in ("pivot", "other", "h", "c")), strict=True):
                h, c = np.frombuffer(h, dtype=np.uint64), np.frombuffer(c, dtype=np.int32)
                if other is None:
                    now, ha, ca = pivot, h, c
                elif pivot == now and min(len(ha), len(h)) > 0 and similarity(ha, ca, h, c) >= threshold:
                    a.append(pivot)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _weights(size: int):
    """The shingles of each text as rows, with their weights. Made from the sets in one function: each Python step of
    a stage has workers of its own, which stay for the stages after it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sets(size)(batches):
            for id_, h, c in zip(*(batch.column(x).to_pylist() for x in ("id", "h", "c")), strict=True):
                h, w = np.frombuffer(h, dtype=np.int64), 1 + np.log2(np.frombuffer(c, dtype=np.int32))
                for at in range(0, len(h), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[part]), id_), pa.int64()), pa.array(h[part]), pa.array(w[part])], ["id", "shingle", "weight"])

    return run


def _texts_of(ids: DataFrame, docs: DataFrame, reps: DataFrame | None, broadcast_bytes: int) -> DataFrame:
    """id, text of the stated nodes. ``reps`` says which row of ``docs`` shows a node (id, sum); without it
    nodes are the ids of ``docs``."""
    if reps is None:
        return docs.join(broadcast_if_small(ids, 32, broadcast_bytes), "id", "left_semi").dropDuplicates(["id"])
    rows = broadcast_if_small(reps.join(broadcast_if_small(ids.select(F.col("id").alias("node")), 32, broadcast_bytes), "node", "left_semi"), 64, broadcast_bytes)
    met = docs.join(rows, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("sum") == F.col("rep_sum")))
    return met.select(F.col("node").alias("id"), "text").dropDuplicates(["id"])


def across(left: DataFrame, docs: DataFrame, size: int, threshold: float, broadcast_bytes: int, reps: DataFrame | None = None) -> DataFrame:
    """pivot, other: all pairs of ``left`` (id, class_id) from different classes that can reach
    the threshold, by a prefix-filtered join.

    Shingles are put in one order, the rarest first. The shingles that a text does not
    share with a text as alike as ``threshold`` are at most 1 - threshold of its number
    (set Jaccard) or of its weight (probability Jaccard is at most the shared weight of
    either text over its whole weight). So the first shingle that the two share is in the
    prefix of both that reaches past that part. A passage that many texts hold is
    frequent, so it lies behind their prefixes and brings no pairs. Where two texts meet
    at a shingle, what lies ahead of it bounds their similarity further: with unshared
    parts u, v of their weights, probability Jaccard is at most the harmonic mean of
    (1-u)/(1+u) and (1-v)/(1+v). Classes meet before their members do, so the members
    of a class are never paired with each other.

    What lies behind the shingle is bounded by parity sketches: every shingle flips one
    bit, so two texts share all but at least as many shingles as bits differ. Weights
    are 1 or more, so with D such shingles u + v >= D / T for the larger whole weight T,
    and the harmonic mean is at most (2 - D/T) / (2 + D/T); the bound on set Jaccard
    follows from this one. For classes a bit differs if all members of one have it and
    none of the other. The conditions stand in the join, so what cannot be alike makes no rows.
    """
    tokens = stored(_texts_of(left.select("id"), docs, reps, broadcast_bytes).mapInArrow(_weights(size), "id long, shingle long, weight double"), "shingles")
    ranked = tokens.join(tokens.groupBy("shingle").agg(F.count("*").alias("holders")), "shingle")
    own = Window.partitionBy("id")
    order, slack = own.orderBy("holders", "shingle"), 1 - threshold + 1e-9
    ahead = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    flipped = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    word = F.pmod(F.shiftright("shingle", 6), F.lit(SKETCH))
    sketch = [F.bit_xor(F.when(word == i, flipped).otherwise(F.lit(0).cast("long"))).over(own).alias(f"s{i}") for i in range(SKETCH)]
    ranked = ranked.select("id", "shingle", "holders", ahead.alias("ahead"), (F.row_number().over(order) - 1).alias("rank"), F.sum("weight").over(own).alias("total"), F.count("*").over(own).alias("n"), *sketch)
    ranked = ranked.withColumn("mass", F.col("ahead") / F.col("total")).withColumn("part", F.col("rank") / F.col("n"))
    prefix = ranked.filter((F.col("mass") <= slack) | (F.col("part") <= slack)).filter("holders > 1")
    prefix = stored(prefix.select("id", "shingle", "mass", "part", "rank", "n", "total", *(f"s{i}" for i in range(SKETCH))).join(left, "id"), "prefixes")
    # of two texts, what lies ahead of the first shared shingle is not shared: that bounds both similarities
    c, eps = threshold / (1 + threshold), 1e-9
    alike = lambda m: (1 - F.col(m)) / (1 + F.col(m))
    weighted = lambda a, b: 2 * alike(a) * alike(b) >= (threshold - eps) * (alike(a) + alike(b))
    over = lambda f: F.greatest((1 - F.col(f)) / c - 1 + eps, F.lit(0.0))
    near = lambda bits, s, t: sum(map(F.bit_count, bits)) <= 2 * (1 - threshold) / (1 + threshold) * F.greatest(s, t) + eps
    both = [agg(f"s{i}").alias(f"{name}{i}") for i in range(SKETCH) for agg, name in ((F.bit_and, "all"), (F.bit_or, "any"))]
    kinds = prefix.groupBy("shingle", "class_id").agg(F.min("mass").alias("m"), F.min("part").alias("f"), F.max("total").alias("t"), *both)
    side = lambda k: kinds.select("shingle", F.col("class_id").alias(f"c{k}"), *(F.col(c).alias(f"{c}_{k}") for c in kinds.columns[2:]))
    bit = lambda name, i, k: F.col(f"{name}{i}_{k}")
    differ = [bit("all", i, x).bitwiseAND(F.bitwise_not(bit("any", i, y))) for i in range(SKETCH) for x, y in ("ab", "ba")]
    met = side("a").join(side("b"), "shingle").filter((F.col("ca") < F.col("cb")) & (weighted("m_a", "m_b") | (over("f_a") * over("f_b") >= 1)) & near(differ, F.col("t_a"), F.col("t_b")))
    met = met.select("shingle", "ca", "cb", *(f"{c}_b" for c in kinds.columns[2:]))
    own_columns = ("mass", "rank", "n", "total", *(f"s{i}" for i in range(SKETCH)))
    member = lambda k, x: prefix.select("shingle", F.col("class_id").alias(f"c{k}"), F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in own_columns))
    # each member of a class meets the other class before it meets that one's members
    alone = [F.col(f"s{i}_x").bitwiseAND(F.bitwise_not(bit("any", i, "b"))) for i in range(SKETCH)] + [bit("all", i, "b").bitwiseAND(F.bitwise_not(F.col(f"s{i}_x"))) for i in range(SKETCH)]
    alone = (weighted("mass_x", "m_b") | (F.greatest((1 - F.col("rank_x") / F.col("n_x")) / c - 1 + eps, F.lit(0.0)) * over("f_b") >= 1)) & near(alone, F.col("total_x"), F.col("t_b"))
    half = met.join(member("a", "x"), ["shingle", "ca"]).filter(alone).select("shingle", "ca", "cb", "x", *(f"{c}_x" for c in own_columns))
    sets_meet = F.least(F.col("n_x") - F.col("rank_x"), F.col("n_y") - F.col("rank_y")) >= c * (F.col("n_x") + F.col("n_y")) - eps
    differ = [F.col(f"s{i}_x").bitwiseXOR(F.col(f"s{i}_y")) for i in range(SKETCH)]
    pairs = half.join(member("b", "y"), ["shingle", "cb"]).filter((sets_meet | weighted("mass_x", "mass_y")) & near(differ, F.col("total_x"), F.col("total_y")))
    return pairs.select(F.least("x", "y").alias("pivot"), F.greatest("x", "y").alias("other")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, size: int, threshold: float, broadcast_bytes: int, reps: DataFrame | None = None) -> DataFrame:
    """The (pivot, other) pairs that reach the threshold, as a, b."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("pivot").alias("id")).union(pairs.select("other")).distinct()
    sets = stored(_texts_of(stored(ids, "involved"), docs, reps, broadcast_bytes).mapInArrow(_sets(size), "id long, h binary, c binary"), "sets")
    part = F.pmod(F.xxhash64("other"), F.lit(64)).alias("part")
    others = pairs.select("pivot", part, "other").join(sets, F.col("other") == F.col("id")).select("pivot", "part", "other", "h", "c")
    pivots = pairs.select("pivot", part).distinct().join(sets, F.col("pivot") == F.col("id")).select("pivot", "part", F.lit(None).cast("long").alias("other"), "h", "c")
    rows = others.unionByName(pivots).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pivot", "part")
    rows = rows.sortWithinPartitions("pivot", "part", F.col("other").asc_nulls_first())
    return rows.select("pivot", "other", "h", "c").mapInArrow(_verify(threshold), "a long, b long")


def _sums(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sum, text: a row's text is known by its hash, as an id may stand on several texts."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("sum"), text.alias("text"))


def _grouped(docs: DataFrame, threshold: float, bands: int, rows: int, size: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): id, sum, k1, k2 of every row of ``docs`` (id, sum, text), and for each different word
    sequence k1, k2, copies, links, its group, and the first row of the group (first: none, id, sum)."""
    python_batches(docs.sparkSession)
    sigs = stored(docs.mapInArrow(_signatures(bands, rows, size), "id long, sum long, k1 long, k2 long, bands array<long>"), "signatures")
    row = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "sum")
    texts = sigs.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(row).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    reps = texts.select("node", F.when(~F.col("rep.none"), F.col("rep.id")).alias("rep_id"), F.col("rep.sum").alias("rep_sum"))
    buckets = texts.select("node", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("bucket", "pivot")
    full = stored(full, "buckets")
    met = stored(buckets.join(broadcast_if_small(full, 48, broadcast_bytes), "bucket"), "members")
    star = stored(met.filter("node <> pivot").select("pivot", F.col("node").alias("other")).distinct(), "star")
    links = stored(verified(star, docs, size, threshold, broadcast_bytes, reps), "links")
    groups = resolve.components(links)
    # members of a bucket that are still in different groups
    placed = met.select("bucket", F.col("node").alias("id")).join(groups, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("class_id"))
    mixed = placed.groupBy("bucket").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter("lo <> hi").select("bucket")
    left = placed.join(broadcast_if_small(stored(mixed, "mixed"), 32, broadcast_bytes), "bucket", "left_semi").select("id", "class_id").distinct()
    cross = stored(across(stored(left, "left"), docs, size, threshold, broadcast_bytes, reps), "cross")
    if not cross.isEmpty():
        cross = cross.join(star, ["pivot", "other"], "left_anti")
        links = stored(links.unionByName(verified(cross, docs, size, threshold, broadcast_bytes, reps)), "links")
        groups = resolve.components(links)
    degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    named = texts.select("k1", "k2", "node", "rep", "copies").join(groups.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left")
    named = stored(named.select("k1", "k2", F.coalesce("component", "node").alias("group"), "rep", "copies", F.coalesce("links", F.lit(0)).alias("links")), "named")
    first = named.groupBy("group").agg(F.min("rep").alias("first"), F.count("*").alias("texts")).filter("texts > 1").select("group", "first")
    named = named.join(broadcast_if_small(first, 80, broadcast_bytes), "group", "left").withColumn("first", F.coalesce("first", "rep"))
    for old in (full, met, star, mixed):
        release(old)
    return sigs.drop("bands"), named.drop("rep")


def _class_ids(rows: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Adds class_id to rows of id, k1, k2, group, first."""
    smallest = F.when(~F.col("first.none"), F.col("first.id"))
    several = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
    several = stored(several.filter("lo <> hi").select(F.col("id").alias("several_id")), "several")
    if several.isEmpty():
        return rows.withColumn("class_id", F.when(F.col("k1").isNull(), F.col("id")).otherwise(smallest))
    alone = rows.filter("k1 is not null").join(broadcast_if_small(several, 32, broadcast_bytes), F.col("id") == F.col("several_id"), "left_anti")
    alone = alone.groupBy("group").agg(F.min("id").alias("alone"))
    rows = rows.join(alone, "group", "left")
    return rows.withColumn("class_id", F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.coalesce("alone", smallest)))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row: id, class_id, copies (rows with the same words), links (other texts it was verified with)."""
    sigs, texts = _grouped(_sums(docs, id_col, text_col), threshold, bands, rows, size, broadcast_bytes)
    out = _class_ids(sigs.join(texts, ["k1", "k2"], "left"), broadcast_bytes)
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row of each group, that of the smallest id (rows without id last), with all its columns; rows
    without words stay. Repeats of the row that stays go too."""
    sigs, texts = _grouped(_sums(docs, id_col, text_col), threshold, bands, rows, size, broadcast_bytes)
    stays = F.col("id").isNull().eqNullSafe(F.col("first.none")) & (F.coalesce("id", F.lit(0)) == F.col("first.id")) & (F.col("sum") == F.col("first.sum"))
    marked = sigs.filter("k1 is not null").join(texts.select("k1", "k2", "first"), ["k1", "k2"]).select(F.col("id").alias("dup_id"), F.col("sum").alias("dup_sum"), stays.alias("stays"))
    marked = stored(marked, "marked")
    gone = marked.filter("not stays").select("dup_id", "dup_sum").distinct()
    again = stored(marked.filter("stays").groupBy("dup_id", "dup_sum").count().filter("count > 1").select("dup_id", "dup_sum"), "again")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key, total = F.col("row").getField(id_col).cast("long"), F.xxhash64(F.col("row").getField(text_col))
    same = key.eqNullSafe(F.col("dup_id")) & (total == F.col("dup_sum"))
    kept = packed.join(broadcast_if_small(gone, 64, broadcast_bytes), same, "left_anti")
    if not again.isEmpty():  # rows repeated whole: one of them stays
        again = F.broadcast(again) if fits(again, 64, broadcast_bytes) else again
        once = kept.join(again, same, "left_semi").withColumn("dup_key", key).withColumn("dup_total", total).dropDuplicates(["dup_key", "dup_total"]).select("row")
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
