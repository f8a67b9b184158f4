"""Parties from appearances in transactions: which appearances belong together, and their registry.

An appearance has id, name, phones (array), contact, address and is_company. Defined results:
null names, phones, contacts and addresses link nothing; repeated rows link like others; the
component of an appearance that nothing links to another is its own id. Appearances may have
alternate_names (array) as well; without that column the rule on them links nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import resolve

#: So many different names make a phone, a brand or an address say nothing.
PHONE_NAMES, BRAND_NAMES, ADDRESS_NAMES = 15, 8, 5
#: Most different names of two groups that an alternate name joins, and words that begin a unit within a building.
COMBINED_NAMES = 50
UNITS = ["SUITE", "STE", "UNIT", "APT", "FLOOR", "FL", "RM", "ROOM", "#"]
#: Shortest phone, address and brand that counts.
PHONE_DIGITS, ADDRESS_CHARS, BRAND_CHARS = 7, 10, 4


def _prepared(appearances: DataFrame) -> DataFrame:
    name, contact = F.col("name"), F.nullif(T.normalize_contact(F.col("contact")), F.lit(""))
    return appearances.select(
        "id", T.normalize_name(name).alias("nn"), F.coalesce(T.numbered_company(name), F.lit(False)).alias("numbered"), contact.alias("contact"),
        F.array_distinct(F.transform("phones", T.normalize_phone)).alias("phones"), "address", "is_company", T.brand_token(name).alias("token"),
    )


def by_name(a: DataFrame) -> DataFrame:
    """Equal names, numbered companies left out."""
    return resolve.star_edges(a.filter("not numbered and nn is not null"), "nn", "id")


def by_phone(a: DataFrame) -> DataFrame:
    """Equal phones; a phone of many names links only those that share a contact as well."""
    rows = a.select("id", "nn", "contact", F.explode("phones").alias("phone")).filter(F.length("phone") >= PHONE_DIGITS)
    spread = rows.groupBy("phone").agg((F.count_distinct("nn") >= PHONE_NAMES).alias("busy"))
    rows = rows.join(spread, "phone")
    gated = rows.filter("busy and contact is not null").withColumn("key", F.concat_ws("|", "phone", "contact"))
    return resolve.star_edges(rows.filter("not busy"), "phone", "id").union(resolve.star_edges(gated, "key", "id"))


def by_brand(a: DataFrame) -> DataFrame:
    """Equal brand tokens; a token counts as the shortest other one that it begins with, if that has four letters.
    The words of a token are few, so its beginnings are joined to the tokens that exist."""
    rows = a.filter("not numbered and token is not null").select("id", "nn", "token")
    tokens = rows.select("token").distinct()
    words = F.split("token", " ")
    begun = tokens.select("token", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))).alias("begins"))
    begun = begun.filter((F.length("begins") >= BRAND_CHARS) | (F.col("begins") == F.col("token")))
    folded = begun.join(tokens.withColumnRenamed("token", "begins"), "begins").groupBy("token").agg(F.min_by("begins", F.length("begins")).alias("brand"))
    return resolve.star_edges(rows.join(folded, "token"), "brand", "id", BRAND_NAMES, "nn")


def by_address(a: DataFrame) -> DataFrame:
    """Companies at one address, unless very different names are there."""
    rows = a.filter(F.col("is_company") & (F.length("address") >= ADDRESS_CHARS)).withColumn("place", T.normalize_party_address(F.col("address")))
    return resolve.star_edges(rows, "place", "id", ADDRESS_NAMES, "nn")


def by_number_and_contact(a: DataFrame) -> DataFrame:
    """Numbered companies of one name and contact."""
    rows = a.filter("numbered and contact is not null").withColumn("key", F.concat_ws("|", "nn", "contact"))
    return resolve.star_edges(rows, "key", "id")


def base_address(address: Column) -> Column:
    """A normalized address without its units; null unless it begins with a number."""
    s = F.regexp_replace(T.normalize_party_address(address), rf",? *(?:{'|'.join(UNITS)}) *[0-9]+[A-Z0-9_]*", "")
    s = F.regexp_replace(F.trim(s), r" *,? *$", "")
    return F.when(s.rlike("^[0-9]"), s)


def alternate_candidates(appearances: DataFrame) -> DataFrame:
    """id, pos, a, b: appearances (a) and the first of those named like one of their alternate names (b), where the base
    of a's address is that of the commonest address of that name; in the order of id and pos."""
    name = T.normalize_name(F.col("name"))
    rows = appearances.select("id", name.alias("nn"), F.coalesce(T.numbered_company(F.col("name")), F.lit(False)).alias("numbered"), F.trim("address").alias("address"), "alternate_names")
    named = rows.filter("not numbered and nn is not null")
    places = named.filter(F.length("address") >= ADDRESS_CHARS).select("id", "nn", T.normalize_party_address(F.col("address")).alias("place"))
    counts = places.groupBy("nn", "place").agg(F.count("*").alias("n"), F.min("id").alias("seen"))
    usual = counts.groupBy("nn").agg(F.max_by("place", F.struct("n", -F.col("seen"))).alias("place"))
    firsts = named.groupBy("nn").agg(F.min("id").alias("b")).join(usual, "nn").select(F.col("nn").alias("alt"), "b", base_address(F.col("place")).alias("there"))
    said = rows.select("id", base_address(F.col("address")).alias("here"), F.posexplode("alternate_names").alias("pos", "said")).filter("said <> '' and here is not null")
    said = said.select("id", "pos", "here", T.normalize_name(F.col("said")).alias("alt"))
    return said.join(firsts, "alt").filter(F.col("here") == F.col("there")).select("id", "pos", F.col("id").alias("a"), "b")


def _united(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates in the order of part, id and pos; of each part the unions that the guard on names admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parent, names = None, {}, {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            taken = []
            for p, a, b, na, nb in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b", "na", "nb")), strict=True):
                if p != part:
                    part, parent, names = p, {}, {}
                ra, rb = root(a), root(b)
                both = names.setdefault(ra, frozenset(na)) | names.setdefault(rb, frozenset(nb))
                if ra != rb and len(both) <= most:
                    parent[rb] = ra
                    del names[rb]
                    names[ra] = both
                    taken.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in taken], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def by_alternate(appearances: DataFrame, linked: DataFrame, most: int = COMBINED_NAMES) -> DataFrame:
    """a, b: unions of components by alternate names, as if candidates were taken one after the other: a pair joins two
    components unless they are one by then or have more than ``most`` different names together.

    ``linked`` (id, component) are the components of the rules before. Between two components only the first
    candidate counts, as what the guard rejects it rejects later too; for that reason components of more names than it
    allows are left out before. What remains falls into parts that share no component, and each part runs through one
    task in order, which holds no more than the names of the part's components.
    """
    of = lambda key, c: linked.select(F.col("id").alias(key), F.col("component").alias(c))
    pairs = alternate_candidates(appearances).join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    pairs = pairs.select("id", "pos", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
    first = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min_by(F.struct("a", "b"), F.struct("id", "pos")).alias("ab"), F.min(F.struct("id", "pos")).alias("at"))
    first = resolve.written(first.select("at.id", "at.pos", "ab.a", "ab.b"))
    ids = first.select(F.col("a").alias("component")).union(first.select("b")).distinct()
    everyone = appearances.select("id", T.normalize_name(F.col("name")).alias("nn")).join(linked, "id", "left").select(F.coalesce("component", "id").alias("component"), "nn").join(ids, "component", "left_semi").distinct()
    small = everyone.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("component")
    held = resolve.written(everyone.join(small, "component").groupBy("component").agg(F.collect_list(F.xxhash64("nn")).alias("names")))
    name = lambda key, c: held.select(F.col("component").alias(key), F.col("names").alias(c))
    pairs = resolve.written(first.join(name("a", "na"), "a").join(name("b", "nb"), "b"))
    parts = resolve.components(pairs.select("a", "b")).select(F.col("id").alias("a"), F.col("component").alias("part"))
    rows = pairs.join(parts, "a").select("part", "id", "pos", "a", "b", "na", "nb").repartition("part").sortWithinPartitions("part", "id", "pos")
    return rows.mapInArrow(_united(most), "a long, b long")


def evidence(appearances: DataFrame) -> DataFrame:
    """a, b, rule: the star edges of every rule; of the rule on alternate names, the unions it leads to."""
    a = resolve.written(_prepared(appearances))
    rules = {"name": by_name, "phone": by_phone, "brand": by_brand, "address": by_address, "number": by_number_and_contact}
    found = {name: resolve.written(rule(a).withColumn("rule", F.lit(name))) for name, rule in rules.items()}
    if "alternate_names" in appearances.columns:
        before = found["name"].union(found["phone"]).union(found["brand"])
        linked = resolve.components(before.select("a", "b").distinct())
        found["alternate"] = by_alternate(appearances, linked).withColumn("rule", F.lit("alternate"))
    out, *rest = found.values()
    for more in rest:
        out = out.unionByName(more)
    return resolve.written(out)


def clustered(appearances: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every appearance."""
    linked = resolve.components(evidence(appearances).select("a", "b").distinct())
    return appearances.select("id").distinct().join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def registry(appearances: DataFrame, clusters: DataFrame, known: DataFrame) -> DataFrame:
    """component, gid, display_name, names, appearances: one row for each cluster.

    ``known`` (name, gid) holds the normalized names of groups that exist. A cluster keeps the group of its
    first name that has one; of several clusters that ask for one group the first keeps it; others get new
    numbers in the order of their components. The display name is the commonest, companies before persons,
    the first seen on ties.
    """
    rows = appearances.join(clusters, "id").withColumn("nn", T.normalize_name(F.col("name")))
    counts = rows.groupBy("component", "name").agg(F.count("*").alias("n"), F.max("is_company").alias("company"), F.min("id").alias("seen"))
    shown = counts.groupBy("component").agg(F.max_by("name", F.struct("company", "n", -F.col("seen"))).alias("display_name"))
    names = rows.groupBy("component").agg(F.array_sort(F.collect_set("nn")).alias("names"), F.count("*").alias("appearances"))
    asked = rows.join(known, rows["nn"] == known["name"]).groupBy("component").agg(F.min_by("gid", "nn").alias("gid"))
    kept = asked.groupBy("gid").agg(F.min("component").alias("component"))
    out = resolve.written(names.join(shown, "component").join(kept, "component", "left"))
    highest = known.agg(F.max(F.substring("gid", 2, 20).try_cast("long"))).first()[0] or 0
    fresh = numbered(out.filter("gid is null").select("component"), "component")
    fresh = fresh.select("component", F.format_string("G%05d", F.col("number") + highest).alias("new_gid"))
    return out.join(fresh, "component", "left").select("component", F.coalesce("gid", "new_gid").alias("gid"), "display_name", F.array_join("names", ",").alias("names"), "appearances")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds number: 1, 2, ... in order, counted within ranges of the order, so that no task sees all rows."""
    ranged = resolve.written(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ranged.withColumn("own", own).join(F.broadcast(before), "part").select(*rows.columns, (F.col("own") + F.col("before")).alias("number"))
