"""Properties: their registry from transactions, matches of assessed records, markets, and replay of party decisions.

Defined results: rows without an address, a name or a pin match nothing by it; repeated rows count once; empty tables
give empty results; columns not named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import addresses as A
from tessera.operators.parties import numbered
from tessera.operators.resolve import fuzzy_best, written

#: The directions tried at the end of an address, in this order.
DIRECTIONS = ["NORTH", "SOUTH", "EAST", "WEST"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.trim("address") != "").withColumn("key", A.dedup_key(F.col("address"), F.col("city")))


def property_registry(transactions: DataFrame, existing: DataFrame) -> DataFrame:
    """pid, key, rt_ids, folded: every property with its transactions and the older properties that went into it.

    ``transactions`` has rt_id, address, city, pins (array); ``existing`` pid, address, city, pin. A transaction stands
    under its address; one of several numbers also under each single address that another transaction has alone. The
    first pin of another property than the address's takes the transaction there. Of properties with one key the last
    counts. Properties without a transaction go into one that has some if the keys are equal or differ by one side's
    direction (the smallest pid of several), else they stay; they are not compared with each other.
    """
    tx, old = written(_keyed(transactions)), written(_keyed(existing))
    alone = tx.select("key", "rt_id")
    singles = tx.withColumn("each", A.expanded(F.col("address"), F.lit(""), F.lit(""))).filter(F.size("each") > 1).select("rt_id", "city", F.explode("each").alias("single"))
    shared = singles.select(A.dedup_key(F.col("single"), F.col("city")).alias("key"), "rt_id").join(alone.select("key").distinct(), "key", "left_semi")
    by_key, by_pin = old.groupBy("key").agg(F.max("pid").alias("pid")), old.filter("pin is not null").groupBy("pin").agg(F.max("pid").alias("pin_pid"))
    placed = alone.union(shared).distinct().join(by_key, "key", "left")
    pins = tx.select("rt_id", F.posexplode("pins").alias("pos", "pin")).join(by_pin, "pin")
    moved = placed.join(pins, "rt_id").filter(~F.col("pin_pid").eqNullSafe(F.col("pid"))).groupBy("key", "rt_id").agg(F.min_by("pin_pid", "pos").alias("pin_pid"))
    to = moved.join(old.select(F.col("pid").alias("pin_pid"), F.col("key").alias("to")), "pin_pid").select("key", "rt_id", "to")
    final = placed.join(to, ["key", "rt_id"], "left").select(F.coalesce("to", "key").alias("key"), "rt_id")
    groups = final.groupBy("key").agg(F.array_sort(F.collect_set("rt_id")).alias("rts"), F.min("rt_id").alias("first"))
    groups = written(groups.join(by_key, "key", "left").withColumn("order", F.concat_ws("|", "first", "key")))
    highest = old.agg(F.max(F.substring("pid", 2, 20).try_cast("long"))).first()[0] or 0
    fresh = numbered(groups.filter("pid is null").select("order"), "order").select("order", F.format_string("P%05d", F.col("number") + highest).alias("new"))
    claimed = written(groups.join(fresh, "order", "left").select(F.coalesce("pid", "new").alias("pid"), "key", F.array_join("rts", ",").alias("rt_ids")))
    rest = old.select("pid", "key").join(claimed.select("pid"), "pid", "left_anti")
    into = claimed.select(F.col("pid").alias("target"), F.col("key").alias("other"))
    met = rest.join(into, rest["key"] == into["other"])
    met = met.union(rest.join(into, A.without_direction(rest["key"]) == into["other"])).union(rest.join(into, rest["key"] == A.without_direction(into["other"])))
    folds = written(met.groupBy("pid").agg(F.min("target").alias("target")))
    folded = folds.groupBy(F.col("target").alias("pid")).agg(F.array_join(F.array_sort(F.collect_set("pid")), ",").alias("folded"))
    kept = rest.join(folds, "pid", "left_anti").select("pid", "key", F.lit("").alias("rt_ids"))
    return claimed.union(kept).join(folded, "pid", "left").select("pid", "key", "rt_ids", F.coalesce("folded", F.lit("")).alias("folded"))


def cascade_match(records: DataFrame, existing: DataFrame) -> DataFrame:
    """id, pid (null if none): records (id, address, city) and the property of their key, or else of the key without the
    direction at the end of its address, or else with each direction put there. Up to six keys a record meet
    the properties (pid, address, city) in one equi-join; of properties with one key the last counts."""
    at = _keyed(records).select("id", A.dedup_address(F.col("address")).alias("a"), A.dedup_city(F.col("city")).alias("c"))
    bare = A.without_direction(F.col("a"))
    tries: list[Column] = [F.col("a"), F.when(bare != F.col("a"), bare), *[F.concat_ws(" ", "a", F.lit(d)) for d in DIRECTIONS]]
    keys = at.select("id", "c", F.posexplode(F.array(*tries)).alias("rank", "try")).filter("try is not null").select("id", "rank", F.concat_ws("|", "try", "c").alias("key"))
    found = keys.join(_keyed(existing).groupBy("key").agg(F.max("pid").alias("pid")), "key").groupBy("id").agg(F.min_by("pid", "rank").alias("pid"))
    return records.select("id").distinct().join(found, "id", "left")


def market_table(lists: list[DataFrame], aliases: DataFrame) -> DataFrame:
    """name, population: of several lists (name, population) the first that has a name counts, within a list the larger
    number; then aliases (name, canonical) that no list has."""
    ranked = lists[0].select("name", "population", F.lit(0).alias("rank"))
    for k, more in enumerate(lists[1:], 1):
        ranked = ranked.union(more.select("name", "population", F.lit(k)))
    base = ranked.groupBy("name").agg(F.min_by("population", F.struct("rank", -F.col("population"))).alias("population"))
    called = aliases.select("name", "canonical").join(base.withColumnRenamed("name", "canonical"), "canonical")
    return base.union(called.join(base, "name", "left_anti").groupBy("name").agg(F.max("population").alias("population")))


def replayed(members: DataFrame, splits: list[tuple[str, str]], merges: list[list[str]]) -> DataFrame:
    """id, gid: members (id, gid, nn, rt_id, role) of party groups after people's decisions, in their order.

    A split (name, target) takes a name out of the first group that has it and other names as well, into the target
    or a new group. A merge [target, source, ...] puts whole groups into one that exists; then the sources are gone.
    A member that comes to a group which had its transaction and role earlier is left out.

    The decisions are short lists made by hand. Only the groups of their names, and how many names those hold, come
    to the driver; what has moved goes back as two tables no longer than that, and members are joined to them.
    """
    spark = members.sparkSession
    told = spark.createDataFrame([(n,) for n in sorted({n for n, _ in splits if n})], "nn string")
    holders = members.join(told, "nn").select("gid", "nn").distinct().collect()  # the groups of the names of the splits
    asked = {r.gid for r in holders} | {t for _, t in splits if t} | {g for m in merges for g in m}
    groups = spark.createDataFrame([(g,) for g in sorted(asked)], "gid string")
    size = {r.gid: r.n for r in members.join(groups, "gid").groupBy("gid").agg(F.count_distinct("nn").alias("n")).collect()}
    highest = members.agg(F.max(F.substring("gid", 2, 20).try_cast("long"))).first()[0] or 0
    names = {(r.gid, r.nn): (r.gid, 0) for r in holders}
    whole = {g: (g, 0) for g in size}
    step = 0
    for name, target in splits:
        step += 1
        source = min((g for (_, n), (g, _) in names.items() if n == name), default=None)
        if source is None or target == source or size[source] < 2:
            continue
        if not target:
            target = f"G{highest + 1:05d}"
        highest = max(highest, int(target[1:])) if target[1:].isdigit() else highest
        size[source] -= 1
        size[target] = size.get(target, 0) + (not any(n == name and g == target for (_, n), (g, _) in names.items()))
        names |= {k: (target, step) for k, (g, _) in names.items() if k[1] == name and g == source}
    for target, *sources in merges:
        for source in sources:
            step += 1
            if target in size and source in size and source != target:
                del size[source]
                for moved in (names, whole):
                    moved |= {k: (target, step) for k, (g, _) in moved.items() if g == source}
    by_name = spark.createDataFrame([(*k, *v) for k, v in names.items()], "gid string, nn string, name_gid string, name_step int")
    by_group = spark.createDataFrame([(k, *v) for k, v in whole.items()], "gid string, group_gid string, group_step int")
    now = members.select("id", "gid", "nn", "rt_id", "role").join(by_name, ["gid", "nn"], "left").join(by_group, "gid", "left")
    now = now.select("id", "rt_id", "role", F.coalesce("name_gid", "group_gid", "gid").alias("gid"), F.coalesce("name_step", "group_step", F.lit(0)).alias("step"))
    first = F.min("step").over(Window.partitionBy("gid", "rt_id", "role"))
    return now.withColumn("first", first).filter("step = first").select("id", "gid")


def street_match(stores: DataFrame, existing: DataFrame, least: float = 0.6, decimals: int = 6) -> DataFrame:
    """id, pid, score, reason: each store (id, address, city) and the property (pid, address, city) of its street number
    and city whose street is most alike, the smaller pid on ties. Those without one say why: no_street_number, no_match
    (no property there) or low_similarity."""

    def placed(rows: DataFrame, key: str) -> DataFrame:
        number, city = A.street_number(F.col("address")), A.dedup_city(F.coalesce("city", F.lit("")))
        return rows.select(F.col(key).alias("id"), F.concat_ws("|", number, city).alias("block"), number.isNotNull().alias("numbered"), F.array_join(A.street_tokens(F.col("address")), " ").alias("text"))

    left, right = written(placed(stores, "id")), written(placed(existing, "pid").filter("numbered"))
    told = fuzzy_best(left.filter("numbered and text <> ''"), right.filter("text <> ''"), "block", least, decimals).distinct()
    there = right.select("block").distinct().withColumn("there", F.lit(True))
    out = left.select("id", "block", "numbered").distinct().join(there, "block", "left").join(told, "id", "left")
    reason = F.when(F.col("match_id").isNotNull(), "").when(~F.col("numbered"), "no_street_number").when(F.col("there").isNull(), "no_match").otherwise("low_similarity")
    return out.select("id", F.col("match_id").alias("pid"), "score", reason.alias("reason"))
