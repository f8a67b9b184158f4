"""Evidence chains: how two parties hang together through what they share.

Parties and attributes are the two sides of a graph. A search goes out from every asked goal at once, or from
every source if these are fewer, a step at a time: the parties that the last step reached meet their attributes, each
attribute meets its holders, and those not reached before are the next frontier. Rows are (start, party), so a join
touches the frontier alone; a start that has all its ends, and one whose frontier is empty, drop out. An attribute of
very many holders is met in slices of ``SLICE``.

From goals, a party keeps the smallest of its shortest ways back, link by link from the goal: the smallest way to a
party goes on from the smallest to the one before it. The last step meets the sources that are still open alone, not
all whom it could reach.

Ties: of the shortest chains, each party on the way was reached over the attribute of the smallest kind and
value, and among equal ones from the smallest party.

Defined results: a pair without a chain of at most ``steps`` has steps and chain null; a source that is its
own goal has no steps; null attributes link nothing; repeated pairs, and repeated attributes, count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.resolve import dropped, written

#: Holders of an attribute that are met at once.
SLICE = 1024


def _reached(frontier: DataFrame, used: DataFrame | None, attributes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The attributes that a frontier (source, party) uses first, and what it reaches over them."""
    told = frontier.join(attributes, "party").select("source", "kind", "value", "party")
    told = told.groupBy("source", "kind", "value").agg(F.min("party").alias("via"))
    if used is not None:
        told = told.join(used, ["source", "kind", "value"], "left_anti")
    told = written(told)
    out = told.join(sizes, ["kind", "value"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    holders = attributes.join(sizes, ["kind", "value"]).withColumn("slice", F.pmod(F.xxhash64("party"), F.col("slices")).cast("int")).select("kind", "value", "slice", "party")
    met = out.join(holders, ["kind", "value", "slice"]).groupBy("source", "party").agg(F.min(F.struct("kind", "value", "via")).alias("by"))
    return told.select("source", "kind", "value"), met.select("source", "party", "by.kind", "by.value", "by.via")


def evidence_chains(attributes: DataFrame, pairs: DataFrame, steps: int = 3) -> DataFrame:
    """source, goal, steps, chain for each of ``pairs`` (source, goal), from ``attributes`` (party, kind, value).
    A chain reads "A -[kind: value]- B -[kind: value]- C"."""
    attributes = written(attributes.select("party", "kind", "value").dropna().distinct())
    sizes = attributes.groupBy("kind", "value").agg(F.count("*").alias("n")).filter("n > 1").select("kind", "value", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    sizes = written(sizes)
    pairs = written(pairs.select("source", "goal").distinct())
    sources, goals = (pairs.select(c).distinct().count() for c in ("source", "goal"))
    whole = (_from_goals if goals <= sources else _from_sources)(attributes, sizes, pairs, steps)
    return pairs.join(whole, ["source", "goal"], "left").select("source", "goal", "steps", "chain")


def _from_goals(attributes: DataFrame, sizes: DataFrame, pairs: DataFrame, steps: int) -> DataFrame:
    party = pairs.schema["goal"].dataType.simpleString()
    held = written(attributes.join(sizes, ["kind", "value"]).withColumn("slice", F.pmod(F.xxhash64("party"), F.col("slices")).cast("int")))
    open_ = pairs.filter("source <> goal")
    whole = pairs.filter("source = goal").select("source", "goal", F.lit(0).alias("steps"), F.col("goal").cast("string").alias("chain"))
    none = F.array().cast(f"array<struct<kind:string,value:string,via:{party}>>")
    frontier = open_.select("goal", F.col("goal").alias("party"), none.alias("way")).distinct()
    reached = frontier.select("goal", "party")
    way = lambda c: F.concat("by.way", F.array(F.struct("by.kind", "by.value", F.col(c).alias("via")))).alias("way")
    for step in range(1, steps + 1):
        told = written(frontier.join(held, "party").groupBy("goal", "kind", "value", "slices").agg(F.min("way").alias("way")))
        told = told.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        if step == steps:
            asked = open_.join(held, open_["source"] == held["party"]).select("goal", "source", "kind", "value", "slice")
            met = asked.join(told, ["goal", "kind", "value", "slice"]).groupBy("goal", "source").agg(F.min(F.struct("way", "kind", "value")).alias("by"))
            done = written(met.select("source", "goal", way("source")))
        else:
            met = told.join(held, ["kind", "value", "slice"]).groupBy("goal", "party").agg(F.min(F.struct("way", "kind", "value")).alias("by")).select("goal", "party", way("party"))
            fresh = written(met.join(reached, ["goal", "party"], "left_anti"))
            done = written(open_.join(fresh.withColumnRenamed("party", "source"), ["source", "goal"]).select("source", "goal", "way"))
            open_ = written(open_.join(done, ["source", "goal"], "left_anti"))
            reached = reached.union(fresh.select("goal", "party"))
            frontier = fresh.join(open_.select("goal").distinct(), "goal", "left_semi")
        link = lambda said, x: F.concat(x["via"].cast("string"), F.lit(" -["), x["kind"], F.lit(": "), x["value"], F.lit("]- "), said)
        whole = whole.unionByName(done.select("source", "goal", F.lit(step).alias("steps"), F.aggregate("way", F.col("goal").cast("string"), link).alias("chain")))
    return whole


def _from_sources(attributes: DataFrame, sizes: DataFrame, pairs: DataFrame, steps: int) -> DataFrame:
    open_ = pairs.filter("source <> goal")
    kind = pairs.schema["source"].dataType.simpleString()
    spark = pairs.sparkSession
    reached = written(open_.select("source", F.col("source").alias("party")).distinct().withColumns({"kind": F.lit(None).cast("string"), "value": F.lit(None).cast("string"), "via": F.lit(None).cast(kind), "step": F.lit(0)}))
    frontier, used = reached.select("source", "party"), None
    for step in range(1, steps + 1):
        told, met = _reached(frontier, used, attributes, sizes)
        fresh = written(met.join(reached.select("source", "party"), ["source", "party"], "left_anti").withColumn("step", F.lit(step)))
        if fresh.isEmpty():
            break
        before, reached = reached, written(reached.unionByName(fresh))
        dropped(before)
        used = told if used is None else written(used.union(told))
        done = open_.join(reached, (open_["source"] == reached["source"]) & (open_["goal"] == reached["party"])).select(open_["source"], "goal")
        open_ = written(open_.join(done, ["source", "goal"], "left_anti"))
        frontier = fresh.join(open_.select("source").distinct(), "source", "left_semi").select("source", "party")
    # back from the goals, all chains a step at a time
    at = pairs.select("source", "goal", F.col("goal").alias("now"), F.lit("").alias("tail"), F.lit(0).alias("gone"))
    whole = spark.createDataFrame([], f"source {kind}, goal {kind}, steps int, chain string")
    for _ in range(steps + 1):
        at = written(at)
        ended = at.filter(F.col("now") == F.col("source")).select("source", "goal", F.col("gone").alias("steps"), F.concat(F.col("now").cast("string"), F.col("tail")).alias("chain"))
        whole = whole.unionByName(ended)
        back = reached.select("source", F.col("party").alias("now"), "kind", "value", "via").filter("via is not null")
        link = F.concat(F.lit(" -["), "kind", F.lit(": "), "value", F.lit("]- "), F.col("now").cast("string"), "tail")
        at = at.filter(F.col("now") != F.col("source")).join(back, ["source", "now"]).select("source", "goal", F.col("via").alias("now"), link.alias("tail"), (F.col("gone") + 1).alias("gone"))
    return whole
