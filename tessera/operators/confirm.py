"""Names of party groups that their own evidence confirms.

Within each group, names that share a phone or a contact hang together, and so do all names with an alias
that is in the group's display name or has it in itself. The names of the sub-cluster with such an alias are
confirmed; without any alias the largest sub-cluster is, if it has two names (of several the one of the
smallest name). Groups of one name are confirmed as they are; what was confirmed before is left out.

Sub-clusters are components within groups: edges carry a key of group and name, so that one pass of connected
components over all groups does what a loop over them would. A phone that very many names of a group share gives
one edge for each of them, never their pairs.

Defined results: empty phones, contacts, aliases and names say nothing; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import resolve


def auto_confirmed(appearances: DataFrame, groups: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """gid, name: names to confirm. ``appearances`` has gid, name (normalized), phone, contact, aliases (array);
    ``groups`` has gid, display_name; ``confirmed`` (gid, name) is known."""
    rows = appearances.filter(F.coalesce("name", F.lit("")) != "")
    names = resolve.written(rows.select("gid", "name").distinct())
    number = names.groupBy("gid").agg(F.count("*").alias("n"), F.min("name").alias("only"))
    alone = number.filter("n = 1").select("gid", F.col("only").alias("name"))
    several = number.filter("n > 1").select("gid")
    held = resolve.written(names.join(several, "gid").withColumn("id", F.concat_ws("|", "gid", "name")))
    many = rows.join(several, "gid").withColumn("id", F.concat_ws("|", "gid", "name"))
    said = F.array(F.struct(F.lit("phone").alias("kind"), F.trim("phone").alias("value")), F.struct(F.lit("contact").alias("kind"), F.upper(F.trim("contact")).alias("value")))
    signals = many.select("gid", "id", F.inline(said)).filter("value <> ''").withColumn("key", F.concat_ws("|", "gid", "kind", "value")).select("key", "id").distinct()
    shown = groups.select("gid", F.upper(F.trim("display_name")).alias("shown")).filter("shown <> ''")
    aliased = many.select("gid", "id", F.explode("aliases").alias("alias")).filter("alias <> ''").join(shown, "gid")
    aliased = resolve.written(aliased.filter(F.col("shown").contains(F.upper("alias")) | F.upper("alias").contains(F.col("shown"))).select("gid", "id").distinct())
    edges = resolve.star_edges(signals, "key", "id").union(resolve.star_edges(aliased, "gid", "id"))
    linked = resolve.components(edges.distinct())
    placed = resolve.written(held.join(linked, "id", "left").select("gid", "name", "id", F.coalesce("component", "id").alias("cluster")))
    sizes = placed.groupBy("gid", "cluster").agg(F.count("*").alias("n"), F.min("name").alias("first"))
    largest = sizes.groupBy("gid").agg(F.min_by(F.struct("cluster", "n"), F.struct(-F.col("n"), "first")).alias("l")).filter("l.n > 1").select("gid", F.col("l.cluster").alias("largest"))
    branded = placed.join(aliased.select("id"), "id").groupBy("gid").agg(F.min("cluster").alias("branded"))  # one cluster holds them all
    chosen = several.join(largest, "gid", "left").join(branded, "gid", "left").select("gid", F.coalesce("branded", "largest").alias("cluster")).filter("cluster is not null")
    out = alone.unionByName(placed.join(chosen, ["gid", "cluster"]).select("gid", "name"))
    return out if confirmed is None else out.join(confirmed.select("gid", "name").distinct(), ["gid", "name"], "left_anti")
