"""What people look at first: addresses that will not geocode, groups that look wrong, keywords, parcels with several
properties.

Defined results: null and blank texts have no issues and match no keyword; a row may have several issues; of equal
scores the smaller id comes first; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for an issue, and how suspicion is scored.
LEGAL = ["LOT", "LOTS", "BLOCK", "PLAN", "PART", "CONC"]
CORNERS = ["NEC", "SEC", "NWC", "SWC"]
SUITES = ["suite", "ste", "unit", "apt"]
BUILDINGS = ["commerce court", "toronto-dominion", "toronto dominion", "td bank", "royal bank", "first canadian", "bay adelaide", "brookfield"]
FORWARDED = ["transit", "attn", "attention"]
LEVELS = ["floor", "level", "flr"]
GARBAGE = ["PIN:", "cash:", "principal:"]
MOST_REVIEWED = 200


def _any(values: list[str], test) -> Column:
    found = F.lit(False)
    for v in values:
        found = found | test(v)
    return found


def property_issues(address: Column) -> Column:
    """The issues of a property's single address, with its city behind a comma."""
    text = F.coalesce(address, F.lit(""))
    first, words = F.substring_index(text, ",", 1), F.split(F.upper(text), r"\W+")
    corner = first.contains("/") | F.arrays_overlap(F.split(first, r"\W+"), F.array(*map(F.lit, CORNERS)))
    begun, legal = text.rlike("^[0-9]"), F.arrays_overlap(words, F.array(*map(F.lit, LEGAL)))
    issues = {"half_address": text.contains("1/2") | text.contains("½"), "intersection": corner, "legal_description": ~begun & legal, "no_street_number": ~begun & ~legal}
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in issues.items()])))


def party_issue(address: Column) -> Column:
    """The one issue of a party's address, null if it has none."""
    text = F.trim(address)
    low, words = F.lower(text), F.split(F.lower(F.trim(address)), r"\W+")
    at = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    level = at(0).isin(LEVELS) | (text.rlike("^[0-9]") & at(1).isin(LEVELS))
    forwarded = at(0).isin(FORWARDED) | low.startswith("c/o") | low.startswith("c/0")
    vague = ~text.contains(",") | ~F.substring_index(text, ",", 1).rlike("[0-9]")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string")).when(_any(GARBAGE, text.contains), "garbage_address").when(at(0).isin(SUITES), "suite_leading")
        .when(_any(BUILDINGS, low.startswith), "building_name").when(forwarded | level | vague, "minor_issues")
    )


def address_issues(rows: DataFrame, key: str, properties: Column, parties: Column) -> DataFrame:
    """key, issue: the different issues of each record's property addresses and party addresses (arrays)."""
    own = F.flatten(F.transform(F.coalesce(properties, F.array().cast("array<string>")), property_issues))
    others = F.array_compact(F.transform(F.coalesce(parties, F.array().cast("array<string>")), party_issue))
    return rows.select(key, F.explode(F.array_distinct(F.concat(own, others))).alias("issue")).distinct()


def review_queue(groups: DataFrame, most: int = MOST_REVIEWED) -> DataFrame:
    """gid, names, transactions, score: the most suspicious of ``groups`` (gid, names, transactions, alternates: counts;
    confirmed: whether any name is), for having many names, nearly as many names as transactions, others' names."""
    many = F.when(F.col("names") >= 20, 50).when(F.col("names") >= 10, 30).otherwise(0)
    spread = F.when((F.col("transactions") > 0) & (F.col("names") / F.col("transactions") > 0.8), 10).otherwise(0)
    leaning = F.when(F.col("alternates") >= 5, 15).when(F.col("alternates") > 0, 5).otherwise(0)
    score = many + F.when(F.coalesce("confirmed", F.lit(False)), 0).otherwise(15) + spread + leaning
    rows = groups.select("gid", "names", "transactions", score.alias("score")).filter((F.col("score") >= 20) | ((F.col("score") >= 15) & (F.col("names") >= 3)))
    return rows.orderBy(F.desc("score"), "gid").limit(most)


def keyword_progress(rows: DataFrame, key: str, fields: list[str], keywords: list[str], reviewed: DataFrame) -> DataFrame:
    """keyword, matches, reviewed: how many rows have a keyword in one of their fields (arrays of texts), and how many of
    these (keyword, key) are ``reviewed``. Each row names its own keywords, so rows and keywords are never crossed."""
    words = F.array(*[F.lit(k.lower()) for k in keywords])
    said = F.transform(F.concat(*[F.coalesce(F.col(f).cast("array<string>"), F.array().cast("array<string>")) for f in fields]), lambda x: F.lower(x))
    hits = rows.select(F.col(key).alias("key"), F.explode(F.filter(words, lambda w: F.exists(said, lambda x: x.contains(w)))).alias("keyword")).distinct()
    done = reviewed.select(F.lower("keyword").alias("keyword"), F.col(key).alias("key"), F.lit(1).alias("done")).distinct()
    counts = hits.join(done, ["keyword", "key"], "left").groupBy("keyword").agg(F.count("*").alias("matches"), F.count("done").alias("reviewed"))
    every = rows.sparkSession.createDataFrame([(k.lower(),) for k in sorted({k.lower(): k for k in keywords})], "keyword string")
    return every.join(counts, "keyword", "left").select("keyword", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("reviewed", F.lit(0)).alias("reviewed"))


def consolidated(properties: DataFrame, stored: DataFrame, contained: DataFrame) -> DataFrame:
    """id, parcel, source, mates, first: each property (id) with its parcel, by the ``stored`` map (id, parcel) or else
    by the smallest of those that contain it (id, parcel); how many others it shares it with and the first of them.

    Strategies in order: what the first has placed never reaches the second. A parcel's properties are counted, not
    gathered: the first two of them tell everyone's first mate."""
    kept = stored.filter("parcel is not null").groupBy("id").agg(F.min("parcel").alias("parcel"))
    told = properties.select("id").distinct().join(kept, "id").select("id", "parcel", F.lit("stored").alias("source"))
    open_ = properties.select("id").distinct().join(kept, "id", "left_anti")
    filled = open_.join(contained.groupBy("id").agg(F.min("parcel").alias("parcel")), "id").select("id", "parcel", F.lit("contained").alias("source"))
    placed = told.unionByName(filled)
    least = placed.groupBy("parcel").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    second = placed.join(least.select("parcel", "one"), "parcel").filter("id <> one").groupBy("parcel").agg(F.min("id").alias("two"))
    out = placed.join(least.join(second, "parcel", "left"), "parcel")
    return out.select("id", "parcel", "source", (F.col("n") - 1).alias("mates"), F.when(F.col("id") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("first"))
