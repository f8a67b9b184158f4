"""Analytic marts over transactions. Ties are always broken by a stated key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.resolve import written

BUCKETS = [("<10k", 0, 10_000), ("10k-50k", 10_000, 50_000), ("50k-100k", 50_000, 100_000), ("100k-200k", 100_000, 200_000), ("200k-400k", 200_000, 400_000), ("400k+", 400_000, 10**15)]


def volume_by(tx: DataFrame, chars: int) -> DataFrame:
    """Count and volume by the first characters of the date (4: year, 7: month)."""
    out = tx.groupBy(F.substring("iso", 1, chars).alias("period")).agg(F.count("*").alias("n"), F.sum("price").alias("volume"))
    return out.select("period", "n", F.col("volume").cast("double").alias("volume"))


def price_buckets(tx: DataFrame) -> DataFrame:
    """Half-open price buckets, zero where empty."""
    label = F.coalesce(*[F.when((F.col("price") >= lo) & (F.col("price") < hi), name) for name, lo, hi in BUCKETS])
    dim = tx.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(BUCKETS)], "ord int, bucket string")
    counts = tx.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    return dim.join(counts, "bucket", "left").select("ord", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def largest_per_month(tx: DataFrame) -> DataFrame:
    """The dearest transaction of each month; the first id wins ties. Combined before the shuffle."""
    best = F.max_by(F.struct("rt_id", "price", "buyer"), F.struct("price", -F.col("rt_id")))
    return tx.groupBy(F.substring("iso", 1, 7).alias("month")).agg(best.alias("b")).select("month", "b.rt_id", F.col("b.price").cast("double").alias("price"), "b.buyer")


def brand_windows(tx: DataFrame, as_of: str) -> DataFrame:
    """Transactions of each brand in 1, 6 and 12 months before a date, and in all, in one pass."""
    since = lambda m: F.count_if(F.col("iso") >= F.date_format(F.add_months(F.lit(as_of).cast("date"), -m), "yyyy-MM-dd"))
    return tx.groupBy("brand").agg(since(1).alias("m1"), since(6).alias("m6"), since(12).alias("m12"), F.count("*").alias("n"))


def latest_per_property(tx: DataFrame) -> DataFrame:
    """The newest transaction of a property (first id on ties), and its span of years."""
    last = F.max_by(F.struct("rt_id", "price", "iso", "buyer"), F.struct("iso", -F.col("rt_id")))
    out = tx.groupBy("prop_key").agg(last.alias("l"), F.min(F.substring("iso", 1, 4)).alias("first_year"), F.max(F.substring("iso", 1, 4)).alias("last_year"), F.count("*").alias("n"))
    return out.select("prop_key", "l.rt_id", F.col("l.price").cast("double").alias("price"), "l.iso", F.col("l.buyer").alias("owner"), "first_year", "last_year", "n")


def latest_fact(tx: DataFrame) -> DataFrame:
    """The newest brand seen at an address; the last id wins ties."""
    return tx.groupBy("address").agg(F.max_by("brand", F.struct("iso", "rt_id")).alias("brand"))


def appearances(tx: DataFrame) -> DataFrame:
    """Every transaction once for its buyer and once for its seller."""
    roles = F.array(F.struct(F.lit("buyer").alias("role"), F.col("buyer").alias("name")), F.struct(F.lit("seller").alias("role"), F.col("seller").alias("name")))
    return tx.select("*", F.inline(roles))


def current_owns(tx: DataFrame) -> DataFrame:
    """Properties a party holds: its newest role there is buyer."""
    last = appearances(tx).groupBy("name", "prop_key").agg(F.max_by("role", F.struct("iso", "rt_id", "role")).alias("role"))
    return last.groupBy("name").agg(F.count_if(F.col("role") == "buyer").alias("owns"))


def party_rollup(tx: DataFrame) -> DataFrame:
    a = appearances(tx)
    out = a.groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(F.col("role") == "buyer").alias("bought"), F.count_if(F.col("role") == "seller").alias("sold"),
        F.min("iso").alias("first"), F.max("iso").alias("last"), F.count_distinct("rt_id").alias("transactions"), F.array_sort(F.collect_set("city")).alias("cities"),
    )
    return out.withColumn("cities", F.array_join("cities", ","))


def recent(tx: DataFrame, n: int = 15) -> DataFrame:
    return tx.select("rt_id", "iso", F.col("price").cast("double").alias("price"), "city").orderBy(F.desc("iso"), "rt_id").limit(n)


def top(tx: DataFrame, column: str, n: int) -> DataFrame:
    """Most common values; ties go to the one seen first."""
    return tx.groupBy(column).agg(F.count("*").alias("n"), F.min("rt_id").alias("first")).orderBy(F.desc("n"), "first").limit(n)


def recently_sold_brands(tx: DataFrame, n: int = 5) -> DataFrame:
    last = tx.groupBy("brand").agg(F.max(F.struct("iso", -F.col("rt_id"))).alias("l"))
    return last.orderBy(F.desc("l")).limit(n).select("brand", F.col("l.iso").alias("iso"))


def stale(tx: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    last = tx.groupBy("prop_key").agg(F.max("iso").alias("last"))
    return last.withColumn("days", F.datediff(F.lit(as_of).cast("date"), F.col("last").cast("date")).cast("long")).orderBy(F.desc("days"), "prop_key").limit(n)


def repeat_traders(tx: DataFrame, n: int = 10) -> DataFrame:
    return appearances(tx).groupBy("name").agg(F.count_distinct("prop_key").alias("properties"), F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def pipeline_by_status(tx: DataFrame) -> DataFrame:
    return tx.groupBy("status").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("value"))


def best_stage(tx: DataFrame) -> DataFrame:
    """Of a property's deals the active one (status other than F) of the best priority."""
    order = F.struct((F.col("status") == "F").alias("closed"), "priority", "rt_id")
    return tx.groupBy("prop_key").agg(F.min_by("priority", order).alias("stage"), F.min(order).getField("closed").alias("closed"))


def filtered(tx: DataFrame, cities: list[str], lo: float, hi: float, since: str, until: str) -> DataFrame:
    keep = F.col("city").isin(cities) & F.col("price").between(lo, hi) & (F.col("iso") != "") & F.col("iso").between(since, until)
    return tx.filter(keep).select("rt_id", "iso", F.col("price").cast("double").alias("price"), "city")


def fanout(tx: DataFrame) -> DataFrame:
    """How many addresses are shared by how many different buyers."""
    per = tx.groupBy("address").agg(F.count_distinct("buyer").alias("names"))
    b = F.when(F.col("names") == 1, "1").when(F.col("names") < 5, "2-4").when(F.col("names") < 10, "5-9").when(F.col("names") < 20, "10-19").when(F.col("names") < 50, "20-49").otherwise("50+")
    return per.groupBy(b.alias("fanout")).agg(F.count("*").alias("addresses"))


def stable_ids(tx: DataFrame) -> DataFrame:
    """New ids for cities in the order in which they first appear. The window runs over one
    row per city, after the aggregation."""
    first = tx.groupBy("city").agg(F.min("rt_id").alias("first"))
    return first.withColumn("gid", F.format_string("G%05d", F.row_number().over(Window.orderBy("first")))).select("city", "gid")


def _modal(tx: DataFrame, key: str, value: str) -> DataFrame:
    """The most common value of each key and how often it occurs; ties go to the one seen first."""
    n = tx.groupBy(key, value).agg(F.count("*").alias("k"), F.min("rt_id").alias("seen"))
    return n.groupBy(key).agg(F.max_by(F.struct(value, "k"), F.struct("k", -F.col("seen"))).alias("m")).select(key, f"m.{value}", "m.k")


def contact_rollup(tx: DataFrame) -> DataFrame:
    """Each buyer's usual city and the seller it deals with most."""
    cities = _modal(tx, "buyer", "city").select("buyer", "city")
    return _modal(tx, "buyer", "seller").join(cities, "buyer").select("buyer", "city", F.col("seller").alias("modal_seller"), F.col("k").alias("deals"))


def shared_signals(tx: DataFrame, wide: int = 50) -> DataFrame:
    """kind, a, b, score: what buyers share, properties (3 each) and a seller's brand (1 each), without a cap.

    Signals of fewer than ``wide`` holders give their pairs (kind ``pair``: buyers a < b and the sum of their weights).
    A signal of more holders stands once for each of them instead (kind ``member``: the buyer, the signal, its weight),
    so rows never grow with the square of its holders. The score of two buyers is that of their pair and the weights of
    the wide signals that both are members of."""
    kinds = F.array(F.struct(F.concat(F.lit("property "), F.col("prop_key").cast("string")).alias("signal"), F.lit(3).alias("w")), F.struct(F.concat_ws("|", F.lit("brand"), "seller", "brand").alias("signal"), F.lit(1).alias("w")))
    held = written(tx.select("buyer", F.inline(kinds)).distinct())
    holders = held.groupBy("signal").agg(F.count("*").alias("holders")).filter("holders > 1")
    held = held.join(holders, "signal")
    few = held.filter(F.col("holders") < wide).select("signal", "buyer", "w")
    met = few.select("signal", F.col("buyer").alias("a"), "w").join(few.select("signal", F.col("buyer").alias("b")), "signal").filter("a < b")
    pairs = met.groupBy("a", "b").agg(F.sum("w").cast("long").alias("score")).select(F.lit("pair").alias("kind"), "a", "b", "score")
    return pairs.unionByName(held.filter(F.col("holders") >= wide).select(F.lit("member").alias("kind"), F.col("buyer").alias("a"), F.col("signal").alias("b"), F.col("w").cast("long").alias("score")))


def signal_suggestions(tx: DataFrame, targets: DataFrame) -> DataFrame:
    """buyer, other, score: for each buyer in ``targets`` every other buyer that shares a property (3 each)
    or a seller's brand (1 each), however many hold it and however low the score. Each target meets a holder
    once for each signal, so the rows grow with the table for a given set of targets."""
    kinds = F.array(F.struct(F.col("prop_key").cast("string").alias("signal"), F.lit(3).alias("w")), F.struct(F.concat_ws("|", "seller", "brand").alias("signal"), F.lit(1).alias("w")))
    held = tx.select("buyer", F.inline(kinds)).distinct()
    asked = held.join(targets.select("buyer").distinct(), "buyer")
    met = asked.join(held.withColumnRenamed("buyer", "other"), ["signal", "w"]).filter("buyer <> other")
    return met.groupBy("buyer", "other").agg(F.sum("w").cast("long").alias("score"))


def address_collection(tx: DataFrame) -> DataFrame:
    """Every place named anywhere, with its best priority and all kinds of source, in one pass over the rows."""
    said = [("address", 1, "property"), ("city", 2, "buyer"), ("municipality", 3, "region"), ("city", 3, "region")]
    rows = tx.select(F.inline(F.array(*[F.struct(F.col(c).alias("place"), F.lit(p).alias("priority"), F.lit(s).alias("source")) for c, p, s in said])))
    out = rows.groupBy("place").agg(F.min("priority").alias("priority"), F.collect_set("source").alias("sources"), F.count("*").alias("n"))
    return out.withColumn("sources", F.array_join(F.array_sort("sources"), ","))


def ranked_search(rows: DataFrame, key: str, text: str, term: str, n: int = 50) -> DataFrame:
    """The best ``n`` rows holding ``term``: equal, then beginning with it, then holding it."""
    low = F.lower(text)
    score = F.when(low == term, 100).when(low.startswith(term), 50).when(low.contains(term), 10)
    return rows.select(key, text, score.alias("score")).filter("score is not null").orderBy(F.desc("score"), key).limit(n)
