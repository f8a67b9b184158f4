"""The transaction view that the analytic operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.resolve import written
from tessera.sources.tables import table

#: The same view in SQL.
TX_SQL = """tx AS (
  SELECT o.o_orderkey AS rt_id, strftime(o.o_orderdate, '%Y-%m-%d') AS iso, CAST(o.o_totalprice AS DECIMAL(18,2)) AS price,
         c.c_name AS buyer, n.n_name AS city, r.r_name AS municipality, s.s_name AS seller, p.p_name AS address,
         p.p_brand AS brand, p.p_partkey AS prop_key, o.o_orderstatus AS status, o.o_orderpriority AS priority
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN (SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS l FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o.o_orderkey
  JOIN supplier s ON s.s_suppkey = f.l.s JOIN part p ON p.p_partkey = f.l.p)"""


_TABLES = ("orders", "lineitem", "customer", "nation", "region", "supplier", "part")
_views: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """Size and time of the files that the view is made from."""
    found = []
    for name in _TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += [(name, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)]
    return tuple(sorted(found))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The view, stored once in the shared folder for each state of its tables: the queries on it read the columns
    they need instead of joining seven tables each. A change of any file makes a new one."""
    key = (spark.sparkContext.applicationId, folder, _state(spark, folder))
    if key not in _views:
        _views[key] = written(joined(spark, folder))
    return _views[key]


def joined(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with its first line. The first line is an aggregate of fixed-width
    fields, combined before the shuffle; nation and region are joined to customers first."""
    first = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("l"))
    place = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = table(spark, folder, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")
    tx = table(spark, folder, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    tx = tx.join(table(spark, folder, "supplier"), F.col("l.l_suppkey") == F.col("s_suppkey")).join(table(spark, folder, "part"), F.col("l.l_partkey") == F.col("p_partkey"))
    return tx.select(
        F.col("o_orderkey").alias("rt_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("c_name").alias("buyer"), F.col("n_name").alias("city"), F.col("r_name").alias("municipality"), F.col("s_name").alias("seller"), F.col("p_name").alias("address"),
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("prop_key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )
