"""Sources and sinks other than one Parquet table: folders of JSON documents and of pages, CSV, GeoJSON, audit logs.

All read and write with Spark's own formats, so any store that Spark knows will do. Defined results: missing
folders read as no rows where ``schema`` is given; files whose names begin with an underscore are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def documents(spark: SparkSession, folder: str, schema: StructType | str | None = None, id_col: str = "id") -> DataFrame:
    """One JSON document in each file; the file's name without extension is its id. With ``schema`` only its fields
    are parsed, and a folder that is not there has no rows."""
    if schema is not None and not _exists(spark, folder):
        return spark.createDataFrame([], schema).select(F.lit(None).cast("string").alias(id_col), "*")
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "[!_]*.json")
    rows = (reader.schema(schema) if schema is not None else reader).json(folder)
    return rows.select(_name().alias(id_col), "*")


def pages(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """id, kind, html of all pages below a folder, or of one kind: the kinds are folders ``kind=...``, so that the
    others are not listed."""
    rows = spark.read.option("basePath", folder).option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    rows = rows.select(_name().alias("id"), F.col("kind").cast("string").alias("kind"), F.col("value").alias("html"))
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The elements of JSON arrays, one array in each file, of all files of a folder."""
    return spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").schema(schema).json(folder)


def located(rows: DataFrame, default_brand: str) -> DataFrame:
    """The rows with both coordinates; those without a brand get the default."""
    there = F.coalesce((F.col("lat") != 0) & (F.col("lng") != 0), F.lit(False))
    return rows.filter(there).withColumn("brand", F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.lit(default_brand)))


def aliases(spark: SparkSession, path: str, name: str = "name", others: str = "aliases", sep: str = ";") -> DataFrame:
    """key, name: a CSV of names and their other names, a row for each of them in upper case. The first name by
    alphabet keeps a key that several claim."""
    rows = spark.read.option("header", True).csv(path)
    keys = F.concat(F.array(F.col(name)), F.split(F.coalesce(F.col(others), F.lit("")), sep))
    rows = rows.select(F.col(name).alias("name"), F.explode(F.transform(keys, lambda k: F.upper(F.trim(k)))).alias("key")).filter("key <> ''")
    return rows.groupBy("key").agg(F.min("name").alias("name"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """polygon_id, ring (outer ring as x, y) of the features of GeoJSON collections; each part of a MultiPolygon is a
    row; features without a geometry are left out."""
    schema = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("features")).select("id", "geometry.type", "geometry.coordinates")
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rows = f.select(F.col("id").alias("polygon_id"), F.explode(parts).alias("part")).filter(F.size("part") > 0)
    return rows.select("polygon_id", F.transform(F.col("part")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def features(points: DataFrame, id_col: str = "id") -> DataFrame:
    """value: points (lat, lng and others) as GeoJSON features, one line of text each."""
    rest = [c for c in points.columns if c not in ("lat", "lng")]
    shape = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_col).alias("id"), shape.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_documents(rows: DataFrame, folder: str) -> None:
    """JSON lines. Many small files, one for each record, suit no store that Spark reads; lines are split by tasks."""
    rows.write.mode("overwrite").json(folder)


def append_log(rows: DataFrame, folder: str) -> None:
    """Adds JSON lines to an audit log; what is there is not touched."""
    rows.write.mode("append").json(folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    """CSV with a header; arrays become text joined by a comma and a space."""
    flat = [F.array_join(c.name, ", ").alias(c.name) if c.dataType.typeName() == "array" else F.col(c.name) for c in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(folder)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``old`` with those of ``new`` in place of rows with their keys. Keys of ``new`` are different."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def pending(wanted: DataFrame, done: DataFrame, key: str, failed: str | None = None) -> DataFrame:
    """What is still to be done: keys that are not done, and with ``failed`` those whose last try failed."""
    finished = done if failed is None else done.filter(~F.coalesce(F.col(failed), F.lit(False)))
    return wanted.join(finished.select(key).distinct(), key, "left_anti")
