"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host if more than ``ratio`` of the host's pages hold
it. Counting shuffles 128-bit line hashes, never the lines. What is dropped is
kept as one array of hashes per host. As the hashes of a host cannot number more
than (mean lines per page) / ratio, an array stays short however large the host
is; whether all arrays together are broadcast is decided by their measured size.

Equal texts of a host are one page, so a group of copies does not lose its lines. A line
is boilerplate only if it repeats, that is if ``least`` = 2 pages hold it: of a host with
fewer than 1 / ``ratio`` pages, the ratio alone would drop every line.

Defined results: null text stays null, has no lines and is no page; blank lines are
never counted or dropped; a line is compared without white space at its ends; a null
host is a host like any other; repeated rows get equal results; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import BROADCAST_BYTES, broadcast_if_small, stored, with_column

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.1
#: A line on fewer pages of a host does not repeat, and is never dropped.
LEAST = 2
_BLANK = " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _line_key(line: Column) -> Column:
    line = _bare(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def host_boilerplate(pages: DataFrame, text_col: str, host_col: str, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, hot: for each host with boilerplate, the hashes of those lines."""
    text, host = F.col(text_col), F.col(host_col).alias("host")
    full = F.filter(_lines(text), lambda x: _bare(x) != "")
    held = pages.filter(text.isNotNull()).select(host, F.array_distinct(F.transform(full, _line_key)).alias("lines"), F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    held = held.groupBy("host", "a", "b").agg(F.first("lines").alias("lines"))
    counts = held.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("holding")).filter(F.col("holding") >= least)
    totals = held.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "total_host")
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("total_host"))).filter(F.col("holding") > F.lit(float(ratio)) * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("hot"))


def _marked(pages: DataFrame, text_col: str, host_col: str, ratio: float, least: int, broadcast_bytes: int) -> DataFrame:
    hot = stored(host_boilerplate(pages, text_col, host_col, ratio, least), "boilerplate")
    hot = broadcast_if_small(hot.withColumnRenamed("host", "hot_host"), F.size("hot") * 16 + 64, broadcast_bytes)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(host_col).alias("host"))
    rows = rows.join(hot, F.col("host").eqNullSafe(F.col("hot_host")), "left")
    lines = _lines(F.col("row").getField(text_col))
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(F.col("hot"), _line_key(x)))
    return rows.select("row", F.size(lines).alias("n"), F.when(F.col("hot").isNotNull(), kept).alias("kept"))


def drop_boilerplate(
    pages: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of their text; every row and column stays."""
    rows = _marked(pages, text_col, host_col, ratio, least, broadcast_bytes)
    text = F.coalesce(F.array_join("kept", "\n"), F.col("row").getField(text_col))
    return rows.select(*with_column(rows, text_col, text))


def boilerplate_report(
    pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per row: the id, the text that stays, its lines before, and how many went."""
    rows = _marked(pages, text_col, host_col, ratio, least, broadcast_bytes)
    text = F.col("row").getField(text_col)
    n = F.when(text.isNull(), 0).otherwise(F.col("n")).cast("long")
    removed = F.coalesce(F.col("n") - F.size("kept"), F.lit(0))
    return rows.select(
        F.col("row").getField(id_col).alias(id_col),
        F.coalesce(F.array_join("kept", "\n"), text).alias(text_col),
        n.alias("n_lines"),
        F.when(text.isNull() | F.col("kept").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"),
    )
