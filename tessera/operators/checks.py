"""Quality checks of pages and of records, and differences of nested documents.

Each check names the rows that fail it. Defined results: a null page or record fails every check for
something missing, and none for a wrong type.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of a page's sections.
ADDRESS = r"(?is)<strong[^>]*\bid\s*=\s*[\"']?address[\"']?[^>]*>(.*?)</strong>"
AFTER = r"(?is)<strong[^>]*\bid\s*=\s*[\"']?address[\"']?[^>]*>.*?</strong>(.*?)(?:<p[\s/>]|$)"
GRAY = r"(?is)<font[^>]*\bcolor\s*=\s*[\"']?#848484[\"']?[^>]*>(.*?)</font>"
DATE = r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}"


def _plain(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def without_comments(html: Column) -> Column:
    """A page without its comments; one that is not closed reaches to the end."""
    rest = lambda x: F.when(x.contains("-->"), F.substr(x, F.instr(x, "-->") + 3)).otherwise("")
    return F.array_join(F.transform(F.split(html, "<!--"), lambda x, i: F.when(i == 0, x).otherwise(rest(x))), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def html_flags(html: Column) -> Column:
    """The ids, H001 to H014, of the checks that a page fails."""
    return _let(without_comments(F.coalesce(html, F.lit(""))), lambda page: _let(_pieces(page), _page_flags))


def _pieces(page: Column) -> Column:
    """Whether a page has an address, what it is, what stands behind it, and the grey captions."""
    first = F.trim(_plain(F.regexp_replace(F.regexp_extract(page, ADDRESS, 1), r"(?i)<br[^>]*>", "\n")))
    header = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(page, AFTER, 1), r"<[^>]*>", " ")), r"\s+", " ")
    gray = F.transform(F.regexp_extract_all(page, F.lit(GRAY), F.lit(1)), lambda x: F.trim(_plain(x)))
    return F.struct(page.rlike(ADDRESS).alias("tagged"), F.regexp_replace(first, r"^\s+", "").alias("lead"), header.alias("header"), gray.alias("gray"))


def _page_flags(piece: Column) -> Column:
    tagged, lead, header, gray = (piece[c] for c in ("tagged", "lead", "header", "gray"))
    holds = lambda word: F.exists(gray, lambda x: x.contains(word))
    last = F.when(F.size(gray) > 0, F.element_at(gray, -1)).otherwise("")
    checks = {
        "H001": ~tagged, "H002": tagged & (lead == ""), "H003": tagged & (lead != "") & ~lead.rlike(r"^\d"),
        "H004": ~holds("Transferor"), "H005": ~holds("Transferee"),
        "H006": tagged & ~header.contains(" : "), "H007": tagged & ~header.rlike(r"\$[\d,]+"), "H008": tagged & ~header.rlike(DATE),
        "H009": ~last.rlike(r"RT\d+"), "H010": ~F.exists(gray, lambda x: x == "Site"), "H011": ~holds("Assessment Roll Number"),
        "H012": ~F.exists(gray, lambda x: x == "Description"), "H013": ~holds("Broker"), "H014": ~F.exists(gray, lambda x: F.lower(x).contains("photos")),
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def record_flags(record: Column) -> Column:
    """The ids, P001 to P010, of the checks that a record (JSON text) fails."""
    at = lambda path: F.get_json_object(record, f"$.{path}")
    missing = lambda path: F.trim(F.coalesce(at(path), F.lit(""))) == ""
    nested = lambda path: F.coalesce(at(path).startswith("{"), F.lit(False))
    checks = {
        "P001": missing("transaction.address.address"), "P002": missing("transaction.sale_price"), "P003": missing("transaction.sale_date"), "P004": missing("transferor.name"), "P005": missing("transferee.name"),
        "P006": missing("transaction.address.city"), "P007": nested("transferor.phone"), "P008": nested("transferee.phone"), "P009": nested("transferor.address"), "P010": nested("transferee.address"),
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def flag_counts(rows: DataFrame, flags: Column) -> DataFrame:
    """flag, n: how many rows fail each check, and under "clean" how many fail none."""
    named = rows.select(_let(flags, lambda f: F.when(F.size(f) == 0, F.array(F.lit("clean"))).otherwise(f)).alias("flags"))
    return named.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def _leaves(value, path: str, out: dict) -> dict:
    if isinstance(value, dict):
        for k, v in value.items():
            _leaves(v, f"{path}.{k}" if path else k, out)
    else:
        out[path] = json.dumps(value, sort_keys=True, ensure_ascii=False)
    return out


def flattened(record: Column, volatile: list[str] = ()) -> Column:
    """JSON text as a map from dotted keys to leaves (arrays are leaves); outermost keys in ``volatile`` are left out."""
    skip = set(volatile)

    @F.pandas_udf("map<string,string>")
    def leaves(records: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _leaves({k: v for k, v in json.loads(r).items() if k not in skip}, "", {}) for r in records])

    return leaves(record)


def nested_diff(active: DataFrame, sandbox: DataFrame, key: str, record: str, volatile: list[str] = ()) -> DataFrame:
    """key, status, field, before, after: a row for each leaf that changed, and one for each document that came, went
    or stayed. Documents that are equal as text are not parsed."""
    pack = lambda df, name: df.select(key, F.col(record).alias(name))
    both = pack(active, "old").join(pack(sandbox, "new"), key, "full_outer")
    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    lone = both.filter(~there | F.col("old").eqNullSafe(F.col("new"))).select(
        key, F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").otherwise("unchanged").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("field", "before", "after")]
    )
    rows = both.filter(there & (F.col("old") != F.col("new"))).select(key, flattened(F.col("old"), volatile).alias("o"), flattened(F.col("new"), volatile).alias("n"))
    fields = F.array_sort(F.array_union(F.map_keys("o"), F.map_keys("n")))
    changed = F.filter(fields, lambda f: ~F.element_at("o", f).eqNullSafe(F.element_at("n", f)))
    rows = rows.select(key, "o", "n", F.explode_outer(changed).alias("field"))
    rows = rows.select(key, F.when(F.col("field").isNull(), "unchanged").otherwise("changed").alias("status"), "field", F.element_at("o", F.col("field")).alias("before"), F.element_at("n", F.col("field")).alias("after"))
    return lone.unionByName(rows)
