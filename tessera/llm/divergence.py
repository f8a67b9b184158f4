"""Source divergence audit: how far the word use of the sources of a language lies apart.

A group is a (lang, source) that occurs; a language keeps the terms that at least
``least_docs`` of its documents hold. With ``count`` the occurrences of a kept term in a
group and N their sum over the V kept terms, p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
and two groups differ in a term by f = floor((p - q)^2 / (p + q)). The sum of f over all
kept terms is not taken term by term. By inclusion and exclusion over the supports of
two groups it is

    V f(0, 0)                                       every term as if neither held it
    + sum over counts c of A:  h_A(c) (f(c, 0) - f(0, 0))    and likewise for B
    + sum over terms of both:  f(a, b) - f(a, 0) - f(0, b) + f(0, 0)

where h_A(c), the number of A's terms with count c, is a histogram that prices terms of one
side alone, and only the last line, a join of posting lists, looks at single terms. f is
symmetric, so each pair of sources is worked out once.

Integers only: p comes from a division of decimals of 38 digits (counts up to 10^28), f and
its sums stay below 2^63, as f <= max(p, q) <= 10^9 + 1 and the p of a group sum to at most
10^9 + V.

Large keys: words are counted within tasks before they travel. Posting lists and the
groups of a language are met in slices of ``SLICE`` rows, so that neither a word that all
sources use nor a language with most of the sources comes together in one task.

Defined results: null text, lang or source count as ''. A text without terms still makes its
group. A language that keeps no term has pairs of value 0 and no terms. Repeated rows are
documents of their own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import BROADCAST_BYTES, broadcast_if_small, release, stored

LEAST_DOCS = 10
TOP = 10
#: Rows of a posting list, or groups of a language, that are met at once.
SLICE = 1024
_SCALE = 1_000_000_000
_BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: Column) -> Column:
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, _BREAKS, -1), "")


def _share(count: Column | int, size: Column) -> Column:
    """p of ``count`` in a group of N + 2 V = ``size``; null where no term is kept."""
    count = F.lit(count) if isinstance(count, int) else count
    part = (F.lit(_SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(28,0)")).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", part, F.nullif(size, F.lit(0)).cast("decimal(38,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """lang, source, term, n, docs: occurrences, and documents that hold it; and the groups."""
    bare = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    words = docs.select(*bare, _terms(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    both = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("d"), F.col("words").alias("ws")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("d"), F.array_distinct("words").alias("ws")))
    rows = words.select("lang", "source", F.inline(both)).select("lang", "source", "n", "d", F.explode("ws").alias("term"))
    counted = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))
    return counted, docs.select(*bare).distinct()


def _kept(counted: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, total (in the language), holders: postings of the terms that a language keeps."""
    terms = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("holders"))
    terms = terms.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "holders")
    return counted.select("lang", "source", "term", "n").join(terms, ["lang", "term"])


def _met(left: DataFrame, right: DataFrame, keys: list[str], of: str, size: str) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, where ``size`` rows of ``right`` share a key: a key is cut
    into slices by a hash of ``of`` (a column of ``right``), and its rows of ``left`` go to every slice."""
    slices = F.ceil(F.col(size) / SLICE).cast("int")
    left = left.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    right = right.withColumn("_slice", F.pmod(F.xxhash64(of), slices).cast("int")).drop(size)
    return left.join(right, [*keys, "_slice"]).drop("_slice")


def divergence_audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, top: int = TOP, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language by their sum of f (part ``pair``,
    all ranks), and the terms a group uses more than its language does (part ``term``, ranks to ``top``)."""
    counted, occurring = _counts(docs, text_col, lang_col, source_col)
    counted = stored(counted, "term-counts")
    kept = stored(_kept(counted, least_docs), "postings")
    release(counted)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = kept.filter(F.col("holders") > 0).groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("all"), F.count("*").alias("v"))
    sources = occurring.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = sources.join(langs, "lang", "left").select("lang", "sources", F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", "sources", "all", "v", F.coalesce("own", F.lit(0)).alias("own"))
    groups = groups.select("lang", "source", "sources", "v", (F.col("own") + 2 * F.col("v")).alias("size"), (F.col("all") + 2 * F.col("v")).alias("lang_size"))
    groups = stored(groups.withColumn("none", _share(0, F.col("size"))), "groups")  # none: p of a term that the group does not hold
    small = broadcast_if_small(groups, F.octet_length("lang") + F.octet_length("source") + 96, broadcast_bytes)
    postings = kept.join(small.select("lang", "source", "size", "lang_size", "none"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("size")))

    other = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), "sources")
    pairs = _met(groups.filter("sources > 1").select("lang", "source", "sources", "v", "none"), other, ["lang"], "other", "sources")
    empty = pairs.filter("source < other").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("v") * _apart(F.col("none"), F.col("other_none")), F.lit(0)).alias("value"))

    prices = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), F.first("p").alias("p"), F.first("none").alias("none"))
    prices = prices.join(langs.select("lang", "sources"), "lang").filter("sources > 1")
    priced = _met(prices, other, ["lang"], "other", "sources").filter("source <> other")
    extra = F.col("terms") * (_apart(F.col("p"), F.col("other_none")) - _apart(F.col("none"), F.col("other_none")))
    one = priced.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), extra.alias("value"))

    here = postings.filter("holders > 1").select("lang", "term", "holders", F.col("source").alias("a"), "p", "none")
    there = here.select("lang", "term", "holders", F.col("a").alias("b"), F.col("p").alias("q"), F.col("none").alias("q_none"))
    shared = _met(here, there, ["lang", "term"], "b", "holders").filter("a < b")
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "none", "q_none"))
    over = shared.select("lang", "a", "b", (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)).alias("value"))

    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (empty, one, over)]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pair = total.select("lang", F.inline(sides), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    usual = _share(F.col("total"), F.col("lang_size"))
    term = postings.filter(F.col("p") > usual).select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), usual).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
