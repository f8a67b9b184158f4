"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every window of an item (``window`` consecutive words, or the whole of a shorter
item) must occur in a document word for word. The words of a window are ordered
by how rare they are in the documents; for exact containment the necessary prefix
is the rarest one, so only documents holding that word meet the window. Each
meeting fixes where the window would have to start: bounds on position and length
leave out what cannot fit, and the words in that place decide.

Words: A-Z are lower-cased, then runs of characters outside
``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. The word list of a document is only read in
the stage that cuts it; no row that leaves the stage carries it.

Defined results: null or wordless texts have no words and no hits; wordless items
have no windows; repeated rows get equal results; items with equal texts all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import BROADCAST_BYTES, fits, stored

WINDOW = 10
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_words(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``words``: the words of ``text``."""
    text = F.coalesce(text, F.lit(""))
    # of ASCII alone, lower case is the same and several times as fast as a table
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return df.withColumn("words", F.array_remove(F.split(folded, _BREAKS, -1), ""))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """win (its words), items: every different window, with the ids that hold it."""
    rows = with_words(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), F.col("text"))
    rows = rows.filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    wins = rows.select("item", length.alias("len"), F.explode(starts).alias("at"), "words").select("item", F.expr("slice(words, at, len)").alias("win"))
    return wins.distinct()


def prefix_windows(wins: DataFrame, docs: DataFrame, text_col: str, broadcast_bytes: int) -> DataFrame:
    """token, off, len, win_id, win: each different window under its rarest word."""
    wins = wins.select("win").distinct().withColumn("win_id", F.sha2(F.concat_ws(" ", "win"), 256))
    tokens = wins.select("win_id", F.posexplode("win").alias("off", "token"))
    vocabulary = stored(tokens.select("token").distinct(), "vocabulary")
    spread = with_words(docs.select(F.col(text_col).alias("text")), F.col("text")).select(F.explode_outer("words").alias("token"))
    if fits(vocabulary, F.length("token") * 4 + 32, broadcast_bytes):
        spread = spread.join(F.broadcast(vocabulary), "token", "left_semi")
    counts = stored(spread.groupBy("token").agg(F.count("*").alias("n")), "counts")
    if fits(counts, F.length("token") * 4 + 64, broadcast_bytes):  # a word of very many windows stays where it is
        counts = F.broadcast(counts)
    ranked = tokens.join(counts, "token")  # a word that no document has leaves no candidates
    least = ranked.groupBy("win_id").agg(F.min(F.struct("n", "token", "off")).alias("rare"), F.count("*").alias("known"))
    least = least.join(wins, "win_id").filter(F.col("known") == F.size("win"))
    return least.select(F.col("rare.token").alias("token"), F.col("rare.off").alias("off"), F.size("win").alias("len"), "win_id", "win")


def occurrences(docs: DataFrame, prefixes: DataFrame, id_col: str, text_col: str, window: int, broadcast_bytes: int) -> DataFrame:
    """id, key, at, len, win_id: where windows occur in documents (at counts words from 0)."""
    rows = with_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text")).select("id", F.xxhash64("text").alias("key"), "words")
    rows = rows.select("id", "key", "words", F.posexplode_outer("words").alias("pos", "token"))
    if fits(prefixes, F.lit(96) + 24 * F.col("len") + 4 * F.length(F.concat_ws(" ", "win")), broadcast_bytes):
        rows = rows.select("id", "key", "words", "pos", "token", F.lit(0).alias("base"), F.size("words").alias("n"))
        prefixes = F.broadcast(prefixes)
    else:  # both sides are shuffled by the word: send what lies around it, not the document
        base = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        rows = rows.select("id", "key", F.slice("words", base + 1, 2 * window - 1).alias("words"), "pos", "token", base.alias("base"), F.size("words").alias("n"))
    at = F.col("pos") - F.col("off")
    met = rows.join(prefixes, "token").filter((at >= 0) & (at + F.col("len") <= F.col("n")))
    # no lambda here: the comparison stays in the generated code of the join
    met = met.filter(F.slice("words", F.greatest(at - F.col("base") + 1, F.lit(1)), F.col("len")) == F.col("win"))
    return met.select("id", "key", at.alias("at"), "len", "win_id")


def decontamination_report(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    wins = stored(item_windows(items, item_col, item_text_col, window), "windows")
    prefixes = stored(prefix_windows(wins, docs, text_col, broadcast_bytes), "prefixes")
    found = stored(occurrences(docs, prefixes, id_col, text_col, window, broadcast_bytes), "occurrences")
    spans = found.select("id", "key", "at", "len").distinct()
    reach = F.max(F.col("at") + F.col("len")).over(Window.partitionBy("id", "key").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("at") + F.col("len") - F.greatest(F.col("at"), F.coalesce(reach, F.lit(0))), F.lit(0))
    hits = spans.select("id", "key", fresh.alias("fresh")).groupBy("id", "key").agg(F.sum("fresh").alias("n_hit"))
    named = wins.select("item", F.sha2(F.concat_ws(" ", "win"), 256).alias("win_id"))
    of = found.select("id", "key", "win_id").distinct().join(named, "win_id").select("id", "key", "item").distinct()
    of = of.groupBy("id", "key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    both = hits.join(of, hits["id"].eqNullSafe(of["id"]) & (hits["key"] == of["key"])).select(hits["id"].alias("hit_id"), hits["key"].alias("hit_key"), "n_hit", "n_items", "items_sha256")
    rows = with_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text")).select("id", F.xxhash64("text").alias("key"), F.size("words").cast("long").alias("n_words"))
    out = rows.join(both, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, all columns kept."""
    wins = stored(item_windows(items, item_col, item_text_col, window), "windows")
    prefixes = stored(prefix_windows(wins, docs, text_col, broadcast_bytes), "prefixes")
    found = occurrences(docs, prefixes, id_col, text_col, window, broadcast_bytes)
    bad = stored(found.select(F.col("id").alias("bad_id"), F.col("key").alias("bad_key")).distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    doc, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    if fits(bad, 48, broadcast_bytes):
        bad = F.broadcast(bad)
    kept = rows.join(bad, doc.eqNullSafe(F.col("bad_id")) & (F.xxhash64(text) == F.col("bad_key")), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
