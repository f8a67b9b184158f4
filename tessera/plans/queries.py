"""The engine's operators as queries on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import addresses as A
from tessera.functions import text as T
from tessera.operators import marts as M
from tessera.operators import resolve as R
from tessera.plans import details, forms, points, rendered, views
from tessera.plans.transactions import TX_SQL, transactions
from tessera.sources.tables import table
from tessera.streaming import events as E

AS_OF = "2001-08-02"
#: Thirty days before that.
RECENT = "2001-07-03"
#: Holders from which on a signal is given by its members, not by their pairs.
WIDE = 50
RING = [(-79.51, 43.59), (-79.49, 43.59), (-79.49, 43.61), (-79.50, 43.60), (-79.51, 43.61)]


def _points(s, d) -> DataFrame:
    e = F.col("embedding")
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (43.60 + e[0].cast("double") * 0.05).alias("lat"), (-79.50 + e[1].cast("double") * 0.05).alias("lng"), F.col("label").alias("label"))


_PTS = "pts AS (SELECT vec_id AS id, 43.60::DOUBLE + embedding[1]::DOUBLE * 0.05::DOUBLE AS lat, -79.50::DOUBLE + embedding[2]::DOUBLE * 0.05::DOUBLE AS lng FROM embeddings)"


def _cc(s, d) -> DataFrame:
    rows = transactions(s, d).select("rt_id", "seller", "prop_key")
    by_pair = rows.withColumn("deal", F.concat_ws("|", "seller", "prop_key"))
    return R.components(R.star_edges(by_pair, "deal", "rt_id").union(R.star_edges(rows, "prop_key", "rt_id", 5)).distinct())


def _cc_names(s, d) -> DataFrame:
    """As ``_cc``, with the cap on the different names of a property, not on its transactions."""
    rows = transactions(s, d).select("rt_id", "seller", "prop_key", T.normalize_name(F.col("seller")).alias("name"))
    by_pair = rows.withColumn("deal", F.concat_ws("|", "seller", "prop_key"))
    return R.components(R.star_edges(by_pair, "deal", "rt_id").union(R.star_edges(rows, "prop_key", "rt_id", 5, "name")).distinct())


def _suggestions(s, d) -> DataFrame:
    """All that share a signal with a buyer who has dealt in the last thirty days."""
    tx = transactions(s, d)
    return M.signal_suggestions(tx, tx.filter(F.col("iso").between(RECENT, AS_OF)).select("buyer"))


def _customer_state(s, d, as_of: str) -> DataFrame:
    """Each customer's newest order, and how many orders there were, as seen on a day."""
    seen = table(s, d, "orders").filter(F.col("o_orderdate") < F.lit(as_of).cast("timestamp_ntz"))
    last = F.max_by(F.struct("o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
    return seen.groupBy("o_custkey").agg(last.alias("l"), F.count("*").alias("n_orders")).select("o_custkey", "l.o_orderstatus", "l.o_orderpriority", "n_orders")


def _state_sql(as_of: str) -> str:
    return f"SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority, count(*) AS n_orders FROM orders WHERE o_orderdate < TIMESTAMP '{as_of}' GROUP BY 1"


def _numbered(s, d, name: str, key: str) -> DataFrame:
    """Names with the nation in which they are compared."""
    col = lambda c: F.col(f"{name[0]}_{c}")
    return table(s, d, name).select(col(key).alias("id"), col("name").alias("text"), col("nationkey").cast("string").alias("block"))


_IN = " + ".join(
    f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lng < ({x2}::DOUBLE - {x1}::DOUBLE) * (lat - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END"
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True)
    if y1 != y2
)
_ROLES = "a AS (SELECT *, 'buyer' AS role, buyer AS name FROM tx UNION ALL SELECT *, 'seller' AS role, seller AS name FROM tx)"
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - p.lng) / 2), 2)))"

#: name: (query, SQL or None)
ALL = {
    "volume_by_year": (lambda s, d: M.volume_by(transactions(s, d), 4), f"WITH {TX_SQL} SELECT substr(iso, 1, 4) AS period, count(*) AS n, CAST(sum(price) AS DOUBLE) AS volume FROM tx GROUP BY 1"),
    "volume_by_month": (lambda s, d: M.volume_by(transactions(s, d), 7), f"WITH {TX_SQL} SELECT substr(iso, 1, 7) AS period, count(*) AS n, CAST(sum(price) AS DOUBLE) AS volume FROM tx GROUP BY 1"),
    "price_buckets": (
        lambda s, d: M.price_buckets(transactions(s, d)),
        f"WITH {TX_SQL} SELECT CAST(b.ord AS INTEGER) AS ord, b.bucket, count(tx.rt_id) AS n FROM (VALUES " + ", ".join(f"({i}, '{n}', {lo}, {hi})" for i, (n, lo, hi) in enumerate(M.BUCKETS)) + ") b(ord, bucket, lo, hi) LEFT JOIN tx ON tx.price >= b.lo AND tx.price < b.hi GROUP BY ALL",
    ),
    "largest_per_month": (
        lambda s, d: M.largest_per_month(transactions(s, d)),
        f"WITH {TX_SQL} SELECT substr(iso, 1, 7) AS month, rt_id, CAST(price AS DOUBLE) AS price, buyer FROM tx QUALIFY row_number() OVER (PARTITION BY substr(iso, 1, 7) ORDER BY price DESC, rt_id) = 1",
    ),
    "brand_windows": (
        lambda s, d: M.brand_windows(transactions(s, d), AS_OF),
        f"WITH {TX_SQL} SELECT brand, count(*) FILTER (iso >= '2001-07-02') AS m1, count(*) FILTER (iso >= '2001-02-02') AS m6, count(*) FILTER (iso >= '2000-08-02') AS m12, count(*) AS n FROM tx GROUP BY 1",
    ),
    "latest_tx_per_property": (
        lambda s, d: M.latest_per_property(transactions(s, d)),
        f"""WITH {TX_SQL} SELECT prop_key, rt_id, CAST(price AS DOUBLE) AS price, iso, buyer AS owner, min(substr(iso, 1, 4)) OVER p AS first_year, max(substr(iso, 1, 4)) OVER p AS last_year, count(*) OVER p AS n
        FROM tx WINDOW p AS (PARTITION BY prop_key) QUALIFY row_number() OVER (PARTITION BY prop_key ORDER BY iso DESC, rt_id) = 1""",
    ),
    "latest_fact_last_wins": (lambda s, d: M.latest_fact(transactions(s, d)), f"WITH {TX_SQL} SELECT address, brand FROM tx QUALIFY row_number() OVER (PARTITION BY address ORDER BY iso DESC, rt_id DESC) = 1"),
    "current_owns_count": (
        lambda s, d: M.current_owns(transactions(s, d)),
        f"WITH {TX_SQL}, {_ROLES}, l AS (SELECT name, prop_key, role FROM a QUALIFY row_number() OVER (PARTITION BY name, prop_key ORDER BY iso DESC, rt_id DESC, role DESC) = 1) SELECT name, count(*) FILTER (role = 'buyer') AS owns FROM l GROUP BY 1",
    ),
    "party_rollup": (
        lambda s, d: M.party_rollup(transactions(s, d)),
        f"WITH {TX_SQL}, {_ROLES} SELECT name, count(*) AS n, count(*) FILTER (role = 'buyer') AS bought, count(*) FILTER (role = 'seller') AS sold, min(iso) AS first, max(iso) AS last, count(DISTINCT rt_id) AS transactions, string_agg(DISTINCT city, ',' ORDER BY city) AS cities FROM a GROUP BY 1",
    ),
    "recent_15": (lambda s, d: M.recent(transactions(s, d)), f"WITH {TX_SQL} SELECT rt_id, iso, CAST(price AS DOUBLE) AS price, city FROM tx ORDER BY iso DESC, rt_id LIMIT 15"),
    "top_cities": (lambda s, d: M.top(transactions(s, d), "city", 15), f"WITH {TX_SQL} SELECT city, count(*) AS n, min(rt_id) AS first FROM tx GROUP BY 1 ORDER BY n DESC, first LIMIT 15"),
    "top_brands": (lambda s, d: M.top(transactions(s, d), "brand", 8), f"WITH {TX_SQL} SELECT brand, count(*) AS n, min(rt_id) AS first FROM tx GROUP BY 1 ORDER BY n DESC, first LIMIT 8"),
    "recently_sold_brands": (
        lambda s, d: M.recently_sold_brands(transactions(s, d)),
        f"WITH {TX_SQL}, f AS (SELECT brand, iso, rt_id FROM tx QUALIFY row_number() OVER (PARTITION BY brand ORDER BY iso DESC, rt_id) = 1) SELECT brand, iso FROM f ORDER BY iso DESC, rt_id LIMIT 5",
    ),
    "stale_top10": (
        lambda s, d: M.stale(transactions(s, d), AS_OF),
        f"WITH {TX_SQL} SELECT prop_key, max(iso) AS last, date_diff('day', CAST(max(iso) AS DATE), DATE '{AS_OF}') AS days FROM tx GROUP BY 1 ORDER BY days DESC, prop_key LIMIT 10",
    ),
    "repeat_traders": (lambda s, d: M.repeat_traders(transactions(s, d)), f"WITH {TX_SQL}, {_ROLES} SELECT name, count(DISTINCT prop_key) AS properties, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, name LIMIT 10"),
    "pipeline_by_status": (lambda s, d: M.pipeline_by_status(transactions(s, d)), f"WITH {TX_SQL} SELECT status, count(*) AS n, CAST(sum(price) AS DOUBLE) AS value FROM tx GROUP BY 1"),
    "best_stage": (lambda s, d: M.best_stage(transactions(s, d)), f"WITH {TX_SQL} SELECT prop_key, priority AS stage, status = 'F' AS closed FROM tx QUALIFY row_number() OVER (PARTITION BY prop_key ORDER BY status = 'F', priority, rt_id) = 1"),
    "outreach_filter": (
        lambda s, d: M.filtered(transactions(s, d), ["CANADA", "FRANCE", "NATION_3", "NATION_7"], 50_000, 300_000, "1996-01-01", "1999-12-31"),
        f"WITH {TX_SQL} SELECT rt_id, iso, CAST(price AS DOUBLE) AS price, city FROM tx WHERE city IN ('CANADA', 'FRANCE', 'NATION_3', 'NATION_7') AND price BETWEEN 50000 AND 300000 AND iso BETWEEN '1996-01-01' AND '1999-12-31'",
    ),
    "fanout_histogram": (
        lambda s, d: M.fanout(transactions(s, d)),
        f"WITH {TX_SQL}, f AS (SELECT address, count(DISTINCT buyer) AS k FROM tx GROUP BY 1) SELECT CASE WHEN k = 1 THEN '1' WHEN k < 5 THEN '2-4' WHEN k < 10 THEN '5-9' WHEN k < 20 THEN '10-19' WHEN k < 50 THEN '20-49' ELSE '50+' END AS fanout, count(*) AS addresses FROM f GROUP BY 1",
    ),
    "stable_ids": (lambda s, d: M.stable_ids(transactions(s, d)), f"WITH {TX_SQL}, f AS (SELECT city, min(rt_id) AS first FROM tx GROUP BY 1) SELECT city, printf('G%05d', row_number() OVER (ORDER BY first)) AS gid FROM f"),
    "exclude_contacted": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "events").filter("event_type = 'purchase'"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey", "c_name"),
        "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase' AND user_id = c_custkey)",
    ),
    "normalize_names": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", T.normalize_name(F.concat(F.lit("  "), "s_name", F.lit("  Inc. , "))).alias("name"), T.is_company(F.col("s_name")).alias("company")),
        rf"SELECT s_suppkey, regexp_replace(trim(regexp_replace(upper('  ' || s_name || '  Inc. , '), '\s+', ' ', 'g')), '[.,;:]+$', '') AS name, regexp_matches(s_name, '[0-9]') AS company FROM supplier",
    ),
    "dedup_keys": (
        lambda s, d: table(s, d, "part").groupBy(A.dedup_key(F.col("p_name"), F.col("p_brand")).alias("key")).agg(F.min("p_partkey").alias("pid"), F.count("*").alias("n")),
        "SELECT upper(p_name) || '|' || upper(p_brand) AS key, min(p_partkey) AS pid, count(*) AS n FROM part GROUP BY 1",
    ),
    "extract_phones": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.phones_in(F.col("text"))).alias("phone")).select("doc_id", "phone", T.normalize_phone(F.col("phone")).alias("digits")),
        r"SELECT doc_id, phone, regexp_replace(phone, '\D', '', 'g') AS digits FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\(\d{3}\) \d{3}-\d{4}'))) AS phone FROM documents)",
    ),
    "page_links": (
        lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long").alias("links")),
        r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""",
    ),
    "json_props": (lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "quality_flags": (
        lambda s, d: table(s, d, "documents").select(F.explode(F.filter(F.array(F.when(F.length("text") < 100, "short"), F.when(F.col("text").rlike("@"), "email"), F.when(F.length("text") > 10_000, "long")), lambda x: x.isNotNull())).alias("flag")).groupBy("flag").agg(F.count("*").alias("n")),
        "SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN contains(text, '@') THEN 'email' END, CASE WHEN length(text) > 10000 THEN 'long' END]) AS flag FROM documents) WHERE flag IS NOT NULL GROUP BY 1",
    ),
    "snapshot_diff": (
        lambda s, d: R.snapshot_diff(_customer_state(s, d, "1995-02-01"), _customer_state(s, d, "1995-05-01"), "o_custkey").groupBy("status", "field").agg(F.count("*").alias("n")),
        f"""WITH o AS ({_state_sql("1995-02-01")}), n AS ({_state_sql("1995-05-01")}),
        b AS (SELECT o.o_custkey AS was, n.o_custkey AS now, list_filter([CASE WHEN o.o_orderstatus <> n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_orderpriority <> n.o_orderpriority THEN 'o_orderpriority' END,
              CASE WHEN o.n_orders <> n.n_orders THEN 'n_orders' END], lambda x : x IS NOT NULL) AS fields FROM o FULL JOIN n ON o.o_custkey = n.o_custkey),
        r AS (SELECT CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN len(fields) > 0 THEN 'changed' ELSE 'unchanged' END AS status, fields FROM b)
        SELECT status, field, count(*) AS n FROM (SELECT status, unnest(CASE WHEN status = 'changed' THEN fields ELSE [NULL] END) AS field FROM r) GROUP BY 1, 2""",
    ),
    "cc_capped": (
        _cc,
        f"""WITH RECURSIVE {TX_SQL},
        s1 AS (SELECT min(rt_id) OVER (PARTITION BY seller, prop_key) AS a, rt_id AS b FROM tx),
        s2 AS (SELECT min(rt_id) OVER (PARTITION BY prop_key) AS a, rt_id AS b FROM tx QUALIFY count(*) OVER (PARTITION BY prop_key) < 5),
        e AS (SELECT a, b FROM s1 WHERE a <> b UNION SELECT a, b FROM s2 WHERE a <> b), e0 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT DISTINCT a AS id, a AS c FROM e0 UNION SELECT e0.b, r.c FROM r JOIN e0 ON r.id = e0.a)
        SELECT id, min(c) AS component FROM r GROUP BY 1""",
    ),
    "cc_capped_names": (
        _cc_names,
        f"""WITH RECURSIVE {TX_SQL},
        few AS (SELECT prop_key FROM tx GROUP BY 1 HAVING count(DISTINCT regexp_replace(trim(regexp_replace(upper(seller), '\\s+', ' ', 'g')), '[.,;:]+$', '')) < 5),
        s1 AS (SELECT min(rt_id) OVER (PARTITION BY seller, prop_key) AS a, rt_id AS b FROM tx),
        s2 AS (SELECT min(rt_id) OVER (PARTITION BY prop_key) AS a, rt_id AS b FROM tx SEMI JOIN few USING (prop_key)),
        e AS (SELECT a, b FROM s1 WHERE a <> b UNION SELECT a, b FROM s2 WHERE a <> b), e0 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT DISTINCT a AS id, a AS c FROM e0 UNION SELECT e0.b, r.c FROM r JOIN e0 ON r.id = e0.a)
        SELECT id, min(c) AS component FROM r GROUP BY 1""",
    ),
    "nearest_property": (
        lambda s, d: R.nearest_within(_points(s, d), _points(s, d), 150.0),
        f"WITH {_PTS}, m AS (SELECT p.id AS probe_id, b.id AS build_id, {_HAV} AS d FROM pts p JOIN pts b ON p.id <> b.id AND abs(p.lat - b.lat) < 0.0075 AND abs(p.lng - b.lng) < 0.0075 WHERE {_HAV} <= 150) SELECT probe_id, build_id, round(d, 3) AS metres, count(*) OVER (PARTITION BY probe_id) - 1 AS alternatives FROM m QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY d, build_id) = 1",
    ),
    "point_in_polygon": (
        lambda s, d: _points(s, d).filter(R.in_polygon(F.col("lng"), F.col("lat"), RING)).select("id"),
        f"WITH {_PTS} SELECT id FROM pts WHERE ({_IN}) % 2 = 1",
    ),
    "median_coords": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", *[F.round(R.upper_median(F.transform(F.array(*[F.get("embedding", F.lit(i)) for i in of]), lambda x: x.cast("double"))), 9).alias(c) for c, of in (("lat", (0, 2, 4, 6)), ("lng", (1, 3, 5)))]),
        "SELECT vec_id, round(list_sort([embedding[1]::DOUBLE, embedding[3]::DOUBLE, embedding[5]::DOUBLE, embedding[7]::DOUBLE])[3], 9) AS lat, round(list_sort([embedding[2]::DOUBLE, embedding[4]::DOUBLE, embedding[6]::DOUBLE])[2], 9) AS lng FROM embeddings",
    ),
    "fuzzy_best_of": (lambda s, d: R.fuzzy_best(_numbered(s, d, "customer", "custkey"), _numbered(s, d, "supplier", "suppkey"), "block"), None),
    "provider_divergence": (
        lambda s, d: R.divergence(table(s, d, "embeddings"), "vec_id", [("a", 0, 1), ("b", 2, 3), ("c", 4, 5)], 1_000.0),
        "WITH v AS (SELECT vec_id, 43.6::DOUBLE + embedding[1]::DOUBLE * 0.05::DOUBLE AS la, -79.5::DOUBLE + embedding[2]::DOUBLE * 0.05::DOUBLE AS ga, 43.6::DOUBLE + embedding[3]::DOUBLE * 0.05::DOUBLE AS lb, -79.5::DOUBLE + embedding[4]::DOUBLE * 0.05::DOUBLE AS gb, 43.6::DOUBLE + embedding[5]::DOUBLE * 0.05::DOUBLE AS lc, -79.5::DOUBLE + embedding[6]::DOUBLE * 0.05::DOUBLE AS gc FROM embeddings), "
        + "d AS (" + " UNION ALL ".join(f"SELECT vec_id, '{p}-{q}' AS pair, 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(l{q} - l{p}) / 2), 2) + cos(radians(l{p})) * cos(radians(l{q})) * pow(sin(radians(g{q} - g{p}) / 2), 2))) AS m FROM v" for p, q in ("ab", "ac", "bc")) + ") "
        "SELECT vec_id, arg_max(pair, m) AS pair, round(max(m), 2) AS metres FROM d GROUP BY 1 HAVING max(m) >= 1000",
    ),
    "contact_rollup": (
        lambda s, d: M.contact_rollup(transactions(s, d)),
        f"WITH {TX_SQL}, c AS (SELECT buyer, city, count(*) AS k, min(rt_id) AS first FROM tx GROUP BY 1, 2), m AS (SELECT buyer, city FROM c QUALIFY row_number() OVER (PARTITION BY buyer ORDER BY k DESC, first) = 1), b AS (SELECT buyer, seller, count(*) AS k, min(rt_id) AS first FROM tx GROUP BY 1, 2), "
        "s AS (SELECT buyer, seller AS modal_seller, k AS deals FROM b QUALIFY row_number() OVER (PARTITION BY buyer ORDER BY k DESC, first) = 1) SELECT s.buyer, m.city, modal_seller, deals FROM s JOIN m ON s.buyer = m.buyer",
    ),
    "shared_signal_score": (
        lambda s, d: M.shared_signals(transactions(s, d), WIDE),
        f"""WITH {TX_SQL}, u AS (SELECT DISTINCT buyer, 'property ' || prop_key AS signal, 3 AS w FROM tx UNION ALL SELECT DISTINCT buyer, 'brand|' || seller || '|' || brand, 1 FROM tx),
        h AS (SELECT *, count(*) OVER (PARTITION BY signal) AS holders FROM u)
        SELECT 'pair' AS kind, x.buyer AS a, y.buyer AS b, CAST(sum(x.w) AS BIGINT) AS score FROM h x JOIN h y ON x.signal = y.signal AND x.buyer < y.buyer WHERE x.holders < {WIDE} GROUP BY 2, 3
        UNION ALL SELECT 'member', buyer, signal, CAST(w AS BIGINT) FROM h WHERE holders >= {WIDE}""",
    ),
    "signal_suggestions": (
        _suggestions,
        f"""WITH {TX_SQL}, u AS (SELECT DISTINCT buyer, CAST(prop_key AS VARCHAR) AS signal, 3 AS w FROM tx UNION ALL SELECT DISTINCT buyer, seller || '|' || brand, 1 FROM tx),
        t AS (SELECT DISTINCT buyer FROM tx WHERE iso BETWEEN '{RECENT}' AND '{AS_OF}')
        SELECT a.buyer, b.buyer AS other, CAST(sum(a.w) AS BIGINT) AS score FROM u a SEMI JOIN t USING (buyer) JOIN u b ON a.signal = b.signal AND a.w = b.w AND a.buyer <> b.buyer GROUP BY 1, 2""",
    ),
    "address_collection": (
        lambda s, d: M.address_collection(transactions(s, d)),
        f"WITH {TX_SQL}, u AS (SELECT address AS place, 1 AS priority, 'property' AS source FROM tx UNION ALL SELECT city, 2, 'buyer' FROM tx UNION ALL SELECT municipality, 3, 'region' FROM tx UNION ALL SELECT city, 3, 'region' FROM tx) SELECT place, min(priority) AS priority, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM u GROUP BY 1",
    ),
    "ranked_search": (
        lambda s, d: M.ranked_search(table(s, d, "part"), "p_partkey", "p_name", "al", 50),
        "SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'al' THEN 100 WHEN starts_with(lower(p_name), 'al') THEN 50 ELSE 10 END AS score FROM part WHERE contains(lower(p_name), 'al') ORDER BY score DESC, p_partkey LIMIT 50",
    ),
    "price_per_unit": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.price_per(F.col("p_retailprice"), F.col("p_size")).alias("shown")),
        "SELECT p_partkey, CASE WHEN p_size > 0 AND p_retailprice > 0 THEN '$' || format('{:,}', CAST(round_even(p_retailprice / p_size, 0) AS BIGINT)) END AS shown FROM part",
    ),
    "activity_overlap": (
        lambda s, d: M.party_rollup(transactions(s, d)).filter((F.col("last") >= "1996-01-01") & (F.col("first") <= "1997-12-31") & (F.col("n") >= 3)).select("name", "first", "last", "n"),
        f"WITH {TX_SQL}, {_ROLES} SELECT name, min(iso) AS first, max(iso) AS last, count(*) AS n FROM a GROUP BY 1 HAVING max(iso) >= '1996-01-01' AND min(iso) <= '1997-12-31' AND count(*) >= 3",
    ),
    "signal_coverage": (
        lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in (("phone", r"\(\d{3}\) \d{3}-\d{4}"), ("email", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+"))]),
        r"SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '\(\d{3}\) \d{3}-\d{4}')) AS phone, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+')) AS email FROM documents GROUP BY 1",
    ),
    "budget_admission": (lambda s, d: R.admitted(table(s, d, "events"), 50), "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used, least(count(*), 50) AS admitted FROM events GROUP BY 1, 2"),
    "seen_dedupe": (lambda s, d: R.first_seen(table(s, d, "events")), "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2"),
    "latest_status": (lambda s, d: R.latest_status(table(s, d, "events")), "SELECT user_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "tumbling_events": (
        lambda s, d: E.tumbling_counts(table(s, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd")),
        "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
    ),
    "session_events": (
        lambda s, d: R.sessions(table(s, d, "events")),
        """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) <= 86400 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS events FROM n GROUP BY 1, 2""",
    ),
}

ALL |= points.ALL | views.ALL | forms.ALL | rendered.ALL | details.ALL
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items() if sql is not None}
