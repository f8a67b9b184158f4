"""Summary views, filters, states and set operations over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import chains
from tessera.operators import resolve as R
from tessera.plans.transactions import TX_SQL, transactions
from tessera.sources.tables import table
from tessera.streaming import events as E

#: Monthly limits of uses by kind (None: no limit); a day's limit is a 28th of them. Kinds that are not listed may not be used.
LIMITS = {"view": 900, "click": None, "purchase": 280, "signup": 56}
STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]
_LINK = r'href="([^"]*)"'


def _budget(s, d) -> DataFrame:
    """Uses of each kind and day, and how many the day's and the month's limit admit, in the order of days."""
    monthly = F.create_map(*[F.lit(x) for k, v in LIMITS.items() for x in (k, -1 if v is None else v)])
    used = table(s, d, "events").groupBy(F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("used"))
    rows = used.withColumn("cap", F.element_at(monthly, F.col("kind")).cast("long"))
    by_day = F.when(F.col("cap").isNull(), 0).when(F.col("cap") < 0, F.col("used")).otherwise(F.least("used", F.floor(F.col("cap") / 28)))
    rows = rows.withColumn("today", by_day.cast("long"))
    before = F.coalesce(F.sum("today").over(Window.partitionBy("kind", F.substring("day", 1, 7)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.when(F.col("cap") < 0, F.col("today")).otherwise(F.greatest(F.least("today", F.col("cap") - before), F.lit(0)))
    return rows.withColumn("admitted", F.coalesce(left, F.lit(0)).cast("long")).select("kind", "day", "used", "admitted")


_KINDS = ", ".join(f"('{k}', {-1 if v is None else v})" for k, v in LIMITS.items())


def _outreach(s, d) -> DataFrame:
    """The status of each user: never contacted again after an error, else the furthest of its steps."""
    e = table(s, d, "events")
    seen = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("newest"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_or(F.col("event_type") == "click").alias("clicked"))
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment").join(seen, "user_id", "left")
    status = F.when(F.col("newest") == "error", "do_not_contact").when(F.col("bought"), "interested").when(F.col("clicked"), "attempted").otherwise("not_started")
    return users.select("user_id", status.alias("status"), F.coalesce("newest", F.lit("")).alias("newest"))


def _summary(s, d) -> DataFrame:
    """Transactions with the population of their city, the buyer's and seller's number of deals, and the search text."""
    tx = transactions(s, d)
    people = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.upper(F.trim("n_name")).alias("place")).agg(F.count("*").alias("population"))
    bought, sold = tx.groupBy("buyer").agg(F.count("*").alias("buyer_deals")), tx.groupBy("seller").agg(F.count("*").alias("seller_deals"))
    rows = tx.join(people, F.upper(F.trim("city")) == F.col("place"), "left").join(bought, "buyer").join(sold, "seller")
    pool = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("address", "city", "brand", "buyer", "seller", "iso")]))
    return rows.select("rt_id", "iso", F.coalesce("population", F.lit(0)).alias("population"), "buyer_deals", "seller_deals", pool.alias("pool"))


def _party_summary(s, d) -> DataFrame:
    """Each buyer with its first three properties' names, the number of all, and whether its names agree."""
    tx = transactions(s, d)
    out = tx.groupBy("buyer").agg(F.array_sort(F.collect_set("address")).alias("places"), F.max("iso").alias("last"), F.count("*").alias("n"))
    return out.select("buyer", F.array_join(F.slice("places", 1, 3), ", ").alias("places"), F.size("places").cast("long").alias("n_places"), "last", "n")


def _owner_filter(s, d) -> DataFrame:
    """Newest deals by city, brand category, price and date, of owners that are not contacted yet."""
    last = transactions(s, d).groupBy("prop_key").agg(F.max_by(F.struct("rt_id", "city", "brand", "price", "iso", "buyer"), F.struct("iso", -F.col("rt_id"))).alias("l")).select("prop_key", "l.*")
    category = F.create_map(*[F.lit(x) for k in range(1, 6) for j in range(1, 6) for x in (f"Brand#{k}{j}", "odd" if k % 2 else "even")])
    contacted = table(s, d, "events").filter("event_type = 'purchase'").join(table(s, d, "customer"), F.col("user_id") == F.col("c_custkey")).select(F.col("c_name").alias("buyer")).distinct()
    keep = (F.element_at(category, F.col("brand")) == "odd") & F.col("price").between(20_000, 400_000) & F.col("iso").between("1996-01-01", "2001-12-31")
    return last.filter(keep).join(contacted, "buyer", "left_anti").select("prop_key", "rt_id", "buyer", "city", "iso")


def _stage_totals(s, d) -> DataFrame:
    """Deals and value of every stage of a fixed list, zero where there are none."""
    dim = s.createDataFrame([(k, x) for k, x in enumerate(STAGES)], "ord long, stage string")
    sums = transactions(s, d).groupBy(F.col("priority").alias("stage")).agg(F.count("*").alias("n"), F.sum("price").alias("value"))
    return dim.join(sums, "stage", "left").select("ord", "stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def _usual_place(s, d) -> DataFrame:
    """The commonest address of each seller among those of ten characters at least; the first by name on ties."""
    n = transactions(s, d).filter(F.length("address") >= 10).groupBy("seller", "address").agg(F.count("*").alias("k"))
    best = n.groupBy("seller").agg(F.max("k").alias("k")).withColumnRenamed("seller", "who")
    return n.join(best, (F.col("seller") == F.col("who")) & (n["k"] == best["k"])).groupBy("seller").agg(F.min("address").alias("address"), F.max(n["k"]).alias("k"))


#: Sellers of one buyer and place from which on they are given one by one, not in pairs.
WIDE = 50


def _shared_pairs(s, d) -> DataFrame:
    """All sellers that share a place and a buyer there, and how many of each (kind ``pair``); where very many share one,
    each of them with the number of all (kind ``member``: a the seller, b the place and the buyer)."""
    met = transactions(s, d).select("seller", "address", "buyer").distinct()
    holders = met.groupBy("address", "buyer").agg(F.count("*").alias("n")).filter("n > 1")
    held = R.written(met.join(holders, ["address", "buyer"]))
    few = held.filter(F.col("n") < WIDE)
    a, b = few.withColumnRenamed("seller", "a"), few.select("address", "buyer", F.col("seller").alias("b"))
    pairs = a.join(b, ["address", "buyer"]).filter("a < b").groupBy("a", "b").agg(F.count_distinct("address").alias("places"), F.count_distinct("buyer").alias("buyers"))
    members = held.filter(F.col("n") >= WIDE).select(F.lit("member").alias("kind"), F.col("seller").alias("a"), F.concat_ws("|", "address", "buyer").alias("b"), F.col("n").alias("places"), F.col("n").alias("buyers"))
    return pairs.select(F.lit("pair").alias("kind"), "a", "b", "places", "buyers").unionByName(members)


def _cluster_rollup(s, d) -> DataFrame:
    """Clusters of points within 150 m: mean coordinates, members and whether there are several labels."""
    e = F.col("embedding")
    points = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (43.60 + e[0].cast("double") * 0.05).alias("lat"), (-79.50 + e[1].cast("double") * 0.05).alias("lng"), "label")
    rows = points.join(R.spatial_clusters(points, 150.0), "id")
    return rows.groupBy("component").agg(F.round(F.avg("lat"), 7).alias("lat"), F.round(F.avg("lng"), 7).alias("lng"), F.count("*").alias("members"), F.count_distinct("label").alias("labels"))


def _links(s, d) -> DataFrame:
    """Links of pages made absolute, and how many stay on the page's own site."""
    site = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    rows = table(s, d, "pages").select("page_id", site.alias("site"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("href"))
    whole = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.concat(F.col("site"), F.lit("/"), F.col("href")))
    rows = rows.select("page_id", "site", whole.alias("whole")).distinct()
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("whole").startswith(F.concat(F.col("site"), F.lit("/")))).alias("own"))


def _array_sets(s, d) -> DataFrame:
    """What two orders' priorities of a customer share, differ in and join to: sorted sets of each status."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(*[F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == x, F.col("o_orderpriority")))).alias(x) for x in "FO"])
    show = lambda c: F.array_join(F.array_sort(c), ",")
    return o.select("o_custkey", show(F.array_intersect("F", "O")).alias("both"), show(F.array_except("F", "O")).alias("only_f"), show(F.array_union("F", "O")).alias("all"))


def _first_three(s, d) -> DataFrame:
    """The first three different brands of each city in order of appearance."""
    seen = transactions(s, d).groupBy("city", "brand").agg(F.min("rt_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("city").orderBy("first"))
    return seen.withColumn("place", place).filter("place <= 3").select("city", "brand", F.col("place").cast("long").alias("place"))


def _page_of(s, d, number: int = 3, size: int = 50) -> DataFrame:
    """One page of a sorted list; rows before it are cut off at the sort."""
    return table(s, d, "customer").select("c_custkey", "c_name").orderBy(F.desc("c_acctbal"), "c_custkey").offset((number - 1) * size).limit(size)


def _coverage(s, d) -> DataFrame:
    """How many documents name a phone, an address of mail or neither, and the shares in per cent."""
    t = F.col("text")
    phone, mail = F.coalesce(t.rlike(r"\(\d{3}\) \d{3}-\d{4}"), F.lit(False)), F.coalesce(t.contains("@"), F.lit(False))
    out = table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(phone & mail).alias("both"), F.count_if(~phone & ~mail).alias("neither"))
    return out.withColumn("share", F.round(F.lit(100.0) * F.col("both") / F.greatest("n", F.lit(1)), 1))


def _merged(s, d) -> DataFrame:
    """Known suppliers with their values replaced where a review says so; what is empty in a review is kept."""
    known = table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    review = known.filter("s_suppkey % 7 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("R "), "s_name")).otherwise("").alias("new_name"))
    return known.join(review, "s_suppkey", "left").select("s_suppkey", F.coalesce(F.nullif("new_name", F.lit("")), "s_name").alias("name"), F.col("new_name").isNotNull().alias("reviewed"))


def _ranked_parties(s, d) -> DataFrame:
    """Customers by how well they answer a search: name, nation and segment count, and a tenth for each order; the best 50."""
    term = "customer#00000001"
    n, low = F.col("n_name"), F.lower("c_name")
    orders = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    score = F.when(low == term, 100).when(low.startswith(term), 50).when(low.contains(term), 10).otherwise(0) + F.when(F.lower(n).contains("an"), 10).otherwise(0)
    rows = rows.filter(score > 0).select("c_custkey", "c_name", F.round(score + 0.1 * F.coalesce("k", F.lit(0)), 1).alias("score"))
    return rows.orderBy(F.desc("score"), "c_custkey").limit(50)


def _edited(s, d) -> DataFrame:
    """Orders that hang together by a seller's deals in a property, after one deal in fifty was taken apart and others joined."""
    rows = transactions(s, d).select("rt_id", F.concat_ws("|", "seller", "brand").alias("deal"))
    edges = R.written(R.star_edges(rows, "deal", "rt_id"))
    removed = edges.filter("b % 50 = 7")
    added = rows.filter("rt_id % 200 = 3").select(F.col("rt_id").alias("a"), (F.col("rt_id") + 1).alias("b")).join(rows.select(F.col("rt_id").alias("b")), "b", "left_semi").select("a", "b")
    return R.components_after(edges, R.written(R.components(edges)), removed, added)[1]


def _streamed(s, d, stream) -> DataFrame:
    """What a stream over the events gives in four micro-batches."""
    folder = R.new_folder(s)
    return E.collected(stream(E.in_micro_batches(table(s, d, "events"), f"{folder}/in", 4)), f"{folder}/out", f"{folder}/checkpoint")


def _budget_stream(s, d) -> DataFrame:
    told = _streamed(s, d, lambda e: E.admission_stream(e, LIMITS))
    return told.groupBy("kind", "day").agg(F.sum("used").alias("used"), F.sum("admitted").alias("admitted"))


def _status_stream(s, d) -> DataFrame:
    """The last status of every user that has one."""
    told = _streamed(s, d, E.status_stream)
    return told.groupBy("user_id").agg(F.max_by("status", F.struct("ts", F.col("was") != "not_started")).alias("status")).filter("status <> 'not_started'")


def _chains(s, d) -> DataFrame:
    """From each buyer to the first buyer of its city, over properties and sellers' brands, in three steps at most."""
    tx = transactions(s, d)
    said = F.array(F.struct(F.lit("property").alias("kind"), F.col("prop_key").cast("string").alias("value")), F.struct(F.lit("brand").alias("kind"), F.concat_ws("|", "seller", "brand").alias("value")))
    firsts = tx.groupBy("city").agg(F.min("buyer").alias("goal"))
    pairs = tx.select("city", F.col("buyer").alias("source")).distinct().join(firsts, "city").select("source", "goal")
    return chains.evidence_chains(tx.select(F.col("buyer").alias("party"), F.inline(said)), pairs, 3)


def _chain_sql(steps: int) -> str:
    """A level after the other: what a level reaches is what none before has."""
    at, out = ["l0 AS MATERIALIZED (SELECT DISTINCT source, source AS party, '' AS kind, '' AS value, '' AS via, 0 AS step, source AS chain FROM pairs)"], []
    for k in range(1, steps + 1):
        before = " UNION ALL ".join(f"SELECT source, party FROM l{j}" for j in range(k))
        at.append(
            f"m{k} AS MATERIALIZED (SELECT l.source, h.party, min({{'kind': u.kind, 'value': u.value, 'via': l.party}}) AS by FROM l{k - 1} l JOIN u ON l.party = u.party JOIN u h ON u.kind = h.kind AND u.value = h.value "
            f"WHERE (l.source, h.party) NOT IN ({before}) GROUP BY 1, 2), "
            f"l{k} AS MATERIALIZED (SELECT m.source, m.party, m.by.kind AS kind, m.by.value AS value, m.by.via AS via, {k} AS step, l.chain || ' -[' || m.by.kind || ': ' || m.by.value || ']- ' || m.party AS chain FROM m{k} m JOIN l{k - 1} l ON m.source = l.source AND m.by.via = l.party)"
        )
        out.append(f"SELECT * FROM l{k}")
    return f"{', '.join(at)}, every AS (SELECT * FROM l0 UNION ALL {' UNION ALL '.join(out)}) SELECT p.source, p.goal, e.step AS steps, e.chain FROM pairs p LEFT JOIN every e ON p.source = e.source AND p.goal = e.party"


_PTS = "pts AS (SELECT vec_id AS id, 43.60::DOUBLE + embedding[1]::DOUBLE * 0.05::DOUBLE AS lat, -79.50::DOUBLE + embedding[2]::DOUBLE * 0.05::DOUBLE AS lng, label FROM embeddings)"
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - p.lng) / 2), 2)))"

#: name: (query, SQL or None)
ALL = {
    "edited_components": (
        _edited,
        f"""WITH RECURSIVE {TX_SQL}, m AS (SELECT min(rt_id) OVER (PARTITION BY seller, brand) AS a, rt_id AS b FROM tx), e AS MATERIALIZED (
          SELECT a, b FROM m WHERE a <> b AND b % 50 <> 7 UNION SELECT x.rt_id, y.rt_id FROM tx x JOIN tx y ON y.rt_id = x.rt_id + 1 WHERE x.rt_id % 200 = 3),
        n AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS id, a AS c FROM n UNION SELECT n.b, r.c FROM r JOIN n ON r.id = n.a)
        SELECT id, min(c) AS component FROM r GROUP BY 1""",
    ),
    "evidence_chains": (
        _chains,
        f"""WITH {TX_SQL}, u AS MATERIALIZED (SELECT DISTINCT buyer AS party, 'property' AS kind, CAST(prop_key AS VARCHAR) AS value FROM tx UNION ALL SELECT DISTINCT buyer, 'brand', seller || '|' || brand FROM tx),
        pairs AS MATERIALIZED (SELECT DISTINCT buyer AS source, min(buyer) OVER (PARTITION BY city) AS goal FROM tx), {_chain_sql(3)}""",
    ),
    "budget_guard": (
        _budget,
        f"""WITH lim(kind, cap) AS (VALUES {_KINDS}), u AS (SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM events GROUP BY 1, 2),
        t AS (SELECT u.*, cap, CASE WHEN cap IS NULL THEN 0 WHEN cap < 0 THEN used ELSE least(used, cap // 28) END AS today FROM u LEFT JOIN lim USING (kind)),
        w AS (SELECT *, coalesce(sum(today) OVER (PARTITION BY kind, substr(day, 1, 7) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
        SELECT kind, day, used, CAST(CASE WHEN cap IS NULL THEN 0 WHEN cap < 0 THEN today ELSE greatest(least(today, cap - before), 0) END AS BIGINT) AS admitted FROM w""",
    ),
    "budget_stream": (
        _budget_stream,
        f"""WITH lim(kind, cap) AS (VALUES {_KINDS}), u AS (SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM events GROUP BY 1, 2),
        t AS (SELECT u.*, cap, CASE WHEN cap IS NULL THEN 0 WHEN cap < 0 THEN used ELSE least(used, cap // 28) END AS today FROM u LEFT JOIN lim USING (kind)),
        w AS (SELECT *, coalesce(sum(today) OVER (PARTITION BY kind, substr(day, 1, 7) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
        SELECT kind, day, used, CAST(CASE WHEN cap IS NULL THEN 0 WHEN cap < 0 THEN today ELSE greatest(least(today, cap - before), 0) END AS BIGINT) AS admitted FROM w""",
    ),
    "status_stream": (
        _status_stream,
        """WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS newest, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'click') AS clicked FROM events GROUP BY 1),
        n AS (SELECT user_id, CASE WHEN newest = 'error' THEN 'do_not_contact' WHEN bought THEN 'interested' WHEN clicked THEN 'attempted' ELSE 'not_started' END AS status FROM s)
        SELECT * FROM n WHERE status <> 'not_started'""",
    ),
    "outreach_status": (
        _outreach,
        """WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS newest, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'click') AS clicked FROM events GROUP BY 1)
        SELECT c_custkey AS user_id, CASE WHEN newest = 'error' THEN 'do_not_contact' WHEN bought THEN 'interested' WHEN clicked THEN 'attempted' ELSE 'not_started' END AS status, coalesce(newest, '') AS newest FROM customer LEFT JOIN s ON c_custkey = user_id""",
    ),
    "transaction_summary": (
        _summary,
        f"""WITH {TX_SQL}, pop AS (SELECT upper(trim(n_name)) AS place, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT rt_id, iso, coalesce(population, 0) AS population, count(*) OVER (PARTITION BY buyer) AS buyer_deals, count(*) OVER (PARTITION BY seller) AS seller_deals, lower(concat_ws(' ', address, city, brand, buyer, seller, iso)) AS pool FROM tx LEFT JOIN pop ON upper(trim(city)) = place""",
    ),
    "party_summary": (
        _party_summary,
        f"WITH {TX_SQL}, g AS (SELECT buyer, list_sort(list_distinct(list(address))) AS p, max(iso) AS last, count(*) AS n FROM tx GROUP BY 1) SELECT buyer, array_to_string(p[1:3], ', ') AS places, CAST(len(p) AS BIGINT) AS n_places, last, n FROM g",
    ),
    "owner_filter": (
        _owner_filter,
        f"""WITH {TX_SQL}, l AS (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY prop_key ORDER BY iso DESC, rt_id) = 1)
        SELECT prop_key, rt_id, buyer, city, iso FROM l WHERE regexp_full_match(brand, 'Brand#[135][1-5]') AND price BETWEEN 20000 AND 400000 AND iso BETWEEN '1996-01-01' AND '2001-12-31'
        AND buyer NOT IN (SELECT c_name FROM customer JOIN events ON user_id = c_custkey WHERE event_type = 'purchase')""",
    ),
    "stage_totals": (
        _stage_totals,
        f"WITH {TX_SQL}, dim(ord, stage) AS (VALUES {', '.join(f'({k}::BIGINT, {x!r})' for k, x in enumerate(STAGES))}) SELECT ord, stage, count(rt_id) AS n, coalesce(CAST(sum(price) AS DOUBLE), 0) AS value FROM dim LEFT JOIN tx ON priority = stage GROUP BY 1, 2",
    ),
    "usual_address": (
        _usual_place,
        f"WITH {TX_SQL}, n AS (SELECT seller, address, count(*) AS k FROM tx WHERE length(address) >= 10 GROUP BY 1, 2) SELECT seller, address, k FROM n QUALIFY row_number() OVER (PARTITION BY seller ORDER BY k DESC, address) = 1",
    ),
    "shared_pairs": (
        _shared_pairs,
        f"""WITH {TX_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY address, buyer) AS n FROM (SELECT DISTINCT seller, address, buyer FROM tx))
        SELECT 'pair' AS kind, a.seller AS a, b.seller AS b, count(DISTINCT a.address) AS places, count(DISTINCT a.buyer) AS buyers FROM m a JOIN m b ON a.address = b.address AND a.buyer = b.buyer AND a.seller < b.seller WHERE a.n < {WIDE} GROUP BY 2, 3
        UNION ALL SELECT 'member', seller, address || '|' || buyer, n, n FROM m WHERE n >= {WIDE}""",
    ),
    "cluster_rollup": (
        _cluster_rollup,
        f"""WITH RECURSIVE {_PTS}, e AS (SELECT p.id AS a, b.id AS b FROM pts p JOIN pts b ON p.id <> b.id AND abs(p.lat - b.lat) < 0.0075 AND abs(p.lng - b.lng) < 0.0075 WHERE {_HAV} <= 150),
        r AS (SELECT DISTINCT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.id = e.a), c AS (SELECT id, min(m) AS component FROM r GROUP BY 1)
        SELECT component, round(avg(lat), 7) AS lat, round(avg(lng), 7) AS lng, count(*) AS members, count(DISTINCT label) AS labels FROM c JOIN pts USING (id) GROUP BY 1""",
    ),
    "site_links": (
        _links,
        f"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS site, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href FROM pages),
        w AS (SELECT DISTINCT page_id, site, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN site || href ELSE site || '/' || href END AS whole FROM l)
        SELECT page_id, count(*) AS links, count(*) FILTER (starts_with(whole, site || '/')) AS own FROM w GROUP BY 1""",
    ),
    "array_sets": (
        _array_sets,
        """WITH o AS (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []) AS f, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), []) AS o FROM orders GROUP BY 1)
        SELECT o_custkey, coalesce(array_to_string(list_sort(list_intersect(f, o)), ','), '') AS both, coalesce(array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(o, x))), ','), '') AS only_f, coalesce(array_to_string(list_sort(list_distinct(list_concat(f, o))), ','), '') AS all FROM o""",
    ),
    "first_three_brands": (
        _first_three,
        f"WITH {TX_SQL}, s AS (SELECT city, brand, min(rt_id) AS first FROM tx GROUP BY 1, 2) SELECT city, brand, row_number() OVER (PARTITION BY city ORDER BY first) AS place FROM s QUALIFY place <= 3",
    ),
    "page_of_customers": (_page_of, "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100"),
    "contact_coverage": (
        _coverage,
        r"WITH f AS (SELECT lang, coalesce(regexp_matches(text, '\(\d{3}\) \d{3}-\d{4}'), false) AS p, coalesce(contains(text, '@'), false) AS m FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (p AND m) AS both, count(*) FILTER (NOT p AND NOT m) AS neither, round(100.0::DOUBLE * count(*) FILTER (p AND m) / greatest(count(*), 1), 1) AS share FROM f GROUP BY 1",
    ),
    "review_overlay": (
        _merged,
        "SELECT s_suppkey, CASE WHEN s_suppkey % 14 = 0 THEN 'R ' || s_name ELSE s_name END AS name, s_suppkey % 7 = 0 AS reviewed FROM supplier",
    ),
    "ranked_parties": (
        _ranked_parties,
        """WITH o AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1),
        r AS (SELECT c_custkey, c_name, CASE WHEN lower(c_name) = 'customer#00000001' THEN 100 WHEN starts_with(lower(c_name), 'customer#00000001') THEN 50 WHEN contains(lower(c_name), 'customer#00000001') THEN 10 ELSE 0 END + CASE WHEN contains(lower(n_name), 'an') THEN 10 ELSE 0 END AS score, coalesce(k, 0) AS k
              FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o_custkey)
        SELECT c_custkey, c_name, round(score + 0.1::DOUBLE * k, 1) AS score FROM r WHERE r.score > 0 ORDER BY 3 DESC, c_custkey LIMIT 50""",
    ),
}
