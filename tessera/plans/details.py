"""Details of properties and parties, review lists and option lists over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import resolve as R
from tessera.operators import review as V
from tessera.plans import points
from tessera.plans.rendered import cut, text
from tessera.plans.transactions import TX_SQL, transactions
from tessera.sources.tables import table

# addresses with issues: as written, and what is wrong with them

PROPERTY_FORMS = [
    ("{n} King St, Ajax", []), ("{n} 1/2 Queen St, Ajax", ["half_address", "intersection"]), ("{n}½ Elm St, Ajax", ["half_address"]), ("{n} Main St / Oak Rd, Ajax", ["intersection"]), ("NEC Bay St and {n} Ave, Ajax", ["intersection", "no_street_number"]),
    ("PART LOT {n}, CONC 4", ["legal_description"]), ("King St, Ajax", ["no_street_number"]), ("", []), ("{n} Necker St, Ajax", []), ("B{n} Parting Way, Ajax", ["no_street_number"]), ("Plan {n} N/E, Ajax", ["intersection", "legal_description"]),
]
PARTY_FORMS = [
    ("{n} King St, Ajax, Ontario", None), ("Suite {n}, 5 Bay St", "suite_leading"), ("Commerce Court West, {n} Bay St", "building_name"), ("c/o Ann Ng, {n} Bay St", "minor_issues"), ("{n} Floor, 5 Bay St", "minor_issues"), ("PIN: {n}", "garbage_address"), ("King St, Ajax", "minor_issues"),
    ("{n} King St", "minor_issues"), ("  ", None), ("Attn: {n} Bay St, Ajax", "minor_issues"), ("Unity Rd {n}, Ajax", None), ("Level {n}, 7 Elm St", "minor_issues"), ("cash: {n}, Suite", "garbage_address"),
]


def _form(forms: list[tuple], key: str) -> str:
    quoted = lambda f: " || ".join(text("rt_id") if p == "{n}" else f"'{p}'" for p in f.replace("{n}", "\0{n}\0").split("\0") if p) or "''"
    return f"CASE ({key}) % {len(forms)} " + " ".join(f"WHEN {k} THEN {quoted(f)}" for k, (f, _) in enumerate(forms)) + " END"


_ONE, _TWO, _PARTY = _form(PROPERTY_FORMS, "rt_id"), _form(PROPERTY_FORMS, "prop_key"), _form(PARTY_FORMS, "rt_id")


def _issues(s, d) -> DataFrame:
    rows = transactions(s, d).select("rt_id", F.array(F.expr(_ONE), F.expr(_TWO)).alias("own"), F.array(F.expr(_PARTY), F.lit(None).cast("string")).alias("others"))
    return V.address_issues(rows, "rt_id", F.col("own"), F.col("others"))


def _expected(forms: list[tuple], key: str) -> str:
    said = [(k, i) for k, (_, x) in enumerate(forms) for i in ([x] if isinstance(x, str) else x or [])]
    return f"SELECT rt_id, issue FROM tx JOIN (VALUES {', '.join(f'({k}, {i!r})' for k, i in said)}) f(k, issue) ON ({key}) % {len(forms)} = f.k"


# groups of twenty-five sellers

_GROUP = cut("CAST(substr(seller, 10) AS INT)", 25)


def _queue(s, d) -> DataFrame:
    tx = transactions(s, d).withColumn("gid", F.expr(_GROUP))
    groups = tx.groupBy("gid").agg(F.count_distinct("seller").alias("names"), F.count_distinct(F.when(F.col("status") == "P", F.col("address"))).alias("alternates"), F.count_distinct(F.when(F.col("rt_id") % 40 == 0, F.col("rt_id"))).alias("transactions"))
    return V.review_queue(groups.withColumn("confirmed", F.col("gid") % 3 == 0))


KEYWORDS = ["ring", "BOLT", "small", "red", "Brand#1", "customer#00000001", "canada", "nothing like it"]


def _keywords(s, d) -> DataFrame:
    tx = transactions(s, d)
    rows = tx.groupBy("seller").agg(*[F.collect_set(c).alias(c) for c in ("address", "brand", "buyer", "city")])
    reviewed = tx.filter("status = 'F' and rt_id % 9 = 0").select("seller", F.explode(F.array(F.lit("Ring"), F.lit("red"))).alias("keyword"))
    return V.keyword_progress(rows, "seller", ["address", "brand", "buyer", "city"], KEYWORDS, reviewed)


def _property_detail(s, d) -> DataFrame:
    """Every property's transactions, newest first, with the change of price against the one before and who holds it."""
    w = Window.partitionBy("prop_key").orderBy(F.desc("iso"), "rt_id")
    rows = transactions(s, d).select("prop_key", F.row_number().over(w).alias("place"), "rt_id", "iso", "buyer", "seller", F.col("price").cast("double").alias("price"), (F.col("price") - F.lead("price").over(w)).cast("double").alias("change"))
    return rows.withColumn("holds", F.col("place") == 1)


def _party_detail(s, d) -> DataFrame:
    """Every party's properties: how often bought and sold, when first and last, and whether it bought last."""
    tx = transactions(s, d)
    sides = F.array(F.struct(F.col("buyer").alias("party"), F.lit("buyer").alias("role")), F.struct(F.col("seller").alias("party"), F.lit("seller").alias("role")))
    rows = tx.select("prop_key", "rt_id", "iso", F.inline(sides))
    out = rows.groupBy("party", "prop_key").agg(F.count_if(F.col("role") == "buyer").alias("bought"), F.count_if(F.col("role") == "seller").alias("sold"), F.min("iso").alias("first"), F.max("iso").alias("last"), F.max_by("role", F.struct("iso", "rt_id", "role")).alias("role"))
    return out.select("party", "prop_key", "bought", "sold", "first", "last", (F.col("role") == "buyer").alias("holds"))


def _options(s, d) -> DataFrame:
    """What can be filtered by, and how many deals each value has."""
    each = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("city", "brand", "municipality", "priority")])
    return transactions(s, d).select(F.inline(each)).filter("value <> ''").groupBy("kind", "value").agg(F.count("*").alias("deals"))


def _history(s, d) -> DataFrame:
    """Every customer's contacts in order, with the days since the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(s, d, "events").filter("event_type <> 'view'")
    days = F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(w)))
    return rows.select("user_id", F.row_number().over(w).alias("place"), "event_id", "event_type", days.cast("long").alias("days"))


_STORED = "id % 4 = 0"


def _parcels(s, d) -> DataFrame:
    """Points in parcels: by a stored map for every fourth, else by the rings that hold them."""
    rows = points._points(s, d)
    held = R.first_containing(rows, points.rings(s, d), 0.02).select("id", F.col("polygon_id").alias("parcel"))
    return V.consolidated(rows, rows.filter(_STORED).select("id", F.expr("id % 17").alias("parcel")), held)


_PARCELS = f"""{points._PTS}, {points._CORNERS}, held AS (SELECT id, polygon_id FROM pts, c WHERE y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1),
p AS MATERIALIZED (SELECT id, id % 17 AS parcel, 'stored' AS source FROM pts WHERE {_STORED} UNION ALL SELECT id, min(polygon_id), 'contained' FROM held WHERE NOT ({_STORED}) GROUP BY 1)"""

#: name: (query, SQL)
ALL = {
    "address_issues": (_issues, f"WITH {TX_SQL} {_expected(PROPERTY_FORMS, 'rt_id')} UNION {_expected(PROPERTY_FORMS, 'prop_key')} UNION {_expected(PARTY_FORMS, 'rt_id')}"),
    "review_queue": (
        _queue,
        f"""WITH {TX_SQL}, g AS (SELECT {_GROUP} AS gid, count(DISTINCT seller) AS names, count(DISTINCT CASE WHEN status = 'P' THEN address END) AS alternates, count(DISTINCT CASE WHEN rt_id % 40 = 0 THEN rt_id END) AS transactions FROM tx GROUP BY 1),
        s AS (SELECT gid, names, transactions, CASE WHEN names >= 20 THEN 50 WHEN names >= 10 THEN 30 ELSE 0 END + CASE WHEN gid % 3 = 0 THEN 0 ELSE 15 END
          + CASE WHEN transactions > 0 AND names / transactions > 0.8 THEN 10 ELSE 0 END + CASE WHEN alternates >= 5 THEN 15 WHEN alternates > 0 THEN 5 ELSE 0 END AS score FROM g)
        SELECT * FROM s WHERE score >= 20 OR (score >= 15 AND names >= 3) ORDER BY score DESC, gid LIMIT {V.MOST_REVIEWED}""",
    ),
    "keyword_progress": (
        _keywords,
        f"""WITH {TX_SQL}, k(keyword) AS (VALUES {', '.join(f'({k.lower()!r})' for k in KEYWORDS)}), done AS (SELECT DISTINCT seller, keyword FROM tx, (VALUES ('ring'), ('red')) r(keyword) WHERE status = 'F' AND rt_id % 9 = 0),
        h AS (SELECT DISTINCT keyword, seller FROM tx JOIN k ON contains(lower(address), keyword) OR contains(lower(brand), keyword) OR contains(lower(buyer), keyword) OR contains(lower(city), keyword))
        SELECT k.keyword, count(h.seller) AS matches, count(done.seller) AS reviewed FROM k LEFT JOIN h ON k.keyword = h.keyword LEFT JOIN done ON h.keyword = done.keyword AND h.seller = done.seller GROUP BY 1""",
    ),
    "property_detail": (
        _property_detail,
        f"""WITH {TX_SQL} SELECT prop_key, row_number() OVER w AS place, rt_id, iso, buyer, seller, CAST(price AS DOUBLE) AS price, CAST(price - lead(price) OVER w AS DOUBLE) AS change, row_number() OVER w = 1 AS holds
        FROM tx WINDOW w AS (PARTITION BY prop_key ORDER BY iso DESC, rt_id)""",
    ),
    "party_detail": (
        _party_detail,
        f"""WITH {TX_SQL}, a AS (SELECT prop_key, rt_id, iso, buyer AS party, 'buyer' AS role FROM tx UNION ALL SELECT prop_key, rt_id, iso, seller, 'seller' FROM tx)
        SELECT party, prop_key, count(*) FILTER (role = 'buyer') AS bought, count(*) FILTER (role = 'seller') AS sold, min(iso) AS first, max(iso) AS last, arg_max(role, (iso, rt_id, role)) = 'buyer' AS holds FROM a GROUP BY 1, 2""",
    ),
    "filter_options": (
        _options,
        f"WITH {TX_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c} AS value, count(*) AS deals FROM tx WHERE {c} <> '' GROUP BY 2" for c in ("city", "brand", "municipality", "priority")),
    ),
    "contact_history": (
        _history,
        "SELECT user_id, row_number() OVER w AS place, event_id, event_type, date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS days FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    ),
    "parcel_consolidation": (
        _parcels,
        f"WITH {_PARCELS} SELECT a.id, a.parcel, a.source, count(b.id) AS mates, min(b.id) AS first FROM p a LEFT JOIN p b ON a.parcel = b.parcel AND a.id <> b.id GROUP BY 1, 2, 3",
    ),
}
