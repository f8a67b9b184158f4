"""Addresses, names, dates, prices, files, markets and parties in the many forms in which they are written, made of
whole tables in SQL that Spark and DuckDB both read, and the queries that bring them to one form.

A form stands with what has to come of it, so the SQL of a query takes nothing apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import addresses as A
from tessera.functions import text as T
from tessera.operators import confirm
from tessera.operators import parties as P
from tessera.operators import places as L
from tessera.operators import resolve as R
from tessera.plans.rendered import DAY, DOLLARS, cut, digits, money, pick, text, when
from tessera.plans.transactions import TX_SQL, transactions
from tessera.sources.tables import table

# addresses: twenty orders in a row have one number and city, and write them in twenty ways

BLOCK = cut("rt_id", 20)
NUMBER = f"(1 + {BLOCK} % 90 * 10)"
#: As written; normalized; without direction; street number; post-office box; legal description; single addresses.
FORMS = [
    ("{0}, {2} & {4} COMMERCE PARK DR", "{0}, {2} & {4} COMMERCE PARK DRIVE", None, True, False, False, ["{0} COMMERCE PARK DR", "{2} COMMERCE PARK DR", "{4} COMMERCE PARK DR"]),
    ("{0} - {4} COMMERCE PARK DR", "{0} - {4} COMMERCE PARK DRIVE", None, True, False, False, ["{0} COMMERCE PARK DR", "{4} COMMERCE PARK DR"]),
    ("{0} - {6} & {8} DUNDURN ST N", "{0} - {6} & {8} DUNDURN STREET NORTH", "{0} - {6} & {8} DUNDURN STREET", True, False, False, ["{0} DUNDURN ST N", "{6} DUNDURN ST N", "{8} DUNDURN ST N"]),
    ("{0} - {5}, {7} BLOOR ST W", "{0} - {5}, {7} BLOOR STREET WEST", "{0} - {5}, {7} BLOOR STREET", True, False, False, ["{0} BLOOR ST W", "{5} BLOOR ST W", "{7} BLOOR ST W"]),
    ("{0}, {2} - {4} ST CLAIR ST", "{0}, {2} - {4} SAINT CLAIR STREET", None, True, False, False, ["{0} ST CLAIR ST", "{2} ST CLAIR ST", "{4} ST CLAIR ST"]),
    ("HIGHWAY 6 & {0}", "HIGHWAY 6 & {0}", None, False, False, False, ["HIGHWAY 6 & {0}"]),
    ("({0} - {2} YORK ST)", "({0} - {2} YORK STREET)", None, False, False, False, ["{0} YORK ST", "{2} YORK ST"]),
    ("B03-{0} King William St", "B03-{0} KING WILLIAM STREET", None, True, False, False, ["B03-{0} King William St"]),
    ("{0} Ave.North", "{0} AVENUE NORTH", "{0} AVENUE", True, False, False, ["{0} Ave.North"]),
    ("{0} WALLACE AVE", "{0} WALLACE AVENUE", None, True, False, False, ["{0} WALLACE AVE"]),
    ("{0} WALLACE AVE N", "{0} WALLACE AVENUE NORTH", "{0} WALLACE AVENUE", True, False, False, ["{0} WALLACE AVE N"]),
    ("{0} Wallace Ave. S", "{0} WALLACE AVENUE SOUTH", "{0} WALLACE AVENUE", True, False, False, ["{0} Wallace Ave. S"]),
    ("PO BOX {0}", "PO BOX {0}", None, False, True, False, ["PO BOX {0}"]),
    ("P.O. Box {0}, Main St", "P O BOX {0}, MAIN STREET", None, False, True, False, ["P.O. Box {0}, Main St"]),
    ("PT LOT 7 CONC {0}", "PT LOT 7 CONC {0}", None, False, False, True, ["PT LOT 7 CONC {0}"]),
    ("LOT 3, PLAN {0}", "LOT 3, PLAN {0}", None, False, False, True, ["LOT 3, PLAN {0}"]),
    ("  {0}   Ste Catherine  Rd. ", "{0} SAINT CATHERINE ROAD", None, True, False, False, ["{0}   Ste Catherine  Rd."]),
    ("{0} BALSAM LOT ST", "{0} BALSAM LOT STREET", None, True, False, False, ["{0} BALSAM LOT ST"]),
    ("", "", None, False, False, False, []),
    ("{0} ST JOHN PL SW", "{0} SAINT JOHN PLACE SOUTHWEST", "{0} SAINT JOHN PLACE", True, False, False, ["{0} ST JOHN PL SW"]),
]
CITIES = [("Barrie", "BARRIE"), ("barrie ", "BARRIE"), ("Hamilton", "HAMILTON"), ("Stoney  Creek", "HAMILTON"), ("S.S. Marie", "SAULT STE. MARIE"), ("listowel", "NORTH PERTH"), ("Orléans", "OTTAWA"), ("Ajax", "AJAX"), ("N. Perth", "NORTH PERTH")]
CITY, CITY_KEY = (pick(BLOCK, [c[k] for c in CITIES]) for k in (0, 1))


def filled(form: str, number: str = NUMBER) -> str:
    """A form with sums of the number in the places of its brackets."""
    parts = [text(f"{number} + {p[1:-1]}") if p.startswith("{") else f"'{p}'" for p in re.split(r"(\{\d+\})", form) if p]
    return " || ".join(parts) or "''"


def of_form(values: list[str], key: str = "rt_id") -> str:
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


ADDRESS = of_form([filled(f[0]) for f in FORMS])
NORMAL, LOOSE = of_form([filled(f[1]) for f in FORMS]), of_form([filled(f[2] or f[1]) for f in FORMS])
_PLACED = f"WITH {TX_SQL}, a AS (SELECT rt_id, {NORMAL} AS a, {LOOSE} AS bare, {CITY_KEY} AS c FROM tx)"


def _addresses(s, d) -> DataFrame:
    return transactions(s, d).select("rt_id", F.expr(ADDRESS).alias("address"), F.expr(CITY).alias("city"))


def _address_keys(s, d) -> DataFrame:
    a, c = F.col("address"), F.col("city")
    return _addresses(s, d).select("rt_id", A.dedup_key(a, c).alias("key"), A.loose_key(a, c).alias("loose"), A.street_number(a).alias("number"), A.is_po_box(a).alias("po_box"), A.is_legal_description(a).alias("legal"))


def _loose_merges(s, d) -> DataFrame:
    """Pairs of addresses that are one place: one key equal to the other's without its direction. What is written alike is
    normalized once, and the keys are stored, as both sides of the join read them."""
    a, c = F.col("address"), F.col("city")
    rows = R.written(_addresses(s, d).select("address", "city").distinct()).select(A.dedup_key(a, c).alias("key"), A.loose_key(a, c).alias("loose")).distinct()
    rows = R.written(rows)
    bare, pointed = rows.filter("key = loose").select(F.col("key").alias("short")), rows.filter("key <> loose")
    return pointed.join(bare, pointed["loose"] == bare["short"]).select("key", "short")


def _compound(s, d) -> DataFrame:
    one = A.expanded(F.col("address"), F.col("city"), F.lit("Ontario"))
    return _addresses(s, d).select("rt_id", F.explode(one).alias("single"))


_SINGLES = " UNION ALL ".join(f"SELECT rt_id, {filled(one)} || ', ' || {CITY} || ', Ontario' AS single FROM tx WHERE rt_id % 20 = {k}" for k, f in enumerate(FORMS) for one in f[6])

#: Of some blocks the address without direction is a property, of others one with a direction.
_HELD = f"(rt_id % 20 = 9 AND {BLOCK} % 3 = 0) OR (rt_id % 20 = 11 AND {BLOCK} % 3 = 1) OR rt_id % 20 IN (0, 16, 18)"
_PID = f"'P' || {digits('rt_id', 9)}"


def _cascade(s, d) -> DataFrame:
    rows = _addresses(s, d)
    return L.cascade_match(rows.withColumnRenamed("rt_id", "id"), rows.filter(F.expr(_HELD)).select(F.expr(_PID).alias("pid"), "address", "city"))


# a registry of properties, over the same addresses

_PINS = f"CASE WHEN rt_id % 20 IN (8, 10) THEN array('x', 'pin' || {text(BLOCK)}) WHEN rt_id % 20 = 5 THEN array('pin' || {text(f'{BLOCK} + 1')}) END"


def registry_input(s, d) -> tuple[DataFrame, DataFrame]:
    """Transactions, and the properties that were known before: some with a pin, some with an older form of the address."""
    rows = _addresses(s, d)
    known = rows.filter(f"{_HELD} OR (rt_id % 20 IN (10, 19) AND {BLOCK} % 2 = 0)").select(F.expr(_PID).alias("pid"), "address", "city", F.expr(f"CASE WHEN rt_id % 20 = 0 THEN 'pin' || {text(BLOCK)} END").alias("pin"))
    bought = rows.filter(f"rt_id % 20 NOT IN (16, 11) AND NOT (rt_id % 20 = 10 AND {BLOCK} % 4 = 0)").select(F.concat(F.lit("RT"), F.lpad(F.col("rt_id").cast("string"), 9, "0")).alias("rt_id"), "address", "city", F.expr(_PINS).alias("pins"))
    return bought, known


# names: every customer under its number in letters

LETTERS = "translate({0}, '0123456789', 'ABCDEFGHIJ')"
#: As written ({W}: the customer's own word); normalized; company; numbered; without suffix; what tells it apart.
NAMES = [
    ("{W} Properties Inc.", "{W} PROPERTIES INC", True, False, "{W} Properties", "{W}"),
    ("{W}  PROPERTIES INC", "{W} PROPERTIES INC", True, False, "{W}  PROPERTIES", "{W}"),
    ("{D} Ontario Ltd", "{D} ONTARIO LTD", True, True, "{D} Ontario", None),
    ("{D} Ontario Ltd Holdings", "{D} ONTARIO LTD HOLDINGS", True, False, "{D} Ontario Ltd Holdings", None),
    ("{D} Canada Inc", "{D} CANADA INC", True, False, "{D} Canada", None),
    ("Ann {W}", "ANN {W}", False, False, "Ann {W}", "ANN {W}"),
    ("Canadian Tire {W} Limited", "CANADIAN TIRE {W} LIMITED", True, False, "Canadian Tire {W}", "CANADIAN TIRE"),
    ("First {W} (Leaside) Corporation", "FIRST {W} (LEASIDE) CORPORATION", True, False, "First {W} (Leaside)", "FIRST {W}"),
    ("{W} Real Estate Limited 12", "{W} REAL ESTATE LIMITED 12", True, False, "{W} Real Estate Limited 12", "{W}"),
    ("{D} {W} Holdings Inc", "{D} {W} HOLDINGS INC", True, False, "{D} {W} Holdings", None),
    ("Van der {W} Family", "VAN DER {W} FAMILY", True, False, "Van der {W} Family", "VAN DER {W} FAMILY"),
    ("{W} Coffee Canada, Inc.", "{W} COFFEE CANADA, INC", True, False, "{W} Coffee Canada", "{W} COFFEE CANADA,"),
    ("", "", True, False, "", None),
]
_WORD = f"'Q' || {LETTERS.format(text('c_custkey'))} || 'Y'"


def _named(form: str | None, upper: bool = False) -> str:
    if form is None:
        return "NULL"
    word = f"upper({_WORD})" if upper else _WORD
    parts = [word if p == "{W}" else digits("c_custkey", 7, "1") if p == "{D}" else f"'{p}'" for p in re.split(r"(\{[WD]\})", form) if p]
    return " || ".join(parts) or "''"


_ALIASES = ["'Law Office of ' || {w}", "{w} || ' LLP'", "{w} || ' Tower 5'", "'BCE Place'", "'IN TRUST'", "{w} || ' Foods'", "'abc'", "'99 Ontario'", "'Avocats ' || {w}"]
NAME, ALIAS = of_form([_named(f[0]) for f in NAMES], "c_custkey"), of_form([a.format(w=_WORD) for a in _ALIASES], "c_custkey")


def _party_names(s, d) -> DataFrame:
    n = F.col("name")
    rows = table(s, d, "customer").select("c_custkey", F.expr(NAME).alias("name"), F.expr(ALIAS).alias("alias"))
    return rows.select("c_custkey", T.normalize_name(n).alias("norm"), T.is_company(n).alias("company"), T.numbered_company(n).alias("numbered"), T.make_alias(n).alias("short"), T.clean_alias(F.col("alias"), n).alias("alias"), T.brand_token(n).alias("token"))


# printed dates and prices, names of files

_MONTH_NAMES = "CASE substr(iso, 6, 2) " + " ".join(f"WHEN '{k:02d}' THEN '{m}'" for k, m in enumerate("January February March April May June July August September October November December".split(), 1)) + " END"
_BARE_DAY = text("CAST(substr(iso, 9, 2) AS INT)")
_DATED = of_form([DAY, f"{_BARE_DAY} || ' ' || {_MONTH_NAMES} || ' ' || substr(iso, 1, 4)", "iso", "substr(iso, 6, 2) || '/' || substr(iso, 9, 2) || '/' || substr(iso, 1, 4)", f"{_BARE_DAY} || 'th ' || substr({DAY}, 4)", "'soon'", f"' ' || upper({DAY})", "''"])
_PRICED = of_form([f"'$' || {money(DOLLARS)}", f"{money(DOLLARS)} || ' CAD'", "'n/a'", f"' $ ' || {money(DOLLARS)} || ' '"])


def _printed(s, d) -> DataFrame:
    rows = transactions(s, d).select("rt_id", F.expr(_DATED).alias("said"), F.expr(_PRICED).alias("cost"))
    when_ = T.sale_date(F.col("said"))
    return rows.select("rt_id", when_["iso"].alias("iso"), when_["day"].alias("day"), T.money(F.col("cost")).alias("amount"), T.shown_price(F.col("cost")).alias("price"))


_CLOCK = f"{digits('rt_id % 24', 2)} || {digits('rt_id % 60', 2)} || {digits('prop_key % 60', 2)}"
_FILE = when("rt_id % 5 = 4", f"'Notes (' || {text('rt_id')} || ').json'", f"'Brokers ' || {text('rt_id')} || '_' || iso || '_' || {_CLOCK} || '.json'")


def _file_times(s, d) -> DataFrame:
    rows = transactions(s, d).select("rt_id", F.expr(_FILE).alias("file"))
    return rows.select("rt_id", T.time_of_file(F.col("file")).alias("made"), T.slug(F.col("file")).alias("slug"))


# markets: customers by nation come before suppliers by nation, these before regions; other names for some

_CALLED = "CASE WHEN n_nationkey % 4 = 0 THEN 'Greater ' || n_name WHEN n_nationkey % 4 = 1 THEN r_name ELSE n_name END"
_COMMON = "(n_nationkey % 3 <> 0)"


def _markets(s, d) -> DataFrame:
    nation, region = table(s, d, "nation"), table(s, d, "region")
    of = lambda t, k: table(s, d, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias("population")).join(nation, "n_nationkey")
    first = of("customer", "c_nationkey").filter(F.expr(_COMMON)).select(F.col("n_name").alias("name"), "population")
    second = of("supplier", "s_nationkey").select(F.col("n_name").alias("name"), "population")
    third = of("customer", "c_nationkey").join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.max("population").alias("population"))
    called = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.expr(_CALLED).alias("name"), F.col("n_name").alias("canonical"))
    return L.market_table([first, second, third], called)


# parties: sixty-four customers in a row are appearances on both sides of every limit of the rules

_B, _P = cut("c_custkey", 64), "(c_custkey % 64)"
_LET = f"'Z' || {LETTERS.format(text(_B))}"
_POS = LETTERS.format(text(_P))


def _by_place(cases: list[tuple[int, int, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_P} BETWEEN {a} AND {b} THEN {e}" for a, b, e in cases) + f" ELSE {other} END"


_PARTY_NAME = _by_place(
    [
        (0, 13, f"'Fourteen' || {_POS} || ' ' || {_LET}"), (14, 28, f"'Fifteen' || {_POS} || ' ' || {_LET}"), (29, 35, f"'Sevenco' || {_LET} || ' ' || repeat('Group ', {_P} - 29) || 'Holdings Inc'"),
        (36, 43, f"'Eightco' || {_LET} || ' ' || repeat('Group ', {_P} - 36) || 'Holdings Inc'"), (44, 47, f"'Fourad' || {_POS} || {_LET} || ' Inc'"), (48, 52, f"'Fivead' || {_POS} || {_LET} || ' Inc'"),
        (53, 53, f"'Gamma' || {_LET} || ' Industries Ltd.'"), (54, 54, f"'gamma' || lower({_LET}) || '  industries LTD'"), (55, 55, f"'Delta' || {_LET} || ' West Realty'"), (56, 56, f"'Delta' || {_LET} || ' Properties'"),
        (57, 58, f"{text(f'5000000 + {_B}')} || ' Ontario Ltd' || repeat('.', {_P} - 57)"), (59, 59, f"{text(f'5000000 + {_B}')} || ' Ontario Ltd'"), (60, 61, f"'Yan' || {_POS} || ' ' || {_LET}"),
    ],
    f"'Lone' || {_POS} || ' ' || {_LET}",
)
#: A block's own digits: two at least, never cut off, so that no two blocks have a phone in common.
_OWN = when(f"{_B} < 100", digits(_B, 2), text(_B))
_PARTY_PHONE = _by_place([(0, 13, f"'(416) 1' || {_OWN} || '-0014'"), (14, 28, f"'4169' || {_OWN} || '0015'"), (60, 60, f"'416 2' || {_OWN} || ' 0100'"), (61, 61, f"'416.2' || {_OWN} || '.0100'"), (62, 62, "'12345'")], "''")
_PARTY_CONTACT = _by_place([(14, 20, "'Kim  Lee'"), (57, 57, "'Bo Ek'"), (58, 58, "' bo ek'"), (59, 59, "'Cy Ode'")], "''")
_PARTY_PLACE = _by_place([(44, 47, f"{text(_B)} || '44 Common Rd'"), (48, 52, f"{text(_B)} || '55 Common Road'"), (62, 63, "'9 Elm St'")], "''")
_IS_COMPANY = f"({_P} BETWEEN 29 AND 59 OR {_P} >= 62)"
#: What has to be one: all under a name of their own but for these, in which the smallest customer's number counts.
_SAME = [(0, 13), (14, 20), (29, 35), (44, 47), (53, 54), (55, 56), (57, 58), (60, 61)]
_COMPONENT_KEY = _by_place([(a, b, str(a)) for a, b in _SAME], _P)


def appearances(s, d) -> DataFrame:
    phone = F.expr(_PARTY_PHONE)
    return table(s, d, "customer").select(
        F.col("c_custkey").alias("id"), F.expr(_PARTY_NAME).alias("name"), F.when(phone == "", F.array().cast("array<string>")).otherwise(F.array(phone)).alias("phones"),
        F.expr(_PARTY_CONTACT).alias("contact"), F.expr(_PARTY_PLACE).alias("address"), F.expr(_IS_COMPANY).alias("is_company"),
    )


def known_groups(s, d) -> DataFrame:
    """Names that have a group: of every fourth block the first of the fourteen, and of every eighth a company."""
    rows = appearances(s, d).withColumn("b", F.expr(_B.replace("c_custkey", "id"))).withColumn("p", F.col("id") % 64)
    kept = rows.filter("(p = 3 AND b % 4 = 0) OR (p IN (44, 53) AND b % 8 = 1)")
    return kept.select(T.normalize_name(F.col("name")).alias("name"), F.concat(F.lit("G"), F.lpad((F.col("b") * 3 + F.when(F.col("p") == 3, 1).otherwise(2)).cast("string"), 5, "0")).alias("gid"))


#: Groups of too many names link only where a block, as the last, is cut short.
_CUT_SHORT = [(14, 28, P.PHONE_NAMES), (36, 43, P.BRAND_NAMES), (48, 52, P.ADDRESS_NAMES)]
_FEW = " ".join(f"WHEN p BETWEEN {a} AND {b} AND count(*) FILTER (p BETWEEN {a} AND {b}) OVER (PARTITION BY b) < {n} THEN {a}" for a, b, n in _CUT_SHORT)
_CLUSTERED = f"""raw AS (SELECT c_custkey, c_custkey AS id, {_PARTY_NAME} AS name, {_IS_COMPANY} AS is_company, {_B} AS b, {_P} AS p FROM customer),
keyed AS (SELECT *, CASE {_FEW} ELSE {_COMPONENT_KEY} END AS k FROM raw), ap AS (SELECT id, name, is_company, b, p, min(id) OVER (PARTITION BY b, k) AS component FROM keyed)"""


def _clusters(s, d) -> DataFrame:
    return P.clustered(appearances(s, d))


def _party_registry(s, d) -> DataFrame:
    rows = R.written(appearances(s, d))
    return P.registry(rows, P.clustered(rows), known_groups(s, d))


# alternate names: blocks lean on the company of the next one, and some of their own people on their own company

_LEANS = f"CASE WHEN {_P} = 53 THEN 'Gamma' || {LETTERS.format(text(f'{_B} + 1'))} || ' Trading Co' WHEN {_P} IN (62, 63, 21, 60) THEN 'Gamma' || {LETTERS.format(text(_B))} || ' Trading Co.' WHEN {_P} = 40 THEN 'Nobody' END"
_OFFICE = f"CASE WHEN {_P} IN (53, 54, 62, 21) THEN '100 King St, Suite ' || {text(_P)} WHEN {_P} = 60 THEN '100 King St' WHEN {_P} = 63 THEN '7 Elsewhere Road' ELSE {_PARTY_PLACE} END"


def leaning_appearances(s, d) -> DataFrame:
    """As ``appearances``; the two of a block's company have the names on which others lean."""
    rows = appearances(s, d).withColumn("alternate_names", F.array_compact(F.array(F.expr(_LEANS.replace("c_custkey", "id")))))
    company = F.expr(f"'Gamma' || {LETTERS.format(text(_B))} || ' Trading Co'".replace("c_custkey", "id"))
    return rows.withColumn("address", F.expr(_OFFICE.replace("c_custkey", "id"))).withColumn("name", F.when(F.col("id") % 64 == 53, company).when(F.col("id") % 64 == 54, F.concat(company, F.lit("."))).otherwise(F.col("name")))


# stores and the properties at their number and city, their streets written in two ways

_STORE_STREETS = ["King Street West", "Queen St.", "Lake Shore Boulvard", "Main Strret N", "Oak Crescnt", "Harbor Rd", "Commerce Park Drive", "Elmwood Avenu E"]
_LOT_STREETS = ["KING ST W", "QUEEN STREET", "LAKE SHORE BLVD", "MAIN ST N", "OAK CRES", "HARBOUR ROAD", "COMMERCE PARK DR", "ELMWOOD AVE E", "KINGSTON ST W", "OAKWOOD CRES"]


def store_input(s, d) -> tuple[DataFrame, DataFrame]:
    """Stores of every customer and properties of every part, in the cities of the nations."""
    store = f"CASE WHEN c_custkey % 29 = 0 THEN 'Unit of the mall' WHEN c_custkey % 29 = 1 THEN 'B' || {text('c_custkey % 7')} || '-' || {text('1 + c_custkey % 12')} || ' ' || {pick('c_custkey', _STORE_STREETS)} ELSE {text('1 + c_custkey % 12')} || ' ' || {pick('c_custkey', _STORE_STREETS)} END"
    lot = f"{text('1 + p_partkey % 11')} || ' ' || {pick('p_partkey', _LOT_STREETS)}"
    nation = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    stores = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(store).alias("address"), F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    lots = table(s, d, "part").select(F.col("p_partkey").alias("pid"), F.expr(lot).alias("address"), F.expr("p_partkey % 25").alias("n_nationkey")).join(nation, "n_nationkey")
    return stores.select("id", "address", "city"), lots.select("pid", "address", "city")


# decisions on parties: groups of eight suppliers; the decisions are a short list

DECISIONS = (
    [("SUPPLIER#000000001", ""), ("SUPPLIER#000000009", "G00003"), ("SUPPLIER#000000010", "G00003"), ("SUPPLIER#000000017", "G00900"), ("NOBODY", "G00001"), ("", "G00001"), ("SUPPLIER#000000001", "G00000"), ("SUPPLIER#000000002", "")],
    [["G00003", "G00000", "G00777"], ["G00900", "G00003"], ["G00888", "G00001"], ["G00001"]],
)


def members(s, d) -> DataFrame:
    """Appearances of sellers, in groups of eight of them."""
    group = F.concat(F.lit("G"), F.lpad(F.floor(F.regexp_extract("seller", r"(\d+)$", 1).cast("int") / 8).cast("string"), 5, "0"))
    return transactions(s, d).select(F.col("rt_id").alias("id"), group.alias("gid"), F.upper("seller").alias("nn"), F.concat(F.lit("RT"), (F.col("rt_id") % 400).cast("string")).alias("rt_id"), F.lit("seller").alias("role"))


# confirmation: groups of eight sellers, whose orders tell phones, contacts and aliases

_GID = digits(cut("CAST(substr(seller, 10) AS INT)", 8), 5)
_POST = f"CASE WHEN CAST({_GID} AS INT) % 3 = 0 THEN 'Trading Post ' || {_GID} ELSE '' END"
_SAID_PHONE = "CASE WHEN CAST(substr(seller, 10) AS INT) % 4 < 2 AND rt_id % 3 = 0 THEN '555-' || CAST(CAST(substr(seller, 10) AS INT) % 2 AS STRING) ELSE ' ' END"
_SAID_CONTACT = "CASE WHEN CAST(substr(seller, 10) AS INT) % 8 IN (5, 6) AND rt_id % 2 = 0 THEN 'kim ' || status ELSE '' END"
_SAID_ALIAS = f"CASE WHEN CAST(substr(seller, 10) AS INT) % 8 IN (2, 6) AND rt_id % 5 = 0 THEN 'trading post' WHEN rt_id % 7 = 0 THEN brand END"


def _confirmed(s, d) -> DataFrame:
    tx = transactions(s, d)
    rows = tx.select(F.expr(_GID).alias("gid"), F.upper("seller").alias("name"), F.expr(_SAID_PHONE).alias("phone"), F.expr(_SAID_CONTACT).alias("contact"), F.array_compact(F.array(F.expr(_SAID_ALIAS))).alias("aliases"))
    groups = tx.select(F.expr(_GID).alias("gid"), F.expr(_POST).alias("display_name")).distinct()
    known = rows.filter("name like '%3'").select("gid", "name")
    return confirm.auto_confirmed(rows, groups, known)


_TRY = ["a", "bare", *(f"a || ' {w}'" for w in L.DIRECTIONS)]

#: name: (query, SQL or None)
ALL = {
    "address_keys": (
        _address_keys,
        f"{_PLACED} SELECT rt_id, a || '|' || c AS key, bare || '|' || c AS loose, CASE WHEN rt_id % 20 IN ({', '.join(str(k) for k, f in enumerate(FORMS) if f[3])}) THEN {text(NUMBER)} END AS number, "
        f"rt_id % 20 IN ({', '.join(str(k) for k, f in enumerate(FORMS) if f[4])}) AS po_box, rt_id % 20 IN ({', '.join(str(k) for k, f in enumerate(FORMS) if f[5])}) AS legal FROM a",
    ),
    "loose_merges": (_loose_merges, f"{_PLACED}, k AS (SELECT DISTINCT a || '|' || c AS key, bare || '|' || c AS loose FROM a) SELECT x.key, y.key AS short FROM k x JOIN k y ON x.loose = y.key WHERE x.key <> x.loose AND y.key = y.loose"),
    "compound_addresses": (_compound, f"WITH {TX_SQL} {_SINGLES}"),
    "cascade_match": (
        _cascade,
        f"""{_PLACED}, k AS (SELECT a || '|' || c AS key, max({_PID}) AS pid FROM a WHERE ({_HELD}) AND a <> '' GROUP BY 1),
        t AS ({" UNION ALL ".join(f"SELECT rt_id, {o} AS o, {e} || '|' || c AS key FROM a WHERE a <> ''" for o, e in enumerate(_TRY))}), b AS (SELECT rt_id, arg_min(pid, o) AS pid FROM t JOIN k USING (key) GROUP BY 1)
        SELECT a.rt_id AS id, b.pid FROM a LEFT JOIN b ON a.rt_id = b.rt_id""",
    ),
    "property_registry": (lambda s, d: L.property_registry(*registry_input(s, d)), None),
    "party_names": (
        _party_names,
        f"SELECT c_custkey, {of_form([_named(f[1], True) for f in NAMES], 'c_custkey')} AS norm, {of_form([str(f[2]) for f in NAMES], 'c_custkey')} AS company, {of_form([str(f[3]) for f in NAMES], 'c_custkey')} AS numbered, "
        f"{of_form([_named(f[4]) for f in NAMES], 'c_custkey')} AS short, CASE WHEN c_custkey % {len(_ALIASES)} = 5 THEN upper({_WORD}) || ' FOODS' END AS alias, {of_form([_named(f[5], True) for f in NAMES], 'c_custkey')} AS token FROM customer",
    ),
    "printed_values": (
        _printed,
        f"WITH {TX_SQL} SELECT rt_id, CASE WHEN rt_id % 8 IN (5, 7) THEN '' ELSE iso END AS iso, CASE WHEN rt_id % 8 IN (5, 7) THEN '' ELSE {DAY} END AS day, CASE WHEN rt_id % 4 IN (0, 3) THEN CAST({DOLLARS} AS DOUBLE) END AS amount, "
        f"CASE WHEN rt_id % 4 = 2 THEN '' ELSE '$' || {money(DOLLARS)} END AS price FROM tx",
    ),
    "file_times": (
        _file_times,
        f"WITH {TX_SQL} SELECT rt_id, CASE WHEN rt_id % 5 <> 4 THEN iso || ' ' || {digits('rt_id % 24', 2)} || ':' || {digits('rt_id % 60', 2)} || ':' || {digits('prop_key % 60', 2)} END AS made, "
        f"CASE WHEN rt_id % 5 = 4 THEN 'notes-' || rt_id ELSE 'brokers-' || rt_id || '-' || iso || '-' || {_CLOCK} END AS slug FROM tx",
    ),
    "market_table": (
        _markets,
        f"""WITH c AS (SELECT n_nationkey, n_name, n_regionkey, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (
          SELECT n_name AS name, population, 0 AS rank FROM c WHERE {_COMMON} UNION ALL SELECT n_name, count(*), 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
          UNION ALL SELECT r_name, max(population), 2 FROM c JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
        m AS (SELECT name, population FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, population DESC) = 1), al AS (SELECT {_CALLED} AS name, n_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT name, population FROM m UNION ALL SELECT al.name, max(m.population) FROM al JOIN m ON m.name = al.canonical WHERE al.name NOT IN (SELECT name FROM m) GROUP BY 1""",
    ),
    "party_clusters": (_clusters, f"WITH {_CLUSTERED} SELECT id, component FROM ap"),
    "party_registry": (
        _party_registry,
        f"""WITH {_CLUSTERED}, m AS (SELECT *, rtrim(upper(regexp_replace(name, '\\s+', ' ', 'g')), '.') AS nn FROM ap), known AS (SELECT DISTINCT nn, 'G' || lpad(CAST(b * 3 + CASE WHEN p = 3 THEN 1 ELSE 2 END AS VARCHAR), 5, '0') AS gid FROM m WHERE (p = 3 AND b % 4 = 0) OR (p IN (44, 53) AND b % 8 = 1)),
        cn AS (SELECT component, name, count(*) AS k, bool_or(is_company) AS company, min(id) AS seen FROM m GROUP BY 1, 2), shown AS (SELECT component, name AS display_name FROM cn QUALIFY row_number() OVER (PARTITION BY component ORDER BY company DESC, k DESC, seen) = 1),
        asked AS (SELECT component, arg_min(gid, m.nn) AS gid FROM m JOIN known ON m.nn = known.nn GROUP BY 1), kept AS (SELECT gid, min(component) AS component FROM asked GROUP BY 1),
        g AS (SELECT component, string_agg(DISTINCT nn, ',' ORDER BY nn) AS names, count(*) AS appearances FROM m GROUP BY 1), top AS (SELECT coalesce(max(CAST(substr(gid, 2) AS BIGINT)), 0) AS t FROM known)
        SELECT g.component, coalesce(kept.gid, printf('G%05d', top.t + row_number() OVER (PARTITION BY kept.gid IS NULL ORDER BY g.component))) AS gid, display_name, names, appearances FROM g JOIN shown USING (component) CROSS JOIN top LEFT JOIN kept USING (component)""",
    ),
    "alternate_clusters": (lambda s, d: P.clustered(leaning_appearances(s, d)), None),
    "auto_confirm": (
        _confirmed,
        f"""WITH RECURSIVE {TX_SQL}, r AS (SELECT {_GID} AS gid, upper(seller) AS name, trim({_SAID_PHONE}) AS phone, upper(trim({_SAID_CONTACT})) AS contact, upper({_SAID_ALIAS}) AS alias, upper(trim({_POST})) AS shown FROM tx),
        nm AS MATERIALIZED (SELECT gid, name, max(CASE WHEN shown <> '' AND (contains(shown, alias) OR contains(alias, shown)) THEN 1 ELSE 0 END) AS branded FROM r GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT DISTINCT a.gid, a.name AS x, b.name AS y FROM r a JOIN r b ON a.gid = b.gid AND ((a.phone <> '' AND a.phone = b.phone) OR (a.contact <> '' AND a.contact = b.contact))
          UNION SELECT a.gid, a.name, b.name FROM nm a JOIN nm b ON a.gid = b.gid WHERE a.branded = 1 AND b.branded = 1),
        w AS (SELECT gid, name, name AS m FROM nm UNION SELECT e.gid, e.y, w.m FROM w JOIN e ON w.gid = e.gid AND w.name = e.x),
        c AS (SELECT gid, name, min(m) AS cluster FROM w GROUP BY 1, 2), z AS (SELECT gid, cluster, count(*) AS n, max(branded) AS branded FROM c JOIN nm USING (gid, name) GROUP BY 1, 2),
        g AS (SELECT gid, count(*) AS names, max(branded) AS branded FROM nm GROUP BY 1),
        p AS (SELECT z.gid, z.cluster FROM z JOIN g USING (gid) WHERE g.names > 1 AND (z.branded = 1 OR (g.branded = 0 AND z.n > 1)) QUALIFY row_number() OVER (PARTITION BY z.gid ORDER BY z.branded DESC, z.n DESC, z.cluster) = 1)
        SELECT gid, name FROM nm JOIN g USING (gid) WHERE names = 1 AND name NOT LIKE '%3' UNION ALL SELECT gid, name FROM c JOIN p USING (gid, cluster) WHERE name NOT LIKE '%3'""",
    ),
    "store_matches": (lambda s, d: L.street_match(*store_input(s, d)), None),
    "override_replay": (lambda s, d: L.replayed(members(s, d), *DECISIONS), None),
}
