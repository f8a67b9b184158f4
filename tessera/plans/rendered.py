"""Record pages, assessment pages and JSON records of every order, rendered in SQL that Spark and DuckDB both read,
and the queries that parse, check and compare them. As all forms are functions of an order's columns, the SQL of
a query says what has to come out without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.operators import record_pages as P
from tessera.plans.transactions import TX_SQL, transactions


def pick(key: str, values: list[str]) -> str:
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def text(e: str) -> str:
    return f"CAST({e} AS STRING)"


def digits(e: str, n: int, fill: str = "0") -> str:
    return f"lpad({text(e)}, {n}, '{fill}')"


def cut(e: str, by: int) -> str:
    """Integer division."""
    return f"CAST((({e}) - ({e}) % {by}) / {by} AS BIGINT)"


def money(e: str) -> str:
    """With commas, up to billions."""
    low = digits(f"({e}) % 1000", 3)
    return f"CASE WHEN {e} < 1000 THEN {text(e)} WHEN {e} < 1000000 THEN {text(cut(e, 1000))} || ',' || {low} ELSE {text(cut(e, 1000000))} || ',' || {digits(f'{cut(e, 1000)} % 1000', 3)} || ',' || {low} END"


def when(condition: str, then: str, other: str = "''") -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {other} END"


def joined(*parts: tuple[str, str]) -> str:
    """The texts whose condition holds, with a bar between them."""
    return "substr(" + " || ".join(when(c, f"'|' || {t}") for c, t in parts) + ", 2)"


K, N, DOLLARS = "rt_id", "(1 + rt_id % 900)", "CAST(floor(price) AS BIGINT)"
MONTHS = "CASE substr(iso, 6, 2) " + " ".join(f"WHEN '{k:02d}' THEN '{m}'" for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)) + " END"
STREETS = ["King St", "Queen St W", "Main St N", "Oak Cres", "Elm Rd", "Harbour Blvd", "Clair Ave E", "Commerce Park Dr", "Bloor St", "Anne Lane"]
STREET, FIRST_WORD = pick("prop_key", STREETS), pick("prop_key", [s.split()[0] for s in STREETS])
RANGE, SIDE, SUITE = "rt_id % 5 = 0", "rt_id % 3 = 0", "rt_id % 4 = 1"
ADDRESS = when(RANGE, f"{text(N)} || '-' || {text(f'{N} + 2')}", text(N)) + f" || ' ' || {STREET}"
SIDE_ADDRESS, SUITE_LINE = f"{text(f'{N} + 40')} || ' Side Rd'", f"'Unit ' || {text('1 + rt_id % 60')}"
DAY = f"substr(iso, 9, 2) || ' ' || {MONTHS} || ' ' || substr(iso, 1, 4)"
PRICE = f"'$' || {money(DOLLARS)}"
SELLER = "seller || " + when("rt_id % 2 = 0", "' Holdings Inc'", "' Services Ltd'")
PHONED, PHONE = "rt_id % 3 < 2", f"'(416) 555-' || {digits('rt_id % 10000', 4)}"
FORMER, FORMER_NAME = "rt_id % 4 = 0", "'Old ' || seller || ' Ltd'"
ATTENDED, ATTN = "rt_id % 3 = 0", "'Ann ' || " + pick("rt_id", ["Ng", "Lee", "Roy"])
CARED, CARE = "rt_id % 5 = 1", "'Care ' || brand || ' Realty Inc'"
MAIL, TOWN, CODE = f"{text('10 + rt_id % 90')} || ' Bay St'", "'Toronto, Ontario'", f"'M5V ' || {text('rt_id % 10')} || 'T' || {text('prop_key % 10')}"
BUYER_MAIL, LAWYER = f"{text('100 + rt_id % 800')} || ' Pine Ave'", "rt_id % 4 = 2"
LEGAL = f"'Plan ' || {text('rt_id % 500')} || ' Part Lot ' || {text('prop_key % 40')}"
PIN, ROLL = digits("rt_id % 1000000000", 9, "1"), digits("rt_id", 12, "7")
AREA, FRONT, DEPTH, WIDE = f"{text('1 + rt_id % 40')} || '.5'", text("20 + rt_id % 80"), text("90 + rt_id % 70"), "rt_id % 3 = 1"
CASH, DEBT, LOAN = cut(DOLLARS, 4), cut(DOLLARS, 2), "rt_id % 2 = 0"
BANK, CHATTELS = "'Bank of ' || " + pick("rt_id", ["Alpha", "Beta", "Gamma"]), "rt_id % 7 = 0"
PAID = when(LOAN, f"'cash: $' || {money(CASH)} || ' assumed debt: $' || {money(DEBT)} || ' chargee: ' || {BANK} || ' and others'") + " || " + when(CHATTELS, when(LOAN, "' '") + " || 'chattels: $1,500'")
FEET = "(1200 + rt_id % 90000)"
TOLD = f"{money(FEET)} || ' sf office, status ' || status || ', zoned C' || {text('rt_id % 9')}"
BROKERED, BROKER, BROKER_PHONE = "rt_id % 3 = 1", f"'Homes ' || {text('rt_id % 50')} || ' Realty'", f"'(905) 555-' || {digits('prop_key % 10000', 4)}"
GALLERY, RT = "rt_id % 4 = 3", f"'RT' || {digits('rt_id % 1000000', 6)}"


def caption(name: str) -> str:
    return f"""'<p/><font color="#848484">{name}</font><br/>'"""


def page(flaw: dict[int, str] | None = None) -> str:
    """An order's page. With ``flaw``, orders of each of its remainders by 17 lack a part or have a wrong one."""

    def part(e: str, *gone: int, instead: str = "''") -> str:
        return e if flaw is None or not gone else when(f"rt_id % 17 IN ({', '.join(map(str, gone))})", instead, e)

    line = lambda condition, e: when(condition, f"{e} || '<br/>'")
    strong = f"""'<strong id="address">' || {part(ADDRESS, 2, instead="' '")} || {when(SUITE, f"'<br/>' || {SUITE_LINE}")} || {when(SIDE, f"'<br/>' || {SIDE_ADDRESS}")} || '</strong>'"""
    strong = strong if flaw is None else when("rt_id % 17 = 3", f"""'<strong id="address">' || {STREET} || '</strong>'""", when("rt_id % 17 = 2", """'<strong id="address"> </strong>'""", strong))
    seller = f"{SELLER} || {when(PHONED, f"'&nbsp;&nbsp;' || {PHONE}")} || {when(FORMER, f"'<br/><em>' || {FORMER_NAME} || '</em>'")} || '<p/>' || {line(ATTENDED, f"'attn: ' || {ATTN}")} || {line(CARED, f"'c/o ' || {CARE}")} || {MAIL} || '<br/>' || {TOWN} || '<br/>' || {CODE}"
    buyer = f"buyer || '<p/>' || {BUYER_MAIL} || '<br/>' || {when(LAWYER, "'Lee Ho<br/>Barrister<br/>'")} || {TOWN} || '<br/>' || {CODE}"
    site = f"{LEGAL} || '<p/>PIN: ' || {PIN} || '<p/>' || {AREA} || ' acres' || {when(WIDE, f"' ' || {FRONT} || ' ft frontage depth of ' || {DEPTH} || ' feet'")}"
    roll = " || ' ' || ".join(f"substr({ROLL}, {a}, 4)" for a in (1, 5, 9))
    sections = [
        ("Transferor(s)", seller, 8), ("Transferee(s)", buyer, 9), ("Site", site, 10), ("Assessment Roll Number", roll, 11), ("Consideration", PAID), ("Description", TOLD, 12),
        ("Broker/Agent", when(BROKERED, f"{BROKER} || ' ' || {BROKER_PHONE} || ' <a href=\"#\">more</a>'"), 13), ("Street photos", "''", 14),
    ]
    pictures = """'<div id="mygallery"><img src="https://cdn.example/photos/' || """ + RT + """ || '-1.jpg"><img src="https://cdn.example/photos/' || """ + RT + """ || '-2.jpg"></div>'"""
    return " || ".join(
        [
            """'<html><body><!-- <strong id="address">none</strong> -->'""", when(GALLERY, pictures), part(strong, 1), part("'<br/>' || city || ' : ' || municipality", 4),
            "'<br/>' || " + part(DAY, 6) + " || ' ' || " + part(PRICE, 5) + " || '<p/>'", *(part(f"{caption(n)} || {e}", *k) for n, e, *k in sections),
            f"""'<p><font color="#848484">1 / 9 ' || {part(RT, 7)} || '</font></body></html>'""",
        ]
    )


FLAWS = {1: "H001", 2: "H002", 3: "H003", 4: "H006", 5: "H007", 6: "H008", 7: "H009", 8: "H004", 9: "H005", 10: "H010", 11: "H011", 12: "H012", 13: "H013", 14: "H014"}

#: Column of record_pages: where it stands in the record, and what it has to be.
_MAILED = f"{MAIL} || ', ' || {TOWN} || ', ' || {CODE}"
FIELDS = {
    "address": ("transaction.address.address", ADDRESS),
    "suite": ("transaction.address.address_suite", when(SUITE, SUITE_LINE)),
    "city": ("transaction.address.city", "city"),
    "municipality": ("transaction.address.municipality", "municipality"),
    "alternates": ("transaction.address.alternate_addresses", joined(*((RANGE, f"{text(f'{N} + {k}')} || ' ' || {FIRST_WORD}") for k in range(3)), (SIDE, SIDE_ADDRESS))),
    "sale_date": ("transaction.sale_date", DAY),
    "sale_date_iso": ("transaction.sale_date_iso", "iso"),
    "sale_price": ("transaction.sale_price", PRICE),
    "rt_number": ("transaction.rt_number", RT),
    "arn": ("transaction.arn", ROLL),
    "pins": ("transaction.pins", PIN),
    "seller": ("transferor.name", SELLER),
    "seller_contact": ("transferor.contact", when(ATTENDED, ATTN, when(CARED, CARE))),
    "seller_phone": ("transferor.phone", when(PHONED, PHONE)),
    "seller_phones": ("transferor.phones", when(PHONED, PHONE)),
    "seller_address": ("transferor.address", _MAILED),
    "seller_names": ("transferor.alternate_names", joined((FORMER, FORMER_NAME), (CARED, CARE))),
    "seller_companies": ("transferor.company_lines", f"{SELLER} || {when(FORMER, f"'|' || {FORMER_NAME}")} || {when(CARED, f"'|' || {CARE}")}"),
    "seller_contacts": ("transferor.contact_lines", when(ATTENDED, ATTN)),
    "seller_lines": ("transferor.address_lines", f"{MAIL} || '|' || {TOWN} || '|' || {CODE}"),
    "seller_aliases": ("transferor.aliases", f"upper(seller) || {when(FORMER, "'|OLD ' || upper(seller)")} || {when(CARED, "'|CARE ' || upper(brand)")}"),
    "buyer": ("transferee.name", "buyer"),
    "buyer_companies": ("transferee.company_lines", f"buyer || {when(LAWYER, "'|Lee Ho Barrister'")}"),
    "buyer_lines": ("transferee.address_lines", f"{BUYER_MAIL} || '|' || {TOWN} || '|' || {CODE}"),
    "buyer_address": ("transferee.address", f"{BUYER_MAIL} || ', ' || {when(LAWYER, "'Lee Ho, Barrister, '")} || {TOWN} || ', ' || {CODE}"),
    "legal": ("site.legal_description", LEGAL),
    "area": ("site.site_area", AREA),
    "frontage": ("site.site_frontage", when(WIDE, FRONT)),
    "depth": ("site.site_depth", when(WIDE, DEPTH)),
    "zoning": ("site.zoning", f"'C' || {text('rt_id % 9')}"),
    "site_pins": ("site.pins", PIN),
    "consideration": ("consideration.verbatim", PAID),
    "cash": ("consideration.cash", when(LOAN, text(CASH))),
    "debt": ("consideration.assumed_debt", when(LOAN, text(DEBT))),
    "chattels": ("consideration.chattels", when(CHATTELS, "'1500'")),
    "chargees": ("consideration.chargees", when(LOAN, BANK)),
    "brokerage": ("broker.brokerage", when(BROKERED, BROKER)),
    "broker_phone": ("broker.phone", when(BROKERED, BROKER_PHONE)),
    "description": ("description", TOLD),
    "building_sf": ("export_extras.building_sf", text(FEET)),
    "photos": ("photos", when(GALLERY, " || '|' || ".join(f"'https://cdn.example/photos/' || {RT} || '-{k}.jpg'" for k in (1, 2)))),
}


def _rendered(s, d: str, e: str, name: str) -> DataFrame:
    return transactions(s, d).select("rt_id", F.expr(e).alias(name))


def _flat(record: DataFrame, fields: dict[str, tuple[str, str]], *more: Column) -> DataFrame:
    kinds = {f.name: f for f in record.schema.fields}

    def column(path: str):
        value, kind = F.col("record"), kinds["record"].dataType
        for p in path.split("."):
            value, kind = value.getField(p), kind[p].dataType
        return F.array_join(value, "|") if kind.typeName() == "array" else value

    return record.select("rt_id", *[column(path).alias(c) for c, (path, _) in fields.items()], *more)


def _wanted(fields: dict[str, tuple[str, str]]) -> str:
    return f"WITH {TX_SQL} SELECT rt_id, {', '.join(f'{e} AS {c}' for c, (_, e) in fields.items())} FROM tx"


# assessment pages

SUFFIX = digits("rt_id", 12, "3")
SALES = [("iso", PRICE, "'Transfer'", "buyer"), ("substr(iso, 1, 4) || '-01-01'", "'$1'", "'Charge'", "seller")]


def _cell(e: str, name: str) -> str:
    return f"""'<span class="v" id="{name}">' || {e} || '</span>'"""


def _suffixed(e: str, name: str) -> str:
    return f"""'<div id="{name}' || {SUFFIX} || '"> ' || {e} || ' </div>'"""


def _sale(date: str, amount: str, kind: str, to: str) -> str:
    cell = lambda name, e: f"""'<td id="vs-tbl-data-{name}-' || {date} || '">' || {e} || '</td>'"""
    return f"""'<tr id="vs-tbl-row-' || {date} || '">' || {cell("sd", date)} || {cell("sa", amount)} || {cell("type", kind)} || {cell("pt", to)} || '</tr>'"""


DETAIL = " || ".join(
    [
        """'<html><body><div id="pr-expansion-panel-registry">x</div>'""", _cell(ADDRESS, "sum-h1-address"), _cell("buyer", "sum-owner-names"), _cell(PRICE, "sum-lastsale-value"), _cell(LEGAL, "sum-legal-desc"), _cell(PIN, "reg-pin"), _cell("'Freehold &amp; other'", "reg-ot"),
        when("rt_id % 5 <> 2", " || ".join([_suffixed(f"'ARN : ' || {ROLL}", "ss-an-arn-"), _suffixed(FRONT, "ss-site-frontage-"), _suffixed(f"'C' || {text('rt_id % 9')}", "ss-site-sa-"), _suffixed("city", "ss-msap-muni-")])),
        """'<table><tr id="vs-tbl-row-hdr"><td>Date</td></tr>'""", _sale(*SALES[0]), when("rt_id % 2 = 0", _sale(*SALES[1])), "'</table></body></html>'",
    ]
)
_DETAILED = "rt_id % 6 <> 5"
ASSESSED = when(_DETAILED, DETAIL, "'<html><body>results of a search</body></html>'")
_SHOWN = [f"{d} || ' ' || {a} || ' ' || {k} || ' ' || {t}" for d, a, k, t in SALES]
ASSESSMENT_FIELDS = {
    "address": ("summary.address", ADDRESS),
    "owner": ("summary.owner_names", "buyer"),
    "last_price": ("summary.last_sale_price", PRICE),
    "pin": ("pin", PIN),
    "tenure": ("registry.ownership_type", "'Freehold & other'"),
    "arn": ("site_structure.arn", when("rt_id % 5 <> 2", ROLL)),
    "frontage": ("site_structure.frontage", when("rt_id % 5 <> 2", FRONT)),
    "zoning": ("site_structure.zoning", when("rt_id % 5 <> 2", f"'C' || {text('rt_id % 9')}")),
    "municipality": ("site_structure.municipality", when("rt_id % 5 <> 2", "city")),
}


def _assessments(s, d) -> DataFrame:
    rows = P.assessment_pages(_rendered(s, d, ASSESSED, "page")).filter("record is not null")
    sales = F.array_join(F.transform("record.sales_history", lambda x: F.concat_ws(" ", x["sale_date"], x["sale_amount"], x["type"], x["party_to"])), "|")
    return _flat(rows, ASSESSMENT_FIELDS, sales.alias("sales"))


# JSON records

_GONE = {"P001": 1, "P002": 2, "P003": 3, "P004": 4, "P005": 5, "P006": 6, "P007": 7, "P008": 8, "P009": 9, "P010": 10}


def json_record(changed: bool = False, flawed: bool = False) -> str:
    """An order as JSON. ``changed``: as it is in a later snapshot; ``flawed``: remainders by 13 lack a value or nest one."""

    def value(e: str, *, gone: int = -1, nested: int = -1, later: str | None = None) -> str:
        out = f"""'"' || {e} || '"'"""
        out = when(f"rt_id % 13 = {gone}", "'\"\"'", out) if flawed and gone >= 0 else out
        out = when(f"rt_id % 13 = {nested}", """'{"a": "b"}'""", out) if flawed and nested >= 0 else out
        return later.format(out) if changed and later else out

    pins = f"""'["' || {PIN} || '", "2"]'"""
    pins = when("rt_id % 7 = 2", f"""'["2", "' || {PIN} || '"]'""", pins) if changed else pins
    name = f"""'"name": ' || {value("buyer", gone=5)} || ', '"""
    return " || ".join(
        [
            """'{"transaction": {"address": {"address": '""", value(ADDRESS, gone=1), """', "city": '""", value("city", gone=6), """'}, "sale_price": '""", value(PRICE, gone=2, later="CASE WHEN rt_id % 7 = 1 THEN '\"$1\"' ELSE {} END"),
            """', "sale_date": '""", value(DAY, gone=3), """'}, "transferor": {"name": '""", value(SELLER, gone=4), """', "phone": '""", value(PHONE, nested=7, later="CASE WHEN rt_id % 7 = 4 THEN '{{\"a\": 1}}' ELSE {} END"),
            """', "address": '""", value(MAIL, nested=9), """'}, "transferee": {'""", when("rt_id % 7 = 3", "''", name) if changed else name, """'"phone": '""", value(PHONE, nested=8), """', "address": '""", value(BUYER_MAIL, nested=10),
            """'}, "facts": {"pins": '""", pins, """'}, "skip": false, "stamp": '""", value("iso", later="CASE WHEN rt_id % 7 = 5 THEN '\"later\"' ELSE {} END"), "'}'",
        ]
    )


def _diff(s, d) -> DataFrame:
    tx = transactions(s, d)
    old, new = tx.filter("rt_id % 11 <> 0").select("rt_id", F.expr(json_record()).alias("record")), tx.filter("rt_id % 11 <> 1").select("rt_id", F.expr(json_record(changed=True)).alias("record"))
    return C.nested_diff(old, new, "rt_id", "record", ["stamp"]).groupBy("status", "field").agg(F.count("*").alias("n"))


#: name: (query, SQL)
ALL = {
    "record_pages": (lambda s, d: _flat(P.record_pages(_rendered(s, d, page(), "page")), FIELDS), _wanted(FIELDS)),
    "assessment_pages": (_assessments, _wanted(ASSESSMENT_FIELDS)[: -len(" FROM tx")] + f", {_SHOWN[0]} || {when('rt_id % 2 = 0', f"'|' || {_SHOWN[1]}")} AS sales FROM tx WHERE {_DETAILED}"),
    "html_checks": (
        lambda s, d: _rendered(s, d, page(FLAWS), "page").select("rt_id", F.array_join(C.html_flags(F.col("page")), ",").alias("flags")),
        f"WITH {TX_SQL} SELECT rt_id, CASE rt_id % 17 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in FLAWS.items())} ELSE '' END AS flags FROM tx",
    ),
    "record_checks": (
        lambda s, d: C.flag_counts(_rendered(s, d, json_record(flawed=True), "record"), C.record_flags(F.col("record"))),
        f"WITH {TX_SQL} SELECT CASE rt_id % 13 {' '.join(f"WHEN {k} THEN '{v}'" for v, k in _GONE.items())} ELSE 'clean' END AS flag, count(*) AS n FROM tx GROUP BY 1",
    ),
    "nested_diff": (
        _diff,
        f"""WITH {TX_SQL}, f(kind, field) AS (VALUES (1, 'transaction.sale_price'), (2, 'facts.pins'), (3, 'transferee.name'), (4, 'transferor.phone'), (4, 'transferor.phone.a')),
        r AS (SELECT CASE WHEN rt_id % 11 = 0 THEN 'new' WHEN rt_id % 11 = 1 THEN 'removed' WHEN rt_id % 7 BETWEEN 1 AND 4 THEN 'changed' ELSE 'unchanged' END AS status, rt_id % 7 AS kind FROM tx)
        SELECT status, field, count(*) AS n FROM r LEFT JOIN f ON status = 'changed' AND r.kind = f.kind GROUP BY 1, 2""",
    ),
}
