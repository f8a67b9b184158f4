"""Record pages of transactions, and assessment pages, as nested records.

A page is cut at its grey captions into a head and named sections, a section at its line breaks
into lines and paragraphs. What a line of a party's section is depends on the lines before it in one
way alone: once a line has begun the address, plain lines go on with it. So every line gets a kind
by itself, the first line that begins the address is looked up, and plain lines before it are
contacts, those behind it address. Each step goes over its piece once, so the time is linear in the page.

Pages are independent of each other: one Arrow stage, no shuffle. ``record_pages`` and
``assessment_pages`` put the record beside the other columns.

Defined results: a null or empty page, or one without the caption asked for, gives empty texts and
lists; comments are no text, one that is not closed reaches to the end of the page; of several
sections with one caption the first counts; a page that is not an assessment gives null.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

# Captions, words that tell a company, an address or an officer, and prefixes of contact lines.
SELLER, BUYER = "Transferor(s)", "Transferee(s)"
COMPANY = [
    "INC", "LIMITED", "LTD", "LLC", "LP", "LLP", "ULC", "CORP", "CORPORATION", "COMPANY", "HOLDINGS", "HOLDING", "TRUST", "FUND", "PROPERTIES", "PROPERTY", "REALTY", "REIT", "PARTNERS", "PARTNERSHIP", "ENTERPRISES", "GROUP",
    "INVESTMENTS", "INVESTMENT", "CAPITAL", "CONTRACTOR", "CONTRACTORS", "MANAGEMENT", "DEVELOPMENT", "DEVELOPMENTS", "SERVICES", "COLLEGE", "SCHOOL", "ASSOCIATION", "CO",
]
CONTACT_PREFIXES = ["attn:", "attention:", "pres:", "president:", "pres.:", "aso:", "asst:", "assistant:", "aso.:", "dir:", "vp:", "vice president:", "officer:", "asst vp:", "assistant vp:", "ceo:", "cfo:", "coo:", "director:", "chair:", "chairman:"]
UNIT_WORDS = ["suite", "suites", "ste", "unit", "units", "lvl", "level", "floor", "flr", "university", "building", "tower", "apt", "apartment"]
PLACE_WORDS = ["building", "tower", "mall", "plaza", "block", "complex", "square", "terminal"]
PROVINCES = ["ontario", "quebec", "alberta", "british columbia", "manitoba", "saskatchewan", "nova scotia", "new brunswick", "newfoundland", "prince edward island", "nunavut", "yukon", "northwest territories"]
LEGAL_WORDS = ["barrister", "barristers", "solicitor", "solicitors", "law office", "law offices", "trust", "in trust", "llp", "llc", "ulc"]
SUITE_WORDS = ["unit", "units", "suite", "suites", "ste", "apt", "apts", "apartment", "apartments", "floor", "floors", "flr", "level", "levels", "lvl", "room", "rooms", "rm"]
OFFICERS = ["president", "ceo", "vice president", "vp", "secretary", "treasurer", "director", "partner", "owner", "manager", "aso", "signing officer", "trustee", "executor", "executrix"]

_COMPANY, _PROVINCES = set(COMPANY), "|".join(PROVINCES)
_TITLES = re.compile(r"(?i)(?:pres|president|vp|vice president|dir|director|aso|sec|secretary|treas|treasurer|mgr|manager|partner|trustee|executor|executrix): ")
_CAPTION = re.compile(r"(?i)<font [^<>]*#848484[^<>]*>")
_BREAK = re.compile(r"(?i)<(?:br|em|/em|/?div|/?tr|/?li)(?:[ /][^<>]*)?>")
_PARAGRAPH = re.compile(r"(?i)</?p(?:[ /][^<>]*)?>")
_ITALIC = re.compile(r"(?i)<em(?: [^<>]*)?>")
_PHONE = re.compile(r"(?:1-)?(?:\d{3}-|\(\d{3}\) ?)\d{3}-\d{4}")
_PHONE_BEHIND = re.compile(r"\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}$")
_POSTAL = re.compile(r"[A-Z]\d[A-Z] *\d[A-Z]\d", re.I)
_CARE = re.compile(r"(?i)c[/0\\] ?o\b *[:-]? *|c\. ?o\. *|care of\b *[:-]? *")
#: Longest range of street numbers that is written out.
LONGEST = 1000


def _words(text: str) -> str:
    return f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "


def _has_word(text: str, words: list[str]) -> bool:
    padded = _words(text)
    return any(f" {w} " in padded for w in words)


def _begins(text: str, starts: list[str]) -> bool:
    return text.lower().startswith(tuple(starts))


def without_comments(page: str) -> str:
    first, *rest = page.split("<!--")
    return first + "".join(x.partition("-->")[2] for x in rest)


def _text(piece: str) -> str:
    """A line as it is read, without mark-up; fixed spaces stay."""
    return html.unescape(re.sub("<[^<>]*>", "", piece)).strip(" \t\r\n")


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def paragraphs(body: str) -> list[list[tuple[str, bool]]]:
    """The lines of each paragraph, and whether they are in italics."""
    out = []
    for part in _PARAGRAPH.split(body):
        pieces, at, italic, held = [], 0, False, []
        for m in _BREAK.finditer(part):
            held.append((part[at : m.start()], italic))
            at, italic = m.end(), bool(_ITALIC.match(m[0]))
        pieces = [(_text(x), i) for x, i in [*held, (part[at:], italic)]]
        if lines := [(x, i) for x, i in pieces if x.strip()]:
            out.append(lines)
    return out


def lines(body: str) -> list[str]:
    return [_squeezed(x) for part in paragraphs(body) for x, _ in part]


class Sections:
    """The head of a page, and what stands under its captions."""

    def __init__(self, page: str):
        self.head, *rest = _CAPTION.split(page)
        cut = [re.split("(?i)</font>", x, maxsplit=1) for x in rest]
        self.named = [(_squeezed(_text(x[0])), x[1] if len(x) > 1 else "") for x in cut]

    def body(self, caption: str, part: bool = False) -> str:
        return next((b for n, b in self.named if n == caption or part and caption in n), "")

    def has(self, caption: str) -> bool:
        return any(n == caption for n, _ in self.named)


def company_like(line: str) -> bool:
    """A company's word, or a firm as in "Able & Baker" (one word behind the last &, no initials)."""
    if _COMPANY.intersection(re.findall("[A-Z0-9]+", line.upper())):
        return True
    before, amp, _ = line.partition("&")
    behind = line.rpartition("&")[2].strip()
    return bool(amp and before.strip() and behind[:1].isalpha() and "." not in before + behind and " " not in behind)


def address_like(line: str) -> bool:
    if company_like(line):
        return False
    low, parts = line.lower(), [x.strip() for x in line.split(",")]
    if line[:1].isdigit() or _POSTAL.search(line) or _begins(line, ["po box", "p.o box", "box ", *(w + end for w in UNIT_WORDS for end in " .")]):
        return True
    if any(f" {w}" in low for w in PLACE_WORDS) or (" " in line and _has_word(line, PROVINCES)):
        return True
    if len(parts) == 2 and all(re.fullmatch(r"[A-Za-z0-9 .'-]+", x) for x in parts) and not re.search(r"\d", parts[1]):
        return True
    return len(parts) > 1 and any(re.search(r"\d", x) or x.lower() in PROVINCES for x in parts)


def after_prefix(line: str) -> str | None:
    """What stands behind the prefix of a contact line; None for others."""
    known = max((p for p in CONTACT_PREFIXES if line.lower().startswith(p)), key=len, default=None)
    return None if known is None else line[len(known) :].strip()


def care_of(line: str) -> str | None:
    m = _CARE.match(line)
    return line[m.end() :].strip() if m else None


def _rank(line: str) -> int:
    """Where a line stands in an address: named buildings, then numbers and boxes, then units, then towns."""
    if line[:1].isdigit() or _begins(line, ["po box", "p.o box"]):
        return 0
    if _begins(line, [w + end for w in UNIT_WORDS for end in " ."]):
        return 1
    return -1 if re.search("(?i)building|tower", line) else 2


def _kind(line: str, italic: bool) -> tuple[str, str, bool]:
    """A line of a party, its kind, and whether it begins the address."""
    contact, care = after_prefix(line), care_of(line)
    if contact:
        return contact, "contact", True
    said = line if care is None else care
    address = address_like(said)
    if _has_word(line, LEGAL_WORDS) or ("&" in said and not address):
        return said, "legal", care is not None
    if italic:  # an address in italics needs a number, or an address that has begun
        return said, ("address" if said[:1].isdigit() else "later") if address else "company", care is not None or address and said[:1].isdigit()
    if company_like(said):
        return said, "company", care is not None
    return said, "address" if address else "plain" if care is None else "contact", address or care is not None


def party_lines(said: list[tuple[str, bool]]) -> dict[str, list[str]]:
    """The lines of a party behind its name by what they are."""
    kinds = [_kind(line, italic) for text, italic in said if (line := _PHONE_BEHIND.sub("", _squeezed(text)).strip())]
    begun = next((k for k, (_, _, opens) in enumerate(kinds) if opens), len(kinds))
    held: list[tuple[str, str]] = []
    for k, (line, kind, _) in enumerate(kinds):
        if kind in ("plain", "later"):
            kind = "address" if k > begun else "contact" if kind == "plain" else "company"
        if kind == "legal":  # a legal descriptor takes the plain line before it, if that went to the address
            if held and held[-1][1] == "address" and not re.search("[,0-9]", held[-1][0]):
                line = f"{held.pop()[0]} {line}"
            kind = "company"
        held.append((line, kind))
    of = lambda kind: [x for x, k in held if k == kind]
    return {"company": of("company"), "contact": of("contact"), "address": sorted(of("address"), key=_rank)}


def _mail_address(parts: list[list[str]]) -> tuple[str, str]:
    """The lines of a paragraph up to its postal code, without the names in front; and a company that was care of."""
    is_code = re.compile(r"[A-Z]\d[A-Z] *\d[A-Z]\d").fullmatch
    held = next((p[: k + 1] for p in parts for k, x in enumerate(p) if is_code(x)), [])
    start = next((k for k, x in enumerate(held) if re.search(r"\d", x) or _begins(x, ["po box", "p.o", "c/o"])), 0)
    held = held[start:]
    care = care_of(held[0]) if held else None
    if care is None or care[:1].isdigit():
        return ", ".join(held if care is None else [care, *held[1:]]), ""
    behind = next((k for k, x in enumerate(held) if k and (x[:1].isdigit() or _begins(x, ["po box", "p.o", "box ", *(f"{w} " for w in UNIT_WORDS)]))), len(held))
    entity = ", ".join([care, *held[1:behind]])
    return ", ".join(held[behind:]), entity if company_like(entity) else ""


def party(body: str) -> dict:
    parts = paragraphs(body)
    said = [x for p in parts for x in p]
    stop = next((k for k, (x, _) in enumerate(said) if "more info:" in x.lower()), len(said))
    first = said[0][0] if said else ""
    squeezed = [_squeezed(x) for x, _ in said]
    name = _squeezed(first.split("\xa0")[0])
    own = _PHONE.search(first.rpartition("\xa0\xa0")[2]) if "\xa0\xa0" in first else None
    phone = own or next((m for x in squeezed if (m := _PHONE.search(x))), None)
    names = [_squeezed(x.split("\xa0")[0]) for x, _ in parts[0][1:7]] if parts else []
    names = [x for x in names if x and not _TITLES.match(x)]
    kinds = party_lines(said[1:stop])
    company = [x for x in [_PHONE_BEHIND.sub("", _squeezed(first)).strip()] if x] + kinds["company"]
    address, entity = _mail_address([[_squeezed(x) for x, _ in p] for p in parts])
    names += [entity] if entity and entity not in names else []
    marked = [x for line in squeezed for x in (after_prefix(line) or care_of(line),) if x]
    contact = next((x for line in squeezed if _begins(line, ["attn:", "c/o"]) for x in (after_prefix(line) or care_of(line),) if x), "")
    attention = marked[0] if marked else ""
    if attention and (not contact or company_like(contact) or address_like(contact)):
        contact = attention
    aliases = list(dict.fromkeys(_alias(x) for x in company[:5]))
    text = " ".join(squeezed)
    return {
        "name": name, "contact": contact, "phone": phone[0] if phone else "", "address": address or ", ".join(kinds["address"]), "alternate_names": names, "company_lines": company, "contact_lines": kinds["contact"],
        "address_lines": kinds["address"], "phones": sorted(set(_PHONE.findall("\n".join(squeezed)))), "officer_titles": sorted(t for t in OFFICERS if _has_word(text, [t])), "aliases": [x for x in aliases if x][:10], "attention": attention,
    }


def _alias(company: str) -> str:
    """A company's name in upper case without its company words."""
    return " ".join(w for w in company.upper().split() if w.strip(".,") not in _COMPANY)


def ranges_written_out(address: str) -> list[str]:
    """Every number from 12 to 16 of "12-16 King St" with the street's first word; other addresses as they are."""
    m = re.search(r"(\d{1,9})[-–](\d{1,9})\s+([A-Za-z]+)", address)
    if not m or int(m[2]) - int(m[1]) > LONGEST:
        return [address]
    return [f"{n} {m[3]}" for n in range(int(m[1]), int(m[2]) + 1)]


def sale_date(text: str) -> tuple[str, str]:
    """A printed date as shown (05 Jan 2024) and in ISO; empty if it is none."""
    for said, form in [(text, f) for f in ("%d %b %Y", "%d %B %Y", "%Y-%m-%d", "%m/%d/%Y")] + [(re.sub(r"(\d)(?:st|nd|rd|th)", r"\1", text), "%d %b %Y")]:
        try:
            return datetime.strptime(said.strip(), form).strftime("%d %b %Y"), datetime.strptime(said.strip(), form).strftime("%Y-%m-%d")
        except ValueError:
            continue
    return "", ""


def header(page: str, cut: Sections) -> dict:
    tag = re.search(r"(?i)<strong [^<>]*\bid *= *[\"']?address[\"']?[^<>]*>", cut.head)
    block, _, behind = (cut.head[tag.end() :] if tag else "").partition("</strong>")
    said, after = lines(block), lines(behind) if tag else []
    suites = [x for x in said[1:] if x.startswith("#") or _has_word(x, SUITE_WORDS)]
    first = said[0] if said else ""
    different = {x.strip().upper(): x for x in reversed([*(ranges_written_out(first) if first else []), *(x for x in said[1:] if x not in suites)])}
    at = next((k for k, x in enumerate(after) if ":" in x), None)
    city, _, region = (after[at] if at is not None else "").partition(":")
    sale = after[at + 1] if at is not None and len(after) > at + 1 else ""
    day, iso = sale_date(sale.partition("$")[0]) if "$" in sale else ("", "")
    price = (sale.partition("$")[2].partition("$")[0].split() or [""])[0]
    shown = _squeezed(_text(page))
    number = re.search(r"RT\d{5,6}", cut.named[-1][0]) if cut.named else None
    pin = re.search(r"PIN:([^<]{0,80})", page)
    pin = re.sub(r"\D", "", pin[1].split("\n")[0]) if pin else ""
    place = {"address": first, "address_suite": suites[0] if suites else "", "city": city.strip(), "municipality": region.strip(), "province": "Ontario", "alternate_addresses": [x for x in reversed(different.values()) if x != first]}
    number = number or re.search(r"RT\d{5,6}", shown)
    return {
        "address": place, "sale_date": day, "sale_date_iso": iso, "sale_price": f"${price}" if price else "", "rt_number": number[0] if number else "",
        "arn": re.sub(r"\D", "", (lines(cut.body("Assessment Roll Number")) or [""])[0]), "pins": [pin] if pin else [],
    }


_FEET = r"(\d+(?:\.\d+)?) *(?:ft\.?|feet|foot) *"
_FRONTAGE = [_FEET + r"(?:of *)?(?:front|wid)", r"frontage *(?:of *)?" + _FEET]
_DEPTH = [_FEET + r"(?:of *)?depth", r"depth *(?:of *)?" + _FEET]
_ZONING = [r"\bzon(?:ing|ed) *[:-]? *([A-Z0-9-]+)", r"\b([A-Z]{1,3}) *zone\b", r"\bzone *[:-]? *([A-Z0-9-]+)"]
_AREA = [r"(\d+(?:\.\d+)?) *acre", r"(\d+(?:\.\d+)?) *ac\.", r"(\d+(?:\.\d+)?) *(?:ha\b|hectare)"]


def _found(texts: list[str], patterns: list[str]) -> str:
    return next((m[1] for t in texts for p in patterns if (m := re.search(p, t, re.I))), "")


def site(cut: Sections) -> dict:
    """legal_description (500 characters and three dots at most, as it is kept); area in acres, lengths in feet."""
    body = cut.body("Site")
    parts, said, told = paragraphs(body), " ".join(lines(body)), " ".join(lines(cut.body("Description")))
    legal = " ".join(_squeezed(x) for x, _ in parts[0]) if parts else ""
    area = _found([said], _AREA)
    if not area and (square := _found([said], [r"(\d+) *(?:sq\.? *ft|square *feet)"])):
        area = f"{int(square) / 43560:.4f}"
    frontage, depth = _found([said, told], _FRONTAGE), _found([said], _DEPTH)
    whole = " ".join(" ".join(lines(b)) for _, b in cut.named)
    return {
        "legal_description": legal[:500] + "..." if len(legal) > 500 else legal, "site_area": area, "site_area_units": "acres" if area else "", "site_frontage": frontage, "site_frontage_units": "feet" if frontage else "",
        "site_depth": depth, "site_depth_units": "feet" if depth else "", "zoning": _found([told, said], _ZONING).upper(), "pins": sorted(set(re.findall(r"(?i)\bpin[: #]*(\d{9,10})\b", whole))),
    }


def _before_link(body: str) -> str:
    return " ".join(lines(re.split("(?i)<a[ >]", body, maxsplit=1)[0]))


def consideration(cut: Sections) -> dict:
    said = _before_link(cut.body("Consideration"))
    amount = lambda names: _found([said], [rf"(?:{names})[: ]*\$?([\d,]+)"]).replace(",", "")
    who = [re.split(r"(?i)\band\b", x, maxsplit=1)[0].strip() for x in re.findall(r"(?i)(?:chargee|lender|mortgagee)[: ]+([A-Za-z ,]+)", said)]
    return {"verbatim": said, "cash": amount("cash"), "assumed_debt": amount("assumed|debt"), "chattels": amount("chattels|inventory"), "chargees": list(dict.fromkeys(x for x in who if x))}


def broker(cut: Sections) -> dict:
    said = _before_link(cut.body("Broker/Agent", part=True))
    phone = _PHONE.search(said)
    return {"brokerage": said.replace(phone[0], "").strip() if phone else said, "phone": phone[0] if phone else ""}


def photos(page: str) -> list[str]:
    """The different photographs of the gallery, or the page's first picture if it has none."""
    source = re.compile(r"(?i)<img [^<>]*\bsrc *= *[\"']?([^\"'<> ]+)")
    gallery = re.search(r"(?i)<div [^<>]*\bid *= *[\"']?mygallery\b[^<>]*>", page)
    if gallery:
        within = page[gallery.end() :]
        return list(dict.fromkeys(x for x in source.findall(re.split("(?i)</div>", within, maxsplit=1)[0]) if "/photos/" in x))
    one = source.search(page)
    return [one[1]] if one and ("/photos/" in one[1] or "/assets/files/" in one[1]) else []


def building_size(text: str) -> str:
    return _found([text], [r"(\d{1,3}(?:,\d{3})*) *(?:sf\b|sq\.? *ft|square *f(?:ee|oo)t)"]).replace(",", "")


def record(page: str) -> dict:
    page = without_comments(page)
    cut = Sections(page)
    told = " ".join(dict.fromkeys(lines(cut.body("Description")))) if cut.has("Description") and cut.has("Site") else ""
    return {
        "transaction": header(page, cut), "transferor": party(cut.body(SELLER)), "transferee": party(cut.body(BUYER)), "site": site(cut), "consideration": consideration(cut),
        "broker": broker(cut), "description": told, "photos": photos(page), "export_extras": {"building_sf": building_size(told)},
    }


#: Names of fields of an assessment page and the ids of their elements; those of STRUCTURE and SALE end in a number or date.
SUMMARY = {"address": "sum-h1-address", "owner_names": "sum-owner-names", "last_sale_price": "sum-lastsale-value", "last_sale_date": "sum-lastsale-date", "lot_size_area": "sum-lotsize-area", "lot_size_perimeter": "sum-lotsize-perimeter", "party_to": "sum-partyto-value", "legal_description": "sum-legal-desc"}
REGISTRY = {"gw_address": "reg-gw-address", "land_registry_office": "reg-lro", "owner_names": "reg-on", "ownership_type": "reg-ot", "land_registry_status": "reg-lrs", "property_type": "reg-pt", "registration_type": "reg-rt", "pin": "reg-pin"}
STRUCTURE = {
    "frontage": "ss-site-frontage-", "zoning": "ss-site-sa-", "depth": "ss-site-depth-", "property_description": "ss-struct-pd-", "property_code": "ss-struct-pc-", "current_assessed_value": "ss-ad-cav-", "valuation_date": "ss-ad-vd-",
    "assessment_legal_description": "ss-msed-ld-", "site_area": "ss-msed-sa-", "property_address": "ss-msap-pa-", "municipality": "ss-msap-muni-", "owner_names_mpac": "ss-msap-on-", "owner_mailing_address": "ss-msap-oma-",
}
SALE = {"sale_date": ["vs-tbl-data-sd-"], "sale_amount": ["vs-tbl-data-sa-"], "type": ["vs-tbl-data-type-"], "party_to": ["vs-tbl-data-pt-"], "notes": ["vs-tbl-data-notes-", "vs-tbl-data-notes-empty-"]}
_ID = re.compile(r"<([A-Za-z][A-Za-z0-9-]*) [^<>]*\bid *= *[\"']([^\"'<>]*)[\"'][^<>]*>")


def _elements(page: str) -> list[tuple[str, str]]:
    """id and text of every element with an id, in order; its text ends with the first end tag of its name, or where the
    next such element begins."""
    found = [(m[1].lower(), m[2], m.start(), m.end()) for m in _ID.finditer(page)]
    ends: dict[str, list[int]] = {}
    for m in re.finditer(r"</([A-Za-z][A-Za-z0-9-]*)", page):
        ends.setdefault(m[1].lower(), []).append(m.start())
    out = []
    for k, (tag, name, _, start) in enumerate(found):
        stop = found[k + 1][2] if k + 1 < len(found) else len(page)
        places = ends.get(tag, [])
        at = bisect.bisect_left(places, start)
        out.append((name, _squeezed(_text(page[start : min(stop, places[at]) if at < len(places) else stop]))))
    return out


def assessment(page: str) -> dict | None:
    """summary, registry, site_structure, sales_history, pin; None for pages of another kind."""
    elements = _elements(without_comments(page))
    text: dict[str, str] = {}
    for name, said in elements:
        text.setdefault(name, said)
    if "pr-expansion-panel-registry" not in text:
        return None
    roll = next((n for n in text if n.startswith("ss-an-arn-")), None)
    suffix = roll.removeprefix("ss-an-arn-") if roll else None
    arn = text[roll].removeprefix("ARN :").strip() or text[roll] if roll else ""
    sales: list[dict] = []
    cells: dict[str, str] = {}
    for name, said in [*elements, ("vs-tbl-row-hdr", "")]:
        if name.startswith("vs-tbl-row-"):
            if cells:
                date = cells.pop("")
                row = {k: next((cells[i + date] for i in ids if cells.get(i + date)), "") for k, ids in SALE.items()}
                sales.append(row | {"sale_date": row["sale_date"] or date})
            cells = {} if name == "vs-tbl-row-hdr" else {"": name.removeprefix("vs-tbl-row-")}
        elif cells:
            cells.setdefault(name, said)
    registry = {k: text.get(i, "") for k, i in REGISTRY.items()}
    return {
        "summary": {k: text.get(i, "") for k, i in SUMMARY.items()}, "registry": registry, "site_structure": {"arn": arn} | {k: text.get(f"{i}{suffix}", "") if roll else "" for k, i in STRUCTURE.items()},
        "sales_history": sales, "pin": registry["pin"],
    }


def _type_of(value: object) -> DataType:
    if isinstance(value, dict):
        return StructType([StructField(k, _type_of(v)) for k, v in value.items()])
    return ArrayType(_type_of(value[0]) if value else StringType()) if isinstance(value, list) else StringType()


RECORD = _type_of(record(""))
_ASSESSED = '<p id="pr-expansion-panel-registry"></p><p id="vs-tbl-row-x"></p>'
ASSESSMENT = _type_of(assessment(_ASSESSED))


def _parsed(parse: Callable[[str], dict | None], kind: StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_type(kind)
        for batch in batches:
            parsed = pa.array([parse(x.as_py() or "") for x in batch.column("_page")], arrow)
            rest = [n for n in batch.schema.names if n != "_page"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), parsed], [*rest, "_record"])

    return run


def _with_record(pages: DataFrame, page: Column, name: str, parse: Callable[[str], dict | None], kind: StructType) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != name]) if set(pages.columns) - {name} else F.struct(F.lit(0).alias("_none"))
    rows = pages.select(rest.alias("_rest"), page.cast("string").alias("_page"))
    schema = StructType([rows.schema["_rest"], StructField("_record", kind)])
    out = rows.mapInArrow(_parsed(parse, kind), schema)
    return out.select(*[F.col("_rest").getField(c).alias(c) for c in pages.columns if c != name], F.col("_record").alias(name))


def record_pages(pages: DataFrame, page_col: str = "page", name: str = "record") -> DataFrame:
    """``pages`` with the nested record of each page; an input column of that name is replaced."""
    return _with_record(pages, F.col(f"`{page_col}`"), name, record, RECORD)


def assessment_pages(pages: DataFrame, page_col: str = "page", name: str = "record") -> DataFrame:
    """``pages`` with the nested assessment of each page, null for pages of another kind."""
    return _with_record(pages, F.col(f"`{page_col}`"), name, assessment, ASSESSMENT)
