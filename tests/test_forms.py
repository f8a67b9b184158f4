"""Pages, addresses, names and registries: literal cases, odd input, and brute force where there is no SQL."""

import ast
import difflib
import glob
import itertools
import math
import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import addresses as A
from tessera.functions import text as T
from tessera.operators import alike
from tessera.operators import chains
from tessera.operators import checks as C
from tessera.operators import confirm
from tessera.operators import marts as M
from tessera.operators import overlap as O
from tessera.operators import places as L
from tessera.operators import parties as PA
from tessera.operators import record_pages as P
from tessera.operators import resolve as R
from tessera.plans import forms

SF = "/root/testdata/sf0.001"
PAGE = """<html><body><!-- <strong id="address">no</strong> --><div id="mygallery"><img src="https://x/photos/1.jpg"><img src="https://x/photos/2.jpg"></div>
<strong id="address">12-14 King St<br/>Unit 4<br/>99 Queen St</strong><br/>Ajax : Durham<br/>05 Jan 2024 $1,200,000 <p/>
<p/><font color="#848484">Transferor(s)</font><br/>Acme Holdings Inc&nbsp;&nbsp;(416) 555-1234<br/><em>Old Acme Ltd</em><p/>attn: Ann Ng<br/>c/o Beta Realty Inc<br/>Suite 4<br/>77 Bay St<br/>Toronto, Ontario<br/>M5V 2T6<p/>
<p/><font color="#848484">Transferee(s)</font><br/>Bo Ek<p/>5 Elm Rd<br/>Smith<br/>Barrister<br/>Ajax, Ontario<br/>L1S 1A1
<p/><font color="#848484">Site</font><br/>Plan 453 Part Lot 4<p/>PIN: 123456789<p/>1.25 acres 50 ft frontage depth of 100 feet
<p/><font color="#848484">Assessment Roll Number</font><br/>12 34 567<p/><font color="#848484">Consideration</font><br/>cash: $500,000 assumed debt: $700,000 chargee: Big Bank and others
<p/><font color="#848484">Description</font><br/>12,000 sf office, zoned C4-X<p/><font color="#848484">Broker/Agent</font><br/>Cheap Homes (905) 555-1111 <a href="x">y</a>
<font color="#848484">1 / 9 RT12345</font></body></html>"""


def test_record_page():
    r = P.record(PAGE)
    head, seller, buyer = r["transaction"], r["transferor"], r["transferee"]
    assert head["address"]["alternate_addresses"] == ["12 King", "13 King", "14 King", "99 Queen St"] and head["address"]["address_suite"] == "Unit 4"
    assert (head["address"]["city"], head["address"]["municipality"], head["sale_date_iso"], head["sale_price"], head["rt_number"], head["arn"], head["pins"]) == ("Ajax", "Durham", "2024-01-05", "$1,200,000", "RT12345", "1234567", ["123456789"])
    assert seller["name"] == "Acme Holdings Inc" and seller["phone"] == "(416) 555-1234" and seller["contact"] == "Ann Ng"
    assert seller["alternate_names"] == ["Old Acme Ltd", "Beta Realty Inc"] and seller["address"] == "Suite 4, 77 Bay St, Toronto, Ontario, M5V 2T6"
    assert seller["address_lines"] == ["77 Bay St", "Suite 4", "Toronto, Ontario", "M5V 2T6"] and seller["contact_lines"] == ["Ann Ng"] and seller["aliases"] == ["ACME", "OLD ACME", "BETA"]
    assert buyer["company_lines"] == ["Bo Ek", "Smith Barrister"] and buyer["address_lines"] == ["5 Elm Rd", "Ajax, Ontario", "L1S 1A1"]
    assert r["site"]["zoning"] == "C4-X" and (r["site"]["site_area"], r["site"]["site_frontage"], r["site"]["site_depth"]) == ("1.25", "50", "100") and r["site"]["legal_description"] == "Plan 453 Part Lot 4"
    assert (r["consideration"]["cash"], r["consideration"]["assumed_debt"], r["consideration"]["chargees"]) == ("500000", "700000", ["Big Bank"])
    assert r["broker"] == {"brokerage": "Cheap Homes", "phone": "(905) 555-1111"} and r["export_extras"]["building_sf"] == "12000" and r["photos"] == ["https://x/photos/1.jpg", "https://x/photos/2.jpg"]


def test_record_pages_of_nothing_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "a", "z"), (2, "", "a", "z"), (2, "", "a", "z"), (3, PAGE, "b", "y"), (4, "<!-- never closed " + PAGE.replace("-->", ""), "b", "y")], "id long, page string, record string, _page string")
    got = {r.id: r for r in P.record_pages(rows).collect()}
    assert set(P.record_pages(rows).columns) == {"id", "page", "record", "_page"} and P.record_pages(rows).count() == 5
    assert got[3].record.transferor.name == "Acme Holdings Inc" and got[3]._page == "y" and got[4].record.transaction.rt_number == "" and got[1].record == got[2].record
    assert P.record_pages(rows.limit(0)).count() == 0 and P.assessment_pages(rows).filter("record is not null").count() == 0
    assert P.record_pages(rows.select("page")).columns == ["page", "record"]


@pytest.mark.parametrize("piece", ["<br>", "<em>", "<font #848484>", "<font ", "<p>", "<!--", "a&nbsp;", "<br>1 x,", "&amp;", "<strong id=address>", '<p id="vs-tbl-row-a">', '<p id="x">', "PIN:", "9", "c/o ", "<img "])
def test_pages_are_parsed_in_linear_time(piece):
    def took(n):
        body = '<font color="#848484">Transferor(s)</font>' + piece * (n // len(piece))
        began = time.process_time()
        P.record(body), P.assessment('<p id="pr-expansion-panel-registry"></p>' + body)
        return time.process_time() - began

    assert took(400_000) < 10 * took(100_000) + 1


def test_html_flags_ignore_comments(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, "<!-- " + PAGE.replace("-->", ""))], "id long, page string")
    got = {r.id: r.flags for r in rows.select("id", C.html_flags(F.col("page")).alias("flags")).collect()}
    assert got[1] == ["H014"] and got[2] == got[3] == ["H001", "H004", "H005", "H009", "H010", "H011", "H012", "H013", "H014"]


def ask(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_addresses_by_words(spark):
    for address, number in (("B 70 King", "70"), ("B03-70 King St", "70"), ("B-70A King St", "70"), ("A1-2-3 King", "3"), ("K1", None), (None, None), ("12-70 King", "12")):
        assert ask(spark, address, A.street_number) == number
    assert [ask(spark, x, A.is_po_box) for x in ("POBOX 4", "P.O.Box 7", "Box 12", "Box St", "general  delivery", "Boxwood 9", None)] == [True, True, True, False, True, False, False]
    assert [ask(spark, x, A.is_legal_description) for x in ("CONC 5 LOT 3", "PARKLOT 4", "PART CONCS 4", "12 LOT ST", None)] == [True, False, True, False, False]
    single = lambda x: A.expanded(x, F.lit(""), F.lit(""))
    assert ask(spark, "HWY 7 & 8", single) == ["HWY 7 & 8"] and ask(spark, "7 - 7 OAK CRES", single) == ["7 OAK CRES"] and ask(spark, "618 - 620A BLOOR ST W", single) == ["618 BLOOR ST W", "620A BLOOR ST W"]


def test_names_by_words(spark):
    for name, alias, token in (("Acme Inc. Ltd Co.", "Acme Inc. Ltd", "ACME"), ("Foo Real Estate", "Foo Real Estate", "FOO"), ("X 5", "X 5", None), ("12 34", "12 34", None), ("A (b) c Inc", "A (b) c", None), ("Loblaw Properties 12", "Loblaw Properties 12", "LOBLAW"), (None, None, None)):
        assert (ask(spark, name, T.make_alias), ask(spark, name, T.brand_token)) == (alias, token)
    assert ask(spark, "1195117 Ontario Limited.", T.numbered_company) and not ask(spark, "Ontario Ltd", T.numbered_company)


TRANSACTIONS = [
    ("RT1", "10 Main St", "Ajax", []), ("RT2", "10 MAIN STREET", "ajax", []), ("RT3", "12 Main St", "Ajax", ["p9"]), ("RT4", "10 - 14 Main St", "Ajax", []), ("RT5", "975 Wallace Ave N", "Listowel", []), ("RT6", "", "Ajax", ["p9"]),
    ("RT7", "20 Oak Cres", "Paris", ["p0", "p7", "p9"]), ("RT8", None, None, None), ("RT1", "10 Main St", "Ajax", []),
]
PROPERTIES = [("P00001", "10 Main St", "Ajax", None), ("P00002", "10 Main Street.", "Ajax", None), ("P00003", "975 Wallace Ave", "Listowel", "p9"), ("P00004", "975 Wallace Ave S", "Listowel", None), ("P00005", "20 Oak Cres", "Paris", "p7"), ("P00006", "44 Elm Rd", "Guelph", None)]
REGISTERED = {
    ("P00002", "10 MAIN STREET|AJAX", "RT1,RT2,RT4", "P00001"), ("P00003", "975 WALLACE AVENUE|NORTH PERTH", "RT3,RT7", "P00004"), ("P00005", "20 OAK CRESCENT|PARIS", "", ""), ("P00006", "44 ELM ROAD|GUELPH", "", ""),
    ("P00007", "10 - 14 MAIN STREET|AJAX", "RT4", ""), ("P00008", "975 WALLACE AVENUE NORTH|NORTH PERTH", "RT5", ""),
}


def test_property_registry_of_stated_rows(spark):
    tx = spark.createDataFrame(TRANSACTIONS, "rt_id string, address string, city string, pins array<string>")
    known = spark.createDataFrame(PROPERTIES, "pid string, address string, city string, pin string")
    assert {tuple(r) for r in L.property_registry(tx, known).collect()} == REGISTERED


def brute_registry(tx, known):
    """One transaction and one property after the other; keys and single addresses as given."""
    bare = lambda key: re.sub(r" (NORTH|SOUTH|EAST|WEST|NORTHEAST|NORTHWEST|SOUTHEAST|SOUTHWEST)(?=\||$)", "", key)
    by_key, by_pin, key_of = {}, {}, {}
    for pid, key, pin in sorted(known):
        by_key[key], key_of[pid] = pid, key
        if pin:
            by_pin[pin] = pid
    alone, held = {key for _, key, _, _ in tx}, {}
    for rt, key, singles, pins in tx:
        for at in {key} | {x for x in singles if len(singles) > 1 and x in alone}:
            other = next((by_pin[p] for p in pins or [] if p in by_pin and by_pin[p] != by_key.get(at)), None)
            held.setdefault(key_of[other] if other else at, set()).add(rt)
    out, highest = {}, max(int(p[1:]) for p, _, _ in known)
    for key in sorted(held, key=lambda k: (min(held[k]) + "|" + k)):
        if key not in by_key:
            highest += 1
        out[by_key.get(key) or f"P{highest:05d}"] = [key, held[key], []]
    rest = [(p, k) for p, k, _ in known if p not in out]
    stays = []
    for pid, key in rest:
        into = [t for t, (k, _, _) in out.items() if key == k or bare(key) == k or key == bare(k)]
        if into:
            out[min(into)][2].append(pid)
        else:
            stays.append((pid, key, "", ""))
    return sorted([(p, k, ",".join(sorted(r)), ",".join(sorted(f))) for p, (k, r, f) in out.items()] + stays)


def test_property_registry_query(spark):
    a, c = F.col("address"), F.col("city")
    tx, known = forms.registry_input(spark, SF)
    keyed = lambda df: df.filter(F.trim("address") != "").withColumn("key", A.dedup_key(a, c))
    singles = F.transform(A.expanded(a, F.lit(""), F.lit("")), lambda x: A.dedup_key(x, c))
    rows = [tuple(r) for r in keyed(tx).select("rt_id", "key", singles, "pins").collect()]
    old = [tuple(r) for r in keyed(known).select("pid", "key", "pin").collect()]
    got = sorted(map(tuple, forms.ALL["property_registry"][0](spark, SF).collect()))
    assert got == brute_registry(rows, old) and sum(bool(r[3]) for r in got) > 3 and sum("," in r[2] for r in got) > 10


MEMBERS = [
    (1, "G00001", "ALPHA INC", "RT1", "buyer"), (2, "G00001", "ALPHA INC", "RT2", "seller"), (3, "G00001", "BETA INC", "RT2", "seller"), (4, "G00001", "GAMMA INC", "RT3", "buyer"), (5, "G00002", "DELTA LTD", "RT4", "buyer"),
    (6, "G00003", "EPSILON LTD", "RT5", "buyer"), (7, "G00003", "BETA INC", "RT6", "buyer"), (8, "G00004", "ZETA CO", "RT5", "buyer"), (9, "G00005", "ETA CO", "RT7", "buyer"),
]
SPLITS = [("ALPHA INC", ""), ("BETA INC", "G00002"), ("DELTA LTD", "G00009"), ("NOBODY", "G00001"), ("", "G00001"), ("GAMMA INC", "G00001"), ("EPSILON LTD", "G00010")]
MERGES = [["G00003", "G00004", "G00077"], ["G00088", "G00005"], ["G00010", "G00003", "G00010"], ["G00005"]]
REPLAYED = {(1, "G00006"), (2, "G00006"), (3, "G00002"), (4, "G00001"), (5, "G00009"), (6, "G00010"), (7, "G00010"), (9, "G00005")}


def brute_replay(members, splits, merges):
    """Groups as lists of members, changed one decision after the other."""
    groups: dict = {}
    for m in members:
        groups.setdefault(m[1], []).append(m)
    highest = max(int(g[1:]) for g in groups)

    def put(group, rows):
        held = groups.setdefault(group, [])
        seen = {(m[3], m[4]) for m in held}
        held += [m for m in rows if (m[3], m[4]) not in seen]

    for name, target in splits:
        source = min((g for g, ms in groups.items() if any(m[2] == name for m in ms)), default=None) if name else None
        if source is None or target == source or len({m[2] for m in groups[source]}) < 2:
            continue
        if not target:
            target = f"G{highest + 1:05d}"
        highest = max(highest, int(target[1:]))
        rows = [m for m in groups[source] if m[2] == name]
        groups[source] = [m for m in groups[source] if m[2] != name]
        put(target, rows)
    for target, *sources in merges:
        for source in sources:
            if target in groups and source in groups and source != target:
                put(target, groups.pop(source))
    return Counter((m[0], g) for g, ms in groups.items() for m in ms)


def test_replay_of_decisions(spark):
    rows = spark.createDataFrame(MEMBERS, "id long, gid string, nn string, rt_id string, role string")
    assert {tuple(r) for r in L.replayed(rows, SPLITS, MERGES).collect()} == REPLAYED == set(brute_replay(MEMBERS, SPLITS, MERGES))


def test_replay_query(spark):
    rows = [tuple(r) for r in forms.members(spark, SF).select("id", "gid", "nn", "rt_id", "role").collect()]
    first = {}
    for r in sorted(rows):  # a transaction stands once for a group and role
        first.setdefault((r[1], r[3], r[4]), r)
    got = Counter(tuple(r) for r in L.replayed(spark.createDataFrame(list(first.values()), "id long, gid string, nn string, rt_id string, role string"), *forms.DECISIONS).collect())
    assert got == brute_replay(list(first.values()), *forms.DECISIONS) and len(got) > 400


def test_shared_signals_lose_nothing(spark):
    """Sixty buyers hold one property; pairs of narrow signals and members of wide ones give every score."""
    rows = [(f"b{k:02d}", 1, f"s{k}", "x") for k in range(60)] + [(f"b{k:02d}", 2, "s", "y") for k in range(3)]
    tx = spark.createDataFrame(rows, "buyer string, prop_key long, seller string, brand string")
    got = M.shared_signals(tx).collect()
    assert {(r.a, r.b, r.score) for r in got if r.kind == "pair"} == {("b00", "b01", 4), ("b00", "b02", 4), ("b01", "b02", 4)}
    assert {(r.a, r.b, r.score) for r in got if r.kind == "member"} == {(f"b{k:02d}", "property 1", 3) for k in range(60)}
    assert M.shared_signals(tx.limit(0)).count() == 0


def full(address):
    s = re.sub(r"\s+", " ", (address or "").strip().upper())
    for short, long in (("STE", "SUITE"), ("AVE", "AVENUE"), ("RD", "ROAD")):
        s = re.sub(rf"\b{short}\b\.?", long, s)
    return re.sub(r"\bST\b\.?(?!\s)", "STREET", s)


def base(address):
    s = full(address)
    s = re.sub(r",?\s*(?:SUITE|UNIT|FLOOR|ROOM|#)\s*\d+\w*", "", s).strip().rstrip(",").strip()
    return s if s[:1].isdigit() else ""


def sequential(rows, component, most):
    """One candidate after the other, on whole components."""
    norm = lambda x: re.sub(r"[.,;:]+$", "", re.sub(r"\s+", " ", x.upper()).strip())
    members, first, places = {}, {}, {}
    for r in sorted(rows, key=lambda r: r["id"]):
        members.setdefault(component[r["id"]], set()).add(norm(r["name"]))
        if not re.fullmatch(r"\d+ ONTARIO (INC|LTD|LIMITED|INCORPORATED)", norm(r["name"])):
            first.setdefault(norm(r["name"]), r["id"])
            if len((r["address"] or "").strip()) >= 10:
                places.setdefault(norm(r["name"]), []).append(full(r["address"]))
    usual = {n: base(Counter(p).most_common(1)[0][0]) for n, p in places.items()}
    now = dict(component)
    for r in sorted(rows, key=lambda r: r["id"]):
        for alt in r["alternate_names"] or []:
            target = first.get(norm(alt or ""))
            if not alt or target is None or not base(r["address"]) or base(r["address"]) != usual.get(norm(alt)):
                continue
            a, b = now[r["id"]], now[target]
            if a != b and len(members[a] | members[b]) <= most:
                members[a] |= members.pop(b)
                now = {k: a if v == b else v for k, v in now.items()}
    return now


def sets(component):
    out = {}
    for k, v in component.items():
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


SCHEMA = "id long, name string, phones array<string>, contact string, address string, is_company boolean, alternate_names array<string>, component string"


@pytest.mark.parametrize("most,seed", [(3, 1), (5, 2), (50, 3)])
def test_alternate_names_one_after_the_other(spark, most, seed):
    r = random.Random(seed)
    names, places = [f"Firm{c} Inc" for c in "abcdefghijkl"] + ["12345 Ontario Ltd", "Firma  INC."], ["10 King St Suite 4", "10 King St, Unit 9", "10 KING ST", "22 Queen Road", "King St", "9 Elm St", None, ""]
    rows = [dict(id=k, name=r.choice(names), phones=None, contact=None, address=r.choice(places[: 4 if k % 2 else 8]), is_company=True, alternate_names=r.choice([None, [], [r.choice(names)], [r.choice(names), None, "Nobody", r.choice(names)]]), component="c") for k in range(60)]
    table = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    linked = R.components(PA.by_name(PA._prepared(table)))
    component = {x["id"]: x["id"] for x in rows} | {x.id: x.component for x in linked.collect()}
    edges = [(x.a, x.b) for x in PA.by_alternate(table, linked, most).collect()]
    now = dict(component)
    for a, b in edges:
        a, b = now[a], now[b]
        now = {k: a if v == b else v for k, v in now.items()}
    assert sets(now) == sets(sequential(rows, component, most)) and edges


def test_alternate_clusters_query(spark):
    table = R.written(forms.leaning_appearances(spark, SF))
    rows = [r.asDict() for r in table.collect()]
    plain = table.drop("alternate_names")
    found = PA.evidence(plain)
    every = {r["id"]: r["id"] for r in rows}
    before = every | {x.id: x.component for x in R.components(found.filter("rule in ('name', 'phone', 'brand')").select("a", "b")).collect()}
    now = sequential(rows, before, PA.COMBINED_NAMES)
    for x in found.filter("rule in ('address', 'number')").collect():
        now = {k: now[x.a] if v == now[x.b] else v for k, v in now.items()}
    got = {x.id: x.component for x in forms.ALL["alternate_clusters"][0](spark, SF).collect()}
    assert sets(got) == sets(now) != sets(before)


def brute_chain(attributes, source, goal, steps):
    """Level by level; each party is reached over the smallest (kind, value, party before)."""
    of = {}
    for p, k, v in attributes:
        of.setdefault(p, set()).add((k, v))
    reached = {source: None}
    for _ in range(steps):
        found = {}
        for at, via in itertools.product(of, [p for p in reached if p in of]):
            if at not in reached and (both := of[at] & of[via]):
                found[at] = min([(*min(both), via), *([found[at]] if at in found else [])])
        reached |= found
    if goal not in reached:
        return None
    chain, n = "", 0
    while goal != source:
        k, v, via = reached[goal]
        chain, goal, n = f" -[{k}: {v}]- {goal}{chain}", via, n + 1
    return n, source + chain


@pytest.mark.parametrize("size", [2, 1024])
def test_evidence_chains(spark, monkeypatch, size):
    monkeypatch.setattr(chains, "SLICE", size)
    r = random.Random(5)
    attributes = [(f"p{r.randrange(40):02d}", r.choice(["phone", "contact"]), f"v{r.randrange(30)}") for _ in range(70)] + [(f"p{k:02d}", "hub", "all") for k in range(30, 40)]
    attributes = sorted(set(attributes))
    pairs = sorted({(f"p{r.randrange(40):02d}", f"p{r.randrange(44):02d}") for _ in range(60)} | {("p01", "p01"), ("none", "p01")})
    table = spark.createDataFrame([*attributes, *attributes[:5], (None, "phone", "v1"), ("p01", None, "v2"), ("p01", "phone", None)], "party string, kind string, value string")
    for steps in (1, 3, 8):
        got = {(x.source, x.goal): (x.steps, x.chain) for x in chains.evidence_chains(table, spark.createDataFrame([*pairs, pairs[0]], "source string, goal string"), steps).collect()}
        want = {p: brute_chain(attributes, *p, steps) or (None, None) for p in pairs}
        assert got == want and len(got) == len(pairs)
    assert chains.evidence_chains(table.limit(0), table.select("party", "kind").limit(0).toDF("source", "goal")).count() == 0


def test_fuzzy_bounds_lose_no_match(spark, monkeypatch):
    monkeypatch.setattr(R, "MET", 16)
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdeABCXYZ -é1", k=r.randint(0, 9)))
    left = [(k, word(), r.choice(["x", "y", None])) for k in range(120)] + [(900, None, "x"), (901, "abc", "none"), (1, word(), "x")]
    right = [(k, word(), r.choice(["x", "x", "y"])) for k in range(150)] + [(200 + k, left[k][1], left[k][2]) for k in range(20)] + [(999, None, "x")]
    frames = [spark.createDataFrame(x, "id long, text string, block string") for x in (left, right)]
    want = {}
    for i, t, b in left:
        met = [(difflib.SequenceMatcher(None, t, u).ratio(), -j) for j, u, c in right if c == b and None not in (t, u, b)]
        if met and max(met)[0] >= 0.6:
            want.setdefault(i, set()).add((-max(met)[1], round(max(met)[0], 6)))
    got = {}
    for x in R.fuzzy_best(*frames, "block").collect():
        got.setdefault(x.id, set()).add((x.match_id, x.score))
    assert got == want and len(want) > 30


def test_store_matches_query(spark):
    stores, lots = forms.store_input(spark, SF)
    kept = lambda df, key: [(x[key], ask_number(x.address), " ".join(x.tokens), x.city) for x in df.withColumn("tokens", A.street_tokens(F.col("address"))).collect()]
    ask_number = lambda a: (m[1] if (m := re.match(r"(?:[A-Z]\d*-)?(\d+)", a)) else None)
    right, want = kept(lots, "pid"), {}
    for i, number, text, city in kept(stores, "id"):
        met = [(difflib.SequenceMatcher(None, text, u).ratio(), -j) for j, n, u, c in right if n == number and c == city and number]
        best = max(met, default=(0, 0))
        want[i] = (-best[1], round(best[0], 6), "") if best[0] >= 0.6 else (None, None, "no_street_number" if number is None else "low_similarity" if met else "no_match")
    got = {x.id: (x.pid, x.score, x.reason) for x in forms.ALL["store_matches"][0](spark, SF).collect()}
    assert got == want and {w[2] for w in want.values()} >= {"", "no_street_number", "no_match"}
    number = A.street_number(F.col("address"))
    side = lambda df, key: df.select(F.concat_ws("|", number, "city").alias("block"), F.array_join(A.street_tokens(F.col("address")), " ").alias(key)).distinct()
    a, b = side(stores.filter(number.isNotNull()), "ta"), side(lots, "tb").withColumn("match_id", F.lit(1))
    first, rest = R.fuzzy_candidates(a, b)
    assert first.count() + rest.count() < 0.8 * a.join(b, "block").count()  # fewer comparisons than pairs of different texts


def test_similarity_of_many_pairs_is_that_of_difflib():
    r = random.Random(4)
    said = lambda: "".join(r.choice("abC0\u00e9\0 "[: r.randrange(2, 8)]) for _ in range(r.choice([0, 1, 5, 20, 63, 64, 210])))
    a, b = [said() for _ in range(300)], [said() for _ in range(300)]
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert list(alike.ratios(a, b)) == want and all(alike.bounds([x], [y])[0, 0] >= w for x, y, w in zip(a, b, want, strict=True))
    assert (alike.bounds(a[:40], b)[:, 7] == [alike.bounds([x], [b[7]])[0, 0] for x in a[:40]]).all()


def test_numbered_names_are_hardly_compared(spark):
    """Names that differ in the order of their digits alone have the same characters."""
    row = spark.range(400)
    a, b = row.select(F.lit("x").alias("block"), F.format_string("Customer#%09d", F.col("id") * 37).alias("ta")), row.select(F.lit("x").alias("block"), F.format_string("Supplier#%09d", "id").alias("tb"), F.col("id").alias("match_id"))
    first, rest = R.fuzzy_candidates(a, b)
    assert first.count() + rest.count() < 0.05 * 400 * 400


def full_cell(spark, n, m):
    """Points and rings in one cell, about half of which meet."""
    x = lambda k: (F.col("id") * k % 1009) / 100_000.0
    points = spark.range(n).select("id", x(37).alias("lng"), x(101).alias("lat"))
    corner = lambda dx, dy: F.struct((x(53) + dx).alias("x"), (x(211) + dy).alias("y"))
    rings = spark.range(m).select(F.col("id").alias("polygon_id"), F.array(corner(-0.004, -0.004), corner(0.004, -0.003), corner(0.001, 0.0), corner(0.004, 0.005), corner(-0.004, 0.004)).alias("ring"))
    return points, rings


def crossings(lng, lat, ring):
    return sum((y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))


def test_rings_that_hold_points_of_a_full_cell(spark):
    began = time.time()
    points, rings = full_cell(spark, 6000, 800)
    assert R.containing(points, rings, 1.0).count() > 6000 * 800 / 10 and time.time() - began < 30
    points, rings = full_cell(spark, 50, 40)
    known = {r.polygon_id: [tuple(c) for c in r.ring] for r in rings.collect()}
    want = {(p.id, k) for p in points.collect() for k, ring in known.items() if crossings(p.lng, p.lat, ring) % 2}
    odd = spark.createDataFrame([(900, None), (901, []), (902, [(None, 1.0), (0.0, None), (0.005, 0.005)])], "polygon_id long, ring array<struct<x:double,y:double>>")
    got = R.containing(points.union(points.select(F.lit(99), F.lit(None), "lat").limit(1)), rings.union(odd), 0.002)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert R.containing(points.limit(0), rings, 0.002).count() == 0


def test_nearest_of_the_rings_of_a_full_cell(spark):
    began = time.time()
    points, rings = full_cell(spark, 6000, 800)
    assert R.nearest_polygon(points, rings, 900, 1.0).count() == 6000 and time.time() - began < 30
    points, rings = full_cell(spark, 60, 3)
    known, want = {r.polygon_id: [tuple(c) for c in r.ring] for r in rings.collect()}, {}

    def away(p, a, b):
        (x1, y1), (x2, y2) = a, b
        u = max(0.0, min(1.0, ((p.lng - x1) * (x2 - x1) + (p.lat - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(x1 + u * (x2 - x1) - p.lng, y1 + u * (y2 - y1) - p.lat) * 95_000

    for p in points.collect():
        m, k = min((0.0 if crossings(p.lng, p.lat, ring) % 2 else min(away(p, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)), k) for k, ring in known.items())
        if m <= 200:
            want[p.id] = (k, round(m, 2))
    got = {r.id: (r.polygon_id, r.metres) for r in R.nearest_polygon(points, rings, 200, 0.003).collect()}
    assert 0 < sum(m > 0 for _, m in want.values()) and len(want) < 60 and got == want


def test_first_ring_that_holds_a_point(spark):
    points, rings = full_cell(spark, 500, 300)
    every = R.containing(points, rings, 0.002).groupBy("id").agg(F.min("polygon_id")).collect()
    got = R.first_containing(points, rings, 0.002).collect()
    assert len(got) > 300 and {tuple(r) for r in got} == {tuple(r) for r in every}


def test_most_overlapped_cuts_out_few_pairs(spark, monkeypatch):
    """Rings of many shapes over each other: convex, concave, wound around twice, null."""
    r = random.Random(8)
    sizes, keep = [], O.written
    monkeypatch.setattr(O, "written", lambda df: sizes.append(((out := keep(df)).columns, out.count())) or out)

    def ring():
        x, y, w, h = r.randrange(40) / 8, r.randrange(40) / 8, r.randrange(2, 9) / 4, r.randrange(2, 9) / 4
        square = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        return r.choice([square, square[::-1], square + square[:1], [*square[:3], (x + w / 2, y + h / 2), square[3]], square + square, square[:3]])

    rings = {k: ring() for k in range(160)} | {200: None, 201: [(0.0, 0.0), (1.0, 1.0)]}
    table = spark.createDataFrame(list(rings.items()), "polygon_id long, ring array<struct<x:double,y:double>>")
    left, right = table.filter("polygon_id % 2 = 1"), table.filter("polygon_id % 2 = 0")
    got = {x.a: (x.b, round(x.share, 9)) for x in O.most_overlapped(left, right, 0.5).collect()}
    pairs = next(n for columns, n in sizes[::-1] if columns == ["key_a", "key_b"])
    every, want = O.overlaps(left, right, 0.5).collect(), {}
    for x in every:
        want[x.a] = min(want.get(x.a, (0, 0)), (-round(x.area / x.area_a, 9), x.b))
    assert got == {a: (b, -s) for a, (s, b) in want.items()} and len(got) > 60 and pairs < len(every) / 2
    assert O.most_overlapped(left.limit(0), right.limit(0), 0.5).count() == 0


def test_shares_are_rounded_once(spark):
    ring = lambda w: [(0.0, 0.0), (w, 0.0), (w, 1.0), (0.0, 1.0)]
    table = spark.createDataFrame([(1, ring(1.0)), (2, ring(0.89850349996))], "polygon_id long, ring array<struct<x:double,y:double>>")
    assert O.most_overlapped(table.filter("polygon_id = 1"), table.filter("polygon_id = 2"), 1.0).select(F.round("share", 6)).first()[0] == 0.898503


def test_captions_and_values_are_looked_for_once(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    rows = spark.createDataFrame([(PAGE, "{}")], "page string, record string")
    assert plan(rows.select(C.html_flags(F.col("page")).alias("x"))).count("regexp_extract_all") == 1
    counted = C.flag_counts(rows, C.record_flags(F.col("record")))
    assert plan(counted).count("get_json_object") == 10 and {r.flag for r in counted.collect()} == {f"P{k:03d}" for k in range(1, 7)}


def test_clusters_of_a_crowd_have_few_links(spark, monkeypatch):
    """Two crowds of 1,500 points within 150 m, a chain of single points, two lone ones and one without a place."""
    linked, keep = [], R.components
    monkeypatch.setattr(R, "components", lambda edges: linked.append(edges.count()) or keep(edges))
    place = lambda k, c: c + (F.col("id") * k % 997) / 997 * 0.0012
    crowds = [spark.range(n, n + 1500).select("id", place(31, 43.6).alias("lat"), place(57, lng).alias("lng")) for n, lng in ((0, -79.5), (2000, -79.4))]
    singles = [(9000 + k, 10.0 + k * 0.0013, 59.9) for k in range(5)] + [(9100, 11.0, 0.0), (9101, 0.0, 0.0), (9102, None, 1.0), (9200, 59.9, 5.0), (9201, 59.9, 5.0026)]
    table = crowds[0].union(crowds[1]).union(spark.createDataFrame(singles, "id long, lat double, lng double"))
    got = {r.id: r.component for r in R.spatial_clusters(table, 150.0).collect()}
    assert linked[0] < 2 * 3000 and got == {k: 0 for k in range(1500)} | {k: 2000 for k in range(2000, 3500)} | {k: 9000 for k in range(9000, 9005)} | {9200: 9200, 9201: 9200}


def test_nearest_of_a_crowd_makes_no_rows_of_pairs(spark):
    place = lambda k, c: c + (F.col("id") * k % 997) / 997 * 0.0008
    table = spark.range(1500).select("id", place(31, 43.6).alias("lat"), place(57, -79.5).alias("lng"))
    table = table.union(spark.createDataFrame([(2000, 43.6, -79.4), (2001, 43.6, -79.4), (2001, 43.6, -79.4), (2002, None, 0.0)], "id long, lat double, lng double"))
    near = R.nearest_within(table, table, 150.0)
    got = {r.probe_id: (r.build_id, r.metres, r.alternatives) for r in near.collect()}
    assert "MapInArrow" in near._jdf.queryExecution().optimizedPlan().toString() and len(got) == 1502
    assert all(got[k][2] == 1498 for k in range(1500)) and got[2000] == (2001, 0.0, 1) and got[2001] == (2000, 0.0, 1)
    a, b = table.select(F.col("id").alias("a"), "lat", "lng").filter("a < 40"), table.select(F.col("id").alias("b"), F.col("lat").alias("y"), F.col("lng").alias("x"))
    pairs = a.join(b, F.col("a") != F.col("b")).select("a", R.haversine_m(F.col("lat"), F.col("lng"), F.col("y"), F.col("x")).alias("d"))
    assert all(abs(got[r.a][1] - r.d) < 0.001 for r in pairs.groupBy("a").agg(F.min("d").alias("d")).collect())


def test_auto_confirm_of_stated_groups(spark):
    rows = [
        ("G1", "ALONE", "", "", []), ("G1", "ALONE", "5", "", None), ("G1", "", "5", "x", ["acme"]),
        ("G2", "A", "1", None, []), ("G2", "B", "1", "kim", []), ("G2", "C", None, "KIM ", []), ("G2", "D", "9", "", []),  # A-B by phone, B-C by contact
        ("G3", "A", "1", "", ["Acme"]), ("G3", "B", "1", "", []), ("G3", "C", "2", "", ["acme holdings co"]), ("G3", "D", "3", "", []), ("G3", "E", "3", "", []), ("G3", "F", "3", "", []),  # aliases beat size
        ("G4", "A", "", "", []), ("G4", "B", "", "", [""]),  # nothing in common
        ("G5", "A", "7", "", []), ("G5", "B", "7", "", []), ("G5", "C", "8", "", []), ("G5", "D", "8", "", []),  # of equal ones that of the smallest name
    ]
    table = spark.createDataFrame(rows, "gid string, name string, phone string, contact string, aliases array<string>")
    groups = spark.createDataFrame([("G1", "x"), ("G2", None), ("G3", " Acme Holdings "), ("G4", ""), ("G5", "zz")], "gid string, display_name string")
    got = {tuple(r) for r in confirm.auto_confirmed(table.union(table), groups, spark.createDataFrame([("G2", "B")], "gid string, name string")).collect()}
    assert got == {("G1", "ALONE"), ("G2", "A"), ("G2", "C"), ("G3", "A"), ("G3", "B"), ("G3", "C"), ("G5", "A"), ("G5", "B")}
    assert confirm.auto_confirmed(table.limit(0), groups).count() == 0


def by_slabs(one, two):
    """The shared area between all corners and crossings: within a slab the shared length of a vertical is linear."""
    edges = lambda r: list(zip(r, r[1:] + r[:1], strict=True))
    xs = {p[0] for p in one + two}
    for (a, b), (c, d) in itertools.product(edges(one), edges(two)):
        den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
        if den:
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
            xs.add(a[0] + t * (b[0] - a[0]))
    xs, total = sorted(xs), 0.0
    for lo, hi in itertools.pairwise(xs):
        if hi - lo < 1e-12:
            continue
        x = (lo + hi) / 2
        cut = lambda r: sorted(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in edges(r) if min(a[0], b[0]) < x < max(a[0], b[0]))  # noqa: B023, E731
        inside = [list(zip(c[::2], c[1::2], strict=False)) for c in (cut(one), cut(two))]
        total += (hi - lo) * sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p, q in itertools.product(*inside))
    return total


def star(r, n, x, y):
    """A simple ring, concave as it likes."""
    turns = [2 * math.pi * (k + 0.4 * r.random()) / n for k in range(n)]
    return [(x + (d := r.uniform(0.2, 1)) * math.cos(t), y + d * math.sin(t)) for t in turns]


def test_shared_area_of_concave_rings():
    r = random.Random(7)
    for _ in range(300):
        one, two = star(r, r.randint(3, 9), 0, 0), star(r, r.randint(3, 9), r.uniform(-1, 1), r.uniform(-1, 1))
        want = by_slabs(one, two)
        for a, b in ((one, two), (two, one[::-1]), (one[2:] + one[:2], [*two, two[0]])):
            assert math.isclose(O.shared_area(a, b), want, rel_tol=1e-7, abs_tol=1e-9)
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert O.shared_area(square, square) == 1 and O.shared_area(square, [(x + 1, y) for x, y in square]) == 0 and O.shared_area(square, square[:2]) == 0


def test_overlaps_of_all_sizes(spark):
    """Small rings, rings over very many cells, odd ones; every pair once."""
    r = random.Random(8)
    rings = {k: star(r, 7, r.uniform(-3, 3), r.uniform(-3, 3)) for k in range(60)} | {100: [(-50.0, -50.0), (50.0, -50.0), (50.0, 0.5), (-50.0, 0.5)], 101: [(0.0, 0.0), (1.0, 1.0)], 102: [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0)]}
    schema = "polygon_id long, ring array<struct<x:double,y:double>>"
    table = spark.createDataFrame([*rings.items(), (103, None), (104, []), (105, [(0.0, None), (1.0, 0.0), (1.0, 1.0)])], schema)
    got = {(x.a, x.b): x.area for x in O.overlaps(table, table, 0.25).collect()}
    want = {(i, j): by_slabs(p, q) for (i, p), (j, q) in itertools.product(rings.items(), repeat=2) if len(p) > 2}
    want = {k: v for k, v in want.items() if v > 1e-7}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, rel_tol=1e-6) for k, v in want.items()) and O.overlaps(table, table, 0.25).count() == len(want)
    assert O.overlaps(table.limit(0), table, 0.25).count() == 0


def test_chains_to_few_goals_grow_with_the_sources(spark, monkeypatch):
    """300 parties, each next to the one before it over every tenth party's attribute, all asked for one goal: no table on
    the way has a row for each two of them."""
    rows = [(k, "near", f"{j}") for k in range(300) for j in (k // 10, k // 10 + 1)]
    sizes, keep = [], chains.written
    monkeypatch.setattr(chains, "written", lambda df: sizes.append((out := keep(df)).count()) or out)
    got = chains.evidence_chains(spark.createDataFrame(rows, "party long, kind string, value string"), spark.createDataFrame([(k, 0) for k in range(300)], "source long, goal long"), 3).collect()
    assert max(sizes) <= 2 * 300 and {x.source: x.steps for x in got} == {k: (k > 0) + (k >= 20) + (k >= 30) if k < 40 else None for k in range(300)}
    assert {x.source: x.chain for x in got}[35] == "35 -[near: 3]- 20 -[near: 2]- 10 -[near: 1]- 0"


def test_edited_components_are_those_of_a_full_rebuild(spark):
    r = random.Random(9)
    frame = lambda rows: spark.createDataFrame(list(rows), "a long, b long")
    norm = lambda rows: {(min(e), max(e)) for e in rows if None not in e and e[0] != e[1]}
    edges = {(r.randrange(80), r.randrange(80)) for _ in range(60)}
    now = R.written(R.components(frame(norm(edges))))
    for _ in range(3):
        gone = {e[:: r.choice([1, -1])] for e in r.sample(sorted(norm(edges)), 12)} | {(500, 501)}
        new = {(r.randrange(90), r.randrange(90)) for _ in range(4)} | {(7, 7), (None, 3)}
        after, now = R.components_after(frame(norm(edges)), now, frame(gone), frame(new))
        edges = (norm(edges) - norm(gone)) | norm(new)
        now = R.written(now)
        assert norm(map(tuple, after.collect())) == edges
        want = {x.id: x.component for x in R.components(frame(edges)).collect()}
        assert {x.id: x.component for x in now.collect()} == want
    kept = R.components_after(frame(edges), now, frame([]), frame([]))[1]
    assert {x.id: x.component for x in kept.collect()} == want


@pytest.mark.parametrize("path", glob.glob(os.path.join(os.path.dirname(forms.__file__), "*.py")), ids=os.path.basename)
def test_no_constant_is_set_twice(path):
    """SQL and queries are filled in at different times, so a second value for a name would reach the older query too."""
    with open(path) as f:
        body = ast.parse(f.read()).body
    names = [t.id for n in body if isinstance(n, ast.Assign) for x in n.targets for t in ast.walk(x) if isinstance(t, ast.Name)]
    assert [n for n, k in Counter(names).items() if k > 1] == []
