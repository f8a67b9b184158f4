"""Review lists and parcels: literal cases and odd input."""

import random

from pyspark.sql import functions as F

from tessera.operators import review as V


def test_address_issues(spark):
    rows = [
        (1, ["12 1/2 Main St, Ajax", None, ""], ["Suite 4, 5 Bay St", "  ", None]), (2, ["King / Queen, Ajax"], ["TD Bank Tower, 5 King St"]), (3, ["Parkway 4", "LOT 4, Plan 2"], ["12 King St, Ajax"]), (4, None, None),
        (5, ["12 NEC St, Ajax"], ["Suites of 5, x"]), (5, ["12 NEC St, Ajax"], ["c/o 5 King, x", "12th Floor, 5 King St"]), (6, ["Ajax"], ["No number, 5 King St", "3 Level Rd, Ajax"]),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "id long, own array<string>, others array<string>, issue string")
    got = {}
    for r in V.address_issues(table, "id", F.col("own"), F.col("others")).collect():
        got.setdefault(r.id, set()).add(r.issue)
    assert got == {
        1: {"half_address", "intersection", "suite_leading"}, 2: {"intersection", "no_street_number", "building_name"}, 3: {"no_street_number", "legal_description"}, 5: {"intersection", "minor_issues"}, 6: {"no_street_number", "minor_issues"},
    }


def test_review_queue_at_its_limits(spark):
    rows = [("a", 20, 100, 0, True), ("b", 19, 100, 0, True), ("c", 3, 100, 0, False), ("d", 2, 100, 0, False), ("e", 1, 1, 0, False), ("f", 4, 5, 0, False), ("g", 2, 0, 5, None), ("h", 2, 100, 4, None), ("i", 9, 10, 5, True)]
    table = spark.createDataFrame(rows, "gid string, names long, transactions long, alternates long, confirmed boolean")
    got = [(r.gid, r.score) for r in V.review_queue(table).collect()]
    assert got == [("a", 50), ("b", 30), ("g", 30), ("e", 25), ("i", 25), ("h", 20), ("c", 15), ("f", 15)] and [r.gid for r in V.review_queue(table, 2).collect()] == ["a", "b"]


def test_keyword_progress(spark):
    rows = spark.createDataFrame([("p", ["Red Ring"], None), ("q", ["ring", None], ["x"]), ("r", [], ["RED"]), ("s", None, None)], "id string, a array<string>, b array<string>")
    done = spark.createDataFrame([("RED", "p"), ("red", "p"), ("ring", "zz"), (None, "q")], "keyword string, id string")
    got = {r.keyword: (r.matches, r.reviewed) for r in V.keyword_progress(rows, "id", ["a", "b"], ["Ring", "red", "none", "RED"], done).collect()}
    assert got == {"ring": (2, 0), "red": (2, 1), "none": (0, 0)}


def test_consolidation_takes_the_stored_parcel_first(spark):
    r = random.Random(1)
    stored = [(k, r.choice([1, 2, 3, None])) for k in range(0, 60, 3)] + [(0, 1), (999, 1)]
    held = [(r.randrange(70), r.randrange(8)) for _ in range(80)]
    ids = [*range(50), 7]
    frame = lambda rows: spark.createDataFrame(rows, "id long, parcel long")
    got = {x.id: (x.parcel, x.source, x.mates, x.first) for x in V.consolidated(spark.createDataFrame([(i,) for i in ids], "id long"), frame(stored), frame(held)).collect()}
    of = {}
    for i in set(ids):
        for source, rows in (("stored", stored), ("contained", held)):
            if i not in of and (found := [p for j, p in rows if j == i and p is not None]):
                of[i] = (min(found), source)
    want = {i: (p, s, len(m := sorted(j for j, (q, _) in of.items() if q == p and j != i)), m[0] if m else None) for i, (p, s) in of.items()}
    assert got == want and {s for _, s in of.values()} == {"stored", "contained"}
