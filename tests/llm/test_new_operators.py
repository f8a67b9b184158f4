"""Divergence audit, delta Lloyd and SimHash against brute force, with nulls, empties, repeats and clashing names."""

import glob
import hashlib
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tessera.llm import delta_lloyd, divergence, near_dup, queries, simhash

SF = "/root/testdata/sf0.001"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.mark.parametrize("name", ["op11_divergence", "op12_delta_lloyd"])
def test_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


# divergence


def brute_divergence(rows, least, top):
    words = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))) for t, a, s in rows]
    out = []
    for lang in {a for a, _, _ in words}:
        seen, used = {}, {s: {} for a, s, _ in words if a == lang}
        for a, s, ws in words:
            if a == lang:
                for w in ws:
                    used[s][w] = used[s].get(w, 0) + 1
                for w in set(ws):
                    seen[w] = seen.get(w, 0) + 1
        kept = {w for w, n in seen.items() if n >= least}
        used = {s: {w: n for w, n in c.items() if w in kept} for s, c in used.items()}
        whole = {w: sum(c.get(w, 0) for c in used.values()) for w in kept}

        def p(count, c, v=len(kept)):
            return 1 + 10**9 * (count + 2) // (sum(c.values()) + 2 * v)

        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in used.items():
            pairs = [(o, sum(f(p(c.get(w, 0), c), p(d.get(w, 0), d)) for w in kept)) for o, d in used.items() if o != s]
            terms = [(w, f(p(n, c), p(whole[w], whole))) for w, n in c.items() if p(n, c) > p(whole[w], whole)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(found[:most])]
    return sorted(out)


def audit(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, n int")
    return sorted(map(tuple, divergence.divergence_audit(table, **options).collect()))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_divergence(spark, monkeypatch, limit):
    monkeypatch.setattr(divergence, "SLICE", 2 if limit == 0 else 1024)
    r = random.Random(4)
    bag = ["the", "The", "É", "é", "straße", "a1b", "x", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(r.choices(bag, [9, 3, 2, 2] + [1] * 23, k=r.randint(0, 25))), r.choice(["en", "en", "de", None]), r.choice(["s", "t", "u", "v", None])) for _ in range(120)]
    rows += [(None, "en", "null text"), ("", "xx", "alone"), ("one two", "yy", "p"), ("one two", "yy", "q"), ("one two", "yy", "q"), ("y " * 30_000, "en", "s"), ("same", "", ""), ("same", None, None)]
    got = audit(spark, rows, least_docs=3, top=4, broadcast_bytes=limit)
    assert got == brute_divergence(rows, 3, 4)
    assert ("yy", "p", "pair", "q", 0, 1) in audit(spark, rows, least_docs=9)


def test_divergence_of_huge_counts_and_nothing(spark):
    assert audit(spark, []) == []
    p = spark.range(1).select(divergence._share(divergence.F.lit(3 * 10**18), divergence.F.lit(7 * 10**18)).alias("p")).first().p
    assert p == 1 + 10**9 * (3 * 10**18 + 2) // (7 * 10**18)


# delta Lloyd


def brute_lloyd(rows, k, dims, scale, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]
    d = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda: [min((d(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        own = [n for _, n in nearest()]
        for n in range(len(centres)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == n]:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = nearest()
    of = {n: sum(x for x, m in last if m == n) for n in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, x, of[n], sum(of.values()), sha[n]) for (i, _), (x, n) in zip(kept, last, strict=True)), key=repr)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e12])
def test_delta_lloyd(spark, size):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in (r.normal(size=3) + r.integers(-3, 4, 3)) * size]) for k in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (200, None), (201, [1.0]), (202, [1.0, None, 2.0]), (203, [1.0, math.nan, 2.0]), (204, [1.0, math.inf, 2.0]), (205, [])]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, cluster int, v int")
    for k, rounds in ((5, 3), (5, 0), (400, 2)):
        want = brute_lloyd(rows, k, 3, 8, rounds)
        long = lambda x: x if x < 2**63 else None
        want = [(i, n, long(d), long(a), long(b), s) for i, n, d, a, b, s in want]
        got = delta_lloyd.cluster_report(table, k=k, dims=3, scale=8, rounds=rounds).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert delta_lloyd.cluster_report(table.limit(0), dims=3).count() == 0 and delta_lloyd.cluster_report(table, dims=7).count() == 0


def test_delta_lloyd_stops_comparing_when_nothing_changes(spark):
    """Two far groups settle at once; rows far beyond doubles and longs do no harm."""
    rows = [(k, [float(k % 2) * 100, 0.0]) for k in range(20)] + [(99, [1e300, -1e300])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = delta_lloyd.cluster_report(table, k=3, dims=2, scale=4, rounds=5).collect()
    assert len(got) == 21 and len({x.cluster for x in got if x.vec_id % 2 == 0}) == 1


# SimHash


def brute_print(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    s = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, radius):
    label = {k: k for k in keys}
    for a, b in itertools.combinations(sorted(keys), 2):
        if (a ^ b).bit_count() <= radius and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
    return label


def brute_simhash(rows, radius=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    label, least = brute_components({p for _, p in prints}, radius), {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return sorted(((i, f"{p:016x}", least.get(label[p])) for i, p in prints), key=repr)


def near_keys(r, n, spread):
    """Keys in chains of single flips around a few centres, so that trees are deep and links many."""
    keys = {0, (1 << 64) - 1}
    while len(keys) < n:
        key = r.choice(sorted(keys)) if r.random() < spread else r.getrandbits(64)
        for _ in range(r.randint(0, 3)):
            key ^= 1 << r.randrange(64)
        keys.add(key)
    return sorted(keys)


def test_trees_find_what_brute_force_finds():
    r = random.Random(6)
    for n, spread in ((1, 0), (2, 1), (60, 0.2), (300, 0.9), (300, 1)):
        trees = [np.array(near_keys(r, max(n, 3), spread)[:n], dtype=np.uint64) for _ in range(3)]
        sizes = np.array([len(t) for t in trees])
        keys, codes = simhash.build_trees(np.concatenate(trees), np.repeat(np.arange(3), sizes))
        base = np.cumsum(sizes) - sizes
        for t in range(3):
            at = slice(base[t], base[t] + sizes[t])
            assert sorted(keys[at]) == sorted(trees[t]) and (np.diff(codes[at]) > 0).all()
            for k in range(1, sizes[t]):  # an edge is the distance of the child to its parent
                parent, edge = divmod(int(codes[base[t] + k]), 65)
                assert (int(keys[base[t] + k]) ^ int(keys[base[t] + parent])).bit_count() == edge and parent < k
        whole = codes + np.repeat(base, sizes) * 65
        for radius in (0, 2, 5):
            who, node = simhash.search(keys, whole, np.repeat(base, sizes), keys, radius)
            want = {(int(a), int(b)) for t in range(3) for a in keys[base[t] :][: sizes[t]] for b in keys[base[t] :][: sizes[t]] if (int(a) ^ int(b)).bit_count() <= radius}
            assert {(int(keys[a]), int(keys[b])) for a, b in zip(who, node, strict=True)} == want


@pytest.mark.parametrize("tree,limit", [(4096, 1 << 20), (4, 1 << 20), (4, 0)])
def test_link_fingerprints(spark, tree, limit):
    r = random.Random(7)
    keys = near_keys(r, 400, 0.8)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    got = simhash.link_fingerprints(spark.createDataFrame([(k,) for k in signed], "fp long"), tree=tree, broadcast_bytes=limit).collect()
    found, want = {}, {}
    for x in got:
        found.setdefault(x.component, set()).add(x.fp % (1 << 64))
    for k, v in brute_components(set(keys), 2).items():
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1) and len(found) > 5


def test_simhash(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choices(words, k=r.randint(1, 40)))) for k in range(120)]
    long = " ".join(r.choices(words, k=900)).split(" ")
    rows += [(300 + k, " ".join(w if j != 7 * k else "other" for j, w in enumerate(long))) for k in range(20)]  # a word in 900 changed
    rows += [(1, None), (2, ""), (3, " \t\x0b\n\x0c\r "), (4, "x " * 70_000), (5, "A b"), (6, "a\x0bB"), (7, "É b"), (8, "é b"), (9, "a\x00b\xa0c d"), (None, "no id"), (None, "no id"), (None, "w1 w2"), (10, "w1 w2"), (10, "w1 w2")]
    table = spark.createDataFrame([(*x, 1, 2, "y") for x in rows], "doc_id long, text string, id int, fp int, component string")
    got = sorted(map(tuple, simhash.simhash_components(table).collect()), key=repr)
    want = brute_simhash(rows)
    assert got == want and len({c for i, _, c in want if i and i >= 300}) < 20
    assert simhash.simhash_components(table.limit(0)).count() == 0


def test_simhash_query(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_simhash"](spark, SF).collect()), key=repr) == brute_simhash(rows)


# near duplicates: recall against all pairs


def test_near_duplicates_find_nearly_all_pairs(spark):
    """All documents of a table against all others, found through shared shingles: of the pairs that reach the
    threshold, set or probability Jaccard, nearly all have one class, and no class holds what no chain of pairs joins."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    bounds, hashes, counts, _ = near_dup.shingles([r.text for r in rows])
    part = [(hashes[a:b], counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    holders, met = {}, {}
    for i, (h, _) in enumerate(part):
        for x in h.tolist():
            for j in holders.setdefault(x, []):
                met[j, i] = met.get((j, i), 0) + 1
            holders[x].append(i)
    near = [(i, j) for (i, j), n in met.items() if n >= 0.4 * max(len(part[i][0]), len(part[j][0])) and near_dup.similarity(*part[i], *part[j]) >= near_dup.THRESHOLD]
    of = {x.doc_id: x.class_id for x in queries.QUERIES["op9_near_dup"](spark, "/root/testdata/sf0.01").collect()}
    same = sum(of[rows[i].doc_id] == of[rows[j].doc_id] for i, j in near)
    label = list(range(len(rows)))
    for i, j in near:
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    print("pairs", len(near), "recall", same / len(near))
    assert len(near) > 20 and same >= 0.98 * len(near)
    joined = {r.doc_id: label[k] for k, r in enumerate(rows)}
    first = {}
    assert all(first.setdefault(of[r.doc_id], joined[r.doc_id]) == joined[r.doc_id] for r in rows if r.text and r.text.strip())


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_near_dup_stages_have_one_python_step(spark, monkeypatch, limit):
    """Each Python step of a stage has workers of its own, which keep memory in later stages."""
    steps, store = [], near_dup.stored

    def kept(df, label):
        steps.append((label, df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")))
        return store(df, label)

    monkeypatch.setattr(near_dup, "stored", kept)
    texts = [" ".join(f"w{(k * j) % 97}" for j in range(40)) for k in range(30)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    near_dup.across(rows.selectExpr("id", "id as class_id"), rows, 5, 0.8, limit).collect()
    assert ("shingles", 1) in steps and max(n for _, n in steps) == 1
