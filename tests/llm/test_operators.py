"""Each operator against a brute-force version, with nulls, empties, repeats and clashing names."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, chunks, decontaminate, html_extract, line_dedup, near_dup, queries, sharding, token_store, toxicity, warc

SF = "/root/testdata/sf0.001"
ENCODER: dict = {}
DOCS = "doc_id long, text string, source string, row int, n int, words string, hot string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "w", "h") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (None, "two words", "a"), (4, " \n ", "b"), (5, "x " * 30_000, "b"), (6, "one", "a")]


# line dedup


def brute_lines(rows, ratio, least):
    bare, pages, held = (lambda x: x.strip(" \t\r\v\f")), {}, {}
    for t, s in {(t, s) for _, t, s in rows if t is not None}:
        pages[s] = pages.get(s, 0) + 1
        for line in {bare(x) for x in t.split("\n")} - {""}:
            held[s, line] = held.get((s, line), 0) + 1
    out = []
    for i, t, s in rows:
        ls = [] if t is None else t.split("\n")
        ks = [x for x in ls if not (bare(x) and held[s, bare(x)] >= least and held[s, bare(x)] > ratio * pages[s])]
        out.append((i, t if len(ks) == len(ls) else "\n".join(ks), len(ls), len(ls) - len(ks)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_line_dedup(spark, limit):
    r = random.Random(1)
    lines = ["menu", " menu", "menu\r", "", "footer", *(f"line {k}" for k in range(40))]
    rows = [(k, "\n".join(r.choices(lines, [9, 3, 3, 5, 6] + [1] * 40, k=6)), r.choice(["a", "a", "b", None])) for k in range(80)] + ODD
    got = line_dedup.boilerplate_report(docs(spark, rows), broadcast_bytes=limit).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, 0.1, 2) and any(x.n_removed for x in got)
    out = line_dedup.drop_boilerplate(docs(spark, rows))
    assert out.columns == docs(spark, []).columns and out.count() == len(rows)
    assert line_dedup.boilerplate_report(docs(spark, [])).count() == 0


def test_line_dedup_keeps_groups_of_copies(spark):
    """Copies hold a third of host a, a plain pair stands on host b of 12 pages; host c has 6 pages with a menu."""
    rows = [(k, "only here\nand this", "a") for k in range(20)] + [(100 + k, f"menu\ntext {k}", "a") for k in range(40)]
    rows += [(200, "twice\nlonger", "b"), (201, "twice\nlonger", "b")] + [(210 + k, f"page {k}", "b") for k in range(10)] + [(300 + k, f"menu\nown {k}", "c") for k in range(6)]
    want = {i: t.removeprefix("menu\n") for i, t, _ in rows}
    for limit in (0, 1 << 20):
        assert {x.doc_id: x.text for x in line_dedup.drop_boilerplate(docs(spark, rows), broadcast_bytes=limit).collect()} == want


def test_line_dedup_of_small_hosts(spark):
    """A host of 8 pages with a footer on 4 of them loses the footer and nothing else; a page alone loses nothing."""
    rows = [(k, f"page {k}\nfooter" if k < 4 else f"page {k}", "a") for k in range(8)] + [(9, "only\npage", "b")]
    got = {x.doc_id: x.text for x in line_dedup.drop_boilerplate(docs(spark, rows)).collect()}
    assert got == {k: f"page {k}" for k in range(8)} | {9: "only\npage"}


# toxicity


def test_toxicity(spark):
    r = random.Random(2)
    plain = ["".join(r.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=r.randint(1, 4))) for _ in range(800)]
    rude = ["grumblefink", "snort", "vexxer", "dolt"]

    def text(bad):
        w = r.choices(plain, k=r.randint(20, 120))
        for _ in range(r.randint(2, 5) if bad else 0):
            w[r.randrange(len(w))] = r.choice(rude)
        return " ".join(w)

    rows = [(k, text(k % 4 == 0), "a") for k in range(1200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    d = docs(spark, rows + [(-i, t, s) for i, (_, t, s) in enumerate(ODD, 1)])
    model = toxicity.fit(d, labels, ~toxicity.held_out())
    got = {x.doc_id: x for x in toxicity.score_documents(d, model).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in set(held)) for k in range(1200))
    good = sum(got[k].predicted == (k % 4 == 0) for k in held) / len(held)
    assert good > 0.97
    assert all(0 <= x.score <= 1 for x in got.values()) and not got[-1].predicted
    assert toxicity.fit(d, labels.limit(0), F.lit(True)) is None
    assert {x.score for x in toxicity.score_documents(d, None).collect()} == {0.0}
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == sum(x.predicted == 0 for x in toxicity.score_documents(d, model).collect())


def test_toxicity_held_out_rows_of_the_test_data(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_documents(d, toxicity.fit(d, labels, ~toxicity.held_out())).join(labels, "doc_id").filter("held_out").collect()
    pairs = sorted((x.score, x.toxic) for x in got)
    ranks = [i for i, (_, y) in enumerate(pairs) if y]
    n, m = len(ranks), len(pairs) - len(ranks)
    assert (sum(ranks) - n * (n - 1) / 2) / (n * m) > 0.9
    assert sum(x.predicted for x in got if not x.toxic) <= 0.01 * m


# token store


def brute_huffman_cost(counts):
    import heapq

    heap = [c for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@given(st.lists(st.lists(st.sampled_from(["A", "h", "İ", "I", "Σ", "K", "ß", ".", ",", ". ", ", ", " ", "\n", "'S", "'t", "\u0301", "\u0307", "\u0331", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\u037e", "7", "...", "Wor"]), max_size=30).map("".join), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_prepared_texts_have_the_ids_of_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    if path not in ENCODER:
        ENCODER[path] = token_store.ChunkEncoder(path)
    encoder = ENCODER[path]
    assert encoder.stops_apart and encoder.folds_case
    with pytest.MonkeyPatch.context() as m:
        m.setattr(token_store, "ChunkEncoder", lambda _: encoder)
        rows = next(token_store._tokenize(path, 2, "<u2")(iter([batch]))).column("ids").to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in rows] == [[*e.ids, 2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60).filter(any), st.integers(1, 9))
def test_huffman(counts, block):
    counts = np.array(counts)
    lengths = token_store.code_lengths(counts)
    assert int((counts * lengths).sum()) == brute_huffman_cost(counts.tolist())
    tight = token_store.code_lengths(counts, 6)
    assert tight.max() <= 6 and sum(2.0 ** -int(x) for x in tight if x) <= 1
    ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 5)).astype(np.uint32)
    np.random.default_rng(1).shuffle(ids)
    bits, words = token_store.pack(ids, token_store.canonical_codes(tight), tight, block)
    for first in range(0, len(bits) + 1, 3):
        assert token_store.unpack(bits, words, len(ids), tight, block, first).tolist() == ids[first * block :].tolist()


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_chunks_are_encoded_as_the_library_does_for_every_letter():
    encoder = token_store.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x20000) if chr(c).isalpha()]
    assert encoder.direct
    for form in ("{0}", "a{0}b,", "{0}{0}."):
        words = [form.format(c) for c in letters]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder(words)] == [x[:-1] for x in brute_ids(words)]


def test_words_with_marks_pass_by_the_tokenizer():
    """Only the marks go through the tokenizer; the ids are those of the library all the same."""
    encoder = token_store.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
    words = [w + a + b for w in ("Heat", "éÀ", "s", "ŸĐǄ") for a in marks for b in ("", a, *marks[::5])] + ["that$$$$$$$$", "<|", "a<|", "b|>", "x<|b|>"]
    seen, whole = [], encoder._whole
    encoder._whole = lambda texts: seen.extend(texts) or whole(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder(words)] == [x[:-1] for x in brute_ids(words)]
    assert [t for t in seen if any(c.isalpha() for c in t)] == ["x<|b|>"]
    rest = ["don't", "a'", "x'S.", "a1.", "é\u0301***", "<|endoftext|>***", "a" * 70 + ".", "a" + "*" * 20, "a*\u0338"]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder(rest)] == [x[:-1] for x in brute_ids(rest)]


def token_rows(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    return [np.frombuffer(x, "<u2").tolist() for b in token_store._tokenize(path, 2, "<u2")(iter([batch])) for x in b.column("ids").to_pylist()]


def test_a_worker_encodes_a_word_once(monkeypatch):
    """A later task of the same worker, and the same word with other marks behind it, need no model."""
    met, words = [], token_store.ChunkEncoder._words
    monkeypatch.setattr(token_store.ChunkEncoder, "_words", lambda self, x: met.extend(x) or words(self, x))
    monkeypatch.setattr(token_store, "_LAST", {}, raising=False)
    texts = ["Heat*** heat%%% heat. Wave", "wave &&& heat (Ürün)", "ürün heat### x"]
    assert token_rows(texts) == brute_ids(texts)
    assert met.count("heat") == 1
    met.clear()
    assert token_rows(texts[::-1]) == brute_ids(texts[::-1]) and met == []
    token_store._forget_runs()
    assert token_store._LAST == {}


def test_marks_are_split_off_as_the_library_does():
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [f"aB{a}{b} c É{a}{b} d'S{a} 1{a} x{a}\u0338 y{a} \u0338" for a in marks for b in ("", a, "'", "<", "|>", ".")]
    texts += ["a<|endoftext|> b", "a<|endoftext|>. b", "a. <|endoftext|>, b", "x|> y", "don't. we'RE! a'*** b", "a" * 70 + "!!! b", "a" + "*" * 90 + " b", "a*\nb%% \n c", "", None]
    assert token_rows(texts) == brute_ids(texts)


@pytest.mark.parametrize("size", [1, 7, 30, 1000])
def test_forgotten_chunks_are_encoded_anew(size):
    encoder = token_store.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    known = token_store.KnownRuns(encoder, size)
    rng = np.random.default_rng(size)
    for _ in range(40):
        asked = [f"Wörd{chr(97 + k)}." if k % 3 == 0 else f"x{k}" if k % 3 == 1 else "ab" * (k + 1) for k in sorted({int(k) for k in rng.integers(0, 26, 9)})]
        number = known(asked)
        got = [known.ids[a : a + n].tolist() for a, n in zip(known.starts[number], known.sizes[number], strict=True)]
        assert got == [x[:-1] for x in brute_ids(asked)]
        assert len(known.number) <= max(size, len(asked)) and list(known.number.values()) == list(range(len(known.sizes)))
    assert len(known(asked)) == len(asked) and len(known([])) == 0


@pytest.mark.parametrize("size", [1, 3, 10, 100])
def test_what_came_last_is_remembered(size):
    known = chunks.Recent(size)
    for lo in range(0, 60, 12):
        known.put_all(list(range(lo, lo + 12)), [str(k) for k in range(lo, lo + 12)])
        last = list(range(max(0, lo + 12 - size), lo + 12))
        assert len(known.new) <= size and known.get_all(last) == [str(k) for k in last]


def brute_limited_cost(counts, limit):
    """The least cost of code lengths of at most ``limit`` bits, tried level by level from the root: of the nodes
    on a level some become leaves (the commonest symbols left), the others have two children."""
    from functools import cache

    c = sorted(counts, reverse=True)
    tail = [sum(c[i:]) for i in range(len(c) + 1)]

    @cache
    def least(done, nodes, depth):
        if done == len(c):
            return 0
        if depth > limit or not nodes:
            return math.inf
        return min(least(done + leaves, min(2 * (nodes - leaves), 2 * len(c)), depth + 1) + (tail[done + leaves] if done + leaves < len(c) else 0) for leaves in range(min(nodes, len(c) - done) + 1))

    return least(0, 2, 1) + tail[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=2, max_size=14))
def test_limited_code_lengths_are_optimal(counts):
    for limit in (4, 5):
        lengths = token_store.code_lengths(np.array(counts), limit)
        assert int((np.array(counts) * lengths).sum()) == brute_limited_cost(counts, limit)


def test_token_store_deals_a_common_id_over_files(spark):
    rows = [(7, f"word{k} and more words here", "s") for k in range(300)] + [(k, "one", "s") for k in (1, 9, 20)] + [(None, f"no id {k}", "s") for k in range(100)]
    folder = token_store.write_tokens(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), tokens_per_file=200, block=64)
    got = token_store.read_tokens(spark, folder).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert sorted((x.doc_id or 0, x.ids) for x in got) == sorted((r[0] or 0, i) for r, i in zip(rows, brute_ids([r[1] for r in rows]), strict=True))
    assert [x.start for x in got] == list(itertools.accumulate([0] + [len(x.ids) for x in got]))[:-1]


def test_empty_tables_are_written_and_read(spark):
    d = docs(spark, [])
    assert token_store.read_digest(spark, token_store.write_tokens(d, public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_digest(spark, warc.write_archives(pages)).count() == 0
    assert html_extract.extract_text(pages).count() == 0
    assert bpe.encode_digest(d, RANKS, public_tokenizers.PATTERN).count() == 0
    assert toxicity.score_documents(d, toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))).count() == 0


@pytest.mark.parametrize("per_file", [500, 1 << 22])
def test_token_store(spark, per_file):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = [(x.doc_id + 10, x.text, x.source) for x in d] + ODD + [(9, "a  b\tc\n\nd e <|endoftext|> I'm", "a")]
    folder = token_store.write_tokens(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), tokens_per_file=per_file, block=64)
    got = token_store.read_tokens(spark, folder).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert [x.start for x in got] == list(itertools.accumulate([0] + [len(x.ids) for x in got]))[:-1]
    want = sorted((r[0] or 0, i) for r, i in zip(rows, brute_ids([r[1] for r in rows]), strict=True))
    assert sorted((x.doc_id or 0, x.ids) for x in got) == want
    digest = {(x.start): x for x in token_store.read_digest(spark, folder).collect()}
    for x in got:
        assert digest[x.start].n_tokens == len(x.ids) and digest[x.start].ids_crc32 == zlib.crc32(np.array(x.ids, dtype="<u4").tobytes())


# WARC


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_warc(spark, limit):
    rows = [(k, f"http://h/{k} \n", f"<p>page {k % 7}</p>" * (k % 3 + 1)) for k in range(60)] + [(60, None, None), (61, "u", ""), (None, "v", "<p>page 1</p>"), (None, "w", "alone"), (3, "http://h/3", "<p>page 3</p>"), (70, "x", "é" * 200_000)]
    p = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    folder = warc.write_archives(p, file_bytes=2000, broadcast_bytes=limit)
    got = warc.archive_digest(spark, folder).collect()
    import base64

    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw, to = (h or "").encode(), first.get(h or "")
        again = to is not None and i != to
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    stored = {(x.page, x.type): bytes(x.payload).decode() for x in warc.read_archives(spark, folder).filter("type = 'response'").collect()}
    assert stored[70, "response"] == "é" * 200_000


# byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    e = bpe.TextEncoder(RANKS, public_tokenizers.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.bpe.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t  aeiouthsñ'l.,0123日🙂"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_bpe_as_tiktoken(encoder, texts):
    e, want = encoder
    assert list(e.encode(texts)) == [want.encode_ordinary(t) for t in texts]


def brute_digests(want, texts):
    ids = [want.encode_ordinary(t or "") for t in texts]
    return [list(map(len, ids)), [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids], [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.one_of(st.sampled_from(" \n\t  aeiouthsñ'l.,*$0123日🙂"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=9), st.sampled_from([1, 50, 4_000_000]), st.integers(0, 2))
def test_bpe_digests_as_tiktoken(encoder, texts, run_chars, skipped):
    e, want = encoder
    with pytest.MonkeyPatch.context() as m:
        m.setattr(e, "run_chars", run_chars)
        got = e.digests(pa.array(texts, pa.string())[skipped:])
    assert list(got) == brute_digests(want, texts[skipped:])


@pytest.mark.parametrize("texts", [[""], ["", ""], [None], [" "], ["  a", "a"], ["a ", "b\n", "\n"], ["x  y"] * 3 + ["x y", "y"], ["z" * 5000, "日本" * 500 + " z"]])
def test_bpe_digests_of_little_and_long(encoder, texts):
    assert list(encoder[0].digests(pa.array(texts, pa.string()))) == brute_digests(encoder[1], texts)


def test_words_are_not_cut_by_the_pattern(encoder):
    """Chunks of Latin letters with ASCII marks behind them, of every letter and mark, do not meet the pattern."""
    e, want = encoder
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
    letters = [chr(c) for c in range(0x250) if re.fullmatch("[^\\W\\d_]", chr(c)) and chr(c).isalpha() and chr(c) not in "ªµº"]
    text = " ".join([f"a{c}b{m}{m}" for c, m in zip(letters, itertools.cycle(marks))] + [f"Wort{a}{b}" for a in marks for b in marks] + letters)
    seen, find = [], e.find
    with pytest.MonkeyPatch.context() as m:
        m.setattr(e, "find", lambda t: seen.append(t) or find(t))
        assert list(e.encode([text])) == [want.encode_ordinary(text)]
        assert seen == []
        assert list(e.encode(["it's a'b 'x aé1 \u00d7y 1."])) == [want.encode_ordinary("it's a'b 'x aé1 \u00d7y 1.")]
        assert {" a'b", " 'x", " aé1", " \u00d7y", " 1."} <= set(seen)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=20), st.data())
def test_bpe_appends_and_edits(encoder, data, more, draw):
    e = encoder[0].bpe
    x = bpe.Encoding(e, data)
    x.append(more)
    whole = data + more
    assert x.last == bpe.Encoding(e, whole).last
    a = draw.draw(st.integers(0, len(whole)))
    b = draw.draw(st.integers(a, len(whole)))
    x.replace(a, b, more)
    whole = whole[:a] + more + whole[b:]
    assert x.data == whole and x.last == bpe.Encoding(e, whole).last and e.decode(x.ids) == whole


def test_bpe_documents(spark, encoder):
    want = encoder[1]
    got = bpe.encode_digest(docs(spark, ODD), RANKS, public_tokenizers.PATTERN).collect()
    rows = []
    for i, t, _ in ODD:
        ids = want.encode_ordinary(t or "")
        rows.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


# HTML


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header>
    <nav><ul><li><a href=/>M{0}</a></ul></nav><div class="cookie notice">We use cookies {0}</div><aside>Side {0}</aside>
    <article><h1>Title&nbsp;{0}</h1><p>First &amp; <b>bold {0}<br>x<p>Second\n  {0}<form><input></form><script>var t="</p>";</script>
    <div class="ad">Buy {0}</div><!-- no --><ul><li>one<li>two {0}</ul></article><section id="comments"><p>Nice {0}</p></section><footer>&copy; F {0}</footer></body></html>"""
    rows = [(k, f"http://h/{k}", page.format(f"v{k}")) for k in range(12)] + [(20, "x", None), (21, None, ""), (22, "http://o/", "no tags &lt;"), (23, "http://o/", "<p>a<p>b" * 3)]
    rows.append(rows[0])
    got = html_extract.extract_text(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")).collect()
    by = {x.page_id: x.text for x in got}
    assert len(got) == len(rows)
    for k in range(12):
        assert by[k] == f"Title v{k}\nFirst & bold v{k} x\nSecond v{k}\none\ntwo v{k}"
    assert by[20] == by[21] == "" and by[22] == "no tags <" and by[23] == "\n".join("ab" * 3)
    assert all(x.n_chars == len(x.text) for x in got)


def test_html_wrapper_finds_what_no_tag_tells():
    page = "<html><body><div class=top>Shop</div><div class=x><div class=y><p>words {0} of {0}</p><p>more {0} text {0}</p></div></div><div class=end>bye</div></body></html>"
    pages = [page.format(w) for w in ("alpha", "beta", "gamma")]
    assert html_extract.induce(pages) == "/html/body/div.x/div.y"
    assert html_extract.content_text(pages[0], html_extract.induce(pages)) == "words alpha of alpha\nmore alpha text alpha"


def test_html_keeps_what_varies_beside_the_body():
    page = "<html><body><div class=top>Shop</div><div class=a><h1>Title {0}</h1><div class=intro>Intro {0}</div><div class=body><p>{1}</p><p>more {1}</p></div></div><div class=end>bye</div></body></html>"
    pages = [page.format(w, f"{w} long " * 50) for w in ("alpha", "beta", "gamma")]
    got = html_extract.content_text(pages[0], html_extract.induce(pages)).split("\n")
    assert got == ["Title alpha", "Intro alpha", ("alpha long " * 50).strip(), "more " + ("alpha long " * 50).strip()]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_html_counts_all_pages_of_a_host_with_two_templates(spark, limit):
    """A long menu comes first, the second template is rare and has another body, and copies are many."""
    menu = "<div class=top>" + "".join(f"<div>M{k}</div>" for k in range(450)) + "</div>"
    first = "<html><body>" + menu + "<div class=x><h1>Title {0}</h1><div class=lead>Lead {0}</div><div class=y><p>words {0} of {0}</p></div></div><div class=end>bye</div></body></html>"
    second = "<html><body>" + menu + "<div class=z><h2>Head {0}</h2><div>text {0} and more {0}</div></div><div class=y>Terms</div><div class=end>bye</div></body></html>"
    rows = [(k, f"http://h/{k}", first.format(f"v{k}")) for k in range(40)] + [(k, f"http://h/{k}", second.format(f"w{k}")) for k in (50, 51, 52)] + [(60 + k, "http://h/c", first.format("copy")) for k in range(30)]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=limit).collect()
    want = {k: f"Title {v}\nLead {v}\nwords {v} of {v}" for k, v in [*((k, f"v{k}") for k in range(40)), *((60 + k, "copy") for k in range(30))]}
    want |= {k: f"Head w{k}\ntext w{k} and more w{k}" for k in (50, 51, 52)}
    assert {x.page_id: x.text for x in got} == want


# decontamination


def brute_hits(rows, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(window, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == iw[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decontaminate(spark, limit):
    r = random.Random(4)
    vocabulary = ["a", "B", "É", "é", "The", "x1", "ß", "q"]
    rows = [(k, r.choice(["", "- "]) + r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary, k=r.randint(0, 14))), "s") for k in range(60)] + ODD[:5]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 7)))) for k in range(12)] + [(90, None), (91, "--"), (92, "x1 absent"), (3, "the")]
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_hit int")
    got = decontaminate.decontamination_report(docs(spark, rows), b, window=4, broadcast_bytes=limit).collect()
    want = brute_hits(rows, items, 4)
    assert sorted(map(tuple, got), key=repr) == want
    kept = decontaminate.drop_contaminated(docs(spark, rows), b, window=4, broadcast_bytes=limit)
    assert kept.columns == docs(spark, []).columns and kept.count() == sum(not x[-1] for x in want)
    assert decontaminate.decontamination_report(docs(spark, rows), b.limit(0)).filter("contaminated").count() == 0


# nearest neighbours


@pytest.mark.parametrize("hashes,block", [(1, 8192), (1, 16), (2, 8192)])
def test_ann(spark, hashes, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 1500)] + 0.25 * rng.normal(size=(1500, 32))
    x[700:760] = x[699]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 32), (2100, [float("nan")] * 32), (2150, [None] * 32), (2200, [1.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    v = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, id int, code string")
    got = ann.search(v, F.col("id") % 50 == 0, hashes=hashes, block=block, probes=8 if hashes == 1 else 30).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 1500, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        want = sorted(range(1500), key=lambda i: (-s[i], i))[:5]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in mine] == [1, 2, 3, 4, 5] and all(math.isclose(g.score, s[g.vec_id], abs_tol=1e-9) for g in mine)
        assert [(-g.score, g.vec_id) for g in mine] == sorted((-g.score, g.vec_id) for g in mine)
        hit, total = hit + len({g.vec_id for g in mine} & set(want)), total + 5
    assert hit / total >= 0.9 and {g.query_id for g in got} == set(range(0, 1500, 50))


def test_ann_query_recall_on_the_test_data(spark):
    """The query's own rows against all pairs."""
    sf = "/root/testdata/sf0.1"
    got = {}
    for g in queries.op8_ann(spark, sf).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 50 == 0)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    hit = sum(len(got[int(ids[q])] & set(ids[np.argsort(-row)[:5]].tolist())) for q, row in zip(asked, s, strict=True))
    assert hit / (5 * len(asked)) >= 0.9


def test_ann_short_queries_meet_all_rows(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(k, [float(y) for y in rng.normal(size=16)]) for k in range(300)], "vec_id long, embedding array<float>")
    got = ann.search(v, F.col("id") % 50 == 0, k=200, tables=1, probes=1, block=40).collect()
    x = np.array([r.embedding for r in v.orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = np.round(x @ x[q], 12)
        s[q] = -9
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == sorted(range(300), key=lambda i: (-s[i], i))[:200]


def test_ann_few_rows(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [-1.0, 0.1])], "vec_id long, embedding array<float>")
    got = sorted((x.query_id, x.rank, x.vec_id) for x in ann.search(v, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 50), (0, 2, 7), (50, 1, 7), (50, 2, 0)]
    assert ann.search(v.limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ann_of_extreme_components(spark, kind):
    """Squares that overflow or vanish change nothing: directions alone count."""
    far, near = (1e200, 1e-200) if kind == "double" else (1e30, 1e-38)
    rows = [(0, [far, far]), (50, [1.0, 0.5]), (7, [2 * far, far]), (8, [0.3, 0.4]), (9, [near, near])]
    v = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted(ann.search(v, F.col("id") % 50 == 0).collect(), key=lambda x: (x.query_id, x.rank))
    assert [(x.query_id, x.vec_id) for x in got] == [(0, 9), (0, 8), (0, 7), (0, 50), (50, 7), (50, 0), (50, 9), (50, 8)]
    want = {(0, 9): 1.0, (0, 8): 0.7 / math.sqrt(0.5), (0, 7): 3 / math.sqrt(10), (0, 50): 3 / math.sqrt(10), (50, 7): 1.0, (50, 8): 0.5 / (0.5 * math.sqrt(1.25))}
    assert all(math.isclose(x.score, want[x.query_id, x.vec_id], rel_tol=1e-6) for x in got if (x.query_id, x.vec_id) in want)


# near duplicates


def brute_classes(rows):
    sets, words = {}, {}
    for i, t, _ in rows:
        w = re.findall(r"\w+", (t or "").lower())
        words[i] = w
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_near_duplicates(spark, limit):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        base = r.choices(vocabulary, k=r.randint(3, 200))
        rows.append((100 * k, " ".join(base), "s"))
        for c in range(r.randint(0, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((100 * k + c + 1, " ".join(w), "s"))
    want = brute_classes(rows)
    more = [(9000, None, "s"), (9001, "", "s"), (9002, "", "s"), (rows[0][0], rows[0][1], "s"), (None, rows[0][1], "s"), (None, "lonely text", "s")]
    got = near_dup.near_duplicates(docs(spark, rows + more), broadcast_bytes=limit).collect()
    mine = {x.doc_id: x.class_id for x in got if x.doc_id is not None}
    assert len(got) == len(rows) + len(more)
    assert {i: mine[i] for i in want} == want
    assert [mine[i] for i in (9000, 9001, 9002)] == [9000, 9001, 9002]
    assert sorted((x.class_id is not None) for x in got if x.doc_id is None) == [False, True]
    kept = near_dup.drop_near_duplicates(docs(spark, rows + more), broadcast_bytes=limit)
    ids = sorted(x.doc_id for x in kept.filter("doc_id is not null").collect())
    assert ids == sorted({*want.values(), 9000, 9001, 9002}) and kept.columns == docs(spark, []).columns
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_near_duplicates_of_an_id_on_several_texts(spark, limit):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, "s"), (1, b, "s"), (2, a, "s"), (3, b, "s"), (4, c, "s"), (4, None, "s"), (4, c, "s"), (None, c + " more", "s"), (None, "x y z", "s"), (None, "x y z", "s")]
    got = near_dup.near_duplicates(docs(spark, rows), broadcast_bytes=limit).collect()
    assert sorted(((x.doc_id, x.class_id, x.copies, x.links) for x in got), key=repr) == sorted(
        [(1, 2, 2, 0), (2, 2, 2, 0), (1, 3, 2, 0), (3, 3, 2, 0), (4, 4, 2, 1), (4, 4, 2, 1), (4, 4, 1, 0), (None, 4, 1, 1), (None, None, 2, 0), (None, None, 2, 0)], key=repr
    )
    kept = near_dup.drop_near_duplicates(docs(spark, rows), broadcast_bytes=limit).collect()
    assert sorted(((x.doc_id, x.text) for x in kept), key=repr) == sorted([(1, a), (1, b), (4, c), (4, None), (None, "x y z")], key=repr)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_across_finds_every_link_between_classes(spark, limit):
    """The prefix-filtered join gives a superset of the links between classes, and few other pairs."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    passage = r.choices(words, k=120)
    rows = []
    for k in range(60):  # texts that share a passage, and some near copies of them, of many sizes
        own = passage[: r.choice([30, 60, 120])] + r.choices(words, k=r.randint(5, 90))
        rows.append((10 * k, " ".join(own), "s"))
        for c in range(r.randint(0, 2)):
            copy = list(own) + own[: r.choice([0, 0, 40])]
            copy[r.randrange(len(copy))] = "changed"
            rows.append((10 * k + c + 1, " ".join(copy), "s"))
    bounds, h, c, _ = near_dup.shingles([t for _, t, _ in rows])
    of = {i: (h[bounds[k] : bounds[k + 1]], c[bounds[k] : bounds[k + 1]]) for k, (i, _, _) in enumerate(rows)}
    want = {(a, b) for a, b in itertools.combinations(sorted(of), 2) if near_dup.similarity(*of[a], *of[b]) >= 0.8}
    left = spark.createDataFrame([(i, i) for i in of], "id long, class_id long")
    texts = docs(spark, rows).select(F.col("doc_id").alias("id"), "text")
    got = {tuple(x) for x in near_dup.across(left, texts, 5, 0.8, limit).collect()}
    assert len(want) > 20 and want <= got and len(got) < 0.2 * len(rows) * (len(rows) - 1) / 2
    one = left.withColumn("class_id", F.lit(0).cast("long"))
    assert near_dup.across(one, texts, 5, 0.8, limit).isEmpty()


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(8)
    a, b = rng.choice(600, 400, replace=False).astype(np.uint64), rng.choice(600, 400, replace=False).astype(np.uint64)
    ha, hb = np.sort(near_dup._mix(a + np.uint64(1))), np.sort(near_dup._mix(b + np.uint64(1)))
    ca, cb = (ha % np.uint64(5) + np.uint64(1)).astype(np.int64), (hb % np.uint64(3) + np.uint64(1)).astype(np.int64)
    sig = near_dup.prob_minhash(np.array([0, 400, 800]), np.concatenate([ha, hb]), 1 + np.log2(np.concatenate([ca, cb])), 4000)
    wa, wb = dict(zip(ha.tolist(), 1 + np.log2(ca), strict=True)), dict(zip(hb.tolist(), 1 + np.log2(cb), strict=True))
    exact = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in {*wa, *wb}) for d in {*wa} & {*wb})
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    plain = len({*wa} & {*wb}) / len({*wa} | {*wb})
    assert math.isclose(near_dup.similarity(ha, ca, hb, cb), max(exact, plain))


# sharding


def test_sharding(spark):
    r = random.Random(9)
    rows = [(k, "x" * r.randint(0, 3000) + str(r.random()), "s") for k in range(3000)]
    rows += [(4000 + k, "same text " * 20, "s") for k in range(100)] + [(5000 + k, "big " * 500, "s") for k in range(900)] + [(-k, t, s) for k, (_, t, s) in enumerate(ODD, 1)]
    got = sharding.shard_report(docs(spark, rows), shards=24).collect()
    assert len(got) == len(rows) and {x.law for x in got} == {"bytes"} and {x.shard for x in got} == set(range(24))
    sizes, slots = {}, {}
    for x in got:
        sizes[x.shard] = sizes.get(x.shard, 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
    mean = sum(sizes.values()) / 24
    assert max(abs(v - mean) for v in sizes.values()) < 0.05 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({x.shard for x in got if 4000 <= (x.doc_id or 0) < 4100}) == 1
    text = {r[0]: (r[1] or "") for r in rows}
    assert all(x.size == len(text[x.doc_id].encode()) + 8 and x.text_crc32 == zlib.crc32(text[x.doc_id].encode()) for x in got)
    assert sharding.shard_report(docs(spark, [])).count() == 0


def brute_tree(points, shards, first, spans):
    """The k-d tree over (id, size, positions) with sorted lists; no group is placed by itself."""
    if shards == 1 or not points:
        return {p[0]: first for p in points}
    width = [(max(p[2][d] for p in points) - min(p[2][d] for p in points)) / spans[d] for d in range(3)]
    d, half = width.index(max(width)), shards // 2
    target, groups = sum(p[1] for p in points) * half / shards, {}
    for p in points:
        groups[p[2][d]] = groups.get(p[2][d], 0) + p[1]
    before, cut = 0, None
    for at in sorted(groups):
        if before + groups[at] >= target:
            cut = (at, before + groups[at] - target <= target - before)
            break
        before += groups[at]
    left = [p for p in points if p[2][d] < cut[0] or (p[2][d] == cut[0] and cut[1])]
    chosen = {p[0] for p in left}
    return brute_tree(left, half, first, spans) | brute_tree([p for p in points if p[0] not in chosen], shards - half, first + half, spans)


@pytest.mark.parametrize("shards", [2, 7, 24])
def test_sharding_cuts_at_the_medians_of_sorted_lists(spark, shards):
    r = random.Random(12)
    rows = [(k, r.choice(["é", "b"]) * r.randint(0, 200) + " " * r.randint(0, 30), "s") for k in range(1500)]
    points = sharding._points(docs(spark, rows), "doc_id", "text")
    known = [(p.id, p.size, [p[d] for d in sharding.DIMENSIONS]) for p in points.collect()]
    spans = [max(p[2][d] for p in known) - min(p[2][d] for p in known) for d in range(3)]
    tree = sharding.plan(points, shards, tolerance=1e9)
    assert {x.id: x.shard for x in tree.assigned(points, "shard").collect()} == brute_tree(known, shards, 0, spans)


def test_groups_of_equal_texts_stay_together(spark):
    """Forty groups of ten, twelve of a third of a shard, one of three fifths, and one that is larger than a shard."""
    r = random.Random(13)
    rows = [(k, "w " * r.randint(0, 300) + str(k), "s") for k in range(4000)]
    mean = sum(len(t) + 8 for _, t, _ in rows) / 20
    sizes = [*[10] * 40, *[int(mean / 3 / 408)] * 12, int(mean * 0.6 / 408), int(mean * 2.5 / 408)]
    copies = [(g, k) for g, n in enumerate(sizes) for k in range(n)]
    rows += [(10_000 + i, f"group {g:02d} " + "x" * 391, "s") for i, (g, _) in enumerate(copies)]
    got = {x.doc_id: x for x in sharding.shard_report(docs(spark, rows)).collect()}
    held = {}
    for i, (g, _) in enumerate(copies):
        held.setdefault(g, set()).add(got[10_000 + i].shard)
    assert all(len(held[g]) == 1 for g in range(len(sizes) - 1)) and len(held[len(sizes) - 1]) > 1
    total = {}
    for x in got.values():
        total[x.shard] = total.get(x.shard, 0) + x.size
    mean = sum(total.values()) / 24
    assert len(total) == 24 and max(abs(v - mean) for v in total.values()) < 0.02 * mean


def test_shards_are_written(spark, tmp_path):
    d = docs(spark, [(k, "y" * k, "s") for k in range(200)])
    sharding.write_shards(d, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {x.shard for x in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_written_shards_keep_a_column_named_shard(spark, tmp_path):
    d = docs(spark, [(k, "y" * k, "s") for k in range(50)]).withColumn("shard", F.concat(F.lit("own"), "doc_id"))
    sharding.write_shards(d, str(tmp_path / "out"), shards=2)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert all(x.shard == f"own{x.doc_id}" for x in back) and {x.shard_ for x in back} == {0, 1}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_with_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(got.columns) == columns and sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))


# time linear in the input


def took(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


def test_archives_are_read_in_linear_time():
    rng = np.random.default_rng(9)
    one = b"".join(warc.record(k, "http://a/", "00" * 20, rng.bytes(900)) for k in range(2000))
    assert sum(1 for _ in warc.read_records(one * 4)) == 8000
    big = warc.record(1, "http://a/", "00" * 20, rng.bytes(300_000)) + warc.record(2, "http://b/", "00" * 20, b"")
    assert [(m["Page-ID"], len(p)) for m, _, p in warc.read_records(big)] == [("1", 300_000), ("2", 0)]
    assert took(lambda: list(warc.read_records(one * 8))) < 2  # 16 MB


@pytest.mark.parametrize(
    "piece,end",
    [("<a ", ""), ("<a ", '">"'), ('<a "', ""), ('<a ">', '"'), ("<!a", ""), ("<b>", ""), ("<p><b>", "</div>"), ("<b>", "<hr>" * 50_000), ("<div>", "</p>" * 50_000), ("<i><div><b>", "</i>" * 50_000), ("<script>", ""), ("<li><b>", ""), ("<!--", ""), ("</", "")],
)
def test_broken_pages_are_parsed_in_linear_time(piece, end):
    page = lambda size: piece * (size // len(piece)) + end
    small, large = took(html_extract.content_text, page(250_000)), took(html_extract.content_text, page(1_000_000))
    assert large < 30 and large < 10 * small + 1


def test_unclosed_quotes_lose_no_text():
    assert html_extract.content_text('<body><a href="x>one</a><p>two</p></body>') == "one\ntwo"
    assert html_extract.content_text('<body><a title="a>b">one</a> 1 < 2 <p>two') == "one 1 < 2\ntwo"
