"""Token ids in binary files under a canonical, length-limited Huffman code.

One code serves the whole corpus: ids are counted over all documents, code
lengths limited to ``MAX_BITS`` come from package-merge, and codes are canonical,
so a file holds lengths only. A file keeps its documents in ascending id order;
the ids of all of them run on in blocks of ``BLOCK`` tokens, and the bit length
of each block is stored, so that a reader can start at any block. Decoding looks
the next ``MAX_BITS`` bits up in a table and advances all blocks of a file together.

File: magic, eight little-endian longs (documents, tokens, blocks, first start,
vocabulary size, bytes of packed code lengths, words of payload, block size), document ids (int64),
null marks (uint8), tokens per document (int64), bits per block (uint32),
zlib-packed code lengths (uint8 each), payload (big-endian uint32 words).

Defined results: null or empty texts hold the end id alone; null ids come first;
repeated ids follow each other, in an order that their token ids decide; no documents, no files.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chunks
from tessera.llm.scratch import give_back, make_folder, new_path, python_batches, release, stored

MAX_BITS = 20
BLOCK = 1024
TOKENS_PER_FILE = 1 << 22
MAGIC = b"TSHUFF01"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    counts = np.asarray(counts, dtype=np.float64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    levels = []  # each level: its items sorted by weight; True marks a leaf
    weights, is_leaf = leaves, np.ones(n, dtype=bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        place = np.argsort(merged, kind="stable")
        weights, is_leaf = merged[place], place < n
        levels.append(is_leaf)
    take, total = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(levels):
        leaf_count = int(is_leaf[:take].sum())
        total[:leaf_count] += 1
        take = 2 * (take - leaf_count)
    lengths[order] = total
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, bits = 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[symbol]:
            code <<= int(lengths[symbol]) - bits
            bits = int(lengths[symbol])
            codes[symbol] = code
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """symbol and length for every value of the next ``bits`` bits."""
    bits = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (bits - lengths[order].astype(np.int64))
    fill = (1 << bits) - int(span.sum())
    symbols = np.concatenate([np.repeat(order, span), np.zeros(fill, dtype=order.dtype)]).astype(np.uint32)
    sizes = np.concatenate([np.repeat(lengths[order], span), np.ones(fill, dtype=np.uint8)])
    return symbols, sizes, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each block, payload words) for a run of ids."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    start = end - size
    value = codes[ids] << (np.uint64(64) - size.astype(np.uint64) - (start & 31).astype(np.uint64))
    words = total // 32 + 2
    out = np.bincount(start >> 5, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words)
    out += np.bincount((start >> 5) + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)[:words] if total else 0
    edges = np.append(start[::block], total) if total else np.zeros(1, dtype=np.int64)
    return np.diff(edges).astype("<u4"), out.astype(np.uint64).astype(">u4")


def unpack(bits: np.ndarray, words: np.ndarray, tokens: int, lengths: np.ndarray, block: int = BLOCK, first: int = 0) -> np.ndarray:
    """The ids again, from block ``first`` on."""
    blocks = len(bits)
    if blocks <= first:
        return np.zeros(0, dtype=np.uint32)
    symbols, sizes, peek = decode_table(lengths)
    at = (np.cumsum(bits.astype(np.int64)) - bits)[first:].copy()
    w = np.append(words.astype(np.uint64), np.uint64(0))
    out = np.zeros((blocks - first, block), dtype=np.uint32)
    left = tokens - (blocks - 1) * block
    for step in range(block):
        live = slice(0, len(at) if step < left else len(at) - 1)
        o = at[live]
        if not len(o):
            break
        i = o >> 5
        both = (w[i] << np.uint64(32)) | w[i + 1]
        key = (both << (o & 31).astype(np.uint64)) >> np.uint64(64 - peek)
        out[live, step] = symbols[key]
        o += sizes[key]
    return out.reshape(-1)[: tokens - first * block]


def write_file(doc_ids: list, sizes: list[int], ids: np.ndarray, start: int, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> bytes:
    bits, words = pack(ids, codes, lengths, block)
    table = zlib.compress(lengths.tobytes())
    head = np.array([len(doc_ids), len(ids), len(bits), start, len(lengths), len(table), len(words), block], dtype="<i8")
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), nulls.tobytes(), np.array(sizes, dtype="<i8").tobytes(), bits.tobytes(), table, words.tobytes()])


def read_file(data: bytes) -> tuple[list, np.ndarray, int, np.ndarray]:
    """(document ids, tokens per document, first start, all ids)."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, blocks, start, _, packed, words, block = np.frombuffer(data, dtype="<i8", count=8, offset=8).tolist()
    at = 72

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += x.nbytes
        return x

    keys, nulls, sizes, bits = part("<i8", docs), part("u1", docs), part("<i8", docs), part("<u4", blocks)
    lengths = np.frombuffer(zlib.decompress(data[at : at + packed]), dtype=np.uint8)
    at += packed
    ids = unpack(bits, part(">u4", words), tokens, lengths, block)
    return [None if n else k for k, n in zip(keys.tolist(), nulls.tolist(), strict=True)], sizes, start, ids


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder whole or not at all."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    part = posixpath.join(path, f".{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, posixpath.join(path, name))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Words that normalizing leaves in one piece: Latin letters below U+0250, none of which composes with or splits
#: into another character, and all of which have a lower case of one character (U+0130 has not); and the ASCII
#: marks behind them, which are a word of their own (an apostrophe may begin a longer one).
_LATIN_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,60})([!-&(-/:-@\\[-`{-~]{0,8})").fullmatch


#: By code point below U+0250, whether it is such a letter; the last stands for all from there on.
_LATIN = np.array([bool(_LATIN_WORD(chr(c))) for c in range(0x250)] + [False])


def _latin(chunk_list: list[str]) -> np.ndarray:
    """Which chunks are words of such letters alone."""
    length = np.fromiter(map(len, chunk_list), dtype=np.int64, count=len(chunk_list))
    code = np.frombuffer("".join(chunk_list).encode("utf-32-le"), dtype="<u4")
    good = np.concatenate([[0], np.cumsum(_LATIN[np.minimum(code, len(_LATIN) - 1)])])
    ends = np.cumsum(length)
    return (length > 0) & (length <= 60) & (good[ends] - good[ends - length] == length)


#: Marks that are split off the letter before them. A special token may hold any of <, | and >, an apostrophe may begin a word.
_MARKS = "!-&(-/:;=?@\\[-`{}~"

#: Rows whose letters keep their case until the tokenizer has them: special tokens are found before case is folded, and
#: marks may compose with a letter of one case alone.
_CASE_MATTERS = "<\\||[\u0300-\u036f]"


class ChunkEncoder:
    """Ids of chunks between spaces. A chunk of Latin letters alone, perhaps with a few ASCII
    marks behind them, goes to the tokenizer's model as the word that its normalizer and splitter
    would make of it, and its marks are looked up; any other chunk goes through the whole tokenizer.
    Special tokens that a text spells out get their ids, as the library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, letters = self.tokenizer.model, _byte_letters()
        self.letters = np.array([10 if b == 10 else ord(letters[b]) for b in range(256)], dtype="<u2")  # line feeds stay: they stand between words
        self.tails = {"": b""}
        self.direct = True
        probe = ["The", "straße,", "éÉ.", "Ñandú", "x", "ŸĐǄ", "ſƿ", "A***", "é$%<|>", *(f"a{chr(c)}" for c in range(33, 127) if _LATIN_WORD(f"a{chr(c)}"))]
        self.direct = self(probe) == self._whole(probe)  # else everything goes through the tokenizer
        self.breaks_as_spaces = len(set(self._whole(["a. B", "a.\nB", "a.\n\nB", "a. \n B"]))) == 1  # line feeds are white space like any other
        apart = [("ab, CD. e", "ab , CD . e"), ("A'S, b", "A'S , b"), *((f"aB{m} c", f"aB {m} c") for c in map(chr, range(33, 127)) if re.match(f"[{_MARKS}]", c) for m in (c, f".{c}", c * 3))]
        self.stops_apart = all(len(set(self._whole(list(pair)))) == 1 for pair in apart)  # marks after a letter are a word
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folds_case = len(set(self._whole(["ABC Defg X'S", "abc defg x's"]))) == 1 and all(t.startswith("<|") for t in added)

    def prepared(self, text: pa.Array) -> pa.Array:
        """Texts of the same ids with fewer different chunks."""
        if self.breaks_as_spaces:
            text = pc.replace_substring(text, "\n", " ")
        if self.stops_apart:
            text = pc.replace_substring_regex(text, pattern=f"([A-Za-z])([{_MARKS}]+) ", replacement=r"\1 \2 ")
        if self.folds_case:
            text = pc.if_else(pc.match_substring_regex(text, _CASE_MATTERS), text, pc.ascii_lower(text))
        return text

    def _whole(self, chunk_list: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunk_list, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """How many ids each word of Latin letters has, and all ids: words are folded and brought to the letters of bytes all together."""
        raw = np.frombuffer("\n".join(words).lower().encode(), dtype=np.uint8)
        tokenize, sizes, ids = self.model.tokenize, [], array("I")
        spelled = self.letters[raw].tobytes().decode("utf-16-le").split("\n")
        for lo in range(0, len(spelled), 500):  # few tokens are held at once: the garbage collector looks at what stays
            tokens = list(map(tokenize, spelled[lo : lo + 500]))
            sizes += map(len, tokens)
            ids.extend([t.id for x in tokens for t in x])
        return sizes, np.frombuffer(ids, dtype="<u4")

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            ids = self.tails[marks] = self._whole([marks])[0]
        return ids

    def runs(self, chunk_list: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each chunk start, how many they are, and all ids."""
        sizes, starts = np.zeros(len(chunk_list), dtype=np.int64), np.zeros(len(chunk_list), dtype=np.int64)
        plain = _latin(chunk_list) if self.direct else np.zeros(len(chunk_list), dtype=bool)
        at = np.flatnonzero(plain)
        counted, ids = self._words([chunk_list[i] for i in at.tolist()]) if len(at) else ([], np.zeros(0, dtype="<u4"))
        sizes[at] = counted
        starts[at] = np.cumsum(sizes[at]) - sizes[at]
        marked, rest = [], []
        for i in np.flatnonzero(~plain).tolist():
            part = _LATIN_WORD(chunk_list[i]) if self.direct else None
            marked.append((i, *part.groups())) if part else rest.append(i)
        others: list[tuple[int, bytes]] = []
        if marked:
            counted, flat = self._words([word for _, word, _ in marked])
            ends = np.cumsum(counted).tolist()
            others += [(i, flat[e - n : e].tobytes() + self._tail(marks)) for (i, _, marks), e, n in zip(marked, ends, counted, strict=True)]
        for lo in range(0, len(rest), 20_000):
            others += zip(rest[lo : lo + 20_000], self._whole([chunk_list[i] for i in rest[lo : lo + 20_000]]), strict=True)
        if others:
            where = [i for i, _ in others]
            sizes[where] = [len(x) // 4 for _, x in others]
            starts[where] = len(ids) + np.cumsum(sizes[where]) - sizes[where]
            ids = np.concatenate([ids, np.frombuffer(b"".join(x for _, x in others), dtype="<u4")])
        return starts, sizes, ids

    def __call__(self, chunk_list: list[str]) -> list[bytes]:
        starts, sizes, ids = self.runs(chunk_list)
        return [ids[a:b].tobytes() for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]


class KnownRuns:
    """Ids of the chunks met lately: a chunk has a number, a number a run of ids. If more than ``size`` chunks would be
    known, those are forgotten that were met only once, and if that is not half of them, all but those asked for just then."""

    def __init__(self, encoder: ChunkEncoder, size: int, kind: str = "<u4"):
        self.encoder, self.size = encoder, size
        self.number: dict[str, int] = {}  # in the order of the numbers
        self.starts, self.sizes, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
        self.again = np.zeros(0, dtype=bool)

    def _forget(self, numbers: np.ndarray) -> np.ndarray:
        """Keep what was met again; the new numbers."""
        known = numbers[numbers >= 0]
        if 2 * np.count_nonzero(self.again) > self.size:
            self.again[:] = False
            self.again[known] = True
        kept = np.flatnonzero(self.again)
        self.number = {k: i for i, k in enumerate(compress(self.number, self.again.tolist()))}
        self.ids = self.ids[chunks.gather(self.starts[kept], self.sizes[kept])]
        self.sizes = self.sizes[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
        place = np.append(np.cumsum(self.again) - 1, -1)
        self.again = np.zeros(len(kept), dtype=bool)
        return place[numbers]

    def __call__(self, chunk_list: list[str]) -> np.ndarray:
        """The numbers of different chunks, good until the next call."""
        numbers = np.fromiter(map(self.number.get, chunk_list, repeat(-1)), dtype=np.int64, count=len(chunk_list))
        new = np.flatnonzero(numbers < 0)
        self.again[numbers[numbers >= 0]] = True
        if len(new) and len(self.number) + len(new) > self.size:
            numbers = self._forget(numbers)
        if len(new):
            fresh = [chunk_list[i] for i in new.tolist()]
            starts, sizes, ids = self.encoder.runs(fresh)
            numbers[new] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip(fresh, numbers[new].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, starts + len(self.ids)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
            self.again = np.concatenate([self.again, np.zeros(len(new), dtype=bool)])
        return numbers


#: What this Python worker knows of the tokenizer it used last, from one task to the next.
_LAST: dict[tuple[str, str], KnownRuns] = {}


def _known_runs(path: str, kind: str) -> KnownRuns:
    if (path, kind) not in _LAST:
        _LAST.clear()
        _LAST[path, kind] = KnownRuns(ChunkEncoder(path), 400_000, kind)
    return _LAST[path, kind]


def _forget_runs() -> None:
    if _LAST:
        _LAST.clear()
        give_back()


def id_kind(path: str, end_id: int) -> str:
    """The width in which ids travel: two bytes if the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"


def _tokenize(path: str, end_id: int, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known_runs(path, kind)
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in chunks.stretches(batches, "text", 4_000_000):
            text = batch.column("text")
            bounds, codes, different = chunks.cut(known.encoder.prepared(text))
            number = known(different)[codes]
            each = known.sizes[number]
            ids = known.ids[chunks.gather(known.starts[number], each)]
            edge = np.concatenate([[0], np.cumsum(each)])[bounds]
            rows = [ids[a:b].tobytes() + end for a, b in zip(edge[:-1], edge[1:], strict=True)]
            spread = pa.array(map(zlib.crc32, rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(edge) + 1, pa.int64()), spread, pa.array(rows, pa.binary())], ["id", "n", "spread", "ids"])

    return run


def _count(kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_runs()
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for a, b in chunks.runs(batch.column("ids")):
                x = np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(a, b - a).to_pylist()), dtype=kind))
                if len(x) > len(total):
                    x, total = total, x
                total[: len(x)] += x
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    return run


def _write(folder: str, bases: dict[int, int], lengths: np.ndarray, per_file: int, block: int, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        bucket, part, start = None, 0, 0
        keys: list = []
        sizes: list[int] = []
        held: list[bytes] = []
        written = pending = 0

        def flush() -> int:
            nonlocal part, start, pending
            if not keys:
                return 0
            ids = np.frombuffer(b"".join(held), dtype=kind)
            put_file(folder, f"{bucket:07d}-{part:05d}.huf", write_file(keys, sizes, ids, start, lengths, codes, block))
            part, start, pending = part + 1, start + len(ids), 0
            for x in (keys, sizes, held):
                x.clear()
            return 1

        for batch in batches:
            for b, key, n, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "n", "ids")), strict=True):
                if b != bucket:
                    written += flush()
                    bucket, part, start = b, 0, bases[b]
                keys.append(key)
                sizes.append(n)
                held.append(ids)
                pending += n
                if pending >= per_file:
                    written += flush()
        written += flush()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])

    return run


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokens_per_file: int = TOKENS_PER_FILE, block: int = BLOCK, folder: str | None = None
) -> str:
    """Encode every text and write token files in ascending id order; returns their folder."""
    spark = docs.sparkSession
    python_batches(spark)
    folder = make_folder(spark, folder or new_path(spark, "tokens"))
    kind = id_kind(tokenizer_path, end_id)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tokens = ids = stored(rows.mapInArrow(_tokenize(tokenizer_path, end_id, kind), "id long, n long, spread long, ids binary"), "ids")
    counted = tokens.select("ids").mapInArrow(_count(kind), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one row for each id of the vocabulary
    if not counted:
        return folder
    counts = np.zeros(max(r.token for r in counted) + 1)
    for r in counted:
        counts[r.token] = r.n
    tokens = tokens.select(_bucket(tokens, int(counts.sum()) / tokens_per_file).alias("bucket"), "id", "n", "ids")
    bases, start = {}, 0
    for b, n in sorted((r.bucket, r.n) for r in tokens.groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # one row for each bucket
        bases[b], start = start, start + n
    dealt = tokens.repartitionById(max(bases) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "ids")
    dealt.mapInArrow(_write(folder, bases, code_lengths(counts), tokens_per_file, block, kind), "files long").agg(F.sum("files")).collect()
    release(ids)
    return folder


def _bucket(tokens: DataFrame, wanted: float) -> Column:
    """The number of a row's bucket: ascending ids, about ``wanted`` buckets of equal numbers of rows, each written
    by one task. An id (or null) so common that it fills buckets by itself has its rows dealt over them by hash."""
    wanted = max(1, min(100_000, round(wanted)))
    if wanted == 1:
        return F.lit(0).cast("long")
    rows, nulls = tokens.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    base = max(1, round(wanted * nulls / rows))
    quantiles = tokens.filter("id is not null").approxQuantile("id", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if nulls < rows else []
    often = sorted(Counter(int(x) for x in quantiles).items())
    edges, parts = np.array([e for e, _ in often], dtype=np.int64), np.array([n for _, n in often], dtype=np.int64)
    first = base + 1 + np.cumsum(parts) - parts  # the first bucket of each edge

    @F.pandas_udf("long")
    def bucket(ids: pd.Series, known: pd.Series, hashes: pd.Series) -> pd.Series:
        key, spread = ids.to_numpy(), hashes.to_numpy()
        at = np.searchsorted(edges, key, side="right") - 1
        place = np.maximum(at, 0)
        out = np.full(len(key), base, dtype=np.int64)
        if len(edges):
            out = np.where(at < 0, base, first[place] + np.where(edges[place] == key, spread % parts[place], parts[place] - 1))
        return pd.Series(np.where(known.to_numpy(), out, spread % base))

    return bucket(F.coalesce("id", F.lit(0)), F.col("id").isNotNull(), F.col("spread"))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            keys, sizes, start, ids = read_file(data.as_py())
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read_digest(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.huf").load(folder).select("content")
    return files.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def _read_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            keys, sizes, start, ids = read_file(data.as_py())
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - sizes, pa.int64()), lists], ["id", "start", "ids"])


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, ids of every document in the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.huf").load(folder).select("content")
    return files.mapInArrow(_read_ids, "id long, start long, ids array<int>").withColumnRenamed("id", id_col)
