"""Byte-level BPE by prefix dynamic programming.

In the encoding of any prefix of a byte string the last token is unique: it is
the one token that ends there and may follow the last token of what comes before
it. Storing that token for every prefix gives the encoding by walking back, lets
text be appended exactly, and after an edit only prefixes behind the edit are
looked at again, until their tokens agree with what was stored.

Two tokens may stand side by side if replaying the merges on the right edge of
the first and on the left edge of the second, lowest rank first, never merges
across the border before both are whole.

``RankBPE`` is the plain form (one byte string at a time, with ``Encoding`` for
appends and edits); ``encode_many`` advances the prefixes of many short strings
together in numpy. Texts are cut by a pattern first and each match is encoded
separately; a match that is itself a token is that token.

Defined results: null or empty texts have no tokens; repeated rows encode alike.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import chunks
from tessera.llm.scratch import give_back, python_batches

_NONE = np.int32(2**31 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD1342543DE82EF95)
_SHORT = 40
#: Text that is cut at once; equal words of more text are encoded once, for some more memory.
RUN_CHARS = 1_000_000
#: Chunks that stay known from one such text to the next, twice as many at most.
REMEMBERED = 60_000
#: A pattern by which letters are one match with the space before them and ASCII marks behind them another (an
#: apostrophe may begin a longer one), and such chunks: they need not be cut by the pattern.
_LETTERS_THEN_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.longest = max(map(len, ranks))
        n = len(self.bytes_of)
        left, right = [-1] * n, [-1] * n
        self.reachable = [False] * n
        for b, r in ranks.items():
            if len(b) == 1:
                self.reachable[r] = True
                continue
            parts = self._merge(b, r)
            if len(parts) == 2:
                left[r], right[r] = parts
                self.reachable[r] = True
        self.right_edge = [self._edge(r, right) for r in range(n)]
        self.left_edge = [self._edge(r, left) for r in range(n)]
        self.ok: dict[tuple[int, int], bool] = {}

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain merging of ``data`` with ranks under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    @staticmethod
    def _edge(token: int, child: list[int]) -> list[int]:
        """The tokens that stand at one edge while ``token`` is merged, in order."""
        edge = [token]
        while child[edge[-1]] >= 0:
            edge.append(child[edge[-1]])
        return edge[::-1]

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.ok.get(key)
        if known is None:
            known = self.ok[key] = self._replay(a, b)
        return known

    def _replay(self, a: int, b: int) -> bool:
        x, y = self.right_edge[a], self.left_edge[b]
        i = j = 0
        never = len(self.bytes_of)
        while True:
            across = self.ranks.get(self.bytes_of[x[i]] + self.bytes_of[y[j]], never)
            next_a = x[i + 1] if i + 1 < len(x) else never
            next_b = y[j + 1] if j + 1 < len(y) else never
            if across < next_a and across <= next_b and across < never:
                return False
            if next_a == never and next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Store the last token of every prefix of ``data`` from ``len(last)`` to ``upto`` bytes."""
        ranks, reachable = self.ranks, self.reachable
        for end in range(len(last), upto + 1):
            for n in range(1, min(self.longest, end) + 1):
                t = ranks.get(data[end - n : end])
                if t is not None and reachable[t] and (n == end or self.may_follow(last[end - n], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the ranks lack a single byte")

    def walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(data, last, len(data))
        return self.walk(last)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class Encoding:
    """One byte string with the last token of each of its prefixes."""

    def __init__(self, bpe: RankBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.bpe.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start .. end; returns how many prefixes were looked at again."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        self.bpe.extend(self.data, self.last, start + len(new))
        looked, run = len(new), 0
        while len(self.last) <= len(self.data):
            at = len(self.last)
            self.bpe.extend(self.data, self.last, at)
            looked += 1
            # as many equal tokens as the longest token has bytes: nothing further back can matter
            run = run + 1 if self.last[at] == old[at - shift] else 0
            if run >= self.bpe.longest:
                self.last += old[at - shift + 1 :]
                break
        return looked

    @property
    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class ManyBPE:
    """The same encoding for many short byte strings at once."""

    def __init__(self, bpe: RankBPE):
        self.bpe = bpe
        n = len(bpe.bytes_of)
        depth = max(map(len, bpe.right_edge + bpe.left_edge)) + 1
        self.right = np.full((n, depth), _NONE, dtype=np.int32)
        self.left = np.full((n, depth), _NONE, dtype=np.int32)
        for r in range(n):
            self.right[r, : len(bpe.right_edge[r])] = bpe.right_edge[r]
            self.left[r, : len(bpe.left_edge[r])] = bpe.left_edge[r]
        pairs = {}
        for b, r in bpe.ranks.items():
            for i in range(1, len(b)):
                x, y = bpe.ranks.get(b[:i]), bpe.ranks.get(b[i:])
                if x is not None and y is not None:
                    pairs[x << 20 | y] = r
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()] or [0], dtype=np.int32)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SHORT + 1, _BASE)]), dtype=np.uint64)
        usable = [(b, r) for b, r in bpe.ranks.items() if bpe.reachable[r] and len(b) <= _SHORT]
        hashes = np.array([self._hash(b) for b, _ in usable], dtype=np.uint64)
        ids = np.array([r for _, r in usable], dtype=np.int32)
        slots = (hashes * _MIX) >> np.uint64(43)
        order = np.argsort(slots, kind="stable")
        lone = np.ones(len(order), dtype=bool)
        same = slots[order][1:] == slots[order][:-1]
        lone[1:] &= ~same
        lone[:-1] &= ~same
        self.table, self.check = np.full(1 << 21, -1, dtype=np.int32), np.zeros(1 << 21, dtype=np.uint64)
        one, more = order[lone], order[~lone]
        self.table[slots[one]], self.check[slots[one]] = ids[one], hashes[one]
        self.table[slots[more]] = -2  # several tokens share the slot: they are searched
        self.shared = hashes[more][np.argsort(hashes[more])]
        self.shared_ids = ids[more][np.argsort(hashes[more])]
        self.sizes = np.array([len(b) for b in bpe.bytes_of], dtype=np.int64)
        self.memo_keys = np.full(1 << 20, -1, dtype=np.int64)
        self.memo = np.zeros(1 << 20, dtype=bool)

    def _hash(self, data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * int(_BASE) + b + 1) & (2**64 - 1)
        return h

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes * _MIX) >> np.uint64(43)
        found = self.table[slot]
        some = np.flatnonzero(found >= 0)
        found[some[self.check[slot[some]] != hashes[some]]] = -1
        many = np.flatnonzero(found == -2)
        if len(many):
            at = np.minimum(np.searchsorted(self.shared, hashes[many]), len(self.shared) - 1)
            found[many] = np.where(self.shared[at] == hashes[many], self.shared_ids[at], -1)
        return found

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        slot = (key * 0x2545F4914F6CDD1D >> 41) & 0xFFFFF
        out = self.memo[slot]
        miss = np.flatnonzero(self.memo_keys[slot] != key)
        if len(miss):
            out[miss] = self._replay(a[miss], b[miss])
            self.memo_keys[slot[miss]], self.memo[slot[miss]] = key[miss], out[miss]
        return out

    def _replay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(a)
        out = np.ones(n, dtype=bool)
        live, i, j = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        while len(live):
            x, y = self.right[a[live], i[live]], self.left[b[live], j[live]]
            key = x.astype(np.int64) << 20 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)
            next_a, next_b = self.right[a[live], i[live] + 1], self.left[b[live], j[live] + 1]
            bad = (across < next_a) & (across <= next_b) & (across < _NONE)
            out[live[bad]] = False
            on = ~bad & ~((next_a == _NONE) & (next_b == _NONE))
            step_a = on & (next_a <= next_b)
            i[live[step_a]] += 1
            j[live[on & ~step_a]] += 1
            live = live[on]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece, four bytes each."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, whole in enumerate(map(self.bpe.ranks.get, pieces)):
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(pieces[k]) <= _SHORT:
                short.append(k)
            else:
                out[k] = np.array(self.bpe.encode_piece(pieces[k]), dtype="<u4").tobytes()
                if len(self.bpe.ok) > 500_000:
                    self.bpe.ok.clear()
        short.sort(key=lambda k: -len(pieces[k]))
        for lo in range(0, len(short), 20_000):
            part = short[lo : lo + 20_000]
            for k, ids in zip(part, self._encode_short([pieces[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _encode_short(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces])  # descending
        width = int(lengths[0])
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(len(pieces), width).T.astype(np.uint64)
        prefix = np.zeros((width + 1, len(pieces)), dtype=np.uint64)
        last = np.full((width + 1, len(pieces)), -1, dtype=np.int32)
        longest = min(self.bpe.longest, width)
        for end in range(1, width + 1):
            prefix[end] = prefix[end - 1] * _BASE + data[end - 1] + np.uint64(1)
            open_ = np.arange(int(np.searchsorted(-lengths, -end, side="right")))
            for n in range(1, min(longest, end) + 1):
                token = self._find(prefix[end][open_] - prefix[end - n][open_] * self.powers[n])
                hit = np.flatnonzero(token >= 0)
                if len(hit) and n < end:
                    hit = hit[self._may_follow(last[end - n][open_[hit]], token[hit])]
                if len(hit):
                    last[end][open_[hit]] = token[hit]
                    open_ = np.delete(open_, hit)
                    if not len(open_):
                        break
        # walk back from the ends of all pieces together; ids fill the rows from the right
        ids = np.zeros((len(pieces), width), dtype="<u4")
        at, live, place = lengths.copy(), np.arange(len(pieces)), width
        while len(live):
            place -= 1
            token = last[at[live], live]
            ids[live, place] = token
            at[live] -= self.sizes[token]
            ended = at[live] == 0
            lengths[live[ended]] = width - place  # from here on the number of ids
            live = live[~ended]
        raw, row = ids.tobytes(), 4 * width
        return [raw[end - 4 * n : end] for end, n in zip(range(row, len(raw) + 1, row), lengths.tolist(), strict=True)]


def _odd(chunk: str) -> bool:
    """Whether white space meets the space at which the text was cut."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


def _joined(items: pa.LargeBinaryArray, of: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of items[of[0]], items[of[1]], ... one after the other, cut behind the first ``ends[0]`` of them and so on."""
    taken = items.take(pa.array(of))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[taken.offset :]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at[np.concatenate([[0], ends])].tobytes()), data])


class TextEncoder:
    """Whole texts, batch by batch. Matches never cross a space that stands between
    two other characters, so a text is cut there and equal chunks are encoded once."""

    def __init__(self, rank_path: str, pattern: str, run_chars: int = RUN_CHARS, remembered: int = REMEMBERED):
        self.bpe = RankBPE(load_ranks(rank_path))
        self.many = ManyBPE(self.bpe)
        self.find = regex.compile(pattern).findall
        self.plain = pattern == _LETTERS_THEN_MARKS
        self.chunks = chunks.Recent(remembered)
        self.run_chars = run_chars
        self.decimal = pa.array([b"%d," % i for i in range(len(self.bpe.bytes_of))], pa.large_binary())
        self.bytes_of = pa.array(self.bpe.bytes_of, pa.large_binary())

    def _cut(self, text: str) -> list[str]:
        word = _WORD(text) if self.plain else None
        if word is None:
            return self.find(text)
        return [word[1], word[2]] if word[2] else [text]

    def _encode_pieces(self, texts: list[str]) -> list[bytes]:
        cut = list(map(self._cut, texts))
        need = list({p for ps in cut for p in ps})
        of = dict(zip(need, self.many.encode([p.encode() for p in need]), strict=True))
        return [of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps]) for ps in cut]

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """bounds (of each text's chunks), codes (of all chunks), the ids of each code."""
        bounds, codes, different = chunks.cut(texts)
        known = self.chunks.get_all(different)
        new = [i for i, ids in enumerate(known) if ids is None]
        odd = {i for i in new if not _WORD(different[i]) and _odd(different[i])}
        new = [i for i in new if i not in odd]
        coded = self._encode_pieces([" " + different[i] for i in new])
        for i, ids in zip(new, coded, strict=True):
            known[i] = ids
        kept = [k for k, i in enumerate(new) if len(different[i]) <= 100]
        self.chunks.put_all([different[new[k]] for k in kept], [coded[k] for k in kept])
        # a text's first chunk has no space before it
        first = bounds[:-1]
        heads, place = np.unique(codes[first], return_inverse=True)
        codes = codes.astype(np.int64)
        codes[first] = len(known) + place
        head_texts = [different[k] for k in heads.tolist()]
        known += self._encode_pieces(head_texts)
        # texts in which white space meets a space are cut as a whole
        meets = np.zeros(len(known), dtype=bool)
        meets[sorted(odd)] = True
        meets[len(different) :] = list(map(_odd, head_texts))
        whole = meets[codes]
        whole[first[np.diff(bounds) == 1]] = False
        rows = np.flatnonzero(np.logical_or.reduceat(whole, first)) if len(first) else []
        for i in odd:
            known[i] = b""
        if len(rows):
            nothing = len(known)
            for k, i in enumerate(rows):
                codes[bounds[i] : bounds[i + 1]] = nothing
                codes[bounds[i]] = nothing + 1 + k
            known += [b"", *self._encode_pieces(texts.take(pa.array(rows)).to_pylist())]
        return bounds, codes, known

    def batch(self, texts: pa.Array) -> Iterator[list[int]]:
        """For every text its ids."""
        for a, b in chunks.runs(texts, self.run_chars):
            bounds, codes, known = self._run(texts[a:b])
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield np.frombuffer(b"".join([known[c] for c in codes[lo:hi].tolist()]), dtype="<u4").tolist()

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        return self.batch(pa.array(texts, pa.string()))

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """For every text the number of its ids, and the hashes of their decimals and of the bytes that they decode to.
        Ids are written and decoded once for each different chunk."""
        n: list[int] = []
        hashes: tuple[list[str], list[str]] = ([], [])
        for a, b in chunks.runs(texts, self.run_chars):
            bounds, codes, known = self._run(texts[a:b])
            ends = np.cumsum(np.fromiter(map(len, known), dtype=np.int64, count=len(known))) // 4
            ids = np.frombuffer(b"".join(known), dtype="<u4")
            n += np.diff(np.concatenate([[0], np.cumsum(np.diff(ends, prepend=0)[codes])])[bounds]).tolist()
            for tokens, comma, out in ((self.decimal, 1, hashes[0]), (self.bytes_of, 0, hashes[1])):
                rows = _joined(_joined(tokens, ids, ends), codes, bounds[1:])
                _, offsets, data = rows.buffers()
                at, view = np.frombuffer(offsets, dtype=np.int64).tolist(), memoryview(data or b"")
                out += [hashlib.sha256(view[lo : max(lo, hi - comma)]).hexdigest() for lo, hi in zip(at[:-1], at[1:], strict=True)]
        return n, *hashes


def _digests(rank_path: str, pattern: str, run_chars: int = RUN_CHARS, remembered: int = REMEMBERED):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = TextEncoder(rank_path, pattern, run_chars, remembered)
        gc.disable()  # millions of objects without cycles
        for batch in batches:
            n, of_ids, of_bytes = encoder.digests(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del encoder
        give_back()

    return run


def encode_digest(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", run_chars: int = RUN_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to)."""
    python_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_digests(rank_path, pattern, run_chars, remembered), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode_ids(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and its token ids."""
    python_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(rank_path, pattern)
        for batch in batches:
            ids = list(encoder.batch(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
