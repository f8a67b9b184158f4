"""Texts cut at single spaces, and tokens remembered by chunk.

Both tokenizers treat a text as words that do not affect each other across a
space, so a batch is cut once, equal chunks are found with Arrow, and each
different chunk is tokenized once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Recent:
    """A dictionary of bounded size that keeps what was used lately: entries not
    asked for while ``size`` newer ones came are forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        hit = self.new.get(key)
        if hit is None:
            hit = self.old.get(key)
            if hit is not None:
                self.put(key, hit)
        return hit

    def get_all(self, keys: list) -> list:
        """``get`` of every key; most are found without a call of their own."""
        found = list(map(self.new.get, keys))
        if self.old:
            for i, hit in enumerate(found):
                if hit is None:
                    found[i] = self.get(keys[i])
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def put_all(self, keys: list, values: list) -> None:
        """``put`` of every key, in stretches that fit."""
        at = 0
        while at < len(keys):
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            room = self.size - len(self.new)
            self.new.update(zip(keys[at : at + room], values[at : at + room], strict=True))
            at += room


def runs(texts: pa.Array, chars: int = 1_000_000) -> list[tuple[int, int]]:
    """Stretches of a batch that hold about so many bytes of text, so that a batch of
    very long texts needs no more memory than one of short ones."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out, start, held = [], 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > chars:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(size))] if len(size) else []


def stretches(batches: Iterable[pa.RecordBatch], column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in batches of about so many bytes of text: short ones are joined, long ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for lo, hi in runs(batch.column(column), chars):
            part = batch.slice(lo, hi - lo)
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > chars:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """bounds (of each text's chunks), codes (of all chunks), chunks (the different ones)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return bounds - bounds[0], flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_numpy(zero_copy_only=False).tolist()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs start .. start + length, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
