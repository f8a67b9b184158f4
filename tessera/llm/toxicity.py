"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on what sets toxic documents apart,
one on ordinary text. A window (``window_words`` words) is compressed with each;
the bytes that the toxic dictionary saves over the ordinary one are its gain. A
logistic model, fitted on rows that trained no dictionary, turns the gains of a
document's windows into thresholds and a score.

The ordinary dictionary is trained on all words of the ordinary rows. The toxic text
is not whole documents, as those are ordinary but for a few words, and dictionaries of
whole texts tell the classes apart badly (figures in the README). It is what the
G-test of word beginnings (4 to 6 characters, and whole words) over different texts
finds far commoner in toxic than in ordinary documents: the method as dealt is
changed here, and the compression compares words with what was found. Each window stands between two fixed strings: zstandard starts no
match in its last 8 bytes, and gives up on windows that shrink too little.

The fit takes at most ``max_toxic`` and ``max_ordinary`` labelled rows, those of
the smallest hash, and collects their texts to the driver; every document is scored over its whole text.

Defined results: null or empty texts score as a text without windows; without
rows of both classes to learn from every score is 0; repeated rows score alike;
a document labelled twice counts as toxic if any label says so.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import python_batches

MAX_TOXIC, MAX_ORDINARY = 2500, 5000
TOXIC_BYTES, ORDINARY_BYTES = 4096, 32768
THRESHOLD = 0.7
_LEAD, _TAIL = bytes(range(33, 97)), b"0123456789"
_STARTS = (4, 5, 6)
_CACHE = 200_000


def _words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _windows(text: str | None, size: int) -> list[str]:
    words = _words(text)
    return words if size == 1 else [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def _beginnings(word: str) -> list[str]:
    word = f" {word} "
    return [word, *(word[:k] for k in _STARTS if len(word) > k)]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]
    means: list[float]
    scales: list[float]
    window_words: int = 1


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=16, chain_log=14, hash_log=15, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_DFAST,
    )
    d = zstandard.ZstdCompressionDict(dictionary + _LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Gains:
    """Bytes saved per window, remembered for windows seen lately."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.seen: dict[str, int] = {}

    def __call__(self, windows: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > _CACHE:
            seen.clear()
        out = [seen.get(w) for w in windows]
        if None in out:
            for i, g in enumerate(out):
                if g is None:
                    w = windows[i]
                    if w not in seen:
                        raw = _LEAD + f" {w} ".encode() + _TAIL
                        seen[w] = len(self.ordinary.compress(raw)) - len(self.toxic.compress(raw))
                    out[i] = seen[w]
        return np.array(out, dtype=np.int32)


def features(windows: list[str], gains: np.ndarray) -> list[float]:
    n = len(gains)
    if not n:
        return [0.0] * 12
    top = np.sort(gains)[::-1][:3]
    over = [int((gains >= k).sum()) for k in (2, 3, 4, 5)]
    kinds = len({windows[i] for i in np.flatnonzero(gains >= 3)})
    first = max(int(top[0]), 0)
    return [
        first, float(top.mean()), float(first >= 3), float(first >= 5), math.log1p(n),
        *(math.log1p(x) for x in over), math.log1p(1000 * over[1] / n), math.log1p(1000 * over[3] / n), math.log1p(kinds),
    ]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-size:]


def _marks(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Word beginnings far commoner in toxic than in ordinary documents."""
    counts = []
    for texts in (toxic, ordinary):
        counts.append(Counter(b for t in texts for b in {b for w in set(_words(t)) for b in _beginnings(w)}))
    nt, no = len(toxic), len(ordinary)
    found = set()
    for mark, x in counts[0].items():
        y = counts[1][mark]
        expected = (x + y) * nt / (nt + no)
        if x >= 3 and x * no > 6 * y * nt:
            g = 2 * (x * math.log(x / expected) + (y * math.log(y / (x + y - expected)) if y else 0))
            if g > min(28, 1.7 * nt):
                found.add(mark)
    return found


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        s = w * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_texts(toxic: list[str], ordinary: list[str], share: float | None = None, window_words: int = 1) -> Model | None:
    """Fit on different texts of both classes; ``share`` is how common toxic rows are among all labelled ones."""
    if len(toxic) < 3 or len(ordinary) < 3:
        return None
    cut_t, cut_o = len(toxic) * 3 // 5, len(ordinary) * 3 // 5
    marks = _marks(toxic[:cut_t], ordinary[:cut_o])
    marked = [[w for w in _words(t) if not marks.isdisjoint(_beginnings(w))] for t in toxic[:cut_t]]
    samples = [f" {' '.join(w)} ".encode() for w in marked if w] or [t.lower().encode() for t in toxic[:cut_t]]
    plain = []
    for t in ordinary[:cut_o]:
        words = _words(t)
        plain += [f" {' '.join(words[i : i + 10])} ".encode() for i in range(0, len(words), 10)]
    random.Random(7).shuffle(plain)
    dicts = _dictionary(TOXIC_BYTES, samples), _dictionary(ORDINARY_BYTES, plain or [b" "])
    gains = Gains(*dicts)
    rows = [(t, 1.0) for t in toxic[cut_t:]] + [(t, 0.0) for t in ordinary[cut_o:]]
    x, y = [], np.array([label for _, label in rows])
    for t, _ in rows:
        w = _windows(t, window_words)
        x.append(features(w, gains(w)))
    x = np.array(x)
    share = share if share and 0 < share < 1 else len(toxic) / (len(toxic) + len(ordinary))
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-6
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    beta = _logistic((x - means) / scales, y, weight)
    return Model(*dicts, beta.tolist(), means.tolist(), scales.tolist(), window_words)


def fit(
    docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY
) -> Model | None:
    """``trainable`` says which rows of ``labels`` may be learned from."""
    known = labels.filter(trainable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    total = {r[0] == 1: r[1] for r in known.groupBy((F.col("toxic") == 1).alias("t")).count().collect()}
    order = F.xxhash64("id")
    chosen = known.filter("toxic = 1").orderBy(order, "id").limit(max_toxic).union(known.filter("toxic = 0").orderBy(order, "id").limit(max_ordinary))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("text", "toxic").collect()  # at most max_toxic + max_ordinary ids
    of: dict[str, int] = {}
    for r in rows:
        of[r.text] = max(of.get(r.text, 0), r.toxic)
    mixed = sorted(of, key=lambda t: (hash_of(t), t))
    share = total.get(True, 0) / max(1, sum(total.values()))
    return fit_texts([t for t in mixed if of[t] == 1], [t for t in mixed if of[t] == 0], share)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def scorer(model: Model | None):
    """A column function from text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model is None:
            yield from (pd.Series(np.zeros(len(b))) for b in batches)
            return
        gains = Gains(model.toxic, model.ordinary)
        means, scales, beta = map(np.array, (model.means, model.scales, model.weights))
        for texts in batches:
            x = np.empty((len(texts), len(means)))
            for i, t in enumerate(texts):
                w = _windows(t, model.window_words)
                x[i] = features(w, gains(w))
            z = beta[0] + ((x - means) / scales) @ beta[1:]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    python_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scorer(model)(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, all columns kept."""
    python_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scorer(model)(F.col(f"`{text_col}`")).alias("score"))
    return rows.filter(F.col("score") < threshold).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
