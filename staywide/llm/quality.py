"""Quality rules: hashed n-gram logistic regression over fixed base rules."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, in_parts, shipped, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is kept from this calibrated probability of good quality on.
MIN_QUALITY = 0.5
#: Labelled rows that the classifier is fitted on, half of each class, by order of a hash.
FIT_ROWS = 3000
CHAR_N = 4
BITS = 16
SLOTS = 1 << BITS
FAMILIES = 3  # characters, words, word pairs
SCALE = 20.0
#: Bytes that are turned into n-grams at a time.
SLICE = 1 << 20
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_POWERS = np.empty(64, np.uint64)
_POWERS[0] = 1
for _i in range(1, 64):
    _POWERS[_i] = np.uint64((int(_POWERS[_i - 1]) * 0x100000001B3) & (1 << 64) - 1)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    white = sum(raw.count(bytes([c])) for c in WHITE)
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    repeated = 0
    n = len(words) - 2
    if n > 1:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n:
            often = Counter(windows)
            upto = 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeated


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def ngrams(raw: bytes, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per family its hashed n-grams in `raw` and the number of the document each belongs to.

    `starts` are the offsets at which documents begin. N-grams do not reach across
    documents.
    """
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    owner = np.zeros(n, np.int32)
    owner[starts[(starts > 0) & (starts < n)]] = 0
    np.add.at(owner, starts[(starts > 0) & (starts < n)], 1)
    owner = np.cumsum(owner, dtype=np.int32)
    if n >= CHAR_N:
        m = n - CHAR_N + 1
        code = data[:m].astype(np.uint64)
        for k in range(1, CHAR_N):
            code |= data[k : k + m].astype(np.uint64) << np.uint64(8 * k)
        inside = owner[:m] == owner[CHAR_N - 1 :]
        yield 0, _mix(code, 0)[inside], owner[:m][inside]
    inside = ~_IS_WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(first)
    if not len(begin):
        return
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    place = at - begin[word]
    value = (data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
    hashes = np.add.reduceat(value, np.flatnonzero(first[at]))
    own = owner[begin]
    yield 1, _mix(hashes, 1), own
    if len(begin) > 1:
        same = own[1:] == own[:-1]
        pair = hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:]
        yield 2, _mix(pair, 2)[same], own[:-1][same]


def _slices(raws: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """First document, count, bytes and offsets of what fits a slice; a very long text comes in pieces."""
    for lo, hi in chunks([len(r) for r in raws], SLICE):
        if hi - lo == 1 and len(raws[lo]) > SLICE:
            for k in range(0, len(raws[lo]), SLICE):
                yield lo, 1, raws[lo][k : k + SLICE], np.zeros(1, np.int64)
        else:
            ends = np.cumsum([len(r) for r in raws[lo:hi]])
            yield lo, hi - lo, b"".join(raws[lo:hi]), np.concatenate([[0], ends[:-1]])


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and shares of one text: each family's shares sum to SCALE."""
    sums = np.zeros(FAMILIES * SLOTS)
    for _, _, piece, starts in _slices([raw]):
        for family, slot, _ in ngrams(piece, starts):
            sums[family * SLOTS : (family + 1) * SLOTS] += np.bincount(slot.astype(np.int64), minlength=SLOTS)
    for f in range(FAMILIES):
        part = sums[f * SLOTS : (f + 1) * SLOTS]
        part *= SCALE / max(1.0, part.sum())
    slots = np.flatnonzero(sums)
    return slots.astype(np.int32), sums[slots].astype(np.float32)


@dataclass
class Model:
    """Weights per slot and family, offset, and Platt's slope and offset of the calibration."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sums = np.zeros((FAMILIES, len(raws)))
        counts = np.zeros((FAMILIES, len(raws)))
        for lo, n, raw, starts in _slices(raws):
            # Empty documents share an offset with their neighbour; they own no n-gram.
            real, index = np.unique(starts[starts < len(raw)][::-1], return_index=True) if len(raw) else (starts[:0], starts[:0])
            index = np.count_nonzero(starts < len(raw)) - 1 - index
            for family, slot, owner in ngrams(raw, real):
                w = self.weights[family * SLOTS + slot.astype(np.int64)]
                sums[family, lo : lo + n] += np.bincount(index[owner], w, n)
                counts[family, lo : lo + n] += np.bincount(index[owner], minlength=n)
        logit = self.offset + (SCALE * sums / np.maximum(counts, 1)).sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -50, 50)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], share_good: float, rounds: int = 80) -> Model | None:
    """Logistic regression by Adam on three quarters of the rows, calibrated on the last.

    None if a class is missing. The rows are balanced by class; `share_good` puts the
    calibrated probabilities back to the labels' own balance.
    """
    y = np.array([r[0] for r in rows], float)
    held = np.arange(len(rows)) % 4 == 3
    if len(rows) < 8 or min(y[~held].min(), y[held].min()) == 1 or max(y[~held].max(), y[held].max()) == 0:
        return None
    size = np.array([len(r[1]) for r in rows])
    doc = np.repeat(np.arange(len(rows)), size)
    slot = np.concatenate([r[1] for r in rows])
    value = np.concatenate([r[2] for r in rows])
    weights, offset = np.zeros(FAMILIES * SLOTS), 0.0
    m, v, mo, vo = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0

    def logits() -> np.ndarray:
        return np.bincount(doc, weights[slot] * value, len(rows)) + offset

    n_fit = np.count_nonzero(~held)
    for t in range(1, rounds + 1):
        gap = np.where(held, 0.0, 1 / (1 + np.exp(-np.clip(logits(), -50, 50))) - y) / n_fit
        grad = np.bincount(slot, gap[doc] * value, len(weights)) + 1e-4 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mo, vo = 0.9 * mo + 0.1 * gap.sum(), 0.99 * vo + 0.01 * gap.sum() ** 2
        a, b = 1 - 0.9**t, 1 - 0.99**t
        weights -= 0.05 * (m / a) / (np.sqrt(v / b) + 1e-8)
        offset -= 0.05 * (mo / a) / (np.sqrt(vo / b) + 1e-8)
    x, target = logits()[held], y[held]
    # Platt's smoothed targets keep the slope finite where the classes separate.
    good = target.sum()
    target = np.where(target > 0, (good + 1) / (good + 2), 1 / (len(target) - good + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -50, 50)))
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * x * x).sum() + 1e-6, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        theta -= np.clip(step, -1, 1)
    balance = y.mean()
    prior = np.log(share_good / (1 - share_good)) - np.log(balance / (1 - balance))
    return Model(weights.astype(np.float32), float(offset), float(theta[0]), float(theta[1] + prior))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """The model of the labelled documents, or None where they do not hold both classes.

    At most `rows` labelled documents take part, half of each class, the first by a hash
    of their id; their whole texts become hashed counts on the executors.
    """
    labels = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    half = [labels.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for q in (0, 1)]
    picked = half[0].unionByName(half[1]).select(F.col("doc_id").alias("id_"), "quality")
    # The rows are bounded by the parameter, so is the broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id_"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features((t or "").encode("utf-8", "surrogatepass")) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "slots": [s.tobytes() for s, _ in got], "shares": [x.tobytes() for _, x in got]})

    found = chosen.select("doc_id", "quality", "text").mapInPandas(hashed, "doc_id long, quality int, slots binary, shares binary").toPandas()
    found = found.drop_duplicates("doc_id")
    found["order"] = found["doc_id"].map(lambda i: (int(i) * 0x9E3779B97F4A7C15 >> 7) & 0xFFFFFFFF)
    found = found.sort_values(["order", "doc_id"])
    data = [(int(q), np.frombuffer(s, np.int32), np.frombuffer(x, np.float32)) for q, s, x in zip(found["quality"], found["slots"], found["shares"])]
    return train(data, counts[1] / (counts[0] + counts[1]))


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def judge(docs: DataFrame, model: Model | None, min_quality: float = MIN_QUALITY) -> tuple[DataFrame, str]:
    """`docs` with a struct column of the rules' counts and verdict, and that column's name.

    Null and empty texts have no words and fail. Without a model `quality` is null and
    the base rules alone decide. All other columns stay in the JVM, whatever their names.
    """
    load = shipped(docs.sparkSession, model)

    @F.pandas_udf(RESULT)
    def rules(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in in_parts(texts):
            batch = batch.tolist()
            out = pd.DataFrame([base_counts(t) for t in batch], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
            out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
            out["quality"] = scorer.probabilities(batch) if scorer else None
            good = out["quality"] >= min_quality if scorer else True
            out["kept"] = ~out["base_failed"] & good
            yield out

    name = fresh(docs, "quality_")
    return docs.withColumn(name, rules.asNondeterministic()("text")), name


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality)."""
    judged, name = judge(docs.select("doc_id", "text"), fit(docs, labels))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    return judged.select("doc_id", *(F.col(f"{name}.{f}").alias(f) for f in fields))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    judged, name = judge(docs, fit(docs, labels))
    return judged.filter(F.col(f"{name}.kept")).select(*docs.columns)


def labels_of(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality")
