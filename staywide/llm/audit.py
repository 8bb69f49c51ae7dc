"""Filter interaction audit: every document is a word of the sets of filters it survives.

Five filters have 32 subsets. Bit s of a document's truth-table word says whether the document
passes all filters of subset s. How many documents survive each subset is then the number
of words that have each bit set, and every question about orders of filters is a difference
of such numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, or_empty

FILTERS = "ABCDE"
#: Subsets of the filters, and the one of all.
SETS = 1 << len(FILTERS)
ALL = SETS - 1
MIN_WORDS = 100
MIN_DISTINCT = 80
MAX_CAPITALS = 10
MARKS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts whose counters a task holds before it passes them on.
HELD = 4096
LABELS = ("good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    length = F.length(text)
    capitals = length - F.length(F.translate(text, CAPITALS, ""))
    failed = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, 100 * capitals.cast("long") > MAX_CAPITALS * length.cast("long"), text.rlike(MARKS)]
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(failed)), F.lit(0))


def truth_words() -> np.ndarray:
    """The word of every set of failed filters: bit s is set if none of s failed."""
    return np.array([sum(1 << s for s in range(SETS) if not s & failed) for failed in range(SETS)], np.uint32)


def add_words(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Carry-save reduction: words of weight 1, 2, 4, ... until two at most are left of each.

    Three words of one weight become their bitwise sum, of the same weight, and their
    carries, of the next: 32 counters are added by five operations on whole words.
    """
    out, level, todo = [], 0, [list(p) if isinstance(p, list) else p for p in planes]
    while level < len(todo):
        words = todo[level]
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            if level + 1 == len(todo):
                todo.append(np.zeros(0, np.uint32))
            todo[level + 1] = np.concatenate([todo[level + 1], (a & b) | (half & c)])
            words = np.concatenate([half ^ c, words[3 * third :]])
        out.append(words)
        level += 1
    return out


def popcounts(planes: list[np.ndarray]) -> np.ndarray:
    """How many words have each bit set, the words of plane j counting 2 ** j times."""
    total = np.zeros(SETS, np.int64)
    for j, words in enumerate(add_words(planes)):
        for word in words:
            total += ((np.uint64(word) >> np.arange(SETS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) << j
    return total


def _planes(words: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """A word that stands for several documents goes to the planes of its number's binary digits."""
    return [words[(times >> j) & 1 == 1] for j in range(int(times.max()).bit_length())] if len(times) else []


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, times): documents by the set of filters they fail.

    Equal texts share a digest. Rows are folded before they meet, by digest, part and label, so a
    large group of copies is a few rows; of each digest the rows with the smallest id pass E.
    """
    text = or_empty(F.col("text"))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_failures(text).alias("failed"))
    rows = rows.groupBy("doc_id", "part", "digest", "failed").agg(F.count(F.lit(1)).alias("times"))
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marked, "doc_id", "left").select("doc_id", "part", "digest", "failed", "times", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in LABELS))
    group = ["digest", "part", "failed", *LABELS]
    # Of the smallest id, how often it is there; rows without an id are copies of none.
    folded = rows.groupBy(*group).agg(
        F.sum(F.when(F.col("doc_id").isNull(), F.col("times"))).alias("nameless"),
        F.sum(F.when(F.col("doc_id").isNotNull(), F.col("times"))).alias("named"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times"))).alias("first"),
    )
    least = folded.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    joined = folded.join(least, "digest")
    named, nameless = F.coalesce("named", F.lit(0)), F.coalesce("nameless", F.lit(0))
    passing = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.times")).otherwise(0)
    kinds = F.array(
        F.struct(F.col("failed").alias("failed"), (nameless + passing).alias("times")),
        F.struct((F.col("failed") + (1 << 4)).alias("failed"), (named - passing).alias("times")),
    )
    return joined.select("part", *LABELS, F.inline(kinds)).filter("times > 0").select("part", "failed", *LABELS, "times")


def survivors(failed: DataFrame) -> DataFrame:
    """(part, kept, good, toxic): per part and label, how many documents survive each of the 32 subsets.

    Tasks add the words of their documents carry-save and pass on 32 counters per part and label.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_of = truth_words()
        held: dict[str, dict[str, list[np.ndarray]]] = {}

        def counted() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string())]
            for kind in ("kept", *LABELS):
                columns.append(pa.array([popcounts(p[kind]).tolist() for p in held.values()], pa.list_(pa.int64())))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "kept", *LABELS])

        for batch in batches:
            words, times = word_of[batch.column("failed").to_numpy()], batch.column("times").to_numpy()
            flags = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in LABELS} | {"kept": np.ones(len(words), bool)}
            parts = batch.column("part").dictionary_encode()
            at = parts.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            bounds = np.searchsorted(at[order], np.arange(len(parts.dictionary) + 1))
            for i, part in enumerate(parts.dictionary.to_pylist()):
                mine = order[bounds[i] : bounds[i + 1]]
                kinds = held.setdefault(part, {kind: [] for kind in ("kept", *LABELS)})
                for kind in kinds:
                    chosen = mine[flags[kind][mine]]
                    new, old = _planes(words[chosen], times[chosen]), kinds[kind]
                    width = max(len(new), len(old))
                    none = [np.zeros(0, np.uint32)]
                    pairs = zip(old + none * (width - len(old)), new + none * (width - len(new)))
                    kinds[kind] = add_words([np.concatenate(p) for p in pairs])
                if len(held) >= HELD:
                    yield counted()
        yield counted()

    counts = failed.mapInArrow(count, "part string, kept array<long>, good array<long>, toxic array<long>")
    sums = [F.sum(F.col(c)[s]).alias(f"{c}{s}") for c in ("kept", *LABELS) for s in range(SETS)]
    arrays = [F.array(*(F.col(f"{c}{s}") for s in range(SETS))).alias(c) for c in ("kept", *LABELS)]
    return counts.groupBy("part").agg(*sums).select("part", *arrays)


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filter, subset before it) of all orders of the filters."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), step + 1, f, before))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the contract of the query for the columns.

    Null texts count as empty and are copies of each other, null languages are the part ''. A row
    without an id is no copy and has no label; repeated rows of one id pass E together. Of
    several label rows of an id any one suffices. Parts without documents have no rows; an empty table none.
    """
    kept, good, toxic = (lambda s, c=c: f"{c}[{s}]" for c in ("kept", *LABELS))
    steps = ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'f', {f}, 'b', {b})" for o, k, f, b in _steps())
    after = "(b | shiftleft(1, f))"
    # What a filter removes over all orders: each subset before it, by the number of orders that begin so.
    shapley = []
    for f in range(len(FILTERS)):
        terms = []
        for s in range(SETS):
            if not s >> f & 1:
                size = s.bit_count()
                orders = factorial(size) * factorial(len(FILTERS) - 1 - size)
                terms.append(f"{orders} * ({kept(s)} - {kept(s | 1 << f)})")
        shapley.append(f"({' + '.join(terms)})")
    parts = survivors(failures(docs, labels)).selectExpr("*", f"array({', '.join(shapley)}) AS shapley_of")
    removed = f"({kept('b')} - {kept(after)})"
    return parts.selectExpr("*", f"inline(array({steps}))").selectExpr(
        "part",
        "filter_order",
        "step",
        f"{kept(after)} AS kept",
        f"{removed} AS removed",
        f"{kept(0)} - {kept('shiftleft(1, f)')} - {removed} AS redundant",
        f"{kept(f'{ALL} - shiftleft(1, f)')} - {kept(ALL)} AS unique_fails",
        f"{good('b')} - {good(after)} AS good_lost",
        f"{toxic('b')} - {toxic(after)} AS toxic_lost",
        "shapley_of[f] AS shapley",
    )
