"""LM scoring by partial matching: a byte-context trie with escapes and exclusion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import broadcast_if_small
from .common import chunks, saved, shipped

#: Bytes of context.
ORDER = 5
#: Contexts up to this length are one small trie, 256^3 nodes at most, that every task gets.
#: All longer ones with the same last LOW + 1 bytes are 256^3 nodes at most too (order 5).
LOW = 2
#: Stands in front of a text and ends it; no byte of UTF-8.
EDGE = 0xFF
HELD_OUT = 10
SMOOTH = 0.1
SLICE = 1 << 18
#: A block of documents: about so many bytes of text.
BLOCK_BYTES = 32 << 20
#: Nodes of longer contexts that are worked out together, rounded up to whole groups.
GROUP_NODES = 1 << 20


def raw(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def held_out(doc_id: int | None) -> bool:
    """A null id counts as an empty text, which is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones: what is made of their texts is as large again."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def grams(texts: list[bytes], order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts: first text, their number, and for every symbol its text and its code.

    A code is the symbol in the low byte below its `order` bytes of context. Symbols are
    the bytes of a text and its end.
    """
    front = bytes([EDGE]) * order
    for lo, hi in chunks([len(t) for t in texts], SLICE):
        if hi - lo == 1 and len(texts[lo]) > SLICE:
            whole = front + texts[lo] + bytes([EDGE])
            for k in range(order, len(whole), SLICE):
                piece = np.frombuffer(whole[k - order : k + SLICE], np.uint8)
                codes = _windows(piece, order)
                yield lo, 1, np.zeros(len(codes), np.int64), codes
            continue
        data = np.frombuffer(b"".join(front + t + bytes([EDGE]) for t in texts[lo:hi]), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts[lo:hi]])
        owner = np.repeat(np.arange(hi - lo), sizes)
        # Where the symbols are: everything but the marks in front.
        at = np.arange(len(owner)) + order * (owner + 1)
        yield lo, hi - lo, owner, _windows(data, order)[at - order]


def _windows(data: np.ndarray, order: int) -> np.ndarray:
    n = len(data) - order
    codes = np.zeros(n, np.int64)
    for k in range(order + 1):
        codes <<= 8
        codes |= data[k : k + n]
    return codes


class Lookup:
    """Position of codes in an array of distinct ones, or -1: open addressing, all at once."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(4, int(len(codes) * 2).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(codes), dtype=np.int32), self._slot(codes)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            missed = self.table[slot] != left
            left, slot = left[missed], (slot[missed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        slot = self._slot(codes)
        found = self.table[slot]
        open_ = np.flatnonzero((found >= 0) & (self.codes[found] != codes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.table[slot[open_]]
            open_ = open_[(found[open_] >= 0) & (self.codes[found[open_]] != codes[open_])]
        return found


class Level:
    """Contexts of one length: counts of their nodes, and sums per context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        context, self.own = np.unique(codes >> 8, return_inverse=True)
        self.nodes, self.contexts = Lookup(codes), Lookup(context)
        self.count = counts.astype(float)
        self.n = np.bincount(self.own, counts, len(context))
        self.q = np.bincount(self.own, minlength=len(context)).astype(float)
        self.excluded = np.zeros(len(context))

    def exclude(self, shorter: Level, mask: int) -> None:
        """What the symbols of a context count behind the next shorter one."""
        if len(self.n):
            self.excluded = np.bincount(self.own, shorter.count[shorter.nodes(self.nodes.codes & np.int64(mask))], len(self.n))


def _at(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The values at places, 0 where there is none (-1)."""
    return np.where(where >= 0, values[where], 0.0) if len(values) else np.zeros(len(where))


class Trie:
    """Counts of symbols behind contexts of every length up to `order`.

    A symbol that a context has seen costs its share of n + q, where n are the symbols
    counted there and q the distinct ones; one it has not seen costs the escape q / (n + q)
    and is looked up behind the context without its oldest byte, where the symbols of the
    longer context are excluded from counts and shares alike. What no context has seen is
    spread evenly over the byte values that remain. So the costs of all symbols behind a
    context sum to one.

    A trie may stand on a `base` with the shorter contexts. It then needs only part of the
    longer ones: all that end alike.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, base: Trie | None = None):
        self.order = order
        levels = base.levels if base else []
        above = []
        for j in range(order, len(levels) - 1, -1):
            if j < order:
                codes, back = np.unique(codes & np.int64(_mask(j)), return_inverse=True)
                counts = np.bincount(back, counts, len(codes))
            above.insert(0, Level(codes, counts))
        self.levels: list[Level] = levels + above
        for j in range(max(1, len(levels)), order + 1):
            self.levels[j].exclude(self.levels[j - 1], _mask(j - 1))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """The log10 probability of every symbol behind its context."""
        out = np.zeros(len(codes))
        left, longer = np.arange(len(codes)), np.full(len(codes), -1)
        for j in range(self.order, -1, -1):
            level = self.levels[j]
            part = codes[left] & np.int64(_mask(j))
            context, node = level.contexts(part >> 8), level.nodes(part)
            n, q = _at(level.n, context), _at(level.q, context)
            if j < self.order:
                above = self.levels[j + 1]
                n, q = n - _at(above.excluded, longer), q - _at(above.q, longer)
            hit = node >= 0
            out[left[hit]] += np.log10(level.count[node[hit]] / (n + q)[hit])
            escapes = ~hit & (q > 0)
            out[left[escapes]] += np.log10(q[escapes] / (n + q)[escapes])
            left, longer = left[~hit], context[~hit]
        out[left] -= np.log10(256.0 - self.levels[0].q.sum())
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, n, owner, codes in grams(texts, self.order):
            out[lo : lo + n] += np.bincount(owner, self.log10(codes), n)
        return out


def _mask(order: int) -> int:
    return (1 << 8 * (order + 1)) - 1


class Tally:
    """Counts by code, summed up now and then while more come in."""

    def __init__(self):
        self.codes, self.counts, self.waiting, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, found: np.ndarray, weight: int) -> None:
        codes, counts = np.unique(found, return_counts=True)
        self.waiting.append((codes, counts * weight))
        self.held += len(codes)
        if self.held > SLICE * 4 + len(self.codes) // 2:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([self.codes, *(w[0] for w in self.waiting)])
        counts = np.concatenate([self.counts, *(w[1] for w in self.waiting)])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        self.codes, self.counts = codes[first], np.add.reduceat(counts, first) if len(first) else counts
        self.waiting, self.held = [], 0
        return self.codes, self.counts


#: Rows of a block, in the order in which they are read: words, codes, documents.
WORD_ROW, CODE, DOC = 0, 1, 2
#: `train` is how often training documents of the block hold the word or code; documents are packed.
INDEX = "block long, kind int, word binary, code long, train long, facts binary, data binary"
#: What many rows of a block hold, compressed: numbers in `facts`, words, codes or texts in `data`.
PACKED = "block long, kind int, facts binary, data binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packs(rows: DataFrame, kind: int) -> DataFrame:
    """Rows (block, key, value) of one kind, many in one: they are compressed before they are dealt to their blocks."""
    key, value = rows.columns[1:]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            t = t.take(pa.array(np.argsort(t["block"].to_numpy(), kind="stable")))
            block, numbers, keys = t["block"].to_numpy(), t[value].to_numpy(), t[key].combine_chunks()
            start = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            for lo, hi in zip(start, [*start[1:], len(block)]):
                part = keys.slice(lo, hi - lo)
                # No word holds white space.
                data = b"\n".join(part.to_pylist()) if kind == WORD_ROW else part.to_numpy().tobytes()
                yield _rows(schema, 1, block=[block[lo]], kind=[kind], facts=[zstandard.compress(numbers[lo:hi].tobytes())], data=[zstandard.compress(data)])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SLICE:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    schema = _arrow(PACKED)
    return rows.mapInArrow(pack, PACKED)


def _index(docs: DataFrame, order: int, block_bytes: int) -> DataFrame:
    """Per block of documents its texts, and a row per distinct word and per distinct code.

    So words and contexts meet what the corpus knows of them in one narrow row per block,
    however often they occur.
    """
    schema = _arrow(INDEX)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        words, trained, codes, size = {}, np.zeros(0, np.int64), Tally(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(words)
            for k in range(0, len(names), 1 << 15):
                some = names[k : k + (1 << 15)]
                n = len(some)
                yield _rows(schema, n, block=np.full(n, block), kind=np.full(n, WORD_ROW), word=some, train=trained[k : k + n])
            found, counts = codes.merge()
            for k in range(0, len(found), 1 << 16):
                some = found[k : k + (1 << 16)]
                n = len(some)
                yield _rows(schema, n, block=np.full(n, block), kind=np.full(n, CODE), code=some, train=counts[k : k + n])

        for batch in small(batches):
            doc_ids, texts = batch["doc_id"].to_pylist(), [raw(t) for t in batch["text"].to_pylist()]
            for lo, hi in chunks([len(t) for t in texts], 4 * SLICE):
                part, held = texts[lo:hi], [held_out(i) for i in doc_ids[lo:hi]]
                n = hi - lo
                facts = np.array([(i or 0, i is None, h, len(t)) for i, h, t in zip(doc_ids[lo:hi], held, part)], np.int64)
                ends = n - sum(held)
                yield _rows(schema, 1, block=[block], kind=[DOC], train=[ends], facts=[zstandard.compress(facts.tobytes())], data=[zstandard.compress(b"".join(part))])
                for out in (False, True):
                    own = [t for t, h in zip(part, held) if h == out]
                    got = [w for t in own for w in t.split()]
                    ids = np.fromiter((words.setdefault(w, len(words)) for w in got), np.int64, len(got))
                    seen = np.bincount(ids, minlength=len(words)) * (not out)
                    trained = np.concatenate([trained, np.zeros(len(words) - len(trained), np.int64)]) + seen
                    for _, _, _, found in grams(own, order):
                        codes.add(found, 0 if out else 1)
                size += sum(map(len, part)) + n
                if size >= block_bytes:
                    yield from flush()
                    words, trained, codes, size, block = {}, np.zeros(0, np.int64), Tally(), 0, block + 1
        if size:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(scan, INDEX)


def _costs(codes: DataFrame, order: int) -> DataFrame:
    """(code, cost) of every distinct code, from (code, train) of all blocks.

    Nodes meet where their contexts end in the same bytes: there all longer contexts are
    complete. One group of these is held at a time, 256^3 nodes at most whatever the size of
    the corpus (order 5), so the trie as a whole is nowhere in one place.
    """
    base = min(order, LOW)
    low = codes.groupBy(F.col("code").bitwiseAND(F.lit(_mask(base))).alias("code")).agg(F.sum("train").alias("n")).filter("n > 0").toArrow()
    load = shipped(codes.sparkSession, Trie(*(np.asarray(low[c].to_numpy(), np.int64) for c in ("code", "n")), base))
    ending = F.shiftright("code", 8).bitwiseAND(F.lit(_mask(LOW)))
    nodes = codes.withColumn("ending", ending).repartition("ending").groupBy("ending", "code").agg(F.sum("train").alias("n"))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, short = [np.zeros((0, 3), np.int64)], load()

        def worked_out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            code, n = rows[:, 1], rows[:, 2]
            trie = Trie(code[n > 0], n[n > 0], order, short) if order > base else short
            for k in range(0, len(code), 1 << 16):
                some = code[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(trie.log10(some))], ["code", "cost"])

        for batch in batches:
            rest.append(np.column_stack([batch[c].to_numpy() for c in ("ending", "code", "n")]))
            if sum(map(len, rest)) >= GROUP_NODES and rest[0][:1, 0].tolist() != rest[-1][-1:, 0].tolist():
                rows = np.concatenate(rest)
                # The last group may go on.
                whole = np.searchsorted(rows[:, 0], rows[-1, 0])
                yield from worked_out(rows[:whole])
                rest = [rows[whole:]]
        yield from worked_out(np.concatenate(rest))

    return nodes.sortWithinPartitions("ending").mapInArrow(cost, "code long, cost double")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def lm_scores(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of `docs`.

    `score` is the log10 probability of the text's bytes, A-Z in lower case, and its end
    under the trie of all training documents; `base_score` the smoothed one-word model.
    Null and empty texts have one token, the end. Repeated rows count as often as they
    stand there. Without training documents every byte costs 1 / 256 and no word is known.
    """
    index = saved(_index(docs, order, block_bytes), "lm-index", "zstd")
    people = index.filter(F.col("kind") == DOC)
    words = index.filter(F.col("kind") == WORD_ROW).select("block", "word", "train")
    codes = index.filter(F.col("kind") == CODE).select("block", "code", "train")
    # A word has one row per block, however often it occurs, so no word has many of the rows.
    same = Window.partitionBy("word")
    counted = words.withColumn("c", F.sum("train").over(same)).withColumn("nth", F.row_number().over(same.orderBy("block")))
    counted = saved(counted.select("block", "word", "c", (F.col("nth") == 1).alias("first"), "train"), "lm-counts", "zstd")
    ends = people.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    known = counted.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count(F.when(F.expr("first and c > 0"), 1)).alias("v")).first()
    n, v = known["n"] + ends, known["v"] + (ends > 0)
    below = float(np.log10(n + SMOOTH * (v + 1)))
    end_cost = float(np.log10(ends + SMOOTH)) - below
    costs = saved(_costs(codes.select("code", "train"), order), "lm-costs", "zstd")
    priced = codes.select("block", "code").join(broadcast_if_small(costs), "code").select("block", "code", "cost")
    both = people.select("block", "kind", "facts", "data").unionByName(_packs(priced, CODE))
    both = both.unionByName(_packs(counted.select("block", "word", "c"), WORD_ROW))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None

        def scored(facts: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
            got = [t.split() for t in texts]
            sizes = np.array([len(g) for g in got])
            owner = np.repeat(np.arange(len(got)), sizes)
            ids = np.fromiter((words[w] for g in got for w in g), np.int64, sizes.sum())
            score = np.zeros(len(texts))
            for lo, n_, text, code in grams(texts, order):
                score[lo : lo + n_] += np.bincount(text, cost[place(code)], n_)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(facts[:, 0], mask=facts[:, 1] > 0),
                    pa.array(facts[:, 2] > 0),
                    pa.array(sizes + 1),
                    pa.array(np.bincount(owner, c[ids] > 0, len(got)).astype(np.int64) + (ends > 0)),
                    pa.array(np.bincount(owner, np.log10(c[ids] + SMOOTH) - below, len(got)) + end_cost),
                    pa.array(score),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

        for batch in batches:
            for k in range(batch.num_rows):
                block, kind, facts, data = (batch[x][k].as_py() for x in ("block", "kind", "facts", "data"))
                facts, data = zstandard.decompress(facts), zstandard.decompress(data)
                if block != current:
                    current = block
                    words, times, found, place = {}, [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0))], None
                if kind == WORD_ROW:
                    names = data.split(b"\n")
                    words.update(zip(names, range(len(words), len(words) + len(names))))
                    times.append(np.frombuffer(facts, np.int64))
                elif kind == CODE:
                    found.append((np.frombuffer(data, np.int64), np.frombuffer(facts)))
                else:
                    if place is None:
                        c = np.concatenate(times)
                        all_codes, cost = (np.concatenate(x) for x in zip(*found))
                        place = Lookup(all_codes)
                        times, found = [], []
                    facts = np.frombuffer(facts, np.int64).reshape(-1, 4)
                    upto = np.cumsum(facts[:, 3]).tolist()
                    yield scored(facts, [data[lo:hi] for lo, hi in zip([0, *upto], upto)])

    by_block = both.repartition("block").sortWithinPartitions("block", "kind")
    out = by_block.mapInArrow(total, RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
