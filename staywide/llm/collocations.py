"""Phrase collocations of a weighted de Bruijn graph.

The longest grams are edges between the two grams of one word less that overlap in them.
Only they are counted in the text, as far as they can be frequent at all. What is shorter follows
from the flow: a gram occurs as often as the longer ones that begin with it, and as often as a
path ends with it. Paths through nodes with one way in and one way out are compacted into passages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks
from .common import or_empty, saved

#: Words of the longest phrase; an edge has as many, a node one less.
LONGEST = 5
LEAST = 100
TOP = 2000
UNKNOWN_LANG = "und"
ENDS = r"[.,;:!?\x0A-\x0D]"
TOKEN = r"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _first(gram: str, k: str | int) -> str:
    return f"substring_index({gram}, ' ', {k})"


def _last(gram: str, k: str | int) -> str:
    return f"substring_index({gram}, ' ', -({k}))"


def _pieces(docs: DataFrame) -> DataFrame:
    """Rows for `blocks.coded`: words, and every mark that ends a piece as a word of its own."""
    lowered = F.translate(or_empty(F.col("text")), UPPER, LOWER)
    words = F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG))
    return docs.select(lang.alias("part"), words.alias("words"), F.lit(None).cast("int").alias("row"))


def _mixed(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of grams with one word more."""
    x = grams * np.uint64(0x9E3779B97F4A7C15) + words
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Block:
    """The words of a block in order, and how long a frequent gram starts at each place."""

    def __init__(self, rows: pa.Table, frequent: pa.Table):
        self.words = blocks.unpack_words_of(rows["numbers"], rows["words"], rows["size"][0].as_py())
        # Every row ends with a mark that is no word.
        chain: list[np.ndarray] = []
        for raw, lengths in zip(rows["codes"].to_pylist(), rows["lengths"].to_pylist()):
            if raw is not None:
                chain.append(np.insert(blocks.unpack_codes(raw), np.cumsum(lengths), -1))
        self.chain = np.concatenate([*chain, np.full(LONGEST, -1)])
        mark = re.compile(ENDS)
        proper = np.array([not mark.match(w) for w in self.words] + [False])
        self.proper = proper[self.chain]
        self.hashes = np.concatenate([blocks.hashes(self.words), np.zeros(1, np.uint64)])[self.chain]
        self.frequent: dict[int, list[np.ndarray]] = {}
        for k, raw in zip(frequent["k"].to_pylist(), frequent["hashes"].to_pylist()):
            self.frequent.setdefault(k, []).append(_numbers(raw))

    def reach(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many words of a frequent gram start at each place, `longest` at most; then the
        places of grams of one word more whose own parts are frequent, and their hashes."""
        n = len(self.chain)
        reach = np.zeros(n, np.int64)
        places, hashes = np.flatnonzero(self.proper), self.hashes
        for k in range(1, longest + 1):
            known = np.unique(np.concatenate(self.frequent.get(k, [np.zeros(0, np.uint64)])))
            found = np.zeros(n + 1, bool)
            if len(known):
                at = np.searchsorted(known, hashes[places])
                at[at == len(known)] = 0
                found[places[known[at] == hashes[places]]] = True
            reach[found[:n]] = k
            places = np.flatnonzero(found[:n] & found[1:])
            longer = np.zeros(n, np.uint64)
            longer[places] = _mixed(hashes[places], self.hashes[places + k])
            hashes = longer
        return reach, places, hashes[places]

    def grams(self, places: np.ndarray, k: int) -> tuple[list[str], np.ndarray]:
        """The distinct grams of k words at these places, and how often each is there."""
        size, numbers = len(self.words) + 1, self.chain[places]
        for j in range(1, k):
            _, numbers = np.unique(numbers, return_inverse=True)
            numbers = numbers * size + self.chain[places + j]
        _, first, n = np.unique(numbers, return_index=True, return_counts=True)
        words = [[self.words[w] for w in self.chain[places[first] + j].tolist()] for j in range(k)]
        return [" ".join(g) for g in zip(*words)], n


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    return blocks.squeezed(np.diff(numbers, prepend=np.uint64(0)).astype("<u8").tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blocks.expanded(raw), "<u8"), dtype=np.uint64)


def _frequent(packed: DataFrame, frequent: DataFrame, k: int, least: int, buckets: int) -> DataFrame:
    """(block, k, hashes): of the grams of k words of a block, those that may be frequent.

    A gram is counted by its hash, where its parts are frequent. Hashes that meet add up, so a
    frequent gram is never left out; one too many is counted exactly later. The hashes of a
    block go out in as many lists as there are buckets, and what is frequent comes back.
    """
    bits = np.uint64(64 - buckets.bit_length() + 1)

    def count(rows: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows:
            _, places, found = _Block(rows, known).reach(k - 1)
            grams, n = np.unique(found, return_counts=True)
            bucket = (grams >> bits).astype(np.int64)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            block, part = rows["block"][0].as_py(), rows["part"][0].as_py()
            for a, b in zip(starts, [*starts[1:], len(grams)]):
                out.append((part, int(bucket[a]), block, _packed(grams[a:b]), blocks.squeezed(n[a:b].astype("<u4").tobytes())))
        kinds = [("part", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("n", pa.binary())]
        return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds)})

    def meet(rows: pa.Table) -> pa.Table:
        lists = [_numbers(x.as_py()) for x in rows["hashes"]]
        n = np.concatenate([np.frombuffer(blocks.expanded(x.as_py()), "<u4") for x in rows["n"]]).astype(np.int64)
        grams = np.concatenate(lists)
        order = np.argsort(grams, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) > 0]))
        often = grams[order][starts][np.add.reduceat(n[order], starts) >= least]
        kept = [(b, own) for b, x in zip(rows["block"].to_pylist(), lists) if len(own := x[np.isin(x, often, assume_unique=True)])]
        return pa.table({"block": pa.array([b for b, _ in kept], pa.int64()), "k": pa.array([k] * len(kept), pa.int32()), "hashes": pa.array([_packed(x) for _, x in kept], pa.binary())})

    counted = packed.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(count, "part string, bucket int, block long, hashes binary, n binary")
    return saved(counted.groupBy("part", "bucket").applyInArrow(meet, "block long, k int, hashes binary"), "frequent")


def graph(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(part, k, gram, n): the edges of the graph, and where a path cannot go on.

    Every place of a text gives one row's count: the longest gram that starts there, has
    `longest` words at most and occurs `least` times. With `longest` words it is an edge. With
    fewer it is an end: its piece ends there, or the next gram is too rare to be of interest,
    and so is all that holds it. With k = 0 a row has the number of all words.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    # A task unpacks a block whole, with several numbers for every place in it.
    packed = blocks.coded(_pieces(docs), "row int", "phrase-blocks", block_bytes=blocks.BLOCK_BYTES // 4)
    buckets = blocks.bucket_count(packed.filter("words IS NOT NULL").count())
    packed = packed.select("block", "part", "size", "numbers", "words", "codes", "lengths")
    frequent = docs.sparkSession.createDataFrame([], "block long, k int, hashes binary")
    for k in range(1, longest + 1):
        frequent = frequent.union(_frequent(packed, frequent, k, least, buckets))

    bits = np.uint64(64 - buckets.bit_length() + 1)

    def count(rows: pa.Table, known: pa.Table) -> pa.Table:
        grams, numbers = [], []
        if rows.num_rows:
            block = _Block(rows, known)
            reach, _, _ = block.reach(longest)
            grams, numbers = [""], [np.array([block.proper.sum()])]
            for k in range(1, longest + 1):
                places = np.flatnonzero(reach == k)
                if len(places):
                    found, n = block.grams(places, k)
                    grams += found
                    numbers.append(n)
        out: list[tuple] = []
        if grams:
            n, part = np.concatenate(numbers), rows["part"][0].as_py()
            bucket = (blocks.hashes(grams) >> bits).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for some in np.split(order, starts[1:]):
                out.append((part, int(bucket[some[0]]), blocks.pack_words([grams[i] for i in some.tolist()]), blocks.pack_codes(n[some])))
        kinds = [("part", pa.string()), ("bucket", pa.int32()), ("grams", pa.binary()), ("n", pa.binary())]
        return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds)})

    def meet(rows: pa.Table) -> pa.Table:
        total: dict[str, int] = {}
        for grams, n in zip(rows["grams"].to_pylist(), rows["n"].to_pylist()):
            for gram, times in zip(blocks.unpack_words(grams), blocks.unpack_codes(n).tolist()):
                total[gram] = total.get(gram, 0) + times
        sizes = [gram.count(" ") + 1 if gram else 0 for gram in total]
        return pa.table({"part": pa.array([rows["part"][0].as_py()] * len(total), pa.string()), "k": pa.array(sizes, pa.int32()), "gram": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    counted = packed.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(count, "part string, bucket int, grams binary, n binary")
    return saved(counted.groupBy("part", "bucket").applyInArrow(meet, "part string, k int, gram string, n long"), "grams", "zstd")


def flows(grams: DataFrame, longest: int = LONGEST) -> dict[int, DataFrame]:
    """(part, gram, n) by number of words: edges, and what flows through the shorter grams.

    A gram occurs as often as the next longer ones that begin with it, and as often as a
    path ends with it. Counts of grams that are frequent are exact; rarer ones may lack rows.
    """
    out = {longest: grams.filter(F.col("k") == longest).select("part", "gram", "n")}
    for k in range(longest - 1, 0, -1):
        through = out[k + 1].select("part", F.expr(_first("gram", k)).alias("gram"), "n")
        ended = grams.filter(F.col("k") == k).select("part", "gram", "n")
        out[k] = saved(through.union(ended).groupBy("part", "gram").agg(F.sum("n").alias("n")), "flow", "zstd")
    return out


def passages(edges: DataFrame, nodes: DataFrame, longest: int = LONGEST, max_rounds: int = 40) -> DataFrame:
    """(part, passage, n): unary paths of the graph, each as its words in order.

    Two edges are one path where all that reaches the node between them comes from the first
    and goes on into the second. No piece begins or ends there, so a path is never a ring.
    Every edge finds the end of its path by pointer doubling: in each round it takes over
    where the edge it points at points to.
    """
    k = longest - 1
    node = nodes.select(F.col("part"), F.col("gram").alias("node"), "n")
    into = edges.select("part", F.col("gram").alias("edge"), F.expr(_last("gram", k)).alias("node"), "n")
    on = edges.select("part", F.col("gram").alias("next"), F.expr(_first("gram", k)).alias("node"), "n")
    links = into.join(node, ["part", "node", "n"]).join(on, ["part", "node", "n"]).select("part", "edge", "next")
    state = edges.select("part", F.col("gram").alias("edge"), "n").join(links, ["part", "edge"], "left")
    state = state.select("part", "edge", "n", F.coalesce("next", "edge").alias("end"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    state = saved(state, "paths", "zstd")
    for _ in range(max_rounds):
        far = state.filter("steps > 0").select("part", F.col("edge").alias("end"), F.col("end").alias("far"), F.col("steps").alias("more"))
        following = state.join(far, ["part", "end"], "left")
        moved = following.select("part", "edge", "n", F.coalesce("far", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("more").isNotNull().alias("moved"))
        moved = saved(moved, "paths", "zstd")
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"paths have not settled after {max_rounds} rounds")
    path = state.groupBy("part", "end", "n").agg(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "edge"))).alias("p"))
    rest = F.expr(f"transform(slice(p.edge, 2, size(p)), e -> {_last('e', 1)})")
    return path.select("part", F.concat_ws(" ", F.expr("p.edge[0]"), rest).alias("passage"), "n")


def _grams_in(passage: str, k: int, drop: int = 0) -> Column:
    """The grams of k words of a passage in order, without `drop` at either end."""
    words = f"split({passage}, ' ')"
    at = f"sequence({1 + drop}, size({words}) - {k - 1 + drop})"
    return F.expr(f"transform(CASE WHEN size({words}) >= {k + 2 * drop} THEN {at} ELSE array() END, i -> array_join(slice({words}, CAST(i AS INT), {k}), ' '))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of every language's first `top` phrases.

    Null texts count as empty, a null language as `und`; repeated rows count as often as
    they are there, ids and other columns are ignored. Without a frequent phrase there are
    no rows. Arithmetic is exact: products are decimals of 38 digits.
    """
    grams = graph(docs, least, longest)
    flow = flows(grams, longest)
    heavy = {k: df.filter(F.col("n") >= least) for k, df in flow.items()}
    paths = saved(passages(heavy[longest], heavy[longest - 1], longest), "passages", "zstd")
    totals = grams.filter("k = 0").select("part", F.col("n").alias("total"))
    # Longest phrases are the edges of the passages; nodes inside a passage are as frequent as its edges and go.
    candidates = paths.select("part", F.explode(_grams_in("passage", longest)).alias("gram"), "n").withColumn("k", F.lit(longest))
    inside = paths.select("part", F.explode(_grams_in("passage", longest - 1, 1)).alias("gram"))
    for k in range(longest - 1, 1, -1):
        longer = heavy[k + 1]
        around = longer.select("part", F.expr(_first("gram", k)).alias("gram"), "n").union(longer.select("part", F.expr(_last("gram", k)).alias("gram"), "n"))
        most = around.groupBy("part", "gram").agg(F.max("n").alias("most"))
        shorter = heavy[k] if k < longest - 1 else heavy[k].join(inside, ["part", "gram"], "left_anti")
        free = shorter.join(most, ["part", "gram"], "left").filter(F.coalesce(F.col("most") < F.col("n"), F.lit(True)))
        candidates = candidates.unionByName(free.select("part", "gram", "n").withColumn("k", F.lit(k)))
    counts = heavy[1]
    for k in range(2, longest):
        counts = counts.union(heavy[k])
    counts = saved(counts, "phrase-counts", "zstd")
    cuts = candidates.select("part", "gram", F.col("n").alias("a"), "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("*", F.expr(_first("gram", "cut")).alias("head"), F.expr(_last("gram", "k - cut")).alias("tail"))
    left = counts.select("part", F.col("gram").alias("head"), F.col("n").alias("l"))
    right = counts.select("part", F.col("gram").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(left, ["part", "head"]).join(right, ["part", "tail"]).join(totals, "part")
    exact = "CAST(1000 * a AS DECIMAL(19, 0)) * CAST(total AS DECIMAL(18, 0)) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))"
    best = scored.groupBy("part", "gram", "a", F.col("total").alias("n")).agg(F.min(F.expr(f"struct({exact} AS score, cut, l, r)")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = best.select(F.col("part").alias("lang"), F.col("gram").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
