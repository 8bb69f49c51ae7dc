"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.workspace import broadcast_if_small
from .common import fresh, in_parts, saved
from .components import components

BITS = 64
#: Fingerprints differing in at most two bits link: of two segments one then differs in one bit at most.
SEGMENT = 32
#: A signature shared by more fingerprints than this is not compared pair by pair.
CROWD = 32
#: Signature k: the segment that holds bit k without that bit, and k itself above it.
SIGNATURE = f"(shiftright(fp, {SEGMENT} * cast(k div {SEGMENT} as int)) & {(1 << SEGMENT) - 1}L & ~shiftleft(1L, k % {SEGMENT})) | shiftleft(cast(k as long), {SEGMENT})"


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash, signed. No word, no text: zero."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and the six white-space characters.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    ones, n, total = np.zeros(BITS, np.int64), 0, max(1, len(found) - words + 1)
    shingles = iter(shingles)
    while n < total:
        part = min(total - n, 65536)
        hashes = np.fromiter((xxhash.xxh64_intdigest(next(shingles), seed) for _ in range(part)), np.uint64, part)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(part, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += part
    packed = np.packbits(ones * 2 > total, bitorder="little")
    return int(packed.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in in_parts(texts):
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (src, dst) between the reps of fingerprints two bits apart or less.

    Takes (fp, rep), one row per fingerprint. The edges connect what such pairs connect;
    fingerprints of a crowd are linked through the smallest rep, not in all pairs.

    Fingerprints that share a signature with few others are compared with them. For a
    signature that many share, a pair within two bits is found by the signatures of the
    whole fingerprint without any two bits: four fingerprints at most have one in common,
    so there is no group to enumerate, whatever the size of the crowd.
    """
    signed = prints.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("k"))
    signed = signed.select("fp", "rep", F.expr(SIGNATURE).alias("sig"))
    shared = saved(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-counts")
    # Most signatures have one owner; the rest are broadcast while they are small, else both sides move.
    members = saved(signed.join(broadcast_if_small(shared), "sig").select("sig", "fp", "rep", "n"), "simhash-shared")

    few = members.filter(F.col("n") <= crowd).groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("rep", "fp"))).alias("m"))
    near = few.select(F.explode("m").alias("a"), "m").select(
        F.col("a.rep").alias("src"),
        F.explode(
            F.transform(
                F.filter("m", lambda b: (b["rep"] > F.col("a.rep")) & (_apart(b["fp"], F.col("a.fp")) <= 2)), lambda b: b["rep"]
            )
        ).alias("dst"),
    )

    crowded = members.filter(F.col("n") > crowd).select("fp", "rep").distinct()
    pairs = crowded.select("fp", "rep", F.explode(F.sequence(F.lit(1), F.lit(BITS - 1))).alias("i"))
    pairs = pairs.select("fp", "rep", "i", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("j"))
    pairs = pairs.selectExpr("rep", "fp", "shiftleft(1L, i) as i", "shiftleft(1L, j) as j")
    at = "if(fp & i = 0, 0, 2) + if(fp & j = 0, 0, 1) as at"
    pairs = pairs.selectExpr("rep", "i | j as bits", "fp & ~(i | j) as rest", at)
    # The four places a fingerprint can have in a group; all in it are two bits apart or less.
    stars = pairs.groupBy("bits", "rest").agg(*(F.max(F.when(F.col("at") == k, F.col("rep"))).alias(f"m{k}") for k in range(4)))
    group = F.array_sort(F.array_compact(F.array("m0", "m1", "m2", "m3")))
    stars = stars.select(group.alias("m")).filter(F.size("m") > 1)
    stars = stars.select(F.element_at("m", 1).alias("src"), F.explode(F.slice("m", 2, 3)).alias("dst"))
    return near.unionByName(stars).distinct()


def named(printed: DataFrame) -> DataFrame:
    """(fp_, component_id) of every fingerprint of (doc_id, fp).

    Fingerprints are linked by themselves, so one without any id links too; a component
    has the smallest id of all its rows.
    """
    reps = saved(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    roots = components(links(reps.select("fp", F.col("fp").alias("rep"))))
    rooted = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(least, "root").select(F.col("fp").alias("fp_"), "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of `docs`.

    A null text counts as empty; empty texts have fingerprint zero and link like any
    other. Repeated rows share a component. A row with a null id is linked to others by
    its fingerprint but names no component; if all rows of a component have null ids,
    its name is null. An empty table gives an empty result.
    """
    # Distinct fingerprints stand for their documents: copies cost one row each from here on.
    printed = saved(docs.select("doc_id", fingerprints("text").alias("fp")), "simhash-prints")
    # A fingerprint may hold a third of all rows; both sides are plain tables, so an uneven
    # join is split at run time.
    groups = saved(named(printed), "simhash-named")
    return printed.join(groups, printed["fp"] == groups["fp_"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The documents, one of each component: the one with the smallest id.

    `groups` gives (doc_id, component_id) of every row, here or as `copies.near_groups`. Rows that share an id are one document, of which the row with the smallest text
    stays. Rows with a null id stay.
    """
    roots = groups(docs).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_")).agg(F.count(F.lit(1)).alias("n"))
    roots = saved(roots, "simhash-kept")

    name = fresh(docs, "kept_")

    def of(ids: DataFrame) -> DataFrame:
        return docs.join(broadcast_if_small(ids.select(F.col("kept_").alias(name))), docs["doc_id"] == F.col(name), "left_semi")

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = of(roots.filter("n > 1")).groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("row_"))
    again = again.select("doc_id", "row_.*").select(*docs.columns)
    return of(roots.filter("n = 1")).unionByName(again).unionByName(docs.filter("doc_id is null"))
