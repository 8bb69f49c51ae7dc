"""Mixing sources to target weights: capped water-filling in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import broadcast_if_small
from .common import WORD, saved

#: Weights by the position of a source in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Each source is cut into 16 to this power ranges of its seeded order.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, epochs: float, weights=WEIGHTS) -> DataFrame:
    """One row per source with its target.

    Takes (source, source_size), one row per source: this table grows with the number of
    sources only. The targets are min(cap, level * weight) at the level where they sum to
    `share` of all sizes. Clamping a source and resharing its excess until none is above
    its cap ends at that level; here it is read off running sums of the sources sorted by
    cap / weight: the sources before the first that is not full are clamped.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "position")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    return (
        sources.withColumn("position", F.row_number().over(by_name) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)))
        .withColumn("level", level)
        # The first source that its share does not fill sets the level for all behind it;
        # what further sources would give is lower.
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))),
        )
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    share: float = 1.5,
    epochs: float = 2.0,
    seed: int = 17,
    weights=WEIGHTS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) and the columns in `keep`, a row per document.

    A source takes its documents target / source_size times: whole repetitions of each,
    and for the fractional rest further documents in an order seeded by `seed` until the
    target is met; the last of these is cut (its first words count). So every source
    takes exactly the whole part of its target.

    No task sees a source as a whole. The seeded order is cut into 4096 ranges; the sums
    of the ranges say which are taken whole and which one the target falls into, and only
    that range is ordered document by document.

    Null texts have size 0, a null source is a source of its own (last), null ids are
    kept and ordered by their size. Repeated rows count and are taken each. An empty
    table gives an empty result; sources of size 0 have target 0.
    """
    sized = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size")).withColumn(
        "at", F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.col("size")), "UTF-8"))
    )
    # Texts that are kept are read again, not copied to the shared folder.
    narrow = saved(sized.select("source", "size", "at", *([] if keep else ["doc_id"])), "mix-sizes")
    sized = sized if keep else narrow
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = (
        targets(totals, share, epochs, weights)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    bucket = F.substring("at", 1, BUCKET_DIGITS)
    ranges = narrow.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = saved(
        ranges.withColumn("before", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)))
        .join(goals.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
        .drop("source_"),
        "mix-ranges",
    )
    # One row per source at most: the range in which its rest runs out.
    edge = ranges.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest")))
    edge = edge.select(F.col("source").alias("source_"), F.col("bucket").alias("edge"), F.col("before").alias("edge_before"))
    facts = ranges.groupBy("source").agg(*(F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")))
    facts = facts.join(edge, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    facts = facts.withColumnRenamed("source", "source_")
    # Ranges before the edge are taken again whole. Without an edge the rest ends with a
    # range, the last that starts below it.
    last = ranges.filter(F.col("before") < F.col("rest")).groupBy("source").agg(F.max("bucket").alias("last"))
    last = last.withColumnRenamed("source", "source__")
    facts = facts.join(last, F.col("source_").eqNullSafe(F.col("source__")), "left").drop("source__")
    facts = broadcast_if_small(saved(facts, "mix-facts"))
    rows = sized.withColumn("bucket", bucket).join(facts, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    rows = rows.withColumn("at_edge", F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False)))
    inside = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", *(c for c in keep if c == "text")).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.filter("at_edge").withColumn("reached", F.col("edge_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("reached")))).drop("reached")
    even = rows.filter("not at_edge").withColumn("more", F.when(F.col("bucket") <= F.col("last"), F.col("size")).otherwise(0))
    return even.unionByName(cut).select(
        "doc_id",
        "source",
        *keep,
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"),
    )


def repeat(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed documents themselves, with the columns of `docs`.

    A document appears once per repetition that `mix` takes, and once more with its
    first words if it is the one that is cut.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    columns = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*columns).alias("row_"))
    mixed = mix(packed, share, epochs, seed, keep=("text", "row_"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("int"), times.cast("int")),
        F.when(part > 0, F.array(part.cast("int"))).otherwise(F.array().cast("array<int>")),
    )
    out = mixed.withColumn("copy_", F.explode(copies))
    cut = F.array_join(F.slice(words, 1, F.greatest(F.col("copy_"), F.lit(1))), " ")
    out = out.withColumn("text", F.when(F.col("copy_") > 0, cut).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in columns:
        kept = F.col("row_.n_chars")
        changed["n_chars"] = F.when(F.col("copy_") > 0, F.length("text")).otherwise(kept).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(f"row_.{c}")).alias(c) for c in columns))
