"""The wide table kept up to date: only stays that new rows can change are computed again."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spans as S
from ..operators.spans import SpanCount
from ..sources import stored
from ..sources.workspace import broadcast_if_small, scratch
from .features import EVENT_TIME, FEATURES, counts_of
from .resources import RESOURCES
from .wide import wide_table

#: A new row can change the stays that share one of these with it.
LINKS = ("subject_id", "hadm_id", "stay_id")


def _sharing(df: DataFrame, values: Mapping[str, DataFrame]) -> DataFrame:
    """The rows that share a link with `values`, each once; NULL shares with nothing."""
    columns = df.columns
    hits = []
    for link in LINKS:
        if link in columns and link in values:
            known = values[link].select(F.col(link).alias(f"_{link}"))
            df = df.join(broadcast_if_small(known), F.col(link) == F.col(f"_{link}"), "left")
            hits.append(F.col(f"_{link}").isNotNull())
    if not hits:
        return df
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    return df.where(any_hit).select(*columns)


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _wide_counts() -> list[SpanCount]:
    return [*counts_of(FEATURES), *RESOURCES.values()]


def _bounded(count: SpanCount) -> bool:
    return "stay_id" not in count.keys and count.span is not None and count.span.end is not None


def _hit_in_time(stays: DataFrame, added: Mapping[str, DataFrame]) -> DataFrame:
    """stay_id of the stays with a row of `added` in a day that a bounded count of theirs touches.

    Counts with the same keys share one range of days, from the first start to the last end of
    their spans; those of a week have their own, so that the others stay short.
    """
    groups: dict[tuple, list[SpanCount]] = {}
    for count in filter(_bounded, _wide_counts()):
        groups.setdefault((count.keys, count.span in (S.WEEK, S.WEEK_AFTER_HOUR)), []).append(count)
    ranges, hits = [], {}
    for number, ((keys, _), counts) in enumerate(groups.items()):
        padded = [*keys, *["CAST(NULL AS BIGINT)"] * (2 - len(keys))]
        key = f"'g', {number}, 'k0', {padded[0]}, 'k1', coalesce({padded[1]}, -1)"
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        starts = ", ".join(dict.fromkeys(c.span.start for c in counts))
        ends = ", ".join(dict.fromkeys(c.span.end for c in counts))
        low, high = f"array_min(array({starts}))", f"array_max(array({ends}))"
        ranges.append(f"CASE WHEN {known} THEN named_struct({key}, '_start', {low}, '_end', {high}) END")
        for source in {c.measure.source for c in counts} & set(added):
            some = " OR ".join(dict.fromkeys(f"({c.measure.where})" for c in counts if c.measure.source == source))
            hits.setdefault(source, []).append(f"CASE WHEN ({some}) AND {known} THEN named_struct({key}) END")
    days = []
    for source, tests in hits.items():
        when = EVENT_TIME[source]
        placed = added[source].where(f"({when}) IS NOT NULL")
        placed = placed.selectExpr(f"{S.bucket_of(when)} AS _day", f"explode(array({', '.join(tests)})) AS hit")
        days.append(placed.where("hit IS NOT NULL").selectExpr("hit.*", "_day"))
    if not days:
        return stays.select("stay_id").limit(0)
    keys = ["g", "k0", "k1"]
    found = _kept(reduce(DataFrame.unionByName, days).distinct(), "upkeep-days")
    spread = stays.selectExpr("stay_id", f"explode(array({', '.join(ranges)})) AS r").where("r IS NOT NULL")
    cut = S.with_blocks(spread.selectExpr("stay_id", "r.*"), "_start", "_end").drop("_start", "_end")
    # A day lies in one block of each level; there are few levels, and all are met.
    levels = [r["_level"] for r in cut.select("_level").distinct().collect()]
    if not levels:
        return stays.select("stay_id").limit(0)
    blocks = found.selectExpr(*keys, "_day", f"explode(array({', '.join(map(str, sorted(levels)))})) AS _level")
    blocks = blocks.selectExpr(*keys, "_level", f"{S.block_at('_day')} AS _block").distinct()
    return cut.join(blocks, [*keys, "_level", "_block"], "left_semi").select("stay_id").distinct()


def affected_stays(clinical, added: Mapping[str, DataFrame]) -> DataFrame:
    """The stays of `clinical` that a row of `added` can change; new stays are among them."""
    found: dict[str, DataFrame] = {}
    for name, rows in added.items():
        links = [link for link in LINKS if link in rows.columns]
        if not links:
            raise ValueError(f"{name} has no patient: after a change of a lookup the table is built anew")
        for link in links:
            values = rows.select(link).where(F.col(link).isNotNull())
            found[link] = found[link].union(values) if link in found else values
    values = {link: _kept(rows.distinct(), "upkeep-links") for link, rows in found.items()}
    return _sharing(clinical["edstays"], values)


def changed_stays(clinical, added: Mapping[str, DataFrame]) -> DataFrame:
    """Those of `affected_stays` with a row of `added` in one of their spans, give or take a day.

    Rows with the id of a stay change that stay at any time, as do new stays and triage
    records; rows of patients change all stays of theirs.
    """
    stays = clinical["edstays"]
    timeless = {name: rows for name, rows in added.items() if name in ("edstays", "triage", "patients", "pyxis") or name not in EVENT_TIME}
    own = {name: rows.select(*(["subject_id"] if name == "patients" else ["stay_id"])) for name, rows in timeless.items() if name in ("edstays", "triage", "patients", "pyxis")}
    parts = [affected_stays(clinical, own | {n: r for n, r in timeless.items() if n not in own}).select("stay_id")] if timeless else []
    for count in _wide_counts():
        source, span = count.measure.source, count.span
        if source in added and source not in timeless and not _bounded(count):
            # Without an end the last row of a key decides.
            when = EVENT_TIME[source]
            last = added[source].where(count.measure.where).groupBy(*count.keys).agg(F.expr(f"max({when}) AS _last"))
            pairs = stays.select("stay_id", *count.keys, "intime", "outtime").join(last, list(count.keys))
            parts.append(pairs.where(span.holds("_last") if span else "TRUE").select("stay_id"))
    hit = reduce(DataFrame.union, [*parts, _hit_in_time(stays, added)]).where("stay_id IS NOT NULL").distinct()
    return _sharing(stays, {"stay_id": _kept(hit, "upkeep-hits")})


def create(clinical, path: str) -> None:
    """Store the wide table, keyed by stay."""
    table = wide_table(clinical)
    stored.create(table, path, ["stay_id"], stored.buckets_for(clinical["edstays"]))


def refresh(spark: SparkSession, clinical, added: Mapping[str, DataFrame], path: str) -> list[int]:
    """Bring the stored table up to date; the rewritten buckets are returned.

    `clinical` holds all rows, `added` those that were not there before, by table name;
    rows are added, not changed or taken away. The stays with such a row in one of their spans
    are computed from all their own events, and only events that share a patient, an admission or a stay with
    these enter the shuffles. A stay must have one triage record at most.
    """
    stays = _kept(changed_stays(clinical, added), "upkeep-stays")
    values = {
        link: _kept(stays.select(link).where(F.col(link).isNotNull()).distinct(), "upkeep-own") for link in LINKS
    }

    part = {"edstays": stays}
    for name in ("triage", "pyxis", "pyxis_admin_method", "poe", "transfers", "procedures_icd", "patients",
                 "labevents", "microbiologyevents", "radiology"):
        part[name] = _sharing(clinical[name], values)
    return stored.merge(spark, path, wide_table(part))
