"""Time spans of a stay, and joins and counts of the events that fall into them.

The natural join key, a patient or an admission, may be very uneven: one subject can
own a large part of all events and of all stays. Two things keep such a subject from
becoming one task or a quadratic join:

* the time, cut into slots, is part of each shuffle key;
* counts are differences of running totals inside slots, so no pair of event and stay is
  ever produced. Work and memory grow with events plus stays. An hour holds the totals of
  instants, a day those of hours, a block of days those of days.

Only `interval_join`, whose result is the set of pairs, produces pairs; sums and minima of whole
days are read off blocks of days (`fold_days`).

Conditions and times are SQL text over the columns of a table, so that a plan with
dozens of features is put together in a few calls.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import broadcast_if_small

#: Spans that run through more days than this count them by blocks.
LONG_DAYS = 64
BLOCK_DAYS = 1024
#: A block of the next level of `with_blocks` is 2 to these bits as long; no block reaches past this day.
BLOCK_BITS = 2
DAYS_END = 1 << 28
#: Marks the ends of spans until they are placed on the levels.
ENDS = -1
HOUR_LATER = "intime + INTERVAL '1' HOUR"


def _day_start(when: str) -> str:
    return f"CAST(CAST({when} AS DATE) AS TIMESTAMP_NTZ)"


def _day_end(when: str) -> str:
    """Last microsecond of the calendar day."""
    return f"{_day_start(when)} + INTERVAL '1' DAY - INTERVAL '0.000001' SECOND"


@dataclass(frozen=True)
class Span:
    """A time range relative to a stay, as SQL expressions over the stay's columns.

    Both ends belong to the span unless `open_start` is set. `end=None` leaves the
    span without an upper bound.
    """

    name: str
    start: str
    end: str | None
    open_start: bool = False

    def holds(self, when: str) -> str:
        """SQL condition that a time lies in the span."""
        after = f"{when} {'>' if self.open_start else '>='} {self.start}"
        return f"({after})" if self.end is None else f"({after} AND {when} <= {self.end})"


IN_STAY = Span("in_stay", "intime", "outtime")
FIRST_HOUR = Span("first_hour", "intime", HOUR_LATER)
AFTER_HOUR_IN_STAY = Span("after_hour_in_stay", HOUR_LATER, "outtime")
PAST_HOUR_IN_STAY = Span("past_hour_in_stay", HOUR_LATER, "outtime", open_start=True)
PAST_HOUR = Span("past_hour", HOUR_LATER, None, open_start=True)
FIRST_TWO_HOURS = Span("first_two_hours", "intime", "intime + INTERVAL '120' MINUTE")
WEEK_AFTER_HOUR = Span("week_after_hour", HOUR_LATER, "intime + INTERVAL '7' DAY")
WEEK = Span("week", "intime", "intime + INTERVAL '7' DAY")
# The first hour, but not past the calendar day of departure.
FIRST_HOUR_SAME_DAYS = Span(
    "first_hour_same_days",
    "intime",
    f"CASE WHEN outtime IS NOT NULL THEN least({HOUR_LATER}, {_day_end('outtime')}) END",
)
PAST_HOUR_SAME_DAYS = Span(
    "past_hour_same_days", HOUR_LATER, _day_end("outtime"), open_start=True
)
STAY_DAYS = Span("stay_days", _day_start("intime"), _day_end("outtime"))
STAY_DAYS_PLUS_ONE = Span(
    "stay_days_plus_one",
    _day_start("intime"),
    _day_end("(outtime + INTERVAL '1' DAY)"),
)


def bucket_of(when: str) -> str:
    """The day of a time, as a number."""
    return f"unix_date(CAST({when} AS DATE))"


def hour_of(when: str) -> str:
    return f"(unix_date(CAST({when} AS DATE)) * 24 + hour({when}))"


def block_of(day: str) -> str:
    return f"CAST(floor({day} / {BLOCK_DAYS}) AS INT)"


def with_blocks(df: DataFrame, start: str, end: str | None) -> DataFrame:
    """One row per block of the days that the closed range touches; none if it is empty.

    A block of level j is 4 to the j days, aligned. A range is cut into the fewest blocks: six
    of a level at most, so their number grows with the logarithm of its days. `end=None` runs
    on to the last block there is. Adds `_level` and `_block`.
    """
    last = f"unix_date(CAST({end} AS DATE)) + 1" if end else str(DAYS_END)
    low = "shiftright(_first + shiftleft(1, {0}) - 1, {0})"
    high = "shiftright(_last, {0})"
    own, up = f"{BLOCK_BITS} * j", f"{BLOCK_BITS} * (j + 1)"
    levels = f"sequence(0, CAST(ceil(log2(_last - _first + 1) / {BLOCK_BITS}) AS INT))"
    # Of each level its blocks within the range, and those of them that make up blocks of the next.
    ranges = (
        f"transform({levels}, j -> named_struct('j', j, 'lo', {low.format(own)}, 'hi', {high.format(own)},"
        f" 'from', shiftleft({low.format(up)}, {BLOCK_BITS}), 'upto', shiftleft({high.format(up)}, {BLOCK_BITS})))"
    )
    front = "if(x.lo < least(x.hi, x.from), sequence(x.lo, least(x.hi, x.from) - 1), array())"
    rest = "greatest(x.upto, least(x.hi, x.from))"
    rear = f"if(x.lo < x.hi AND {rest} < x.hi, sequence({rest}, x.hi - 1), array())"
    blocks = f"transform(concat({front}, {rear}), b -> named_struct('_level', x.j, '_block', b))"
    cover = f"flatten(transform({ranges}, x -> {blocks}))"
    # A range too short for a larger block is its days.
    day = "named_struct('_level', 0, '_block', _first + {0})"
    for n in range(3, 0, -1):
        cover = f"CASE WHEN _last - _first = {n} THEN array({', '.join(day.format(i) for i in range(n))}) ELSE {cover} END"
    ranged = df.where(f"{start} <= {end}" if end else f"{start} IS NOT NULL")
    return (
        ranged.selectExpr("*", f"unix_date(CAST({start} AS DATE)) AS _first", f"{last} AS _last")
        .selectExpr("*", f"inline({cover})")
        .drop("_first", "_last")
    )


def block_at(day: str, level: str = "_level") -> str:
    """The block of that level in which a day lies."""
    return f"shiftright({day}, {BLOCK_BITS} * {level})"


def _in_blocks(events: DataFrame, cut: DataFrame, keys: list[str], day: str) -> DataFrame:
    """One row per event and level: its day, and the larger blocks that ranges of its keys use.

    Most ranges are a few days and their blocks are days; only events of keys that have larger
    blocks get those too, each level once.
    """
    levels = cut.where("_level > 0").groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    level = "explode(concat(array(0), coalesce(_levels, array()))) AS _level"
    placed = events.join(broadcast_if_small(levels), keys, "left").selectExpr("*", level)
    return placed.selectExpr("*", f"{block_at(day)} AS _block").drop("_levels")


def interval_join(
    stays: DataFrame, events: DataFrame, keys: list[str], time: str, span: Span
) -> DataFrame:
    """Every pair of a stay and an event inside the span of the stay.

    The days of a span are cut into blocks, their number grows with the logarithm of its
    length, and both sides meet by keys and block. An event lies in exactly one block of a
    span, so each pair is found once. Events that carry the id of their stay meet one stay
    and need no blocks. What remains uneven, many events of a key on one day, is split by
    adaptive skew-join handling. Apart from the keys the sides must not share column names.
    """
    inside = Span("", "_start", "_end" if span.end else None, span.open_start).holds(time)
    ends = [f"{span.end} AS _end"] if span.end else []
    placed = stays.selectExpr("*", f"{span.start} AS _start", *ends)
    if "stay_id" in keys:
        return placed.join(events, keys).where(inside).drop("_start", "_end")
    cut = with_blocks(placed, "_start", "_end" if span.end else None)
    pairs = cut.join(_in_blocks(events, cut, keys, bucket_of(time)), [*keys, "_level", "_block"])
    return pairs.where(inside).drop("_start", "_end", "_level", "_block")


def fold_days(
    stays: DataFrame, per_day: DataFrame, keys: list[str], span: Span, value: str, how: str
) -> DataFrame:
    """stay_id and `value` folded by `how` (sum, min or max) over the days of a span of whole days.

    `per_day` has the keys, `day` and `value`. Days are folded to blocks before they meet the
    stays: a stay reads as many rows as it has blocks, whatever its length. Stays without a
    day are left out.
    """

    met = [*keys, "_level", "_block"]
    folded = F.expr(f"{how}({value}) AS {value}")
    cut = with_blocks(stays, span.start, span.end).select("stay_id", *met)
    blocks = _in_blocks(per_day.select(*keys, "day", value), cut, keys, "day").groupBy(*met).agg(folded)
    return cut.join(blocks, met).groupBy("stay_id").agg(folded)


@dataclass(frozen=True)
class Measure:
    """What to count: rows of a source that satisfy a condition, or an amount per row.

    Both are SQL over the source's columns. Rows that fail `where` add nothing.
    """

    name: str
    source: str
    where: str
    amount: str = "1"


@dataclass(frozen=True)
class SpanCount:
    """A measure summed over the events in a span of each stay.

    `keys` are the columns an event shares with its stays. `span=None` counts over all
    time.
    """

    name: str
    measure: Measure
    keys: tuple[str, ...]
    span: Span | None


@dataclass(frozen=True)
class EventSource:
    """A table of events and the expression of the time at which they happen."""

    df: DataFrame
    time: str | None


def _group(items, key):
    grouped: dict = {}
    for item in items:
        grouped.setdefault(key(item), []).append(item)
    return grouped


def _known(columns) -> str:
    return " AND ".join(f"{column} IS NOT NULL" for column in columns)


def _any_measure(measures) -> str:
    return "(" + " OR ".join(dict.fromkeys(f"({m.where})" for m in measures)) + ")"


@dataclass(frozen=True)
class _Pass:
    """Counts with the same keys: they share points and totals.

    Measures and spans are numbered within the pass, so that all passes can use the same
    few columns for their running totals and weights.
    """

    number: int
    keys: tuple[str, ...]
    counts: tuple[SpanCount, ...]

    @property
    def measures(self) -> list[Measure]:
        return list(dict.fromkeys(c.measure for c in self.counts))

    @property
    def spans(self) -> list[Span]:
        return list(dict.fromkeys(c.span for c in self.counts))

    def key_fields(self, width: int) -> str:
        """Struct fields k0, k1, ... that hold the keys, padded to the common width."""
        padded = [*self.keys, *["CAST(NULL AS BIGINT)"] * (width - len(self.keys))]
        return ", ".join(f"'k{i}', {key}" for i, key in enumerate(padded))


def _passes(counts) -> list[_Pass]:
    groups = _group(counts, lambda c: c.keys)
    return [_Pass(number, keys, tuple(group)) for number, (keys, group) in enumerate(groups.items())]


def _measured(source: EventSource, name: str, passes, width: int) -> DataFrame:
    """(pass, keys, measure, n, level, slot, pos, t): a row per event, measure it counts for, and level."""
    hits, tests = [], []
    for p in passes:
        for number, m in enumerate(p.measures):
            if m.source != name:
                continue
            test = f"({m.where}) AND {_known(p.keys)}"
            tests.append(f"({test})")
            hits.append(
                f"CASE WHEN {test} THEN named_struct('pass', {p.number},"
                f" {p.key_fields(width)}, 'measure', {number}, 'n', CAST({m.amount} AS BIGINT)) END"
            )
    hit = hits[0] if len(hits) == 1 else f"explode(array({', '.join(hits)}))"
    places = (
        ("0", "_hour", "0", "_t"),
        ("1", "_day", "_hour", "CAST(NULL AS TIMESTAMP_NTZ)"),
        ("2", block_of("_day"), "_day", "CAST(NULL AS TIMESTAMP_NTZ)"),
    )
    levels = ", ".join(
        f"named_struct('level', {level}, 'slot', {slot}, 'pos', {pos}, 't', {t})"
        for level, slot, pos, t in places
    )
    when = source.time
    return (
        source.df.where(f"({when}) IS NOT NULL AND ({' OR '.join(tests)})")
        .selectExpr(f"{when} AS _t", f"{bucket_of(when)} AS _day", f"{hour_of(when)} AS _hour", f"{hit} AS hit")
        .where("hit IS NOT NULL")
        .selectExpr("hit.*", f"inline(array({levels}))")
    )


def _point_list(p: _Pass, width: int, weights: int, prefix: str) -> tuple[dict, str]:
    """The points of one pass: helper columns over the stay, and an SQL array of points.

    A span subtracts the total at its start and adds the total at its end, in the hour and
    in the day. It adds the total of every day, or every block of days, it runs through.
    Spans share the points they have in common. `side` places a point before (-1) or
    after (1) the events of its instant.
    """
    spans = range(len(p.spans))
    points: dict[tuple[str, int], dict[int, int]] = {}
    helpers = {}
    ok, first, last, long_ = (f"{prefix}{name}" for name in ("ok", "first", "last", "long"))
    for i, span in enumerate(p.spans):
        points.setdefault((span.start, 1 if span.open_start else -1), {})[i] = -1
        points.setdefault((span.end, 1), {})[i] = 1
        day, end = bucket_of(span.start), bucket_of(span.end)
        helpers[f"{ok}{i}"] = f"{_known(p.keys)} AND coalesce({span.start} <= {span.end}, FALSE)"
        helpers[f"{first}{i}"] = day
        helpers[f"{last}{i}"] = f"{end} - 1"
        helpers[f"{long_}{i}"] = f"{end} - {day} > {LONG_DAYS}"

    far = " + ".join(f"if({long_}{i}, {1 << i}, 0)" for i in spans)

    def struct(level, slot, pos, t, side, values):
        values = [*values, *["0"] * (weights - len(values))]
        listed = ", ".join(f"'w{i}', {w}" for i, w in enumerate(values))
        return (
            f"named_struct('pass', {p.number}, {p.key_fields(width)}, 'level', {level}, 'slot', {slot},"
            f" 'pos', {pos}, 't', {t}, 'side', {side}, 'far', {far if level == ENDS else 0}, {listed})"
        )

    no_time = "CAST(NULL AS TIMESTAMP_NTZ)"
    marks = [
        struct(ENDS, bucket_of(t), hour_of(t), t, side, [f"if({ok}{i}, {of[i]}, 0)" if i in of else "0" for i in spans])
        for (t, side), of in points.items()
    ]

    def through(level, holds, low_of, high_of, pos):
        """A point at the end of every slot from the lowest to the highest of the spans."""
        low = f"array_min(array({', '.join(f'if({holds(i)}, {low_of(i)}, NULL)' for i in spans)}))"
        high = f"array_max(array({', '.join(f'if({holds(i)}, {high_of(i)}, NULL)' for i in spans)}))"
        values = [f"if({holds(i)} AND b BETWEEN {low_of(i)} AND {high_of(i)}, 1, 0)" for i in spans]
        point = struct(level, "b", pos, no_time, "-1", values)
        return f"if({low} <= {high}, transform(sequence({low}, {high}), b -> {point}), array())"

    days = through(1, lambda i: f"({ok}{i} AND NOT {long_}{i})", lambda i: f"{first}{i}", lambda i: f"{last}{i}", "(b + 1) * 24")
    blocks = through(
        2,
        lambda i: f"({ok}{i} AND {long_}{i})",
        lambda i: block_of(f"{first}{i}"),
        lambda i: f"({block_of(f'({last}{i} + 1)')} - 1)",
        f"(b + 1) * {BLOCK_DAYS}",
    )
    return helpers, f"array({', '.join(marks)}), {days}, {blocks}"


def _points(stays: DataFrame, passes, width: int, weights: int) -> DataFrame:
    """(stay, pass, keys, level, slot, pos, t, side, weights): where running totals are read."""
    helpers, lists = {}, []
    for p in passes:
        own, points = _point_list(p, width, weights, f"_p{p.number}_")
        helpers.update(own)
        lists.append(points)
    ws = [f"w{i}" for i in range(weights)]
    listed = ", ".join(f"'{w}', {w}" for w in ws)
    distant = ", ".join(f"'{w}', if((far & {1 << i}) <> 0, {w}, 0)" for i, w in enumerate(ws))

    def placed(level, slot, pos, t, side, values):
        return f"named_struct('level', {level}, 'slot', {slot}, 'pos', {pos}, 't', {t}, 'side', {side}, {values})"

    # The end of a span is a point of its hour, of its day and, if far, of its block.
    no_time = "CAST(NULL AS TIMESTAMP_NTZ)"
    near = [placed(0, "pos", 0, "t", "side", listed), placed(1, "slot", "pos", no_time, -1, listed)]
    block = placed(2, block_of("slot"), "slot", no_time, -1, distant)
    itself = placed("level", "slot", "pos", "t", "side", listed)
    levels = (
        f"CASE WHEN level <> {ENDS} THEN array({itself}) WHEN far = 0 THEN array({', '.join(near)})"
        f" ELSE array({', '.join([*near, block])}) END"
    )
    keys = ["pass", *[f"k{i}" for i in range(width)]]
    some = " OR ".join(f"{w} <> 0" for w in ws)
    # A stay has dozens of points: stays out of few files are spread before they have them. The
    # number is given, since so few bytes would be put together again.
    spark = stays.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    own = list(dict.fromkeys(["stay_id", "intime", "outtime", *[k for p in passes for k in p.keys]]))
    return (
        stays.select(*own)
        .repartition(parts, "stay_id")
        .selectExpr("*", *[f"{sql} AS {name}" for name, sql in helpers.items()])
        .selectExpr("stay_id AS _stay", f"explode(concat({', '.join(lists)})) AS point")
        .selectExpr("_stay", "point.*")
        .where(some)
        .selectExpr("_stay", *keys, f"inline({levels})")
        .where(some)
    )


def _running_counts(stays, sources, counts) -> DataFrame:
    """Counts of events that share keys with a stay, by running totals on three levels.

    Events are folded on the map side to a row per instant within the hour, per hour within
    the day, and per day within a block of days. A total up to a point is the sum of the
    totals up to it in its hour, its day and, for long spans, its block. One window runs
    through the rows and points of each key, level and slot, for all passes at once: no task
    holds more of a key than the instants of an hour, and the points of a day. Days that a
    long span runs through are counted by blocks, so a departure in the far future costs
    few points.
    """
    passes = _passes(counts)
    width = max(len(p.keys) for p in passes)
    weights = max(len(p.spans) for p in passes)
    totals = max(len(p.measures) for p in passes)
    key = ["pass", *[f"k{i}" for i in range(width)], "level", "slot"]
    # A hash of the key comes first: most comparisons of the sort end at it.
    cell = f"xxhash64({', '.join(key)}) AS cell"
    place = ["pos", "t"]
    names = dict.fromkeys(m.source for p in passes for m in p.measures)
    frames = [_measured(sources[name], name, passes, width) for name in names]
    folded = (
        reduce(DataFrame.unionByName, frames)
        .groupBy(*key, *place, "measure")
        .agg(F.sum("n").alias("n"))
        .selectExpr("*", "0 AS side")
    )
    running = (
        f"OVER (PARTITION BY cell, {', '.join(key)} ORDER BY pos, t, side"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    # Partitioned and sorted before the measures are spread over columns: the shuffle and
    # the sort handle one narrow row per folded event or point.
    read = (
        folded.unionByName(
            _points(stays, passes, width, weights), allowMissingColumns=True
        )
        .repartition(*key)
        .selectExpr("*", cell)
        .sortWithinPartitions("cell", *key, *place, "side")
        .selectExpr(
            "_stay",
            "pass",
            *[f"w{i}" for i in range(weights)],
            *[
                f"sum(CASE WHEN measure = {i} THEN n ELSE 0 END) {running} AS _m{i}"
                for i in range(totals)
            ],
        )
        .where("_stay IS NOT NULL")
    )
    # Most points of most stays read a total of zero; they need not travel on.
    return read.where(" OR ".join(f"_m{i} <> 0" for i in range(totals))).selectExpr(
        "_stay AS stay_id",
        *[
            f"CASE WHEN pass = {p.number} THEN w{p.spans.index(c.span)} *"
            f" _m{p.measures.index(c.measure)} ELSE 0 END AS `{c.name}`"
            for p in passes
            for c in p.counts
        ],
    )


def _stay_counts(stays, source: EventSource, counts) -> DataFrame:
    """Counts of events that carry the id of their own stay.

    Such an event meets one stay, so a join on the id is linear, however long the stay is.
    The sums that follow combine on the map side.
    """
    bounded = [c for c in counts if c.span is not None]
    events = source.df.where(
        f"{_known(['stay_id'])} AND {_any_measure(c.measure for c in counts)}"
    ).selectExpr(
        "stay_id",
        "subject_id AS _subject",
        f"{source.time} AS _t",
        *[
            f"CAST(CASE WHEN {c.measure.where} THEN {c.measure.amount} ELSE 0 END"
            f" AS BIGINT) AS `{c.name}`"
            for c in counts
        ],
    )
    if not bounded:
        return events.selectExpr("stay_id", *[f"`{c.name}`" for c in counts])

    def counted(c: SpanCount) -> str:
        if c.span is None:
            return f"`{c.name}`"
        inside = c.span.holds("_t")
        if "subject_id" in c.keys:
            inside += " AND _subject = subject_id"
        return f"CASE WHEN {inside} THEN `{c.name}` ELSE 0 END AS `{c.name}`"

    joined = events.join(stays.select("stay_id", "subject_id", "intime", "outtime"), "stay_id")
    return joined.selectExpr("stay_id", *[counted(c) for c in counts])


def _key_totals(stays, source: EventSource, keys, counts) -> DataFrame:
    """Counts without an upper time bound: one row per key, then one join to the stays.

    A span that only has a start needs no count: the latest event decides, and the
    result is 1 or 0.
    """
    totals = (
        source.df.where(f"{_known(keys)} AND {_any_measure(c.measure for c in counts)}")
        .groupBy(*keys)
        .agg(
            *[
                F.expr(
                    f"CAST(sum(CASE WHEN {c.measure.where} THEN {c.measure.amount} ELSE 0 END) AS BIGINT) AS `{c.name}`"
                    if c.span is None
                    else f"max(CASE WHEN {c.measure.where} THEN {source.time} END) AS `{c.name}`"
                )
                for c in counts
            ]
        )
    )
    columns = list(dict.fromkeys(["stay_id", *keys, "intime", "outtime"]))
    return (
        stays.select(*columns)
        .join(totals, list(keys))
        .selectExpr(
            "stay_id",
            *[
                f"`{c.name}`"
                if c.span is None
                else f"CAST(CASE WHEN {c.span.holds(f'`{c.name}`')} THEN 1 ELSE 0 END"
                f" AS BIGINT) AS `{c.name}`"
                for c in counts
            ],
        )
    )


def count_in_spans(
    stays: DataFrame, sources: dict[str, EventSource], counts: list[SpanCount]
) -> DataFrame:
    """One row per stay that any event was found for, one BIGINT column per count.

    Each source is read once for all counts by running totals. All counts meet in a
    single aggregation by stay.
    """
    by_stay = [c for c in counts if "stay_id" in c.keys]
    others = [c for c in counts if "stay_id" not in c.keys]
    bounded = [c for c in others if c.span is not None and c.span.end is not None]
    unbounded = [c for c in others if c.span is None or c.span.end is None]
    parts = []
    if bounded:
        parts.append((_running_counts(stays, sources, bounded), bounded))
    for name, group in _group(by_stay, lambda c: c.measure.source).items():
        parts.append((_stay_counts(stays, sources[name], group), group))
    for (keys, name), group in _group(
        unbounded, lambda c: (c.keys, c.measure.source)
    ).items():
        parts.append((_key_totals(stays, sources[name], keys, group), group))
    names = [c.name for c in counts]

    def aligned(part, group):
        own = {c.name for c in group}
        return part.selectExpr(
            "stay_id",
            *[f"`{n}`" if n in own else f"CAST(0 AS BIGINT) AS `{n}`" for n in names],
        )

    union = reduce(DataFrame.unionByName, [aligned(*part) for part in parts])
    return union.groupBy("stay_id").agg(*[F.expr(f"sum(`{n}`) AS `{n}`") for n in names])
