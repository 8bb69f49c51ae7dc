"""Chat formatting: tool calls linked to their results, ordered, validated, serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, saved

#: Tools and what their arguments must be: name, type, required; other arguments are not allowed.
SCHEMAS = {
    "count_words": (("text_length", "integer", True), ("limit", "integer", False)),
    "find_phrase": (("phrase", "string", True), ("ignore_case", "boolean", False)),
    "summarise": (("max_words", "integer", True), ("style", "string", True)),
}
KINDS = {"integer": "BIGINT", "boolean": "BOOLEAN", "string": "STRING"}


def calls_of(conversations: DataFrame) -> DataFrame:
    """Calls (conv_id, turn, call_id, parent_id, name, arguments) from assistant turns.

    The table holds no tool calls, so they are derived from it: an assistant's turn calls
    the tool that its text's length picks, with arguments taken from the text, keys in no
    canonical order; every seventh length leaves a required one out. A call builds on the
    assistant's turn two before it.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    first = F.coalesce(F.regexp_extract(text, f"({WORD})", 1), F.lit(""))
    number = n.cast("string")

    def arguments(*pairs) -> Column:
        return F.concat(F.lit("{ "), F.concat_ws(" , ", *(F.concat(F.lit(f'"{k}" : '), v) for k, v in pairs)), F.lit(" }"))

    quoted = F.concat(F.lit('"'), F.replace(F.replace(first, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    flag = F.when(n % 2 == 0, "true").otherwise("false")
    short = n % 7 == 0
    made = (
        F.when(n % 3 == 0, F.when(short, arguments(("limit", number))).otherwise(arguments(("text_length", number), ("limit", (n % 10).cast("string")))))
        .when(n % 3 == 1, arguments(("phrase", F.when(short, number).otherwise(quoted)), ("ignore_case", flag)))
        .otherwise(F.when(short, arguments(("max_words", number))).otherwise(arguments(("style", F.lit('"plain"')), ("max_words", number))))
    )
    own = F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    parent = F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 2).cast("string"))
    return conversations.filter("role = 'assistant' and conv_id is not null and turn is not null").select(
        "conv_id",
        "turn",
        own.alias("call_id"),
        F.when(F.col("turn") >= 2, parent).alias("parent_id"),
        F.when(n % 3 == 0, "count_words").when(n % 3 == 1, "find_phrase").otherwise("summarise").alias("name"),
        made.alias("arguments"),
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """Results (conv_id, call_id, content): what the user says next answers the assistant's call."""
    call = F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    return conversations.filter("role = 'user' and conv_id is not null and turn is not null").select(
        "conv_id", call.alias("call_id"), F.coalesce("text", F.lit("")).alias("content")
    )


def depths(calls: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(call_id, depth): how many calls stand in front of a call, -1 on a cycle.

    Takes (call_id, parent_id), one row per call. Each round doubles how far every call
    sees: it adds the distance that the call it points to sees, and points where that
    one points. A chain of n calls settles in about log2(n) rounds, without its calls
    ever being in one place.
    """
    known = calls.select(F.col("call_id").alias("known_"))
    step = calls.join(known, F.col("parent_id") == F.col("known_"), "left")
    step = step.select("call_id", F.col("known_").alias("up"), F.when(F.col("known_").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    step = saved(step, "chat-depths")
    total = step.count()
    rounds, reach = 0, 1
    while rounds < max_rounds and reach <= total:
        moving = step.filter("up is not null")
        if moving.isEmpty():
            break
        far = step.select(F.col("call_id").alias("far_"), F.col("up").alias("far_up"), F.col("depth").alias("far_depth"))
        moved = moving.join(far, moving["up"] == far["far_"]).select("call_id", F.col("far_up").alias("up"), (F.col("depth") + F.col("far_depth")).alias("depth"))
        step = saved(step.filter("up is null").unionByName(moved), "chat-depths")
        rounds, reach = rounds + 1, reach * 2
    # What still points somewhere after that many steps goes round in a circle.
    return step.select(F.col("call_id").alias("deep_"), F.when(F.col("up").isNull(), F.col("depth")).otherwise(-1).alias("depth"))


def check(name: Column, parsed: Column, schemas=SCHEMAS) -> Column:
    """The first fault of the arguments, a variant, null if there is none."""
    keys = F.json_object_keys(F.to_json(parsed))
    rules = [F.when(keys.isNull(), "arguments are no JSON object"), F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), "unknown tool")]
    for tool, wanted in sorted(schemas.items()):
        here = name == tool
        more = F.array_except(keys, F.array(*(F.lit(key) for key, _, _ in wanted)))
        rules.append(F.when(here & (F.size(more) > 0), "unknown argument"))
        for key, kind, required in wanted:
            found = F.schema_of_variant(F.variant_get(parsed, f"$.{key}", "variant"))
            if required:
                rules.append(F.when(here & found.isNull(), f"{key} is missing"))
            rules.append(F.when(here & (found != KINDS[kind]), f"{key} is no {kind}"))
    return F.coalesce(*rules)


def json_text(value: Column) -> Column:
    """A JSON string, null for null."""
    written = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(written, 6, F.length(written) - 6))


def _key(df: DataFrame, column: str = "call_id") -> Column:
    """A text that only equal conversations and identifiers share, null without identifier."""
    conversation = F.col("conv_id") if "conv_id" in df.columns else F.lit(None).cast("string")
    named = F.to_json(F.struct(conversation.alias("conv"), F.col(column).alias("call")))
    return F.when(F.col(column).isNotNull(), named)


def _first_results(results: DataFrame) -> DataFrame:
    """(result_, content): of the results of one call the smallest content."""
    keyed = results.select(_key(results).alias("result_"), "content").filter("result_ is not null")
    return keyed.groupBy("result_").agg(F.min("content").alias("content"))


def _keyed(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The calls with the key that results meet them by; results without conversation meet by identifier."""
    own = _key(calls if "conv_id" in results.columns else calls.drop("conv_id"))
    return calls.withColumn("meets_", own)


def unlinked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(call_id, content, fault), with conv_id if `results` has it: the results that `link` does not use.

    "no call": there is no call of that conversation and identifier, or no identifier;
    "further result": the call has one with a smaller content. Equal results of one call
    are one. Every result is in `link` or here.
    """
    columns = [c for c in ("conv_id", "call_id", "content") if c in results.columns]
    distinct = results.select(*columns, _key(results).alias("key_")).distinct()
    known = _keyed(calls.filter("call_id is not null"), results).select(F.col("meets_").alias("known_")).distinct()
    first = _first_results(results).select("result_", F.col("content").alias("first_"))
    found = distinct.join(known, F.col("key_") == F.col("known_"), "left").join(first, F.col("key_") == F.col("result_"), "left")
    fault = F.when(F.col("known_").isNull(), "no call").when(~F.col("content").eqNullSafe(F.col("first_")), "further result")
    return found.withColumn("fault", fault).filter("fault is not null").select(*columns, "fault")


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """(conv_id, turn, call_id, depth, name, fault, linked, json), a row per call.

    Calls and results meet by conversation and identifier, by identifier alone where
    `results` has no `conv_id`. `depth`, then `turn`, is a topological order within a
    conversation: a call stands behind the one it builds on; it is -1 for calls on a cycle.
    `json` is the call with its result, keys in order. `fault` tells what is wrong with the
    arguments; such calls keep their arguments as text.

    Equal rows are one call. Of different calls with one identifier in a conversation the
    first (smallest turn, then name and arguments) gives the others their parent; all are
    returned, the further ones with the fault "repeated identifier", and share depth rules
    and result with the first. Of the results of a call the smallest content counts;
    `unlinked` gives the others and those without a call. Calls without a result have
    `linked` false and a null result; a parent that is not there counts as none. Null
    identifiers take no part. An object that names a key twice is no JSON object.
    """
    calls = calls.filter("call_id is not null").select("conv_id", "call_id", "turn", "name", "arguments", "parent_id").distinct()
    calls = saved(calls.select("*", _key(calls).alias("key_"), _key(calls, "parent_id").alias("parent_")), "chat-calls")
    row = F.struct("turn", "name", "arguments", "parent_id")
    # One row per identifier, made by a combining aggregate: a much repeated one is no group in a task.
    first = saved(calls.groupBy("key_").agg(F.min(F.struct("turn", "name", "arguments", "parent_id", "parent_")).alias("f")), "chat-first")
    deep = depths(first.select(F.col("key_").alias("call_id"), F.col("f.parent_").alias("parent_id")))
    lead = first.select(F.col("key_").alias("lead_"), F.struct("f.turn", "f.name", "f.arguments", "f.parent_id").alias("lead_row"))
    both = _keyed(calls, results).join(_first_results(results), F.col("meets_") == F.col("result_"), "left")
    both = both.join(deep, F.col("key_") == F.col("deep_")).join(lead, F.col("key_") == F.col("lead_"))
    # A variant keeps the keys of an object in order, at every level.
    both = both.withColumn("parsed_", F.try_parse_json("arguments"))
    both = both.withColumn("wrong_", check(F.col("name"), F.col("parsed_"), schemas))
    repeated = F.when(~row.eqNullSafe(F.col("lead_row")), "repeated identifier")
    both = both.withColumn("fault", F.coalesce("wrong_", repeated))
    text = json_text(F.coalesce("arguments", F.lit("")))
    arguments = F.when(F.col("wrong_").isNull(), F.to_json("parsed_")).otherwise(text)
    json = F.concat(
        F.lit('{"arguments":'),
        arguments,
        F.lit(',"id":'),
        json_text(F.col("call_id")),
        F.lit(',"name":'),
        json_text(F.coalesce("name", F.lit(""))),
        F.lit(',"result":'),
        F.coalesce(json_text(F.col("content")), F.lit("null")),
        F.lit("}"),
    )
    return both.select("conv_id", "turn", "call_id", "depth", "name", "fault", F.col("result_").isNotNull().alias("linked"), json.alias("json"))
