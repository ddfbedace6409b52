"""Tool-call linking in conversations, with DataFrame functions only.

Turns are rows (conv_id, turn, role, text).  An assistant's text that is a JSON
object with ``tool_calls`` makes calls: objects with id, name, arguments (an object,
or its JSON as a string) and, optionally, depends_on (ids of calls whose results it
uses); its own ``content``, where it isn't null, is a message beside them.  A tool's text
that is a JSON object with ``tool_call_id`` is a result, with its ``content``.  Every
other turn is a message, JSON or not.

Calls are hash-joined to results by conversation and identifier.  A call's level
is 0, or one more than the highest level it depends on; calls in a cycle, or
after one, have none.  Identifiers that no call has are no obstacle, but make
the call invalid.  Arguments are checked against schemas (tool, param, type,
required), type being string, integer, number, boolean, array or object; null is
allowed for an argument that isn't required.

One row for each message, call and result comes out, with its canonical JSON: keys
in order, no white space.  Nothing gathers a conversation in one task, so one of
any length is spread over many.  Rows order a conversation by turn, level
and ordinal.

Null texts and roles are null in the JSON; a null conversation is one like others,
and so is a call without an identifier; empty tables give no rows; rows that
repeat give repeated rows; of several results with one identifier the first
turn's is linked, and of several calls with one identifier each is linked to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: What schema_of_variant says of a value, for each type a schema may name.
TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


def split_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results."""
    start = F.ltrim("text")
    whole = turns.select("conv_id", "turn", "role", "text")
    parsed = whole.withColumn("made", F.when((F.col("role") == "assistant") & start.startswith("{"), F.from_json("text", CALLS))).withColumn(
        "got", F.when((F.col("role") == "tool") & start.startswith("{"), F.from_json("text", RESULT))
    )
    is_call = F.coalesce(F.size("made.tool_calls") > 0, F.lit(False))
    is_result = F.col("got.tool_call_id").isNotNull()
    said = F.when(is_call, F.col("made.content")).otherwise(F.col("text"))
    messages = parsed.where((~is_call & ~is_result) | (is_call & F.col("made.content").isNotNull())).select("conv_id", "turn", "role", said.alias("text"))
    calls = parsed.where(is_call).select("conv_id", "turn", F.posexplode("made.tool_calls").alias("ordinal", "c"))
    calls = calls.select("conv_id", "turn", "ordinal", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.try_parse_json("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = parsed.where(is_result).select("conv_id", "turn", F.col("got.tool_call_id").alias("call_id"), F.col("got.content").alias("content"))
    return messages, calls, results


def same(*names: str):
    """Equality of each of the columns with that of the same name and ``of_`` before it; nulls are equal."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(name).eqNullSafe(F.col(f"of_{name}"))
    return out


def as_other(table: DataFrame, *names: str) -> DataFrame:
    return table.withColumnsRenamed({name: f"of_{name}" for name in names})


def with_levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds level; and missing, the number of unknown identifiers.

    Chains of calls with one known need each are shortened by pointer jumping: in each
    round a call points as far again, so a chain takes the logarithm of its
    length.  What is left, calls of several needs, is placed by rounds, one for each level of those.
    """
    key = ("conv_id", "call_id")
    named = scratch.keep(calls.select(*key).distinct())
    edges = scratch.keep(calls.select(*key, F.explode(F.array_distinct("depends_on")).alias("needs")).distinct())
    of = as_other(named.withColumnRenamed("call_id", "needs"), "conv_id", "needs")
    known = scratch.keep(edges.join(of, same("conv_id", "needs"), "left_semi"))
    missing = edges.join(of, same("conv_id", "needs"), "left_anti").groupBy(*key).agg(F.count("*").alias("missing"))
    fan = known.groupBy(*key).agg(F.count("*").alias("fan"), F.min("needs").alias("needs"))
    # Where each call of one need leads, and how far: to the first call of none or of several.
    jumps = scratch.keep(fan.where("fan = 1").select(*key, "needs", F.lit(1).cast("long").alias("far")))
    rounds = jumps.count().bit_length()
    for _ in range(rounds):
        onward = as_other(jumps.withColumnRenamed("far", "more").withColumnRenamed("needs", "next"), *key)
        match = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & F.col("needs").eqNullSafe(F.col("of_call_id"))
        step = jumps.join(onward, match, "left")
        jumped = scratch.keep(step.select(*key, F.when(F.col("more").isNull(), F.col("needs")).otherwise(F.col("next")).alias("needs"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("more").isNotNull().alias("moved")))
        jumps = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    ends = named.join(as_other(jumps.select(*key), *key), same(*key), "left_anti")
    heads = ends.join(as_other(fan.select(*key), *key), same(*key), "left_anti")
    placed = scratch.keep(heads.withColumn("level", F.lit(0).cast("long")))
    # A need of a call of several needs is that call's, or the end of its chain and the way there.
    several = known.join(as_other(fan.where("fan > 1").select(*key), *key), same(*key), "left_semi")
    onward = as_other(jumps.withColumnRenamed("needs", "end"), *key)
    match = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & F.col("needs").eqNullSafe(F.col("of_call_id"))
    open_ = scratch.keep(several.join(onward, match, "left").select(*key, F.when(F.col("far").isNull(), F.col("needs")).otherwise(F.col("end")).alias("needs"), (F.coalesce("far", F.lit(0)) + 1).alias("far")))
    while not open_.isEmpty():
        level = placed.select(F.col("conv_id").alias("of_conv_id"), F.col("call_id").alias("of_needs"), "level")
        ready = open_.join(level, same("conv_id", "needs"), "left").groupBy(*key).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count(F.when(F.col("level").isNull(), 1)).alias("open"))
        ready = scratch.keep(ready.where("open = 0").select(*key, "level"))
        if ready.isEmpty():
            break
        placed = scratch.keep(placed.unionByName(ready))
        open_ = scratch.keep(open_.join(as_other(ready.select(*key), *key), same(*key), "left_anti"))
    level = placed.select(F.col("conv_id").alias("of_conv_id"), F.col("call_id").alias("of_needs"), "level")
    chained = jumps.join(level, same("conv_id", "needs")).select(*key, (F.col("level") + F.col("far")).alias("level"))
    out = joined(joined(calls, placed.unionByName(chained).withColumn("level", F.col("level").cast("int"))), missing)
    return out.withColumn("missing", F.coalesce("missing", F.lit(0)))


def joined(calls: DataFrame, other: DataFrame) -> DataFrame:
    """Left-joins a table with a row for each (conv_id, call_id); a null is equal to another."""
    return calls.join(as_other(other, "conv_id", "call_id"), same("conv_id", "call_id"), "left").drop("of_conv_id", "of_call_id")


def with_validity(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds problems: unknown tool, missing or unknown parameters, wrong types, unknown identifiers or a cycle."""
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    params = schemas.groupBy("tool").agg(F.collect_list(F.struct("param", kinds[F.col("type")].alias("type"), F.coalesce("required", F.lit(False)).alias("required"))).alias("params"))
    given = F.from_json(F.to_json("arguments"), "map<string,string>")
    known = calls.join(params, F.col("name") == F.col("tool"), "left").withColumn("given", F.when(F.col("arguments").isNotNull(), given))
    keys = F.map_keys("given")
    value_type = F.expr("transform(params, p -> schema_of_variant(try_variant_get(arguments, concat('$[\"', p.param, '\"]'), 'variant')))")
    typed = known.withColumn("types", value_type)
    checks = [
        F.when(F.col("tool").isNull(), "unknown tool"),
        F.when(F.col("given").isNull(), "arguments are no object"),
        F.when(F.exists("params", lambda p: p["required"] & ~F.array_contains(keys, p["param"])), "parameter missing"),
        F.when(F.exists(keys, lambda k: ~F.exists("params", lambda p: p["param"] == k)), "unknown parameter"),
        F.when(F.exists(F.arrays_zip("params", "types"), lambda z: F.array_contains(keys, z["params"]["param"]) & (z["params"]["required"] | (z["types"] != "VOID")) & ~F.coalesce(F.rlike(z["types"], z["params"]["type"]), F.lit(False))), "wrong type"),
        F.when(F.col("missing") > 0, "unknown identifier"),
        F.when(F.col("level").isNull(), "cycle"),
    ]
    return typed.withColumn("problems", F.array_compact(F.array(*checks))).drop("tool", "params", "given", "types")


def canonical(*fields: tuple[str, object]) -> F.Column:
    """JSON of an object with its keys in order; null values stay."""
    return F.to_json(F.struct(*[F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in sorted(fields, key=lambda f: f[0])]), {"ignoreNullFields": "false"})


def link_tool_calls(turns: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, kind, level, ordinal, call_id, linked_turn, problems, json."""
    messages, calls, results = split_turns(turns)
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    with Scratch(turns.sparkSession) as scratch:
        calls = scratch.keep(calls)
        checked = with_validity(with_levels(calls, scratch), schemas)
        answered = scratch.result(joined(checked, answer))
    none = lambda kind: F.lit(None).cast(kind)
    rows = [
        messages.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("ordinal"), none("string").alias("call_id"), none("long").alias("linked_turn"), F.array().cast("array<string>").alias("problems"), canonical(("turn", "turn"), ("role", "role"), ("content", "text")).alias("json")),
        answered.select("conv_id", "turn", F.lit("call").alias("kind"), "level", "ordinal", "call_id", F.col("answer.turn").alias("linked_turn"), "problems", canonical(("turn", "turn"), ("role", F.lit("assistant")), ("id", "call_id"), ("name", "name"), ("arguments", "arguments"), ("result", F.col("answer.content"))).alias("json")),
        results.select("conv_id", "turn", F.lit("result").alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("ordinal"), "call_id", none("long").alias("linked_turn"), F.array().cast("array<string>").alias("problems"), canonical(("turn", "turn"), ("role", F.lit("tool")), ("id", "call_id"), ("content", "content")).alias("json")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
