"""Chat formatting: linking tool calls to their results. DataFrame functions only.

Calls and results are joined on (conv_id, call_id). Calls are ordered topologically: a call's level is one more
than the highest level among the calls that it waits for, that is the longest way back to a call that waits for none. Ways are
doubled: a round joins the calls that are reached in exactly k steps to those reached in 2k, so a chain of thousands takes a dozen
rounds, and no conversation is ever gathered into one task; (level, turn) orders a conversation. Arguments are parsed and
checked against the schema of their tool, and every call is serialised as canonical JSON: keys sorted, no
white space.

Edge cases: arguments that are null or not JSON are reported and serialised as null; an unknown tool, a
missing, unknown or mistyped argument, a missing result, several results (the earliest counts), a result
without a call, a dependency that does not exist and calls in a cycle (level null) are reported as problems.
Repeated call rows collapse to the earliest, of equal turns to the least by name and arguments. Null ids join nothing. Very long
texts are carried once. Extra columns are ignored; empty tables work.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distloom.llm.common import cut, discard

#: JSON types and the names by which the engine reports them.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}

#: tool -> argument -> (type, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, missing): topological levels of calls with column `after`; no level on a cycle or behind one."""
    call, key = ["conv_id", "call_id"], ["conv_id", "call_id", "to"]
    ids = calls.select(*call)
    waits = calls.select(*call, F.explode("after").alias("to")).distinct()
    known = ids.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("known"))
    waits = cut(waits.join(known, ["conv_id", "to"], "left"))
    missing = waits.where("known IS NULL").groupBy(*call).agg(F.lit(True).alias("missing"))
    # `reach`: what lies exactly `step` waits back. `best`: the longest way, of fewer than `step` waits, to a call that waits for none.
    reach, step = cut(waits.where("known").select(*key)), 1
    best = cut(ids.join(reach.select(*call).distinct().withColumn("waits", F.lit(True)), call, "left").select(*call, F.when(F.col("waits").isNull(), 0).alias("level")))
    most = ids.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while step <= most and reach.limit(1).count():
        beyond = best.where("level IS NOT NULL").select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("rest"))
        via = reach.join(beyond, ["conv_id", "to"]).groupBy(*call).agg((F.max("rest") + step).alias("longer"))
        then, best = best, cut(best.join(via, call, "left").select(*call, F.greatest("level", "longer").alias("level")))
        further = reach.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"))
        old, reach = reach, cut(reach.join(further, ["conv_id", "to"]).select(*call, F.col("next").alias("to")).distinct())
        discard(then)
        discard(old)
        step *= 2
    endless = reach.select(*call).distinct().withColumn("endless", F.lit(True))  # as many waits as there are calls: a cycle
    found = best.join(endless, call, "left").select(*call, F.when(F.col("endless").isNull(), F.col("level")).alias("level"))
    return found.join(missing, call, "left").withColumn("missing", F.coalesce("missing", F.lit(False)))


def _problems(schemas: Schemas) -> list[Column]:
    """Conditions over parsed (variant) and arguments, each null or a problem's name."""
    found = [F.when(F.col("parsed").isNull(), "invalid_json"), F.when(~F.coalesce(F.col("name").isin(*schemas), F.lit(False)), "unknown_tool")]
    for tool, arguments in schemas.items():
        here = (F.col("name") == tool) & F.col("parsed").isNotNull()
        for argument, (kind, required) in arguments.items():
            value = F.try_variant_get("parsed", f"$.{argument}", "variant")
            if required:
                found.append(F.when(here & value.isNull(), f"missing:{argument}"))
            found.append(F.when(here & value.isNotNull() & ~F.coalesce(F.schema_of_variant(value).rlike(TYPES[kind]), F.lit(False)), f"type:{argument}"))
        unknown = F.size(F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), F.array(*map(F.lit, arguments)))) > 0
        found.append(F.when(here & unknown, "unknown_argument"))
    return found


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row a call, and one for each result id without a call: level, problems and the canonical JSON message.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (array of call_ids). results: conv_id, call_id, turn, content.
    """
    whole = F.struct(F.col("turn"), F.col("name"), F.col("arguments"), F.array_sort(F.coalesce("after", F.array().cast("array<string>"))).alias("after"))
    calls = calls.groupBy("conv_id", "call_id").agg(F.min(whole).alias("c")).select("conv_id", "call_id", "c.*")
    answered = results.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content")).alias("r"))
    answered = answered.select("conv_id", "call_id", "n_results", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    ordered = calls.drop("after").join(levels(calls), ["conv_id", "call_id"], "left").withColumn("called", F.lit(True))
    linked = ordered.join(answered, ["conv_id", "call_id"], "full").withColumn("called", F.coalesce("called", F.lit(False)))
    linked = linked.withColumn("n_results", F.coalesce("n_results", F.lit(0))).withColumn("parsed", F.try_parse_json("arguments"))
    of_call = [F.when(F.col("level").isNull(), "cycle"), F.when(F.col("missing"), "missing_dependency"), F.when(F.col("n_results") == 0, "no_result"), F.when(F.col("n_results") > 1, "several_results")]
    problems = F.when(F.col("called"), F.array_compact(F.array(*_problems(schemas), *of_call))).otherwise(F.array(F.lit("no_call")))
    # The engine writes {"x":...}: what stands between is the value.
    value = lambda c: F.to_json(F.struct(c.alias("x")))
    text = lambda c: F.when(c.isNull(), "null").otherwise(F.substr(value(c), F.lit(6), F.length(value(c)) - 6))
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")),
        F.lit(',"call_id":'), text(F.col("call_id")),
        F.lit(',"name":'), text(F.col("name")),
        F.lit(',"result":'), text(F.col("content")), F.lit("}"),
    )
    return linked.select("conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "level", "name", F.array_join(problems, ",").alias("problems"), "n_results", message.alias("message"))


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation table stands for.

    The k-th assistant turn (turn = 2k + 1) calls a tool with its text as the query, after call (k - 1) div 2;
    the next user turn is its result. Every seventh turn's arguments are cut short, every fifth's limit is text.
    """
    call_id = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    turn = F.col("turn")
    k = F.floor((turn - 1) / 2)
    tools = F.array(F.lit("search"), F.lit("translate"), F.lit("lookup"))
    parent = F.floor((k - 1) / 2) * 2 + 1
    json = F.to_json(F.struct(F.col("text").alias("query"), F.when(turn % 5 == 1, turn.cast("string")).alias("limit_text"), F.when(turn % 5 != 1, turn).alias("limit")))
    json = F.regexp_replace(json, r'"limit_text":("[0-9]+")\}$', r'"limit":$1}')
    json = F.when(turn % 7 == 3, F.left(json, F.length(json) - 1)).otherwise(json)
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", call_id(turn).alias("call_id"), "turn", F.get(tools, F.pmod(k, F.lit(3)).cast("int")).alias("name"), json.alias("arguments"),
        F.when(k > 0, F.array(call_id(parent))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = conversations.where("role = 'user'").select("conv_id", call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


#: The tools that conversations call.
SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "translate": {"query": ("string", True), "limit": ("integer", False)},
    "lookup": {"query": ("string", True), "limit": ("number", False)},
}
