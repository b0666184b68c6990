"""Chat formatting with tool-call linking, with DataFrame functions only.

An assistant turn may hold calls, `<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`; a turn of
role `tool` is a result, `{"tool_call_id": ..., "content": ...}`. Calls and results are hash-joined by conversation
and identifier; results sort after their calls; arguments are validated against the tools' schemas; each message
becomes one line of canonical JSON (keys sorted, no white space, numbers in one form).

Messages stay one row each, so a conversation that holds a third of all rows is never gathered in one task; its
order is in order_turn, order_phase, turn. Turns without calls or results take no part in a shuffle.

Defined results: a null conv_id, turn or role is kept as it is; a null text is an empty content; a turn without a
number sorts first. Of calls with one identifier the earliest counts (ties: the smallest text), the others are
`duplicate`; a result without such a call is an `orphan`, a text that isn't JSON an `invalid` result or an invalid
call. Repeated rows each give a row. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.common import table

#: JSON types and what schema_of_variant() calls them.
TYPES = {
    "string": "STRING|DATE|TIMESTAMP.*",
    "integer": "BIGINT|DECIMAL[(][0-9]+,0[)]",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "object": "OBJECT<.*",
    "array": "ARRAY<.*",
}
#: Schemas of the registered query's tools: name -> (types of the properties, the required ones).
TOOLS = {
    "search": ({"query": "string", "limit": "integer"}, ("query",)),
    "calculator": ({"expression": "string"}, ("expression",)),
    "weather": ({"city": "string", "days": "integer", "metric": "boolean"}, ("city",)),
}
CALL = r"(?s)<tool_call>(.*?)</tool_call>"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _errors(tools: dict, name: str, args: str) -> str:
    """SQL: array of what is wrong with the arguments, empty if they fit."""
    cases = []
    for tool, (types, required) in tools.items():
        tests = [f"CASE WHEN {args} IS NULL OR NOT rlike(schema_of_variant({args}), '^OBJECT<') THEN 'arguments' END"]
        for p, kind in types.items():
            at = f"variant_get({args}, {_quoted(f'$[' + chr(34) + p + chr(34) + ']')})"
            if p in required:
                tests.append(f"CASE WHEN {at} IS NULL THEN {_quoted('missing ' + p)} END")
            tests.append(f"CASE WHEN {at} IS NOT NULL AND NOT rlike(schema_of_variant({at}), '^({TYPES[kind]})$') THEN {_quoted('type of ' + p)} END")
        cases.append(f"WHEN {name} = {_quoted(tool)} THEN filter(array({', '.join(tests)}), e -> e IS NOT NULL)")
    return f"CASE {' '.join(cases)} ELSE array('unknown tool') END"


def _calls(tools: dict) -> Column:
    """The calls of the column content, parsed and validated."""
    parsed = f"transform(regexp_extract_all(content, {_quoted(CALL)}, 1), raw -> try_parse_json(raw))"
    fields = (
        "transform({0}, v -> named_struct('id', try_variant_get(v, '$.id', 'string'), 'name', try_variant_get(v, '$.name', 'string'), "
        "'args', try_variant_get(v, '$.arguments', 'variant')))"
    ).format(parsed)
    return F.expr(
        f"transform({fields}, c -> named_struct('arguments', c.args, 'errors', CASE WHEN c.id IS NULL OR c.name IS NULL THEN array('no call') "
        f"ELSE {_errors(tools, 'c.name', 'c.args')} END, 'id', c.id, 'name', c.name))"
    )


def chat_format(df: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row for each turn: conv_id, turn, role, order_turn, order_phase, n_calls, n_valid, n_answered, link, message."""
    tools = TOOLS if tools is None else tools
    base = df.select(
        "conv_id", "turn", df["role"].cast("string").alias("role"), F.coalesce(df["text"].cast("string"), F.lit("")).alias("content")
    )
    calling = F.col("role").eqNullSafe("assistant") & F.col("content").contains("<tool_call>")
    result = F.col("role").eqNullSafe("tool")
    none = F.lit(None)

    calls = base.filter(calling).withColumn("calls", _calls(tools)).withColumn("row", F.xxhash64("content"))
    each = calls.select("conv_id", "turn", "row", F.posexplode("calls").alias("pos", "call")).filter("call.id IS NOT NULL")
    each = each.select("conv_id", F.col("call.id").alias("id"), F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "row", "pos").alias("at"))
    first = each.groupBy("conv_id", "id").agg(F.min("at").alias("at"))

    parsed = base.filter(result).withColumn("v", F.expr("try_parse_json(content)"))
    results = parsed.withColumn("id", F.expr("try_variant_get(v, '$.tool_call_id', 'string')"))
    same = F.col("r.id").eqNullSafe(F.col("c.id")) & F.col("r.conv_id").eqNullSafe(F.col("c.conv_id"))
    linked = results.alias("r").join(first.alias("c"), same, "left")
    late = F.col("c.at.turn") >= F.coalesce("r.turn", F.lit(-1))
    out_results = linked.select(
        "r.conv_id", "r.turn", "r.role",
        F.greatest(F.coalesce("r.turn", F.lit(-1)), F.col("c.at.turn")).alias("order_turn"),
        F.when(late, 1).otherwise(0).alias("order_phase"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid"), F.lit(0).alias("n_answered"),
        F.when(F.col("r.id").isNull(), "invalid").when(F.col("c.id").isNull(), "orphan").otherwise("linked").alias("link"),
        F.to_json(F.struct(
            F.expr("coalesce(to_json(try_variant_get(v, '$.content', 'variant')), content)").alias("content"),
            "role", F.col("r.id").alias("tool_call_id"),
        )).alias("message"),
    )

    answered = results.filter("id IS NOT NULL").select("conv_id", "id").distinct()
    state = first.join(answered.withColumn("yes", F.lit(1)), ["conv_id", "id"], "left").select("conv_id", "id", "at", "yes")
    per_turn = state.groupBy("conv_id", F.col("at.turn").alias("key"), F.col("at.row").alias("row")).agg(
        F.count("*").alias("n_first"), F.count("yes").alias("n_answered")
    )
    c, s = calls.alias("c"), per_turn.alias("s")
    met = F.col("c.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.coalesce("c.turn", F.lit(-1)) == F.col("s.key")) & (F.col("c.row") == F.col("s.row"))
    size = F.size("calls")
    out_calls = c.join(s, met, "left").select(
        "c.conv_id", "c.turn", "c.role", F.coalesce("c.turn", F.lit(-1)).alias("order_turn"), F.lit(0).alias("order_phase"),
        size.alias("n_calls"), F.expr("size(filter(calls, x -> size(x.errors) = 0))").alias("n_valid"),
        F.coalesce(F.col("s.n_answered").cast("int"), F.lit(0)).alias("n_answered"),
        F.when(F.expr("size(filter(calls, x -> x.id IS NOT NULL))") > F.coalesce("s.n_first", F.lit(0)), "duplicate").otherwise("calls").alias("link"),
        F.to_json(F.struct(F.expr(f"regexp_replace(content, {_quoted(CALL)}, '')").alias("content"), "role", F.col("calls").alias("tool_calls"))).alias("message"),
    )

    plain = base.filter(~calling & ~result).select(
        "conv_id", "turn", "role", F.coalesce("turn", F.lit(-1)).alias("order_turn"), F.lit(0).alias("order_phase"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid"), F.lit(0).alias("n_answered"), none.cast("string").alias("link"),
        F.to_json(F.struct("content", "role")).alias("message"),
    )
    return plain.unionByName(out_calls).unionByName(out_results)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as one canonical line."""
    return chat_format(table(spark, sf_dir, "conversations"))
