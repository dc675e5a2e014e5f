"""Chat formatting: links tool calls with their results, orders them, validates arguments, writes canonical JSON.

Calls and results are hash-joined by identifier. A call may name one earlier call that it comes `after`; its depth
in that forest is its topological rank, found by pointer doubling: each round every call jumps twice as far, so a
chain of n calls takes log2(n) joins and no conversation is ever gathered into one task. Arguments are parsed as
VARIANT, checked against the tool's schema, objects and arrays inside them too, and written with sorted keys and without
white space; numbers as VARIANT holds them, decimals without trailing zeros and those with an exponent as doubles.

Defined cases: of calls (or results) that repeat an identifier the earliest (conv_id, turn, payload) counts and
`n_repeats` says how many followed; a null identifier links with nothing (status no_id); a result without a call
is an orphan_result, a call without a result is unanswered; arguments that aren't a JSON object, or repeat a key,
are bad_json; an unknown `after` is a dangling_after; calls in a cycle have a null depth and status cycle; a
tool without schema is an unknown_tool. Only the named columns are used, so further columns can't clash.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.llm.common import table, written

#: JSON type -> the start of what schema_of_variant says
JSON_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}
ASK = {"question": {"type": "string", "required": True, "min_length": 1}, "words": {"type": "integer", "required": True, "minimum": 1}}
SCHEMAS = {"ask": ASK}


def _is_a(value: Column, kind: str) -> Column:
    """If a VARIANT is of a JSON type."""
    found = F.schema_of_variant(value)
    return F.coalesce(reduce(Column.__or__, [F.startswith(found, F.lit(start)) for start in JSON_TYPES[kind]]), F.lit(False))


def argument_errors(parsed: Column, schema: dict, above: str = "") -> Column:
    """Array of messages, one for each way in which a VARIANT object breaks the schema; empty if none. A rule has a type and
    may have: required, min_length, max_length, pattern and enum (texts), minimum and maximum (numbers), items (a rule of
    type, pattern and enum for each element) and properties (a schema of the object's own fields)."""
    errors, inner = [], []
    for field, rule in sorted(schema.items()):
        name, value = f"{above}{field}", F.try_variant_get(parsed, f"$['{field}']", "variant")
        text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
        missing = value.isNull() | (F.schema_of_variant(value) == "VOID")
        fits = _is_a(value, rule["type"])
        says = lambda breaks, what, n=name: F.when(breaks, F.lit(f"{n}: {what}"))
        if rule.get("required"):
            errors.append(says(missing, "missing"))
        errors.append(says(~missing & ~fits, f"not {rule['type']}"))
        for key, breaks, what in (
            ("min_length", lambda x, t=text: F.length(t) < x, "too short"), ("max_length", lambda x, t=text: F.length(t) > x, "too long"), ("pattern", lambda x, t=text: ~t.rlike(x), "doesn't match"),
            ("enum", lambda x, t=text: ~t.isin(*x), "not a choice"), ("minimum", lambda x, n=number: n < x, "too small"), ("maximum", lambda x, n=number: n > x, "too large"),
        ):
            if key in rule:
                errors.append(says(fits & breaks(rule[key]), what))
        if "items" in rule:
            each, item = F.try_variant_get(value, "$", "array<variant>"), rule["items"]
            errors.append(says(fits & F.exists(each, lambda x: ~_is_a(x, item["type"])), f"an element is not {item['type']}"))
            texts = F.transform(each, lambda x: F.try_variant_get(x, "$", "string"))
            if "pattern" in item:
                errors.append(says(fits & F.exists(texts, lambda x: ~x.rlike(item["pattern"])), "an element doesn't match"))
            if "enum" in item:
                errors.append(says(fits & F.exists(texts, lambda x: ~x.isin(*item["enum"])), "an element is not a choice"))
        if "properties" in rule:
            inner.append(F.when(fits, argument_errors(value, rule["properties"], f"{name}.")))
    none = F.array().cast("array<string>")
    known = F.array(*[F.lit(x) for x in sorted(schema)])
    extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(F.to_json(parsed)), known)), lambda x: F.concat(F.lit(above), x, F.lit(": unexpected")))
    return F.concat(F.filter(F.array(*errors), lambda x: x.isNotNull()), *[F.coalesce(x, none) for x in [*inner, extra]])


def _earliest(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each non-null call_id."""
    rest = [c for c in keep if c not in ("conv_id", "turn", "payload")]
    first = F.struct("conv_id", "turn", "payload", *rest)
    return rows.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min(first).alias("first"), (F.count("*") - 1).alias("n_repeats")).select("call_id", "first.*", "n_repeats")


def depths(links: DataFrame) -> DataFrame:
    """(call_id, depth, dangling) from unique rows (call_id, after): how many calls must come before each; null in
    and behind a cycle."""
    first = links.where(F.col("after").isNull()).select("call_id", F.lit(None).cast(links.schema["after"].dataType).alias("hop"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("dangling"))
    found = links.where(F.col("after").isNotNull()).select("call_id", F.col("after").alias("hop")).join(links.select(F.col("call_id").alias("hop"), F.lit(1).alias("there")), "hop", "left")
    later = found.select(
        "call_id",
        F.when(F.col("there").isNotNull(), F.col("hop")).alias("hop"),
        F.coalesce(F.col("there"), F.lit(0)).cast("long").alias("depth"),
        F.col("there").isNull().alias("dangling"),
    )
    state = written(first.unionByName(later))
    rounds = math.ceil(math.log2(state.count() + 1)) + 1
    for _ in range(rounds):
        if state.where(F.col("hop").isNotNull()).isEmpty():
            return state.drop("hop")
        goal = state.select(F.col("call_id").alias("hop"), F.col("hop").alias("hop2"), F.col("depth").alias("depth2"))
        moving = state.where(F.col("hop").isNotNull()).join(goal, "hop").select("call_id", F.col("hop2").alias("hop"), (F.col("depth") + F.col("depth2")).alias("depth"), "dangling")
        state = written(moving.unionByName(state.where(F.col("hop").isNull())))
    return state.select("call_id", F.when(F.col("hop").isNull(), F.col("depth")).alias("depth"), "dangling")


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls (conv_id, turn, call_id, tool, payload, after), payload being the arguments as JSON text, and results
    (conv_id, turn, call_id, payload) -> (conv_id, call_id, turn, depth, status, errors, n_repeats, json)."""
    asked = _earliest(calls, ["conv_id", "turn", "payload", "tool", "after"])
    answered = _earliest(results, ["conv_id", "turn", "payload"])
    ranked = depths(asked.select("call_id", "after"))
    a = asked.join(ranked, "call_id").select("call_id", F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), "tool", F.try_parse_json("payload").alias("parsed"), "depth", "dangling", F.col("n_repeats").alias("a_repeats"))
    r = answered.select("call_id", F.col("conv_id").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("payload").alias("result"), F.col("n_repeats").alias("r_repeats"), F.lit(True).alias("has_result"))
    both = a.withColumn("has_call", F.lit(True)).join(r, "call_id", "full")
    called, is_object = F.coalesce("has_call", F.lit(False)), F.coalesce(F.startswith(F.schema_of_variant("parsed"), F.lit("OBJECT")), F.lit(False))
    none = F.array().cast("array<string>")
    errors = F.when(~called, none).when(~is_object, F.array(F.lit("bad_json")))
    for tool, schema in sorted(schemas.items()):
        errors = errors.when(F.col("tool") == tool, argument_errors(F.col("parsed"), schema))
    both = both.withColumn("errors", errors.otherwise(F.array(F.lit("unknown_tool"))))
    status = (
        F.when(~called, "orphan_result")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.size("errors") > 0, "invalid_arguments")
        .when(F.col("dangling"), "dangling_after")
        .when(F.col("has_result").isNull(), "unanswered")
        .otherwise("ok")
    )
    as_json = F.to_json(F.struct(F.when(is_object, F.col("parsed")).alias("arguments"), "call_id", "result", "tool"), {"ignoreNullFields": "false"})
    linked = both.select(F.coalesce("a_conv", "r_conv").alias("conv_id"), "call_id", F.coalesce("a_turn", "r_turn").alias("turn"), "depth", status.alias("status"), "errors", (F.coalesce("a_repeats", F.lit(0)) + F.coalesce("r_repeats", F.lit(0))).cast("long").alias("n_repeats"), as_json.alias("json"))
    lost = lambda df, tool: df.where(F.col("call_id").isNull()).select("conv_id", "call_id", "turn", F.lit(None).cast("long").alias("depth"), F.lit("no_id").alias("status"), none.alias("errors"), F.lit(0).cast("long").alias("n_repeats"), F.to_json(F.struct(F.lit(None).cast("string").alias("call_id"), F.col("payload").alias("result"), tool.alias("tool")), {"ignoreNullFields": "false"}).alias("json"))
    return linked.unionByName(lost(calls, F.col("tool"))).unionByName(lost(results, F.lit(None).cast("string")))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and the other turns of a conversation table: each user turn calls the tool `ask` and comes
    after the call two turns before it; an assistant turn is the result of the call one turn before it."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", name(0).alias("call_id"), F.lit("ask").alias("tool"),
        F.to_json(F.struct(F.col("text").alias("question"), words.alias("words")), {"ignoreNullFields": "false"}).alias("payload"),
        F.when(F.col("turn") >= 2, name(2)).alias("after"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("payload"))
    return calls, results, turns.where("role IS NULL OR role NOT IN ('user', 'assistant')")


def op5_tool_chat(spark, sf_dir):
    calls, results, rest = from_turns(table(spark, sf_dir, "conversations"))
    notes = rest.select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.lit(None).cast("long").alias("depth"), F.lit("note").alias("status"), F.array().cast("array<string>").alias("errors"), F.lit(0).cast("long").alias("n_repeats"),
        F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"),
    )
    return link(calls, results).unionByName(notes).withColumn("errors", F.array_join("errors", "; "))


ORACLE = {
    "op5_tool_chat": r"""
    WITH RECURSIVE
    u AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
                 conv_id || ':' || turn AS call_id FROM conversations WHERE role = 'user'),
    v AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
    d AS (SELECT a.call_id, a.conv_id, a.turn, 0::BIGINT AS depth, a.turn >= 2 AS dangling FROM u a
          WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
          UNION ALL SELECT a.call_id, a.conv_id, a.turn, d.depth + 1, false FROM u a JOIN d ON a.conv_id = d.conv_id AND a.turn = d.turn + 2),
    j AS (SELECT coalesce(u.conv_id, v.conv_id) AS conv_id, coalesce(u.call_id, v.call_id) AS call_id, coalesce(u.turn, v.turn) AS turn, d.depth,
                 CASE WHEN u.call_id IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN u.text IS NULL THEN 'question: missing' WHEN u.text = '' THEN 'question: too short' END,
                      CASE WHEN words < 1 THEN 'words: too small' END) END AS errors,
                 u.call_id IS NULL AS orphan, v.call_id IS NULL AS open, d.dangling,
                 '{"arguments":' || CASE WHEN u.call_id IS NULL THEN 'null' ELSE '{"question":' || coalesce(to_json(u.text)::VARCHAR, 'null') || ',"words":' || words || '}' END
                 || ',"call_id":' || to_json(coalesce(u.call_id, v.call_id))::VARCHAR || ',"result":' || coalesce(to_json(v.text)::VARCHAR, 'null')
                 || ',"tool":' || CASE WHEN u.call_id IS NULL THEN 'null' ELSE '"ask"' END || '}' AS json
          FROM u FULL JOIN v ON u.call_id = v.call_id LEFT JOIN d ON d.call_id = u.call_id)
    SELECT conv_id, call_id, turn, depth,
           CASE WHEN orphan THEN 'orphan_result' WHEN errors <> '' THEN 'invalid_arguments' WHEN dangling THEN 'dangling_after' WHEN open THEN 'unanswered' ELSE 'ok' END AS status,
           errors, 0::BIGINT AS n_repeats, json FROM j
    UNION ALL
    SELECT conv_id, NULL, turn, NULL, 'note', '', 0, '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
    FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
    """
}
QUERIES = {"op5_tool_chat": op5_tool_chat}
