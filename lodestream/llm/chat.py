"""Chat formatting with DataFrame and SQL functions only: tool calls linked to results, checked, ordered, serialised.

A message is a row (conversation, turn, role, text). Text that is a JSON object may carry more than words:
- a system message's "tools": [{"name", "parameters": a JSON schema}], or with both inside "function";
- an assistant message's "tool_calls": [{"id", "name", "arguments" (an object, or its text), "after": [ids]}], beside "content"; name and
  arguments may be inside "function";
- a tool message's "tool_call_id", beside "content".
Every message and every call becomes one row, so a conversation that holds a third of all messages is never
gathered. Calls and results are hash-joined by conversation and identifier; a call's result is the first by turn that
does not stand before it. A call's level is 0, or one more than that of the calls it names in "after"; (level, turn,
slot, part) puts calls after what they wait for and results right behind their calls. Lines are canonical JSON: sorted
keys, no white space, null where there is no value.

Defined cases: null text is the empty content; null roles, turns and conversations pass through, null turns come
first, and nothing is linked under a null conversation; text that is no JSON object, or has no part above that its role
may carry, is content as it stands, at any length; of calls that share an identifier the first by turn, slot, name and
arguments is linked, the others have the problem duplicate_id; of several results the first by turn and content links,
the others, results before their call and results without a call are kind orphan (later_result, before_call, no_call);
of tools that share a name the first by turn and schema counts; names in "after" that no call has give unknown_after;
calls in or behind a cycle have level -1 and the problem cycle; repeated rows each give their rows; an empty table gives an
empty result; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.tables import table
from lodestream.session import cut

_BODY = (
    "content string, tool_call_id string, tool_calls array<struct<id string, name string, arguments string, after array<string>, function struct<name string, arguments string>>>, "
    "tools array<variant>"
)

_COLUMNS = ("conv_id", "turn", "slot", "part", "kind", "role", "call_id", "level", "linked_turn", "valid", "problems", "line")


def _parsed(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    named = messages.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    body = F.when(F.col("text").rlike(r"^\s*\{"), F.from_json("text", _BODY))
    return named.withColumn("body", body)


#: A level that stands for any larger one while chains are joined; no table holds as many calls.
_FAR = 1 << 40


def _levels(calls: DataFrame) -> DataFrame:
    """calls(conv_id, call_id, after) to (conv_id, call_id, level); calls in or behind a cycle have no row.

    A call waits for others: its level is the most of base and, over its edges, of the other's level and a weight. In each
    round edges to settled calls go into the base, and an edge to a call with one edge left is led on to what that one
    waits for, so a chain of calls takes as many rounds as its length has binary digits. A round that settles no call
    leaves only cycles.
    """
    named = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("other"))
    known = calls.select("conv_id", F.col("call_id").alias("other"))
    edges = cut(named.join(known, ["conv_id", "other"]).withColumn("weight", F.lit(1).cast("long")))
    state, settled = cut(calls.select("conv_id", "call_id", F.lit(0).cast("long").alias("base"))), -1
    waiting = lambda: edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.first("other").alias("to"), F.first("weight").alias("far"))
    while True:
        now = cut(state.join(waiting(), ["conv_id", "call_id"], "left"))
        done = now.filter("n is null").count()
        if done == settled or not edges.limit(1).count():
            return now.filter("n is null").select("conv_id", "call_id", F.col("base").cast("int").alias("level"))
        settled = done
        others = now.selectExpr("conv_id", "call_id as other", "base", "n", "to", "far")
        led = cut(edges.join(others, ["conv_id", "other"]).selectExpr("conv_id", "call_id", "if(n is null or n = 1, base + weight, 0) as reached", "case when n is null then null when n = 1 then to else other end as other", f"least({_FAR}, if(n = 1, weight + far, weight)) as weight"))
        gained = led.groupBy("conv_id", "call_id").agg(F.max("reached").alias("reached"))
        state = cut(state.join(gained, ["conv_id", "call_id"], "left").selectExpr("conv_id", "call_id", f"least({_FAR}, greatest(base, coalesce(reached, 0))) as base"))
        edges = cut(led.filter("other is not null").groupBy("conv_id", "call_id", "other").agg(F.max("weight").alias("weight")))


def _is_first(rows: DataFrame, keys: list[str], order: list[Column | str], eligible: str = "true") -> DataFrame:
    """rows with first: whether a row is the first eligible one by this order among those that share the keys (place decides ties)."""
    firsts = rows.filter(eligible).groupBy(*keys).agg(F.min(F.struct(*order, "place")).getField("place").alias("__first"))
    return rows.join(firsts, keys, "left").withColumn("first", F.expr(f"({eligible}) and place <=> __first")).drop("__first")


def _variant(name: str, kind: str = "variant") -> str:
    return f"try_variant_get(s, '$.{name}', '{kind}')"


#: SQL: the parts of a value and its schema, in steps that use the ones before.
_NODE = [
    ["try_parse_json(schema) as s", "try_parse_json(value) as v"],
    ["schema_of_variant(v) as vt", "to_json(v) as told", "concat(path, if(path = '', '', '.')) as prefix"],
    ["case when vt in ('STRING', 'BOOLEAN') then lower(vt) when vt = 'VOID' then 'null' when vt like 'OBJECT%' then 'object' when vt like 'ARRAY%' then 'array' else 'number' end as kind"],
    [
        "if(kind = 'number', try_variant_get(v, '$', 'double'), null) as num",
        "if(kind = 'object', try_cast(v as map<string, variant>), null) as fields",
        "if(kind = 'array', try_cast(v as array<variant>), null) as elements",
        "if(kind = 'string', length(try_variant_get(v, '$', 'string')), null) as letters",
        f"filter(coalesce({_variant('type', 'array<string>')}, array({_variant('type', 'string')})), t -> t is not null) as types",
        f"{_variant('enum', 'array<variant>')} as options",
        f"{_variant('const')} as const",
        f"coalesce({_variant('properties', 'map<string, variant>')}, cast(map() as map<string, variant>)) as properties",
        f"coalesce({_variant('required', 'array<string>')}, cast(array() as array<string>)) as required",
        f"{_variant('additionalProperties')} as others",
        f"{_variant('items')} as items",
    ],
]


def _same(x: str) -> str:
    """SQL: whether variant x is the value, numbers by their value."""
    return f"(to_json({x}) = told or num is not null and schema_of_variant({x}) rlike '^(BIGINT|DOUBLE|DECIMAL.*)$' and try_variant_get({x}, '$', 'double') = num)"


def _outside(measure: str, low: str, high: str) -> str:
    return f"coalesce({measure} < {_variant(low, 'double')}, false) or coalesce({measure} > {_variant(high, 'double')}, false)"


#: SQL: what is wrong with a value itself, then the values within that have schemas of their own.
_WRONG = f"""concat(
  if(schema = 'false' or size(types) > 0 and not exists(types, t -> t = kind or t = 'integer' and kind = 'number' and num = rint(num)), array(concat('type:', path)), array()),
  if(options is not null and not exists(options, x -> {_same("x")}), array(concat('enum:', path)), array()),
  if(const is not null and not {_same("const")}, array(concat('const:', path)), array()),
  if({_outside("num", "minimum", "maximum")} or coalesce(num <= {_variant("exclusiveMinimum", "double")}, false) or coalesce(num >= {_variant("exclusiveMaximum", "double")}, false), array(concat('range:', path)), array()),
  if({_outside("letters", "minLength", "maxLength")} or {_outside("if(elements is null, null, size(elements))", "minItems", "maxItems")} or {_outside("if(fields is null, null, size(fields))", "minProperties", "maxProperties")}, array(concat('size:', path)), array()),
  if(fields is null, array(), transform(array_except(required, map_keys(fields)), x -> concat('missing:', prefix, x))),
  if(fields is not null and to_json(others) = 'false', transform(array_except(map_keys(fields), map_keys(properties)), x -> concat('unexpected:', prefix, x)), array()))"""
_WITHIN = """concat(
  if(fields is null, array(), transform(filter(map_entries(properties), p -> map_contains_key(fields, p.key)), p -> struct(concat(prefix, p.key) as path, to_json(p.value) as schema, to_json(fields[p.key]) as value))),
  if(fields is null or others is null or to_json(others) in ('true', 'false'), array(), transform(filter(map_entries(fields), p -> not map_contains_key(properties, p.key)), p -> struct(concat(prefix, p.key) as path, to_json(others) as schema, to_json(p.value) as value))),
  if(elements is null or items is null, array(), transform(elements, (x, i) -> struct(concat(path, '[', i, ']') as path, to_json(items) as schema, to_json(x) as value))))"""


def _wrong(nodes: DataFrame) -> DataFrame:
    """nodes(place, path, schema, value) to (place, wrong): rounds over the schemas' nesting, a row per value with a schema."""
    found = None
    while True:
        for columns in _NODE:
            nodes = nodes.selectExpr("*", *columns)
        judged = cut(nodes.selectExpr("place", f"{_WRONG} as wrong", f"{_WITHIN} as within"))
        found = judged.select("place", "wrong") if found is None else found.unionAll(judged.select("place", "wrong"))
        nodes = judged.select("place", F.explode("within").alias("x")).select("place", "x.*")
        if not nodes.limit(1).count():
            return found.groupBy("place").agg(F.array_sort(F.flatten(F.collect_list("wrong"))).alias("wrong"))


def _line(*names: str) -> str:
    """SQL: canonical JSON of columns; names are sorted."""
    fields = ", ".join(f"'{n}', {n}" for n in sorted(names))
    return f"to_json(named_struct({fields}), map('ignoreNullFields', 'false'))"


_NO_PROBLEMS = "cast(array() as array<string>)"


def _linked(calls: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls with first, level, after_unknown and linked_turn; answers with the call that they link to, or why none."""
    keys = ["conv_id", "call_id"]
    may = "call_id is not null and conv_id is not null"
    with_id = _is_first(calls.filter(may), keys, ["turn", "slot", "name", "arguments"])
    first = cut(with_id.filter("first").select("conv_id", "call_id", "turn", "slot", "after"))
    levels = cut(_levels(first))
    source = first.join(levels, keys, "left").selectExpr("conv_id", "call_id", "turn as call_turn", "slot as call_slot", "level as call_level", "true as known")
    told = answers.filter(may).join(source.hint("shuffle_hash"), keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    told = told.withColumn("behind", F.expr("known and coalesce(turn >= call_turn, call_turn is null)"))
    told = cut(_is_first(told, keys, ["turn", "content"], "behind"))
    results = told.filter("first").selectExpr("conv_id", "call_id", "cast(turn as bigint) as linked_turn")
    # a name in "after" that no call of the conversation has
    named = first.select("conv_id", F.col("call_id").alias("by"), F.explode(F.array_distinct("after")).alias("call_id"))
    lost = named.join(first.select(*keys), keys, "left_anti").groupBy("conv_id", F.col("by").alias("call_id")).agg(F.array_sort(F.collect_set("call_id")).alias("lost"))
    linked = with_id.join(source.select(*keys, F.col("call_level").alias("level")), keys, "left").join(results.hint("shuffle_hash"), keys, "left").join(lost, keys, "left")
    for name in ("level", "linked_turn", "lost"):
        linked = linked.withColumn(name, F.when(F.col("first"), F.col(name)))
    alone = calls.filter(f"not ({may})").selectExpr("*", "false as first", "cast(null as int) as level", "cast(null as bigint) as linked_turn", "cast(null as array<string>) as lost")
    unlinked = answers.filter(f"not ({may})").selectExpr("*", "cast(null as int) as call_level", "false as known", "false as behind", "false as first")
    return linked.unionByName(alone), told.unionByName(unlinked, allowMissingColumns=True)


def format_chats(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message and per call: see the module's text for the columns' meaning."""
    parsed = _parsed(messages, conversation, turn, role, text)
    calling, answering = "(role <=> 'assistant' and body.tool_calls is not null)", "(role <=> 'tool' and body.tool_call_id is not null)"
    said = parsed.filter(f"not {answering}").selectExpr("conv_id", "turn", "0 as slot", "0 as part", "'message' as kind", "role", "cast(null as string) as call_id", "0 as level", "cast(null as bigint) as linked_turn", "true as valid", f"{_NO_PROBLEMS} as problems", f"if({calling}, body.content, text) as content")
    said = said.withColumn("line", F.expr(_line("content", "role"))).select(*_COLUMNS)

    raw = parsed.filter(calling).select("conv_id", "turn", F.posexplode("body.tool_calls").alias("at", "call"))
    calls = cut(raw.selectExpr("conv_id", "turn", "cast(at + 1 as int) as slot", "call.id as call_id", "coalesce(call.name, call.function.name) as name", "coalesce(call.arguments, call.function.arguments) as arguments", "coalesce(call.after, array()) as after", "monotonically_increasing_id() as place"))
    answers = cut(parsed.filter(answering).selectExpr("conv_id", "turn", "body.tool_call_id as call_id", "body.content as content", "monotonically_increasing_id() as place"))
    if not calls.limit(1).count() and not answers.limit(1).count():
        return said
    linked, told = _linked(calls, answers)

    tools = parsed.filter("role <=> 'system' and body.tools is not null").select("conv_id", "turn", F.explode("body.tools").alias("tool"))
    own = lambda name, kind: f"coalesce(try_variant_get(tool, '$.{name}', '{kind}'), try_variant_get(tool, '$.function.{name}', '{kind}'))"
    tools = tools.selectExpr("conv_id", "turn", f"{own('name', 'string')} as name", f"coalesce(to_json({own('parameters', 'variant')}), '{{}}') as tool")
    tools = tools.groupBy("conv_id", "name").agg(F.min(F.struct("turn", "tool")).getField("tool").alias("tool"))
    linked = linked.join(tools, ["conv_id", "name"], "left").withColumn("parsed", F.expr("try_parse_json(arguments)"))
    is_object = "schema_of_variant(parsed) like 'OBJECT%' and try_cast(parsed as map<string, variant>) is not null"
    linked = cut(linked.withColumn("value", F.expr(f"if({is_object}, to_json(parsed), null)")).drop("parsed"))
    wrong = _wrong(linked.filter("tool is not null and value is not null").selectExpr("place", "'' as path", "tool as schema", "value"))
    checked = linked.join(wrong, "place", "left").withColumn("parsed", F.expr("try_parse_json(arguments)"))
    checked = checked.withColumn("problems", F.expr(f"case when tool is null then array('unknown_tool') when value is null then array('arguments_not_an_object') else coalesce(wrong, {_NO_PROBLEMS}) end"))
    may = "call_id is not null and conv_id is not null"
    checked = checked.withColumn("problems", F.expr(f"concat(problems, if({may} and not first, array('duplicate_id'), array()), if(call_id is null, array('no_id'), array()), transform(coalesce(lost, array()), x -> concat('unknown_after:', x)), if(first and level is null, array('cycle'), array()))"))
    checked = checked.withColumn("canonical", F.expr("coalesce(to_json(parsed), arguments)"))
    made = checked.selectExpr("conv_id", "turn", "slot", "0 as part", "'call' as kind", "'assistant' as role", "call_id", "coalesce(level, if(first, -1, 0)) as level", "linked_turn", "size(problems) = 0 as valid", "problems", "concat('{\"arguments\":', if(parsed is null, regexp_extract(to_json(array(canonical)), '(?s)^.(.*).$', 1), canonical), ',\"call\":', substring(to_json(named_struct('call', struct(call_id as id, name)), map('ignoreNullFields', 'false')), 9)) as line")

    why = "case when not known then 'no_call' when not behind then 'before_call' else 'later_result' end"
    told = told.selectExpr("conv_id", "if(first, call_turn, turn) as turn", "if(first, call_slot, 0) as slot", "1 as part", "if(first, 'result', 'orphan') as kind", "'tool' as role", "call_id", "if(first, coalesce(call_level, -1), 0) as level", "cast(turn as bigint) as linked_turn", "first as valid", f"if(first, {_NO_PROBLEMS}, array({why})) as problems", f"{_line('call_id', 'content')} as line")
    return said.unionByName(made.select(*_COLUMNS)).unionByName(told.select(*_COLUMNS))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


#: The rows of messages; the test tables hold no calls and no results.
OP1_SQL = r"""
SELECT conv_id, turn, 0 AS slot, 0 AS part, 'message' AS kind, role, CAST(NULL AS VARCHAR) AS call_id, 0 AS level, CAST(NULL AS BIGINT) AS linked_turn, TRUE AS valid, CAST([] AS VARCHAR[]) AS problems,
       '{"content":' || to_json(COALESCE(text, '')) || ',"role":' || COALESCE(to_json(role), 'null') || '}' AS line
FROM conversations WHERE NOT regexp_matches(COALESCE(text, ''), '^\s*\{')
"""
