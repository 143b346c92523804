"""Chat formatting: tool calls are linked with their results, ordered, validated and written as canonical JSON.

All of it is DataFrame operations: calls and results meet in joins on (conversation, call id), a call's depth in the order
of dependences comes from pointer doubling, arguments are checked as variants, and JSON is canonical (sorted keys, no
blanks) because a variant keeps its keys sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import Carried, join_groups, stored, table

#: Schema rows up to which schemas are broadcast.
BROADCAST_SCHEMAS = 10_000
EVENT = ["conv_id", "turn", "kind", "role", "call_id", "name", "arguments", "after", "content"]


def depths(nodes: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, cyclic) of the calls (conv_id, call_id, after): how many calls stand before each.

    A call whose `after` is null or unknown has depth 0. Each round doubles how far a call looks back, so a chain of n
    calls takes about log2(n) joins; calls that still look back after as many rounds as there could be are on, or behind,
    a cycle: their depth is null.
    """
    total = nodes.count()

    def looked_up(calls: DataFrame, by: str, found: DataFrame) -> DataFrame:
        """calls with the columns of the row of found (conv_id, call_id, ...) that `by` names; many calls may name one."""
        names = calls.where(F.col(by).isNotNull()).groupBy("conv_id", by).agg(F.count(F.lit(1)).alias("_n"))
        return join_groups(calls, found.withColumnRenamed("call_id", by).join(names, ["conv_id", by]), ["conv_id", by], total, "left")

    known = nodes.select("conv_id", "call_id", F.col("call_id").alias("up"))
    at = looked_up(nodes.select("conv_id", "call_id", "after"), "after", known)
    at = stored(at.select("conv_id", "call_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")), "calls")
    for _ in range(total.bit_length()):
        if at.where("up is not null").isEmpty():
            break
        step = looked_up(at, "up", at.select("conv_id", "call_id", F.col("up").alias("up2"), F.col("depth").alias("d2")))
        at = stored(step.select("conv_id", "call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")), "calls")
    return at.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.col("up").isNotNull().alias("cyclic"))


def type_of(v: Column) -> Column:
    """JSON type of a variant."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (kind == "VOID"), "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def errors(arguments: Column, fields: Column, schema: Column) -> Column:
    """What is wrong with a call's arguments: sorted messages, empty if nothing is."""
    none = F.array().cast("array<string>")

    def wrong(s: Column) -> Column:
        kind = type_of(fields[s["arg"]])
        fits = (kind == s["type"]) | ((s["type"] == "number") & (kind == "integer"))
        missing = ~F.map_contains_key(fields, s["arg"])
        return F.when(missing, F.when(s["required"], F.concat(F.lit("missing:"), s["arg"]))).when(~fits, F.concat(F.lit("type:"), s["arg"]))

    unknown = F.transform(F.array_except(F.map_keys(fields), F.transform(schema, lambda s: s["arg"])), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.array_sort(F.concat(F.filter(F.transform(schema, wrong), lambda e: e.isNotNull()), unknown))
    return F.when(schema.isNull(), F.array(F.lit("unknown tool"))).when(arguments.isNull() | fields.isNull(), F.array(F.lit("not an object"))).otherwise(F.coalesce(found, none))


def canonical(*pairs: tuple[str, Column]) -> Column:
    """A JSON object with sorted keys; values are columns that hold JSON text, null where a key is left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(pairs, key=lambda p: p[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(c: Column) -> Column:
    """A string column as JSON text; null stays null."""
    return F.when(c.isNotNull(), F.to_json(F.to_variant_object(F.array(c)))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(c)))) - 2)


def link_tool_calls(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each different event, with depth, status, errors, order_key and json.

    events: conv_id, turn, kind ('call', 'result', else a plain message), role, call_id, name, arguments (JSON text),
    after (the id of a call that must come first), content. schemas: name, arg, type (string, integer, number, boolean,
    array, object, null), required. Sorted by conv_id and order_key, each call comes after the calls it depends on
    and before its result; messages come first. No row waits for all rows of its conversation: there is no window and
    no list over one, so a conversation may hold any share of the rows.

    - repeated rows count once. Of several calls or results with one id the one with the smallest turn (null turns
      first), then hash, links; the others have status 'duplicate'.
    - null conv_id or call_id: 'no id'. Calls without a result: 'pending'; results without a call: 'orphan'; calls on or
      behind a cycle: 'cyclic', after all others. An `after` that is no call of the conversation is ignored.
    - arguments that are null or not a JSON object: errors holds 'not an object', and json holds null for them. A tool
      without schema: 'unknown tool'. errors is null for anything but calls.
    - arguments and contents of any length are read whole; other columns are not read, whatever their names. Empty tables
      give no rows; without schemas every tool is unknown.
    """
    own = Carried(events, **{c: c for c in EVENT}).df.select(*EVENT)
    e = stored(own.distinct().withColumn("h", F.xxhash64(*EVENT)), "events")
    first = F.struct("turn", "h")
    tool = e.where("kind in ('call', 'result') and conv_id is not null and call_id is not null")
    ids = tool.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", first)).alias("c"),
        F.min_by("after", F.when(F.col("kind") == "call", first)).alias("after"),
        F.min(F.when(F.col("kind") == "result", first)).alias("r"),
        F.count(F.lit(1)).alias("_n"),
    )
    ids = stored(ids, "ids")
    # Results without a call have nothing to link with.
    links = ids.where("c is not null").drop("after").join(depths(ids.where("c is not null").select("conv_id", "call_id", "after")), ["conv_id", "call_id"])
    linked = join_groups(tool, links.select("conv_id", "call_id", "c", "r", "depth", "cyclic", "_n"), ["conv_id", "call_id"], tool.count(), "left")
    kept = [*e.columns, "c", "r", "depth", "cyclic"]
    rest = e.where("not coalesce(kind in ('call', 'result') and conv_id is not null and call_id is not null, false)")
    rest = rest.select("*", *[F.lit(None).cast(linked.schema[c].dataType).alias(c) for c in kept[-4:]])
    out = linked.select(*kept).unionByName(rest)
    schemas = Carried(schemas, name="name", arg="arg", type="type", required="required").df.drop("row")
    known = schemas.distinct().groupBy("name").agg(F.collect_list(F.struct("arg", "type", "required")).alias("schema"))
    if schemas.count() <= BROADCAST_SCHEMAS:
        out = out.join(F.broadcast(known.withColumnRenamed("name", "n2")), (F.col("name") == F.col("n2")) & (F.col("kind") == "call"), "left")
    else:
        names = tool.where("kind = 'call' and name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
        out = join_groups(out, known.join(names, "name"), ["name"], e.count(), "left").withColumn("schema", F.when(F.col("kind") == "call", F.col("schema")))
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when((call | result) & (F.col("conv_id").isNull() | F.col("call_id").isNull()), "no id")
        .when(result & F.col("c").isNull(), "orphan")
        .when(call & (F.col("c.h") != F.col("h")), "duplicate")
        .when(result & (F.col("r.h") != F.col("h")), "duplicate")
        .when(call & F.col("cyclic"), "cyclic")
        .when(call & F.col("r").isNull(), "pending")
        .when(call | result, "linked")
        .otherwise("message")
    )
    parsed = F.try_parse_json("arguments")
    out = out.withColumn("v", parsed).withColumn("fields", F.try_variant_get("v", "$", "map<string,variant>"))
    out = out.withColumns({"status": status, "errors": F.when(call, errors(F.col("v"), F.col("fields"), F.col("schema")))})
    depth = F.when(~(call | result), -1).otherwise(F.coalesce("depth", F.lit(2**31 - 1))).cast("long")
    padded = lambda t: F.lpad(F.coalesce(t, F.lit(0)).cast("string"), 19, "0")
    order = F.concat_ws("|", F.lpad((depth + 1).cast("string"), 10, "0"), padded(F.coalesce("c.turn", "turn")), F.coalesce("call_id", F.lit("")), F.when(result, "1").otherwise("0"), padded(F.col("turn")), F.lpad(F.hex("h"), 16, "0"))
    as_json = (
        F.when(call, canonical(("arguments", F.when(F.col("fields").isNull(), "null").otherwise(F.to_json("v"))), ("id", F.coalesce(quoted(F.col("call_id")), F.lit("null"))), ("name", F.coalesce(quoted(F.col("name")), F.lit("null"))), ("role", F.lit('"assistant"')), ("type", F.lit('"tool_call"'))))
        .when(result, canonical(("content", F.coalesce(quoted(F.col("content")), F.lit("null"))), ("id", F.coalesce(quoted(F.col("call_id")), F.lit("null"))), ("role", F.lit('"tool"')), ("type", F.lit('"tool_result"'))))
        .otherwise(canonical(("content", F.coalesce(quoted(F.col("content")), F.lit("null"))), ("role", F.coalesce(quoted(F.col("role")), F.lit("null")))))
    )
    return out.withColumns({"depth": depth, "order_key": order, "json": as_json}).select("conv_id", "turn", "kind", "call_id", "depth", "status", "errors", "order_key", "json")


def conversation_events(messages: DataFrame) -> DataFrame:
    """conversations read as tool use: a user turn calls a tool with the text, the next turn's assistant returns its
    result, and a call depends on the one two turns before. Other roles are plain messages."""
    call, result = F.col("role") == "user", F.col("role") == "assistant"
    turn, conv = F.col("turn"), F.col("conv_id")
    call_id = lambda t: F.concat(F.lit("c"), conv.cast("string"), F.lit("-"), t.cast("string"))
    size = F.length("text")
    name = F.when(size % 3 == 0, "search").when(size % 3 == 1, "lookup").otherwise("note")
    # Every seventh conversation sends its turn as a string, every eleventh an argument that no schema has.
    arguments = F.when(conv % 7 == 0, F.to_json(F.struct(F.col("text").alias("query"), turn.cast("string").alias("turn")))).when(conv % 11 == 0, F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("query"), F.lit(True).alias("debug")))).otherwise(F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("query"))))
    return messages.select(
        "conv_id",
        "turn",
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"),
        "role",
        F.when(call, call_id(turn)).when(result, call_id(turn - 1)).alias("call_id"),
        F.when(call, name).alias("name"),
        F.when(call, arguments).alias("arguments"),
        F.when(call & (turn >= 2), call_id(turn - 2)).alias("after"),
        F.when(~call | call.isNull(), F.col("text")).alias("content"),
    )


def tool_schemas(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """SELECT * FROM VALUES
        ('search', 'query', 'string', true), ('search', 'turn', 'integer', true), ('search', 'top', 'integer', false),
        ('lookup', 'query', 'string', true), ('lookup', 'turn', 'integer', true), ('lookup', 'top', 'integer', false),
        ('note', 'query', 'string', true), ('note', 'turn', 'number', true), ('note', 'tags', 'array', true)
        AS t(name, arg, type, required)"""
    )


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_tool_calls(conversation_events(table(spark, sf_dir, "conversations")), tool_schemas(spark))
    order = F.regexp_replace("order_key", r"\|[0-9A-F]{16}$", "")  # without the hash that tells ties apart
    return linked.select("conv_id", "turn", "kind", "call_id", "depth", "status", F.array_join("errors", ",").alias("errors"), order.alias("order_key"), "json")


ORACLE_SQL = r"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
e AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE role WHEN 'user' THEN 'c' || conv_id || '-' || turn WHEN 'assistant' THEN 'c' || conv_id || '-' || (turn - 1) END AS call_id FROM m),
d AS (
  SELECT conv_id, turn, 0 AS depth FROM e WHERE kind = 'call' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.kind = 'call' AND p.conv_id = e.conv_id AND p.turn = e.turn - 2)
  UNION ALL SELECT e.conv_id, e.turn, d.depth + 1 FROM e JOIN d ON e.conv_id = d.conv_id AND e.turn = d.turn + 2 WHERE e.kind = 'call'),
x AS (SELECT e.*, CASE WHEN kind = 'message' THEN -1 WHEN d.depth IS NULL THEN 2147483647 ELSE d.depth END AS depth,
  CASE WHEN kind = 'message' THEN 'message' WHEN kind = 'result' THEN CASE WHEN d.depth IS NULL THEN 'orphan' ELSE 'linked' END
    WHEN EXISTS (SELECT 1 FROM e r WHERE r.kind = 'result' AND r.call_id = e.call_id) THEN 'linked' ELSE 'pending' END AS status,
  CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'note' END AS name
  FROM e LEFT JOIN d ON d.conv_id = e.conv_id AND d.turn = e.turn - CASE kind WHEN 'result' THEN 1 ELSE 0 END)
SELECT conv_id, turn, kind, call_id, depth::BIGINT AS depth, status,
  lpad((depth::BIGINT + 1)::VARCHAR, 10, '0') || '|' || lpad((CASE WHEN kind = 'result' AND status = 'linked' THEN turn - 1 ELSE turn END)::VARCHAR, 19, '0')
    || '|' || coalesce(call_id, '') || CASE kind WHEN 'result' THEN '|1|' ELSE '|0|' END || lpad(turn::VARCHAR, 19, '0') AS order_key,
  CASE WHEN kind = 'call' THEN concat_ws(',', CASE WHEN name = 'note' THEN 'missing:tags' END,
    CASE WHEN conv_id % 7 = 0 THEN 'type:turn' END, CASE WHEN conv_id % 11 = 0 AND conv_id % 7 <> 0 THEN 'unknown:debug' END) END AS errors,
  CASE kind WHEN 'call' THEN '{"arguments":{' || CASE WHEN conv_id % 11 = 0 AND conv_id % 7 <> 0 THEN '"debug":true,' ELSE '' END
      || '"query":' || to_json(text)::VARCHAR || ',"turn":' || CASE WHEN conv_id % 7 = 0 THEN '"' || turn || '"' ELSE turn::VARCHAR END
      || '},"id":"' || call_id || '","name":"' || name || '","role":"assistant","type":"tool_call"}'
    WHEN 'result' THEN '{"content":' || to_json(text)::VARCHAR || ',"id":"' || call_id || '","role":"tool","type":"tool_result"}'
    ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '"}' END AS json
FROM x
"""
