"""Tool calls in conversations: linked to their results, ordered by their dependencies, validated and serialised.

Everything is DataFrame operations. Calls and results meet by a hash join on (conversation, identifier); the levels of
the dependency graph come from rounds that settle every call whose dependencies are settled; arguments are parsed to
variants and checked against declared schemas; canonical JSON has sorted keys and no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.plans.scratch import Scratch

#: A schema is {tool: {parameter: (type, required)}}; types are string, integer, number, boolean, array and object.
TYPES = {"string": ("STRING",), "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT"), "boolean": ("BOOLEAN",)}
Schema = dict[str, dict[str, tuple[str, bool]]]


def _has_type(kind: Column, wanted: str) -> Column:
    """Whether a variant's own type, as schema_of_variant names it, is the declared one."""
    if wanted == "array":
        return kind.startswith("ARRAY")
    if wanted == "object":
        return kind.startswith("OBJECT")
    if wanted == "number":
        return kind.isin(*TYPES["integer"]) | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return kind.isin(*TYPES[wanted])


def argument_errors(tool: Column, arguments: Column, schemas: Schema) -> Column:
    """Sorted array of what is wrong with ``arguments`` (a variant): unknown tool, not an object, missing, type, unknown field."""
    found = F.schema_of_variant(arguments)
    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknown_tool"))
    keys = F.coalesce(F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>")), none)
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            of_value = F.schema_of_variant(value)
            absent = value.isNull() | (of_value == "VOID")
            checks.append(F.when(absent, F.lit(f"missing:{field}") if required else None).when(~_has_type(of_value, kind), F.lit(f"type:{field}")))
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>")), lambda k: F.concat(F.lit("unknown:"), k))
        errors = F.concat(F.array_compact(F.array(*checks, F.lit(None).cast("string"))), unknown)
        out = F.when(tool == name, F.when(~found.startswith("OBJECT"), F.array(F.lit("not_an_object"))).otherwise(errors)).otherwise(out)
    return F.sort_array(F.when(tool.isNull(), F.array(F.lit("unknown_tool"))).when(arguments.isNull(), F.array(F.lit("not_json"))).otherwise(out))


def levels(calls: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, level): 0 for calls without dependencies, else one more than the highest of theirs; null on and behind a cycle.

    ``calls`` has id, ``needs`` (id, needed_id). Dependencies on calls that don't exist are ignored here. Each round settles
    every call whose dependencies are settled, so rounds grow with the longest chain, not with the table.
    """
    nodes = scratch.table(calls.select("id").distinct(), "calls")
    edges = needs.select("id", "needed_id").distinct().join(nodes, "id", "left_semi").join(nodes.withColumnRenamed("id", "needed_id"), "needed_id", "left_semi")
    edges = scratch.table(edges.select("id", "needed_id"), "needs")
    done, level = [], 0
    while True:
        ready = nodes.join(edges, "id", "left_anti")
        ready = scratch.table(ready.select("id", F.lit(level).alias("level")), f"level{level}")
        if ready.isEmpty():
            break
        done.append(ready)
        left = scratch.table(nodes.join(ready, "id", "left_anti"), "left")
        open_ = scratch.table(edges.join(ready.select(F.col("id").alias("needed_id")), "needed_id", "left_anti").select("id", "needed_id"), "open")
        scratch.drop(nodes, edges)
        nodes, edges, level = left, open_, level + 1
    out = nodes.select("id", F.lit(None).cast("int").alias("level"))
    for part in done:
        out = out.unionByName(part)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: Schema, scratch: Scratch) -> DataFrame:
    """One row per call: conv_id, call_id, tool, level, status, errors, missing_needs, canonical.

    ``calls`` has conv_id, call_id, turn, tool, arguments (JSON text); ``results`` has conv_id, call_id, turn, content;
    ``needs`` has conv_id, call_id, needed_id. Of calls with one identifier the earliest turn counts, the rest are left
    out as repeats; of results likewise. A null identifier or conversation makes no call and no
    result. status is ok, invalid (arguments), cyclic, unmet (a dependency that is no call) or unanswered, in
    this order of precedence. canonical is the linked pair as canonical JSON: arguments with sorted keys, null where not
    JSON. Ordering by (conv_id, level, turn, call_id) is topological. Very long texts are linked and serialised whole; other
    columns are ignored, whatever their names. Without calls there are no rows; without results, needs or both all calls are
    still there.
    """
    key = ["conv_id", "call_id"]
    called = calls.select(*key, "turn", "tool", "arguments").dropna(subset=key).groupBy(*key).agg(F.min(F.struct("turn", "tool", "arguments")).alias("c")).select(*key, "c.*")
    called = scratch.table(called.withColumn("id", F.md5(F.to_json(F.struct(F.col("conv_id").cast("string").alias("a"), F.col("call_id").cast("string").alias("b"))))), "called")
    answered = results.select(*key, "turn", "content").dropna(subset=key).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r")).select(*key, F.lit(True).alias("answered"), F.col("r.content").alias("content"))
    answered = scratch.table(answered, "answered")
    id_of = lambda c: F.md5(F.to_json(F.struct(F.col("conv_id").cast("string").alias("a"), F.col(c).cast("string").alias("b"))))
    edges = scratch.table(needs.dropna(subset=[*key, "needed_id"]).select(id_of("call_id").alias("id"), id_of("needed_id").alias("needed_id")).distinct(), "edges")
    level = scratch.table(levels(called, edges, scratch), "levels")
    lost = edges.join(called.select(F.col("id").alias("needed_id")), "needed_id", "left_anti").groupBy("id").agg(F.count("*").alias("missing_needs"))
    lost = scratch.table(lost, "lost")
    linked = called.join(answered, key, "left").join(level, "id", "left").join(lost, "id", "left")
    parsed = linked.withColumn("parsed", F.try_parse_json("arguments")).withColumn("errors", argument_errors(F.col("tool"), F.col("parsed"), schemas))
    bad = F.size("errors") > 0
    status = F.when(bad, "invalid").when(F.col("level").isNull(), "cyclic").when(F.coalesce("missing_needs", F.lit(0)) > 0, "unmet").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    pair = F.struct(F.col("parsed").alias("arguments"), F.col("call_id").cast("string").alias("id"), F.col("tool").alias("name"), F.col("content").alias("result"))
    return parsed.select(*key, "turn", "tool", "level", status.alias("status"), F.array_join("errors", ",").alias("errors"), F.coalesce("missing_needs", F.lit(0)).cast("long").alias("missing_needs"), F.to_json(pair).alias("canonical"))


#: The tools that the derived calls use.
SCHEMAS: Schema = {"look_up": {"query": ("string", True), "limit": ("integer", True)}, "count_words": {"text": ("string", True), "exact": ("boolean", False)}}


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, needs) from ``conversations``: a user's turn calls a tool, an assistant's answers the turn before.

    Texts of even length look something up, others have their words counted; a limit above 300 is sent as text, which its
    schema forbids. A call needs the call at half of its turn. Arguments and contents hold the whole texts.
    """
    said = turns.select("conv_id", F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    n = F.char_length("text")
    text = F.to_json(F.struct("text"))
    query = F.expr("substr(to_json(struct(text AS query)), 2)")
    limit = F.when(n > 300, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    look = F.concat(F.lit('{"limit":'), limit, F.lit(","), query)
    users = said.filter("role = 'user'")
    even = n % 2 == 0
    calls = users.select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.when(even, "look_up").otherwise("count_words").alias("tool"), F.when(even, look).otherwise(text).alias("arguments"))
    results = said.filter("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    half = F.floor(F.col("turn") / 4) * 2
    needs = users.filter("turn >= 2").select("conv_id", call_id(F.col("turn")).alias("call_id"), call_id(half).alias("needed_id"))
    return calls, results, needs


def uncalled(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results without a call, in the columns of ``link_tool_calls``: status uncalled, the result alone as canonical JSON.

    As there, the earliest result of an identifier counts, and a null identifier or conversation makes no result.
    """
    key = ["conv_id", "call_id"]
    first = results.select(*key, "turn", "content").dropna(subset=key).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r")).select(*key, "r.*")
    alone = first.join(calls.select(*key).dropna(), key, "left_anti")
    canonical = F.to_json(F.struct(F.col("call_id").cast("string").alias("id"), F.col("content").alias("result")))
    return alone.select(*key, "turn", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("level"), F.lit("uncalled").alias("status"), F.lit("").alias("errors"), F.lit(0).cast("long").alias("missing_needs"), canonical.alias("canonical"))


def with_digests(linked: DataFrame) -> DataFrame:
    """``linked`` with each text of its canonical JSON, read back from there, as its md5: the form that the SQL twin gives."""
    whole = F.parse_json("canonical")
    text = lambda path: F.md5(F.try_variant_get(whole, path, "string"))
    limit = F.to_json(F.try_variant_get(whole, "$.arguments.limit", "variant"))
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    inner = F.concat_ws(",", part("limit", limit), part("query", quoted(text("$.arguments.query"))), part("text", quoted(text("$.arguments.text"))))
    arguments = F.when(F.try_variant_get(whole, "$.arguments", "variant").isNotNull(), part("arguments", F.concat(F.lit("{"), inner, F.lit("}"))))
    outer = F.concat_ws(",", arguments, part("id", quoted(F.try_variant_get(whole, "$.id", "string"))), part("name", quoted(F.try_variant_get(whole, "$.name", "string"))), part("result", quoted(text("$.result"))))
    return linked.withColumn("canonical", F.concat(F.lit("{"), outer, F.lit("}")))


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls derived from every turn of ``conversations``, linked, ordered, validated and serialised with whole texts.

    Results without a call follow as rows of their own. Texts become digests only in what the operator returns.
    """
    calls, results, needs = derived_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    scratch = Scratch(spark, "calls")
    linked = link_tool_calls(calls, results, needs, SCHEMAS, scratch).unionByName(uncalled(calls, results))
    return with_digests(scratch.table(linked, "linked"))


OP7_SQL = """
WITH RECURSIVE s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
c AS MATERIALIZED (SELECT conv_id, turn, 'call_' || turn AS call_id, CASE WHEN n % 2 = 0 THEN 'look_up' ELSE 'count_words' END AS tool,
        CASE WHEN n % 2 = 0 THEN '{"limit":' || CASE WHEN n > 300 THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END || ',"query":"' || md5(text) || '"}'
             ELSE '{"text":"' || md5(text) || '"}' END AS args,
        CASE WHEN n % 2 = 0 AND n > 300 THEN 'type:limit' ELSE '' END AS errors, (turn // 4) * 2 AS half FROM s WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS turn, md5(text) AS content FROM s WHERE role = 'assistant'),
l AS (SELECT conv_id, turn, CAST(0 AS INTEGER) AS level FROM c WHERE turn < 2 OR NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.half)
      UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM c JOIN l ON c.conv_id = l.conv_id AND c.half = l.turn WHERE c.turn >= 2),
m AS (SELECT c.conv_id, c.turn FROM c WHERE turn >= 2 AND NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.half))
SELECT c.conv_id, call_id, c.turn, tool, level, CASE WHEN errors <> '' THEN 'invalid' WHEN level IS NULL THEN 'cyclic' WHEN m.turn IS NOT NULL THEN 'unmet' WHEN content IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
       errors, CAST(CASE WHEN m.turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS missing_needs,
       '{"arguments":' || args || ',"id":"' || call_id || '","name":"' || tool || '"' || CASE WHEN content IS NULL THEN '' ELSE ',"result":"' || content || '"' END || '}' AS canonical
FROM c LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn LEFT JOIN m ON c.conv_id = m.conv_id AND c.turn = m.turn
"""
