"""Tool calls linked to their results, ordered, validated and written as canonical JSON.

Everything is columns and joins. Calls and results meet in a hash join on
conversation and identifier. A conversation whose dependencies all point back in
time is in topological order by its turns already, which one join finds out; the
others are peeled level by level. Positions are numbered by range partitions, so
a conversation of any length is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import broadcast_if_small, with_positions
from .common import saved, word_count


def canonical(json: Column) -> Column:
    """Keys in order, no white space; null for what is not JSON."""
    return F.to_json(F.try_parse_json(json))


def _types(json: Column) -> Column:
    """JSON type of every argument by name; null if ``json`` is no object."""
    kinds = F.transform_values(F.from_json(json, "map<string,variant>"), lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))

    def kind(k, t):
        return (
            F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer")
            .when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "VOID", "null")
            .otherwise("number")
        )

    return F.when(json.startswith("{"), F.transform_values(kinds, kind))


def _errors(types: Column, schema: Column) -> Column:
    """What is wrong with the arguments, sorted: ``missing:``, ``type:`` and ``unknown:`` names."""

    def wrong(k):
        want = schema[k]["type"]
        fits = (want == types[k]) | ((want == "number") & (types[k] == "integer"))
        return F.when(~F.map_contains_key(schema, k), F.concat(F.lit("unknown:"), k)).when(~fits, F.concat(F.lit("type:"), k))

    def missing(f):
        return F.when(schema[f]["required"] & ~F.map_contains_key(types, f), F.concat(F.lit("missing:"), f))

    found = F.concat(F.transform(F.map_keys(types), wrong), F.transform(F.map_keys(schema), missing))
    return (
        F.when(types.isNull(), F.array(F.lit("not_an_object")))
        .when(schema.isNull(), F.array(F.lit("unknown_tool")))
        .otherwise(F.array_sort(F.array_compact(found)))
    )


def _levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level, cyclic)`` for calls of conversations that are not in order by turn."""
    named = calls.select("conv_id", "call_id", "turn").where("call_id is not null")
    at = named.groupBy("conv_id", "call_id").agg(F.max("turn").alias("dep_turn"), F.min("turn").alias("first_turn"))
    edges = calls.where("call_id is not null").select("conv_id", "call_id", "turn", F.explode("after").alias("dep"))
    edges = edges.join(at.select("conv_id", F.col("call_id").alias("dep"), "dep_turn"), ["conv_id", "dep"])
    late = edges.where((F.col("dep_turn") > F.col("turn")) | ((F.col("dep_turn") == F.col("turn")) & (F.col("dep") >= F.col("call_id"))))
    odd = saved(late.select("conv_id").distinct(), "odd")
    rest = saved(at.select("conv_id", "call_id").join(odd, "conv_id", "left_semi"), "nodes")
    edges = saved(edges.select("conv_id", "dep", "call_id").distinct().join(odd, "conv_id", "left_semi"), "edges")
    done, level = rest.limit(0).select("conv_id", "call_id", F.lit(0).alias("level"), F.lit(False).alias("cyclic")), 0
    while not rest.isEmpty():
        blocked = edges.select("conv_id", "call_id").distinct()
        ready = saved(rest.join(blocked, ["conv_id", "call_id"], "left_anti"), "ready")
        stuck = ready.isEmpty()
        done = done.union((rest if stuck else ready).select("conv_id", "call_id", F.lit(level).alias("level"), F.lit(stuck).alias("cyclic")))
        if stuck:
            break
        rest = saved(rest.join(ready, ["conv_id", "call_id"], "left_anti"), "rest")
        edges = saved(edges.join(ready.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti"), "edges")
        level += 1
    return done


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without a call.

    ``calls(conv_id, call_id, turn, name, arguments, after)``: ``arguments`` is JSON
    text, ``after`` the identifiers of calls that must come first (null or unknown
    ones bind nothing). ``results(conv_id, call_id, turn, content)``; of several
    results for a call the earliest, then least, counts. ``schemas(name, field,
    type, required)``; a field given twice counts once.

    Returns ``(conv_id, position, call_id, name, status, errors, json)``.
    position: 0, 1, … within a conversation, dependencies first, then by turn, then
    identifier; members of a cycle come last with status ``cyclic``. Other
    statuses: ``ok``, ``invalid`` (see ``errors``), ``no_result``, ``no_call``.
    Calls that share an identifier share its result; rows without identifier
    link to nothing. Empty tables give empty results.
    """
    known = (
        schemas.where("name is not null and field is not null")
        .groupBy("name", "field")
        .agg(F.min("type").alias("type"), F.max("required").alias("required"))
        .groupBy("name")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("type", "required")))).alias("schema"))
    )
    arguments = canonical(F.col("arguments"))
    calls = saved(calls.select("conv_id", "call_id", "turn", "name", "after", arguments.alias("arguments")), "calls")
    checked = calls.join(broadcast_if_small(schemas_by_name(known)), "name", "left")
    checked = checked.withColumn("errors", _errors(_types(F.col("arguments")), F.col("schema"))).drop("schema", "after")
    least = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("result"))
    linked = checked.hint("shuffle_hash").join(least, ["conv_id", "call_id"], "full_outer")
    levels = _levels(calls)
    linked = linked.join(levels, ["conv_id", "call_id"], "left")
    is_call = F.col("errors").isNotNull()
    status = (
        F.when(~is_call, "no_call")
        .when(F.col("cyclic"), "cyclic")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("result").isNull(), "no_result")
        .otherwise("ok")
    )
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")),
        F.lit(',"call_id":'), F.coalesce(_quoted("call_id"), F.lit("null")),
        F.lit(',"name":'), F.coalesce(_quoted("name"), F.lit("null")),
        F.lit(',"result":'), F.coalesce(_quoted("result.content"), F.lit("null")),
        F.lit("}"),
    )
    rows = linked.select(
        "conv_id", "call_id", "name", status.alias("status"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
        body.alias("json"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("turn", "result.turn").alias("turn"),
    )
    order = [F.col(c) for c in ("conv_id", "level", "turn", "call_id", "json")]
    numbered = saved(with_positions(rows, order, "at"), "numbered")
    starts = numbered.groupBy(F.col("conv_id").alias("of")).agg(F.min("at").alias("start"))
    placed = numbered.join(starts, F.col("conv_id").eqNullSafe(F.col("of")))
    return placed.select("conv_id", (F.col("at") - F.col("start")).alias("position"), "call_id", "name", "status", "errors", "json")


def schemas_by_name(known: DataFrame) -> DataFrame:
    """Written once: its size decides how it is joined."""
    return saved(known, "schemas")


def _quoted(column: str) -> Column:
    """A text as a JSON string."""
    wrapped = F.to_json(F.struct(F.col(column).alias("v")))
    return F.when(F.col(column).isNotNull(), F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


SCHEMAS = [
    ("ask", "digest", "string", True),
    ("ask", "n_words", "integer", True),
    ("ask", "after", "string", False),
    ("configure", "digest", "string", True),
    ("configure", "n_words", "number", False),
]


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas that a table of turns stands for.

    A user's turn is a call of ``ask``, a system turn one of ``configure``; each
    depends on the call two turns before, if there is one. An assistant's turn is
    the result of the call one turn before.
    """
    turn = F.col("turn").cast("long")
    call = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    after = F.when(turn >= 2, call(turn - 2))
    words = word_count(text).cast("string")
    raw = F.concat(
        F.lit('{ "n_words": '), words, F.lit(', "digest": "'), F.md5(text), F.lit('"'),
        F.coalesce(F.concat(F.lit(', "after": "'), after, F.lit('"')), F.lit("")), F.lit(" }"),
    )
    role = F.col("role")
    calls = conversations.where(role.isin("user", "system")).select(
        F.col("conv_id").cast("long").alias("conv_id"), call(turn).alias("call_id"), turn.alias("turn"),
        F.when(role == "user", "ask").otherwise("configure").alias("name"), raw.alias("arguments"),
        F.when(after.isNotNull(), F.array(after)).alias("after"),
    )
    results = conversations.where(role == "assistant").select(
        F.col("conv_id").cast("long").alias("conv_id"), call(turn - 1).alias("call_id"), turn.alias("turn"), text.alias("content")
    )
    # A relation of literals, so that no Python rows are shipped.
    rows = ", ".join(f"('{n}', '{f}', '{t}', {str(r).lower()})" for n, f, t, r in SCHEMAS)
    schemas = conversations.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(name, field, type, required)")
    return calls, results, schemas


SQL = r"""
WITH calls AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name,
    '{' || CASE WHEN turn >= 2 THEN '"after":"call_' || (turn - 2) || '",' ELSE '' END
    || '"digest":"' || md5(coalesce(text, '')) || '","n_words":' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) || '}' AS arguments
  FROM conversations WHERE role IN ('user', 'system')
), results AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, turn, coalesce(text, '') AS content FROM conversations WHERE role = 'assistant'
), linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, name, coalesce(c.turn, r.turn) AS turn,
    CASE WHEN name IS NULL THEN 'no_call' WHEN name = 'configure' AND c.turn >= 2 THEN 'invalid' WHEN r.content IS NULL THEN 'no_result' ELSE 'ok' END AS status,
    CASE WHEN name = 'configure' AND c.turn >= 2 THEN 'unknown:after' ELSE '' END AS errors,
    '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":"' || coalesce(c.call_id, r.call_id) || '","name":'
    || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, call_id) - 1 AS position, call_id, name, status, errors, json FROM linked
"""
