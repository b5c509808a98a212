"""Tool-call linking for chat data.

Calls and results meet by identifier in a hash join; calls are ordered so that whatever a
call depends on comes before it; arguments are checked against the tool's schema; each call
becomes one line of canonical JSON (sorted keys, no blanks).

A transcript usually refers backwards only. Its own order is then a topological order and
``level`` is 0 throughout. Conversations with a forward reference are peeled level by level
(calls whose dependencies are all placed, round after round, in written tables). Sorting a
conversation by ``(level, seq)`` is a topological order in both cases.

Defined results: a null call id links to nothing; of several results of one call the first by
``seq``, then content, is linked and each other one is a row with status ``extra_result``; repeated call ids are all kept and marked ``duplicate``; a result without a
call is a row with status ``orphan_result``; arguments that are no JSON object are null in
the record and a violation; calls on a dependency cycle, or behind one, have a null level and
the violation ``cycle``; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceboard.llm.common import stored


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def json_type(value: Column) -> Column:
    """The JSON schema type of a variant."""
    of = F.schema_of_variant(value)
    return (F.when(of == "BIGINT", "integer").when(of == "STRING", "string").when(of == "BOOLEAN", "boolean")
            .when(of == "VOID", "null").when(of.startswith("ARRAY"), "array").when(of.startswith("OBJECT"), "object").otherwise("number"))


def violations(arguments: Column, types: Column, required: Column) -> Column:
    """Sorted violations of an argument object (``map<string,variant>``, null if it is none)
    against ``types`` (name to JSON type, null for an unknown tool) and ``required`` names."""
    missing = F.transform(F.array_except(required, F.map_keys(arguments)), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.array_except(F.map_keys(arguments), F.map_keys(types)), lambda k: F.concat(F.lit("unknown:"), k))

    def fits(name: Column, value: Column) -> Column:
        want, have = F.try_element_at(types, name), json_type(value)
        return want.isNull() | (want == have) | ((want == "number") & (have == "integer"))

    bad = F.map_filter(arguments, lambda k, v: ~fits(k, v))
    wrong = F.transform(F.map_keys(bad), lambda k: F.concat(F.lit("type:"), k))
    return (F.when(types.isNull(), F.array(F.lit("unknown_tool"))).when(arguments.isNull(), F.array(F.lit("not_an_object")))
            .otherwise(F.sort_array(F.concat(missing, unknown, wrong))))


def tool_schemas(schemas: DataFrame) -> DataFrame:
    """``(tool, argument, type, required)`` rows as one ``(tool, types, required)`` row per tool."""
    rows = schemas.where(F.col("tool").isNotNull() & F.col("argument").isNotNull()).groupBy("tool", "argument").agg(
        F.min("type").alias("type"), F.max("required").alias("req"))
    return rows.groupBy("tool").agg(
        F.map_from_entries(F.collect_list(F.struct("argument", "type"))).alias("types"),
        F.collect_list(F.when(F.col("req"), F.col("argument"))).alias("required"))


def topological_levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of the calls in conversations with a forward reference.

    ``calls``: ``(conv_id, call_id, seq, depends_on)``. The number of rounds is the longest
    dependency chain of those conversations; what cannot be placed gets a null level.
    """
    nodes = calls.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("seq").alias("seq"))
    edges = (calls.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).distinct()
             .join(nodes, ["conv_id", "call_id"])
             .join(nodes.select("conv_id", F.col("call_id").alias("dep"), F.col("seq").alias("dep_seq")), ["conv_id", "dep"]))
    edges = stored(edges, "call-edges")
    hard = stored(edges.where(F.col("dep_seq") >= F.col("seq")).select("conv_id").distinct(), "forward-conversations")
    left = stored(nodes.join(hard, "conv_id", "left_semi").select("conv_id", "call_id"), "unplaced")
    waiting = stored(edges.join(hard, "conv_id", "left_semi").select("conv_id", "call_id", "dep"), "waiting")
    placed = left.withColumn("level", F.lit(None).cast("int")).limit(0)
    level = 0
    while not left.isEmpty():
        free = stored(left.join(waiting, ["conv_id", "call_id"], "left_anti"), "placed")
        if free.isEmpty():
            break
        placed = placed.unionByName(free.withColumn("level", F.lit(level)))
        done = free.withColumnRenamed("call_id", "dep")
        left = stored(left.join(free, ["conv_id", "call_id"], "left_anti"), "unplaced")
        waiting = stored(waiting.join(done, ["conv_id", "dep"], "left_anti"), "waiting")
        level += 1
    return placed.unionByName(left.withColumn("level", F.lit(None).cast("int")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id, seq, level, status, violations, record`` for every call and unlinked result.

    ``calls``: conv_id, call_id, seq, tool, arguments (JSON text), depends_on (call ids);
    ``results``: conv_id, call_id, seq, content; ``schemas``: tool, argument, type, required.
    """
    calls = calls.select("conv_id", "call_id", F.col("seq").cast("long").alias("seq"), "tool", "arguments",
                         F.array_distinct(F.array_compact(F.coalesce("depends_on", _no_strings()))).alias("depends_on"))
    results = results.select("conv_id", "call_id", F.col("seq").cast("long").alias("seq"), "content")
    key = ["conv_id", "call_id"]
    counts = calls.groupBy(*key).agg(F.count(F.lit(1)).alias("n_calls"))
    answers = results.groupBy(*key).agg(F.min(F.struct("seq", "content")).alias("answer"), F.count(F.lit(1)).alias("n_results"))
    levels = stored(topological_levels(calls), "levels")
    # what is known of an identifier: one row each, so a repeated identifier makes no pairs
    ids = stored(counts.join(answers, key, "full"), "identifiers")
    known = calls.join(ids, key, "left")
    deps = (calls.select(*key, F.explode("depends_on").alias("dep")).distinct()
            .join(counts.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("there")), ["conv_id", "dep"], "left")
            .where(F.col("there").isNull()).groupBy(*key).agg(F.sort_array(F.collect_set(F.concat(F.lit("unknown_dependency:"), "dep"))).alias("no_dep")))
    hard = levels.groupBy(*key).agg(F.max("level").alias("at"), F.lit(True).alias("hard"))
    parsed = F.try_parse_json(F.col("arguments"))
    known = (known.join(stored(deps, "unknown-dependencies"), key, "left").join(hard, key, "left").join(tool_schemas(schemas), "tool", "left")
             .withColumn("args", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))
             .withColumn("level", F.when(F.col("hard").isNull(), F.lit(0)).otherwise(F.col("at"))))
    found = F.concat(violations(F.col("args").cast("map<string,variant>"), F.col("types"), F.coalesce("required", _no_strings())),
                     F.coalesce("no_dep", _no_strings()), F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(_no_strings()))
    linked = F.col("answer").isNotNull()
    record = F.to_json(F.struct(F.col("args").alias("arguments"), F.sort_array("depends_on").alias("depends_on"), F.col("call_id").alias("id"),
                                F.col("tool").alias("name"), F.col("answer")["content"].alias("result")), {"ignoreNullFields": "false"})
    status = F.when(F.col("n_calls") > 1, "duplicate").when(linked, "linked").otherwise("unanswered")
    out = known.select("conv_id", "call_id", "seq", "level", status.alias("status"), found.alias("violations"), record.alias("record"))
    no_call = ids.where(F.col("n_calls").isNull()).select(*key).unionByName(
        results.where(F.col("conv_id").isNull() | F.col("call_id").isNull()).select(*key)).distinct()
    orphans = results.join(no_call.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")),
                           F.col("conv_id").eqNullSafe(F.col("c")) & F.col("call_id").eqNullSafe(F.col("i")), "left_semi").select("*", F.lit("orphan_result").alias("status"))
    # beside the linked result: equal ones are counted, so that one of them is the linked one
    several = ids.where(F.col("n_calls").isNotNull() & (F.col("n_results") > 1)).select(*key, "answer")
    others = results.groupBy(*key, "seq", "content").agg(F.count(F.lit(1)).alias("n")).join(several, key)
    others = others.withColumn("n", F.col("n") - F.struct("seq", "content").eqNullSafe(F.col("answer")).cast("long")).where(F.col("n") > 0)
    extra = others.select(*key, "seq", "content", F.explode(F.array_repeat(F.lit("extra_result"), F.col("n").cast("int"))).alias("status"))
    lone = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return out.unionByName(orphans.unionByName(extra).select(
        *key, "seq", F.lit(None).cast("int").alias("level"), "status", _no_strings().alias("violations"), lone.alias("record")))


TURN_SCHEMAS = [("respond", "after", "string", False), ("respond", "prompt", "string", True), ("respond", "turn", "integer", True),
                ("configure", "prompt", "string", True), ("configure", "turn", "integer", True)]


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain conversations ``(conv_id, turn, role, text)`` as calls, results and schemas.

    A user turn calls ``respond`` and depends on the call of the turn two before it; a system
    turn calls ``configure``; any other turn is the result of the call one turn before. A turn
    without conversation or number has a null call id, and a null number or text is a missing
    argument.
    """
    at = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    asks = turns.where(F.col("role").isin("user", "system"))
    user = F.col("role") == "user"
    earlier = asks.where(user).select(F.col("conv_id"), (F.col("turn") + 2).alias("turn"), F.lit(True).alias("again")).distinct()
    after = F.when(user & F.col("again"), at(2))
    calls = asks.join(earlier, ["conv_id", "turn"], "left").select(
        "conv_id", at(0).alias("call_id"), F.col("turn").alias("seq"), F.when(user, "respond").otherwise("configure").alias("tool"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt"), after.alias("after"))).alias("arguments"),
        F.array_compact(F.array(after)).alias("depends_on"))
    results = turns.where(~F.coalesce(F.col("role").isin("user", "system"), F.lit(False))).select(
        "conv_id", at(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    schemas = turns.sparkSession.createDataFrame(TURN_SCHEMAS, "tool string, argument string, type string, required boolean")
    return calls, results, schemas
