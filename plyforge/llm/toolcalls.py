"""Tool-call linking: calls and results joined by identifier, ordered, validated, as canonical JSON.

`link` joins a table of calls to a table of results by conversation and call id, checks arguments
against the schema of the called tool, puts the calls of a conversation in topological order of
their dependencies and writes each call with its result as one canonical JSON text (sorted keys, no
spaces). Conversations are never gathered into one row, so one of any length stays spread.

Order: a dependency normally stands before its dependent, and the order of turns is kept then. The
level of a call is the largest number of late dependencies (those at the same turn or a later one,
or without a turn) on any path of dependencies that ends in it; a call on a cycle, or after one, has
level null. Rows sorted by (level, turn, call_id) are in topological order. All calls go through
rounds that settle those whose dependencies are settled and halve the paths of the others.

Defined cases: of several calls with one id the first by turn, name and arguments counts, and
`n_calls` tells how many there were; the same for results; calls without conversation or id are
kept with status `no_id`; results without a call are `orphan`, calls without a result `unanswered`;
null, empty or broken arguments are `invalid`, unknown tools `unknown_tool`; a dependency that is no
call of the conversation is left out of the order; empty tables give no rows; other columns are left
out; long texts are kept whole.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.scale import fits_broadcast
from plyforge.session import checkpointed

KEY = ["conv_id", "call_id"]
MOST_LATE = 1 << 40  # only counts on a cycle come near it
#: JSON schema types and the variant types that meet them.
KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT",
    "boolean": "BOOLEAN",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
    "null": "VOID",
}


def first_calls(calls: DataFrame) -> DataFrame:
    """One row per call id: its first call, and the number of calls."""
    row = F.struct("turn", "name", "arguments", "depends_on")
    groups = calls.dropna(subset=KEY).groupBy(*KEY)
    return groups.agg(F.min(row).alias("call"), F.count(F.lit(1)).alias("n_calls")).select(
        *KEY, "call.*", "n_calls"
    )


def first_results(results: DataFrame) -> DataFrame:
    """One row per call id: its first result, and the number of results."""
    row = F.struct(F.col("turn").alias("result_turn"), F.col("content").alias("result"))
    groups = results.dropna(subset=KEY).groupBy(*KEY)
    return groups.agg(F.min(row).alias("found"), F.count(F.lit(1)).alias("n_results")).select(
        *KEY, "found.*", "n_results"
    )


def _waiting(left: DataFrame, edges: DataFrame) -> DataFrame:
    """Unsettled calls with the number of their edges and, if there is one, where it leads."""
    waits = edges.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("dep").alias("next"), F.min("late").alias("step")
    )
    return checkpointed(left.select(*KEY, "base").join(waits, KEY, "left"))


def _raised(left: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """Calls whose `base` is at least that of their dependencies and what is late on the way."""
    least = edges.groupBy(*KEY).agg(F.least(F.max(edges[base] + F.col("late")), F.lit(MOST_LATE)).alias("least"))
    rows = left.select(*KEY, "base").join(least, KEY, "left")
    return rows.select(*KEY, F.greatest("base", "least").alias("base"))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level of every call.

    A call holds the level known so far (`base`) and edges to the dependencies that it waits for,
    with the number of late ones on the way (`late`). In a round a settled dependency raises the base
    and its edge goes; one that waits for a single call raises it too, and the edge moves on to that
    call, so a chain of n calls takes about log n rounds. When no call is settled the rest is cyclic.
    """
    edges = calls.select(*KEY, "turn", F.explode("depends_on").alias("dep")).distinct()
    deps = calls.select("conv_id", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"))
    late = F.coalesce(F.col("dep_turn") >= F.col("turn"), F.lit(True)).cast("long")
    edges = checkpointed(edges.join(deps, ["conv_id", "dep"]).select(*KEY, "dep", late.alias("late")))
    none = F.lit(0).cast("long")
    state, done = _waiting(calls.select(*KEY, none.alias("base")), edges), []
    while True:
        ready, level = state.where("n IS NULL"), F.col("base").cast("int").alias("level")
        if ready.isEmpty():
            break
        done.append(ready.select(*KEY, level))
        of_dep = lambda *columns: ["conv_id", F.col("call_id").alias("dep"), *columns]
        settled = ready.select(*of_dep(F.col("base").alias("reached")))
        met = checkpointed(edges.join(settled, ["conv_id", "dep"], "left"))
        left = _raised(state.where("n IS NOT NULL"), met.where("reached IS NOT NULL"), "reached")
        edges = met.where("reached IS NULL").drop("reached")
        state = _waiting(left, edges)
        moved = edges.join(state.select(*of_dep("base", "n", "next", "step")), ["conv_id", "dep"])
        moved = checkpointed(moved.withColumn("one", F.coalesce(F.col("n") == 1, F.lit(False))))
        left = _raised(state, moved.where("one"), "base")
        further = F.least(F.col("late") + F.expr("IF(one, step, 0)"), F.lit(MOST_LATE))
        edges = moved.groupBy(*KEY, F.expr("IF(one, next, dep)").alias("dep")).agg(F.max(further).alias("late"))
        edges = checkpointed(edges)
        state = _waiting(left, edges)
    cyclic = state.select(*KEY, F.lit(None).cast("int").alias("level"))
    return reduce(DataFrame.unionByName, done, cyclic)


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with `valid`, and `known` for tools that have a schema.

    `schemas` has a row per tool and field: name, field, kind (a JSON schema type), required.
    Arguments are valid if they are a JSON object with all required fields, without unknown
    fields, and with values of the fields' kinds.
    """
    fields = F.map_from_entries(
        F.collect_list(F.struct("field", F.struct("kind", "required")))  # the fields of one tool
    )
    one = schemas.groupBy("name", "field").agg(
        F.min("kind").alias("kind"), F.max("required").alias("required")
    )
    tools = one.groupBy("name").agg(fields.alias("fields"))
    tools = F.broadcast(tools) if fits_broadcast(one) else tools
    parsed = calls.join(tools, "name", "left").withColumn("_json", F.try_parse_json("arguments"))
    parsed = parsed.withColumn(
        "_kinds",
        F.expr(
            "CASE WHEN startswith(schema_of_variant(_json), 'OBJECT') THEN transform_values("
            "CAST(_json AS map<string, variant>), (k, v) -> coalesce(schema_of_variant(v), 'VOID')) END"
        ),
    )
    pattern = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    present = F.map_keys("_kinds")
    complete = F.forall(
        F.map_entries("fields"),
        lambda e: ~e["value"]["required"] | F.array_contains(present, e["key"]),
    )
    fitting = F.forall(
        F.map_entries("_kinds"),
        lambda e: F.coalesce(
            F.rlike(
                e["value"],
                F.concat(
                    F.lit("^("), F.element_at(pattern, F.col("fields")[e["key"]]["kind"]), F.lit(")$")
                ),
            ),
            F.lit(False),
        ),
    )
    return parsed.select(
        *calls.columns,
        "_json",
        F.col("fields").isNotNull().alias("known"),
        F.coalesce(complete & fitting, F.lit(False)).alias("valid"),
    )


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each call with its result, status, order and canonical JSON.

    calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids);
    results: conv_id, turn, call_id, content.
    """
    calls = calls.select(*KEY, "turn", "name", "arguments", "depends_on")
    results = results.select(*KEY, "turn", "content")
    own = first_calls(calls)
    unkeyed = calls.where("conv_id IS NULL OR call_id IS NULL").withColumn("n_calls", F.lit(1))
    rows = own.join(levels(own), KEY, "left").join(first_results(results), KEY, "full_outer")
    rows = rows.unionByName(unkeyed, allowMissingColumns=True)
    lost = results.where("conv_id IS NULL OR call_id IS NULL").select(
        *KEY, F.col("turn").alias("result_turn"), F.col("content").alias("result"),
        F.lit(1).alias("n_results"),
    )
    rows = checked(rows.unionByName(lost, allowMissingColumns=True), schemas)
    status = (
        F.when(F.col("n_calls").isNull(), "orphan")
        .when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no_id")
        .when(~F.col("known"), "unknown_tool")
        .when(~F.col("valid"), "invalid")
        .when(F.col("n_results").isNull(), "unanswered")
        .otherwise("linked")
    )
    line = F.struct(
        F.col("_json").alias("arguments"),
        F.col("call_id").alias("id"),
        "name",
        "result",
        status.alias("status"),
    )
    return rows.select(
        *KEY,
        "turn",
        "name",
        "level",
        "result_turn",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        status.alias("status"),
        F.to_json(line, {"ignoreNullFields": "false"}).alias("line"),
    )


def calls_of(conversations: DataFrame) -> DataFrame:
    """A call for each turn of a user or system: answering it, after the same turn before."""
    call_id = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    return conversations.where("role IN ('user', 'system')").select(
        "conv_id",
        "turn",
        F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), call_id(turn)).alias("call_id"),
        F.when(F.col("role") == "user", "answer").otherwise("configure").alias("name"),
        F.to_json(
            F.struct(
                F.coalesce("text", F.lit("")).alias("prompt"),
                turn.alias("turn"),
                F.length(F.coalesce("text", F.lit(""))).alias("chars"),
            )
        ).alias("arguments"),
        F.when(turn >= 2, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """The result of a call: the assistant's turn that follows it."""
    before = F.col("turn") - 1
    return conversations.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.when(
            F.col("conv_id").isNotNull() & before.isNotNull(),
            F.concat_ws(":", F.col("conv_id").cast("string"), before.cast("string")),
        ).alias("call_id"),
        F.col("text").alias("content"),
    )


def turn_schemas(spark) -> DataFrame:
    """The tools of `calls_of` and the kinds of their arguments."""
    rows = [
        (name, field, kind, True)
        for name in ("answer", "configure")
        for field, kind in (("prompt", "string"), ("turn", "integer"), ("chars", "integer"))
    ]
    return spark.createDataFrame(rows, "name string, field string, kind string, required boolean")
