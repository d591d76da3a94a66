"""Tool-call linking.

Calls and results meet in a hash join on conversation and identifier, unknown
dependencies and levels join likewise. A call's level
is the length of its longest chain of dependencies, so (level, turn, id) is a
topological order; chains are resolved by pointer doubling, and only calls with
several dependencies are placed round by round. Arguments are checked against the schema of their tool, and each call with
its result becomes one canonical JSON text: sorted keys, no spaces.

No step gathers a conversation: rows stay one per call, whatever a conversation holds.

Defined results: a null conversation or id links with nothing and stands alone; of
calls that share an identifier the earliest counts (then the least name and
arguments) and the others are counted in n_calls; of results likewise; a result
without a call is a row with a null name; a dependency on an unknown identifier is
ignored and counted; calls on or behind a cycle have a null level; arguments that
are not a JSON object, or repeat a key, are invalid and serialised as null; empty
tables give no rows, texts of any length stay whole, extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch

NAME = "op2_tool_linking"
ORACLE = None

#: JSON types by the start of a variant's schema.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(?:BIGINT|DOUBLE|DECIMAL)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
#: Tool to parameters, each with its JSON type and whether it is required.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

#: The tools as which the query reads a conversation's turns.
TURN_TOOLS: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True)}, "configure": {"text": ("string", True), "turn": ("integer", True)}}

KEY = ["conv", "call_id"]


def canonical_json(text: Column) -> Column:
    """The JSON text with sorted keys and no spaces; null if it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def is_valid(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments are an object with all required keys, no unknown ones, and values of their types."""
    value, keys = F.try_parse_json(arguments), F.json_object_keys(arguments)
    chain = F.when(value.isNull() | keys.isNull(), F.lit(False))
    for tool, parameters in schemas.items():
        good = F.forall(keys, lambda k: k.isin(*parameters)) if parameters else F.size(keys) == 0
        for key, (kind, required) in parameters.items():
            typed = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")).rlike(f"^{TYPES[kind]}")
            good = good & F.coalesce(typed if required else (~F.array_contains(keys, key)) | typed, F.lit(False))
        chain = chain.when(name == tool, good)
    return F.coalesce(chain.otherwise(F.lit(False)), F.lit(False))


def levels(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """calls(conv, call_id) and edges(conv, call_id, dep), both distinct, to (conv, call_id, level).

    Calls with one dependency are paths. Their pointers are doubled until they reach
    an anchor - a call with none or several - so a path of n calls takes log2 n
    rounds. Anchors with several dependencies are then peeled: one is placed when the
    anchors of all its dependencies are.
    """
    at = lambda name: ["conv", F.col("call_id").alias(name)]
    known = scratch.save(edges.join(calls.select(*at("dep")), ["conv", "dep"]).select(*KEY, "dep"), "edges")
    degree = known.groupBy(*KEY).agg(F.count("*").alias("degree"))
    pointers = scratch.save(known.join(degree.filter("degree = 1"), KEY, "left_semi").select(*KEY, F.col("dep").alias("up"), F.lit(1).alias("far")), "pointers-0")
    before, k = -1, 0
    while True:
        ahead = pointers.select(*at("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        k += 1
        joined = pointers.join(ahead, ["conv", "up"], "left")
        nxt = scratch.save(joined.select(*KEY, F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("up2").isNotNull().alias("open")), f"pointers-{k}")
        scratch.drop(f"pointers-{k - 1}")
        pointers, still = nxt.select(*KEY, "up", "far"), nxt.filter("open").count()
        if still in (0, before):  # the same number again: cycles, and what hangs on them
            break
        before = still
    ends = nxt.filter("NOT open").select(*KEY, "up", "far")
    placed = scratch.save(calls.join(known, KEY, "left_anti").select(*KEY, F.lit(0).alias("level")), "level-0")
    # of each dependency of a call with several, its anchor and the way from there
    several = known.join(degree.filter("degree > 1"), KEY)
    way = ends.select(*at("dep"), F.col("up").alias("anchor"), "far").unionByName(calls.join(known.join(degree.filter("degree = 1"), KEY, "left_semi").select(*KEY), KEY, "left_anti").select("conv", F.col("call_id").alias("dep"), F.col("call_id").alias("anchor"), F.lit(0).alias("far")))
    several = scratch.save(several.join(way, ["conv", "dep"]).select(*KEY, "degree", "anchor", (F.col("far") + 1).alias("far")), "several")
    k, open_ = 0, not several.isEmpty()
    while open_:
        k += 1
        reached = several.join(placed.select(*at("anchor"), "level"), ["conv", "anchor"]).groupBy(*KEY, "degree").agg(F.count("*").alias("n"), F.max(F.col("level") + F.col("far")).alias("level"))
        new = scratch.save(reached.filter("n = degree").select(*KEY, "level").join(placed, KEY, "left_anti"), f"level-{k}")
        open_ = not new.isEmpty()
        placed = placed.unionByName(new)
    along = ends.join(placed.select(*at("up"), "level"), ["conv", "up"]).select(*KEY, (F.col("level") + F.col("far")).alias("level"))
    return placed.unionByName(along)


def link_tools(calls: DataFrame, results: DataFrame, schemas: Schemas, scratch: Scratch | None = None) -> DataFrame:
    """calls(conv, call_id, turn, name, arguments, after: array of ids) and results(conv, call_id, turn, content).

    Returns conv, call_id, name, call_turn, result_turn, n_calls, n_results,
    n_unknown, level, valid, json.
    """
    scratch = scratch or Scratch(calls.sparkSession, "tools")
    known = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    calls = scratch.save(calls.select("conv", "call_id", "turn", "name", "arguments", "after"), "calls")
    one = calls.filter(known).groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("call"), F.count("*").alias("n_calls"))
    one = scratch.save(one.select(*KEY, "call.*", "n_calls"), "first-calls")
    answers = results.filter(known).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    answers = answers.select(*KEY, F.col("answer.turn").alias("result_turn"), F.col("answer.content").alias("content"), "n_results")
    edges = one.select(*KEY, F.explode(F.array_distinct(F.filter("after", lambda x: x.isNotNull()))).alias("dep"))
    unknown = edges.join(one.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("n_unknown"))
    placed = levels(one.select(*KEY), edges, scratch)
    linked = one.withColumn("is_call", F.lit(True)).join(answers.hint("shuffle_hash"), KEY, "full").join(unknown.hint("shuffle_hash"), KEY, "left").join(placed.hint("shuffle_hash"), KEY, "left")
    lone_calls = calls.filter(~known).select("conv", "call_id", "turn", "name", "arguments", F.lit(1).cast("long").alias("n_calls"), F.lit(True).alias("is_call"), F.lit(0).alias("level"))
    lone_results = results.filter(~known).select("conv", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results"))
    rows = linked.drop("after").unionByName(lone_calls, allowMissingColumns=True).unionByName(lone_results, allowMissingColumns=True)
    valid = F.when(F.col("is_call"), is_valid(F.col("name"), F.col("arguments"), schemas))
    rows = rows.withColumn("valid", valid).withColumn("canonical", F.when(F.coalesce("valid", F.lit(False)) | F.json_object_keys("arguments").isNotNull(), canonical_json(F.col("arguments"))))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    json = F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("content")), F.lit("}"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("conv", "call_id", "name", F.col("turn").alias("call_turn"), "result_turn", number("n_calls"), number("n_results"), number("n_unknown"), "level", "valid", json.alias("json"))


def turns_as_tools(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads turns as calls and results: user turns call reply, system turns configure; any other turn answers the turn before.

    Turns of roles beside user and system, null included, are results. A call depends on the calls of the two turns before it, as far as there are any.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    at = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    tool = F.when(F.col("role") == "user", "reply").when(F.col("role") == "system", "configure")
    calls = c.withColumn("name", tool).filter("name IS NOT NULL").select("conv", at(0).alias("call_id"), "turn", "name", F.to_json(F.struct("turn", "text")).alias("arguments"), F.array(at(1), at(2)).alias("after"))
    results = c.filter(tool.isNull()).select("conv", at(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    calls, results = turns_as_tools(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_tools(calls, results, TURN_TOOLS).withColumnRenamed("conv", "conv_id")
