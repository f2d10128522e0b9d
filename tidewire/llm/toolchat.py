"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

DataFrame operations only. One row a call, so a conversation of any length stays spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, save, table

#: tool -> field -> (JSON type, required); types: string, integer, number, boolean, array, object
Schemas = dict[str, dict[str, tuple[str, bool]]]

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def canonical(json: Column) -> Column:
    """JSON text with object keys sorted at every level and no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def read_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text).

    An assistant's text {"tool_calls": [{"id", "name", "arguments"}]} holds calls, a tool's text
    {"tool_call_id", "content"} a result; any other text holds none.
    """
    got = messages.where((F.col("role") == "assistant") & F.col("text").contains("tool_calls"))
    calls = got.select("conv_id", "turn", F.posexplode(F.from_json("text", _CALLS)["tool_calls"]).alias("pos", "c")).select(
        "conv_id", "turn", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    results = messages.where(F.col("role") == "tool").select("conv_id", "turn", F.from_json("text", _RESULT).alias("r")).select(
        "conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    return calls, results.where(F.col("call_id").isNotNull())


def _chains(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, far) of calls with one reference (conv_id, call_id, end): where the chain of such calls ends, and
    how many references away. Chains that run into a cycle are left out. Each round doubles the part of a chain that is known."""
    at = save(single.withColumn("far", F.lit(1).cast("long")), "chains")
    for _ in range(at.count().bit_length() + 1):
        ahead = at.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("end2"), F.col("far").alias("far2"))
        nxt = save(at.join(ahead, ["conv_id", "end"], "left").select("conv_id", "call_id", F.coalesce("end2", "end").alias("end"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("end2").isNotNull().alias("moved")), "chains")
        remove(at)
        at = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return at
    return at.join(single.select("conv_id", F.col("call_id").alias("end")), ["conv_id", "end"], "left_anti")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls: 0 without references, else one more than the highest referenced call.

    Calls on a cycle of references, or behind one, are left out. Chains of calls with one reference each are followed by
    doubling. Calls with several take a round a level among themselves, in which those settle whose references are settled.
    Rounds are written tables.
    """
    key = ["conv_id", "call_id"]
    left = save(edges.select("conv_id", "call_id", "dep").distinct(), "references")
    degree = save(left.groupBy(*key).agg(F.count("*").alias("n"), F.min("dep").alias("end")), "degrees")
    chains = _chains(degree.where("n = 1").select(*key, "end"))
    # references of calls with several, led to where their chains end; one that leads into a cycle keeps its call from settling
    several = left.join(degree.where("n > 1").select(key), key, "left_semi")
    single = degree.where("n = 1").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("single"))
    led = several.join(single, ["conv_id", "dep"], "left").join(chains.select("conv_id", F.col("call_id").alias("dep"), "end", "far"), ["conv_id", "dep"], "left")
    led = led.select(*key, F.when(F.col("single"), F.col("end")).otherwise(F.col("dep")).alias("end"), F.coalesce("far", F.lit(0).cast("long")).alias("far"))
    wait = save(led, "references")
    remove(left)
    done = [save(nodes.select(key).join(degree, key, "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")]
    best = wait.select(*key, F.col("far").alias("level")).limit(0)
    while True:
        settled = done[-1].select("conv_id", F.col("call_id").alias("end"), "level")
        met = wait.join(settled, ["conv_id", "end"]).select(*key, (F.col("level") + F.col("far") + 1).alias("level"))
        rest = save(wait.join(settled, ["conv_id", "end"], "left_anti"), "references")
        best = save(best.unionByName(met).groupBy(*key).agg(F.max("level").alias("level")), "levels")
        front = save(best.join(rest, key, "left_anti"), "levels")
        remove(wait)
        wait = rest
        if front.isEmpty():
            break
        done.append(front)
        best = best.join(front.select(key), key, "left_anti")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ends = out.select("conv_id", F.col("call_id").alias("end"), "level")
    return out.unionByName(chains.join(ends, ["conv_id", "end"]).select(*key, (F.col("level") + F.col("far")).alias("level")))


def _problems(name: Column, args: Column, schemas: Schemas) -> Column:
    """Sorted names of what is wrong: not JSON, unknown tool, missing or unknown fields, wrong types."""
    v = F.try_parse_json(args)
    out = F.when(name.isNull() | ~name.isin(list(schemas)), F.array(F.lit("unknown tool"))).otherwise(F.array())
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            path = f"$['{field}']"
            found = F.schema_of_variant(F.variant_get(v, path, "variant"))
            wrong = F.when(found.isNull() | (found == "VOID"), F.lit(f"missing {field}") if required else F.lit(None)).when(~found.rlike(_TYPES[kind]), F.lit(f"type of {field}"))
            checks.append(wrong)
        extra = F.when(F.size(F.array_except(F.coalesce(F.json_object_keys(args), F.array()), F.array(*[F.lit(f) for f in fields], F.lit("$ref")))) > 0, F.lit("unknown field"))
        out = F.when(name == tool, F.array_compact(F.array(*checks, extra))).otherwise(out)
    return F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("arguments"))).otherwise(F.array_sort(out))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row a call: conv_id, turn, call_id, level, n_results, problems (joined by ", "), record (canonical JSON).

    Calls meet results by (conv_id, call_id). Of results of one call the earliest counts (smaller text on a tie);
    of calls with one id the earliest is linked and the others, equal ones too, have the problem "repeated id". References
    are the string "$ref" of the arguments or the strings in an array of that name; anything else there is the problem
    "references". One that no call bears is "dangling reference", one on a cycle "cycle" (level null). Calls without an id are not linked ("no id"). A null
    conversation is a conversation of its own. level, then turn, is a topological order within a conversation.
    Results without a call are dropped.
    """
    # a key of text that tells null from the empty conversation
    conv = lambda d: d.withColumn("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))
    calls, results = conv(calls.select("conv_id", "turn", "pos", "call_id", "name", "arguments")), conv(results.select("conv_id", "turn", "call_id", "content"))
    order = F.struct("turn", "pos", "name", "arguments")
    # equal calls are counted first, so a call repeated any number of times meets the first of its id as one row
    equal = calls.where("call_id is not null").groupBy("conv_id", "call_id", "turn", "pos", "name", "arguments").agg(F.count("*").alias("copies"))
    first = equal.groupBy("conv_id", "call_id").agg(F.min(order).alias("first"), F.sum("copies").alias("n"))
    heads = save(first.select("conv_id", "call_id", "first.*"), "calls")
    more = equal.join(first.where("n > 1").select("conv_id", "call_id", "first"), ["conv_id", "call_id"])
    left = F.col("copies") - F.when(order.eqNullSafe(F.col("first")), 1).otherwise(0)
    others = more.withColumn("copy", F.explode(F.array_repeat(F.lit(0), left.cast("int")))).drop("first", "copies", "copy")
    odd = others.withColumn("why", F.lit("repeated id")).unionByName(calls.where("call_id is null").withColumn("why", F.lit("no id")))
    found = F.try_variant_get(F.try_parse_json("arguments"), "$['$ref']", "variant")
    kind = F.schema_of_variant(found)
    refs = F.when(kind == "STRING", F.array(found.cast("string"))).when(kind == "ARRAY<STRING>", F.try_variant_get(found, "$", "array<string>"))
    odd_refs = kind.isNotNull() & ~kind.isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    edges = save(heads.select("conv_id", "call_id", F.explode(F.array_distinct(refs)).alias("dep")).where("dep is not null"), "references")
    known = edges.join(heads.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi")
    dangling = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_refs")).join(known.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_known")), ["conv_id", "call_id"], "left")
    dangling = dangling.select("conv_id", "call_id", (F.col("n_refs") > F.coalesce("n_known", F.lit(0))).alias("dangling"))
    best = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    key = ["conv_id", "call_id"]
    joined = heads.join(best.hint("shuffle_hash"), key, "left").join(levels(heads, known), key, "left").join(dangling, key, "left").withColumn("why", F.lit(None).cast("string"))
    joined = joined.unionByName(odd, allowMissingColumns=True)
    problems = F.array_compact(F.concat(
        F.array("why", F.when(F.col("dangling"), F.lit("dangling reference")), F.when(odd_refs, F.lit("references")), F.when(F.col("why").isNull() & F.col("level").isNull(), F.lit("cycle")), F.when(F.col("why").isNull() & F.col("r").isNull(), F.lit("no result"))),
        _problems(F.col("name"), F.col("arguments"), schemas)))
    record = F.to_json(F.struct(
        F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")).alias("arguments"), F.col("call_id").alias("id"), F.col("level"), "name", F.col("r.content").alias("result")))
    shown = F.when(F.col("conv_id") != "-", F.substring("conv_id", 2, 2**31 - 1)).alias("conv_id")
    return joined.select(shown, "turn", "call_id", "level", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), F.array_join(problems, ", ").alias("problems"), record.alias("record"))


#: What the query takes turns for: a user's turn is a call, the assistant's next turn its result.
QUERY_SCHEMAS: Schemas = {"ask": {"text": ("string", True), "turn": ("integer", True)}, "follow": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)}}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain turns: every user's turn calls a tool, "follow" with a reference to the call two
    turns before unless the turn is the first or second of eight, and the turn after it is its result."""
    mine = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    later = F.col("turn") % 8 >= 2
    name = F.when(later, F.lit("follow")).otherwise(F.lit("ask"))
    ref = F.when(later, F.array(F.concat_ws("-", F.col("conv_id"), F.col("turn") - 2)))
    args = F.to_json(F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("text"), ref.alias("$ref")))
    calls = conversations.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("pos"), mine.alias("call_id"), name.alias("name"), args.alias("arguments"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op8_toolchat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    return link(calls, results, QUERY_SCHEMAS)


SQL = {
    "op8_toolchat": """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id::VARCHAR || '-' || turn AS call_id, turn % 8 >= 2 AS later, coalesce(text, '') AS text
  FROM conversations WHERE role = 'user'),
refs AS (
  SELECT a.conv_id, a.turn, b.turn AS dep FROM calls a LEFT JOIN calls b ON a.later AND b.conv_id = a.conv_id AND b.turn = a.turn - 2),
lev(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM refs WHERE dep IS NULL
  UNION ALL SELECT r.conv_id, r.turn, l.level + 1 FROM refs r JOIN lev l ON r.conv_id = l.conv_id AND r.dep = l.turn),
res AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT c.conv_id::VARCHAR AS conv_id, c.turn, c.call_id, l.level, coalesce(r.n, 0) AS n_results,
  concat_ws(', ', CASE WHEN c.later AND d.dep IS NULL THEN 'dangling reference' END, CASE WHEN r.n IS NULL THEN 'no result' END,
    CASE WHEN c.later THEN 'missing words' END) AS problems,
  '{"arguments":{' || CASE WHEN c.later THEN '"$ref":["' || c.conv_id || '-' || (c.turn - 2) || '"],' ELSE '' END
    || '"text":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '},"id":"' || c.call_id || '","level":' || l.level
    || ',"name":"' || CASE WHEN c.later THEN 'follow' ELSE 'ask' END || '"'
    || CASE WHEN r.content IS NULL THEN '' ELSE ',"result":' || to_json(r.content)::VARCHAR END || '}' AS record
FROM calls c JOIN lev l USING (conv_id, turn) JOIN refs d USING (conv_id, turn) LEFT JOIN res r USING (conv_id, turn)
"""
}
QUERIES = {"op8_toolchat": op8_toolchat}
