"""Chat formatting: tool calls linked to their results.

Calls and results are joined by conversation and identifier, ordered topologically, their arguments validated
against schemas and each pair serialised as canonical JSON (keys sorted by code point, no spaces, no
escapes beyond those JSON needs, no NaN).

A call may name calls that it comes after. Where every call stands after those, its place in the
conversation is a topological order already and ``depth`` is 0; in conversations with a reference forward every call gets the length
of the longest chain of calls before it. Such a conversation of at most MOST_EDGES references is ordered whole in one task; the
references of a larger one stay spread, and each depth costs a round of joins. Both ways give the same. Calls that are
on a cycle, or between two, have the status ``cycle``, and those that merely come after one ``after_cycle``; both have depth
-1. (depth, turn, place) orders a conversation.

Status: ok, missing_result, early_result (the result stands before the call), orphan_result (no such call),
unknown_tool, bad_arguments (with ``fault``), cycle, after_cycle. Of repeated calls or results of one identifier the first, by
turn, place and content, counts and ``repeats`` has the number of the others. Rows without a conversation or
identifier are left out. Null arguments are {}; null content is null. Arguments that are no JSON, or nested too deep to be read, stay
text. Lone surrogates, which UTF-8 cannot hold, are written as JSON escapes. No group is gathered beyond MOST_EDGES references: rows of
a conversation are only ever hash-joined by identifier or summed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.common import bound_arrow, stored, table, tidy

#: References between the calls of a conversation that is ordered in one task.
MOST_EDGES = 100_000
SURROGATE = re.compile("[\ud800-\udfff]")

CALLS = "conv_id long, turn long, place int, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
MESSAGE = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string, content string"


def storable(text: str) -> str:
    """The text with lone surrogates as JSON escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    return storable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


_KINDS = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def fault(value, schema: dict, at: str = "$") -> str | None:
    """The first violation of a JSON schema's type, enum, bounds, required, properties, additionalProperties or items."""
    kinds = schema.get("type")
    if kinds is not None:

        def is_a(kind: str) -> bool:
            if kind in ("integer", "number"):
                return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
            return isinstance(value, _KINDS[kind])

        if not any(map(is_a, [kinds] if isinstance(kinds, str) else kinds)):
            return f"{at}: not {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of bounds"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at}: length"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in own:
                if found := fault(value[name], own[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from messages (conv_id, turn, role, text) whose text is JSON; other texts have neither."""
    rows = messages.select("conv_id", "turn", "role", F.from_json("text", MESSAGE).alias("m"))
    calls = rows.where("role = 'assistant'").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("place", "c")).select("conv_id", "turn", "place", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after")
    results = rows.where("role = 'tool' and m.tool_call_id is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    return calls, results


def depths(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Longest chain of calls before each call of (call, call before it); -1 on or between cycles, -2 after one."""
    before: dict[str, set[str]] = {}
    behind: dict[str, set[str]] = {}
    for call, to in edges:
        before.setdefault(call, set()).add(to)
        before.setdefault(to, set())
        behind.setdefault(to, set()).add(call)
    waits = {call: len(to) for call, to in before.items()}
    out: dict[str, int] = {}
    ready, level = [c for c, n in waits.items() if not n], 0
    while ready:
        later = []
        for c in ready:
            out[c] = level
            for x in behind.get(c, ()):
                waits[x] -= 1
                if not waits[x]:
                    later.append(x)
        ready, level = later, level + 1
    left = before.keys() - out.keys()
    # nothing that is left comes after these
    needed = {c: len(behind.get(c, set()) & left) for c in left}
    ready = [c for c, n in needed.items() if not n]
    while ready:
        c = ready.pop()
        out[c] = -2
        for x in before[c] & left:
            needed[x] -= 1
            if not needed[x]:
                ready.append(x)
    return dict.fromkeys(left, -1) | out


def _depths(calls: DataFrame, most: int) -> DataFrame:
    """(conv_id, call_id, depth) of the calls of conversations with a reference forward, if they take part in any."""
    edges = calls.select("conv_id", "call_id", "turn", "place", F.explode(F.array_distinct("after")).alias("to"))
    ends = calls.select("conv_id", F.col("call_id").alias("to"), F.col("turn").alias("to_turn"), F.col("place").alias("to_place"))
    known = edges.join(ends.hint("shuffle_hash"), ["conv_id", "to"])
    forward = (F.col("to_turn") > F.col("turn")) | ((F.col("to_turn") == F.col("turn")) & (F.col("to_place") >= F.col("place")))
    own = stored(known.select("conv_id", "call_id", "to", forward.alias("forward")), "call-edges")
    sizes = own.groupBy("conv_id").agg(F.max("forward").alias("tangled"), F.count("*").alias("n")).where("tangled")
    tangled = stored(sizes.select("conv_id", (F.col("n") <= most).alias("small")), "tangled")
    key = T.StructType([own.schema["conv_id"], own.schema["call_id"], T.StructField("depth", T.LongType())])
    ends_in = key.fieldNames()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        now, kind = None, None

        def close() -> pa.RecordBatch:
            found = depths(held)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(found), kind), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=ends_in)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, call, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != now:
                    yield close()
                    held = []
                now = conv
                held.append((call, to))
        if held:
            yield close()

    small = own.join(tangled.where("small"), "conv_id", "left_semi").select("conv_id", "call_id", "to")
    # conversations stand one behind another in a task; a task of groups would make a frame of each of these short lists
    out = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(tidy(order), key)
    if tangled.where("not small").isEmpty():
        return out
    return out.unionByName(_depths_by_rounds(stored(own.join(tangled.where("not small"), "conv_id", "left_semi").select("conv_id", "call_id", "to"), "call-edges")))


def _peel(own: DataFrame, left: DataFrame, by: str) -> tuple[list[DataFrame], DataFrame]:
    """Take the calls off ``left`` round by round that no edge from ``by`` holds; (what each round took, the rest)."""
    other = {"to": "call_id", "call_id": "to"}[by]
    done, n = [], left.count()
    while n:
        held = own.join(left.select("conv_id", F.col("call_id").alias(by)), ["conv_id", by], "left_semi").select("conv_id", F.col(other).alias("call_id")).distinct()
        rest = stored(left.join(held, ["conv_id", "call_id"], "left_semi"), "calls-left")
        m = rest.count()
        if m == n:
            break
        done.append(left.join(rest, ["conv_id", "call_id"], "left_anti"))
        left, n = rest, m
    return done, left


def _depths_by_rounds(own: DataFrame) -> DataFrame:
    """``depths`` of all conversations at once, a round of joins for each depth."""
    nodes = stored(own.select("conv_id", "call_id").union(own.select("conv_id", F.col("to"))).distinct(), "calls-left")
    levels, left = _peel(own, nodes, "to")
    after, cycle = _peel(own, left, "call_id")
    out = cycle.withColumn("depth", F.lit(-1).cast("long"))
    for part, depth in [*((x, i) for i, x in enumerate(levels)), *((x, -2) for x in after)]:
        out = out.unionByName(part.withColumn("depth", F.lit(depth).cast("long")))
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], most_edges: int = MOST_EDGES) -> DataFrame:
    """(conv_id, call_id, turn, place, depth, name, status, fault, repeats, json) of every call and orphan result."""
    bound_arrow(calls.sparkSession)
    schemas = {k: dict(v) for k, v in schemas.items()}
    one = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", "name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls"))
    first = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    flat = one.select("conv_id", "call_id", "c.*")
    depth = _depths(flat.select("conv_id", "call_id", "turn", "place", "after"), most_edges)
    # a hash join: after the sums each side has a row for each identifier, so no key is hot
    both = one.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "full").join(depth.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    rows = both.select("conv_id", "call_id", F.coalesce("c.turn", "r.turn").alias("turn"), F.coalesce("c.place", F.lit(0)).alias("place"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "c.name", "c.arguments", "r.content", F.col("r.turn").alias("result_turn"), F.col("c").isNotNull().alias("called"), F.col("r").isNotNull().alias("answered"), (F.coalesce("n_calls", F.lit(0)) - F.col("c").isNotNull().cast("long") + F.coalesce("n_results", F.lit(0)) - F.col("r").isNotNull().cast("long")).alias("repeats"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            status, why, text = [], [], []
            for r in frame.itertuples(index=False):
                found = None
                raw = r.arguments if isinstance(r.arguments, str) else "{}"
                try:
                    arguments = json.loads(raw, parse_constant=lambda x: float("nan"))
                    canonical(arguments)
                except ValueError:
                    arguments, found = raw, "$: not JSON"
                except RecursionError:
                    arguments, found = raw, "$: too deep"
                if not r.called:
                    kind = "orphan_result"
                elif r.depth < 0:
                    kind = "cycle" if r.depth == -1 else "after_cycle"
                elif r.name not in schemas:
                    kind = "unknown_tool"
                elif found := found or fault(arguments, schemas[r.name]):
                    kind = "bad_arguments"
                elif not r.answered:
                    kind = "missing_result"
                else:
                    kind = "early_result" if r.result_turn < r.turn else "ok"
                status.append(kind)
                why.append(storable(found) if kind == "bad_arguments" else None)
                body: dict = {"id": r.call_id}
                if r.called:
                    body |= {"name": r.name, "arguments": arguments}
                if r.answered:
                    body["result"] = r.content
                text.append(canonical(body))
            yield frame[["conv_id", "call_id", "turn", "place", "name"]].assign(depth=frame["depth"].clip(lower=-1), status=status, fault=why, repeats=frame["repeats"], json=text)

    kinds = "turn long, place int, depth long, name string, status string, fault string, repeats long, json string"
    return rows.mapInPandas(run, T.StructType([rows.schema["conv_id"], rows.schema["call_id"], *T._parse_datatype_string(kinds)]))


#: A user's turn as a call of this tool, and the next turn, if it is the assistant's, as its result.
REPLY = {"type": "object", "required": ["prompt"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 0}}}


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations' turns as calls of ``reply`` and their results.

    Of every three calls in a row, two turns apart, the first comes after the second and that after the third.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n]+"), lambda w: w != ""))
    body = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), count.alias("words")))
    after = F.when(F.floor(F.col("turn") / 2) % 3 < 2, F.array(name(F.col("turn") + 2))).otherwise(F.array().cast("array<string>"))
    calls = rows.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("place"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), body.alias("arguments"), after.alias("after"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every turn of the conversations: users' and assistants' as linked calls, others as messages of their own."""
    turns = table(spark, sf_dir, "conversations")
    done = link(*as_calls(turns), {"reply": REPLY}).select("conv_id", "call_id", "turn", "depth", "status", "repeats", "json")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    body = F.to_json(F.struct(F.col("text").alias("content"), key.alias("id"), "role"), {"ignoreNullFields": "false"})
    rest = turns.where("role is null or role not in ('user', 'assistant')")
    return done.unionByName(rest.select("conv_id", key.alias("call_id"), "turn", F.lit(0).cast("long").alias("depth"), F.lit("message").alias("status"), F.lit(0).cast("long").alias("repeats"), body.alias("json")))


SQL = r"""
WITH c AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, coalesce(text, '') AS prompt,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda w: w <> '')) AS words,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n
  FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text AS content,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n
  FROM conversations WHERE role = 'assistant'),
o AS (SELECT conv_id, turn FROM c WHERE k = 1),
x AS (SELECT a.conv_id, a.turn, CASE WHEN a.turn // 2 % 3 = 2 OR b.turn IS NULL THEN 0 WHEN a.turn // 2 % 3 = 1 OR d.turn IS NULL THEN 1 ELSE 2 END AS depth
  FROM o a LEFT JOIN o b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 LEFT JOIN o d ON d.conv_id = a.conv_id AND d.turn = a.turn + 4),
b AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn,
    c.conv_id IS NOT NULL AS called, r.conv_id IS NOT NULL AS answered, c.prompt, c.words, r.content,
    coalesce(c.n - 1, 0) + coalesce(r.n - 1, 0) AS repeats
  FROM (SELECT * FROM c WHERE k = 1) c FULL JOIN (SELECT * FROM r WHERE k = 1) r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT b.conv_id, call_id, b.turn, CAST(CASE WHEN called THEN x.depth ELSE 0 END AS BIGINT) AS depth,
  CASE WHEN NOT called THEN 'orphan_result' WHEN prompt = '' THEN 'bad_arguments' WHEN NOT answered THEN 'missing_result' ELSE 'ok' END AS status,
  CAST(repeats AS BIGINT) AS repeats,
  '{' || CASE WHEN called THEN '"arguments":{"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',"words":' || words || '},' ELSE '' END
  || '"id":' || CAST(to_json(call_id) AS VARCHAR) || CASE WHEN called THEN ',"name":"reply"' ELSE '' END
  || CASE WHEN answered THEN ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') ELSE '' END || '}' AS json
FROM b LEFT JOIN x ON x.conv_id = b.conv_id AND x.turn = b.turn
UNION ALL
SELECT conv_id, conv_id || '-' || turn, turn, 0, 'message', 0,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"id":' || CAST(to_json(conv_id || '-' || turn) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
