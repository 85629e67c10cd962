"""Tool-call linking: calls and results are joined by identifier, ordered by what they
depend on, validated against their tools' schemas and written as canonical JSON.

``parse`` reads calls and results from conversations: an assistant's text that is a JSON
object with ``tool_calls`` (id, name, arguments) holds calls, a tool's text that is one
with ``tool_call_id`` and ``content`` holds a result. Plain turns are linked the same
way: a user's text is a call of the tool ``reply`` and the assistant's text of the next
turn its result, under the identifier conversation:turn.

``link`` hash-joins the two. A call depends on each call whose id its arguments name in
an object {"$ref": id}; ``level`` is the length of its longest chain of dependencies,
found level by level over all conversations at once, and (level, turn, call_id) is the
order. A round writes only the dependencies that are still open, so conversations drop
out once they are settled. No conversation is gathered in one task.

Defined results: calls that repeat an id in a conversation are ``duplicate`` but the
first (by turn, then text, then name), results that do so are ``duplicate_result``; a call without a result is
``open``, a result without a call ``orphan``; calls in a cycle, or behind one, have a
null level and are ``cycle``. A call without an id is called ``no-id:turn:place``, a
result without one ``no-id:turn``; ids and names that are no strings stand as JSON. JSON
that nests deeper than MAX_DEPTH, or holds a number that JSON or a double does not have,
is plain text; a lone surrogate is written as its escape. Turns of other roles (system
ones too), or without a role, and a tool's plain texts give no row. Null conversations
are one conversation, null texts empty. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import arrow_step, cut, slices

#: Schema of each known tool's arguments (a subset of JSON Schema: type, required, properties, additionalProperties, enum, items, minLength, minimum).
SCHEMAS = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}

NO_CONVERSATION = -(1 << 63)
#: Levels of objects and lists in a text that is read as JSON.
MAX_DEPTH = 100
_SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; equal values give equal texts."""
    return _encodable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _encodable(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 has no bytes for, as escapes."""
    return text if text.isascii() else _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _is(value, kind: str) -> bool:
    """Whether a JSON value is of a type; a whole number is an integer however it is written, and true and false are no numbers."""
    if kind in ("number", "integer"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, object))


def _same(a, b) -> bool:
    """Equality of JSON values: 1 equals 1.0, and neither equals true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``; its type may be a list of types, any of which will do."""
    kind, out = schema.get("type"), []
    kinds = kind if isinstance(kind, list) else [] if kind is None else [kind]
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(map(str, kinds))}"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not among the allowed values")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if isinstance(value, int | float) and not isinstance(value, bool) and value < schema.get("minimum", value):
        out.append(f"{at}: too small")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


def references(value) -> list[str]:
    """Ids that ``value`` names as {"$ref": id}."""
    if isinstance(value, dict):
        if isinstance(value.get("$ref"), str):
            return [value["$ref"]]
        return [r for v in value.values() for r in references(v)]
    if isinstance(value, list):
        return [r for v in value for r in references(v)]
    return []


def _finite(number: str) -> float:
    if not math.isfinite(value := float(number)):
        raise ValueError("no double holds this number")
    return value


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def _object(text: str) -> dict | None:
    """The JSON object that ``text`` is, if it is one."""
    if not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    level = [value]
    for _ in range(MAX_DEPTH):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, dict | list)]
        if not level:
            return value
    return None


def _name(value, missing: str) -> str:
    """An identifier as text."""
    return missing if value is None else _encodable(value) if isinstance(value, str) else canonical(value)


def parse(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """kind (call or result), conv, turn, call_id, name, payload (canonical JSON), problems and refs of each call and result."""
    known = SCHEMAS if schemas is None else schemas
    kind = "kind string, conv long, turn long, call_id string, name string, payload string, problems array<string>, refs array<string>"
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def call(conv, turn, call_id, name, arguments):
        if isinstance(arguments, str) and (parsed := _object(arguments)) is not None:
            arguments = parsed
        problems = violations(arguments, known[name]) if name in known else ["$: unknown tool"]
        return ("call", conv, turn, call_id, name, canonical(arguments), [*map(_encodable, problems)], sorted({*map(_encodable, references(arguments))}))

    def read(conv, turn, role, text):
        value = _object(text)
        if role == "assistant" and value and isinstance(value.get("tool_calls"), list):
            for i, c in enumerate(value["tool_calls"]):
                if isinstance(c, dict):
                    yield call(conv, turn, _name(c.get("id"), f"no-id:{turn}:{i}"), _name(c.get("name"), ""), c.get("arguments"))
        elif role == "tool" and value and "tool_call_id" in value:
            yield ("result", conv, turn, _name(value["tool_call_id"], f"no-id:{turn}"), None, canonical(value.get("content")), [], [])
        elif role == "user":
            yield call(conv, turn, f"{conv}:{turn}", "reply", {"text": text})
        elif role == "assistant":
            yield ("result", conv, turn, f"{conv}:{(turn or 0) - 1}", None, canonical(text), [], [])

    def run(batches):
        for batch in slices(batches):
            rows = [r for x in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text")), strict=True) for r in read(*x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in kind.split(", ")])

    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return arrow_step(turns, run, kind)


def levels(calls: DataFrame) -> DataFrame:
    """conv, call_id and level of each first call; calls in or behind a cycle are missing. Round n settles the calls of level n: those whose last dependency the round before settled."""
    edges = calls.select("conv", "call_id", F.explode("refs").alias("needs"))
    # A dependency on a call that is not there binds nothing.
    edges = cut(edges.join(calls.select("conv", F.col("call_id").alias("needs")), ["conv", "needs"]).distinct())
    if edges.isEmpty():
        return calls.select("conv", "call_id", F.lit(0).alias("level"))
    key = ["conv", "call_id"]
    settled = cut(calls.select(*key).join(edges.select(*key), key, "left_anti"))
    out, level = settled.withColumn("level", F.lit(0)), 0
    while not settled.isEmpty():
        # What is no longer open is not written again.
        still = cut(edges.join(settled.select("conv", F.col("call_id").alias("needs")), ["conv", "needs"], "left_anti"))
        settled, edges, level = cut(edges.select(*key).distinct().join(still.select(*key), key, "left_anti")), still, level + 1
        out = out.unionByName(settled.withColumn("level", F.lit(level)))
    return out


def link(parsed: DataFrame) -> DataFrame:
    """A row for each call and each orphan or repeated result of ``parsed``: conv_id, call_id, name, turn, result_turn, level, status, valid, problems and canonical."""
    parsed = cut(parsed)
    order = F.struct(F.col("turn").isNull().alias("none"), "turn", "payload", "name")
    key = ["kind", "conv", "call_id"]
    # The first of each id: an aggregate, then rows that equal it are counted, so equal rows are told apart too.
    counted = parsed.groupBy(*key, "turn", "payload", "name").agg(F.count("*").alias("n"), F.first("problems").alias("problems"), F.first("refs").alias("refs"))
    first = counted.groupBy(*key).agg(F.min(order).alias("first"))
    rows = counted.join(first, key).select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    is_first = (F.col("copy") == 1) & F.col("turn").eqNullSafe(F.col("first.turn")) & (F.col("payload") == F.col("first.payload")) & F.col("name").eqNullSafe(F.col("first.name"))
    rows = rows.withColumn("repeat", ~is_first)
    calls, results = rows.filter("kind = 'call'"), rows.filter("kind = 'result'")
    firsts = calls.filter("not repeat")
    level = levels(firsts.select("conv", "call_id", "refs"))
    answer = results.filter("not repeat").select("conv", "call_id", F.col("turn").alias("result_turn"), F.col("payload").alias("result"), F.lit(True).alias("answered"))
    linked = firsts.join(level, ["conv", "call_id"], "left").join(answer, ["conv", "call_id"], "left")
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("answered"), "linked").otherwise("open")
    conv_id = F.when(F.col("conv") != NO_CONVERSATION, F.col("conv")).alias("conv_id")
    whole = F.concat(
        F.lit('{"arguments":'), "payload", F.lit(',"id":'), F.to_json(F.array("call_id")).substr(F.lit(2), F.length(F.to_json(F.array("call_id"))) - 2),
        F.lit(',"name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}"),
    )
    out = [conv_id, "call_id", "name", "turn", "result_turn", "level", "status", "valid", "problems", "canonical"]
    none = lambda kind: F.lit(None).cast(kind)
    valid = F.size("problems") == 0
    first_rows = linked.withColumns({"status": status, "valid": valid, "canonical": whole}).select(*out)
    repeated = calls.filter("repeat").withColumns({"result_turn": none("long"), "result": none("string"), "level": none("int"), "status": F.lit("duplicate"), "valid": valid}).withColumn("canonical", whole).select(*out)
    alone = results.join(firsts.select("conv", "call_id", F.lit(True).alias("called")), ["conv", "call_id"], "left").filter("repeat or called is null")
    lost = alone.select(conv_id, "call_id", "name", none("long").alias("turn"), F.col("turn").alias("result_turn"), none("int").alias("level"), F.when(F.col("repeat"), "duplicate_result").otherwise("orphan").alias("status"), F.lit(False).alias("valid"), "problems", F.col("payload").alias("canonical"))
    return first_rows.unionByName(repeated).unionByName(lost)


def tool_links(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """``link`` over the calls and results of ``conversations``; ``schemas`` by tool (None: SCHEMAS)."""
    return link(parse(conversations, schemas))


#: DuckDB's form for tables whose texts are plain turns and hold each turn once.
PLAIN_TURNS_SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT * FROM t WHERE role = 'user'), r AS (SELECT * FROM t WHERE role = 'assistant')
SELECT c.conv_id, c.conv_id || ':' || c.turn AS call_id, 'reply' AS name, c.turn, r.turn AS result_turn, 0 AS level, CASE WHEN r.turn IS NULL THEN 'open' ELSE 'linked' END AS status, c.text <> '' AS valid,
  CASE WHEN c.text = '' THEN '$.text: too short' ELSE '' END AS problems,
  '{"arguments":{"text":' || CAST(to_json(c.text) AS VARCHAR) || '},"id":"' || c.conv_id || ':' || c.turn || '","name":"reply","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS canonical
FROM c LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.turn = c.turn + 1
UNION ALL SELECT r.conv_id, r.conv_id || ':' || (r.turn - 1), NULL, NULL, r.turn, NULL, 'orphan', FALSE, '', CAST(to_json(r.text) AS VARCHAR)
FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.turn = r.turn - 1)"""
