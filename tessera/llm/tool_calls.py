"""Tool-call linking: calls meet their results by identifier, stand in topological order, have
their arguments checked against schemas, and are written as canonical JSON.

Order comes from depth (how many calls a call builds on, one after the other), found by pointer
doubling: a chain of n calls takes log2(n) joins, and no conversation has to fit in one task.
Sorted by conversation, depth, turn and id, each call stands after all that it builds on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import isfinite

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import erase, table, written

SURROGATES = re.compile("[\ud800-\udfff]").sub
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Schemas of the tools that op10 derives.
TOOLS = {
    "search": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 0, "maximum": 44}, "exact": {"type": "boolean"}},
    },
    "note": {
        "type": "object", "required": ["text", "tags"],
        "properties": {"text": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}},
    },
}

def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where value breaks schema: type, enum, bounds, lengths, required, properties and items of JSON Schema."""
    kind = schema.get("type")
    if kind is not None:
        fits = isinstance(value, KINDS[kind]) and not (kind in ("integer", "number") and isinstance(value, bool))
        if not fits and not (kind == "integer" and isinstance(value, float) and value.is_integer()):
            return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: below minimum"] * (value < schema.get("minimum", value))
        found += [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        found += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0))
        found += [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    return found


def canonical(value) -> str:
    """Sorted keys, no blanks, characters as they are; halves of surrogate pairs, which UTF-8 has not, escaped."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def escaped(text: str) -> str:
    return SURROGATES(lambda m: f"\\u{ord(m[0]):04x}", text)


def parsed(text: str):
    """The JSON value of a text. NaN, infinities and numbers beyond the doubles are none (ValueError)."""
    def refuse(x: str):
        raise ValueError(f"{x} is not JSON")

    def number(x: str) -> float:
        return float(x) if isfinite(float(x)) else refuse(x)

    return json.loads(text, parse_constant=refuse, parse_float=number)


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 0 for a call that builds on none; null on a cycle or above one.

    calls: conv_id, call_id, parent, which is one id or an array of ids; the depth is that of the
    longest chain. A parent that is no call of the conversation counts as none.

    A call with one parent points to it; pointers double until they reach a call with none, or
    with several. What is left is a graph of the calls with several parents, whose depths settle
    from below, one generation a round. Both end when a round settles nothing more, or when no
    chain without a cycle could be longer.
    """
    many = calls.schema["parent"].dataType.typeName() == "array"
    ids = calls.where("call_id IS NOT NULL").select("conv_id", "call_id", F.explode_outer("parent").alias("parent") if many else "parent").distinct()
    known = ids.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k")).distinct()
    on = (F.col("parent") == F.col("k")) & F.col("conv_id").eqNullSafe(F.col("c"))
    edges = ids.join(known, on, "left").groupBy("conv_id", "call_id").agg(F.collect_set("k").alias("ups"))
    edges = written(edges, "calls")
    # A call's own entry: where it points (null at a root or at a call with several parents), how far away, and where that way ends.
    state = edges.select(
        "conv_id", "call_id", F.when(F.size("ups") == 1, F.col("ups")[0]).alias("up"), (F.size("ups") == 1).cast("long").alias("depth"), F.col("call_id").alias("end")
    )
    state = written(state.withColumn("end", F.coalesce("up", "end")), "depth")
    longest = state.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("end").alias("last"))
        on = (F.col("up") == F.col("k")) & F.col("conv_id").eqNullSafe(F.col("c"))
        before, state = state, written(
            state.join(above, on, "left").select(
                "conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("last", "end").alias("end")
            ),
            "depth",
        )
        erase(before)
    forks = edges.where("size(ups) > 1").select("conv_id", "call_id", F.explode("ups").alias("parent"))
    if forks.isEmpty():
        return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    return _forked(state, forks)


def _forked(state: DataFrame, forks: DataFrame) -> DataFrame:
    """Depths where calls have several parents: state (up null where the way ends at a root or a fork), forks (call, parent)."""
    ways = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.when(F.col("up").isNull(), F.col("end")).alias("to"), F.col("depth").alias("far"))
    here = forks.select("conv_id", "call_id").distinct()
    on = (F.col("parent") == F.col("k")) & F.col("conv_id").eqNullSafe(F.col("c"))
    # to: the fork or root where the way over a parent ends; null on a cycle.
    legs = written(forks.join(ways, on).select("conv_id", "call_id", "to", (F.col("far") + 1).alias("far")), "legs")
    roots = state.where("up IS NULL AND depth = 0").join(here, ["conv_id", "call_id"], "left_anti")
    at = (F.col("to") == F.col("dk")) & F.col("conv_id").eqNullSafe(F.col("dc"))
    done = written(roots.select("conv_id", "call_id", F.lit(0).cast("long").alias("depth")), "settled")
    n, left = -1, legs.select("conv_id", "call_id").distinct().count()
    while left and n != left:
        n = left
        base = done.select(F.col("conv_id").alias("dc"), F.col("call_id").alias("dk"), F.col("depth").alias("base"))
        new = (
            legs.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(base, at, "left")
            .groupBy("conv_id", "call_id").agg(F.max(F.col("base") + F.col("far")).alias("depth"), F.bool_and(F.col("base").isNotNull()).alias("all"))
            .where("all").select("conv_id", "call_id", "depth")
        )
        before, done = done, written(done.union(new), "settled")
        erase(before)
        left = legs.select("conv_id", "call_id").distinct().join(done, ["conv_id", "call_id"], "left_anti").count()
    ends = done.select(F.col("conv_id").alias("dc"), F.col("call_id").alias("dk"), F.col("depth").alias("base"))
    to = F.when(F.col("up").isNull(), F.col("end"))
    return state.join(ends, (to == F.col("dk")) & F.col("conv_id").eqNullSafe(F.col("dc")), "left").select(
        "conv_id", "call_id", (F.col("depth") + F.col("base")).alias("depth")
    )


def checked(text: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """The value of a call's arguments, and what is wrong with it (then the value is null if it is no JSON)."""
    if text is None:
        return None, ["not JSON"]
    try:
        value = parsed(text)
        canonical(value)  # nested too deep to be written again is no value either
    except (ValueError, RecursionError):
        return None, ["not JSON"]
    return value, ["unknown tool"] if schema is None else [escaped(x) for x in violations(value, schema)]


def link(calls: DataFrame, results: DataFrame, schemas: dict = TOOLS) -> DataFrame:
    """One row per call and per result that answers none.

    calls: conv_id, turn, call_id, name, arguments (JSON), parent (an id, or an array of ids);
    results: conv_id, turn, call_id, content. status: answered, unanswered, orphan (a result without a call) or cyclic. Of several
    results the earliest is taken (by turn, then content) and all are counted; a call id that
    occurs again in a conversation is one call each time, with the same result and the parents of all; null call ids link
    to nothing; null or broken arguments are violations, and so are NaN and numbers beyond the
    doubles, which JSON has not; halves of surrogate pairs are written as escapes; empty tables
    give no rows; further columns are ignored. valid, violations and canonical come from a small helper per row.
    """
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments", "parent")
    first = (
        results.where("call_id IS NOT NULL").groupBy("conv_id", "call_id")
        .agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "content")).alias("first"))
        .select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rk"), "n_results", F.col("first.turn").alias("result_turn"), F.col("first.content").alias("result"))
    )
    d = depths(c).select(F.col("conv_id").alias("dc"), F.col("call_id").alias("dk"), "depth")
    answered = c.join(d, (F.col("call_id") == F.col("dk")) & F.col("conv_id").eqNullSafe(F.col("dc")), "left").join(
        first, (F.col("call_id") == F.col("rk")) & F.col("conv_id").eqNullSafe(F.col("rc")), "left"
    )
    status = (
        F.when(F.col("depth").isNull() & F.col("call_id").isNotNull(), "cyclic")
        .when(F.col("result_turn").isNotNull() | F.col("n_results").isNotNull(), "answered")
        .otherwise("unanswered")
    )
    columns = ["conv_id", "turn", "call_id", "name", "arguments", "depth", "status", "n_results", "result_turn", "result"]
    linked = answered.withColumn("status", status).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    asked = c.select(F.col("conv_id").alias("ac"), F.col("call_id").alias("ak"))
    orphans = results.join(asked, (F.col("call_id") == F.col("ak")) & F.col("conv_id").eqNullSafe(F.col("ac")), "left_anti").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(None).cast("long").alias("depth"), F.lit("orphan").alias("status"), F.lit(1).cast("long").alias("n_results"),
        F.col("turn").alias("result_turn"), F.col("content").alias("result"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "call_id", "name", "depth", "status", "n_results", "result_turn", "valid", "violations", "canonical"]
        for b in batches:
            valid, broken, texts = [], [], []
            for r in b.to_pylist():
                if r["status"] == "orphan":
                    arguments, found = None, ["no call"]
                else:
                    arguments, found = checked(r["arguments"], schemas.get(r["name"]))
                valid.append(not found)
                broken.append(found)
                texts.append(canonical({"arguments": arguments, "depth": r["depth"], "id": r["call_id"], "name": r["name"], "result": r["result"], "status": r["status"]}))
            kept = [b.column(b.schema.get_field_index(n)) for n in names[:8]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(valid, pa.bool_()), pa.array(broken, pa.list_(pa.string())), pa.array(texts, pa.string())], names)

    both = linked.select(*columns).union(orphans.select(*columns)).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments",
        F.col("depth").cast("long").alias("depth"), "status", F.col("n_results").cast("long").alias("n_results"), F.col("result_turn").cast("long").alias("result_turn"), "result",
    )
    return both.mapInArrow(
        run,
        "conv_id long, turn long, call_id string, name string, depth long, status string, n_results long, result_turn long, "
        "valid boolean, violations array<string>, canonical string",
    )


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of conversations stand for, each with the whole text of its turn.

    An assistant's turn is a call; two in three build on the call two turns before. A user's turn
    is the result of the call before it, and one in eleven names a call that does not exist.
    """
    n = F.length(F.coalesce("text", F.lit("")))

    def name(turn: F.Column) -> F.Column:
        return F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    search = F.to_json(F.struct((n % 50).alias("limit"), F.col("text").alias("query"), (n % 2 == 0).alias("exact")))
    note = F.to_json(F.struct(F.array(F.col("role")).alias("tags"), F.col("text")))
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"),
        F.when(n % 3 == 0, "note").otherwise("search").alias("name"),
        F.when(n % 3 == 0, note).otherwise(search).alias("arguments"),
        F.when(n % 3 != 1, name(F.col("turn") - 2)).alias("parent"),
    )
    results = conversations.where("role = 'user' AND turn > 0").select(
        "conv_id", "turn", F.when(n % 11 == 0, F.lit("call-none")).otherwise(name(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def op10(spark, sf_dir: str) -> DataFrame:
    calls, results = calls_of(table(spark, sf_dir, "conversations"))
    return link(calls, results)
