"""Schemas that drift between files: one consistent table and an ordered list of each change.

The schema of each file is read in parallel (one small row per file), folded by an aggregation through a
type-promotion lattice into the union schema, records are cast to it, and the ordered differences between
neighbouring files of a sink are logged.

Lattice: null < boolean < number < string; object and array promote to string (their JSON text) when they meet
anything else. Two names are one quantity if their words agree in order after dropping fillers, a word agreeing
with its abbreviation, and if no file holds both.

Edge cases: files without a complete record are passed over; null, blank and cut-off bodies have none; null tells
no type; equal written_at is resolved by file_id; null written_at comes first; null sinks form one sink; an empty
table gives empty results; extra columns are ignored. Only the distinct field names and types reach the driver.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.core.compaction import record_lines
from netweave.core.skew import ROWS_PER_CHUNK, add_chunks, lag_over_chunks
from netweave.functions.jsontext import parse, type_name
from netweave.session import cut, map_rows

#: Words that carry no meaning of their own in a field name.
FILLERS = {"is", "has", "was", "flag"}
PROMOTION = ["null", "boolean", "number", "string"]
CASTS = {"null": "string", "boolean": "boolean", "number": "double", "string": "string", "array": "string", "object": "string"}
_SCHEMA = "sink string, file_id long, written_at timestamp_ntz, n_records int, fields array<struct<name: string, first: string, last: string, inner: array<string>>>"


def _schemas(sinks: list, ids: list, times: list, bodies: list) -> Iterator[tuple]:
    for s, i, t, body in zip(sinks, ids, times, bodies):
        seen: dict[str, list[str]] = {}
        n = 0
        for line in (body or "").split("\n"):
            record = parse(line)
            if isinstance(record, dict):
                n += 1
                for name, value in record.items():
                    types, kind = seen.setdefault(name, []), type_name(value)
                    if kind != "null" and types[-1:] != [kind]:
                        types.append(kind)
        if n:
            yield s, i, t, n, [{"name": k, "first": v[0] if v else None, "last": v[-1] if v else None, "inner": v[1:]} for k, v in sorted(seen.items())]


def file_schemas(files: DataFrame) -> DataFrame:
    """One row per file that holds a complete record: its top-level fields with the types seen, in order."""
    return map_rows(files.select("sink", "file_id", F.col("written_at").cast("timestamp_ntz").alias("written_at"), "body"), _schemas, _SCHEMA)


def promote(types: list[str]) -> str:
    """The least type of the lattice above all given ones."""
    kinds = set(types) - {"null"}
    if len(kinds) <= 1:
        return next(iter(kinds), "null")
    return max(kinds, key=PROMOTION.index) if kinds <= set(PROMOTION) else "string"


def field_types(schemas: DataFrame) -> DataFrame:
    """field, the types seen, and the number of files; aggregated map-side, one row per field."""
    each = schemas.select(F.explode("fields").alias("f")).select(
        F.col("f.name").alias("field"), F.explode(F.array_union(F.array(F.coalesce("f.first", F.lit("null"))), "f.inner")).alias("kind"))
    return each.groupBy("field").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count("*").alias("n"))


def words(name: str) -> list[str]:
    parts = re.findall(r"[a-z]+|\d+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    return [w for w in parts if w not in FILLERS] or parts


def same_quantity(a: str, b: str) -> bool:
    """Whether the words of the shorter name occur in order in the longer one, abbreviated or not."""
    short, long = sorted((words(a), words(b)), key=len)
    whole, at = False, 0
    for w in short:
        while at < len(long) and not (long[at].startswith(w) or w.startswith(long[at])):
            at += 1
        if at == len(long):
            return False
        whole, at = whole or (w == long[at] and len(w) > 3), at + 1
    return whole


def quantities(schemas: DataFrame) -> dict[str, str]:
    """Field name to the longest name of its quantity; only the distinct names reach the driver."""
    names = [r.field for r in field_types(schemas).select("field").collect()]
    alike = [(a, b) for a in names for b in names if a < b and same_quantity(a, b)]
    if not alike:
        return {n: n for n in names}
    sets = schemas.select(F.col("fields.name").alias("names")).distinct()
    spark = schemas.sparkSession
    pairs = spark.createDataFrame(alike, "a string, b string")
    # pairs come from the distinct names alone, so their table is small
    held = sets.select("names", F.explode("names").alias("a")).join(F.broadcast(pairs), "a").where(F.array_contains("names", F.col("b"))).select("a", "b").distinct()
    apart = {(r.a, r.b) for r in held.collect()}
    group = {n: {n} for n in names}
    for a, b in sorted(set(alike) - apart):
        merged = group[a] | group[b]
        if not any((x, y) in apart for x in merged for y in merged):
            for n in merged:
                group[n] = merged
    return {n: max(g, key=lambda x: (len(x), x)) for n, g in group.items()}


def changes(files: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """sink, file_id, field, drift: each change of a sink's fields from one file to the next."""
    order = ["written_at", "file_id"]
    listed = files.select("sink", "file_id", F.col("written_at").cast("timestamp_ntz").alias("written_at"))
    schemas = cut(add_chunks(file_schemas(files), ["sink"], order, rows_per_chunk, listed), "schemas")
    of = quantities(schemas)
    lookup = F.create_map(*[F.lit(x) for pair in (of or {"": ""}).items() for x in pair])

    # what one file hands on to the next: its names, and the last type of each quantity that tells one
    told = F.transform(F.filter("fields", lambda f: f["last"].isNotNull()), lambda f: F.struct(
        f["name"].alias("field"), lookup[f["name"]].alias("quantity"), f["first"].alias("type"), f["last"].alias("last"), (F.size(f["inner"]) > 0).alias("mixed")))
    states = schemas.select("sink", "chunk", *order, F.col("fields.name").alias("names"), told.alias("told"))
    states = states.select("*", F.struct("names", F.map_from_arrays("told.quantity", "told.last").alias("types")).alias("state"))
    steps = lag_over_chunks(states, ["sink"], order, "state", "was")

    # names against the names before; types mostly against the file before. Only where a quantity starts to tell a type
    # after files without one is the type it ended with looked up, among such starts and ends alone. It lives on under a
    # new name.
    new, gone = F.array_except("names", "was.names"), F.array_except("was.names", "names")
    meant = lambda c: F.transform(c, lambda n: lookup[n])
    steps = steps.withColumn("new", new).withColumn("gone", gone).withColumn("before", F.coalesce("was.types", F.create_map().cast("map<string,string>")))
    change = lambda n, kind: F.struct(n.alias("field"), kind.alias("drift"))
    named = F.concat(
        F.transform("new", lambda n: change(n, F.when(F.array_contains(meant(F.col("gone")), lookup[n]), "renamed").otherwise("added"))),
        F.transform(F.filter("gone", lambda n: ~F.array_contains(meant(F.col("new")), lookup[n])), lambda n: change(n, F.lit("removed"))))
    event = lambda q, name, kind, mix: F.struct(q.alias("quantity"), name.alias("field"), kind.alias("type"), mix.alias("mixed"))
    before, now = F.col("before"), F.col("state.types")
    changed = F.filter("told", lambda f: before[f["quantity"]].isNotNull() & (f["mixed"] | (before[f["quantity"]] != f["type"])))
    starts = F.transform(F.filter("told", lambda f: before[f["quantity"]].isNull()), lambda f: event(f["quantity"], f["field"], f["type"], f["mixed"]))
    ends = F.transform(F.filter(F.map_keys(before), lambda q: now[q].isNull()), lambda q: event(q, F.lit(None).cast("string"), before[q], F.lit(False)))
    steps = steps.select("sink", "chunk", *order, F.coalesce(named, F.array().cast("array<struct<field:string,drift:string>>")).alias("named"), F.transform(changed, lambda f: f["field"]).alias("changed"), F.concat(starts, ends).alias("events"))
    steps = cut(steps.where("size(named) + size(changed) + size(events) > 0"), "steps")

    drift = steps.select("sink", "file_id", F.explode("named").alias("d")).select("sink", "file_id", "d.field", "d.drift")
    here = steps.select("sink", "file_id", F.explode("changed").alias("field"))
    events = steps.select("sink", "chunk", *order, F.explode("events").alias("e")).select("sink", "chunk", *order, "e.*")
    events = lag_over_chunks(events, ["sink", "quantity"], order, "type", "was").where(F.col("field").isNotNull() & (F.col("mixed") | (F.col("was") != F.col("type"))))
    retyped = here.unionByName(events.select("sink", "file_id", "field")).withColumn("drift", F.lit("retyped"))
    fresh = drift.where("drift <> 'removed'").select("sink", "file_id", "field")
    on = [retyped.sink.eqNullSafe(fresh.sink), retyped.file_id.eqNullSafe(fresh.file_id), retyped.field == fresh.field]
    return drift.unionByName(retyped.join(fresh, on, "left_anti"))


def union_table(files: DataFrame) -> DataFrame:
    """Every complete record, cast to the union schema; renamed fields share the column of their quantity."""
    schemas = cut(file_schemas(files), "schemas")
    of = quantities(schemas)
    kinds: dict[str, list[str]] = defaultdict(list)
    names: dict[str, list[str]] = defaultdict(list)
    for r in field_types(schemas).collect():
        kinds[of[r.field]] += r.kinds
        names[of[r.field]].append(r.field)
    lines = record_lines(files).where("record_key is not null")
    held = lines.select("sink", "file_id", "line_no", "written_at", F.from_json("record", "map<string,string>").alias("values"))

    def column(quantity: str) -> Column:
        value = F.coalesce(*[F.col("values")[n] for n in sorted(names[quantity])])
        return value.try_cast(CASTS[promote(kinds[quantity])]).alias(f"r_{quantity}")

    return held.select("sink", "file_id", "line_no", "written_at", *[column(q) for q in sorted(names)])


def type_files(files: DataFrame) -> DataFrame:
    """field, json_type, n_files: in how many files a field has a type among the complete records (null: in no record another)."""
    each = file_schemas(files).select(F.explode("fields").alias("f"))
    kinds = F.array_distinct(F.concat(F.array(F.coalesce("f.first", F.lit("null"))), "f.inner"))
    return each.select(F.col("f.name").alias("field"), F.explode(kinds).alias("json_type")).groupBy("field", "json_type").agg(F.count("*").alias("n_files"))


def column_summary(table: DataFrame) -> DataFrame:
    """quantity, data_type, n_values, total, n_true of each column of a union table: values that survived the cast, the
    sum of numbers (to three digits) and the number of true ones."""
    held = {n.removeprefix("r_"): (n, t) for n, t in table.dtypes if n.startswith("r_")}
    one = lambda q, n, t: F.struct(
        F.lit(q).alias("quantity"), F.lit(t).alias("data_type"), F.count(n).alias("n_values"),
        (F.sum(F.round(n, 3).cast("decimal(28,3)")).cast("double") if t == "double" else F.lit(None).cast("double")).alias("total"),
        (F.count_if(n) if t == "boolean" else F.lit(None).cast("long")).alias("n_true"))
    rows = [one(q, n, t) for q, (n, t) in held.items()]
    none = table.sparkSession.createDataFrame([], "quantity string, data_type string, n_values long, total double, n_true long")
    return table.agg(F.array(*rows).alias("c")).select(F.explode("c").alias("c")).select("c.*") if rows else none
