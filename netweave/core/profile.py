"""Column-level data quality profile from file footers, dictionaries and, where needed, scans.

Files are listed by Spark, a first small job lists the row groups from their footers, and row groups are spread over
tasks. A task reads the footer of its file: nulls are exact there,
extrema too unless missing. Distinct candidates come from the chunk's dictionary page when all its data pages use
it. A chunk is scanned only when that isn't enough: no statistics, no complete dictionary, a dictionary that holds
NaN (which extrema leave out and nobody counts), or a value outside the column's rule.

``found`` judges single values and whole loads. Loads differ by their null share, share of zeros, level, spread and
share of distinct values, each against the median over all loads, in units of the median deviation; a load is a case
only if it also differs by a plain amount (``FLOORS``). Its chunks hold many loads each, so that footers never suffice
and every chunk's needed columns are scanned.

Edge cases: an empty table gives one row per column with zero counts, or no row without files; NaN is not null
and counts as one distinct value; -0.0 equals 0.0; nested columns are left out; rows without a load are judged one by
one only; repeated rows count each; a column of all nulls has null extrema.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.core.compaction import data_files
from netweave.core.dictionary_pages import dictionary_values
from netweave.session import cut

_CHUNKS = "column_name string, n_rows long, n_null long, n_nan long, lo double, hi double, lo_text string, hi_text string, n_violations long, scanned int, candidates array<string>"
BLOCK = 50_000


@dataclass(frozen=True)
class Rule:
    """What a column's values must be: a closed range, or a text that matches a pattern. Null never violates."""

    low: float = -math.inf
    high: float = math.inf
    pattern: str | None = None

    def broken(self, v) -> bool:
        if self.pattern is not None:
            return isinstance(v, str) and not re.fullmatch(self.pattern, v)
        return isinstance(v, (int, float)) and not self.low <= v <= self.high


#: Schemes of Hadoop's connectors and what Arrow calls them.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://"}


def _open(path: str):
    for theirs, ours in SCHEMES.items():
        path = ours + path.removeprefix(theirs) if path.startswith(theirs) else path
    fs, name = pafs.FileSystem.from_uri(path if re.match(r"^[a-z0-9]+:/", path) else f"file://{path}")
    return fs.open_input_file(re.sub("^/+", "/", name))


def _text(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def _profile_chunk(file, reader: pq.ParquetFile, group: int, col: int, rule: Rule | None) -> Iterator[dict]:
    chunk, schema = reader.metadata.row_group(group).column(col), reader.schema_arrow
    name = chunk.path_in_schema
    kind = schema.field(name).type
    real, text, timed = pa.types.is_floating(kind), pa.types.is_string(kind) or pa.types.is_large_string(kind), pa.types.is_timestamp(kind)
    stats = chunk.statistics
    n_rows = reader.metadata.row_group(group).num_rows
    n_null = stats.null_count if stats is not None and stats.has_null_count else None
    # text extrema may be cut short by a writer, so only their dictionary or a scan tells
    lo, hi = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)
    if pa.types.is_boolean(kind) and lo is not None:
        values = sorted({lo, hi})
    else:
        values = dictionary_values_typed(file, chunk, text, timed, kind)
    nan = real and values is not None and any(math.isnan(v) for v in values)
    broken = rule is not None and (any(map(rule.broken, values)) if values is not None else text or lo is None or rule.broken(lo) or rule.broken(hi))
    empty = n_null == n_rows
    if not empty and (n_null is None or nan or broken or values is None or (text and lo is None)):
        array = reader.read_row_group(group, columns=[name]).column(0)
        n_null = array.null_count
        n_nan = pc.sum(pc.is_nan(array)).as_py() or 0 if real else 0
        distinct = pc.unique(array).drop_null()
        values = distinct.to_pylist()
        real_values = distinct.filter(pc.invert(pc.is_nan(distinct))) if real else distinct
        ends = pc.min_max(real_values).as_py() if len(real_values) else {"min": None, "max": None}
        lo, hi = ends["min"], ends["max"]
        n_broken = 0
        if rule is not None:
            counts = pc.value_counts(array)
            n_broken = sum(c.as_py() for v, c in zip(counts.field("values"), counts.field("counts")) if rule.broken(v.as_py()))
        scanned = 1
    else:
        n_nan = n_broken = scanned = 0
        values = values or []
        if values and not pa.types.is_boolean(kind):
            known = [v for v in values if v == v]
            lo, hi = (min(known), max(known)) if known else (None, None)
    number = lambda v: float(v) if isinstance(v, (int, float, bool)) and v is not None else None
    word = lambda v: None if v is None or isinstance(v, (int, float)) else v.strftime("%Y-%m-%d %H:%M:%S") if timed else v
    texts = sorted({_text(v) for v in values})
    for at in range(0, max(1, len(texts)), BLOCK):
        first = at == 0
        yield {
            "column_name": name, "n_rows": n_rows * first, "n_null": n_null * first, "n_nan": n_nan * first, "lo": number(lo), "hi": number(hi),
            "lo_text": word(lo), "hi_text": word(hi), "n_violations": n_broken * first, "scanned": scanned * first, "candidates": texts[at : at + BLOCK],
        }


def dictionary_values_typed(file, chunk, text: bool, timed: bool, kind) -> list | None:
    """The dictionary's values in the column's own type."""
    values = dictionary_values(file, chunk)
    if values is None:
        return None
    if text:
        return [v.decode("utf-8", "replace") for v in values]
    if timed:
        return pa.array(values, pa.int64()).cast(kind).to_pylist()
    return values


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """file and group of each row group, from the footers alone, spread over as many tasks as there are groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with _open(name) as file:
                    n = pq.ParquetFile(file).metadata.num_row_groups
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32())], ["file", "group"])

    files = data_files(spark, path).select("file")
    groups = cut(files.repartition(max(1, min(files.count(), 4096))).mapInArrow(run, "file string, group int"), "groups")
    return groups.repartition(max(1, min(groups.count(), 100_000)), "file", "group")


def chunk_profiles(spark: SparkSession, path: str, rules: dict[str, Rule]) -> DataFrame:
    """One row per column chunk (more where its candidates are very many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, group in zip(batch.column("file").to_pylist(), batch.column("group").to_pylist()):
                with _open(name) as file:
                    reader = pq.ParquetFile(file)
                    flat = [c for c in range(reader.metadata.num_columns) if "." not in reader.schema.column(c).path]
                    rows = [r for c in flat for r in _profile_chunk(file, reader, group, c, rules.get(reader.schema.column(c).path))]
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return row_groups(spark, path).mapInArrow(run, _CHUNKS)


_ARROW = pa.schema([
    ("column_name", pa.string()), ("n_rows", pa.int64()), ("n_null", pa.int64()), ("n_nan", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()),
    ("lo_text", pa.string()), ("hi_text", pa.string()), ("n_violations", pa.int64()), ("scanned", pa.int32()), ("candidates", pa.list_(pa.string())),
])


def profile(spark: SparkSession, path: str, rules: dict[str, Rule] | None = None) -> DataFrame:
    """One row per column: rows, nulls, NaN, distinct values, range, violations and how many chunks were scanned."""
    chunks = cut(chunk_profiles(spark, path, rules or {}), "chunks")
    totals = chunks.groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_nan", "n_violations")],
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo_text").alias("lo_text"), F.max("hi_text").alias("hi_text"),
        F.sum("scanned").cast("long").alias("n_scanned"), F.count_if(F.col("n_rows") > 0).alias("n_chunks"),
    )
    distinct = chunks.select("column_name", F.explode("candidates").alias("v")).groupBy("column_name").agg(F.countDistinct("v").alias("n_distinct"))
    return totals.join(distinct, "column_name", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


# ---- impossible values and loads that differ -----------------------------------------------------------------

NEEDED = ["record_id", "load_id", "polish_method", "support_measured", "n_links", "n_zones", "budget_seconds", "residual", "support_changes_final", "seconds"]
_NEEDED = "record_id long, load_id long, polish_method string, support_measured boolean, n_links int, n_zones int, budget_seconds double, residual double, support_changes_final double, seconds double"
#: By how much a load must differ at least, whatever the deviations among the others.
FLOORS = {"null_share": 0.25, "zero_share": 0.35, "level": 0.5, "spread": 1.2, "distinct_share": 0.4}
DEVIATIONS = 8.0
#: Below so many values a load tells nothing of level, spread and distinct values.
LEAST_VALUES = 10


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The needed columns of the row groups.

    Null shares, spreads and rules across columns of each load are asked for, which no footer of a group of many
    loads can settle; so every group is scanned, in these columns alone.
    """
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in _NEEDED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, group in zip(batch.column("file").to_pylist(), batch.column("group").to_pylist()):
                with _open(name) as file:
                    reader = pq.ParquetFile(file)
                    for rows in reader.iter_batches(BLOCK, row_groups=[group], columns=NEEDED):
                        yield pa.RecordBatch.from_arrays([rows.column(n).cast(schema.field(n).type) for n in NEEDED], schema=schema)

    return row_groups(spark, path).mapInArrow(run, _NEEDED)


def _impossible() -> dict[str, Column]:
    c = F.col
    finite = lambda n: ~F.isnan(n) & (F.abs(c(n)) < float("inf"))
    return {
        "residual": ~(finite("residual") & (c("residual") >= 0) & (c("residual") < 1)) | F.coalesce(c("polish_method") == "not reached", F.lit(False)),
        "support_changes_final": ~(
            finite("support_changes_final") & (c("support_changes_final") >= 0) & (F.floor("support_changes_final") == c("support_changes_final"))
            & F.coalesce(c("support_changes_final") <= c("n_links").cast("double") * c("n_zones"), F.lit(True))
        ) | F.coalesce(~c("support_measured"), F.lit(False)),
        "seconds": ~(finite("seconds") & (c("seconds") > 0) & (c("seconds") <= 864000)) | F.coalesce(c("seconds") > c("budget_seconds") * 1.1, F.lit(False)),
    }


def _values(rows: DataFrame) -> DataFrame:
    """record_id, load_id, column_name, value, due (a null would be unexpected) and bad."""
    due = {"residual": ~F.coalesce(F.col("polish_method") == "not reached", F.lit(False)), "support_changes_final": F.coalesce("support_measured", F.lit(True)), "seconds": F.lit(True)}
    each = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("value"), due[n].alias("due"), F.coalesce(bad, F.lit(False)).alias("bad")) for n, bad in _impossible().items()])
    return rows.select("record_id", "load_id", F.explode(each).alias("v")).select("record_id", "load_id", "v.*")


def load_profiles(values: DataFrame) -> DataFrame:
    """Per load and column the share of unexpected nulls and zeros, level, spread and distinct share of its finite values."""
    v = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    log = F.when(v > 0, F.log10(v))
    return values.groupBy("column_name", "load_id").agg(
        F.count("*").alias("n"), F.count(v).alias("n_values"),
        (F.count_if(F.col("due") & F.col("value").isNull()) / F.count_if("due")).alias("null_share"),
        (F.count_if(v == 0) / F.count(v)).alias("zero_share"),
        F.count(log).alias("n_positive"), F.percentile_approx(log, [0.1, 0.5, 0.9], 1000).alias("q"),
        (F.approx_count_distinct(v, 0.03) / F.count(v)).alias("distinct_share"),
    ).select(
        "column_name", "load_id", "n", "null_share", F.when(F.col("n_values") >= LEAST_VALUES, F.col("zero_share")).alias("zero_share"),
        *[F.when(F.col("n_positive") >= LEAST_VALUES, x).alias(n) for x, n in ((F.col("q")[1], "level"), (F.col("q")[2] - F.col("q")[0], "spread"))],
        F.when(F.col("n_values") >= LEAST_VALUES, F.col("distinct_share")).alias("distinct_share"),
    )


def odd_loads(loads: DataFrame) -> DataFrame:
    """The loads that plainly differ, with the features that tell so."""
    traits = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), F.lit(floor).alias("floor")) for f, floor in FLOORS.items()])
    long = loads.where("load_id is not null").select("column_name", "load_id", "n", F.explode(traits).alias("t")).select("column_name", "load_id", "n", "t.*").where("x is not null")
    keys = ["column_name", "feature"]
    # one row per column and feature: a fixed few, so they may be broadcast
    middle = long.groupBy(*keys).agg(F.percentile_approx("x", 0.5, 10000).alias("mid"))
    long = long.join(F.broadcast(middle), keys)
    usual = long.groupBy(*keys).agg((1.4826 * F.percentile_approx(F.abs(F.col("x") - F.col("mid")), 0.5, 10000)).alias("dev"))
    share = F.col("feature").endswith("_share")
    noise = F.when(share, 4 * F.sqrt(F.greatest(F.col("mid") * (1 - F.col("mid")), F.lit(0.0)) / F.col("n"))).otherwise(0.0)
    # a high share of distinct values only says that a load has few values
    off = F.when(F.col("feature") == "distinct_share", F.col("mid") - F.col("x")).otherwise(F.abs(F.col("x") - F.col("mid")))
    odd = long.join(F.broadcast(usual), keys).where(off > F.greatest("floor", DEVIATIONS * F.col("dev"), noise))
    return odd.groupBy("column_name", "load_id").agg(F.sort_array(F.collect_set("feature")).alias("features"))


def found(spark: SparkSession, path: str) -> DataFrame:
    """column_name, load_id, record_id: record_id 0 for a load that differs, else an impossible value of another load."""
    values = cut(_values(scan_chunks(spark, path)), "values")
    odd = cut(odd_loads(load_profiles(values)), "odd")
    bad = values.where("value is not null and bad").select("column_name", "load_id", "record_id")
    return odd.select("column_name", "load_id", F.lit(0).cast("long").alias("record_id")).unionByName(bad.join(odd, ["column_name", "load_id"], "left_anti"))
