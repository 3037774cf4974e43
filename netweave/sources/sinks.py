"""JSONL result sinks: coerced records out, sharded folders in under one superset schema; file fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators.records import named
from netweave.session import work_dir

#: Arrays longer than this are replaced by their size in a record.
MAX_ARRAY = 64


def coerced(df: DataFrame) -> list[Column]:
    """The columns as JSON holds them: NaN and infinite numbers are null, long arrays only tell their size."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        elif kind.startswith("array"):
            c = F.when(F.size(c) > MAX_ARRAY, F.to_json(F.struct(F.size(c).alias("array_shape"), F.lit(kind).alias("dtype")))).otherwise(F.to_json(c))
        out.append(c.alias(name))
    return out


def write_sink(records: DataFrame, root: str, by: str = "exhibit", stamp: dict[str, str] | None = None) -> None:
    """Append records to ``<root>/<by>=...``, each stamped with the given provenance."""
    stamped = records.select(*coerced(records), *[F.lit(v).alias(k) for k, v in (stamp or {}).items()])
    stamped.write.mode("append").partitionBy(by).option("ignoreNullFields", "true").json(root)


def read_sink(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All shards under one superset schema: a field that a shard lacks is null, a broken line gives nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(root)


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, n_bytes and the first 16 hex digits of the SHA-256 of each file; files are hashed in tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def roundtrip(records: DataFrame) -> DataFrame:
    """Write the records as a JSONL sink, read it back and count by exhibit and network."""
    root = work_dir(records.sparkSession, "sink")
    write_sink(named(records).select("exhibit", "network", "mu", "residual", "iterations"), root, stamp={"version": "1"})
    back = read_sink(records.sparkSession, root, "exhibit string, network string, mu double, residual double, iterations long, version string")
    return back.groupBy("exhibit", "network").agg(F.count("*").alias("n_records"), F.count("residual").alias("n_residuals"), F.sum("iterations").alias("total_iterations"))
