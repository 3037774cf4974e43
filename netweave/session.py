"""Session helpers: table access and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is empty and Spark is local, as in tests, a temporary folder is used; executors on other
    machines could not read it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/netweave/{what}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-netweave-")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys into enough tasks for work that is heavy per row.

    Small in bytes, such rows would otherwise be coalesced into few tasks; a grouping by the same keys needs no other shuffle.
    """
    return df.repartition(4 * shuffle_width(df.sparkSession), *keys)


#: Rows that a row function gets at once, so that long texts don't pile up in a task.
ROWS_AT_ONCE = 500


def map_rows(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Apply f to blocks of rows: it gets one list per column and gives tuples of the schema.

    Values travel as Arrow, so that nulls stay nulls and long integers stay exact.
    """
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = list(f(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)))
                columns = list(zip(*rows)) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
