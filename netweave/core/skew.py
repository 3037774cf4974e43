"""Hot keys: splitting an ordered group into chunks so that no window holds a hot group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is split; at most total / ROWS_PER_CHUNK keys can be that hot.
ROWS_PER_CHUNK = 200_000


#: Rows that are looked at per chunk to find where chunks end; the ends of a hot key are chosen in one row.
SEEN_PER_CHUNK = 16


def heavy_keys(df: DataFrame, keys: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The keys with more than rows_per_chunk rows, with their count.

    The count aggregates map-side; at most total / rows_per_chunk rows come out, so the result can be broadcast.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_chunk)


def chunk_ends(df: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per heavy key the quantiles of ``order`` at which its chunks begin, from an even sample of its rows.

    Quantiles of the whole order, not of a time alone, so that equal times and bursts are cut too.
    """
    every = max(1, rows_per_chunk // SEEN_PER_CHUNK)
    seen = df.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(*keys, F.struct(*order).alias("at"))
    heavy = heavy_keys(df, keys, rows_per_chunk).drop("n")
    on = [seen[k].eqNullSafe(heavy[k]) for k in keys]
    lists = seen.join(F.broadcast(heavy), on, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list("at")).alias("ats"))
    step = max(1, rows_per_chunk // every)
    return lists.select(*keys, F.array_distinct(F.filter("ats", lambda x, i: (i > 0) & (i % step == 0))).alias("ends"))


def add_chunks(df: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int = ROWS_PER_CHUNK, of: DataFrame | None = None) -> DataFrame:
    """Adds ``chunk``: 0 for ordinary keys, a slice of ``order`` (nulls first) for heavy ones; it rises with the order.

    ``of`` is a frame with the same keys and order that is cheaper to read; it may hold more rows.
    """
    ends = chunk_ends(df if of is None else of, keys, order, rows_per_chunk).select(*[F.col(k).alias(f"_{k}") for k in keys], "ends")
    on = df[keys[0]].eqNullSafe(F.col(f"_{keys[0]}"))
    for k in keys[1:]:
        on = on & df[k].eqNullSafe(F.col(f"_{k}"))
    at = F.struct(*order)
    chunk = F.coalesce(F.size(F.filter("ends", lambda e: e <= at)), F.lit(0))
    # without ends, size() gives -1 or null, by setting
    return df.join(F.broadcast(ends), on, "left").withColumn("chunk", F.greatest(chunk, F.lit(0)).cast("long")).drop(*[f"_{k}" for k in keys], "ends")


def lag_over_chunks(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the value of the row before, by order within keys, computed chunk by chunk.

    Needs the column chunk of add_chunks, which must rise with the order. The first row of a chunk takes the last
    value of the chunk before it; that table has one row per chunk of a heavy key and is broadcast.
    """
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order)
    df = df.withColumn(name, F.lag(value).over(inside))
    ends = df.where(F.col("chunk") >= 0).groupBy(*keys, "chunk").agg(F.max_by(value, F.struct(*order)).alias("end"), F.count("*").alias("n"))
    across = Window.partitionBy(*keys).orderBy("chunk")
    # only heavy keys have more than one chunk
    before = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("chunk").alias("_chunk"), F.lag("end").over(across).alias("_before")).where("_chunk > 0")
    on = df["chunk"] == F.col("_chunk")
    for k in keys:
        on = on & df[k].eqNullSafe(F.col(f"_{k}"))
    joined = df.join(F.broadcast(before), on, "left")
    return joined.withColumn(name, F.coalesce(name, F.when(F.col(name).isNull(), F.col("_before")))).drop(*[f"_{k}" for k in keys], "_chunk", "_before")
