"""References to records that do not exist, with their status at the time of the reference.

Targets are reduced to merged spans of time per key. References are pre-aggregated per key and period, and a
whole group is judged at once: all good, all missing, all deleted, all late, or mixed. Heavy groups (few, by count)
are checked by broadcast, the remaining keys by a shuffle join; only mixed groups look at single rows. Orphan
counts come from the groups without touching their rows, but for the mixed ones.

Edge cases: a null or blank reference is none; a reference without a time is judged only on whether its target
exists at all; a target without a start is never there, one without an end is there for good; equal times count as
there at the start and gone at the end; repeated rows are judged each; empty tables give empty results; columns
beside those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.core.skew import ROWS_PER_CHUNK, add_chunks
from netweave.session import cut

HEAVY_ROWS = 20_000
_FAR = "timestamp_ntz'9999-12-31'"


def file_meant(name: str) -> Column:
    """The file's name: no folder, no case, no white space around."""
    c = F.lower(F.regexp_replace(F.trim(F.translate(name, "\t\r\n", "   ")), r"^.*[/\\]", ""))
    return F.nullif(F.trim(c), F.lit(""))


def digest_meant(name: str) -> Column:
    """The first 16 hex digits, whatever case or prefix; else the text itself."""
    c = F.lower(F.trim(name))
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(c, r"^(?:sha-?256[:=])?\s*([0-9a-f]{16})", 1), F.lit("")), c), F.lit(""))


def directory_meant(name: str) -> Column:
    """The path with single forward slashes, without a leading ./ or a slash at either end."""
    c = F.regexp_replace(F.translate(F.lower(F.trim(name)), "\\", "/"), "/+", "/")
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), "^/|/$", ""), F.lit(""))


def _islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    marked = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def spans_of(targets: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Spans (key, start, end) in which a target is there, merged where they overlap; a hot key only within chunks of time.

    Spans of different chunks may overlap; that only leaves a group for its rows to decide.
    """
    spans = targets.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.coalesce(F.col("end").cast("timestamp_ntz"), F.expr(_FAR)).alias("end"))
    spans = spans.where("key is not null and start is not null")
    return _islands(add_chunks(spans, ["key"], ["start", "end"], rows_per_chunk), ["key", "chunk"]).drop("chunk")


def _meet(groups: DataFrame, spans: DataFrame, heavy: DataFrame, hits: list) -> DataFrame:
    """Per group (key, period): the aggregates ``hits`` over the spans of its key.

    Heavy keys have many spans but few groups, so their groups are broadcast and their spans stay where they are; other
    keys meet in a shuffle. No list of spans is ever gathered.
    """
    parts = []
    for keep in ("left_semi", "left_anti"):
        g, s = (df.join(F.broadcast(heavy), "key", keep) for df in (groups, spans))
        parts.append(s.join(F.broadcast(g) if keep == "left_semi" else g, "key").groupBy("key", "period").agg(*hits))
    return reduce(DataFrame.unionByName, parts)


def judge(refs: DataFrame, targets: DataFrame, heavy_rows: int = HEAVY_ROWS, rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[DataFrame, DataFrame]:
    """Group verdicts (key, period, n, verdict) and the references with their status.

    refs: key, at and further columns; targets: key, start, end. Keys with at least heavy_rows references in a month or
    spans in all are at most rows / heavy_rows; only their groups (one row a month) and verdicts are broadcast.
    """
    refs = refs.where("key is not null").withColumn("period", F.date_trunc("month", F.coalesce(F.col("at"), F.expr("timestamp_ntz'1970-01-01'"))).cast("timestamp_ntz"))
    groups = cut(refs.groupBy("key", "period").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")), "groups")
    spans = cut(spans_of(targets, rows_per_chunk), "spans")
    heavy = groups.where(F.col("n") >= heavy_rows).select("key").union(spans.groupBy("key").count().where(F.col("count") >= heavy_rows).select("key")).distinct()
    touches = (F.col("start") <= F.col("hi")) & (F.col("end") > F.col("lo"))
    covers = (F.col("start") <= F.col("lo")) & (F.col("end") > F.col("hi"))
    met = _meet(groups, spans, heavy, [F.min("start").alias("first"), F.bool_or(covers).alias("covered"), F.bool_or(touches).alias("touched")])
    verdict = (
        F.when(F.col("first").isNull(), "missing").when(F.col("lo").isNull() | F.col("covered"), "good").when(F.col("touched"), "mixed")
        .when(F.col("first") <= F.col("lo"), "deleted").otherwise("late")
    )
    verdicts = cut(groups.join(met, ["key", "period"], "left").withColumn("verdict", verdict), "verdicts")

    # heavy groups meet their verdict by broadcast; their rows then carry a key that spreads them and matches nothing
    big = verdicts.where(F.col("n") >= heavy_rows).select("key", "period", F.col("first").alias("big_first"), F.col("verdict").alias("big_verdict"))
    small = verdicts.where(F.col("n") < heavy_rows).select(F.col("key").alias("small_key"), F.col("period").alias("small_period"), "first", "verdict")
    rows = refs.join(F.broadcast(big), ["key", "period"], "left")
    rows = rows.withColumn("meet", F.when(F.col("big_verdict").isNotNull(), F.concat(F.lit("\u0001"), F.xxhash64(*refs.columns).cast("string"))).otherwise(F.col("key")))
    rows = rows.join(small, (F.col("meet") == F.col("small_key")) & (F.col("period") == F.col("small_period")), "left")
    rows = cut(rows.select(*refs.columns, F.coalesce("big_first", "first").alias("first"), F.coalesce("big_verdict", "verdict").alias("verdict")), "judged")
    # rows of mixed groups meet the spans day by day, so that a hot key is spread over its days
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    mixed = verdicts.where("verdict = 'mixed'").select("key", "lo", "hi")
    heavy_mixed = mixed.join(F.broadcast(heavy), "key", "left_semi")
    near = reduce(DataFrame.unionByName, [
        spans.join(F.broadcast(heavy_mixed), "key"), spans.join(F.broadcast(heavy), "key", "left_anti").join(mixed, "key")
    ]).where(touches).select("key", "start", "end", F.explode(F.sequence(day(F.greatest("start", "lo")), day(F.least("end", "hi")), F.expr("interval 1 day"))).alias("day"))
    near = near.select(F.col("key").alias("span_key"), "start", "end", F.col("day").alias("span_day"))
    open_rows = rows.where("verdict = 'mixed'").withColumn("day", day(F.col("at")))
    there = (F.col("key") == F.col("span_key")) & (F.col("day") == F.col("span_day")) & (F.col("start") <= F.col("at")) & (F.col("end") > F.col("at"))
    absent = F.when(F.col("at").isNull(), "good").when(F.col("first") <= F.col("at"), "deleted").otherwise("late")
    out = [
        rows.where("verdict <> 'mixed'").withColumn("status", F.col("verdict")),
        open_rows.join(near, there, "left_semi").withColumn("status", F.lit("good")).drop("day"),
        open_rows.join(near, there, "left_anti").withColumn("status", absent).drop("day"),
    ]
    return verdicts, reduce(DataFrame.unionByName, out).drop("verdict", "first")


def _references(certificates: DataFrame, manifest: DataFrame, directories: DataFrame, heavy_rows: int):
    listings = manifest.select(file_meant("flow_file").alias("key"), digest_meant("flow_sha256").alias("digest"), F.col("listed_at").alias("start"), F.col("removed_at").alias("end"))
    files = certificates.select("record_id", file_meant("flow_file").alias("key"), digest_meant("flow_sha256").alias("digest"), F.col("recorded_at").cast("timestamp_ntz").alias("at"))
    by_file = judge(files, listings, heavy_rows)
    both = F.concat_ws("|", "key", "digest").alias("key")
    right_file = by_file[1].where("status = 'good' and digest is not null and at is not null")
    by_digest = judge(right_file.select("record_id", both, "at"), listings.where("digest is not null").select(both, "start", "end"), heavy_rows)
    places = manifest.select("entry_id", directory_meant("directory").alias("key"), F.col("listed_at").cast("timestamp_ntz").alias("at"))
    by_directory = judge(places, directories.select(directory_meant("directory").alias("key"), F.col("opened_at").alias("start"), F.col("closed_at").alias("end")), heavy_rows)
    return ("certificate_sweep", "record_id", "flow_file", by_file), ("certificate_sweep", "record_id", "flow_sha256", by_digest), ("flows_manifest", "entry_id", "directory", by_directory)


def _digest_status(field: str) -> Column:
    """A digest that another listing of the file has is deleted, whenever that listing was."""
    return F.when(F.lit(field == "flow_sha256") & (F.col("status") == "late"), "deleted").otherwise(F.col("status"))


def orphans(certificates: DataFrame, manifest: DataFrame, directories: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """src_table, row_id, field, status of each reference whose target isn't there at its time."""
    parts = [
        rows.where("status <> 'good'").select(F.lit(src).alias("src_table"), F.col(row_id).alias("row_id"), F.lit(field).alias("field"), _digest_status(field).alias("status"))
        for src, row_id, field, (_, rows) in _references(certificates, manifest, directories, heavy_rows)
    ]
    return reduce(DataFrame.unionByName, parts)


def orphan_counts(certificates: DataFrame, manifest: DataFrame, directories: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Orphans per src_table, field, status and month; whole groups are counted without their rows."""
    parts = []
    for src, _, field, (verdicts, rows) in _references(certificates, manifest, directories, heavy_rows):
        whole = verdicts.where("verdict not in ('good', 'mixed')").select("period", F.col("verdict").alias("status"), "n")
        mixed = verdicts.where("verdict = 'mixed'").select("key", "period")
        single = rows.join(mixed, ["key", "period"], "left_semi").where("status <> 'good'").select("period", "status", F.lit(1).cast("long").alias("n"))
        parts.append(whole.unionByName(single).select(F.lit(src).alias("src_table"), F.lit(field).alias("field"), _digest_status(field).alias("status"), "period", "n"))
    each = reduce(DataFrame.unionByName, parts)
    return each.groupBy("src_table", "field", "status", F.date_format("period", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n_orphans"))
