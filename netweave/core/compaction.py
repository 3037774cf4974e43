"""Far too many small files: partition-local compaction under snapshot versions.

``compact_parquet`` works on any partitioned Parquet dataset: it lists file sizes per partition, picks only the
partitions with more small files than allowed, and rewrites just these. ``compact_sink_files`` is the same operator for
the table ``sink_files``, whose rows are tiny JSONL files: their lines are ingested once into a dataset partitioned by a
hash of the record, so that equal records share a partition, and the rewrite of a partition keeps each record once.

A rewrite first fills a folder of its claim, by dynamic partition overwrite of the partitions that are due; its few files
then move beside the old ones, under names that carry the claim, and what they replace is named file by file in a list.
The switch is one exclusive create, the commit: readers take files of committed claims and leave out what committed lists
removed. So files that someone appends meanwhile are never touched, whoever wrote them: they are found by a second look at
the fingerprints (``Conflict``), or, in the moment between that look and the switch, simply stay part of the dataset.

A snapshot log guards the rewrite. A writer reads the current version with a fingerprint of every partition, claims the
next version by an exclusive create, and commits it by another. A claim runs out after ``lease`` seconds, so that a dead
writer stops nobody; should it come back, its commit finds the version taken. Exclusive creates need a file system that
has them (HDFS and local disks do; object stores need their committers).

Edge cases: null, empty and blank bodies hold no line with a record; a line that isn't one complete JSON object is kept
as a reject and never dropped silently; null sinks are a value of their own; equal ``written_at`` is resolved by file_id,
line_no, null ``written_at`` counts as earliest; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.jsontext import record_key
from netweave.session import cut, map_rows, work_dir

SMALL_BYTES, MAX_SMALL_FILES, TARGET_BYTES = 8 << 20, 8, 128 << 20
#: Partitions of a sink dataset, least and most (larger partitions get more files); files that an ingestion may leave
#: before it is spread by partition first; files that one round of a rewrite makes (the others follow in further rounds).
LEAST_BUCKETS, MOST_BUCKETS, MOST_FILES, FILES_A_ROUND = 16, 4096, 10_000, 20_000
LEASE_SECONDS = 6 * 3600.0


class Conflict(RuntimeError):
    """Another writer took the version, or the files changed since the plan was made."""


class SnapshotLog:
    """Numbered JSON versions in ``<root>/_snapshots``, taken by exclusive create."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.root = spark, spark._jvm, f"{root}/_snapshots"
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.root))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _create(self, name: str, text: str) -> None:
        try:
            out = self.fs.create(self._path(f"{self.root}/{name}"), False)
        except Py4JJavaError as e:
            raise Conflict(f"{name} exists") from e
        out.write(bytearray(text.encode()))
        out.close()

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]

    def current(self) -> int:
        return max((int(n[1:-5]) for n in self._names() if n.endswith(".json")), default=0)

    def claim(self, version: int, lease: float = LEASE_SECONDS) -> str:
        """Take the version after ``version``; raises Conflict if someone else holds it. Returns the claim's name.

        A claim older than ``lease`` belongs to a dead writer and is followed by the next one of the same version.
        """
        if self.current() != version:
            raise Conflict(f"version {self.current()} follows {version}")
        held = sorted((n for n in self._names() if n.startswith(f"v{version + 1}.claim")), key=lambda n: int(n.rpartition("-")[2]))
        if held:
            age = time.time() - self.fs.getFileStatus(self._path(f"{self.root}/{held[-1]}")).getModificationTime() / 1000
            if age < lease:
                raise Conflict(f"{held[-1]} is {age:.0f} s old")
        name = f"v{version + 1}.claim-{int(held[-1].rpartition('-')[2]) + 1 if held else 1}"
        self._create(name, "")
        return name

    def release(self, version: int) -> None:
        """Give up the latest claim of the version after ``version``."""
        held = [n for n in self._names() if n.startswith(f"v{version + 1}.claim")]
        if held:
            self.fs.delete(self._path(f"{self.root}/{max(held, key=lambda n: int(n.rpartition('-')[2]))}"), False)

    def commit(self, version: int, info: dict) -> None:
        self._create(f"v{version + 1}.json", json.dumps(info))

    def claims(self) -> list[tuple[int, str]]:
        """Version and claim of each committed rewrite; one small file a version."""
        out = []
        for version in sorted(int(n[1:-5]) for n in self._names() if n.endswith(".json")):
            stream = self.fs.open(self._path(f"{self.root}/v{version}.json"))
            claim = json.loads(bytes(stream.readAllBytes()).decode()).get("claim")
            stream.close()
            out += [(version, claim)] if claim else []
        return out

    def removed(self, claims: list[str]) -> DataFrame:
        """file (its place below the dataset) of each file that the rewrites of these claims replaced."""
        if not claims:
            return self.spark.createDataFrame([], "file string")
        return self.spark.read.parquet(*[f"{self.root}/removed-{c}" for c in claims]).select("file")


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """file, n_bytes and partition of each data file below path; only the listing is read, hidden files are left out."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))
    )
    return found.withColumn("partition", F.regexp_replace(F.regexp_extract("file", r"((?:/[^/=]+=[^/]*)*)/[^/]+$", 1), "^/", ""))


def partition_sizes(files: DataFrame, small_bytes: int, keys: list[str]) -> DataFrame:
    """Per partition: files, small files, bytes, and a fingerprint of the listing."""
    return files.groupBy(*keys).agg(
        F.count("*").alias("n_files"),
        F.count_if(F.coalesce(F.col("n_bytes"), F.lit(0)) < small_bytes).alias("n_small"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"),
        F.sum(F.xxhash64("file", "n_bytes").bitwiseAND(F.lit((1 << 31) - 1))).alias("fingerprint"),
    )


def same_place(a: DataFrame, b: DataFrame, columns: list[str]):
    """Join condition on columns that may be null."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


@dataclass
class Compaction:
    root: str
    version: int
    rewritten: int


def _place(column: str = "file"):
    """A file's place below the dataset."""
    return F.regexp_extract(column, r"/data/(.*)$", 1)


def files_at(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """file, n_bytes, partition of the files that make up a version (the last one if none is given).

    A file that a rewrite made carries its claim in its name and counts from the version that committed the claim; others
    were there from the start or appended. Each file counts up to the version that removed it.
    """
    log = SnapshotLog(spark, root)
    claims = [c for v, c in log.claims() if version is None or v <= version]
    of = F.regexp_extract("file", r"/(v\d+\.claim-\d+)\.[^/]*$", 1)
    files = data_files(spark, f"{root}/data").where((of == "") | of.isin(claims))
    return files.join(log.removed(claims).select(F.col("file").alias("gone")), _place() == F.col("gone"), "left_anti")


def read_version(spark: SparkSession, root: str, schema: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of a version. Only the names of its files reach the driver."""
    names = [r.file for r in files_at(spark, root, version).select("file").collect()]
    reader = spark.read.option("basePath", f"{root}/data")
    if not names:
        return spark.createDataFrame([], schema) if schema else reader.parquet(f"{root}/data").limit(0)
    return (reader.schema(schema) if schema else reader.option("mergeSchema", "false")).parquet(*names)


def compact_parquet(
    spark: SparkSession, root: str, small_bytes: int = SMALL_BYTES, max_small_files: int = MAX_SMALL_FILES, target_bytes: int = TARGET_BYTES,
    due: DataFrame | None = None, merge: Callable[[DataFrame], DataFrame] | None = None, spread_by: list[str] | None = None, vacuum: bool = True, lease: float = LEASE_SECONDS,
) -> Compaction:
    """Compact the dataset ``<root>/data``; only partitions with more than max_small_files small files.

    Rows go to files of about target_bytes: a partition gets ``ceil(bytes / target)`` files, each filled by one task, over
    which its rows are spread by a hash, so that one hot partition never lands in one task. ``due`` (column partition)
    names further partitions to rewrite. ``merge`` may fold rows of a partition on the way. With ``vacuum``, replaced
    files are deleted after the switch; without, earlier versions stay readable. Many partitions go in several rounds,
    each a version of its own.
    """
    done = Compaction(root, SnapshotLog(spark, root).current(), 0)
    sizes = partition_sizes(files_at(spark, root), small_bytes, ["partition"])
    # one row per partition that needs the rewrite: bounded by the number of partitions, not of files or rows
    wanted = sizes.where(F.col("n_small") > max_small_files)
    if due is not None:
        wanted = wanted.unionByName(sizes.join(due.select("partition").distinct(), "partition", "left_semi")).distinct()
    todo = sorted(wanted.collect(), key=lambda r: r.partition)
    while todo:
        n, files = 0, 0
        while n < len(todo) and (n == 0 or files + -(-todo[n].n_bytes // target_bytes) <= FILES_A_ROUND):
            files, n = files + max(1, -(-todo[n].n_bytes // target_bytes)), n + 1
        version = _rewrite(spark, root, todo[:n], small_bytes, target_bytes, merge, spread_by, lease)
        done, todo = Compaction(root, version, done.rewritten + n), todo[n:]
    if vacuum and done.rewritten:
        _vacuum(spark, root)
    return done


def _rewrite(spark: SparkSession, root: str, todo: list, small_bytes: int, target_bytes: int, merge, spread_by: list[str] | None, lease: float) -> int:
    log, data = SnapshotLog(spark, root), f"{root}/data"
    version = log.current()
    claim = log.claim(version, lease)
    staged = f"{root}/_staged/{claim}"
    try:
        parts = spark.createDataFrame([(r.partition,) for r in todo], "partition string")
        # the files to replace, named once and for all: what comes later is not among them
        old = cut(files_at(spark, root).join(F.broadcast(parts), "partition", "left_semi"), "old")
        names = [part.split("=")[0] for part in todo[0].partition.split("/")]
        rows = spark.read.option("basePath", data).option("mergeSchema", "false").parquet(*[r.file for r in old.select("file").collect()])
        if merge is not None:
            rows = merge(rows)
        # one row per partition: how many files its rows are spread over, and where they begin among all files
        plan, at = [], 0
        for r in todo:
            n = max(1, -(-r.n_bytes // target_bytes))
            plan.append((r.partition, n, at))
            at += n
        label = F.concat_ws("/", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for n in names])
        rows = rows.withColumn("_partition", label).join(F.broadcast(spark.createDataFrame(plan, "_partition string, _files long, _at long")), "_partition", "left")
        task = F.coalesce("_at", F.lit(0)) + F.pmod(F.xxhash64(*(spread_by or [c for c in rows.columns if c[0] != "_"])), F.coalesce("_files", F.lit(1)))
        (
            rows.repartitionById(at, task.cast("int")).drop("_partition", "_files", "_at")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(staged)
        )
        old.select(_place().alias("file")).coalesce(1).write.mode("overwrite").parquet(f"{log.root}/removed-{claim}")
        for r in cut(data_files(spark, staged).select("file"), "made").toLocalIterator():
            folder, _, name = r.file.rpartition(f"/_staged/{claim}/")[2].rpartition("/")
            log.fs.rename(log._path(f"{staged}/{folder}/{name}"), log._path(f"{data}/{folder}/{claim}.{name}"))
        now = {r.partition: r.fingerprint for r in partition_sizes(files_at(spark, root), small_bytes, ["partition"]).join(F.broadcast(parts), "partition", "left_semi").collect()}
        if any(now.get(r.partition) != r.fingerprint for r in todo):
            raise Conflict("files changed since the plan was made")
        log.commit(version, {"rewritten": len(todo), "small_bytes": small_bytes, "target_bytes": target_bytes, "claim": claim})
    except BaseException:
        log.release(version)
        _drop(log, data_files(spark, data).where(F.col("file").contains(f"/{claim}.")))
        raise
    finally:
        log.fs.delete(log._path(staged), True)
    return version + 1


def _drop(log: SnapshotLog, files: DataFrame) -> None:
    # the listing is written first: it is read while the files go
    for r in cut(files.select("file"), "drop").toLocalIterator():
        log.fs.delete(log._path(r.file), False)


def _vacuum(spark: SparkSession, root: str) -> None:
    """Delete the files that committed rewrites replaced, just those listed, and what dead writers of taken versions left."""
    log = SnapshotLog(spark, root)
    claims = dict(log.claims())
    _drop(log, data_files(spark, f"{root}/data").join(log.removed(list(claims.values())).select(F.col("file").alias("gone")), _place() == F.col("gone"), "left_semi"))
    claim = F.regexp_extract("file", r"/(v(\d+)\.claim-\d+)\.[^/]*$", 1)
    version = F.regexp_extract("file", r"/(v(\d+)\.claim-\d+)\.[^/]*$", 2).try_cast("int")
    _drop(log, data_files(spark, f"{root}/data").where((version <= log.current()) & ~claim.isin(list(claims.values()))))


_LINES = "file_id long, written_at timestamp_ntz, sink string, line_no int, record_key binary, record string"
_STORED = f"{_LINES}, kind string, bucket int"


def _lines(ids: list, times: list, sinks: list, bodies: list) -> Iterator[tuple]:
    for i, t, s, body in zip(ids, times, sinks, bodies):
        for no, line in enumerate((body or "").split("\n"), 1):
            text = line.lstrip("\ufeff").strip(" \t\r")
            if text:
                yield i, t, s, no, record_key(text), text


def record_lines(files: DataFrame) -> DataFrame:
    """One row per line that isn't blank; record_key is null where the line isn't one complete JSON object."""
    return map_rows(files.select("file_id", F.col("written_at").cast("timestamp_ntz").alias("written_at"), "sink", "body"), _lines, _LINES)


def once(rows: DataFrame) -> DataFrame:
    """The first line of each record; a hot record collapses in the map-side minimum."""
    first = F.min(F.struct("written_at", "file_id", "line_no", "sink", "record")).alias("f")
    return rows.groupBy("kind", "bucket", "record_key").agg(first).select("f.file_id", "f.written_at", "f.sink", "f.line_no", "record_key", "f.record", "kind", "bucket")


def compact_sink_files(
    files: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES, max_small_files: int = MAX_SMALL_FILES, most_files: int = MOST_FILES
) -> str:
    """Bring the tiny files of ``sink_files`` into few well-sized files; returns the dataset's root.

    Version 1 of the dataset holds every line as ingested, the last version each record once (partitions kind, bucket).
    Due are the buckets that hold pieces of more small files than allowed, and, among the others, those that would keep a
    record twice; lines that aren't records stay as they were ingested.
    """
    spark = files.sparkSession
    root = root or work_dir(spark, "sinks")
    total = files.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-total // target_bytes)))
    known = F.col("record_key").isNotNull()
    lines = record_lines(files).select(
        "*", F.when(known, "record").otherwise("reject").alias("kind"),
        F.pmod(F.when(known, F.xxhash64("record_key")).otherwise(F.xxhash64("file_id", "line_no")), F.lit(buckets)).cast("int").alias("bucket"),
    )
    if files.rdd.getNumPartitions() * buckets > most_files:
        # every task would leave a file in every bucket: rows meet in their bucket first, spread over its files
        lines = lines.repartition(max(buckets, -(-total // target_bytes)), "kind", "bucket", F.pmod(F.xxhash64("file_id", "line_no"), F.lit(max(1, -(-total // (buckets * target_bytes))))))
    lines.write.partitionBy("kind", "bucket").parquet(f"{root}/data")
    SnapshotLog(spark, root).commit(0, {"ingested": True, "buckets": buckets})

    staged = spark.read.schema(_STORED).parquet(f"{root}/data").where("kind = 'record'")
    pieces = staged.groupBy("bucket").agg(F.approx_count_distinct("file_id", 0.02).alias("n"))
    many = cut(pieces.where(F.col("n") > max_small_files).select("bucket"), "many")
    # buckets, not rows, are listed here: at most MOST_BUCKETS
    twice = staged.join(F.broadcast(many), "bucket", "left_anti").groupBy("bucket", "record_key").agg(F.count("*").alias("n")).where("n > 1").select("bucket").distinct()
    due = many.unionByName(twice).select(F.concat(F.lit("kind=record/bucket="), F.col("bucket").cast("string")).alias("partition"))
    compact_parquet(spark, root, max_small_files=1 << 30, target_bytes=target_bytes, due=due, merge=once, spread_by=["record_key"], vacuum=False)
    return root


def compacted_records(spark: SparkSession, root: str) -> DataFrame:
    """Each record once, with the place of its first line."""
    return read_version(spark, root, _STORED).where("kind = 'record'").drop("kind")


def folded_lines(spark: SparkSession, root: str) -> DataFrame:
    """file_id and line_no of each line whose record an earlier line already holds: ingested, but not among the compacted."""
    places = ["file_id", "line_no"]
    ingested = read_version(spark, root, _STORED, 1).where("kind = 'record'").select(*places)
    kept = compacted_records(spark, root).select(*places)
    return ingested.join(kept, same_place(ingested, kept, places), "left_anti")
