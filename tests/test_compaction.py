import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netweave.core import compaction as cp
from netweave.functions.jsontext import record_key

SCHEMA = "file_id long, sink string, path string, written_at timestamp_ntz, n_bytes long, body string, extra string"


def files(spark, *bodies, sink="s", at=None):
    rows = [(i, sink, f"p{i}", (at or {}).get(i, datetime(2025, 1, 1, i % 24)), len((b or "").encode()), b, "x") for i, b in enumerate(bodies, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, df, **k):
    root = cp.compact_sink_files(df, **k)
    kept = sorted(((r.file_id, r.line_no) for r in cp.compacted_records(spark, root).collect()), key=lambda x: (x[0] or 0, x[1]))
    return sorted((r.file_id, r.line_no) for r in cp.folded_lines(spark, root).collect()), kept, root


def test_keys_follow_json_equality():
    same = ['{"a": 1, "b": [1.0, true]}', '﻿{"b":[1,true],"a":1.00}', '{"\\u0061": 10e-1, "b": [1, true]}']
    assert len({record_key(s) for s in same}) == 1
    assert record_key('{"a": true}') != record_key('{"a": 1}') != record_key('{"a": "1"}')
    assert record_key('{"a": 12345678901234567890}') != record_key('{"a": 12345678901234567891}')
    assert record_key('{"a": -0.0}') == record_key('{"a": 0}')
    assert [record_key(s) for s in ("", None, "[1]", '{"a": 1', '{"a": NaN}', "null")] == [None] * 6


def test_each_record_stays_once(spark):
    df = files(spark, '{"a":1}\n{"a":2}', None, "", " \r\n", '{"a": 2.0}\r\n{"a":3}\n{"a":', '{"a":3}\n{"a":3}')
    folded, kept, _ = found(spark, df, max_small_files=0)
    assert kept == [(1, 1), (1, 2), (5, 2)] and folded == [(5, 1), (6, 1), (6, 2)]


def test_earlier_goes_by_time_then_id_then_line(spark):
    t = datetime(2025, 1, 1)
    df = files(spark, '{"a":1}', '{"a":1}', '{"a":1}\n{"a":1}', at={1: datetime(2025, 1, 2), 2: t, 3: t})
    assert found(spark, df)[0] == [(1, 1), (3, 1), (3, 2)]


def test_hot_record_and_many_buckets(spark):
    df = files(spark, *['{"hot": 1}\n{"n": %d}' % i for i in range(60)])
    folded, kept, root = found(spark, df, target_bytes=300, max_small_files=1)
    assert len(folded) == 59 and len(kept) == 61
    assert cp.SnapshotLog(spark, root).current() == 2


def test_empty_table(spark):
    assert found(spark, files(spark).limit(0))[:2] == ([], [])


def test_parquet_compaction_only_touches_partitions_that_need_it(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = spark.range(600).select("id", F.when(F.col("id") < 500, "a").otherwise("b").alias("part"), F.lit("v").alias("extra"))
    rows.where("part = 'a'").repartition(20).write.partitionBy("part").parquet(f"{root}/data")
    rows.where("part = 'b'").repartition(2).write.mode("append").partitionBy("part").parquet(f"{root}/data")
    before = {r.file for r in cp.data_files(spark, f"{root}/data").where("partition = 'part=b'").collect()}
    out = cp.compact_parquet(spark, root, max_small_files=8)
    after = cp.data_files(spark, f"{root}/data").collect()
    assert out.rewritten == 1 and sum(r.partition == "part=a" for r in after) == 1
    assert before == {r.file for r in after if r.partition == "part=b"}
    assert sorted(r.id for r in spark.read.parquet(f"{root}/data").collect()) == list(range(600))
    assert cp.compact_parquet(spark, root, max_small_files=8).rewritten == 0


def test_conflicting_writers_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    log = cp.SnapshotLog(spark, root)
    log.claim(0)
    with pytest.raises(cp.Conflict):
        log.claim(0)
    spark.range(40).selectExpr("id", "1 as part").repartition(20).write.partitionBy("part").parquet(f"{root}/data")
    with pytest.raises(cp.Conflict):
        cp.compact_parquet(spark, root, max_small_files=2)
    log.release(0)
    assert cp.compact_parquet(spark, root, max_small_files=2).rewritten == 1
    with pytest.raises(cp.Conflict):
        log.claim(0)


def test_found_equals_brute_force_on_the_small_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/sink_files.parquet")
    seen, out = set(), []
    for f in sorted(df.collect(), key=lambda r: (r.written_at, r.file_id)):
        for no, line in enumerate((f.body or "").split("\n"), 1):
            try:
                v = json.loads(line.strip("\ufeff \r\t"), parse_int=float)
            except ValueError:
                continue
            k = json.dumps(v, sort_keys=True)
            out += [(f.file_id, no)] if isinstance(v, dict) and k in seen else []
            seen.add(k)
    assert found(spark, df)[0] == sorted(out)


def test_null_ids_and_long_ids(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(None, None, "p", None, None, '{"a":1}', None), (big, "s", "q", datetime(2025, 1, 1), 3, '{"a":1}', None)], SCHEMA)
    assert found(spark, df)[:2] == ([(big, 1)], [(None, 1)])


def dataset(spark, root, files=20):
    spark.range(400).selectExpr("id", "id % 2 as part").repartition(files).write.partitionBy("part").parquet(f"{root}/data")


def ids(spark, root):
    return sorted(r.id for r in cp.read_version(spark, root).collect())


def test_a_dead_writers_claim_runs_out(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    dataset(spark, root)
    cp.SnapshotLog(spark, root).claim(0)
    with pytest.raises(cp.Conflict):
        cp.compact_parquet(spark, root, max_small_files=2)
    assert cp.compact_parquet(spark, root, max_small_files=2, lease=-1.0).rewritten == 2
    assert ids(spark, root) == list(range(400)) and len(list(tmp_path.rglob("part*/*.parquet"))) == 2
    # the dead writer comes back: the version is taken, and what it left is no part of the dataset
    log = cp.SnapshotLog(spark, root)
    with pytest.raises(cp.Conflict):
        log.commit(0, {"claim": "v1.claim-1"})


def test_files_appended_before_the_switch_are_a_conflict_and_stay(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    dataset(spark, root)
    plain, calls = cp.partition_sizes, []

    def late(files, *a):
        calls.append(1)
        if len(calls) == 2:  # between the rewrite and the second look at the fingerprints
            spark.range(400, 410).selectExpr("id", "id % 2 as part").coalesce(1).write.mode("append").partitionBy("part").parquet(f"{root}/data")
            files = cp.files_at(spark, root)
        return plain(files, *a)

    monkeypatch.setattr(cp, "partition_sizes", late)
    with pytest.raises(cp.Conflict):
        cp.compact_parquet(spark, root, max_small_files=2)
    monkeypatch.undo()
    assert ids(spark, root) == list(range(410)) and cp.SnapshotLog(spark, root).current() == 0
    assert cp.compact_parquet(spark, root, max_small_files=2).rewritten == 2
    assert ids(spark, root) == sorted(r.id for r in spark.read.parquet(f"{root}/data").collect()) == list(range(410))


def test_files_appended_after_the_second_look_stay_part_of_the_dataset(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    dataset(spark, root)
    commit = cp.SnapshotLog.commit

    def late(self, version, info):
        spark.range(400, 410).selectExpr("id", "id % 2 as part").coalesce(1).write.mode("append").partitionBy("part").parquet(f"{root}/data")
        commit(self, version, info)

    monkeypatch.setattr(cp.SnapshotLog, "commit", late)
    cp.compact_parquet(spark, root, max_small_files=2)
    assert ids(spark, root) == list(range(410))


def test_earlier_versions_stay_readable_and_rounds_are_versions(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    dataset(spark, root)
    monkeypatch.setattr(cp, "FILES_A_ROUND", 1)
    done = cp.compact_parquet(spark, root, max_small_files=2, vacuum=False)
    assert (done.version, done.rewritten) == (2, 2)
    sizes = [cp.files_at(spark, root, v).count() for v in (0, 1, 2)]
    assert sizes[0] > sizes[1] > sizes[2] == 2 and all(sorted(r.id for r in cp.read_version(spark, root, version=v).collect()) == list(range(400)) for v in (0, 1, 2))


def test_files_of_a_partition_are_near_the_target(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    spark.range(40_000).selectExpr("id", "uuid() as text", "0 as part").repartition(40).write.partitionBy("part").parquet(f"{root}/data")
    before = cp.files_at(spark, root).agg({"n_bytes": "sum"}).first()[0]
    cp.compact_parquet(spark, root, max_small_files=2, target_bytes=before // 7)
    made = [r.n_bytes for r in cp.files_at(spark, root).collect()]
    assert len(made) in (7, 8) and max(made) < 1.3 * min(made)


def test_ingestion_that_would_leave_too_many_files_meets_in_buckets_first(spark):
    df = files(spark, *['{"hot": 1}\n{"n": %d}\n{"cut' % i for i in range(40)])
    folded, kept, root = found(spark, df, most_files=1)
    assert len(folded) == 39 and len(kept) == 41
    assert cp.read_version(spark, root, cp._STORED).where("kind = 'reject'").count() == 40
