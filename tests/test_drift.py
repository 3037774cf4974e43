import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from netweave.core import drift as d
from netweave.core.skew import add_chunks

SCHEMA = "file_id long, sink string, written_at timestamp_ntz, body string, field string"


def files(spark, *records, sink="s"):
    start = datetime(2025, 1, 1)
    rows = [(i, sink, start + timedelta(hours=i), r if r is None or isinstance(r, str) else "\n".join(map(json.dumps, r)), "clash") for i, r in enumerate(records, 1)]
    return spark.createDataFrame(rows, SCHEMA)


STEPS = (
    [{"mu": 1, "budget_seconds": 5.0}], "", '{"mu": 1, "budget', [{"mu": 1, "budget_seconds": None, "note": ""}], [{"mu": 1, "budget_s": "5"}], [{"mu": "1", "budget_s": "5"}, {"mu": "1", "budget_s": {"v": 5}}],
    [{"mu": None, "budget_s": "5", "note": 3}], [{"mu": 2, "note": "x"}], None,
)
WANTED = [
    (4, "note", "added"), (5, "budget_s", "renamed"), (5, "note", "removed"), (6, "budget_s", "retyped"), (6, "mu", "retyped"), (7, "budget_s", "retyped"), (7, "note", "added"),
    (8, "budget_s", "removed"), (8, "mu", "retyped"), (8, "note", "retyped"),
]


def test_each_change_is_listed_once(spark, rows):
    assert rows(d.changes(files(spark, *STEPS)), "file_id", "field", "drift") == sorted(WANTED, key=repr)


def test_a_hot_sink_in_chunks_gives_the_same(spark, rows):
    df = files(spark, *STEPS).unionByName(files(spark, *STEPS[:4], sink=None))
    assert rows(d.changes(df, rows_per_chunk=2)) == rows(d.changes(df))
    assert (None, 4, "note", "added") in rows(d.changes(df, rows_per_chunk=2), "sink", "file_id", "field", "drift")


def test_hot_sinks_with_null_equal_and_bunched_times(spark, rows):
    records = [[{"mu": 1} | ({"note": "x"} if i % 3 == 0 else {}) | ({"gate": i if i % 4 else "y"})] for i in range(40)]
    df = files(spark, *records)
    for at in ("if(file_id <= 7, null, written_at)", "cast(null as timestamp_ntz)", "timestamp_ntz'2025-01-01'", "if(file_id = 1, timestamp_ntz'1999-01-01', timestamp_ntz'2025-01-01')"):
        timed = df.withColumn("written_at", F.expr(at))
        assert rows(d.changes(timed, rows_per_chunk=3)) == rows(d.changes(timed))
        cut = add_chunks(timed, ["sink"], ["written_at", "file_id"], 3).groupBy("chunk").count().collect()
        assert len(cut) > 10 and max(r["count"] for r in cut) <= 4


def test_names_of_one_quantity():
    alike = [("budget_seconds", "budgetSeconds"), ("unresolved", "is_unresolved"), ("is_unresolved", "unresolved_flag"), ("env_windows_held", "envelope_windows_held"), ("peak_rss", "peak_rss_mb"), ("inclusionEnvelopeSettled", "envelope_settled")]
    assert all(d.same_quantity(*p) and d.same_quantity(*p[::-1]) for p in alike)
    apart = [("budget_seconds", "inclusion_envelope_settled"), ("unresolved", "peak_rss_mb"), ("envelope_settled", "envelope_windows_held"), ("n_links", "n_zones")]
    assert not any(d.same_quantity(*p) for p in apart)


def test_lattice():
    assert d.promote(["null"]) == "null" and d.promote(["null", "boolean"]) == "boolean" and d.promote(["boolean", "number"]) == "number"
    assert d.promote(["number", "string"]) == "string" and d.promote(["number", "object"]) == "string" and d.promote(["array", "null"]) == "array"


def test_union_table_holds_all_records(spark):
    t = d.union_table(files(spark, *STEPS)).orderBy("file_id", "line_no").collect()
    assert len(t) == 7 and {"r_mu", "r_budget_seconds", "r_note"} <= set(t[0].asDict())
    assert [r.r_budget_seconds for r in t[:4]] == ["5.0", None, "5", "5"]


def test_empty_table(spark):
    df = files(spark, "x").limit(0)
    assert d.changes(df).count() == 0 and d.union_table(df).count() == 0 and d.type_files(df).count() == 0
