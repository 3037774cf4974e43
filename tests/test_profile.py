import math
import random

import pyarrow as pa
import pyarrow.parquet as pq

from netweave.core import profile as p

SCHEMA = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in p._NEEDED.split(", "))])


def write(path, rows, **k):
    pq.write_table(pa.Table.from_pylist(rows, schema=SCHEMA.append(pa.field("value", pa.string()))), path, **k)
    return f"file://{path}"


def record(i, load, **k):
    return {"record_id": i, "load_id": load, "polish_method": "x", "support_measured": True, "n_links": 10, "n_zones": 2, "budget_seconds": None, "residual": 1e-9, "support_changes_final": 3.0, "seconds": 5.0, "value": "clash"} | k


def test_footers_dictionaries_and_scans_agree(spark, tmp_path):
    r = random.Random(3)
    rows = [record(i, i // 50, residual=r.choice([None, float("nan"), 0.5, -0.0, 0.0, float("inf")]), seconds=r.random(), polish_method=r.choice([None, "a", "b" * 300])) for i in range(500)]
    paths = [write(tmp_path / f"{k}", rows, **a) for k, a in {"d": {"row_group_size": 70}, "plain": {"use_dictionary": False}, "nostats": {"write_statistics": False, "compression": "gzip"}, "small": {"dictionary_pagesize_limit": 64, "data_page_version": "2.0"}}.items()]
    out = []
    for path in paths:
        got = {x.column_name: x.asDict() for x in p.profile(spark, path, {"seconds": p.Rule(0, 0.5), "polish_method": p.Rule(pattern="a")}).collect()}
        out.append({c: {k: v for k, v in d.items() if k not in ("n_scanned", "n_chunks")} for c, d in got.items()})
        assert got["record_id"]["n_distinct"] == 500 and got["residual"]["n_nan"] == sum(x["residual"] is not None and math.isnan(x["residual"]) for x in rows)
        assert got["residual"]["n_null"] == sum(x["residual"] is None for x in rows) and got["residual"]["hi"] == math.inf and got["residual"]["n_distinct"] == 4
        assert got["seconds"]["n_violations"] == sum(x["seconds"] > 0.5 for x in rows) and got["polish_method"]["n_violations"] == sum(x["polish_method"] not in ("a", None) for x in rows)
        assert got["budget_seconds"]["n_null"] == 500 and got["budget_seconds"]["lo"] is None
    assert out[0] == out[1] == out[2] == out[3]


def test_scans_only_where_the_footer_is_not_enough(spark, tmp_path):
    path = write(tmp_path / "t", [record(i, 1) for i in range(100)])
    scanned = {x.column_name: x.n_scanned for x in p.profile(spark, path, {"seconds": p.Rule(0, 10)}).collect()}
    assert scanned["seconds"] == 0 and scanned["polish_method"] == 0 and scanned["load_id"] == 0


def test_empty_table(spark, tmp_path):
    path = write(tmp_path / "t", [])
    assert p.found(spark, path).count() == 0
    assert all(x.n_rows == 0 and x.n_distinct == 0 for x in p.profile(spark, path).collect())


def test_impossible_values(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    bad = [{"residual": nan}, {"residual": -1e-9}, {"residual": 1.0}, {"residual": inf}, {"polish_method": "not reached"}, {"support_changes_final": 2.5}, {"support_changes_final": 21.0}, {"support_changes_final": -1.0},
           {"support_measured": False}, {"seconds": 0.0}, {"seconds": 864001.0}, {"seconds": 11.1, "budget_seconds": 10.0}, {"seconds": -inf}]
    good = [{"residual": 0.0}, {"residual": None, "polish_method": "not reached"}, {"support_changes_final": 20.0}, {"support_changes_final": None, "support_measured": False}, {"seconds": 11.0, "budget_seconds": 10.0}, {"seconds": None}, {"polish_method": None}]
    rows = [record(i, None if i % 2 else 1, **k) for i, k in enumerate(bad + good)]
    assert sorted(x.record_id for x in p.found(spark, write(tmp_path / "t", rows)).collect()) == list(range(len(bad)))


def test_odd_loads_hide_their_values(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for load in range(40):
        for i in range(60):
            x = {"residual": 10 ** r.uniform(-14, -9), "seconds": 10 ** r.uniform(0.5, 3), "support_changes_final": float(r.choice([0, 0, 1, 2, 3, 5, 8]))}
            if load == 7:
                x["residual"] = None if r.random() < 0.9 else x["residual"]
            if load == 8:
                x["seconds"] *= 1000
            if load == 9:
                x["residual"] = 1e-10
            if load == 10:
                x["support_changes_final"] = 0.0
            if load == 11 and i == 0:
                x["seconds"] = 1e9
            rows.append(record(load * 60 + i, load, **x))
    got = {(x.column_name, x.load_id, x.record_id) for x in p.found(spark, write(tmp_path / "t", rows)).collect()}
    assert got == {("residual", 7, 0), ("seconds", 8, 0), ("residual", 9, 0), ("support_changes_final", 10, 0), ("seconds", 11, 660)}
