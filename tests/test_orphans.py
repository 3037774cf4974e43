import random
from datetime import datetime, timedelta

from netweave.core import orphans as o

T = datetime(2025, 1, 1)
DAY = timedelta(days=1)


def tables(spark, certs, listings, dirs):
    c = spark.createDataFrame([(*r, "clash") for r in certs], "record_id long, flow_file string, flow_sha256 string, recorded_at timestamp_ntz, key string")
    m = spark.createDataFrame([(*r, 1) for r in listings], "entry_id long, directory string, flow_file string, flow_sha256 string, listed_at timestamp_ntz, removed_at timestamp_ntz, status int")
    return c, m, spark.createDataFrame(dirs, "directory string, opened_at timestamp_ntz, closed_at timestamp_ntz")


H = "0123456789abcdef"
DIRS = [("flows/a", T, T + 10 * DAY), ("flows", T, None), ("late", T + 400 * DAY, None)]
LISTINGS = [
    (1, "flows/a/", "x_mu1.npz", H, T + DAY, T + 3 * DAY), (2, ".\\flows\\a", "x_mu1.npz", "f" * 16, T + 5 * DAY, None), (3, "flows/a", "y.npz", H, T + 20 * DAY, None), (4, "nowhere", None, None, T, None),
    (5, None, "z.npz", H, None, None), (6, "LATE", "w.npz", H, T, T),
]
CERTS = [
    (1, "flows/X_MU1.NPZ ", "sha256:" + H.upper(), T + 2 * DAY), (2, "x_mu1.npz", H, T + 4 * DAY), (3, "x_mu1.npz", H + "99", T + 6 * DAY), (4, "y.npz", H, T), (5, "gone.npz", H, T), (6, None, H, T), (7, "", None, T),
    (8, "y.npz", "e" * 16, T + 21 * DAY), (9, "x_mu1.npz", None, T + DAY), (10, "x_mu1.npz", None, T + 3 * DAY), (11, "z.npz", None, T), (12, "y.npz", "x", None), (2, "x_mu1.npz", H, T + 4 * DAY), (13, "w.npz", None, T),
]
WANTED = [
    ("certificate_sweep", 2, "flow_file", "deleted"), ("certificate_sweep", 2, "flow_file", "deleted"), ("certificate_sweep", 3, "flow_sha256", "deleted"), ("certificate_sweep", 4, "flow_file", "late"), ("certificate_sweep", 5, "flow_file", "missing"),
    ("certificate_sweep", 8, "flow_sha256", "missing"), ("certificate_sweep", 10, "flow_file", "deleted"), ("certificate_sweep", 11, "flow_file", "missing"), ("certificate_sweep", 13, "flow_file", "deleted"),
    ("flows_manifest", 3, "directory", "deleted"), ("flows_manifest", 4, "directory", "missing"), ("flows_manifest", 6, "directory", "late"),
]


def test_each_status(spark, rows):
    t = tables(spark, CERTS, LISTINGS, DIRS)
    assert rows(o.orphans(*t)) == sorted(WANTED, key=repr)
    # the same when every key counts as hot and is broadcast
    assert rows(o.orphans(*t, heavy_rows=1)) == sorted(WANTED, key=repr)


def test_counts_equal_the_rows(spark, rows):
    t = tables(spark, CERTS, LISTINGS, DIRS)
    for heavy in (1, 1000):
        assert o.orphan_counts(*t, heavy_rows=heavy).groupBy().sum("n_orphans").first()[0] == len(WANTED)


def test_empty_tables(spark):
    assert o.orphans(*tables(spark, [], [], [])).count() == 0
    assert {r.status for r in o.orphans(*tables(spark, CERTS, [], [])).collect()} == {"missing"}


def test_spans_and_status_against_brute_force(spark, rows):
    r = random.Random(1)
    targets = [(r.choice("abc"), T + r.randint(0, 90) * DAY, None if r.random() < 0.1 else T + r.randint(0, 120) * DAY) for _ in range(40)]
    refs = [(i, r.choice("abcd"), T + r.randint(0, 130) * DAY) for i in range(400)]

    def status(key, at):
        own = [(s, e or datetime.max) for k, s, e in targets if k == key]
        if any(s <= at < e for s, e in own):
            return "good"
        return "missing" if not own else "deleted" if any(s <= at for s, _ in own) else "late"

    tf = spark.createDataFrame(targets, "key string, start timestamp_ntz, end timestamp_ntz")
    rf = spark.createDataFrame(refs, "id long, key string, at timestamp_ntz")
    for heavy, chunk in ((10, 10**6), (10**6, 10**6), (10, 3)):
        assert rows(o.judge(rf, tf, heavy, chunk)[1], "id", "status") == sorted(((i, status(k, at)) for i, k, at in refs), key=repr)
