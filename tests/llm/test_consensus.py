from datetime import datetime, timedelta
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.llm import consensus as c

T = datetime(2025, 1, 1)
SCHEMA = "record_id long, sweep_id long, network string, mu double, origin string, recorded_at timestamp_ntz, residual double, stopped_on string, converged boolean, value string, weight double"
FIELDS = ["origin", "recorded_at", "residual", "stopped_on", "converged"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA)


def record(i, network="Corvale-Center", mu=2.0, sweep=1, origin="primary", hours=0, residual=1e-9, stopped="time budget", converged=True):
    return (i, sweep, network, mu, origin, T + timedelta(hours=hours), residual, stopped, converged)


WAYS = [" corvale - CENTER ", "Corvale_Center", "corvale‑center", "Corvale Center", "Corvale-Center"]


def test_pairs_of_a_cell_however_written(spark, rows):
    held = [record(i, w, 2.0 + i * 1e-9) for i, w in enumerate(WAYS)] + [record(10, "Corvale"), record(11, mu=5.0), record(12, sweep=2), record(13, None), record(14, None), record(15, mu=None), record(16, mu=None)]
    want = sorted(combinations(range(5), 2))
    df = frame(spark, held)
    assert rows(c.same_cell_pairs(df)) == want and rows(c.same_cell_pairs(df, block_rows=2)) == want
    assert c.same_cell_pairs(df.limit(0)).count() == 0


def test_fields_are_chosen_one_by_one(spark):
    nan = float("nan")
    held = [record(1, residual=None, stopped="time budget"), record(2, residual=3e-9, stopped=None, origin="archive"), record(3, residual=3e-9, stopped="time budget"), record(4, residual=nan, stopped="time  budget", converged=None)]
    r = c.representatives(frame(spark, held), FIELDS).first()
    assert (r.n_records, r.residual, r.stopped_on, r.converged, r.network) == (4, 3e-9, "time budget", True, "corvale-center")


def test_the_latest_run_outweighs_copies_of_an_older_one(spark):
    held = [record(i, hours=0, residual=1e-3, origin="mirror") for i in range(4)] + [record(9, hours=48, residual=1e-9)]
    assert c.representatives(frame(spark, held), FIELDS).first().residual == 1e-9


def test_alignment_votes_per_token():
    votes = c.vote(c.profile_of([("gate_r2 north", 1.0), ("gate_r3 north", 1.2), ("gate_r3 south", 1.0), ("gate_r3 northx", 0.1)]))
    assert "".join(votes) == "gate_r3 north"
    assert c.closest([("gate_r2 north", 1.0), ("gate_r3 south", 1.1), ("gate_r3 north", 0.9)]) == "gate_r3 north"
    assert c.closest([("b", 1.0), ("a", 1.0)]) == "a" and c.distance(list("kitten"), list("sitting")) == 3


def test_hot_cell_in_blocks_chooses_an_existing_value(spark):
    held = [record(i, residual=float(f"1.{i:04d}e-09"), stopped="time budget") for i in range(300)]
    df = frame(spark, held)
    r = c.representatives(df, FIELDS, block=16).first()
    assert r.n_records == 300 and r.stopped_on == "time budget" and r.residual in {x[6] for x in held}


def test_values_of_a_hot_field_meet_one_token_per_column_only(spark):
    values = [(f"1.{i * 7919 % 100003:06d}e-09", 1.0 + i % 3) for i in range(600)]
    hot = spark.createDataFrame([("c", "residual", v, w, i % 10) for i, (v, w) in enumerate(values)], "cell string, field string, value string, weight double, block long")
    r = c.consensus_tokens(hot, 10, 16).collect()
    assert len(r) == 1 and r[0].wanted[:2] == ["1", "."] and len(r[0].wanted) < 12
    chosen = c.consensus_values(hot.drop("block"), 16).first().value
    assert chosen in {v for v, _ in values}


def test_records_without_a_cell_and_empty_table(spark):
    df = frame(spark, [record(1, None), record(2, None), record(3, sweep=None)])
    assert c.representatives(df, FIELDS).count() == 3
    assert c.representatives(df.limit(0), FIELDS).count() == 0


def test_a_majority_is_its_own_consensus():
    values = [("gate_r2 north", 2.1), ("gate_r3 south", 1.0), ("gate_r3 northx", 1.0)]
    assert c.closest(values) == "gate_r2 north" == "".join(c.vote(c.profile_of(values)))


def test_the_way_a_cell_is_brought_together_does_not_matter(spark):
    held = [record(i, mu=2.0 + i % 7, sweep=i % 3, residual=float(f"1.{i * 37 % 11}e-{8 + i % 3}"), stopped=["time budget", "time  budget", None][i % 3], origin=["primary", "archive"][i % 2], hours=i % 5) for i in range(200)]
    df, out = frame(spark, held), []
    for width in (FIELDS, FIELDS[::-1]):
        out.append(sorted(map(repr, (tuple(r[f] for f in ("first_record_id", *FIELDS)) for r in c.representatives(df, width).collect()))))
    rows = c.cells(df).withColumn("newest", F.max("recorded_at").over(Window.partitionBy("cell"))).withColumn("w", c._weight(FIELDS))
    apart = {(r.cell, r.field): r.value for r in c.consensus_values(c.weighted_values(rows, FIELDS)).collect()}
    together = {r.cell: r for r in c.cells(c.representatives(df, FIELDS)).collect()}
    assert out[0] == out[1] and len(together) == 21
    assert all(str(together[cell][f]) == v for (cell, f), v in apart.items() if f in ("origin", "stopped_on"))
    assert all(together[cell][f] == float(v) for (cell, f), v in apart.items() if f == "residual")
