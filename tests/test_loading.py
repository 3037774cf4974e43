import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.operators import flows as fl
from netweave.operators import graph as gr
from netweave.operators import loading as ld

SUPPORT = "network string, dest int, link_id int, tail int, head int, cost double, pi_tail double, pi_head double, dest_name string"
DEMAND = "network string, origin int, dest int, demand double"
LINK = "network string, link_id int, tail int, head int"


def diamond(spark):
    """From 1 to 0 over 2 or 3, the second way dearer by 1, and 4 aside; two networks alike."""
    rows = [(0, 1, 2, 1.0, 2.0, 1.0), (1, 1, 3, 1.0, 2.0, 2.0), (2, 2, 0, 1.0, 1.0, 0.0), (3, 3, 0, 2.0, 2.0, 0.0)]
    return spark.createDataFrame([(n, 0, *r, "x") for n in ("a", "b") for r in rows], SUPPORT)


def test_load_splits_by_path_cost_and_keeps_what_cannot_go(spark):
    demand = spark.createDataFrame([("a", 1, 0, 6.0), ("a", 1, 0, 4.0), ("a", 2, 0, 1.0), ("a", 4, 0, 9.0), ("a", 0, 0, 5.0), ("b", 1, 0, None), ("b", 1, 0, 0.0)], DEMAND)
    y = {(r.network, r.mu, r.link_id): r.y for r in ld.load(diamond(spark), demand, (1.0, 2.0)).collect()}
    for mu in (1.0, 2.0):
        short = 10 / (1 + math.exp(-mu))
        assert [y["a", mu, e] for e in range(4)] == pytest.approx([short, 10 - short, short + 1, 10 - short])
        assert [y["b", mu, e] for e in range(4)] == [0.0] * 4


def test_values_sum_over_paths(spark):
    v = {(r.mu, r.node): r.value for r in ld.values(diamond(spark).where("network = 'a'"), (1.0, 2.0)).collect()}
    for mu in (1.0, 2.0):
        assert v[mu, 0] == 0 and v[mu, 3] == pytest.approx(-2 * mu) and v[mu, 1] == pytest.approx(np.logaddexp(-2 * mu, -3 * mu))


def test_load_refuses_a_missing_support_and_a_cycle(spark):
    with pytest.raises(ld.NoSupport, match="destination 7"):
        ld.load(diamond(spark), spark.createDataFrame([("a", 1, 7, 1.0)], DEMAND), (1.0,))
    back = spark.createDataFrame([("a", 0, 4, 2, 1, 1.0, 1.0, 2.0, None)], SUPPORT)
    with pytest.raises(ld.Cyclic):
        ld.load(diamond(spark).unionByName(back), spark.createDataFrame([("a", 1, 0, 1.0)], DEMAND), (1.0,))


def test_load_of_empty_tables(spark):
    none, nothing = spark.createDataFrame([], SUPPORT), spark.createDataFrame([], DEMAND)
    assert ld.load(none, nothing, (1.0,)).count() == 0 and ld.values(none, (1.0,)).count() == 0
    assert {r.y for r in ld.load(diamond(spark), nothing, (1.0,)).collect()} == {0.0}


def test_one_cycle(spark, rows):
    # a: 0 -> 1 -> 2 -> 0 with a way out and a way in that no cycle reaches; b: no cycle; c: a self-loop; d: two ways between two nodes
    links = [("a", 0, 0, 1), ("a", 1, 1, 2), ("a", 2, 2, 0), ("a", 3, 2, 3), ("a", 4, 9, 0), ("b", 0, 0, 1), ("c", 5, 4, 4), ("d", 0, 0, 1), ("d", 1, 1, 0)]
    got = rows(gr.one_cycle(spark.createDataFrame(links, LINK)))
    assert got == [("a", 0, 0, True), ("a", 0, 1, True), ("a", 0, 2, True), ("c", 4, 5, True), ("d", 0, 0, True), ("d", 0, 1, False)]
    assert gr.one_cycle(spark.createDataFrame([], LINK)).count() == 0


def test_representation_residuals(spark):
    flows = spark.createDataFrame([("n", 1.0, d, e, x) for d, e, x in [(1, 0, 4.0), (1, 1, 0.0), (2, 0, 8.0), (3, 0, 5.0), (3, 1, 2.0)]], "network string, mu double, deposit_id long, link_id int, x double")
    of = lambda d: flows.where(F.col("deposit_id") == d).select("network", "mu", "deposit_id").distinct()
    half = of(2).withColumn("weight", F.lit(0.5))
    r = fl.representation_residuals(flows, half, of(1), of(3)).first()
    # half of 8 and half of 4 are 6 on link 0; the target has 5 and 2
    assert (r.weight, r.residual) == (0.5, pytest.approx(2 / 5))
    r = fl.representation_residuals(flows, half.withColumn("weight", F.lit(None).cast("double")), of(1), of(1)).first()
    assert (r.weight, r.residual) == (0.0, 0.0)
    assert fl.representation_residuals(flows, half, of(1), of(9)).count() == 0


def test_comparison(spark):
    rows = [("a", m, 3 * m**2) for m in (0.5, 1.0, 2.0)] + [("b", 1.0, 0.0), ("b", 2.0, 5.0), ("c", 1.0, None)]
    margins = spark.createDataFrame([("a", 0.5, 7.0), ("a", 1.0, None), ("b", 9.0, 1.0)], "network string, mu double, margin double")
    got = {r.network: r for r in fl.comparison(spark.createDataFrame(rows, "network string, mu double, difference double"), margins).collect()}
    assert set(got) == {"a", "b"} and got["a"].slope == 2.0 and got["a"].r2 == 1.0 and got["a"].least_margin == got["a"].greatest_margin == 7.0
    assert (got["b"].n_cells, got["b"].first_difference, got["b"].last_difference, got["b"].slope, got["b"].least_margin) == (2, 0.0, 5.0, None, None)
