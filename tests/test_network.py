import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netweave.functions import costs
from netweave.operators import flows as fl
from netweave.operators import graph as gr
from netweave.operators import records as rc
from netweave.operators.kernels import Graph, Support, bpr, zone_demand
from netweave.plans import certificate, equilibrium, tied
from netweave.sources import sinks, tntp

SF = "/root/testdata/sf0.001"


@st.composite
def graphs(draw):
    n, z = draw(st.integers(3, 9)), draw(st.integers(1, 3))
    m = draw(st.integers(2, 22))
    ends = draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), min_size=m, max_size=m))
    cost = np.array(draw(st.lists(st.integers(0, 9), min_size=m, max_size=m)), float)
    tail, head = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
    zdc = bool(((tail < z) & (cost <= 0)).any())
    cost = np.where(tail >= z, np.maximum(cost, 1), cost)
    return Graph(n, z, tail, head, draw(st.booleans()) or zdc, zdc), cost


@settings(max_examples=80, deadline=None)
@given(graphs())
def test_kernels_keep_the_invariants(case):
    g, cost = case
    pi = g.potentials(cost)
    slow = np.full((g.n, g.z), np.inf)
    slow[np.arange(g.z), np.arange(g.z)] = 0
    for _ in range(g.n + 1):
        for e in range(len(cost)):
            for d in range(g.z):
                if not (g.no_thru and g.head[e] < g.z and g.head[e] != d):
                    slow[g.tail[e], d] = min(slow[g.tail[e], d], cost[e] + slow[g.head[e], d])
    assert np.array_equal(pi, slow)
    mask = g.support(pi)
    first = lambda *rules: next(said for meets, said in rules if meets)
    zone = lambda node: node < g.z
    for (e, d), got in np.ndenumerate(mask):
        tail, head = g.tail[e], g.head[e]
        cut_off = np.isinf(pi[tail, d]) or np.isinf(pi[head, d])
        assert got == first((cut_off or tail == d, False), (head == d, True), (g.no_thru and zone(head), False), (g.zdc and zone(tail), True), (True, pi[tail, d] > pi[head, d]))
    demand = np.where(np.isfinite(pi), zone_demand(g.n, g.z), 0.0)
    support = Support(g, mask, pi)
    assert not support.cyclic.any() and np.array_equal(support.mask, mask)
    p, value = support.chances(cost, pi, 1.0)
    # values by a dense solve, an independent way
    for d in range(g.z):
        a = np.zeros((g.n, g.n))
        np.add.at(a, (g.tail[mask[:, d]], g.head[mask[:, d]]), np.exp(-cost[mask[:, d]]))
        w = np.linalg.solve(np.eye(g.n) - a, np.eye(g.n)[d])
        seen = np.isfinite(value[:, d])
        assert np.allclose(np.log(w[seen]), value[seen, d], atol=1e-8)
    y = support.push(p, demand)
    net = np.bincount(g.tail, y, g.n) - np.bincount(g.head, y, g.n) - demand.sum(1)
    net[: g.z] += demand.sum(0)
    assert np.abs(net).max() < 1e-8


def test_a_cycle_of_connectors_is_reported_and_cut():
    # zones 0 and 1 lead to each other by free connectors, and zones are a way through
    g = Graph(3, 2, np.array([0, 1, 0, 2, 1]), np.array([2, 2, 1, 1, 0]), False, True)
    cost = np.array([0.0, 0.0, 5.0, 1.0, 5.0])
    g2 = Graph(4, 1, np.array([1, 2, 2, 3]), np.array([2, 1, 3, 0]), False, False)
    pi = g2.potentials(np.array([1.0, 1.0, 1.0, 1.0]))
    s = Support(g2, np.ones((4, 1), bool), pi)
    assert s.cyclic.all() and s.mask[:, 0].tolist() == [True, False, True, True]
    y, pi, support = g.load(cost, zone_demand(3, 2), 1.0)
    assert np.isfinite(y).all() and support.cyclic[0]


def test_cost_columns(spark):
    rows = [(x, 2.0, 10.0, 0.15, 4.0) for x in (None, float("nan"), -3.0, 0.0, 5.0, 10.0, 1e300)] + [(1.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, fft double, capacity double, b double, power double")
    got = df.select(costs.bpr_cost().alias("c"), costs.bpr_prime().alias("s")).collect()
    assert [r.c for r in got[:4]] == [2.0] * 4 and got[4].c == pytest.approx(2 * (1 + 0.15 / 16)) and got[5].c == pytest.approx(2.3)
    assert math.isfinite(got[6].c) and got[6].s == 0 and [r.s for r in got[:4]] == [0.0] * 4 and got[5].s == pytest.approx(0.12)
    xs = np.array([-1.0, 5.0, 10.0])
    assert np.allclose(bpr(xs, 2.0, 10.0, 0.15, 4.0), [2.0, got[4].c, got[5].c])
    assert [r.v for r in spark.range(14).select(costs.spelled(F.col("id")).alias("v")).collect()][-3:] == ["eleven", "twelve", "13"]


NET = "network string, n_zones int, n_nodes int, first_thru int, n_links int"
LINK = "network string, link_id int, tail int, head int, capacity double, fft double, b double, power double, cost double, x double"


def transit(spark):
    """Zones 0 and 1; the short way leads through zone 2, which is barred."""
    links = [(0, 2, 1.0), (2, 1, 1.0), (0, 3, 2.0), (3, 4, 2.0), (4, 1, 2.0)]
    net = spark.createDataFrame([("t", 3, 5, 4, 5)], NET)
    return net, spark.createDataFrame([("t", i, a, b, 100.0, c, 0.15, 4.0, c, 1.0) for i, (a, b, c) in enumerate(links)], LINK)


def test_transit_rule_and_two_forms_of_potentials(spark, rows):
    net, links = transit(spark)
    pi = gr.potentials(links, net)
    assert {(r.dest, r.node): r.pi for r in pi.collect()}[(1, 0)] == 6.0
    assert rows(pi) == rows(gr.potentials_by_rounds(links, net))
    y = {r.link_id: r.y for r in certificate.loads(links, net, (1.0,)).collect()}
    assert y[2] == pytest.approx(y[3]) == pytest.approx(y[4]) and y[2] == pytest.approx(10 * (1 + 13 % 10) / 3)
    g = gr.gaps(links, net)
    reach = gr.reached(gr.supports(g), gr.demand(net))
    m = gr.margin_table(g, reach).first()
    assert m.isolation <= (m.exclusion or math.inf) <= (m.path_excess or math.inf)
    assert gr.unreachable(net, pi).first().n_pairs == 3 and gr.cycle_links(links).count() == 0
    assert gr.tight_hops(g, net).first().most_hops == 3


def test_clean_flows_takes_the_last_written(spark, rows):
    ts = "timestamp_ntz"
    df = spark.sql(f"select * from values (1L, 'n', 1.0D, 0, 5.0D, {ts}'2025-01-01'), (1L, 'n', 1.0D, 0, double('nan'), {ts}'2025-01-02'), (1L, 'n', 1.0D, 1, null, {ts}'2025-01-02'), (1L, 'n', 1.0D, 2, -1e-9D, null), (1L, 'n', 1.0D, 3, 2.0D, null), (1L, 'n', 1.0D, 3, 2.0D, null) t(deposit_id, network, mu, link_id, x, written_at)")
    assert rows(fl.clean_flows(df), "link_id", "x") == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 2.0)]


def test_strict_certificate_of_its_own_load(spark):
    net, links = transit(spark)
    free = links.withColumn("b", F.lit(0.0))
    y = certificate.loads(free, net, (1.0,))
    flows = y.select(F.lit(1).cast("long").alias("deposit_id"), "network", "mu", "link_id", F.col("y").alias("x"))
    base = ["network", "link_id", "tail", "head", "capacity", "fft", "b", "power"]
    out = certificate.certify(flows, free.select(*base), net).first()
    assert out.reload_defect < 1e-9 and out.n_violations == 0
    half = flows.withColumn("x", F.when(F.col("link_id") == 3, F.col("x") / 2).otherwise(F.col("x")))
    assert certificate.certify(half, free.select(*base), net).first().verdict == "not conserved"


def test_unrestricted_load_against_a_dense_solve():
    r = np.random.default_rng(2)
    g = Graph(6, 2, r.integers(0, 6, 14), r.integers(0, 6, 14), False, False)
    cost, demand = r.uniform(2, 4, 14), zone_demand(6, 2)
    pi = g.potentials(cost)
    demand = np.where(np.isfinite(pi), demand, 0.0)
    want = np.zeros(14)
    for d in range(2):
        keep = (g.tail != d) & np.isfinite(pi[g.tail, d]) & np.isfinite(pi[g.head, d])
        a = np.zeros((6, 6))
        np.add.at(a, (g.tail[keep], g.head[keep]), np.exp(-cost[keep]))
        w = np.linalg.solve(np.eye(6) - a, np.eye(6)[d])
        p = np.where(keep & (w[g.tail] > 0), np.exp(-cost) * w[g.head] / np.where(w[g.tail] > 0, w[g.tail], 1), 0.0)
        b = np.zeros((6, 6))
        np.add.at(b, (g.head, g.tail), p)
        want += p * np.linalg.solve(np.eye(6) - b, demand[:, d])[g.tail]
    assert np.allclose(equilibrium.unrestricted_load(g, cost, demand, 1.0), want, atol=1e-6)


def test_a_cell_is_solved_and_tilts_agree(spark):
    net, links = transit(spark)
    flows = spark.createDataFrame([(1, "t", 2.0, i, 1.0) for i in range(5)], "deposit_id long, network string, mu double, link_id int, x double")
    out = equilibrium.solve(flows, links, net).first()
    assert out.solved and out.residual < 1e-10 and out.support_holds
    assert equilibrium.solution_set(flows, links, net).first().flow_diameter < 1e-6
    y = certificate.loads(links, net, (1.0,))
    assert equilibrium.recovered_dispersion(links, net, y).count() == 1


def test_inclusion_sees_slow_alternation_and_says_when_it_is_not_settled():
    masks = np.array([[True, True, False], [True, False, True]])

    def run(rounds, window, same_windows=None, fresh=False):
        calls = [0]

        def load(x):
            calls[0] += 1
            mask = np.array([int(b) for b in f"{calls[0]:012b}"], bool) if fresh else masks[calls[0] // 40 % 2]
            return np.array([1.0, calls[0] % 7]), mask

        return equilibrium.included(load, np.zeros(2), rounds, window, same_windows)

    slow = run(1000, 300)
    assert (slow["n_supports"], slow["n_contested"], slow["n_base"], slow["stopped_on"], slow["iterations"]) == (2, 2, 1, "support set settled", 340)
    assert run(25, 300)["stopped_on"] == "not settled yet" and not run(25, 300)["settled"]
    new = run(700, 300, fresh=True)
    assert (new["settled"], new["iterations"], new["n_supports"], new["n_supports_seen"]) == (False, 700, 300, 700)
    assert run(1000, 80, 2)["stopped_on"] in ("envelope settled", "support set settled")
    still = equilibrium.included(lambda x: (np.ones(2), masks[0]), np.zeros(2), 50, 300)
    assert still["stopped_on"] == "flow tolerance" and still["iterations"] == 2


def test_claimed_support_violations(spark, rows):
    net, links = transit(spark)
    g = gr.gaps(links, net)
    full = links.select("network", F.lit(1.0).alias("mu"), "link_id", "x")
    bad = gr.claimed(g, full.where("link_id <> 3"))
    assert (1, 3) in rows(bad, "dest", "link_id")
    assert gr.admissibility(bad).first().n_violations == bad.count() and gr.violating_pairs(bad).count() >= 1


def test_nested_atoms_reproduce_their_weights(spark, rows):
    w = spark.createDataFrame([(1, 0, "tied", 1, 5, 0.75), (1, 0, "tied", 2, 6, 0.25), (1, 0, "base", 1, None, 0.1), (1, 0, "tied", 3, 7, 1.5)], "record_id long, face_pos int, kind string, dest long, link long, weight double")
    assert rows(tied.nested_atoms(w), "n_admitted", "mass") == [(0, 0.25), (1, 0.5), (2, 0.25)]
    m = tied.marginals(w).first()
    assert (m.total_mass, m.admitted, m.ring_slack) == (1.0, 1.0, 0.0)


def test_text_networks(spark, tmp_path, rows):
    (tmp_path / "A_net.tntp").write_text("<NUMBER OF ZONES> 2\n<NUMBER OF NODES> 4\n<FIRST THRU NODE> 1\n<NUMBER OF LINKS> 3\n<END OF METADATA>\n\n~ init term cap len fft b power\n\t1\t3\t100\t1\t0.5\t0.15\t4\t0 ;\n3 4 50 1 0.01 0.15;\nbroken line ;\n4 2 1e3 1 2 0.2 16.83 ;\n")
    (tmp_path / "A_trips.tntp").write_text("<NUMBER OF ZONES> 2\n<END OF METADATA>\nOrigin 1\n 1 : 0.0; 2 : 10.5;\n 2 : 11.0;\nOrigin  2 \n 1 : 3; 9 : 4;\n")
    net = tntp.read_networks(spark, str(tmp_path / "A_net.tntp"))
    assert rows(net) == [("A", 2, 4, 1, 3)]
    links = tntp.read_links(spark, str(tmp_path / "A_net.tntp"), net, fft_floor=0.1)
    assert rows(links) == [("A", 0, 0, 2, 100.0, 0.5, 0.15, 4.0), ("A", 1, 2, 3, 50.0, 0.1, 0.15, 4.0), ("A", 2, 3, 1, 1000.0, 2.0, 0.2, 16.83)]
    assert rows(tntp.read_demand(spark, str(tmp_path / "A_trips.tntp"), net)) == [("A", 0, 0, 0.0), ("A", 0, 1, 11.0), ("A", 1, 0, 3.0)]


def test_sinks_and_fingerprints(spark, tmp_path):
    df = spark.sql("select 'e' exhibit, 1.0D mu, double('nan') residual, sequence(1, 100) a, array(1) b")
    root = f"file://{tmp_path}/sink"
    sinks.write_sink(df, root, stamp={"version": "9"})
    r = sinks.read_sink(spark, root, "exhibit string, mu double, residual double, a string, b string, version string, later string").first()
    assert r.residual is None and '"array_shape":100' in r.a and r.b == "[1]" and r.version == "9" and r.later is None
    (tmp_path / "f").write_bytes(b"abc")
    assert sinks.fingerprints(spark, str(tmp_path), "f").first().digest == "ba7816bf8f01cfea"


def test_latest_record_wins(spark, rows):
    df = spark.sql("select * from values ('a', 1.0D, 5L, timestamp_ntz'2025-01-01', null), ('a', 1.0D, 4L, timestamp_ntz'2025-01-02', 'x'), ('a', 1.0D, 9L, null, 'y') t(network, mu, record_id, recorded_at, note)")
    assert rows(rc.latest(df), "record_id", "note") == [(4, "x")]


def test_rounds_that_run_out_give_no_partial_answer(spark):
    net = spark.createDataFrame([("n", 1, 6, None)], "network string, n_zones int, n_nodes int, first_thru int")
    chain = spark.createDataFrame([("n", i, i + 1, i, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0) for i in range(5)], "network string, link_id int, tail int, head int, cost double, capacity double, fft double, b double, power double, x double")
    assert gr.potentials_by_rounds(chain, net, max_rounds=6).count() == 6
    g = spark.createDataFrame([("n", 0, i + 1, i, 1.0, 1.0) for i in range(5)], "network string, dest int, tail int, head int, cost double, gap double")
    wanted = spark.createDataFrame([("n", 5, 0)], "network string, origin int, dest int")
    ring = chain.limit(0).unionByName(spark.createDataFrame([("n", i, i, i + 1, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0) for i in range(4)], chain.schema))
    assert gr.reached(g, wanted, max_rounds=6).count() == 6 and gr.cycle_links(ring, max_rounds=6).count() == 0
    for run in (lambda: gr.potentials_by_rounds(chain, net, max_rounds=2), lambda: gr.reached(g, wanted, max_rounds=2), lambda: gr.cycle_links(ring, max_rounds=2), lambda: gr.tight_hops(g, net, max_rounds=2)):
        with pytest.raises(gr.Unfinished):
            run()


def test_cycle_links_are_those_on_a_cycle_or_reached_by_one(spark):
    rows = [(0, 0, 1), (1, 1, 2), (2, 2, 0), (3, 2, 3), (4, 3, 4), (5, 5, 0), (6, 6, 6)]
    links = spark.createDataFrame([("n", *r) for r in rows], "network string, link_id int, tail int, head int")
    assert sorted(r.link_id for r in gr.cycle_links(links).collect()) == [0, 1, 2, 3, 4, 6]
    assert gr.cycle_links(links.limit(0)).count() == 0


def test_matched_files_catalog_and_selection(spark, rows, tmp_path):
    head = "<NUMBER OF ZONES> {z}\n<NUMBER OF NODES> 4\n<FIRST THRU NODE> 1\n<NUMBER OF LINKS> {n}\n<END OF METADATA>\n"
    for name, zones, origin, n in (("A", 2, 1, 3), ("B", 3, 1, 9), ("C", 2, 77, 3), ("_D", 2, 1, 3)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_net.tntp").write_text(head.format(z=2, n=n) + "1 3 100 1 0.5 0.15 4 ;\n")
        (tmp_path / name / f"{name}_trips.tntp").write_text(f"<NUMBER OF ZONES> {zones}\n<END OF METADATA>\nOrigin {origin}\n 2 : 5.0; 9 : 1;\n")
    (tmp_path / "E").mkdir()
    (tmp_path / "E" / "E_net.tntp").write_text(head.format(z=2, n=3))
    cat = tntp.catalog(spark, str(tmp_path))
    assert rows(cat, "name") == [("A",), ("B",), ("C",)]
    net, links, demand = tntp.load_named(spark, str(tmp_path), "A")
    assert net.first().n_zones == 2 and links.count() == 1 and rows(demand) == [("A", 0, 1, 5.0)]
    for name in "BC":
        with pytest.raises(tntp.Mismatch):
            tntp.load_named(spark, str(tmp_path), name)
    networks = tntp.read_networks(spark, str(tmp_path / "[ABC]" / "*_net.tntp"))
    assert rows(tntp.select(cat, max_links=3, networks=networks), "name") == [("A",), ("C",)]
    assert rows(tntp.select(cat, ["B", " A"]), "name") == [("A",), ("B",)]
    with pytest.raises(KeyError):
        tntp.select(cat, ["A", "Z"])


def test_network_report_warns(spark):
    net = spark.createDataFrame([("n", 2, 5, None), ("empty", 0, 0, None)], "network string, n_zones int, n_nodes int, first_thru int")
    links = spark.createDataFrame([("n", 0, 0, 2, 0.0, 1.0, 0.1, 60.0), ("n", 1, 2, 2, 1.0, 0.0, 0.1, 4.0)], "network string, link_id int, tail int, head int, capacity double, fft double, b double, power double")
    lost = spark.createDataFrame([("n", 2, 20.0), ("empty", 0, 0.0)], "network string, n_pairs long, lost double")
    r = {x.network: x for x in gr.network_report(links, net, lost).collect()}
    assert (r["n"].zero_capacity, r["n"].self_loops, r["n"].isolated_nodes, r["n"].zero_free_flow, r["n"].unit_capacity) == (1, 1, 3, 1, 1)
    assert r["n"].warnings == "demand lost; zero capacities; self-loops; costs stand still at ordinary ratios" and r["empty"].warnings == "no demand"


def test_top_contested_ages_and_faces(spark, rows):
    contested = spark.createDataFrame([("n", 1.0, i, s) for i, s in ((0, 1), (1, 3), (2, 3), (3, 2), (4, 1), (5, 1))], "network string, mu double, link_id int, n_supports long")
    assert rows(fl.contested_top(contested, 4), "place", "link_id") == [(1, 1), (2, 2), (3, 3), (4, 0)]
    links = spark.createDataFrame([("n", i, i % 2, (i + 1) % 2) for i in range(6)], "network string, link_id int, tail int, head int")
    assert rows(fl.face_sizes(contested, links)) == [("n", 1.0, 6, 1)]
    at = lambda d: f"timestamp_ntz'2025-01-0{d} 00:00:00'"
    manifest = spark.range(1, 5).selectExpr("id as entry_id", "timestampadd(DAY, id, " + at(1) + ") as listed_at")
    flows = spark.createDataFrame([(d, "n", 1.0, link, 1.0) for d, held in ((1, [0]), (2, [0, 1]), (3, [0]), (4, [0])) for link in held], "deposit_id long, network string, mu double, link_id int, x double")
    assert rows(fl.support_ages(flows, manifest)) == [("n", 1.0, 2, 2, 2)]
