"""Graph operators over congested links: flags, prefix sums, potentials, supports, margins, reach and cycles.

Costs are those of the mean deposited flow, so the work of every query follows the flows table. Potentials come in two
forms with one contract (network, dest, node, pi; a missing row is an infinite potential): rounds of join and aggregation
that stop at the fixed point, and a grouped kernel per network. Everything after them is joins and aggregations.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.costs import NUDGE, bpr_cost, exact_sum
from netweave.operators.kernels import Graph
from netweave.session import cut, spread

#: Gaps within this are ties, and a link lies on a least path within that of zero slack.
TIE, COST_MINIMAL = 1e-10, 1e-6


def congested(flows: DataFrame, links: DataFrame) -> DataFrame:
    """All links with the mean deposited flow x (0 without one, at most the capacity) and its cost, to six digits.

    Deposits far above capacity have costs beyond all bounds; held at capacity, costs stay comparable along a path.
    """
    means = flows.groupBy("network", "link_id").agg((exact_sum(F.col("x")) / F.count("*")).alias("x"))
    both = links.join(means, ["network", "link_id"], "left").withColumn("x", F.round(F.least(F.coalesce("x", F.lit(0.0)), "capacity") + NUDGE, 6))
    return both.withColumn("cost", F.round(bpr_cost(), 6))


def flags(links: DataFrame, networks: DataFrame) -> DataFrame:
    """Per network: whether a zone has a free connector, and whether zones are no way through."""
    both = links.join(networks.select("network", "n_zones", "n_nodes", "first_thru"), "network")
    out = both.groupBy("network", "n_zones", "n_nodes", "first_thru").agg(F.bool_or((F.col("tail") < F.col("n_zones")) & (F.col("fft") <= 0)).alias("zero_connectors"))
    return out.select("network", "n_zones", "n_nodes", "zero_connectors", F.coalesce(F.col("first_thru") > 1, "zero_connectors").alias("no_thru"))


def flagged(links: DataFrame, networks: DataFrame) -> DataFrame:
    return links.join(flags(links, networks), "network")


def csr(links: DataFrame) -> DataFrame:
    """Place of each link in its tail's adjacency, and the tail's offset within the network."""
    at = F.row_number().over(Window.partitionBy("network").orderBy("tail", "link_id")) - 1
    placed = links.select("network", "link_id", "tail", at.alias("place"))
    return placed.withColumn("offset", F.min("place").over(Window.partitionBy("network", "tail")))


def parallel_least(links: DataFrame) -> DataFrame:
    """The cheapest of parallel links, with their number."""
    return links.groupBy("network", "tail", "head").agg(F.min(F.struct("cost", "link_id")).alias("m"), F.count("*").alias("n_parallel")).select(
        "network", "tail", "head", F.col("m.cost").alias("cost"), F.col("m.link_id").alias("link_id"), "n_parallel")


def densified(links: DataFrame) -> DataFrame:
    """Used node ids of each network, renumbered from 0 in their order."""
    ends = links.where("x > 0").select("network", F.explode(F.array("tail", "head")).alias("node")).distinct()
    return ends.select("network", "node", (F.row_number().over(Window.partitionBy("network").orderBy("node")) - 1).alias("dense_id"))


def opposite_groups(links: DataFrame) -> DataFrame:
    """Links between the same two nodes, both ways: the lowest id is forward."""
    return links.where("tail <> head").groupBy("network", F.least("tail", "head").alias("a"), F.greatest("tail", "head").alias("b")).agg(
        F.count("*").alias("n_links"), F.min("link_id").alias("forward"), F.concat_ws(",", F.sort_array(F.collect_list(F.format_string("%04d", F.col("link_id"))))).alias("members"), (F.countDistinct("tail") == 2).alias("both_ways"))


def demand(networks: DataFrame) -> DataFrame:
    """Demand between each two zones of a network, by a fixed rule; none within a zone."""
    zones = F.sequence(F.lit(0), F.col("n_zones") - 1)
    pairs = networks.where("n_zones > 0").select("network", "n_zones", F.explode(zones).alias("origin")).withColumn("dest", F.explode(F.sequence(F.lit(0), F.col("n_zones") - 1)))
    amount = 10.0 * (1 + (F.col("origin") * 7 + F.col("dest") * 13) % 10) / F.col("n_zones")
    return pairs.where("origin <> dest").select("network", "origin", "dest", amount.alias("demand"))


class Unfinished(RuntimeError):
    """Rounds ran out before the fixed point; no partial answer is given."""


def potentials_by_rounds(links: DataFrame, networks: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Least cost from each node to each zone, as rounds of join and aggregation until nothing changes.

    A round only extends the rows that the last round improved, and drops what isn't better than what is known. Costs
    aren't negative, so as many rounds as the longest least path has links are enough; more than max_rounds raise.
    """
    edges = flagged(links, networks).select("network", "tail", "head", "cost", (F.col("no_thru") & (F.col("head") < F.col("n_zones"))).alias("zone_head"))
    edges = cut(edges, "edges")
    known = cut(networks.where("n_zones > 0").select("network", F.explode(F.sequence(F.lit(0), F.col("n_zones") - 1)).alias("dest")).select("network", "dest", F.col("dest").alias("node"), F.lit(0.0).alias("pi"), F.lit(True).alias("new")), "pi")
    for _ in range(max_rounds):
        front = known.where("new").select("network", "dest", F.col("node").alias("head"), "pi")
        steps = front.join(edges, ["network", "head"]).where("not zone_head or head = dest").select("network", "dest", F.col("tail").alias("node"), (F.col("cost") + F.col("pi")).alias("pi"), F.lit(True).alias("new"))
        best = known.withColumn("new", F.lit(False)).unionByName(steps).groupBy("network", "dest", "node").agg(F.min(F.struct("pi", "new")).alias("m"))
        known = cut(best.select("network", "dest", "node", "m.pi", "m.new"), "pi")
        if known.where("new").isEmpty():
            return known.drop("new")
    raise Unfinished(f"potentials still fall after {max_rounds} rounds")


def potentials(links: DataFrame, networks: DataFrame) -> DataFrame:
    """The same table by a kernel per network; networks are the groups, so tasks hold one network's matrix each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        first = rows.iloc[0]
        g = Graph(int(first.n_nodes), int(first.n_zones), rows["tail"].to_numpy(), rows["head"].to_numpy(), bool(first.no_thru), bool(first.zero_connectors))
        pi = g.potentials(rows["cost"].to_numpy())
        node, dest = pi.shape
        out = pd.DataFrame({"network": first.network, "dest": list(range(dest)) * node, "node": [n for n in range(node) for _ in range(dest)], "pi": pi.reshape(-1)})
        return out[out["pi"] < float("inf")]

    rows = flagged(links, networks).select("network", "link_id", "tail", "head", "cost", "n_nodes", "n_zones", "no_thru", "zero_connectors")
    return spread(rows, "network").groupBy("network").applyInPandas(run, "network string, dest int, node int, pi double")


def gaps(links: DataFrame, networks: DataFrame, pi: DataFrame | None = None) -> DataFrame:
    """Links x destinations with both potentials finite: gap = pi(tail) - pi(head), and the flags."""
    pi = cut(pi if pi is not None else potentials(links, networks), "pi")
    rows = flagged(links, networks)
    at_tail = pi.select("network", F.col("node").alias("tail"), "dest", F.col("pi").alias("pi_tail"))
    at_head = pi.select("network", F.col("node").alias("head"), "dest", F.col("pi").alias("pi_head"))
    return rows.join(at_tail, ["network", "tail"]).join(at_head, ["network", "head", "dest"]).withColumn("gap", F.col("pi_tail") - F.col("pi_head"))


def efficient() -> Column:
    """Whether a link belongs to the destination's support; the first rule that speaks wins."""
    return (
        F.when(F.col("tail") == F.col("dest"), False).when(F.col("head") == F.col("dest"), True).when(F.col("no_thru") & (F.col("head") < F.col("n_zones")), False)
        .when(F.col("zero_connectors") & (F.col("tail") < F.col("n_zones")), True).otherwise(F.col("gap") > 0)
    )


def eligible() -> Column:
    """Links whose membership the potentials decide, rather than a rule."""
    zone = lambda c: F.col(c) < F.col("n_zones")
    return (F.col("tail") != F.col("dest")) & (F.col("head") != F.col("dest")) & ~(F.col("no_thru") & zone("head")) & ~(F.col("zero_connectors") & zone("tail"))


def supports(g: DataFrame) -> DataFrame:
    return g.where(efficient()).select("network", "dest", "link_id", "tail", "head", "cost")


def support_sizes(g: DataFrame) -> DataFrame:
    return g.groupBy("network", "dest").agg(F.count_if(efficient()).alias("n_support"), F.count_if(eligible()).alias("n_eligible"))


def reached(support: DataFrame, wanted: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Nodes that flow can occupy: from demanded origins along the support, in rounds until nothing is new."""
    support = cut(support.select("network", "dest", "tail", "head"), "support")
    known = cut(wanted.select("network", "dest", F.col("origin").alias("node")).distinct().withColumn("new", F.lit(True)), "reach")
    for _ in range(max_rounds):
        steps = known.where("new").select("network", "dest", F.col("node").alias("tail")).join(support, ["network", "dest", "tail"]).select("network", "dest", F.col("head").alias("node"), F.lit(True).alias("new"))
        both = known.withColumn("new", F.lit(False)).unionByName(steps)
        known = cut(both.groupBy("network", "dest", "node").agg(F.min("new").alias("new")), "reach")
        if known.where("new").isEmpty():
            return known.drop("new")
    raise Unfinished(f"new nodes are still reached after {max_rounds} rounds")


def margin_table(g: DataFrame, reach: DataFrame, tolerance: float = TIE) -> DataFrame:
    """Isolation, exclusion and path-excess margins per network; null where no link decides them."""
    e = g.where(eligible()).select("network", "dest", "tail", "gap").join(reach.select("network", "dest", F.col("node").alias("tail"), F.lit(True).alias("occupied")), ["network", "dest", "tail"], "left")
    out = F.col("gap") < -tolerance
    least = lambda c: F.round(F.min(F.when(c, F.abs("gap"))), 6)
    return e.groupBy("network").agg(least(F.lit(True)).alias("isolation"), least(out).alias("exclusion"), least(out & F.coalesce("occupied", F.lit(False))).alias("path_excess"), F.count_if(F.abs("gap") <= tolerance).alias("n_ties"))


def tie_inventory(g: DataFrame, tolerance: float = COST_MINIMAL) -> DataFrame:
    """Per network: tied pairs, distinct tied links, excluded pairs, pairs per link, and the least cost among tied links."""
    e = g.where(eligible())
    tied = F.abs("gap") <= tolerance
    return e.groupBy("network").agg(
        F.count_if(tied).alias("n_tied_pairs"), F.count_distinct(F.when(tied, F.col("link_id"))).alias("n_tied_links"), F.count_if(F.col("gap") < -tolerance).alias("n_excluded"),
        F.round(F.count_if(tied) / F.nullif(F.count_distinct(F.when(tied, F.col("link_id"))), F.lit(0)), 6).alias("pairs_per_link"), F.min(F.when(tied, F.col("cost"))).alias("least_tied_cost"),
    )


def unreachable(networks: DataFrame, pi: DataFrame) -> DataFrame:
    """Per network the demand that no way serves: an anti-join of demand with potentials."""
    lost = demand(networks).join(pi.select("network", F.col("node").alias("origin"), "dest"), ["network", "origin", "dest"], "left_anti")
    return networks.select("network").join(lost.groupBy("network").agg(F.count("*").alias("n_pairs"), exact_sum(F.col("demand")).alias("lost")), "network", "left").na.fill(0)


def cycle_links(links: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Links on a directed cycle, or between nodes that a cycle reaches; a self-loop is a cycle.

    Nodes that no link enters are stripped with their links, in rounds, until every node that is left is entered.
    """
    left = cut(links.select("network", "link_id", "tail", "head"), "cycle")
    n = left.count()
    for _ in range(max_rounds):
        left = cut(left.join(left.select("network", F.col("head").alias("tail")).distinct(), ["network", "tail"], "left_semi"), "cycle")
        m = left.count()
        if m == n:
            return left.select("network", "link_id")
        n = m
    raise Unfinished(f"links are still stripped after {max_rounds} rounds")


def tight_hops(g: DataFrame, networks: DataFrame, tolerance: float = COST_MINIMAL, max_rounds: int = 100_000) -> DataFrame:
    """Per network the most hops of a least-cost path between two zones, over links of positive gap without slack."""
    tight = cut(g.where((F.abs(F.col("cost") - F.col("gap")) <= tolerance) & (F.col("gap") > tolerance) & (F.col("tail") != F.col("dest"))).select("network", "dest", "tail", "head"), "tight")
    front = networks.where("n_zones > 0").select("network", F.explode(F.sequence(F.lit(0), F.col("n_zones") - 1)).alias("dest")).withColumn("head", F.col("dest"))
    reach = front.select("network", "dest", F.col("head").alias("node"), F.lit(0).alias("hops"))
    front = cut(front, "front")
    for hop in range(1, max_rounds + 2):
        if hop > max_rounds:
            raise Unfinished(f"paths still grow after {max_rounds} hops")
        front = cut(front.join(tight, ["network", "dest", "head"]).select("network", "dest", F.col("tail").alias("head")).distinct(), "front")
        if front.isEmpty():
            break
        reach = reach.unionByName(front.select("network", "dest", F.col("head").alias("node"), F.lit(hop).alias("hops")))
    zones = reach.join(networks.select("network", "n_zones"), "network").where(F.col("node") < F.col("n_zones"))
    return zones.groupBy("network").agg(F.max("hops").alias("most_hops"))


def claimed(g: DataFrame, used: DataFrame, tolerance: float = TIE) -> DataFrame:
    """Links x destinations x cells where the links that a cell uses (network, mu, link_id, x) aren't an admissible support.

    Strictly efficient and forced links must be in it; a link in it must not be strictly inefficient.
    """
    cells = used.select("network", "mu").distinct()
    all_ = g.drop("x").join(cells, "network").join(used.select("network", "mu", "link_id", "x"), ["network", "mu", "link_id"], "left")
    zone = lambda c: F.col(c) < F.col("n_zones")
    open_ = ~(F.col("no_thru") & zone("head") & (F.col("head") != F.col("dest")))
    away = F.col("tail") != F.col("dest")
    forced = away & ((F.col("head") == F.col("dest")) | (F.col("zero_connectors") & zone("tail") & open_))
    strict = ((F.col("gap") > tolerance) & away & open_) | forced
    closed = ((F.col("gap") >= -tolerance) & away & open_) | forced
    inside = F.col("x").isNotNull()
    return all_.where((strict & ~inside) | (inside & ~closed)).select("network", "mu", "dest", "link_id", "gap", F.coalesce("x", F.lit(0.0)).alias("x"))


def admissibility(bad: DataFrame) -> DataFrame:
    """Per cell: violations, the worst gap and the largest flow among them."""
    return bad.groupBy("network", "mu").agg(F.count("*").alias("n_violations"), F.round(F.max(F.abs("gap")), 6).alias("worst_gap"), F.round(F.max("x"), 6).alias("worst_flow"))


def violating_pairs(bad: DataFrame) -> DataFrame:
    """Per cell and link: how many destinations it violates, and the destination with the widest gap."""
    worst = F.max(F.struct(F.round(F.abs("gap"), 6).alias("gap"), (-F.col("dest")).alias("dest")))
    return bad.groupBy("network", "mu", "link_id").agg(F.count("*").alias("n_destinations"), worst.alias("w")).select("network", "mu", "link_id", "n_destinations", F.col("w.gap").alias("worst_gap"), (-F.col("w.dest")).alias("worst_dest"))


#: Limits of the pre-flight report. Capacities at most LEAST_CAPACITY count as none; above the load ratio at
#: which ratio ** power leaves a double's range (10 ** (DECADES / power)) costs stand still.
LEAST_CAPACITY, DECADES, MOST_EMPTY, MOST_LOST, MOST_UNIT, STEEP, ORDINARY_RATIO = 1e-9, 250.0, 0.01, 0.001, 0.5, 10.0, 1e6


def network_report(links: DataFrame, networks: DataFrame, lost: DataFrame) -> DataFrame:
    """Per network what is degenerate in it, with a warning for each limit passed; lost: network, n_pairs, lost.

    Isolated nodes are those that no link touches. A network without links has zero counts and null extrema.
    """
    ends = links.select("network", F.explode(F.array("tail", "head")).alias("node")).distinct().groupBy("network").agg(F.count("*").alias("touched"))
    counts = links.groupBy("network").agg(
        F.count("*").alias("found_links"), F.count_if(F.col("capacity") <= LEAST_CAPACITY).alias("zero_capacity"), F.count_if(F.col("capacity") == 1.0).alias("unit_capacity"),
        F.count_if(F.col("fft") <= 0).alias("zero_free_flow"), F.count_if(F.col("tail") == F.col("head")).alias("self_loops"), F.max("power").alias("max_power"))
    total = demand(networks).groupBy("network").agg(exact_sum(F.col("demand")).alias("demand"))
    all_ = networks.select("network", "n_nodes", "n_zones").join(counts, "network", "left").join(ends, "network", "left").join(lost, "network", "left").join(total, "network", "left")
    numbers = ["found_links", "zero_capacity", "unit_capacity", "zero_free_flow", "self_loops", "touched", "n_pairs", "lost", "demand"]
    all_ = all_.na.fill(0, numbers).withColumn("isolated_nodes", F.col("n_nodes") - F.col("touched")).withColumn("clamp_ratio", F.when(F.col("max_power") > 0, F.round(DECADES / F.col("max_power"), 6)))
    warnings = F.array_compact(F.array(
        F.when(F.col("demand") <= 0, "no demand"), F.when(F.col("lost") > MOST_LOST * F.col("demand"), "demand lost"), F.when(F.col("zero_capacity") > MOST_EMPTY * F.col("found_links"), "zero capacities"),
        F.when(F.col("self_loops") > 0, "self-loops"), F.when((F.col("unit_capacity") > MOST_UNIT * F.col("found_links")) & (F.col("max_power") > STEEP), "unit capacities under a steep exponent"),
        F.when(F.col("clamp_ratio") < F.log10(F.lit(ORDINARY_RATIO)), "costs stand still at ordinary ratios")))
    return all_.select("network", "n_nodes", "n_zones", F.col("found_links").alias("n_links"), "zero_capacity", "unit_capacity", "zero_free_flow", "self_loops", "isolated_nodes", F.col("n_pairs").alias("lost_pairs"),
                       "lost", "max_power", F.col("clamp_ratio").alias("clamp_decades"), F.array_join(warnings, "; ").alias("warnings"))


def one_cycle(links: DataFrame, max_doublings: int = 62) -> DataFrame:
    """Directed cycles that show why a set of links isn't acyclic: network, cycle (its least node), link_id, uses_forward.

    Of what cycle_links leaves, each node is entered by the link of least id; going back along those links from any node
    ends in a cycle, at least one in each network that has one. Steps back are doubled in each round, so that the rounds
    are the logarithm of the number of nodes. A link is forward if it has the least id of those between its two nodes.
    Networks without a cycle have no row.
    """
    left = cut(links.select("network", "link_id", "tail", "head").join(cycle_links(links), ["network", "link_id"], "left_semi"), "core")
    enter = left.groupBy("network", F.col("head").alias("node")).agg(F.min(F.struct("link_id", "tail")).alias("m")).select("network", "node", F.col("m.link_id").alias("link_id"), F.col("m.tail").alias("before"))
    enter = cut(enter, "enter")
    jump = enter.select("network", "node", F.col("before").alias("to"), F.least("node", "before").alias("low"))
    n = enter.groupBy("network").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(min(n.bit_length(), max_doublings)):
        far = jump.select("network", F.col("node").alias("to"), F.col("to").alias("further"), F.col("low").alias("far_low"))
        jump = cut(jump.join(far, ["network", "to"]).select("network", "node", F.col("further").alias("to"), F.least("low", "far_low").alias("low")), "jump")
    on_cycle = jump.select("network", F.col("to").alias("node")).distinct()
    rows = enter.join(on_cycle, ["network", "node"], "left_semi").join(jump.select("network", "node", F.col("low").alias("cycle")), ["network", "node"])
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    forward = links.groupBy("network", *pair("tail", "head")).agg(F.min("link_id").alias("forward"))
    return rows.select("network", "cycle", "link_id", *pair("node", "before")).join(forward, ["network", "a", "b"]).select("network", "cycle", "link_id", (F.col("link_id") == F.col("forward")).alias("uses_forward"))
