"""The registered queries of flows, graphs and records, with the same results in SQL where SQL can express them.

All read the flow deposits or the result records, whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.core.nested import flatten_tied
from netweave.core.queries import TIED_SQL
from netweave.functions.costs import NUDGE
from netweave.operators import flows as fl
from netweave.operators import graph as gr
from netweave.operators import loading as ld
from netweave.operators import records as rc
from netweave.plans import certificate, equilibrium, tied
from netweave.session import cut, table
from netweave.sources import sinks
from netweave.streaming import records as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, cleaned where a query needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def clean(self) -> DataFrame:
        return fl.clean_flows(self.flows)

    @property
    def congested(self) -> DataFrame:
        return cut(gr.congested(self.clean, self.links), "congested")

    @property
    def gaps(self) -> DataFrame:
        return gr.gaps(self.congested, self.networks)


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- deposited flows -----------------------------------------------------------------------------------------

_CLEAN = """
clean as (select deposit_id, network, mu, link_id, greatest(coalesce(case when isnan(x) then null else x end, 0), 0) as x from
  (select *, row_number() over (partition by deposit_id, network, mu, link_id order by written_at desc nulls last, coalesce(case when isnan(x) then null else x end, 0) desc) rn from flows) where rn = 1)"""
_R = "greatest(x / greatest(capacity, 1e-9), 0)"
_CAP = "pow(10.0, 250 / greatest(power, 1e-12))"
_COST = f"(fft * (1 + b * pow(least({_R}, {_CAP}), power)))"
_SLOPE = f"(case when {_R} > 0 and {_R} < {_CAP} then fft * b * power * pow({_R}, power - 1) / greatest(capacity, 1e-9) else 0 end)"
_DECADES = "case when {0} > 0 then round(log10({0}), 6) end"
_STEPS = """
steps as (select *, row_number() over (partition by network, mu order by listed_at, deposit_id) k from
  (select distinct c.deposit_id, c.network, c.mu, m.listed_at from clean c join flows_manifest m on c.deposit_id = m.entry_id))"""

_query("clean_flows", f"with {_CLEAN} select deposit_id, link_id, round(x, 6) x from clean")(lambda t: t.clean.select("deposit_id", "link_id", F.round("x", 6).alias("x")))
_query(
    "bpr_cost",
    f"with {_CLEAN} select deposit_id, link_id, {_DECADES.format(_COST)} as cost, {_DECADES.format(_SLOPE)} as slope, {_DECADES.format(_CAP)} as ratio_cap from clean join links using (network, link_id)",
)(lambda t: fl.link_costs(t.clean, t.links))
_query(
    "deposit_costs",
    f"""with {_CLEAN}, v as (select *, {_COST} as cost, {_SLOPE} as slope from clean join links using (network, link_id))
select deposit_id, count(*) n_links, {_DECADES.format("sum(x * cost)")} total_time, count_if(x > capacity) n_over_capacity, count_if(slope <= 0 and x > 0 and fft <= 0) n_flat_connectors,
count_if(slope <= 0 and x > 0 and fft > 0) n_flat_links, {_DECADES.format("min(slope) filter (slope > 0)")} least_slope from v group by 1""",
)(lambda t: fl.deposit_costs(t.clean, t.links))
_query(
    "conservation",
    f"""with {_CLEAN}, e as (select deposit_id, network, tail node, x from clean join links using (network, link_id) union all select deposit_id, network, head, -x from clean join links using (network, link_id)),
n as (select deposit_id, network, node, sum(round(x, 6)::decimal(28,6))::double net from e group by all), m as (select n.*, node >= n_zones through from n join networks using (network))
select deposit_id, coalesce(max(abs(net)) filter (through), 0) worst_imbalance, coalesce(sum(round(abs(net), 6)::decimal(28,6)) filter (through), 0)::double summed_imbalance,
coalesce(sum(round(net, 6)::decimal(28,6)) filter (not through and net > 0), 0)::double produced from m group by 1""",
)(lambda t: fl.conservation(t.clean, t.links, t.networks))
_query(
    "latest_flows",
    f"with {_CLEAN}, {_STEPS} select deposit_id, network, mu, link_id, round(x, 6) x from clean where deposit_id in (select arg_max(deposit_id, k) from steps group by network, mu)",
)(lambda t: fl.latest_flows(t.flows, t.flows_manifest).select("deposit_id", "network", "mu", "link_id", F.round("x", 6).alias("x")))
_SQ = "sqrt(sum(round(({0}) * ({0}), 6)::decimal(28,6))::double)"
_query(
    "relative_gap",
    f"""with {_CLEAN}, {_STEPS}, p as (select a.deposit_id, b.deposit_id before_id from steps a join steps b on a.network = b.network and a.mu = b.mu and a.k = b.k + 1)
select p.deposit_id, round({_SQ.format("c.x - d.x")} / greatest({_SQ.format("d.x")}, 1e-30), 6) gap_2, round(max(abs(c.x - d.x)) / greatest(max(abs(d.x)), 1e-30), 6) gap_max
from p join clean c on c.deposit_id = p.deposit_id join clean d on d.deposit_id = p.before_id and d.link_id = c.link_id group by 1""",
)(lambda t: fl.deposit_gaps(t.clean, t.flows_manifest))
_query(
    "mixture_reconstruct",
    f"with {_CLEAN}, {_STEPS} select network, mu, link_id, round(sum(round(x * k, 6)::decimal(28,6))::double / sum(k) + 1e-9, 6) x, count(*) n_components from clean join steps using (deposit_id, network, mu) group by all",
)(lambda t: fl.mixtures(t.clean, t.flows_manifest))
_query(
    "running_mean",
    f"""with {_CLEAN}, {_STEPS} select deposit_id, link_id, round(sum(x::decimal(28,6)) over w::double / count(*) over w + 1e-9, 6) mean_x from clean join steps using (deposit_id, network, mu)
window w as (partition by network, mu, link_id order by k rows between unbounded preceding and current row)""",
)(lambda t: fl.running_means(t.clean, t.flows_manifest))
_query(
    "contested_links",
    f"""with {_CLEAN}, {_STEPS}, r as (select deposit_id, network, mu, least(n, 5) w from (select *, max(k) over (partition by network, mu) n from steps) where k > n - 5)
select network, mu, link_id, count(*) n_supports from clean join r using (deposit_id, network, mu) where x > 1e-6 group by all having count(*) < max(w)""",
)(lambda t: fl.contested_links(t.flows, t.flows_manifest))
_CONTESTED = f"""{_CLEAN}, {_STEPS}, r as (select deposit_id, network, mu, least(n, 5) w from (select *, max(k) over (partition by network, mu) n from steps) where k > n - 5),
cont as (select network, mu, link_id, count(*) n_supports from clean join r using (deposit_id, network, mu) where x > 1e-6 group by all having count(*) < max(w))"""
_query("contested_top", f"with {_CONTESTED} select *, row_number() over (partition by network, mu order by n_supports desc, link_id) place from cont qualify place <= 4")(
    lambda t: fl.contested_top(fl.contested_links(t.flows, t.flows_manifest))
)
_query("face_sizes", f"with {_CONTESTED} select network, mu, count(*) n_links, count(distinct (least(tail, head), greatest(tail, head))) n_node_pairs from cont join links using (network, link_id) group by all")(
    lambda t: fl.face_sizes(fl.contested_links(t.flows, t.flows_manifest), t.links)
)
_query(
    "support_ages",
    f"""with {_CLEAN}, {_STEPS}, d as (select deposit_id, coalesce(string_agg(link_id, ',' order by link_id) filter (x > 1e-6), '') s from clean group by 1),
f as (select network, mu, s, min(k) fst, max(k) lst from steps join d using (deposit_id) group by all) select network, mu, count(*) n_supports, max(fst) newest, max(lst) - max(fst) age from f group by all""",
)(lambda t: fl.support_ages(t.clean, t.flows_manifest))
_query(
    "representation_residual",
    f"""with {_CLEAN}, {_STEPS}, n as (select *, max(k) over (partition by network, mu) n from steps qualify n > 1),
c as (select *, case when k < n then k / (n * n)::double else 0 end as c from n), d as (select *, sum(c) over (partition by network, mu) as weight from c),
l as (select network, mu, link_id, weight, sum(x * (c + case when k = 1 then 1 - weight else 0 end)) mixed, sum(case when k = n then x else 0 end) wanted from clean join d using (deposit_id, network, mu) group by all)
select network, mu, round(weight + 1e-9, 6) as weight, round(max(abs(mixed - wanted)) / greatest(max(abs(wanted)), 1e-30) + 1e-9, 6) residual from l group by all""",
)(lambda t: fl.windows_represented(t.clean, t.flows_manifest))
_query(
    "comparison",
    f"""with {_CLEAN}, {_STEPS}, p as (select a.network, a.mu, a.deposit_id, b.deposit_id before_id, a.k from steps a join steps b on a.network = b.network and a.mu = b.mu and a.k = b.k + 1 qualify row_number() over (partition by a.network, a.mu order by a.k desc) = 1),
d as (select p.network, p.mu, round(max(abs(c.x - d.x)) / greatest(max(abs(d.x)), 1e-30), 6) difference from p join clean c on c.deposit_id = p.deposit_id join clean d on d.deposit_id = p.before_id and d.link_id = c.link_id group by all),
h as (select network, round(mu, 6) mu, max(mixture_residual) margin from certificate_sweep where mixture_residual >= 0 and mixture_residual < 'inf'::double group by all), r as (select * from d left join h using (network, mu))
select network, min(mu) least_mu, max(mu) greatest_mu, count(*) n_cells, arg_min(difference, mu) first_difference, arg_max(difference, mu) last_difference,
case when count_if(difference > 0) >= 3 then round(regr_slope(ln(difference), ln(mu)) filter (difference > 0), 6) end slope, case when count_if(difference > 0) >= 3 then round(regr_r2(ln(difference), ln(mu)) filter (difference > 0), 6) end r2,
min(margin) least_margin, max(margin) greatest_margin from r group by 1""",
)(lambda t: fl.steps_compared(t.clean, t.flows_manifest, t.certificate_sweep))
_ENV = f"""{_CLEAN}, {_STEPS}, s as (select *, (k - 1) // 4 as block from steps), full_ as (select network, mu, block from s group by all having count(*) = 4),
u as (select network, mu, block, link_id, count(*) n from clean join s using (deposit_id, network, mu) where x > 1e-6 group by all)"""
_query(
    "envelope_watch",
    f"""with {_ENV}, b as (select network, mu, block, count_if(n = 4) n_base, count(*) n_union, string_agg(link_id, ',' order by link_id) ud, coalesce(string_agg(link_id, ',' order by link_id) filter (n = 4), '') bd
from u join full_ using (network, mu, block) group by all), m as (select *, coalesce(lag(ud) over w = ud and lag(bd) over w = bd, false) same from b window w as (partition by network, mu order by block)),
r as (select *, sum(case when same then 0 else 1 end) over (partition by network, mu order by block) run from m)
select network, mu, block, n_base, n_union, n_union - n_base as n_contested, row_number() over (partition by network, mu, run order by block) windows_held from r""",
)(lambda t: fl.envelopes(t.clean, t.flows_manifest))
_query(
    "support_symdiff",
    f"""with {_ENV}, b as (select distinct network, mu, block from s where block > 0),
d as (select coalesce(a.network, p.network) network, coalesce(a.mu, p.mu) mu, coalesce(a.block, p.block + 1) block, a.link_id a, p.link_id p from u a full join u p on a.network = p.network and a.mu = p.mu and a.link_id = p.link_id and a.block = p.block + 1)
select network, mu, block, count_if(p is null) n_entered, count_if(a is null) n_left from d join b using (network, mu, block) group by all""",
)(lambda t: fl.envelope_changes(t.clean, t.flows_manifest))
_query(
    "manifest_digest",
    f"with {_CLEAN}, v as (select deposit_id, string_agg(printf('%06d:%.6f', link_id, x), ';' order by link_id) s from clean group by 1) select deposit_id, substr(sha256(s), 1, 16) digest, length(s) n_bytes from v",
)(lambda t: fl.flow_digests(t.clean))

# ---- graphs at the cost of the mean deposited flow -----------------------------------------------------------

_GRAPH = f"""{_CLEAN},
mean_ as (select network, link_id, sum(round(x, 6)::decimal(28,6))::double / count(*) x from clean group by all),
cong0 as (select l.*, round(least(coalesce(m.x, 0), l.capacity) + 1e-9, 6) x from links l left join mean_ m using (network, link_id)),
cong as (select *, round({_COST}, 6) as cost from cong0),
flg as (select network, n_zones, n_nodes, zdc, coalesce(first_thru > 1, zdc) no_thru from (select n.network, n.n_zones, n.n_nodes, n.first_thru, bool_or(l.tail < n.n_zones and l.fft <= 0) zdc from networks n join links l using (network) group by all)),
lk as (select * from cong join flg using (network))"""
_PI = f"""with recursive {_GRAPH},
pi(network, dest, node, pi) using key (network, dest, node) as (
  select network, d, d, 0.0::double from networks, unnest(range(0, n_zones)) u(d)
  union
  select network, dest, node, min(v) from (select l.network, p.dest, l.tail as node, l.cost + p.pi as v from pi p join lk l on l.network = p.network and l.head = p.node where not (l.no_thru and l.head < l.n_zones) or l.head = p.dest) q
  where v < coalesce((select r.pi from recurring.pi r where r.network = q.network and r.dest = q.dest and r.node = q.node), 1e300) group by all)"""
_GAPS = f"""{_PI},
g as (select l.*, t.dest, t.pi pi_tail, h.pi pi_head, t.pi - h.pi as gap from lk l join pi t on t.network = l.network and t.node = l.tail join pi h on h.network = l.network and h.node = l.head and h.dest = t.dest),
s as (select *, case when tail = dest then false when head = dest then true when no_thru and head < n_zones then false when zdc and tail < n_zones then true else pi_head < pi_tail end as eff,
  tail <> dest and head <> dest and not (no_thru and head < n_zones) and not (zdc and tail < n_zones) as elig from g)"""

_query("congested_links", f"with {_GRAPH} select network, link_id, x, cost from cong")(lambda t: t.congested.select("network", "link_id", "x", "cost"))
_query("topology_flags", f"with {_GRAPH} select network, n_zones, n_nodes, zdc zero_connectors, no_thru, u.n_used from flg join (select network, count_if(x > 0) n_used from cong group by 1) u using (network)")(
    lambda t: gr.flags(t.links, t.networks).join(t.congested.groupBy("network").agg(F.count_if(F.col("x") > 0).alias("n_used")), "network")
)
_query("csr_prefix", f"with {_GRAPH} select network, link_id, tail, place, min(place) over (partition by network, tail) as \"offset\" from (select *, row_number() over (partition by network order by tail, link_id) - 1 place from cong where x > 0)")(
    lambda t: gr.csr(t.congested.where("x > 0"))
)
_query("parallel_collapse", f"with {_GRAPH} select network, tail, head, min(cost) cost, arg_min(link_id, (cost, link_id)) link_id, count(*) n_parallel from cong group by all")(lambda t: gr.parallel_least(t.congested))
_query("node_densify", f"with {_GRAPH}, n as (select network, tail node from cong where x > 0 union select network, head from cong where x > 0) select network, node, row_number() over (partition by network order by node) - 1 dense_id from n")(
    lambda t: gr.densified(t.congested)
)
_query(
    "tied_groups",
    f"""with {_GRAPH} select network, least(tail, head) a, greatest(tail, head) b, count(*) n_links, min(link_id) forward, string_agg(printf('%04d', link_id), ',' order by link_id) members, count(distinct tail) = 2 both_ways
from cong where tail <> head and x > 0 group by all""",
)(lambda t: gr.opposite_groups(t.congested.where("x > 0")))
_query("potentials", f"{_PI} select network, dest, node, round(pi, 6) pi from pi")(lambda t: gr.potentials_by_rounds(t.congested, t.networks).withColumn("pi", F.round("pi", 6)))
_query("potentials_kernel", f"{_PI} select network, dest, node, round(pi, 6) pi from pi")(lambda t: gr.potentials(t.congested, t.networks).withColumn("pi", F.round("pi", 6)))
_query("efficient_support", f"{_GAPS} select network, dest, count_if(eff) n_support, count_if(elig) n_eligible from s group by all")(lambda t: gr.support_sizes(t.gaps))


@_query("margins", f"""{_GAPS},
od as (select network, o, d from networks, unnest(range(0, n_zones)) a(o), unnest(range(0, n_zones)) b(d) where o <> d),
reach as (select network, d dest, o node from od union select r.network, r.dest, s.head from reach r join s on s.network = r.network and s.dest = r.dest and s.tail = r.node where s.eff)
select s.network, round(min(abs(gap)), 6) isolation, round(min(abs(gap)) filter (gap < -1e-5), 6) exclusion, round(min(abs(gap)) filter (gap < -1e-5 and r.node is not null), 6) path_excess, count_if(abs(gap) <= 1e-5) n_ties
from s left join reach r on r.network = s.network and r.dest = s.dest and r.node = s.tail where elig group by 1""")  # fmt: skip
def _margins(t: Tables) -> DataFrame:
    g = cut(t.gaps, "gaps")
    wanted = gr.demand(t.networks).select("network", "origin", "dest")
    out = gr.margin_table(g, gr.reached(gr.supports(g), wanted), tolerance=1e-5)
    return out.select("network", *[F.round(c, 6).alias(c) for c in ("isolation", "exclusion", "path_excess")], "n_ties")


_query(
    "tie_inventory",
    f"""{_GAPS} select network, count_if(abs(gap) <= 1e-5) n_tied_pairs, count(distinct link_id) filter (abs(gap) <= 1e-5) n_tied_links, count_if(gap < -1e-5) n_excluded,
round(count_if(abs(gap) <= 1e-5) / nullif(count(distinct link_id) filter (abs(gap) <= 1e-5), 0), 6) pairs_per_link, min(cost) filter (abs(gap) <= 1e-5) least_tied_cost from s where elig group by 1""",
)(lambda t: gr.tie_inventory(t.gaps, 1e-5))
_query(
    "unreachable_demand",
    f"""{_PI}, od as (select network, o, d, 10.0::double * (1 + (o * 7 + d * 13) % 10) / n_zones demand from networks, unnest(range(0, n_zones)) a(o), unnest(range(0, n_zones)) b(d) where o <> d),
l as (select od.* from od left join pi p on p.network = od.network and p.node = od.o and p.dest = od.d where p.pi is null)
select n.network, count(l.o) n_pairs, coalesce(sum(round(l.demand, 6)::decimal(28,6)), 0)::double lost from networks n left join l using (network) group by 1""",
)(lambda t: gr.unreachable(t.networks, gr.potentials(t.congested, t.networks)))
_USED = f"{_STEPS}, used as (select network, mu, link_id, x from clean where x > 1e-6 and deposit_id in (select arg_max(deposit_id, k) from steps group by network, mu))"
_BAD = f"""{_GAPS}, {_USED}, cells as (select distinct network, mu from used),
a as (select g.*, c.mu, u.x as ux, not (no_thru and head < n_zones and head <> dest) op, tail <> dest aw from g join cells c using (network) left join used u on u.network = g.network and u.mu = c.mu and u.link_id = g.link_id),
f as (select *, aw and (head = dest or (zdc and tail < n_zones and op)) forced from a),
bad as (select network, mu, dest, link_id, gap, coalesce(ux, 0) x from f where (((gap > 1e-5 and aw and op) or forced) and ux is null) or (ux is not null and not ((gap >= -1e-5 and aw and op) or forced)))"""


def _bad(t: Tables) -> DataFrame:
    used = fl.latest_flows(t.flows, t.flows_manifest).where(F.col("x") > fl.USED)
    return gr.claimed(t.gaps, used, 1e-5)


_query("admissibility", f"{_BAD} select network, mu, count(*) n_violations, round(max(abs(gap)), 6) worst_gap, round(max(x), 6) worst_flow from bad group by all")(lambda t: gr.admissibility(_bad(t)))
_query("violating_pairs", f"{_BAD} select network, mu, link_id, count(*) n_destinations, max(round(abs(gap), 6)) worst_gap, arg_min(dest, (-round(abs(gap), 6), dest)) worst_dest from bad group by all")(
    lambda t: gr.violating_pairs(_bad(t))
)
_query(
    "network_report",
    f"""{_PI}, od as (select network, o, d, 10.0::double * (1 + (o * 7 + d * 13) % 10) / n_zones demand from networks, unnest(range(0, n_zones)) a(o), unnest(range(0, n_zones)) b(d) where o <> d),
ld as (select od.* from od left join pi p on p.network = od.network and p.node = od.o and p.dest = od.d where p.pi is null),
lo as (select network, count(*) n_pairs, sum(round(demand, 6)::decimal(28,6))::double lost from ld group by 1), dm as (select network, sum(round(demand, 6)::decimal(28,6))::double demand from od group by 1),
e as (select network, count(distinct node) touched from (select network, tail node from links union all select network, head from links) group by 1),
c as (select network, count(*) n_links, count_if(capacity <= 1e-9) zero_capacity, count_if(capacity = 1) unit_capacity, count_if(fft <= 0) zero_free_flow, count_if(tail = head) self_loops, max(power) max_power from links group by 1),
a as (select n.network, n.n_nodes, n.n_zones, coalesce(c.n_links, 0) n_links, coalesce(zero_capacity, 0) zero_capacity, coalesce(unit_capacity, 0) unit_capacity, coalesce(zero_free_flow, 0) zero_free_flow, coalesce(self_loops, 0) self_loops,
  n.n_nodes - coalesce(touched, 0) isolated_nodes, coalesce(n_pairs, 0) lost_pairs, coalesce(lost, 0)::double lost, max_power, case when max_power > 0 then round(250 / max_power, 6) end clamp_decades, coalesce(demand, 0) demand
  from networks n left join c using (network) left join e using (network) left join lo using (network) left join dm using (network))
select * exclude (demand), concat_ws('; ', case when demand <= 0 then 'no demand' end, case when lost > 0.001 * demand then 'demand lost' end, case when zero_capacity > 0.01 * n_links then 'zero capacities' end, case when self_loops > 0 then 'self-loops' end,
  case when unit_capacity > 0.5 * n_links and max_power > 10 then 'unit capacities under a steep exponent' end, case when clamp_decades < 6 then 'costs stand still at ordinary ratios' end) warnings from a""",
)(lambda t: gr.network_report(t.links, t.networks, gr.unreachable(t.networks, gr.potentials(t.congested, t.networks))))
_query(
    "cycle_links",
    f"""with recursive {_GRAPH}, l as (select network, link_id, tail, head from cong where x > 0),
r as (select network, tail a, head b from l union select r.network, r.a, l.head from r join l on l.network = r.network and l.tail = r.b),
c as (select network, a from r where a = b), stuck as (select network, a node from c union select r.network, r.b from r join c on c.network = r.network and c.a = r.a)
select l.network, l.link_id from l join stuck s on s.network = l.network and s.node = l.tail join stuck t on t.network = l.network and t.node = l.head""",
)(lambda t: gr.cycle_links(t.congested.where("x > 0")))
_query(
    "longest_tight_path",
    f"""{_GAPS}, tight as (select distinct network, dest, tail, head from g where abs(cost - gap) <= 1e-5 and gap > 1e-5 and tail <> dest),
hp as (select network, d dest, d node, 0 hops from networks, unnest(range(0, n_zones)) u(d) union select h.network, h.dest, t.tail, h.hops + 1 from hp h join tight t on t.network = h.network and t.dest = h.dest and t.head = h.node)
select network, max(hops) most_hops from hp join networks using (network) where node < n_zones group by 1""",
)(lambda t: gr.tight_hops(t.gaps, t.networks, 1e-5))
#: supports without the links that don't fall where a destination's links close a cycle (cyc), and with falling links only (strict)
_SUPPORTS = f"""{_GAPS}, open_ as (select * from s where eff and zdc and not no_thru),
walk as (select distinct network, dest, head node, 0 hop, n_nodes from open_ union select w.network, w.dest, o.tail, w.hop + 1, w.n_nodes from walk w join open_ o on o.network = w.network and o.dest = w.dest and o.head = w.node where w.hop <= w.n_nodes),
cyc as (select distinct network, dest from walk where hop > n_nodes),
m as (select s.network, s.dest, s.link_id, s.tail, s.head, s.cost, s.pi_tail, s.pi_head from s left join cyc c on c.network = s.network and c.dest = s.dest where eff and (c.dest is null or pi_head < pi_tail)),
ends_ as (select network, d from networks, unnest(range(0, n_zones)) u(d))"""
_STRICT = f"{_GAPS}, m as (select network, dest, link_id, tail, head, cost, pi_tail, pi_head from s where eff and pi_head < pi_tail), ends_ as (select distinct network, dest d from m)"
_WEIGHTS = """
share as materialized (select m.*, mu, exp(greatest(least(-mu * (cost + pi_head - pi_tail), 50), -700)) e from m, (values (1.0::double), (5.0::double)) t(mu)),
hop as (select network, mu, d dest, d node, 1.0::double w from ends_, (values (1.0::double), (5.0::double)) t(mu)
  union all select h.network, h.mu, h.dest, s.tail, sum(h.w * s.e) from hop h join share s on s.network = h.network and s.dest = h.dest and s.head = h.node and s.mu = h.mu group by all),
w as (select network, mu, dest, node, sum(w) w from hop group by all)"""
_LOAD = f"""{_WEIGHTS},
p as (select s.network, s.mu, s.dest, s.link_id, s.tail, s.head, s.e * h.w / t.w p from share s join w t on t.network = s.network and t.mu = s.mu and t.dest = s.dest and t.node = s.tail
  join w h on h.network = s.network and h.mu = s.mu and h.dest = s.dest and h.node = s.head where t.w > 0),
z as (select network, mu, d dest, o node, 10.0::double * (1 + (o * 7 + d * 13) % 10) / n_zones z from networks, unnest(range(0, n_zones)) a(o), unnest(range(0, n_zones)) b(d), (values (1.0::double), (5.0::double)) t(mu) where o <> d
  union all select z.network, z.mu, z.dest, p.head, sum(z.z * p.p) from z join p on p.network = z.network and p.mu = z.mu and p.dest = z.dest and p.tail = z.node group by all),
y as (select p.network, p.mu, p.link_id, sum(z.z * p.p) y from p join z on p.network = z.network and p.mu = z.mu and p.dest = z.dest and p.tail = z.node group by all)"""

_VALUE = """pn as materialized (select network, dest, node, pi from pi), v as (select w.network, w.mu, w.dest, w.node, round(ln(w.w) - w.mu * pn.pi, 6) as value from w join pn using (network, dest, node) where w.w > 0)"""
_query("value_pass", f"{_SUPPORTS}, {_WEIGHTS}, {_VALUE} select network, dest, node, value from v where mu = 1")(lambda t: certificate.values(t.congested, t.networks, 1.0).withColumn("value", F.round("value", 6)))
_query(
    "flow_load",
    f"{_SUPPORTS}, {_LOAD} select l.network, t.mu, l.link_id::int link_id, round(coalesce(y, 0) + 1e-9, 6) y from lk l cross join (values (1.0::double), (5.0::double)) t(mu) left join y on y.network = l.network and y.mu = t.mu and y.link_id = l.link_id",
)(lambda t: certificate.loads(t.congested, t.networks, (1.0, 5.0)).withColumn("y", F.round(F.col("y") + NUDGE, 6)))


def _strict(t: Tables) -> DataFrame:
    return t.gaps.where(gr.efficient() & (F.col("pi_head") < F.col("pi_tail")))


@_query("load_on_supports", f"{_STRICT}, {_LOAD} select network, mu, link_id, round(y + 1e-9, 6) y from y")
def _load_on_supports(t: Tables) -> DataFrame:
    """Demand that some way serves, loaded in rounds on the falling links of each destination's support."""
    support = cut(_strict(t), "strict")
    served = gr.demand(t.networks).join(support.select("network", F.col("tail").alias("origin"), "dest").distinct(), ["network", "origin", "dest"], "left_semi")
    y = ld.load(support, served, (1.0, 5.0))
    return y.where("y > 0").withColumn("y", F.round(F.col("y") + NUDGE, 6))


_query("values_on_supports", f"{_STRICT}, {_WEIGHTS}, {_VALUE} select network, mu, dest, node, value from v")(
    lambda t: ld.values(_strict(t), (1.0, 5.0)).withColumn("value", F.round("value", 6))
)
_query(
    "cycle_found",
    f"""with recursive {_GRAPH}, l as (select network, link_id, tail, head from cong where x > 0),
r as (select network, tail a, head b from l union select r.network, r.a, l.head from r join l on l.network = r.network and l.tail = r.b),
c as (select network, a from r where a = b), stuck as (select network, a node from c union select r.network, r.b from r join c on c.network = r.network and c.a = r.a),
e as (select l.network, l.head node, min(l.link_id) link_id, arg_min(l.tail, l.link_id) before from l join stuck s on s.network = l.network and s.node = l.tail group by all),
b as (select network, node first_, before cur from e union select b.network, b.first_, e.before from b join e on e.network = b.network and e.node = b.cur),
cy as (select x.network, x.first_ node, min(y.cur) as cycle from b x join b y on y.network = x.network and y.first_ = x.first_ where x.cur = x.first_ group by all),
f as (select network, least(tail, head) a, greatest(tail, head) b, min(link_id) forward from l group by all)
select cy.network, cy.cycle, e.link_id, e.link_id = f.forward uses_forward from cy join e on e.network = cy.network and e.node = cy.node join f on f.network = e.network and f.a = least(e.node, e.before) and f.b = greatest(e.node, e.before)""",
)(lambda t: gr.one_cycle(t.congested.where("x > 0")))


@_query("load_conserves")
def _load_conserves(t: Tables) -> DataFrame:
    """Per network and dispersion the worst node imbalance of the loaded demand, by joins over the loaded flows."""
    c = t.congested
    y = cut(certificate.loads(c, t.networks, (1.0, 5.0)), "loads").join(c.select("network", "link_id", "tail", "head"), ["network", "link_id"])
    ends = y.select("network", "mu", F.explode(F.array(F.struct(F.col("tail").alias("node"), F.col("y").alias("v")), F.struct(F.col("head").alias("node"), (-F.col("y")).alias("v")))).alias("e"))
    served = gr.demand(t.networks).join(gr.potentials(c, t.networks).select("network", F.col("node").alias("origin"), "dest"), ["network", "origin", "dest"], "left_semi")
    od = served.select("network", F.explode(F.array(F.lit(1.0), F.lit(5.0))).alias("mu"), F.explode(F.array(F.struct(F.col("origin").alias("node"), (-F.col("demand")).alias("v")), F.struct(F.col("dest").alias("node"), F.col("demand").alias("v")))).alias("e"))
    net = ends.unionByName(od).groupBy("network", "mu", F.col("e.node").alias("node")).agg(F.sum("e.v").alias("net"))
    return net.groupBy("network", "mu").agg((F.max(F.abs("net")) < 1e-6).alias("conserves"), F.count("*").alias("n_nodes"))


_query("certify_deposits")(lambda t: certificate.certify(t.clean, t.links, t.networks))
_query("equilibrium")(lambda t: equilibrium.solve(t.clean, t.congested, t.networks))
_query("inclusion")(lambda t: equilibrium.inclusion(t.clean, t.congested, t.networks))
_query("solution_set")(lambda t: equilibrium.solution_set(t.clean, t.congested, t.networks))


@_query("dispersion_recovery")
def _dispersion_recovery(t: Tables) -> DataFrame:
    c = t.congested
    return equilibrium.recovered_dispersion(c, t.networks, cut(certificate.loads(c, t.networks, (1.0, 5.0)), "loads"))


_query("full_graph")(lambda t: equilibrium.full_graph(t.clean, t.congested, t.networks))

# ---- result records ------------------------------------------------------------------------------------------

_NAMED = "regexp_replace(regexp_replace(lower(network), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_REC = f"rec as (select * replace ({_NAMED} as network, round(mu, 6) as mu) from corpus_sweep)"
_CERT = f"cert as (select * replace ({_NAMED} as network, round(mu, 6) as mu) from certificate_sweep)"
_LAST = "last_ as (select * from rec qualify row_number() over (partition by network, mu order by recorded_at desc, record_id desc) = 1)"
_SWEEP_LAST = "slast as (select * from rec qualify row_number() over (partition by sweep_id, network, mu order by recorded_at desc, record_id desc) = 1)"
_SOUND = "case when {0} >= 0 and {0} < 'inf'::double then {0} end"
_SOLVED = f"coalesce({_SOUND.format('residual')} < 1e-8 and {_SOUND.format('conservation_max')} < 1e-6, false)"
_SCI = "case when {0} = 0 then '0' else printf('%.{1}e', {0}) end"
_WORDS = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve']"

_query("latest_cell", f"with {_REC}, {_LAST} select network, mu, record_id, sweep_id, iterations from last_")(lambda t: rc.latest(rc.named(t.corpus_sweep)).select("network", "mu", "record_id", "sweep_id", "iterations"))
_query(
    "solved_headline",
    f"""with {_REC}, {_SWEEP_LAST} select sweep_id, count(*) n_cells, count(distinct network) n_networks, count_if({_SOLVED}) n_solved, count_if(coalesce(unresolved, false)) n_unresolved,
{_SCI.format(f"(max(residual) filter ({_SOLVED}))", 1)} worst_residual, case when count_if({_SOLVED}) <= 12 then {_WORDS}[(count_if({_SOLVED}) + 1)::bigint] else count_if({_SOLVED})::varchar end n_solved_text from slast group by 1""",
)(lambda t: rc.headline(t.corpus_sweep))
_query(
    "tier_table",
    f"""with {_REC}, n as (select network, max(n_nodes) n_nodes, max(n_zones) n_zones, max(n_links) n_links from rec group by 1)
select *, case when n_links < 100 then 'small' when n_links < 250 then 'medium' else 'large' end tier, ntile(2) over (order by n_links, network) half from n""",
)(lambda t: rc.tiers(t.corpus_sweep))
_query(
    "rho_pivot",
    f"with {_REC}, {_LAST} select network, "
    + ", ".join(f"{_SCI.format(f'(max({_SOUND.format("residual")}) filter (mu = {m}))', 3)} as mu_{f'{m:g}'.replace('.', '_')}" for m in rc.DISPERSIONS)
    + " from last_ group by 1",
)(lambda t: rc.by_dispersion(t.corpus_sweep))
_query(
    "loglog_fit",
    f"""with {_REC}, m as (select network, mu, sum(round(seconds, 3)::decimal(28,3))::double / count(*) s from rec where {_SOUND.format('seconds')} > 0 and seconds < 864000 group by all)
select network, count(*) n_points, case when count(*) >= 3 then round(-regr_slope(ln(s), ln(mu)), 6) end "order", case when count(*) >= 3 then round(regr_r2(ln(s), ln(mu)), 6) end r2 from m group by 1""",
)(lambda t: rc.fits(t.corpus_sweep))
_query("span_report", f"with {_REC} select network, min(iterations) least_iterations, max(iterations) most_iterations, round(min(peak_rss_mb), 3) least_mb, round(max(peak_rss_mb), 3) most_mb from rec group by 1")(
    lambda t: rc.spans(t.corpus_sweep)
)
_query(
    "timing_report",
    f"""with {_REC} select mu, count(*) n_records, round(min(seconds), 4) least_seconds, round(max(seconds), 4) most_seconds, sum(round(seconds, 3)::decimal(28,3))::double total_seconds,
arg_max(network, (seconds, network)) slowest from rec where {_SOUND.format('seconds')} > 0 and seconds <= 864000 group by 1""",
)(lambda t: rc.timings(t.corpus_sweep))
_query(
    "coverage_both_ways",
    f"""with {_REC}, h as (select distinct sweep_id, network, mu, true held from rec), d as (select s.sweep_id, lower(n.network) network, m.mu::double mu, true declared from (select distinct sweep_id from corpus_sweep) s, networks n, unnest([0.5, 1.0, 2.0, 5.0, 10.0]) m(mu))
select sweep_id, count_if(held is null) n_pending, count_if(declared is null) n_undeclared, count(held) n_held from d full join h using (sweep_id, network, mu) group by 1""",
)(lambda t: rc.coverage(t.corpus_sweep, t.networks))
_query("pending_cells", f"with {_REC}, {_CERT}, {_SWEEP_LAST} select distinct network, mu from slast where {_SOLVED} except select network, mu from cert")(lambda t: rc.pending(t.corpus_sweep, t.certificate_sweep))
_query(
    "records_margins",
    f"""with {_REC}, {_CERT}, {_LAST}, cl as (select * from cert qualify row_number() over (partition by network, mu order by recorded_at desc, record_id desc) = 1)
select a.network, a.mu, a.record_id, {_SCI.format(f"({_SOUND.format('a.residual')})", 3)} residual, c.n_contested, c.certified, c.verdict_kind from last_ a left join cl c on a.network = c.network and a.mu = c.mu""",
)(lambda t: rc.margins(t.corpus_sweep, t.certificate_sweep))
_query(
    "vintage_check",
    """select sweep_id, count(distinct gate_revision) n_revisions, count(distinct cores) n_cores, count_if(gate_revision is null) n_without_revision, array_to_string(list_sort(list(distinct origin)), ',') origins,
count(distinct gate_revision) > 1 mixed from corpus_sweep group by 1""",
)(lambda t: rc.vintages(t.corpus_sweep))
_query(
    "convergence_check",
    f"select coalesce(stopped_on, 'unknown') stopped_on, count(*) n_records, count_if(coalesce(converged, false)) n_converged, count_if(coalesce(converged, false) and not coalesce({_SOUND.format('residual')} < 1e-8, false)) n_doubtful from corpus_sweep group by 1",
)(lambda t: rc.convergence(t.corpus_sweep))
_query("cell_index", f"with {_REC}, h as (select distinct sweep_id, network, mu from rec) select *, row_number() over (partition by sweep_id order by network, mu) - 1 cell from h")(lambda t: rc.cell_index(t.corpus_sweep))
_query(
    "verdicts",
    "select coalesce(verdict_kind, 'none') verdict, count(*) n_records, count_if(coalesce(certified, false)) n_certified, round(sum(n_contested) / count(n_contested), 6) mean_contested from certificate_sweep group by 1",
)(lambda t: rc.verdicts(t.certificate_sweep))
_query(
    "resumed_runs",
    f"""with {_REC}, s as (select distinct sweep_id, network, mu, resumed_from v from rec where resumed_from is not null), h as (select distinct sweep_id, network, mu, iterations v from rec)
select s.network, count(*) n_resumed, count_if(h.v is null) n_broken from s left join h using (sweep_id, network, mu, v) group by 1""",
)(lambda t: rc.resumed(t.corpus_sweep))
_ATOMS = f"""{TIED_SQL}, w0 as (select record_id, face_pos, unnest(json_extract(face->'weights', '$[*]')) w from faces where json_type(face->'weights') = 'ARRAY'),
w as (select record_id, face_pos, (w->>0)::bigint dest, (w->>1)::bigint link, max((w->>2)::double) w from w0 where json_array_length(w) = 3 and (w->>2)::double between 0 and 1 group by all),
o as (select *, row_number() over v n_admitted, w - coalesce(lead(w) over v, 0) mass from w window v as (partition by record_id, face_pos order by w desc, dest, link)),
atoms as (select record_id, face_pos, n_admitted, round(mass, 9) mass from (select record_id, face_pos, n_admitted, mass from o union all select record_id, face_pos, 0, 1 - max(w) from w group by all) where mass > 0)"""

_query("nested_atoms", f"with {_ATOMS} select record_id, face_pos, n_admitted, mass from atoms")(lambda t: tied.nested_atoms(flatten_tied(t.certificate_sweep)["weight"]))
_query(
    "marginals",
    f"""with {_ATOMS}, a as (select record_id, face_pos, round(sum(mass), 6) total_mass, round(sum(mass * n_admitted), 6) admitted, max(n_admitted) most_admitted from atoms group by all)
select *, round(most_admitted - 1 - admitted, 6) ring_slack from a""",
)(lambda t: tied.marginals(cut(flatten_tied(t.certificate_sweep)["weight"], "weights")))
_query(
    "walk_counters",
    f"""with {TIED_SQL}, r as (select record_id, r->>'phase' as phase, coalesce((r->>'converged')::boolean, false) converged, (r->>'retired')::bigint retired, (r->>'residual')::double residual from rounds)
select record_id, count(*) n_rounds, count_if(converged) n_converged, coalesce(sum(retired), 0)::bigint n_retired, count(distinct phase) filter (phase <> '') n_phases, max(residual) filter (isfinite(residual)) worst_residual from r group by 1""",
)(lambda t: tied.walk_counters(flatten_tied(t.certificate_sweep)["round"]))
_query(
    "sink_roundtrip",
    f"with {_REC} select exhibit, network, count(*) n_records, count(residual) filter (not isnan(residual) and abs(residual) < 'inf'::double) n_residuals, sum(iterations)::bigint total_iterations from rec group by all",
)(lambda t: sinks.roundtrip(t.corpus_sweep))
_query("stream_daily", "select strftime(recorded_at, '%Y-%m-%d') as day, count(*) n_records, count_if(coalesce(converged, false)) n_converged from corpus_sweep where recorded_at is not null group by 1")(
    lambda t: st.daily_counts(t.spark, f"{t.dir}/corpus_sweep.parquet")
)
_query("stream_latest", f"with {_REC}, {_LAST} select network, mu, record_id, iterations from last_")(lambda t: st.latest_cells(t.spark, f"{t.dir}/corpus_sweep.parquet"))
