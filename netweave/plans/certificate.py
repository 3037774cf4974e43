"""The strict certificate of every deposited flow, and the loading of a cost on its own support.

One group is one deposit: at most some hundred links, whatever the number of deposits. The kernels are those of
netweave.operators.kernels; Spark joins the flows with links and flags, and spreads the deposits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators.graph import flagged
from netweave.operators.kernels import Graph, Support, bpr, zone_demand
from netweave.session import spread

_NEEDED = ["network", "link_id", "tail", "head", "capacity", "fft", "b", "power", "n_nodes", "n_zones", "no_thru", "zero_connectors"]
TIE, CONSERVATION = 1e-9, 1e-6


def graph_of(rows: pd.DataFrame) -> Graph:
    first = rows.iloc[0]
    return Graph(int(first["n_nodes"]), int(first["n_zones"]), rows["tail"].to_numpy(), rows["head"].to_numpy(), bool(first["no_thru"]), bool(first["zero_connectors"]))


def certificate_of(g: Graph, x: np.ndarray, cost: np.ndarray, mu: float, demand: np.ndarray) -> dict:
    """The clauses of one flow: its reload on its own support, conservation, margins and use of inefficient links."""
    y, pi, support = g.load(cost, demand, mu)
    mask = support.mask
    t, h = pi[g.tail], pi[g.head]
    with np.errstate(invalid="ignore"):
        gap = np.where(np.isfinite(t) & np.isfinite(h), t - h, 0.0)
    zone_t, zone_h = (g.tail < g.z)[:, None], (g.head < g.z)[:, None]
    free = np.isfinite(t) & np.isfinite(h) & ~(g.no_thru & zone_h) & ~(g.zdc & zone_t) & ~g.from_dest & ~g.to_dest
    net = np.bincount(g.tail, x, g.n) - np.bincount(g.head, x, g.n) - demand.sum(1)
    net[: g.z] += demand.sum(0)
    least = lambda m: float(np.abs(gap[m]).min()) if m.any() else float("nan")
    unused = ~mask.any(1) & (x > 1e-6)
    return {
        "reload_defect": float(np.abs(x - y).max() / max(np.abs(x).max(initial=0.0), 1e-30)), "worst_imbalance": float(np.abs(net).max()), "n_support": int(mask.sum()), "n_cyclic": int(support.cyclic.sum()),
        "isolation": least(free), "exclusion": least(free & (gap < -TIE)), "n_ties": int((free & (np.abs(gap) <= TIE)).sum()), "n_violations": int(unused.sum()),
        "conserves": bool(np.abs(net).max() <= CONSERVATION * max(demand.sum(), 1.0)),
    }


def certify(flows: DataFrame, links: DataFrame, networks: DataFrame) -> DataFrame:
    """One row per deposit: the clauses and the verdict (strict, not conserved, inadmissible or not reproduced)."""
    schema = (
        "deposit_id long, network string, mu double, n_links long, reload_defect double, worst_imbalance double, n_support long, n_cyclic long, isolation double, exclusion double, n_ties long, n_violations long, conserves boolean, verdict string"
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        g, first = graph_of(rows), rows.iloc[0]
        x = rows["x"].to_numpy()
        cost = bpr(x, *(rows[c].to_numpy() for c in ("fft", "capacity", "b", "power")))
        out = certificate_of(g, x, cost, float(first["mu"]), zone_demand(g.n, g.z))
        verdict = "not conserved" if not out["conserves"] else "inadmissible" if out["n_violations"] else "not reproduced" if out["reload_defect"] > 1e-8 else "strict"
        out = {k: round(v, 6) if isinstance(v, float) else v for k, v in out.items()}
        return pd.DataFrame([{"deposit_id": first["deposit_id"], "network": first["network"], "mu": first["mu"], "n_links": len(rows), **out, "verdict": verdict}])

    rows = flows.join(flagged(links, networks).select(*_NEEDED), ["network", "link_id"]).select("deposit_id", "mu", "x", *_NEEDED)
    return spread(rows, "deposit_id").groupBy("deposit_id").applyInPandas(run, schema)


def loads(links: DataFrame, networks: DataFrame, mus: tuple[float, ...]) -> DataFrame:
    """Flow of each link when the zone demand is loaded at the given costs, for each dispersion: network, mu, link_id, y."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        g, mu = graph_of(rows), float(rows["mu"].iloc[0])
        y = g.load(rows["cost"].to_numpy(), zone_demand(g.n, g.z), mu)[0]
        return pd.DataFrame({"network": rows["network"], "mu": mu, "link_id": rows["link_id"], "y": y})

    cells = flagged(links, networks).withColumn("mu", F.explode(F.array(*map(F.lit, mus))))
    return spread(cells.select(*_NEEDED, "cost", "mu"), "network", "mu").groupBy("network", "mu").applyInPandas(run, "network string, mu double, link_id int, y double")


def values(links: DataFrame, networks: DataFrame, mu: float) -> DataFrame:
    """Log-sum-exp value of each node towards each zone; a missing row is minus infinity."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        g = graph_of(rows)
        cost = rows["cost"].to_numpy()
        pi = g.potentials(cost)
        v = Support(g, g.support(pi), pi).chances(cost, pi, mu)[1]
        node, dest = np.nonzero(np.isfinite(v))
        return pd.DataFrame({"network": rows["network"].iloc[0], "dest": dest, "node": node, "value": v[node, dest]})

    rows = flagged(links, networks).select(*_NEEDED, "cost")
    return spread(rows, "network").groupBy("network").applyInPandas(run, "network string, dest int, node int, value double")
