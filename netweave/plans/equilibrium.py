"""Fixed points per cell: the two-phase equilibrium, the inclusion scheme, and the full-graph comparator.

A cell is one network at one dispersion, the unit that Spark spreads. A cell's kernel starts from the mean deposited
flow and iterates on that cell's arrays alone.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators.graph import flagged
from netweave.operators.kernels import Graph, Support, bpr, zone_demand
from netweave.plans.certificate import _NEEDED, graph_of
from netweave.session import spread

SOLVED_BELOW, FLOW_TOLERANCE = 1e-8, 1e-9


def _cells(flows: DataFrame, congested: DataFrame, networks: DataFrame) -> DataFrame:
    """All links of each cell that has a deposit, with the mean flow."""
    cells = flows.select("network", F.round("mu", 6).alias("mu")).distinct()
    return spread(flagged(congested, networks).select(*_NEEDED, "x", "cost").join(cells, "network"), "network", "mu")


def fixed_support(x: np.ndarray, cost_of, demand: np.ndarray, mu: float, pi: np.ndarray, support: Support, rounds: int) -> tuple[np.ndarray, float, int]:
    """Polish on a frozen support: Anderson-accelerated reloading, keeping the best iterate."""
    kept_x, kept_r, best = [], [], (np.inf, x)
    for k in range(rounds):
        r = support.push(support.chances(cost_of(x), pi, mu)[0], demand) - x
        size = float(np.linalg.norm(r) / max(np.linalg.norm(x), 1e-30))
        if size < best[0]:
            best = (size, x)
        if size < 1e-11:
            break
        kept_x.append(x)
        kept_r.append(r)
        kept_x, kept_r = kept_x[-6:], kept_r[-6:]
        if len(kept_r) > 1:
            dr = np.stack([b - a for a, b in zip(kept_r, kept_r[1:])], 1)
            dx = np.stack([b - a for a, b in zip(kept_x, kept_x[1:])], 1)
            c = np.linalg.lstsq(dr, r, rcond=1e-10)[0]
            x = np.maximum(x + r - (dx + dr) @ c, 0.0)
        else:
            x = np.maximum(x + 0.5 * r, 0.0)
    return best[1], best[0], k + 1


def solve_cell(g: Graph, x: np.ndarray, cost_of, mu: float, averaging: int, polishing: int, tilt: np.ndarray | float = 0.0) -> tuple[np.ndarray, dict]:
    """Averaging with the support of the averaged cost, rebuilt every tenth step; then the polish on the last support.

    tilt is added to the cost that defines the support, to tell solutions apart that a tie allows.
    """
    demand = zone_demand(g.n, g.z)
    mean, changes, stable = cost_of(x), 0, 0
    pi = g.potentials(mean + tilt)
    demand = np.where(np.isfinite(pi), demand, 0.0)
    support = Support(g, g.support(pi), pi)
    k = 0
    for k in range(1, averaging + 1):
        cost = cost_of(x)
        mean += (cost - mean) / k
        if k % 10 == 0:
            pi = g.potentials(mean + tilt)
            new = Support(g, g.support(pi), pi)
            changes = int((new.mask != support.mask).sum())
            support, stable = new, stable + 1 if not changes else 0
            if stable >= 3:
                break
        y = support.push(support.chances(cost, pi, mu)[0], demand)
        x = x + (y - x) / k
    x, residual, rounds = fixed_support(x, cost_of, demand, mu, pi, support, polishing)
    own = g.potentials(cost_of(x))
    return x, {"iterations": k, "support_changes": changes, "residual": residual, "polish_rounds": rounds, "n_support": int(support.mask.sum()), "support_holds": bool((Support(g, g.support(own), own).mask == support.mask).all())}


def solve(flows: DataFrame, congested: DataFrame, networks: DataFrame, averaging: int = 200, polishing: int = 40) -> DataFrame:
    """One row per cell: how far the two phases came, and whether the frozen support is that of the final cost."""
    schema = "network string, mu double, iterations long, support_changes long, residual double, polish_rounds long, n_support long, support_holds boolean, solved boolean"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        g = graph_of(rows)
        parts = [rows[c].to_numpy() for c in ("fft", "capacity", "b", "power")]
        _, out = solve_cell(g, rows["x"].to_numpy(), lambda x: bpr(x, *parts), float(rows["mu"].iloc[0]), averaging, polishing)
        return pd.DataFrame([{"network": rows["network"].iloc[0], "mu": rows["mu"].iloc[0], **out, "solved": out["residual"] < SOLVED_BELOW}])

    return _cells(flows, congested, networks).groupBy("network", "mu").applyInPandas(run, schema)


def included(load, x: np.ndarray, rounds: int, window: int, same_windows: int | None = None, tolerance: float = FLOW_TOLERANCE) -> dict:
    """Rounds of averaging with the support of the current flow, until a stop rule holds; load gives (flow, support mask).

    The rules: no support within a whole window that wasn't seen before; ``same_windows`` whole windows with one envelope
    (off by default); the flow moves less than the tolerance. Otherwise the verdict is "not settled yet".
    """
    first: dict[bytes, int] = {}
    recent: dict[bytes, tuple[np.ndarray, int]] = {}
    envelope, last, held, newest, stopped, k = None, None, 0, 0, "not settled yet", 0
    for k in range(1, rounds + 1):
        y, mask = load(x)
        step = (y - x) / k
        x = x + step
        bits = np.packbits(mask)
        key = blake2b(bits.tobytes(), digest_size=16).digest()
        newest = k if first.setdefault(key, k) == k else newest
        recent[key] = (bits, k)
        for stale in [s for s, (_, at) in recent.items() if at <= k - window]:
            del recent[stale]
        envelope = (mask, mask) if envelope is None else (envelope[0] & mask, envelope[1] | mask)
        if k % window == 0:
            held = held + 1 if last is not None and all(np.array_equal(a, b) for a, b in zip(envelope, last)) else 1
            last, envelope = envelope, None
            if same_windows is not None and held >= same_windows:
                stopped = "envelope settled"
                break
        if k - newest >= window:
            stopped = "support set settled"
            break
        if k > 1 and np.abs(step).max(initial=0.0) <= tolerance * max(float(np.abs(x).max(initial=0.0)), 1.0):
            stopped = "flow tolerance"
            break
    masks = [np.unpackbits(b, count=mask.size).astype(bool) for b, _ in recent.values()]
    inner, union = np.logical_and.reduce(masks), np.logical_or.reduce(masks)
    return {
        "n_supports": len(masks), "n_contested": int((union & ~inner).sum()), "n_base": int(inner.sum()), "last_move": float(np.linalg.norm(step) / max(np.linalg.norm(x), 1e-30)),
        "settled": stopped != "not settled yet", "stopped_on": stopped, "iterations": k, "n_supports_seen": len(first)}


def inclusion(flows: DataFrame, congested: DataFrame, networks: DataFrame, rounds: int = 1000, window: int = 300, same_windows: int | None = None) -> DataFrame:
    """The scheme with the support of the current cost: distinct supports in the last window, contested pairs, flow change.

    ``settled`` says that a stop rule held, which one is in ``stopped_on``; a cell that needs more than ``rounds`` is not settled yet.
    """
    schema = "network string, mu double, n_supports long, n_contested long, n_base long, last_move double, settled boolean, stopped_on string, iterations long, n_supports_seen long"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        g, mu = graph_of(rows), float(rows["mu"].iloc[0])
        parts, demand = [rows[c].to_numpy() for c in ("fft", "capacity", "b", "power")], zone_demand(g.n, g.z)

        def load(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            y, _, support = g.load(bpr(x, *parts), demand, mu)
            return y, support.mask

        return pd.DataFrame([{"network": rows["network"].iloc[0], "mu": mu, **included(load, rows["x"].to_numpy(), rounds, window, same_windows)}])

    return _cells(flows, congested, networks).groupBy("network", "mu").applyInPandas(run, schema)


def full_graph(flows: DataFrame, congested: DataFrame, networks: DataFrame, rounds: int = 200) -> DataFrame:
    """Is the unrestricted model well-posed: spectral radius of exp(-mu cost) by power iteration, and value-iteration defect."""
    schema = "network string, mu double, radius double, ill_posed boolean, value_defect double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        g, mu = graph_of(rows), float(rows["mu"].iloc[0])
        weight = np.exp(-mu * rows["cost"].to_numpy())[:, None]
        v, radius = np.ones((g.n, 1)), 0.0
        for _ in range(rounds):
            # the shift by the identity makes the iteration settle on graphs whose cycles share a factor
            new = v + g.out_reduce(np.add, weight * v[g.head], 0.0)
            radius = float(new.max())
            v = new / max(radius, 1e-300)
        own = np.zeros((g.n, g.z))
        own[np.arange(g.z), np.arange(g.z)] = 1.0
        w = last = own
        for _ in range(60):
            last, w = w, own + np.where(g.from_dest.any(0), g.out_reduce(np.add, np.where(g.from_dest, 0.0, weight) * w[g.head], 0.0), 0.0)
        top = w.max()
        defect = float(np.abs(w - last).max() / top) if np.isfinite(top) and top else float("inf")
        return pd.DataFrame([{"network": rows["network"].iloc[0], "mu": mu, "radius": radius - 1.0, "ill_posed": radius - 1.0 >= 1.0, "value_defect": defect}])

    return _cells(flows, congested, networks).groupBy("network", "mu").applyInPandas(run, schema)


def solution_set(flows: DataFrame, congested: DataFrame, networks: DataFrame, averaging: int = 100, polishing: int = 30) -> DataFrame:
    """Two solutions per cell, with the support's cost tilted up and down: diameters, isolation radius, and whether it is unique."""
    schema = "network string, mu double, flow_diameter double, cost_diameter double, isolation_radius double, unique_flow boolean"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        g, mu = graph_of(rows), float(rows["mu"].iloc[0])
        parts = [rows[c].to_numpy() for c in ("fft", "capacity", "b", "power")]
        up, down = (solve_cell(g, rows["x"].to_numpy(), lambda x: bpr(x, *parts), mu, averaging, polishing, sign * 0.05 * parts[0])[0] for sign in (1, -1))
        cost = bpr(up, *parts)
        pi = g.potentials(cost)
        t, h = pi[g.tail], pi[g.head]
        zone_t, zone_h = (g.tail < g.z)[:, None], (g.head < g.z)[:, None]
        free = np.isfinite(t) & np.isfinite(h) & ~(g.no_thru & zone_h) & ~(g.zdc & zone_t) & ~g.from_dest & ~g.to_dest
        margin = float(np.abs(t[free] - h[free]).min()) if free.any() else float("nan")
        spread_ = float(np.abs(cost - bpr(down, *parts)).max())
        radius = margin / (2 * max(g.n - 1, 1))  # NaN: no link's membership is open
        return pd.DataFrame([{
            "network": rows["network"].iloc[0], "mu": mu, "flow_diameter": float(np.linalg.norm(up - down) / max(np.linalg.norm(up), 1e-30)), "cost_diameter": spread_,
            "isolation_radius": radius, "unique_flow": bool(np.isnan(radius) or radius > spread_)}])

    return _cells(flows, congested, networks).groupBy("network", "mu").applyInPandas(run, schema)


def unrestricted_load(g: Graph, cost: np.ndarray, demand: np.ndarray, mu: float, rounds: int = 120) -> np.ndarray:
    """Link flows of the model without supports: values and flows on the whole graph by repeated sweeps."""
    pi = g.potentials(cost)
    t, h = pi[g.tail], pi[g.head]
    with np.errstate(invalid="ignore"):
        share = np.where(np.isfinite(t) & np.isfinite(h) & ~g.from_dest, np.exp(np.clip(-mu * (cost[:, None] + h - t), -700, 50)), 0.0)
    own = np.zeros((g.n, g.z))
    own[np.arange(g.z), np.arange(g.z)] = 1.0
    w = own
    for _ in range(rounds):
        # beyond all bounds where the model is ill-posed
        w = np.minimum(own + g.out_reduce(np.add, share * w[g.head], 0.0), 1e200)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(w[g.tail] > 0, share * w[g.head], 0.0)
    total = g.out_reduce(np.add, p, 0.0)
    p = np.where(total[g.tail] > 0, p / np.maximum(total[g.tail], 1e-300), 0.0)
    z = moved = np.where(np.isfinite(pi), demand, 0.0)
    flow = np.zeros(len(cost))
    by_head = np.argsort(g.head, kind="stable")
    heads, at = np.unique(g.head[by_head], return_index=True)
    for _ in range(rounds):
        step = p * moved[g.tail]
        flow += step.sum(1)
        moved = np.zeros_like(z)
        moved[heads] = np.add.reduceat(step[by_head], at, axis=0)
        if moved.sum() <= 1e-10:
            break
    return flow


def recovered_dispersion(congested: DataFrame, networks: DataFrame, loads: DataFrame, grid: tuple[float, ...] = (0.5, 0.63, 0.79, 1.0, 1.26, 1.59, 2.0)) -> DataFrame:
    """The dispersion at which the unrestricted model comes closest to a load (network, mu, link_id, y), of a grid around mu.

    Every candidate is a row of its own, so that Spark spreads them; the best is an aggregation.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("link_id")
        g, y = graph_of(rows), rows["y"].to_numpy()
        x = unrestricted_load(g, rows["cost"].to_numpy(), zone_demand(g.n, g.z), float(rows["candidate"].iloc[0]))
        far = float(np.linalg.norm(x - y) / max(np.linalg.norm(y), 1e-30))
        return pd.DataFrame([{"network": rows["network"].iloc[0], "mu": rows["mu"].iloc[0], "candidate": rows["candidate"].iloc[0], "distance": far}])

    rows = flagged(congested, networks).select(*_NEEDED, "cost").join(loads, ["network", "link_id"])
    rows = rows.withColumn("candidate", F.explode(F.transform(F.array(*map(F.lit, grid)), lambda f: F.round(f * F.col("mu"), 6))))
    tried = spread(rows, "network", "mu", "candidate").groupBy("network", "mu", "candidate").applyInPandas(run, "network string, mu double, candidate double, distance double")
    return tried.groupBy("network", "mu").agg(F.min_by("candidate", F.struct("distance", "candidate")).alias("recovered"), F.min("distance").alias("distance"))
