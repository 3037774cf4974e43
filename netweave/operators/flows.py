"""Operators over deposited link flows: cleaning, cost, conservation, mixtures, windows of supports.

The flows table is the largest; every operator aggregates map-side by deposit or link and joins the links by network and
link id. No broadcast is forced: Spark broadcasts the links only while their size is below its threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.costs import NUDGE, bpr_cost, bpr_prime, clipped, decades, exact_sum, ratio_cap
from netweave.session import cut

#: A link counts as used above this flow.
USED = 1e-6


def clean_flows(flows: DataFrame) -> DataFrame:
    """One row per deposit and link: the last one written (of those, the larger); null, NaN and negative flows become 0.

    Repeated rows are few, so rows go straight to their deposit's partition; whatever is grouped by deposit afterwards
    needs no other shuffle. A deposit has as many rows as its network has links.
    """
    last = F.max(F.struct("written_at", F.coalesce(F.nanvl("x", F.lit(None)), F.lit(0.0)).alias("x")))
    return flows.repartition("deposit_id").groupBy("deposit_id", "network", "mu", "link_id").agg(last.alias("w")).select("deposit_id", "network", "mu", "link_id", clipped(F.col("w.x")).alias("x"))


def with_links(flows: DataFrame, links: DataFrame) -> DataFrame:
    return flows.join(links, ["network", "link_id"])


def link_costs(flows: DataFrame, links: DataFrame) -> DataFrame:
    """Cost and slope of each deposited link flow, in decades (null: zero), since they span far more than reports print."""
    both = with_links(flows, links)
    return both.select("deposit_id", "link_id", decades(bpr_cost()).alias("cost"), decades(bpr_prime()).alias("slope"), decades(ratio_cap("power")).alias("ratio_cap"))


def deposit_costs(flows: DataFrame, links: DataFrame) -> DataFrame:
    """Per deposit: links, total travel time, links above capacity, and the flat-cost diagnostic."""
    both = with_links(flows, links).withColumn("cost", bpr_cost()).withColumn("slope", bpr_prime())
    return both.groupBy("deposit_id").agg(
        F.count("*").alias("n_links"), decades(F.sum(F.col("x") * F.col("cost"))).alias("total_time"), F.count_if(F.col("x") > F.col("capacity")).alias("n_over_capacity"),
        F.count_if((F.col("slope") <= 0) & (F.col("x") > 0) & (F.col("fft") <= 0)).alias("n_flat_connectors"),
        F.count_if((F.col("slope") <= 0) & (F.col("x") > 0) & (F.col("fft") > 0)).alias("n_flat_links"),
        decades(F.min(F.when(F.col("slope") > 0, F.col("slope")))).alias("least_slope"),
    )


def conservation(flows: DataFrame, links: DataFrame, networks: DataFrame) -> DataFrame:
    """Per deposit: the largest and the summed imbalance at through nodes, and the total produced by zones.

    Each flow leaves its tail and enters its head: one explode and one aggregation by deposit and node.
    """
    both = with_links(flows, links).select("deposit_id", "network", F.explode(F.array(F.struct(F.col("tail").alias("node"), F.col("x").alias("x")), F.struct(F.col("head").alias("node"), (-F.col("x")).alias("x")))).alias("e"))
    nodes = both.groupBy("deposit_id", "network", F.col("e.node").alias("node")).agg(exact_sum(F.col("e.x")).alias("net"))
    nodes = nodes.join(networks.select("network", "n_zones"), "network").withColumn("through", F.col("node") >= F.col("n_zones"))
    return nodes.groupBy("deposit_id").agg(
        F.coalesce(F.max(F.when(F.col("through"), F.abs("net"))), F.lit(0.0)).alias("worst_imbalance"),
        F.coalesce(exact_sum(F.when(F.col("through"), F.abs("net"))), F.lit(0.0)).alias("summed_imbalance"),
        F.coalesce(exact_sum(F.when(~F.col("through") & (F.col("net") > 0), F.col("net"))), F.lit(0.0)).alias("produced"),
    )


def deposits(manifest: DataFrame, flows: DataFrame) -> DataFrame:
    """Deposits that hold flows, with their cell, in the order in which they were listed (k from 1 within a cell)."""
    held = flows.select("deposit_id", "network", "mu").distinct()
    listed = held.join(manifest.select(F.col("entry_id").alias("deposit_id"), "listed_at"), "deposit_id")
    return listed.withColumn("k", F.row_number().over(Window.partitionBy("network", "mu").orderBy("listed_at", "deposit_id")))


def latest_flows(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """The clean flows of the latest deposit of each cell; the last one listed wins. Only its raw rows are cleaned."""
    last = deposits(manifest, raw).groupBy("network", "mu").agg(F.max_by("deposit_id", F.struct("listed_at", "deposit_id")).alias("deposit_id"))
    return clean_flows(raw.join(last.select("deposit_id"), "deposit_id", "left_semi"))


def deposit_gaps(flows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Relative 2-norm and sup-norm distance of each deposit's flow from the one before it in its cell."""
    steps = deposits(manifest, flows)
    before = steps.select("network", "mu", (F.col("k") + 1).alias("k"), F.col("deposit_id").alias("before_id"))
    pairs = steps.join(before, ["network", "mu", "k"]).select("deposit_id", "before_id")
    old = flows.select(F.col("deposit_id").alias("before_id"), "link_id", F.col("x").alias("y"))
    both = flows.join(pairs, "deposit_id").join(old, ["before_id", "link_id"])
    square = lambda c: F.sqrt(exact_sum(c * c))
    x, y = F.col("x"), F.col("y")
    return both.groupBy("deposit_id").agg(
        F.round(square(x - y) / F.greatest(square(y), F.lit(1e-30)), 6).alias("gap_2"), F.round(F.max(F.abs(x - y)) / F.greatest(F.max(F.abs(y)), F.lit(1e-30)), 6).alias("gap_max"))


def mixtures(flows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The flow of the mixture of a cell's deposits, the k-th with weight k: per link, over the deposits that have it."""
    weighed = flows.join(deposits(manifest, flows).select("deposit_id", "k"), "deposit_id")
    return weighed.groupBy("network", "mu", "link_id").agg(F.round(exact_sum(F.col("x") * F.col("k")) / F.sum("k") + NUDGE, 6).alias("x"), F.count("*").alias("n_components"))


def running_means(flows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The running average of each link's flow over a cell's deposits (step 1/k)."""
    w = Window.partitionBy("network", "mu", "link_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = flows.join(deposits(manifest, flows).select("deposit_id", "k"), "deposit_id")
    return steps.select("deposit_id", "link_id", F.round(F.sum(F.col("x").cast("decimal(28,6)")).over(w).cast("double") / F.count("*").over(w) + NUDGE, 6).alias("mean_x"))


def contested_links(raw: DataFrame, manifest: DataFrame, window: int = 5) -> DataFrame:
    """Links whose membership is undecided over the last ``window`` supports of a cell: used in some, not in all.

    Only the raw rows of those deposits are cleaned.
    """
    steps = deposits(manifest, raw)
    size = steps.groupBy("network", "mu").agg(F.max("k").alias("n"))
    recent = steps.join(size, ["network", "mu"]).where(F.col("k") > F.col("n") - window).select("deposit_id", F.least("n", F.lit(window)).alias("w"))
    used = clean_flows(raw.join(recent.select("deposit_id"), "deposit_id", "left_semi")).where(F.col("x") > USED).join(recent, "deposit_id")
    return used.groupBy("network", "mu", "link_id").agg(F.count("*").alias("n_supports"), F.max("w").alias("w")).where(F.col("n_supports") < F.col("w")).select("network", "mu", "link_id", "n_supports")


def envelopes(flows: DataFrame, manifest: DataFrame, block: int = 4) -> DataFrame:
    """Tumbling windows of ``block`` supports per cell: sizes of intersection and union, and how many windows in a row were equal."""
    steps = deposits(manifest, flows).withColumn("block", F.floor((F.col("k") - 1) / block))
    sizes = steps.groupBy("network", "mu", "block").agg(F.count("*").alias("w")).where(F.col("w") == block)
    used = flows.where(F.col("x") > USED).join(steps.select("deposit_id", "block"), "deposit_id")
    links = used.groupBy("network", "mu", "block", "link_id").agg(F.count("*").alias("n")).join(sizes, ["network", "mu", "block"])
    digest = lambda c: F.substring(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(c))), 256), 1, 16)
    label = F.format_string("%06d", F.col("link_id"))
    inner = F.col("n") == F.col("w")
    blocks = links.groupBy("network", "mu", "block").agg(
        F.count_if(inner).alias("n_base"), F.count("*").alias("n_union"), digest(label).alias("union_digest"), digest(F.when(inner, label)).alias("base_digest"))
    w = Window.partitionBy("network", "mu").orderBy("block")
    same = F.coalesce((F.lag("union_digest").over(w) == F.col("union_digest")) & (F.lag("base_digest").over(w) == F.col("base_digest")), F.lit(False))
    marked = blocks.withColumn("same", same).withColumn("run", F.sum((~F.col("same")).cast("int")).over(w))
    held = F.row_number().over(Window.partitionBy("network", "mu", "run").orderBy("block"))
    return marked.select("network", "mu", "block", "n_base", "n_union", (F.col("n_union") - F.col("n_base")).alias("n_contested"), held.alias("windows_held"))


def envelope_changes(flows: DataFrame, manifest: DataFrame, block: int = 4) -> DataFrame:
    """Per cell and window: links that entered and left the union since the window before."""
    steps = deposits(manifest, flows).withColumn("block", F.floor((F.col("k") - 1) / block))
    used = flows.where(F.col("x") > USED).join(steps.select("deposit_id", "block"), "deposit_id").select("network", "mu", "block", "link_id").distinct()
    now = used.withColumn("now", F.lit(True))
    was = used.select("network", "mu", (F.col("block") + 1).alias("block"), "link_id", F.lit(True).alias("was"))
    blocks = steps.select("network", "mu", "block").distinct().where("block > 0")
    both = now.join(was, ["network", "mu", "block", "link_id"], "full_outer").join(blocks, ["network", "mu", "block"])
    return both.groupBy("network", "mu", "block").agg(F.count_if(F.col("was").isNull()).alias("n_entered"), F.count_if(F.col("now").isNull()).alias("n_left"))


def flow_digests(flows: DataFrame) -> DataFrame:
    """Per deposit: digest of its links and flows in link order, number of links and size as text."""
    row = F.format_string("%06d:%.6f", F.col("link_id"), F.col("x"))
    return flows.groupBy("deposit_id").agg(F.concat_ws(";", F.sort_array(F.collect_list(row))).alias("t")).select(
        "deposit_id", F.substring(F.sha2("t", 256), 1, 16).alias("digest"), F.length("t").cast("long").alias("n_bytes"))


def contested_top(contested: DataFrame, k: int = 4) -> DataFrame:
    """The k links of each cell that the most supports contest; ties go to the smaller link."""
    place = F.row_number().over(Window.partitionBy("network", "mu").orderBy(F.desc("n_supports"), "link_id"))
    return contested.withColumn("place", place).where(F.col("place") <= k)


def support_ages(flows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per cell: distinct supports, the step at which the newest was first seen, and how many steps ago that was."""
    label = F.format_string("%06d", F.col("link_id"))
    used = flows.groupBy("deposit_id").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("x") > USED, label)))), 256).alias("digest"))
    first = deposits(manifest, flows).join(used, "deposit_id").groupBy("network", "mu", "digest").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    return first.groupBy("network", "mu").agg(F.count("*").alias("n_supports"), F.max("first").alias("newest"), (F.max("last") - F.max("first")).alias("age"))


def face_sizes(contested: DataFrame, links: DataFrame) -> DataFrame:
    """Per cell: contested links and the distinct pairs of nodes they join, whichever way."""
    both = contested.join(links.select("network", "link_id", "tail", "head"), ["network", "link_id"])
    return both.groupBy("network", "mu").agg(F.count("*").alias("n_links"), F.count_distinct(F.least("tail", "head"), F.greatest("tail", "head")).alias("n_node_pairs"))


def representation_residuals(flows: DataFrame, parts: DataFrame, base: DataFrame, target: DataFrame) -> DataFrame:
    """Relative sup-norm distance of each cell's target flow from its mixture: network, mu, weight, residual.

    parts: network, mu, deposit_id, weight (null counts as 0); base and target: network, mu, deposit_id. What the weights
    lack of 1 goes to the base. Each deposit gets one signed coefficient, so that links are met in a single aggregation;
    a link that a deposit doesn't have is 0 in it. Cells without parts lie on their base; without target they have no row.
    """
    cell = ["network", "mu"]
    total = parts.groupBy(*cell).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    held = base.select(*cell, "deposit_id").join(total, cell, "left").select(*cell, "deposit_id", (1 - F.coalesce("weight", F.lit(0.0))).alias("c"), F.lit(0.0).alias("goal"))
    all_ = parts.select(*cell, "deposit_id", F.coalesce("weight", F.lit(0.0)).alias("c"), F.lit(0.0).alias("goal")).unionByName(held)
    all_ = all_.unionByName(target.select(*cell, "deposit_id", F.lit(0.0).alias("c"), F.lit(1.0).alias("goal"))).groupBy(*cell, "deposit_id").agg(F.sum("c").alias("c"), F.max("goal").alias("goal"))
    per_link = flows.join(all_, [*cell, "deposit_id"]).groupBy(*cell, "link_id").agg(F.sum(F.col("x") * F.col("c")).alias("mixed"), F.sum(F.col("x") * F.col("goal")).alias("wanted"))
    out = per_link.groupBy(*cell).agg((F.max(F.abs(F.col("mixed") - F.col("wanted"))) / F.greatest(F.max(F.abs("wanted")), F.lit(1e-30))).alias("residual"))
    return out.join(target.select(*cell), cell, "left_semi").join(total, cell, "left").select(*cell, F.coalesce("weight", F.lit(0.0)).alias("weight"), "residual")


def windows_represented(flows: DataFrame, manifest: DataFrame) -> DataFrame:
    """How far each cell's newest deposit is from the mixture of those before it: the k-th with weight k / n^2, the rest on the first.

    Cells of one deposit are left out.
    """
    steps = deposits(manifest, flows)
    sizes = steps.groupBy("network", "mu").agg(F.max("k").alias("n")).where("n > 1")
    steps = cut(steps.join(sizes, ["network", "mu"]), "steps")
    parts = steps.where("k < n").withColumn("weight", F.col("k") / (F.col("n") * F.col("n")))
    out = representation_residuals(flows, parts, steps.where("k = 1"), steps.where("k = n"))
    return out.select("network", "mu", F.round(F.col("weight") + NUDGE, 6).alias("weight"), F.round(F.col("residual") + NUDGE, 6).alias("residual"))


def comparison(differences: DataFrame, margins: DataFrame) -> DataFrame:
    """Per network: dispersions and cells compared, difference at the least and the greatest dispersion, fit, span of margins.

    differences: network, mu, difference; margins: network, mu, margin. Null differences are left out. The fit is that of
    log difference by log dispersion over positive differences, null below three of them or where all are alike.
    """
    d = differences.where("difference is not null").join(margins.select("network", "mu", "margin"), ["network", "mu"], "left")
    x, y = F.log(F.when(F.col("difference") > 0, F.col("mu"))), F.log(F.when(F.col("difference") > 0, F.col("difference")))
    enough = F.count_if(F.col("difference") > 0) >= 3
    return d.groupBy("network").agg(
        F.min("mu").alias("least_mu"), F.max("mu").alias("greatest_mu"), F.count("*").alias("n_cells"), F.min_by("difference", "mu").alias("first_difference"), F.max_by("difference", "mu").alias("last_difference"),
        F.when(enough, F.round(F.regr_slope(y, x), 6)).alias("slope"), F.when(enough, F.round(F.regr_r2(y, x), 6)).alias("r2"), F.min("margin").alias("least_margin"), F.max("margin").alias("greatest_margin"),
    )


def steps_compared(flows: DataFrame, manifest: DataFrame, certificates: DataFrame) -> DataFrame:
    """The comparison of each cell's newest deposit with the one before, beside the largest mixture residual of its certificates."""
    newest = deposits(manifest, flows).groupBy("network", "mu").agg(F.max_by("deposit_id", "k").alias("deposit_id"))
    differences = newest.join(deposit_gaps(flows, manifest), "deposit_id").select("network", "mu", F.col("gap_max").alias("difference"))
    held = certificates.where("mixture_residual >= 0 and mixture_residual < double('inf')").groupBy("network", F.round("mu", 6).alias("mu")).agg(F.max("mixture_residual").alias("margin"))
    return comparison(differences, held)
