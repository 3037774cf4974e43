"""Operators over result records: latest per cell, coverage, headlines, pivots, fits, timings and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.costs import exact_sum, scientific, spelled

#: A record counts as solved below this residual, and conserves below that error; the dispersions of the corpus.
SOLVED_BELOW, CONSERVES_BELOW = 1e-8, 1e-6
DISPERSIONS = (0.5, 1.0, 2.0, 5.0, 10.0)


def named(records: DataFrame) -> DataFrame:
    """Records with network and mu written alike."""
    key = F.regexp_replace(F.regexp_replace(F.lower("network"), "[^a-z0-9]+", "-"), "^-|-$", "")
    return records.withColumn("network", key).withColumn("mu", F.round("mu", 6))


def sound(c: str) -> Column:
    """The column where it is a finite number of at least 0, else null."""
    return F.when((F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c))


def latest(records: DataFrame, keys: list[str] = ("network", "mu"), order: list[str] = ("recorded_at", "record_id")) -> DataFrame:
    """The record written last for each key; a map-side aggregation, no sort of a group."""
    last = records.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in records.columns if c not in (*keys, *order)])).alias("r"))
    return last.select(*keys, "r.*")


def solved(c: str = "residual") -> Column:
    return F.coalesce((sound(c) < SOLVED_BELOW) & (sound("conservation_max") < CONSERVES_BELOW), F.lit(False))


def headline(records: DataFrame) -> DataFrame:
    """Per sweep: cells, networks, solved and unresolved cells and the worst solved residual, over the latest records."""
    last = latest(named(records), ["sweep_id", "network", "mu"])
    return last.groupBy("sweep_id").agg(
        F.count("*").alias("n_cells"), F.countDistinct("network").alias("n_networks"), F.count_if(solved()).alias("n_solved"), F.count_if(F.coalesce("unresolved", F.lit(False))).alias("n_unresolved"),
        scientific(F.max(F.when(solved(), F.col("residual")))).alias("worst_residual"), spelled(F.count_if(solved())).alias("n_solved_text"),
    )


def tiers(records: DataFrame) -> DataFrame:
    """Per network: size, tier by links and half by size (ntile over networks: one row each)."""
    sizes = named(records).groupBy("network").agg(F.max("n_nodes").alias("n_nodes"), F.max("n_zones").alias("n_zones"), F.max("n_links").alias("n_links"))
    tier = F.when(F.col("n_links") < 100, "small").when(F.col("n_links") < 250, "medium").otherwise("large")
    return sizes.select("*", tier.alias("tier"), F.ntile(2).over(Window.orderBy("n_links", "network")).alias("half"))


def by_dispersion(records: DataFrame) -> DataFrame:
    """Per network the worst residual of the latest records for each dispersion, as columns."""
    last = latest(named(records))
    pivoted = last.groupBy("network").pivot("mu", list(DISPERSIONS)).agg(F.max(sound("residual")))
    return pivoted.select("network", *[scientific(F.col(f"`{m}`"), 3).alias("mu_" + f"{m:g}".replace(".", "_")) for m in DISPERSIONS])


def fits(records: DataFrame) -> DataFrame:
    """Per network the log-log slope and fit of run time by dispersion; null below three dispersions."""
    means = named(records).where((sound("seconds") > 0) & (F.col("seconds") < 864000)).groupBy("network", "mu").agg((exact_sum(F.col("seconds"), 3) / F.count("*")).alias("s"))
    x, y = F.log(F.col("mu")), F.log(F.col("s"))
    fit = means.groupBy("network").agg(F.count("*").alias("n_points"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    enough = F.col("n_points") >= 3
    return fit.select("network", "n_points", F.when(enough, F.round(-F.col("slope"), 6)).alias("order"), F.when(enough, F.round("r2", 6)).alias("r2"))


def spans(records: DataFrame) -> DataFrame:
    """Per network the range of iterations and memory."""
    return named(records).groupBy("network").agg(F.min("iterations").alias("least_iterations"), F.max("iterations").alias("most_iterations"), F.round(F.min("peak_rss_mb"), 3).alias("least_mb"), F.round(F.max("peak_rss_mb"), 3).alias("most_mb"))


def timings(records: DataFrame) -> DataFrame:
    """Per dispersion: timed records, range of seconds and the slowest cell's network."""
    timed = named(records).where((sound("seconds") > 0) & (F.col("seconds") <= 864000))
    return timed.groupBy("mu").agg(
        F.count("*").alias("n_records"), F.round(F.min("seconds"), 4).alias("least_seconds"), F.round(F.max("seconds"), 4).alias("most_seconds"), exact_sum(F.col("seconds"), 3).alias("total_seconds"),
        F.max(F.struct("seconds", "network")).getField("network").alias("slowest"),
    )


def cells_held(records: DataFrame) -> DataFrame:
    return named(records).select("sweep_id", "network", "mu").distinct()


def coverage(records: DataFrame, networks: DataFrame) -> DataFrame:
    """Per sweep: cells declared but not held, and held but not declared; declared are all networks times all dispersions."""
    clean = networks.select(F.lower("network").alias("network"), F.lit(True).alias("known"))
    n_declared = clean.count() * len(DISPERSIONS)
    held = cells_held(records).join(clean, "network", "left")
    declared = F.col("known").isNotNull() & F.col("mu").isin(*DISPERSIONS)
    return held.groupBy("sweep_id").agg((F.lit(n_declared) - F.count_if(declared)).alias("n_pending"), F.count_if(~declared).alias("n_undeclared"), F.count("*").alias("n_held"))


def pending(records: DataFrame, certificates: DataFrame) -> DataFrame:
    """Cells solved in the corpus sweep that no certificate sweep holds."""
    done = latest(named(records), ["sweep_id", "network", "mu"]).where(solved()).select("network", "mu").distinct()
    return done.join(named(certificates).select("network", "mu").distinct(), ["network", "mu"], "left_anti")


def margins(records: DataFrame, certificates: DataFrame) -> DataFrame:
    """Latest corpus record beside the latest certificate of each cell."""
    held = latest(named(certificates)).select("network", "mu", "n_contested", "certified", "verdict_kind")
    return latest(named(records)).select("network", "mu", "record_id", scientific(sound("residual"), 3).alias("residual")).join(held, ["network", "mu"], "left")


def vintages(records: DataFrame) -> DataFrame:
    """Per sweep: gate revisions, core counts and origins among its records; more than one is a finding."""
    return records.groupBy("sweep_id").agg(
        F.countDistinct("gate_revision").alias("n_revisions"), F.countDistinct("cores").alias("n_cores"), F.count_if(F.col("gate_revision").isNull()).alias("n_without_revision"),
        F.concat_ws(",", F.sort_array(F.collect_set("origin"))).alias("origins"), (F.countDistinct("gate_revision") > 1).alias("mixed"),
    )


def convergence(records: DataFrame) -> DataFrame:
    """Per stop reason: records, converged ones, and those that claim convergence without a small residual."""
    return records.groupBy(F.coalesce("stopped_on", F.lit("unknown")).alias("stopped_on")).agg(
        F.count("*").alias("n_records"), F.count_if("converged").alias("n_converged"), F.count_if(F.col("converged") & ~F.coalesce(sound("residual") < SOLVED_BELOW, F.lit(False))).alias("n_doubtful"))


def cell_index(records: DataFrame) -> DataFrame:
    """Number of each cell within its sweep, by network and dispersion, as array jobs want it."""
    return cells_held(records).select("*", (F.row_number().over(Window.partitionBy("sweep_id").orderBy("network", "mu")) - 1).alias("cell"))


def verdicts(certificates: DataFrame) -> DataFrame:
    """Per verdict: records, certified ones, and mean contested pairs."""
    return certificates.groupBy(F.coalesce("verdict_kind", F.lit("none")).alias("verdict")).agg(
        F.count("*").alias("n_records"), F.count_if("certified").alias("n_certified"), F.round(F.sum("n_contested") / F.count("n_contested"), 6).alias("mean_contested"))


def resumed(records: DataFrame) -> DataFrame:
    """Per cell: continued runs, and those that resume from an iteration no record of the cell reached."""
    r = named(records)
    starts = r.where("resumed_from is not null").select("sweep_id", "network", "mu", "resumed_from").distinct()
    reached = r.select("sweep_id", "network", "mu", F.col("iterations").alias("resumed_from")).distinct().withColumn("there", F.lit(True))
    return starts.join(reached, ["sweep_id", "network", "mu", "resumed_from"], "left").groupBy("network").agg(F.count("*").alias("n_resumed"), F.count_if(F.col("there").isNull()).alias("n_broken"))
