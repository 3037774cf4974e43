"""Loading on given supports, in rounds of join and aggregation: values from the destinations back, flows from the origins on.

A support is a frame (network, dest, link_id, tail, head, cost, pi_tail, pi_head). A round moves one link on, for all
destinations and dispersions of all networks together; what a round found is one partition of a written table, which the
next round reads and the result aggregates. There are as many rounds as the longest path of a support has links. State is
rows (network, mu, dest, node), never the matrix of a network, so that the size of a network is no limit of a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.session import cut, work_dir

KEYS = ("network", "mu", "dest")
#: Bounds of the exponent of a choice share.
LEAST_EXPONENT, MOST_EXPONENT = -700.0, 50.0


class Cyclic(ValueError):
    """A support closes a cycle: a walk along it is longer than any path can be."""


class NoSupport(KeyError):
    """A destination has demand but no support."""


def _hops(front: DataFrame, step: Callable[[DataFrame], DataFrame], most: int, what: str) -> DataFrame:
    """The fronts of all hops, from the given one until a step gives none; walks of more than ``most`` links raise."""
    spark, schema, path = front.sparkSession, front.schema, work_dir(front.sparkSession, what)
    for hop in range(most + 2):
        here = f"{path}/hop={hop}"
        front.select(*schema.names).write.parquet(here)
        front = spark.read.schema(schema).parquet(here)
        if front.isEmpty():
            return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
        front = step(front)
    raise Cyclic(f"a walk along a support has more than {most} links")


def _longest(support: DataFrame) -> int:
    """Links that a path can have at most: a network's tails."""
    return support.groupBy("network").agg(F.count_distinct("tail").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def shares(support: DataFrame, mus: tuple[float, ...]) -> DataFrame:
    """The unscaled share exp(-mu (cost + pi(head) - pi(tail))) of each pair of link and destination, for each dispersion."""
    slack = F.col("cost") + F.col("pi_head") - F.col("pi_tail")
    rows = support.select("network", "dest", "link_id", "tail", "head", slack.alias("slack"), F.explode(F.array(*map(F.lit, mus))).alias("mu"))
    return rows.withColumn("share", F.exp(F.greatest(F.least(-F.col("mu") * F.col("slack"), F.lit(MOST_EXPONENT)), F.lit(LEAST_EXPONENT)))).drop("slack")


def weights(share: DataFrame, most: int) -> DataFrame:
    """Sum over all paths of the support from each node to its destination of the product of shares: network, mu, dest, node, w."""

    def step(front: DataFrame) -> DataFrame:
        moved = front.withColumnRenamed("node", "head").join(share, [*KEYS, "head"])
        return moved.groupBy(*KEYS, F.col("tail").alias("node")).agg(F.sum(F.col("w") * F.col("share")).alias("w"))

    front = share.select(*KEYS).distinct().select(*KEYS, F.col("dest").alias("node"), F.lit(1.0).alias("w"))
    return _hops(front, step, most, "weights").groupBy(*KEYS, "node").agg(F.sum("w").alias("w"))


def values(support: DataFrame, mus: tuple[float, ...]) -> DataFrame:
    """Log-sum-exp of the costs of all paths of a support: network, mu, dest, node, value; a missing row is minus infinity.

    Destinations without any support have no row.
    """
    support = cut(support.select("network", "dest", "link_id", "tail", "head", "cost", "pi_tail", "pi_head"), "support")
    ends = support.select("network", "dest", F.explode(F.array(F.struct(F.col("tail").alias("node"), F.col("pi_tail").alias("pi")), F.struct(F.col("head").alias("node"), F.col("pi_head").alias("pi")))).alias("e"))
    pi = ends.groupBy("network", "dest", F.col("e.node").alias("node")).agg(F.max("e.pi").alias("pi"))
    found = weights(cut(shares(support, mus), "shares"), _longest(support))
    # only a destination that no link of its support enters has no potential there: it is 0
    return found.join(pi, ["network", "dest", "node"], "left").where("w > 0").select(*KEYS, "node", (F.log("w") - F.col("mu") * F.coalesce("pi", F.lit(0.0))).alias("value"))


def load(support: DataFrame, demand: DataFrame, mus: tuple[float, ...]) -> DataFrame:
    """Flow of each link of a support when demand (network, origin, dest, demand) is loaded on it: network, mu, link_id, y.

    Null or zero demand and demand within a node moves nothing; an origin that the support doesn't lead on keeps its
    demand. A destination with demand and without any support raises NoSupport, a support with a cycle Cyclic. Repeated
    rows of demand add up; a repeated link of a support is an error of the caller and counts twice.
    """
    wanted = demand.where("demand > 0 and origin <> dest").groupBy("network", "dest", F.col("origin").alias("node")).agg(F.sum("demand").alias("z"))
    wanted = cut(wanted, "wanted")
    support = cut(support.select("network", "dest", "link_id", "tail", "head", "cost", "pi_tail", "pi_head"), "support")
    lost = wanted.select("network", "dest").distinct().join(support.select("network", "dest").distinct(), ["network", "dest"], "left_anti").first()
    if lost is not None:
        raise NoSupport(f"{lost.network}: destination {lost.dest} has demand but no support")
    share, most = cut(shares(support, mus), "shares"), _longest(support)
    w = cut(weights(share, most), "w")
    at = lambda end: w.select(*KEYS, F.col("node").alias(end), F.col("w").alias(f"w_{end}"))
    chance = share.join(at("tail"), [*KEYS, "tail"]).join(at("head"), [*KEYS, "head"]).where("w_tail > 0")
    chance = cut(chance.select(*KEYS, "link_id", "tail", "head", (F.col("share") * F.col("w_head") / F.col("w_tail")).alias("p")), "chance")

    def step(front: DataFrame) -> DataFrame:
        moved = front.withColumnRenamed("node", "tail").join(chance, [*KEYS, "tail"])
        return moved.groupBy(*KEYS, F.col("head").alias("node")).agg(F.sum(F.col("z") * F.col("p")).alias("z"))

    front = wanted.select("network", F.explode(F.array(*map(F.lit, mus))).alias("mu"), "dest", "node", "z")
    through = _hops(front, step, most, "through").groupBy(*KEYS, F.col("node").alias("tail")).agg(F.sum("z").alias("z"))
    return chance.join(through, [*KEYS, "tail"], "left").groupBy("network", "mu", "link_id").agg(F.sum(F.coalesce("z", F.lit(0.0)) * F.col("p")).alias("y"))
