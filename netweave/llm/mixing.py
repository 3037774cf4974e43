"""Mixing sources to target weights, by hierarchical budgets over a tree of domains, languages and sources.

Every leaf of the tree has a weight and a capacity (its tokens times its allowed repeats). A source's weight is spread
over its languages by their tokens; that of a source without documents over all languages. Budgets go down the tree in
proportion to weights; what a child can't take is first shared among its siblings, the other sources of its language,
and only what none of them can take goes back to the ancestor's other children. A leaf's budget is filled by whole epochs
and a prefix of one more epoch, each epoch in the order of a seeded hash.

Unless a total is given, it is the largest one at which every leaf with documents can take its budget, so that the only
shares missed are those of sources without documents, and, by their weight, of those that take their place.

The prefix needs no sort of a leaf: documents fall into hash ranges, whose token sums give the ranges that lie fully
inside the budget; only within the one range that the budget ends in are single documents ordered.

Edge cases: sources without a target (null too) are not used; targets without documents get a share of 0 and their
weight goes to siblings; null and empty texts have no tokens and are used in no epoch; null language is a leaf of its
own; non-positive weights or repeats count as 0; repeated doc_ids are documents of their own; ties of the hash go by
doc_id; an empty table gives shares of 0 and an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.tokenize import VOCABULARY, token_counts
from netweave.session import cut

RANGES = 4096
PATH = ("domain", "language", "source")


def share_out(budget: float, weights: list[float], capacities: list[float]) -> list[float]:
    """Split a budget by weight, none above its capacity; what is left over goes to the others by weight."""
    given = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    while open_ and budget > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if given[i] + budget * (weights[i] / total) >= capacities[i]]
        if not full:
            for i in open_:
                given[i] += budget * (weights[i] / total)
            return given
        for i in full:
            budget -= capacities[i] - given[i]
            given[i] = capacities[i]
        open_ = [i for i in open_ if i not in full]
        # the others start again from what is left
        budget += sum(given[i] for i in open_)
        for i in open_:
            given[i] = 0.0
    return given


def tree_budgets(leaves: list[dict], budget: float, path: tuple[str, ...] = PATH) -> list[float]:
    """The budget of each leaf (keys of path, weight, capacity): siblings take a shortage before ancestors do."""

    def down(members: list[int], level: int, budget: float) -> None:
        if level == len(path):
            out[members[0]] = budget
            return
        children: dict[object, list[int]] = {}
        for i in members:
            children.setdefault(leaves[i][path[level]], []).append(i)
        groups = [children[k] for k in sorted(children, key=lambda k: (k is None, str(k)))]
        weights = [sum(leaves[i]["weight"] for i in g) for g in groups]
        for g, b in zip(groups, share_out(budget, weights, [sum(leaves[i]["capacity"] for i in g) for g in groups])):
            down(g, level + 1, b)

    out = [0.0] * len(leaves)
    if leaves:
        down(list(range(len(leaves))), 0, budget)
    return out


def reachable_total(leaves: list[dict], path: tuple[str, ...] = PATH) -> float:
    """The largest total at which no leaf with documents falls short of its budget; 0 without such a leaf."""
    free = [leaf | {"capacity": float("inf") if leaf["capacity"] > 0 else 0.0} for leaf in leaves]
    parts = tree_budgets(free, 1e6, path)
    return min((1e6 * leaf["capacity"] / p for leaf, p in zip(leaves, parts) if p > 0), default=0.0)


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, language, n_tokens, copies) and the shares reached per source.

    total: tokens of the mixture; by default as many as meet every share that can be met. Shares tell whether the weight
    was reached within 0.01. Only one row per leaf reaches the driver, of which there are at most sources in ``targets``
    times languages.
    """
    spark = documents.sparkSession
    named = targets.where("source is not null").groupBy("source").agg(
        F.greatest(F.coalesce(F.first("weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce(F.first("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    domain = F.lit("corpus")
    language = F.substring(F.lower(F.trim("lang")), 1, 2)
    sized = token_counts(documents.select("doc_id", "source", language.alias("language"), "text"), vocabulary, keep=("doc_id", "source", "language"))
    sized = cut(sized.join(F.broadcast(named.select("source")), "source", "left_semi").where("n_tokens > 0"), "sized")

    of_source = {r.source: r for r in named.collect()}
    leaves = [r.asDict() for r in sized.groupBy("source", "language").agg(F.sum("n_tokens").alias("tokens")).collect()]
    of_all: dict[str, int] = {}
    for leaf in leaves:
        of_all[leaf["source"]] = of_all.get(leaf["source"], 0) + leaf["tokens"]
    of_language: dict[str | None, int] = {}
    for leaf in leaves:
        of_language[leaf["language"]] = of_language.get(leaf["language"], 0) + leaf["tokens"]
        target = of_source[leaf["source"]]
        leaf |= {"domain": "corpus", "weight": target.weight * leaf["tokens"] / of_all[leaf["source"]], "capacity": float(leaf["tokens"] * target.max_repeats)}
    for source in of_source.keys() - of_all.keys():
        for language, tokens in of_language.items():
            weight = of_source[source].weight * tokens / sum(of_language.values())
            leaves.append({"source": source, "language": language, "tokens": 0, "domain": "corpus", "weight": weight, "capacity": 0.0})
    budgets = tree_budgets(leaves, reachable_total(leaves) if total is None else float(total))
    plan = [(leaf["source"], leaf["language"], int(b // leaf["tokens"]), float(b - b // leaf["tokens"] * leaf["tokens"])) for leaf, b in zip(leaves, budgets) if leaf["tokens"]]
    plan = spark.createDataFrame(plan, "p_source string, p_language string, epochs long, rest double")

    # the last, partial epoch: a prefix in the order of a seeded hash
    spot = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    rows = sized.join(F.broadcast(plan), (F.col("source") == F.col("p_source")) & F.col("language").eqNullSafe(F.col("p_language"))).drop("p_source", "p_language")
    rows = rows.withColumn("spot", spot).withColumn("range", F.pmod(F.shiftrightunsigned("spot", 20), F.lit(RANGES)))
    leaf = ["source", "language"]
    sums = rows.groupBy(*leaf, "range", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.coalesce(F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", upto).where(F.col("before") < F.col("rest")).select(F.col("source").alias("s_source"), F.col("language").alias("s_language"), F.col("range").alias("s_range"), "before", (F.col("before") + F.col("tokens") <= F.col("rest")).alias("whole"))
    # at most RANGES rows per leaf, so the table of ranges may be broadcast
    on = (F.col("source") == F.col("s_source")) & F.col("language").eqNullSafe(F.col("s_language")) & (F.col("range") == F.col("s_range"))
    rows = rows.join(F.broadcast(sums), on, "left").drop("s_source", "s_language", "s_range")
    last = rows.where("not whole").withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    extra = F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    out = ["doc_id", "source", "language", "n_tokens"]
    mixed = (
        rows.where("whole is null or whole").select(*out, (F.col("epochs") + F.when(F.col("whole"), 1).otherwise(0)).alias("copies"))
        .unionByName(last.select(*out, (F.col("epochs") + extra).alias("copies"))).where("copies > 0")
    )
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    shares = named.join(used, "source", "left").na.fill(0, ["n_tokens", "n_documents", "most_copies"])
    whole = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
    shares = shares.withColumn("share", F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0))
    return mixed, shares.withColumn("reached", F.abs(F.col("share") - F.col("weight")) <= 0.01)
