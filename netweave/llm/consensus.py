"""Best representative of each duplicate group, by token-level consensus.

Records of one cell (sweep, network and mu, however written) form a group. For each field the group's distinct values,
with the summed weights of their records, are split into tokens and aligned progressively, heaviest first; the tokens
vote per aligned column with their weights; and of the existing values the one closest to the consensus is emitted.
A record weighs by the trust in its origin, its completeness, and how far behind the cell's latest record it lies.

Alignment goes by blocks at every size: ``ceil(distinct values / BLOCK)`` blocks by a hash of the value, each aligned
progressively, and their profiles aligned with each other in rounds. With one block that is plain progressive alignment.
A value with more than half of its field's weight wins every column it takes part in, so that it is the consensus
itself and needs no alignment.

Records that are alone in their cell are copied. Cells of at most BLOCK records come together as rows and are settled in
one go. Larger cells are never gathered: their values collapse by an aggregation per cell and field, only fields with
more than one value are aligned, and the distance to the consensus is taken value by value.

Edge cases: a null never competes with a value, a field null in all records stays null; NaN and infinite numbers win only
where there is nothing else; records without sweep, network or mu form no cell and are their own representatives; ties go
to the heavier, then the smaller value; an empty table gives empty results; columns beside the known ones are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.session import cut, map_rows, shuffle_width, spread

#: Trust by origin of a record; any other origin has DEFAULT_TRUST.
TRUST = {"primary": 1.0, "cluster": 1.0, "resent": 0.8, "mirror": 0.7, "archive": 0.6}
DEFAULT_TRUST, HALF_LIFE_SECONDS = 0.5, 6 * 3600.0
FIELDS = [
    "exhibit", "n_nodes", "n_zones", "n_links", "gate_revision", "cores", "converged", "stopped_on", "unresolved", "residual", "polish_method", "iterations",
    "resumed_from", "conservation_max", "support_changes_final", "support_measured", "budget_seconds", "seconds", "peak_rss_mb", "origin", "recorded_at",
]
BLOCK, GAP = 64, ""
_TOKEN = re.compile(r"\d+|[^\W\d_]+|\s+|.", re.S)


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


def align(profile: list[dict[str, float]], other: list[dict[str, float]]) -> list[dict[str, float]]:
    """Global alignment of two profiles (token weights per column); both lengths may differ."""
    a = [sum(c.values()) for c in profile]
    b = [sum(c.values()) for c in other]
    total_a, total_b = max(a, default=0.0), max(b, default=0.0)
    if not profile or not other:
        pad = total_b if profile else total_a
        return [c | {GAP: c.get(GAP, 0.0) + pad} for c in (profile or other)]
    n, m = len(profile), len(other)
    fit = [[sum(w * q.get(t, 0.0) for t, w in p.items() if t) / (x * y) for q, y in zip(other, b)] for p, x in zip(profile, a)]
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = -0.4 * i
    for j in range(1, m + 1):
        score[0][j] = -0.4 * j
    for i in range(1, n + 1):
        above, row, fits = score[i - 1], score[i], fit[i - 1]
        for j in range(1, m + 1):
            row[j] = max(above[j - 1] + fits[j - 1] - 0.3, above[j] - 0.4, row[j - 1] - 0.4)
    out, i, j = [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + fit[i - 1][j - 1] - 0.3:
            i, j, p, q = i - 1, j - 1, profile[i - 1], other[j - 1]
        elif i and score[i][j] == score[i - 1][j] - 0.4:
            i, p, q = i - 1, profile[i - 1], {GAP: total_b}
        else:
            j, p, q = j - 1, {GAP: total_a}, other[j - 1]
        out.append({t: p.get(t, 0.0) + q.get(t, 0.0) for t in p.keys() | q.keys()})
    return out[::-1]


def profile_of(values: list[tuple[str, float]]) -> list[dict[str, float]]:
    """Progressive alignment of weighted values, heaviest first."""
    out: list[dict[str, float]] = []
    for k, (value, weight) in enumerate(sorted(values, key=lambda v: (-v[1], v[0]))):
        one = [{t: weight} for t in tokens(value)]
        out = one if k == 0 else align(out, one)
    return out


def vote(profile: list[dict[str, float]]) -> list[str]:
    return [t for t in (max(sorted(c), key=c.__getitem__) for c in profile) if t != GAP]


def distance(a: list[str], b: list[str]) -> int:
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(values: list[tuple[str, float]]) -> str:
    """The existing value closest to the consensus of all."""
    heaviest = max(values, key=lambda v: v[1])
    if 2 * heaviest[1] > sum(w for _, w in values) * (1 + 1e-12):
        return heaviest[0]
    wanted = vote(profile_of(values))
    return min(values, key=lambda v: (distance(tokens(v[0]), wanted), -v[1], v[0]))[0]


def network_meant(name: str) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""), F.lit(""))


def mu_meant(name: str) -> Column:
    """Six digits of mu, as text."""
    return F.format_string("%.5e", F.col(name).cast("double"))


def cells(records: DataFrame) -> DataFrame:
    """The records with cell: an id shared by all records of the same sweep, network and mu; null where one is missing."""
    parts = [F.col("sweep_id").cast("string"), network_meant("network"), F.when(F.col("mu").isNotNull(), mu_meant("mu"))]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return records.withColumn("cell", F.when(known, F.concat_ws("|", *parts)))


def same_cell_pairs(records: DataFrame, block_rows: int = 2000) -> DataFrame:
    """record_id_a < record_id_b of each two records of one cell; repeated rows count once.

    The pairs are the result that is asked for. A cell of more than block_rows records is cut into blocks on one side,
    so that no task gets a whole hot cell; the list of such cells is written first, so that Spark knows its size.
    """
    held = cut(cells(records).where("cell is not null").select("cell", "record_id").distinct(), "held")
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    spread = held.join(cut(sizes.where("blocks > 1"), "heavy"), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = spread.select("cell", F.col("record_id").alias("record_id_a"), F.pmod(F.hash("record_id"), F.col("blocks")).alias("block"))
    right = spread.select("cell", F.col("record_id").alias("record_id_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["cell", "block"]).where("record_id_a < record_id_b").select("record_id_a", "record_id_b")


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        chosen = [closest([(v["value"], v["weight"]) for v in vs]) for vs in batch["values"]]
        yield pd.DataFrame({"cell": batch["cell"], "field": batch["field"], "value": chosen})


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [json.dumps(profile_of([(v["value"], v["weight"]) for v in vs])) for vs in batch["values"]]
        yield pd.DataFrame({"cell": batch["cell"], "field": batch["field"], "block": batch["block"], "profile": out})


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for texts in batch["profiles"]:
            whole: list[dict[str, float]] = []
            for k, text in enumerate(sorted(texts, key=lambda t: (-len(t), t))):
                whole = json.loads(text) if k == 0 else align(whole, json.loads(text))
            out.append(json.dumps(whole))
        yield pd.DataFrame({"cell": batch["cell"], "field": batch["field"], "block": batch["block"], "profile": out})


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"cell": batch["cell"], "field": batch["field"], "wanted": [vote(json.loads(p)) for p in batch["profile"]]})


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch = batch.assign(distance=[distance(tokens(v), list(w)) for v, w in zip(batch["value"], batch["wanted"])])
        yield batch[["cell", "field", "value", "weight", "distance"]]


def _weight(fields: list[str]) -> Column:
    """The weight of a record that knows ``newest``, the latest time of its cell."""
    trust = F.coalesce(F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])[F.col("origin")], F.lit(DEFAULT_TRUST))
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) / len(fields)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    recent = F.coalesce(F.pow(F.lit(0.5), (seconds("newest") - seconds("recorded_at")) / HALF_LIFE_SECONDS), F.lit(0.01))
    return trust * filled * F.greatest(recent, F.lit(1e-6))


#: How much NaN and infinite numbers weigh against others, and the least weight of a value.
ODD, LEAST = 1e-9, 1e-9


def weighted_values(weighed: DataFrame, fields: list[str]) -> DataFrame:
    """cell, field, value, weight: the distinct values of each field with the summed weights (w) of their records."""
    numbers = {n for n, t in weighed.dtypes if t in ("double", "float")}

    def one(f: str) -> Column:
        odd = (F.isnan(f) | (F.abs(F.col(f)) == float("inf"))) if f in numbers else F.lit(False)
        return F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.when(odd, ODD).otherwise(1.0).alias("sound"))

    each = weighed.select("cell", "w", F.explode(F.array(*map(one, fields))).alias("v")).where("v.value is not null")
    return each.groupBy("cell", F.col("v.field").alias("field"), F.col("v.value").alias("value")).agg(F.greatest(F.round(F.sum(F.col("w") * F.col("v.sound")), 9), F.lit(LEAST)).alias("weight"))


def consensus_tokens(hot: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """cell, field, wanted: the tokens that win each column of hot fields (cell, field, value, weight, block of width).

    A profile holds every distinct token of its field and stays in this step; what goes on to the values is one token per
    column, voted once per cell and field.
    """
    keys = ["cell", "field"]
    profiles = "cell string, field string, block long, profile string"
    level = hot.groupBy(*keys, "block").agg(F.collect_list(F.struct("value", "weight")).alias("values")).mapInPandas(_profiles, profiles)
    while width > 1:
        level = level.withColumn("block", F.floor(F.col("block") / block)).groupBy(*keys, "block").agg(F.collect_list("profile").alias("profiles"))
        level = cut(level.mapInPandas(_merged, profiles), "profiles")
        width = -(-width // block)
    return cut(level.mapInPandas(_votes, "cell string, field string, wanted array<string>"), "wanted")


def consensus_values(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """cell, field, value: the existing value closest to the consensus of each cell and field."""
    spark = values.sparkSession
    schema = "cell string, field string, value string"
    keys = ["cell", "field"]
    values = cut(values, "values")
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"))
    many = cut(sizes.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / F.lit(block))), "many")
    few = values.join(many.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.collect_list(F.struct("value", "weight")).alias("values"))
    chosen = few.where("size(values) = 1").select(*keys, F.col("values")[0]["value"].alias("value"))
    chosen = chosen.unionByName(spread(few.where("size(values) > 1")).mapInPandas(_choose, schema))
    if many.isEmpty():
        return chosen
    hot = values.join(many, keys).withColumn("block", F.pmod(F.xxhash64("value"), F.col("blocks")))
    wanted = consensus_tokens(hot, many.agg(F.max("blocks")).first()[0], block)
    # one short list per hot field; the values stay where they are unless Spark finds the lists too large to send
    far = values.join(wanted, keys).mapInPandas(_distances, f"{schema}, weight double, distance long")
    best = far.groupBy(*keys).agg(F.min(F.struct("distance", (-F.col("weight")).alias("w"), "value")).alias("b")).select(*keys, F.col("b.value").alias("value"))
    return chosen.unionByName(best)


def _settle(fields: list[str], numbers: list[bool]):
    """Per cell: the best value of each field among its few records, given as (w, value of each field as text)."""

    def field(at: int, members: list) -> str | None:
        weights: dict[str, float] = {}
        for m in members:
            v = m[at]
            if v is not None:
                weights[v] = weights.get(v, 0.0) + m["w"] * (ODD if numbers[fields.index(at)] and v in ("NaN", "Infinity", "-Infinity") else 1.0)
        if len(weights) < 2:
            return next(iter(weights), None)
        return closest([(v, max(round(w, 9), LEAST)) for v, w in weights.items()])

    def run(found: list, held: list) -> Iterator[tuple]:
        for cell, members in zip(found, held):
            yield cell, *(field(f, members) for f in fields)

    return run


def representatives(records: DataFrame, fields: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per cell with the best value of each field; records without a cell stand for themselves.

    Rows are shuffled once, to their cell. Cells with more than a fair share of a task's rows (at most four per task, so
    that their list has a bound of its own) are kept out of that shuffle.
    """
    spark, fields = records.sparkSession, fields or FIELDS
    kinds = dict(records.dtypes)
    named = cells(records.select("record_id", "sweep_id", "network", "mu", *[f for f in fields]))
    grouped = named.withColumn("cell", F.coalesce("cell", F.concat(F.lit("record "), F.col("record_id").cast("string"))))
    heads = cut(grouped.groupBy("cell").agg(
        F.min("record_id").alias("first_record_id"), F.count("*").alias("n_records"), F.max("sweep_id").alias("sweep_id"), F.max(network_meant("network")).alias("network"),
        F.max(F.expr("try_cast(format_string('%.5e', cast(mu as double)) as double)")).alias("mu"), F.max("recorded_at").alias("newest")), "heads")
    share = (heads.agg(F.sum("n_records")).first()[0] or 0) // (4 * shuffle_width(spark))
    sized = heads.select("cell", "n_records", "newest")
    rows = grouped.select("cell", *fields)
    hottest = sized.where(F.col("n_records") > max(block, share))
    apart = rows.join(F.broadcast(hottest), "cell")
    others = rows.join(F.broadcast(hottest.select("cell")), "cell", "left_anti").join(sized, "cell")

    alone = others.where("n_records = 1").select("cell", *fields)
    texts = F.struct(_weight(fields).alias("w"), *[F.col(f).cast("string").alias(f) for f in fields])
    some = others.where((F.col("n_records") > 1) & (F.col("n_records") <= block)).groupBy("cell").agg(F.collect_list(texts).alias("members"))
    some = map_rows(some, _settle(fields, [kinds[f] in ("double", "float") for f in fields]), "cell string, " + ", ".join(f"`{f}` string" for f in fields))
    best = alone.unionByName(some.select("cell", *[F.col(f).try_cast(kinds[f]).alias(f) for f in fields]))
    if not heads.where(F.col("n_records") > block).isEmpty():
        weighed = others.where(F.col("n_records") > block).unionByName(apart).withColumn("w", _weight(fields))
        hot = consensus_values(weighted_values(weighed, fields), block)
        best = best.unionByName(hot.groupBy("cell").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).try_cast(kinds[f]).alias(f) for f in fields]))
    return heads.drop("newest").join(best, "cell", "left").drop("cell")
