"""Tied faces as relations: nested atoms of the weights, their marginals and ring slack, and walk counters of the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nested_atoms(weights: DataFrame) -> DataFrame:
    """Atoms of nested supports: with weights sorted down, atom k admits the k heaviest links and has the step below them as mass.

    weights: the flat table ``weight`` of netweave.core.nested. The last atom (k = number of links) admits all; the
    mass 1 - largest weight admits none (k = 0).
    """
    w = weights.where("kind = 'tied' and weight between 0 and 1").groupBy("record_id", "face_pos", "dest", "link").agg(F.max("weight").alias("w"))
    order = Window.partitionBy("record_id", "face_pos").orderBy(F.desc("w"), "dest", "link")
    steps = w.select("record_id", "face_pos", F.row_number().over(order).alias("n_admitted"), (F.col("w") - F.coalesce(F.lead("w").over(order), F.lit(0.0))).alias("mass"))
    none = w.groupBy("record_id", "face_pos").agg((1 - F.max("w")).alias("mass")).select("record_id", "face_pos", F.lit(0).alias("n_admitted"), "mass")
    return steps.unionByName(none).where("mass > 0").select("record_id", "face_pos", "n_admitted", F.round("mass", 9).alias("mass"))


def marginals(weights: DataFrame) -> DataFrame:
    """Per face: links, summed marginals of its atoms, total mass, and slack of a ring of all its links."""
    a = nested_atoms(weights)
    totals = a.groupBy("record_id", "face_pos").agg(F.round(F.sum("mass"), 6).alias("total_mass"), F.round(F.sum(F.col("mass") * F.col("n_admitted")), 6).alias("admitted"), F.max("n_admitted").alias("most_admitted"))
    return totals.withColumn("ring_slack", F.round(F.col("most_admitted") - 1 - F.col("admitted"), 6))


def walk_counters(rounds: DataFrame) -> DataFrame:
    """Per record: rounds, converged ones, retired pairs, phases and the largest residual."""
    return rounds.groupBy("record_id").agg(
        F.count("*").alias("n_rounds"), F.count_if(F.coalesce("converged", F.lit(False))).alias("n_converged"), F.coalesce(F.sum("retired"), F.lit(0)).alias("n_retired"),
        F.countDistinct(F.nullif("phase", F.lit(""))).alias("n_phases"), F.max("residual").alias("worst_residual"))
