"""The queries of the text and record problems, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm import consensus, mixing, pii, tokenize
from netweave.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.same_cell_pairs(table(spark, sf_dir, "corpus_sweep"))


def p6_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.representatives(table(spark, sf_dir, "corpus_sweep"))


def p6_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representatives' fields in which all records of the cell that have a value agree; the others are null."""
    records = table(spark, sf_dir, "corpus_sweep")
    fields = consensus.FIELDS
    own = F.coalesce("cell", F.concat(F.lit("record "), F.col("record_id").cast("string")))
    alike = consensus.cells(records).groupBy(own.alias("cell")).agg(F.min("record_id").alias("first_record_id"), *[(F.min(f) == F.max(f)).alias(f"same_{f}") for f in fields])
    both = consensus.representatives(records).join(alike.drop("cell"), "first_record_id")
    return both.select("first_record_id", "n_records", *[F.when(F.col(f"same_{f}"), F.col(f)).alias(f) for f in fields])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_ids(table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(table(spark, sf_dir, "documents"))


QUERIES = {
    "p6_found": p6_found,
    "p6_representatives": p6_representatives,
    "p6_agreed": p6_agreed,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_masked": p9_masked,
}

_CELL = "sweep_id, regexp_replace(regexp_replace(lower(network), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g'), printf('%.5e', mu)"
SQL = {
    "p6_agreed": f"""with r as (select *, case when sweep_id is null or network is null or mu is null then row(record_id, null, null) else row({_CELL}) end cell from corpus_sweep)
select min(record_id) first_record_id, count(*) n_records, """
    + ", ".join(f'case when min("{f}") = max("{f}") then min("{f}") end as "{f}"' for f in consensus.FIELDS)
    + " from r group by cell",
    "p6_found": f"with r as (select record_id, row({_CELL}) cell from corpus_sweep where sweep_id is not null and network is not null and mu is not null) "
    "select a.record_id record_id_a, b.record_id record_id_b from r a join r b on a.cell = b.cell and a.record_id < b.record_id",
}
