"""Readers of the plain-text network and demand files of the transport community.

A network file has metadata tags, ``<END OF METADATA>``, then one link per line: tail, head, capacity, length, free-flow
time, b, power, ... ending in a semicolon. A demand file lists ``Origin n`` and ``dest : value;`` pairs. Both are read as
text by Spark; each line or origin is parsed by Column expressions.

Edge cases: blank lines, lines that begin with ~ or <, and lines whose numbers don't parse are skipped; a missing power
is 4; of repeated pairs the later one holds; an empty file gives an empty table. Files that don't belong together are
refused rather than guessed at: zone counts that differ, and origins that are no zone of the network. Destinations that
are none are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAGS = {"n_zones": "NUMBER OF ZONES", "n_nodes": "NUMBER OF NODES", "first_thru": "FIRST THRU NODE", "n_links": "NUMBER OF LINKS"}


class Mismatch(ValueError):
    """Files that don't describe the same network."""


def _name():
    return F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"_(net|trips)\.tntp$", "")


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """network and its four header numbers; first_thru is null where the file doesn't tell."""
    text = spark.read.text(path, wholetext=True).select(_name().alias("network"), "value")
    number = lambda tag: F.regexp_extract("value", rf"<{tag}>\s*(\d+)", 1).try_cast("int")
    return text.select("network", *[number(tag).alias(c) for c, tag in TAGS.items()])


def read_links(spark: SparkSession, path: str, networks: DataFrame | None = None, fft_floor: float = 0.0) -> DataFrame:
    """Links with 0-based ids in file order; free-flow times below fft_floor are raised between through nodes."""
    text = spark.read.text(path, wholetext=True).select(_name().alias("network"), F.posexplode(F.split(F.regexp_replace("value", r"(?s)^.*<END OF METADATA>", ""), r"\r?\n")).alias("pos", "line"))
    parts = F.split(F.trim(F.regexp_replace(F.regexp_replace("line", ";", " "), r"\s+", " ")), " ")
    get = lambda k, kind: F.get(parts, k).try_cast(kind)
    rows = text.where(~F.col("line").rlike(r"^\s*($|~|<)")).select(
        "network", "pos", get(0, "int").alias("tail"), get(1, "int").alias("head"), get(2, "double").alias("capacity"), get(4, "double").alias("fft"), get(5, "double").alias("b"), F.coalesce(get(6, "double"), F.lit(4.0)).alias("power"))
    rows = rows.where("tail is not null and head is not null and capacity is not null and fft is not null and b is not null")
    link = F.row_number().over(Window.partitionBy("network").orderBy("pos")) - 1
    rows = rows.select("network", link.alias("link_id"), (F.col("tail") - 1).alias("tail"), (F.col("head") - 1).alias("head"), "capacity", "fft", "b", "power")
    if fft_floor > 0 and networks is not None:
        rows = rows.join(networks.select("network", "n_zones"), "network")
        low = (F.col("tail") >= F.col("n_zones")) & (F.col("head") >= F.col("n_zones")) & (F.col("fft") < fft_floor)
        rows = rows.withColumn("fft", F.when(low, fft_floor).otherwise(F.col("fft"))).drop("n_zones")
    return rows


def read_demand(spark: SparkSession, path: str, networks: DataFrame) -> DataFrame:
    """network, origin, dest (0-based) and demand; pairs outside the network's zones are dropped."""
    text = spark.read.text(path, wholetext=True).select(_name().alias("network"), "value")
    blocks = text.select("network", F.posexplode(F.split("value", "Origin")).alias("pos", "block")).where("pos > 0")
    pairs = blocks.select("network", "pos", F.regexp_extract("block", r"^\s*(\d+)", 1).try_cast("int").alias("origin"), F.posexplode(F.regexp_extract_all("block", F.lit(r"(\d+)\s*:\s*[0-9.eE+-]+"), F.lit(0))).alias("at", "pair"))
    pairs = pairs.select("network", "pos", "at", "origin", F.regexp_extract("pair", r"^(\d+)", 1).try_cast("int").alias("dest"), F.regexp_extract("pair", r":\s*(\S+)$", 1).try_cast("double").alias("demand"))
    last = pairs.groupBy("network", "origin", "dest").agg(F.max_by("demand", F.struct("pos", "at")).alias("demand"))
    inside = last.join(networks.select("network", "n_zones"), "network").where("origin between 1 and n_zones and dest between 1 and n_zones and demand is not null")
    return inside.select("network", (F.col("origin") - 1).alias("origin"), (F.col("dest") - 1).alias("dest"), "demand")


def zone_mismatches(spark: SparkSession, path: str, networks: DataFrame) -> DataFrame:
    """Per demand file what speaks against its network: zones it declares, the network's, and origins that are no zone."""
    text = spark.read.text(path, wholetext=True).select(_name().alias("network"), "value")
    ids = F.transform(F.regexp_extract_all("value", F.lit(r"Origin\s+(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    told = text.select("network", F.regexp_extract("value", rf"<{TAGS['n_zones']}>\s*(\d+)", 1).try_cast("int").alias("declared"), ids.alias("ids"))
    both = told.join(networks.select("network", "n_zones"), "network", "left")
    strange = F.array_distinct(F.filter("ids", lambda x: (x < 1) | (x > F.col("n_zones"))))
    return both.withColumn("strange", strange).where(F.col("n_zones").isNull() | (F.col("declared") != F.col("n_zones")) | (F.size("strange") > 0)).select("network", "declared", "n_zones", "strange")


def read_matched(spark: SparkSession, networks_path: str, demand_path: str, fft_floor: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Networks, links and demand of files that belong together; raises Mismatch, naming the first few that don't."""
    networks = read_networks(spark, networks_path)
    odd = zone_mismatches(spark, demand_path, networks).orderBy("network").limit(5).collect()
    if odd:
        raise Mismatch("; ".join(f"{r.network}: {r.declared} zones declared, {r.n_zones} in the network, no zones: {(r.strange or [])[:5]}" for r in odd))
    return networks, read_links(spark, networks_path, networks, fft_floor), read_demand(spark, demand_path, networks)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """name, network_file, demand_file of each folder of root that holds both; the first of several by name.

    Folders that begin with an underscore are left out. Only the listing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tntp").load(root).select("path")
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file")).where(~F.col("name").startswith("_"))
    kinds = [(r"_net\.tntp$", "network_file"), (r"_trips.*\.tntp$", "demand_file")]
    found = named.groupBy("name").agg(*[F.min(F.when(F.col("file").rlike(p), F.col("path"))).alias(c) for p, c in kinds])
    return found.where("network_file is not null and demand_file is not null")


def select(cat: DataFrame, names: list[str] | None = None, max_links: int | None = None, networks: DataFrame | None = None) -> DataFrame:
    """The named entries of a catalog (all, if none are named), with at most max_links links by the networks' headers.

    Raises KeyError for names that the catalog doesn't have. ``networks`` (network, n_links) is needed with max_links.
    """
    if names is not None:
        wanted = cat.sparkSession.createDataFrame([(n.strip(), i) for i, n in enumerate(names)], "name string, place int")
        missing = sorted(r.name for r in wanted.join(cat, "name", "left_anti").collect())
        if missing:
            raise KeyError(f"not in the catalog: {', '.join(missing)}")
        cat = cat.join(wanted, "name")
    if max_links is not None:
        cat = cat.join(networks.where(F.col("n_links") <= max_links).select(F.col("network").alias("name")), "name", "left_semi")
    return cat


def load_named(spark: SparkSession, root: str, name: str, fft_floor: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Networks, links and demand of one catalog entry."""
    entry = select(catalog(spark, root), [name]).first()
    return read_matched(spark, entry.network_file, entry.demand_file, fft_floor)
