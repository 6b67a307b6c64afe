"""Sinks: model and index files, an SBOM, and writing only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import package_url


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def sbom_components(inventory: DataFrame) -> DataFrame:
    """One CycloneDX component per (ecosystem, package, version), as JSON in order of the package URL."""
    purl = package_url(F.col("ecosystem"), F.col("package"), F.col("version"))
    c = inventory.select(purl.alias("purl"), F.to_json(F.struct(F.lit("library").alias("type"), F.col("package").alias("name"), F.col("version").alias("version"), purl.alias("purl"))).alias("component"))
    return c.distinct().orderBy("purl")


def changed_pages(pages: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, change): pages (path, content) whose content hash is new, other or gone."""
    from ..operators.joins import row_diff

    h = lambda df: df.select("path", F.sha2("content", 256).alias("h"))
    return row_diff(h(previous), h(pages), "path", "h")


def scan_summary(nodes: DataFrame) -> DataFrame:
    """Counts by file ending and by kind."""
    ending = F.lower(F.regexp_extract("file", r"(\.[A-Za-z0-9]+)$", 1))
    by = lambda what, c: nodes.groupBy(c.alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("by"), "value", "n")
    return by("ending", ending).union(by("kind", F.col("kind")))
