"""Readers of evidence files. Schemas are explicit and reading fails on records that don't fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD_REPORT = """schema string, started_at timestamp, target struct<base_url: string, local: boolean>,
 label string, file string,
 steps array<struct<name: string, method: string, path: string, requests: bigint, failures: bigint, error_rate: double,
                    latency_ms: struct<p50: double, p95: double, p99: double>>>,
 series array<struct<t: double, requests: bigint, p95_ms: double>>"""
HISTORY = """schema string, provider string, repository string,
 commits array<struct<sha: string, parents: array<string>, subject: string, committedAt: timestamp, kind: string,
   files: array<struct<path: string, oldPath: string, status: string, granularity: string,
                       ranges: array<struct<oldStart: int, oldCount: int, newStart: int, newCount: int>>>>,
   workItems: array<struct<workItem: string, source: string, kind: string, evidence: string>>>>,
 pullRequests array<struct<id: string, title: string, status: string, commits: array<string>, workItems: array<string>>>"""
WORK_ITEMS = "id int, revision int, type string, state string, title string, changedDate timestamp, description struct<text: string>, relations array<struct<kind: string, id: int>>"
TESTS = """format string, plans array<struct<id: int, name: string>>, testCases array<struct<id: int, title: string, suiteIds: array<int>>>,
 assignments array<struct<planId: int, suiteId: int, testCaseId: int>>, requirements array<struct<id: int, title: string, testCaseIds: array<int>>>"""
EVIDENCE = "id string, kind string, text string, source string, version string"


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON records with their file, failing on what the schema doesn't take."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("from_file", F.col("_metadata.file_path"))


def load_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    r = json_files(spark, path, LOAD_REPORT)
    key = ["started_at", F.col("target.base_url").alias("base_url")]
    return {
        "steps": r.select(*key, F.posexplode("steps").alias("pos", "s")).select("started_at", "base_url", "pos", "s.*"),
        "series": r.select(*key, F.explode("series").alias("p")).select("started_at", "base_url", "p.*"),
    }


def history(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Commits (order: oldest first), their files and hunks, work items and pull requests, as flat tables."""
    h = json_files(spark, path, HISTORY)
    c = h.select(F.size("commits").alias("n"), F.posexplode("commits").alias("pos", "c")).select((F.col("n") - F.col("pos") - 1).alias("order"), "c.*")
    files = c.select("sha", "order", F.explode("files").alias("f")).select("sha", "order", "f.*")
    return {
        "commits": c.select("sha", "order", "subject", "committedAt", "kind"),
        "files": files.drop("ranges"),
        "hunks": files.select("sha", "order", "path", F.explode("ranges").alias("r")).select("sha", "order", "path", F.col("r.newStart").alias("first"), (F.col("r.newStart") + F.col("r.newCount") - 1).alias("last")),
        "work_items": c.select("sha", "order", F.explode("workItems").alias("w")).select("sha", "order", "w.*"),
        "pull_requests": h.select(F.explode("pullRequests").alias("p")).select("p.*"),
    }


def work_items(spark: SparkSession, path: str) -> DataFrame:
    """The newest revision of each item; of equal ones the first file."""
    from ..operators.assembly import first_by

    rows = json_files(spark, path, WORK_ITEMS)
    return first_by(rows, ["id"], F.desc("revision"), F.desc("changedDate"), "from_file")


def test_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    t = json_files(spark, path, TESTS)
    return {k: t.select(F.explode(k).alias("x")).select("x.*") for k in ("plans", "testCases", "assignments", "requirements")}


def evidence_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVIDENCE).option("header", True).option("mode", "FAILFAST").option("multiLine", True).csv(path)


def evidence_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Markdown tables with the columns of EVIDENCE."""
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.btrim(c), F.lit("\\|"), F.lit("|")))
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|.*\|\s*$")).select(cells.alias("c")).where(F.size("c") == 5)
    names = [x.split()[0] for x in EVIDENCE.split(", ")]
    return rows.where(~F.col("c")[0].isin("id") & ~F.col("c")[0].rlike("^:?-+:?$")).select(*[F.col("c")[i].alias(n) for i, n in enumerate(names)])


def evidence_problems(items: DataFrame, links: DataFrame) -> DataFrame:
    """(problem, id): bad ids and kinds, repeated ids, links that don't go requirement - architecture - test."""
    bad = items.where(~F.col("id").rlike("^[A-Z][A-Z0-9]*-[0-9]+$")).select(F.lit("bad-id").alias("problem"), "id")
    kind = items.where(~F.col("kind").isin("requirement", "architecture", "test")).select(F.lit("bad-kind").alias("problem"), "id")
    twice = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated-id").alias("problem"), "id")
    k = items.groupBy("id").agg(F.min("kind").alias("kind"))
    j = links.join(k.withColumnsRenamed({"id": "from", "kind": "a"}), "from", "left").join(k.withColumnsRenamed({"id": "to", "kind": "b"}), "to", "left")
    ok = ((F.col("a") == "requirement") & (F.col("b") == "architecture")) | ((F.col("a") == "architecture") & (F.col("b") == "test"))
    wrong = j.where(~F.coalesce(ok, F.lit(False))).select(F.lit("bad-link").alias("problem"), F.concat("from", F.lit(" -> "), "to").alias("id"))
    return bad.union(kind).union(twice).union(wrong)


def text_files(spark: SparkSession, path: str, endings: list[str], exclude: list[str] = ()) -> DataFrame:
    """(file, text) of all files with the endings, recursively; excluded globs and generated folders out."""
    from ..functions.scalars import any_glob

    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    keep = F.lit(False)
    for e in endings:
        keep = keep | F.lower("file").endswith(e)
    skip = F.col("file").rlike(r"/(?:bin|obj|node_modules|dist|\.[^/]+)/|\.min\.js$|\.d\.ts$|/wwwroot/lib/")
    return rows.where(keep & ~skip & ~any_glob(F.col("file"), list(exclude)))
