"""The fact model: schemas of nodes, edges and snapshots, and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

NODES = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("id", "kind", "name", "file")]
    + [T.StructField(c, T.IntegerType()) for c in ("line", "end_line", "complexity", "params")]
    + [T.StructField(c, T.StringType()) for c in ("visibility", "doc", "hash", "route", "returns", "language")]
    + [T.StructField(c, _strings) for c in ("tags", "parameters", "throws", "events", "state", "hooks", "responses")]
    + [T.StructField("ord", T.LongType(), False)]
)
EDGES = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("from_id", "to_id", "kind")]
    + [T.StructField("label", T.StringType()), T.StructField("ord", T.LongType(), False)]
)

#: Edge kinds that are dependencies, and all kinds that a rule may name.
DEPENDENCY_KINDS = ("calls", "injects", "implements", "inherits", "imports", "renders", "routes-to", "persists", "publishes", "subscribes", "http", "creates")
EDGE_KINDS = (*DEPENDENCY_KINDS, "contains", "accesses", "registers", "connects", "reads", "binds", "references", "depends-on", "tests", "uses-namespace", "pipeline", "hosts")


def model_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id, n): ids that several nodes share, and edge ends that no node has (legal, but worth knowing)."""
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate-id").alias("problem"), "id", "n")
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    loose = ends.join(nodes, "id", "left_anti").groupBy("id").agg(F.count("*").alias("n")).select(F.lit("dangling-end").alias("problem"), "id", "n")
    return twice.unionByName(loose)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str, snapshot: str) -> None:
    """Write one snapshot as two Parquet tables, edges clustered by kind so that kind filters prune."""
    nodes.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(f"{path}/nodes")
    edges.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot", "kind").parquet(f"{path}/edges")


def read_snapshot(spark: SparkSession, path: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{path}/{t}").where(F.col("snapshot") == snapshot).drop("snapshot")
    edges = read("edges")
    return read("nodes"), edges.select(*[f.name for f in EDGES if f.name in edges.columns], *[c for c in edges.columns if c not in EDGES.names])
