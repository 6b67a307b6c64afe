"""Questions to a model: one method each, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALLOW, LAYERS
from ..functions import scalars as S
from ..operators import graph as G
from ..operators import joins as J
from ..operators import projects as P
from ..operators import rules as R
from ..operators import windows as W


class Model:
    """Nodes and edges (graphloom.model) and what is asked of them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def find_symbol(self, text: str, limit: int = 50) -> DataFrame:
        return J.find_names(self.nodes.select("id", "kind", "name", "file", "line"), text, limit)

    def resolve(self, text: str) -> DataFrame:
        """The candidates of the first way that finds any: id, name, file, folder, VERB /route; several rows are ambiguous."""
        n = self.nodes
        ways = [F.col("id") == text, F.col("name") == text, F.col("file") == text, S.under(F.col("file"), text), S.route_key(F.get("tags", 1), F.col("route")) == S.route_key(F.lit(text.split(" ")[0]), F.lit(text.split(" ")[-1]))]
        way = F.coalesce(*[F.when(w, F.lit(k)) for k, w in enumerate(ways)])
        hits = n.withColumn("way", way).where("way IS NOT NULL")
        return hits.join(F.broadcast(hits.agg(F.min("way").alias("best"))), F.col("way") == F.col("best")).drop("best")  # best is one row

    def callers(self, id: str) -> DataFrame:
        """Direct callers, and those of an interface that the symbol implements, with via."""
        e = self.edges.where("kind IN ('calls', 'creates', 'accesses', 'injects', 'http')")
        up = self.edges.where((F.col("kind") == "implements") & (F.col("from_id") == id)).select(F.col("to_id").alias("via"))
        direct = e.where(F.col("to_id") == id).select("from_id", "kind", F.lit(None).cast("string").alias("via"))
        return direct.union(e.join(up, e.to_id == up.via).select("from_id", "kind", "via")).distinct()

    def callees(self, id: str) -> DataFrame:
        return self.edges.where((F.col("from_id") == id) & ~F.col("kind").isin("implements", "inherits", "contains")).select("to_id", "kind").distinct()

    def trace_endpoint(self, id: str) -> DataFrame:
        e = self.edges.where("kind IN ('calls', 'accesses', 'http', 'renders', 'routes-to', 'connects')").select(F.col("from_id").alias("u"), F.col("to_id").alias("v"), F.lit(1).alias("cost"))
        i = self.edges.where("kind = 'implements'").select(F.col("to_id").alias("u"), F.col("from_id").alias("v"), F.lit(0).alias("cost"))
        start = self.nodes.where(F.col("id") == id).select(F.col("id").alias("start"))
        return G.flow_trace(e.union(i), start)

    def module_summary(self, folder: str) -> DataFrame:
        return self.nodes.where(S.under(F.col("file"), folder)).groupBy("kind").agg(F.count("*").alias("n"), F.max("complexity").alias("most_complex"), F.count("doc").alias("with_doc"))

    def impact(self, id: str, depth: int = 4) -> DataFrame:
        """Who reaches the symbol, by least distance."""
        back = self.edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
        return G.closure(back, self.nodes.where(F.col("id") == id).select(F.col("id").alias("src")), depth).select(F.col("dst").alias("id"), "depth")

    def violations(self, layers: dict | None = None, allow: dict | None = None) -> DataFrame:
        n = R.with_layer(self.nodes.select("id", "file"), layers or LAYERS)
        side = lambda end, p: n.select(F.col("id").alias(end), F.col("layer").alias(f"{p}_layer"), F.col("file").alias(f"{p}_file"))
        e = self.edges.join(side("from_id", "from"), "from_id").join(side("to_id", "to"), "to_id", "left")
        return R.layer_violations(e.withColumn("to_key", F.coalesce("to_file", "to_id")), allow or ALLOW)

    def cycles(self) -> DataFrame:
        return R.folder_cycles(self.edges, self.nodes)

    def gaps(self) -> DataFrame:
        """Symbols of medium need or more without a doc."""
        calls = self.edges.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("fan_in"))
        n = self.nodes.join(calls, "id", "left").withColumns({"effects": F.lit(0), "is_type": F.col("kind").isin("class", "interface", "record", "struct", "enum")})
        return R.need_score(n).where("level IN ('high', 'medium') AND doc IS NULL").select("id", "level", "score", "reasons")

    def requirements_for_symbol(self, id: str, touches: DataFrame, items: DataFrame) -> DataFrame:
        return P.requirements_of_symbols(self.nodes.where(F.col("id") == id).select(F.col("id").alias("symbol")), touches, items)

    def symbols_for_requirement(self, requirement: str, touches: DataFrame, items: DataFrame) -> DataFrame:
        return P.symbols_of_requirements(touches, items.where(F.col("requirement") == requirement))

    def context(self, id: str, hops: int = 2, budget: int = 6000) -> DataFrame:
        """Lines about a symbol in order of weight, within a budget of tokens (four characters each)."""
        e = self.edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
        near = G.hops(e, self.nodes.where(F.col("id") == id).select(F.col("id").alias("start")), min(max(hops, 1), 4))
        own = self.nodes.where(F.col("id") == id).select(F.lit(0).alias("block"), F.concat_ws(" ", "kind", "id", F.concat("file", F.lit(":"), F.col("line"))).alias("line"))
        rows = near.join(self.nodes.select("id", "kind"), "id").select(F.col("hop").alias("block"), F.concat_ws(" ", F.concat(F.lit("hop "), "hop"), "kind", "id", F.concat(F.lit("via "), "via")).alias("line"))
        lines = own.union(rows).withColumn("all", F.lit(0))
        return W.within_budget(lines, ["all"], ["block", "line"], F.length("line") + 1, budget * 4).select("block", "line")
