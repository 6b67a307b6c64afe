"""Projects, requirements and the question interface on small tables."""

from pyspark.sql import functions as F

from graphloom.operators import projects as P
from graphloom.plans.api import Model


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_scope(spark):
    p = spark.createDataFrame([("App",), ("Lib",), ("Core",), ("Other",)], "project string")
    refs = spark.createDataFrame([("App", "Lib"), ("Lib", "Core"), ("Lib", "Gone")], "src string, dst string")
    assert rows(P.scope(p, refs, ["app"])) == [("App", "included"), ("Core", "stub"), ("Lib", "stub")]
    own = spark.createDataFrame([("App", "x"), ("Other", "x"), ("App", "y")], "project string, folder string")
    assert rows(P.shared_folders(own, p.where("project = 'App'"))) == [("x",)]


def test_requirements(spark):
    t = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("u", "c2")], "symbol string, sha string")
    i = spark.createDataFrame([("c1", "R1"), ("c2", "R1"), ("c2", "R2")], "sha string, requirement string")
    assert rows(P.symbols_of_requirements(t, i)) == [("R1", "s", 2), ("R1", "u", 1), ("R2", "s", 1), ("R2", "u", 1)]
    assert rows(P.requirements_of_symbols(t.select("symbol").distinct(), t, i, most=1)) == [("s", "R1", 2, 1), ("u", "R1", 1, 1)]
    touch = spark.createDataFrame([("old", "O", "()", "method", "f", 5, 1), ("new", "O", "()", "method", "f", 5, 2)], "id string, owner string, args string, kind string, file string, line int, order int")
    assert rows(P.renamed_from(touch, spark.createDataFrame([("new",)], "id string"))) == [("new", "old")]


def test_entities(spark):
    text = """<edmx:Edmx xmlns:edmx="e"><edmx:ConceptualModels><Schema xmlns="s"><EntityType Name="A"><NavigationProperty Relationship="M.Lost"/></EntityType><EntityType Name="B"/>
<Association Name="AB"><End Type="M.A"/><End Type="M.X"/></Association></Schema></edmx:ConceptualModels></edmx:Edmx>"""
    m = P.entity_model(spark.createDataFrame([("f", text)], "file string, text string"))
    assert rows(m["entities"], "entity") == [("A",), ("B",)] and rows(m["associations"], "name", "a", "b") == [("AB", "A", "X")]
    assert rows(P.entity_findings(m), "code", "name") == [("missing-association", "Lost"), ("missing-type", "X")]


def test_questions(spark):
    n = [("c", "class", "CoinsController", "src/Api/CoinsController.cs"), ("i", "interface", "ICoins", "src/Application/ICoins.cs"), ("s", "class", "CoinService", "src/Application/CoinService.cs"), ("r", "class", "CoinRepository", "src/Infrastructure/CoinRepository.cs")]
    nodes = spark.createDataFrame([(*x, 1, k) for k, x in enumerate(n)], "id string, kind string, name string, file string, line int, ord long")
    nodes = nodes.withColumns({"tags": F.array().cast("array<string>"), "route": F.lit(None).cast("string"), "doc": F.lit(None).cast("string"), "visibility": F.lit("public"), "complexity": F.lit(9), "params": F.lit(0)})
    edges = spark.createDataFrame([("c", "i", "calls", 0), ("s", "i", "implements", 1), ("s", "r", "calls", 2), ("r", "c", "calls", 3)], "from_id string, to_id string, kind string, ord long")
    m = Model(nodes, edges)
    assert [r.id for r in m.find_symbol("coin").collect()] == ["s", "r", "c", "i"] and rows(m.resolve("CoinService"), "id") == [("s",)]
    assert rows(m.callers("s"), "from_id", "via") == [("c", "i")] and rows(m.callees("s"), "to_id") == [("r",)]
    assert rows(m.trace_endpoint("c"), "node", "depth") == [("c", 0), ("i", 1), ("r", 2), ("s", 1)]
    assert rows(m.impact("r"), "id", "depth") == [("s", 1)]
    assert rows(m.violations(), "rule", "from_layer", "to_layer") == [("ARCH-001", "application", "infrastructure"), ("ARCH-001", "infrastructure", "api")]
    assert len(rows(m.gaps())) == 4 and m.context("c").count() >= 3 and m.module_summary("src").count() == 2
