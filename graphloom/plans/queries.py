"""One query per operator on the test tables: a projection into the operator's shape, the operator, a
projection of its result. ORACLE_SQL holds the same in SQL, written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Architecture, Rule, Selector
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import assembly as M
from ..operators import graph as G
from ..operators import joins as J
from ..operators import rules as R
from ..operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def whole(name: str, *cuts: str) -> str:
    """The SQL of a query without the filters that keep it to a part of its table."""
    sql = ORACLE_SQL[name]
    for c in cuts:
        assert c in sql, (name, c)
        sql = sql.replace(c, "")
    return sql


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- layers and rules -------------------------------------------------------------------------------

LAYERS = {"api": ["src/AFRICA/*"], "domain": ["src/A*"], "ui": ["src/EUROPE/*"]}
ALLOWED = {"ui": ["api"], "api": ["domain"], "domain": []}
LAYER_SQL = "CASE WHEN r_name ILIKE 'AFRICA' THEN 'api' WHEN r_name ILIKE 'A%' THEN 'domain' WHEN r_name ILIKE 'EUROPE' THEN 'ui' END"
NATION_EDGES_SQL = """SELECT c.c_nationkey AS a, s.s_nationkey AS b, l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey"""


def nations(spark, sf) -> DataFrame:
    n = t(spark, sf, "nation").join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("src/"), "r_name", F.lit("/"), "n_name").alias("file"), F.col("n_nationkey").cast("long").alias("ord"))


def nation_edges(spark, sf) -> DataFrame:
    """One row per lineitem: a, the customer's nation; b, the supplier's."""
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey"))
    s = t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("a", "b")


def layered_edges(spark, sf) -> DataFrame:
    n = R.with_layer(nations(spark, sf), LAYERS)
    side = lambda k, p: n.select(F.col("id").alias(k), F.col("layer").alias(f"{p}_layer"), F.col("file").alias(f"{p}_file"), F.col("ord").alias(f"{p}_ord"))
    e = nation_edges(spark, sf).groupBy("a", "b").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(side("a", "from")), "a").join(F.broadcast(side("b", "to")), "b")


@query(f"""WITH l AS (SELECT n_nationkey AS k, {LAYER_SQL} AS layer FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS ({NATION_EDGES_SQL})
SELECT f.layer AS from_layer, g.layer AS to_layer, count(*) AS edges, (f.layer = 'ui' AND g.layer = 'api') OR (f.layer = 'api' AND g.layer = 'domain') AS allowed
FROM e JOIN l f ON e.a = f.k JOIN l g ON e.b = g.k WHERE f.layer <> g.layer GROUP BY ALL""")
def layer_dependency_counts(spark, sf):
    allowed = spark.createDataFrame([(k, v) for k, v in ALLOWED.items()], "from_layer string, may array<string>")
    return A.layer_dependencies(layered_edges(spark, sf), allowed, weight="n")


@query(f"""WITH l AS (SELECT n_nationkey AS k, {LAYER_SQL} AS layer, 'src/' || r_name || '/' || n_name AS file FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT DISTINCT a, b FROM ({NATION_EDGES_SQL})),
bad AS (SELECT CASE WHEN f.layer = 'ui' THEN 'ARCH-004' ELSE 'ARCH-001' END AS rule, f.layer AS from_layer, g.layer AS to_layer, f.file AS from_file, g.file AS to_key
  FROM e JOIN l f ON e.a = f.k JOIN l g ON e.b = g.k
  WHERE (f.layer, g.layer) IN (('ui', 'domain'), ('api', 'ui'), ('domain', 'ui'), ('domain', 'api')))
SELECT DISTINCT rule, CASE rule WHEN 'ARCH-004' THEN 'low' ELSE 'high' END AS severity, from_layer, to_layer, from_file, to_key, CASE rule WHEN 'ARCH-004' THEN 'api' END AS via FROM bad""")
def layer_violations(spark, sf):
    e = layered_edges(spark, sf).select("from_layer", "to_layer", "from_file", F.col("to_file").alias("to_key"), F.lit("calls").alias("kind"), (F.col("from_ord") * 1000 + F.col("to_ord")).alias("ord"))
    return R.layer_violations(e, ALLOWED).drop("ord")


@query(f"""WITH n AS (SELECT n_nationkey AS k, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey), e AS (SELECT DISTINCT a, b FROM ({NATION_EDGES_SQL}))
SELECT 'NO-ASIA' AS rule, 'low' AS severity, 'src/' || f.r_name || '/' || f.n_name AS from_file, 'src/' || g.r_name || '/' || g.n_name AS to_key
FROM e JOIN n f ON e.a = f.k JOIN n g ON e.b = g.k WHERE f.r_name = 'AFRICA' AND g.r_name = 'ASIA' AND f.n_name NOT ILIKE '%_1%'""")
def custom_rule_violations(spark, sf):
    e = layered_edges(spark, sf)
    for p in ("from", "to"):
        e = e.withColumns({f"{p}_kinds": F.array(F.lit("nation")), f"{p}_all_tags": F.array().cast("array<string>"), f"{p}_names": F.array(F.element_at(F.split(f"{p}_file", "/"), -1))})
    e = e.withColumns({"kind": F.lit("calls"), "to_namespace": F.lit(""), "to_key": F.col("to_file"), "ord": F.col("from_ord") * 1000 + F.col("to_ord")})
    rule = Rule("NO-ASIA", Selector(layer="api"), to=Selector(path="src/ASIA/*", kind="nat*"), exceptions=Selector(name="NATION_1*"), severity="low")
    return R.custom_violations(e, Architecture(LAYERS, ALLOWED, (rule,)))


TOP2_SQL = f"""SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS k FROM ({NATION_EDGES_SQL}) GROUP BY a, b) WHERE k <= 2"""


def top_partners(spark, sf) -> DataFrame:
    e = nation_edges(spark, sf).groupBy("a", "b").agg(F.count("*").alias("n"))
    return W.top_with_rest(e, ["a"], 2, F.desc("n"), "b").select("a", "b")


@query(f"""WITH p AS (SELECT DISTINCT a, b FROM ({TOP2_SQL}) WHERE a <> b), o AS (SELECT a AS module, count(*) AS fan_out FROM p GROUP BY 1), i AS (SELECT b AS module, count(*) AS fan_in FROM p GROUP BY 1)
SELECT coalesce(o.module, i.module) AS module, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, round(coalesce(fan_out, 0) / (coalesce(fan_in, 0) + coalesce(fan_out, 0)), 6) AS instability
FROM o FULL JOIN i ON o.module = i.module""")
def module_coupling(spark, sf):
    return A.coupling(top_partners(spark, sf)).withColumn("instability", F.round("instability", 6))


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM ({TOP2_SQL}) WHERE a <> b), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""")
def module_cycles(spark, sf):
    return G.strong_components(top_partners(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst")))


WEAK_SQL = """SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' AND l_quantity >= 49 AND o_orderpriority LIKE '1%' AND o_orderkey % 4 = 0"""


@query(f"""WITH RECURSIVE e AS ({WEAK_SQL}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
m AS (SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a)
SELECT id, component, dense_rank() OVER (ORDER BY component) AS number FROM m""")
def weak_components(spark, sf):
    lines = t(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 49").select("l_orderkey", "l_suppkey")
    o = t(spark, sf, "orders").where("o_orderpriority LIKE '1%' AND o_orderkey % 4 = 0").select("o_orderkey", "o_custkey")
    e = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    v = e.select(F.explode(F.array("src", "dst")).alias("id"))
    return G.weak_components(e, v).withColumn("number", F.col("number").cast("long"))


@query()
def weak_components_all(spark, sf):
    """weak_components over every line and order; recursive SQL doesn't follow, a test compares it to brute force."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    e = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    v = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(t(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey")))
    return G.weak_components(e, v.union(e.select(F.explode(F.array("src", "dst"))))).withColumn("number", F.col("number").cast("long"))


def containment(spark, sf) -> DataFrame:
    """(parent, child, ord): region, nation, customer."""
    n = t(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.lit(0).alias("ord"))
    return n.union(t(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"), F.lit(0)))


@query("""SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS root FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def containment_roots(spark, sf):
    return G.containment_roots(containment(spark, sf))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0)
SELECT 'c' || c_custkey AS id, 'c' || c_custkey AS ancestor FROM c UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM c UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM c""")
def ancestors(spark, sf):
    ids = t(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return G.ancestors(containment(spark, sf), ids)


@query(f"""{whole("ancestors", " WHERE c_acctbal < 0")} UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region""")
def ancestors_all(spark, sf):
    c, r = containment(spark, sf), t(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return G.ancestors(c, c.select(F.col("child").alias("id")).union(r))


FLOW_SQL = """SELECT DISTINCT 'n' || c_nationkey AS s, 'c' || c_custkey AS c, 'o' || o_orderkey AS o, 's' || l_suppkey AS p FROM customer JOIN orders ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' AND l_quantity >= 45"""


def flow_edges(spark, sf, every: bool = False) -> DataFrame:
    """nation - customer (1) - order (0) - supplier (1); of every line and order, or of large and urgent ones."""
    lines = t(spark, sf, "lineitem").where(F.lit(every) | F.expr("l_quantity >= 45")).select("l_orderkey", "l_suppkey")
    o = t(spark, sf, "orders").where(F.lit(every) | F.expr("o_orderpriority LIKE '1%'")).select("o_orderkey", "o_custkey")
    x = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    ends = F.array(
        F.struct(F.concat(F.lit("n"), "c_nationkey").alias("u"), F.concat(F.lit("c"), "c_custkey").alias("v"), F.lit(1).alias("cost")),
        F.struct(F.concat(F.lit("c"), "c_custkey").alias("u"), F.concat(F.lit("o"), "o_orderkey").alias("v"), F.lit(0).alias("cost")),
        F.struct(F.concat(F.lit("o"), "o_orderkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v"), F.lit(1).alias("cost")),
    )
    return x.select(F.explode(ends).alias("e")).select("e.*").distinct()


#: Traces by session, folder and extent: several queries read one.
TRACES: dict[tuple, DataFrame] = {}


def traced(spark, sf, every: bool = False) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, every)
    if key not in TRACES:
        TRACES[key] = new_trace(spark, sf, every)
    return TRACES[key]


def new_trace(spark, sf, every: bool) -> DataFrame:
    starts = t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start"))
    return G.flow_trace(flow_edges(spark, sf, every), starts)


@query(f"""WITH f AS ({FLOW_SQL})
SELECT 'n' || n_nationkey AS start, 'n' || n_nationkey AS node, 0 AS depth, NULL AS via FROM nation
UNION ALL SELECT DISTINCT s, c, 1, s FROM f UNION ALL SELECT DISTINCT s, o, 1, c FROM f UNION ALL SELECT s, p, 2, min(o) FROM f GROUP BY s, p""")
def flow_trace(spark, sf):
    return traced(spark, sf)


#: What keeps the flow queries to large and urgent orders.
FLOW_CUT = " WHERE o_orderpriority LIKE '1%' AND l_quantity >= 45"


@query(whole("flow_trace", FLOW_CUT))
def flow_trace_all(spark, sf):
    return traced(spark, sf, every=True)


@query(f"""WITH f AS ({FLOW_SQL}) SELECT p AS unit, count(DISTINCT s) AS starts FROM f GROUP BY p UNION ALL SELECT c, count(DISTINCT s) FROM f GROUP BY c""")
def flow_backlinks(spark, sf, every: bool = False):
    trace = traced(spark, sf, every)
    orders = flow_edges(spark, sf, every).where("cost = 0").groupBy("v").agg(F.min("u").alias("owner"))
    units = trace.select("node").distinct().join(orders, F.col("node") == F.col("v"), "left").select("node", F.coalesce("owner", "node").alias("unit"))
    return G.backlinks(G.flow_units(trace, units))


@query(whole("flow_backlinks", FLOW_CUT))
def flow_backlinks_all(spark, sf):
    return flow_backlinks(spark, sf, every=True)


@query(f"""WITH f AS ({FLOW_SQL}), r AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS k, count(*) OVER (PARTITION BY s) AS n FROM (SELECT DISTINCT s, p FROM f))
SELECT s AS start, string_agg(p, ', ' ORDER BY p) || CASE WHEN max(n) > 6 THEN ' +' || (max(n) - 6) ELSE '' END AS chain FROM r WHERE k <= 6 GROUP BY s""")
def flow_chains(spark, sf, every: bool = False):
    u = traced(spark, sf, every).where("depth = 2").select("start", F.col("node").alias("unit"), F.col("depth").alias("hop"))
    return G.flow_chains(u)


@query(whole("flow_chains", FLOW_CUT))
def flow_chains_all(spark, sf):
    return flow_chains(spark, sf, every=True)


@query(f"""WITH f AS ({FLOW_SQL}), bad AS (SELECT 's' || s_suppkey AS p FROM supplier WHERE s_acctbal < 0)
SELECT 'SEC-005' AS rule, s AS start, f.p AS node, 2 AS depth FROM f JOIN bad ON f.p = bad.p GROUP BY s, f.p""")
def sensitive_reach(spark, sf, every: bool = False):
    starts = t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start"))
    bad = t(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return R.sensitive_reach(traced(spark, sf, every), starts, bad)


@query(whole("sensitive_reach", FLOW_CUT))
def sensitive_reach_all(spark, sf):
    return sensitive_reach(spark, sf, every=True)


@query(f"""WITH p AS (SELECT a, b FROM ({TOP2_SQL})), e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), h1 AS (SELECT DISTINCT x AS start, y AS id FROM e WHERE x <> y),
h2 AS (SELECT h1.start, e.y AS id, min(CAST(h1.id AS VARCHAR)) AS via FROM h1 JOIN e ON h1.id = e.x WHERE e.y <> h1.start AND NOT EXISTS (SELECT 1 FROM h1 z WHERE z.start = h1.start AND z.id = e.y) GROUP BY h1.start, e.y)
SELECT start, id, 1 AS hop, CAST(start AS VARCHAR) AS via FROM h1 UNION ALL SELECT start, id, 2, via FROM h2""")
def hop_neighbours(spark, sf):
    e = top_partners(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return G.hops(e, t(spark, sf, "nation").select(F.col("n_nationkey").alias("start")), 2)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size AS a, (p_size * 7 + CAST(p_partkey % 3 AS INT)) % 50 AS b FROM part WHERE p_size < (p_size * 7 + CAST(p_partkey % 3 AS INT)) % 50),
own AS (SELECT DISTINCT p_size AS node, p_type AS effect FROM part WHERE p_size >= 48), r AS (SELECT node, effect FROM own UNION SELECT e.a, r.effect FROM e JOIN r ON e.b = r.node)
SELECT node, effect FROM r""")
def side_effects_closure(spark, sf):
    p = t(spark, sf, "part").withColumn("to", (F.col("p_size") * 7 + (F.col("p_partkey") % 3).cast("int")) % 50)
    own = p.where("p_size >= 48").select(F.col("p_size").alias("node"), F.col("p_type").alias("effect"))
    return G.effects_closure(p.where("p_size < to").select(F.col("p_size").alias("u"), F.col("to").alias("v")), own)


@query(whole("side_effects_closure", " WHERE p_size < (p_size * 7 + CAST(p_partkey % 3 AS INT)) % 50", " WHERE p_size >= 48"))
def side_effects_closure_all(spark, sf):
    """Own effects of all parts over all edges, cycles included."""
    p = t(spark, sf, "part").select(F.col("p_size").alias("u"), ((F.col("p_size") * 7 + (F.col("p_partkey") % 3).cast("int")) % 50).alias("v"), F.col("p_type").alias("effect"))
    return G.effects_closure(p, p.select(F.col("u").alias("node"), "effect"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size AS a, (p_size * 7 + CAST(p_partkey % 3 AS INT)) % 50 AS b FROM part),
r AS (SELECT a, b, 1 AS depth FROM e WHERE a = 1 UNION SELECT r.a, e.b, r.depth + 1 FROM r JOIN e ON r.b = e.a WHERE r.depth < 30)
SELECT a AS src, b AS dst, CAST(min(depth) AS INT) AS depth FROM r GROUP BY a, b""")
def reference_closure(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_size").alias("src"), ((F.col("p_size") * 7 + (F.col("p_partkey") % 3).cast("int")) % 50).alias("dst"))
    return G.closure(p, p.where("src = 1").select("src"))


#: No path without a repeated vertex is longer than the 51 vertices, so the recursion isn't cut short.
@query(whole("reference_closure", " WHERE a = 1", " WHERE r.depth < 30").replace("ON r.b = e.a", "ON r.b = e.a WHERE r.depth < 60"))
def reference_closure_all(spark, sf):
    return G.closure(t(spark, sf, "part").select(F.col("p_size").alias("src"), ((F.col("p_size") * 7 + (F.col("p_partkey") % 3).cast("int")) % 50).alias("dst")))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM ({TOP2_SQL})), n AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey FROM nation),
p AS (SELECT id AS start, id, [id] AS path, 0 AS n FROM n UNION ALL SELECT start, e.b, list_append(path, e.b), p.n + 1 FROM p JOIN e ON e.a = p.id WHERE p.n < 8 AND NOT list_contains(path, e.b)),
r AS (SELECT start, id, path, row_number() OVER (PARTITION BY start, id ORDER BY p.n, path) AS k FROM p)
SELECT start, r.id AS target, array_to_string(path, ' > ') AS path FROM r JOIN n ON n.id = r.id WHERE n_regionkey = 0 AND k = 1""")
def shortest_paths(spark, sf):
    e = top_partners(spark, sf).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"))
    starts = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("start"))
    targets = t(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("string").alias("id"))
    return G.shortest_paths(e, starts, targets).withColumn("path", F.array_join("path", " > "))


@query(f"""WITH RECURSIVE e AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, b % 2 = 1 AS deferred FROM ({TOP2_SQL})),
p0 AS (SELECT '0' AS id, 0 AS d UNION SELECT e.b, d + 1 FROM p0 JOIN e ON e.a = p0.id WHERE NOT deferred AND d < 4), t0 AS (SELECT id, min(d) AS d FROM p0 GROUP BY id),
p1 AS (SELECT e.b AS id, d + 1 AS d FROM t0 JOIN e ON e.a = t0.id WHERE deferred AND d < 4 AND e.b NOT IN (SELECT id FROM t0) UNION SELECT e.b, d + 1 FROM p1 JOIN e ON e.a = p1.id WHERE d < 4 AND e.b NOT IN (SELECT id FROM t0))
SELECT id, tier, depth FROM (SELECT id, 0 AS tier, d AS depth FROM t0 UNION ALL SELECT id, 1, min(d) FROM p1 GROUP BY id) ORDER BY tier, depth, id LIMIT 15""")
def best_first_crawl(spark, sf):
    e = top_partners(spark, sf).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), (F.col("b") % 2 == 1).alias("deferred"))
    return spark.createDataFrame(G.crawl(e, "0", depth=4, limit=15), "id string, tier int, depth int")


# --- documentation, quality, gates ------------------------------------------------------------------

SCORE_SQL = """CASE WHEN lang IN ('en', 'de') THEN 2 ELSE 0 END + CASE WHEN n_chars // 300 >= 15 THEN 3 WHEN n_chars // 300 >= 8 THEN 2 WHEN n_chars // 300 >= 4 THEN 1 ELSE 0 END
 + CASE WHEN doc_id % 7 >= 4 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 >= 3 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 > 0 AND NOT (doc_id % 3 = 0) THEN 1 ELSE 0 END"""


@query(f"""SELECT doc_id, CAST({SCORE_SQL} AS INT) AS score, CASE WHEN {SCORE_SQL} >= 6 THEN 'high' WHEN {SCORE_SQL} >= 4 THEN 'medium' WHEN {SCORE_SQL} >= 1 THEN 'low' ELSE 'none' END AS level FROM documents""")
def doc_need_score(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.when(F.col("lang").isin("en", "de"), "public").alias("visibility"), F.floor(F.col("n_chars") / 300).alias("complexity"), (F.col("doc_id") % 7).alias("params"), (F.col("doc_id") % 5).alias("fan_in"), (F.col("doc_id") % 2).alias("effects"), (F.col("doc_id") % 3 == 0).alias("is_type"))
    return R.need_score(d).select("doc_id", "score", "level")


@query(r"""WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark)
SELECT item_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)^\W*(todo|fixme|tbd|xxx|hack)\b|\b(todo|fixme)\b:') THEN 'placeholder' END, CASE WHEN len(ws) < 3 THEN 'too-short' END) AS flags FROM w""")
def doc_quality_flags(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", F.array_join(S.doc_flags(F.col("text"), F.lit("zzz")), ",").alias("flags"))


STATUS_SQL = "CASE WHEN quality = 1 THEN 'documented' WHEN quality = 0 THEN 'partial' ELSE 'undocumented' END"


def items(spark, sf) -> DataFrame:
    j = t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels"), "doc_id", "left")
    return j.select("source", F.when(F.col("quality") == 1, "documented").when(F.col("quality") == 0, "partial").otherwise("undocumented").alias("status"), F.col("quality").isNotNull().alias("written"), F.coalesce("toxic", F.lit(0)).alias("flags"))


@query(f"""SELECT source, count(*) AS items, round(100 * avg(CASE s WHEN 'documented' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END), 6) AS coverage,
round(coalesce(100 * avg(CASE WHEN quality IS NOT NULL THEN CASE WHEN coalesce(toxic, 0) = 0 THEN 1.0 ELSE 0 END END), 100), 6) AS quality,
count(*) FILTER (s = 'documented') AS documented, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'undocumented') AS undocumented
FROM (SELECT source, quality, toxic, {STATUS_SQL} AS s FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source""")
def coverage_by_source(spark, sf):
    return A.coverage_by(items(spark, sf), "source").withColumns({"coverage": F.round("coverage", 6), "quality": F.round("quality", 6)})


@query(f"""SELECT round(100 * avg(CASE s WHEN 'documented' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END), 6) AS coverage, 100 * avg(CASE s WHEN 'documented' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END) >= 80 AS passed
FROM (SELECT {STATUS_SQL} AS s FROM documents LEFT JOIN labels USING (doc_id))""")
def gate_summary(spark, sf):
    return items(spark, sf).agg(F.round(A.coverage(F.col("status")), 6).alias("coverage")).withColumn("passed", F.col("coverage") >= 80)


@query("""SELECT source, layer AS first_lang FROM (SELECT source, arg_min(lang, doc_id) AS layer FROM documents WHERE lang <> 'en' GROUP BY source)""")
def folder_layer(spark, sf):
    d = t(spark, sf, "documents").select(F.concat("source", F.lit("/x")).alias("file"), F.when(F.col("lang") != "en", F.col("lang")).alias("layer"), F.col("doc_id").alias("ord"))
    return A.folder_layers(d).select(F.col("folder").alias("source"), F.col("layer").alias("first_lang"))


# --- differences and identity -----------------------------------------------------------------------


@query("""WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 6 <> 0)
SELECT coalesce(b.doc_id, a.doc_id) AS id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE b.h IS DISTINCT FROM a.h""")
def snapshot_diff(spark, sf):
    d = t(spark, sf, "documents")
    before = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    after = d.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return J.row_diff(before, after, "id", "hash")


@query("""SELECT coalesce(b.k, a.k) AS id, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderstatus <> 'F') b FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS v FROM orders WHERE o_orderstatus <> 'O') a ON a.k = b.k
WHERE b.k IS NULL OR a.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def evidence_diff(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("v"))
    return J.row_diff(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'O'").withColumn("v", F.when(F.col("o_custkey") % 10 != 0, F.col("v"))), "id", "v")


@query("""WITH e AS (SELECT event_id, user_id || ':' || event_type AS id, substr(sha256(CAST(event_id AS VARCHAR)), 1, 12) AS h FROM events WHERE user_id < 20),
g AS (SELECT id, count(*) AS n, substr(sha256(string_agg(h, '|' ORDER BY h)), 1, 12) AS m FROM e GROUP BY id)
SELECT event_id, e.id, CASE WHEN n > 1 THEN m ELSE h END AS hash FROM e JOIN g ON e.id = g.id""")
def merge_hashes(spark, sf):
    return merged(t(spark, sf, "events").where("user_id < 20"))


@query(whole("merge_hashes", " WHERE user_id < 20"))
def merge_hashes_all(spark, sf):
    return merged(t(spark, sf, "events"))


def merged(events: DataFrame) -> DataFrame:
    e = events.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("id"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 12).alias("hash"))
    return M.merge_hashes(e)


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 3 = 0), event_id) AS k FROM events) WHERE k = 1""")
def first_wins(spark, sf):
    e = t(spark, sf, "events").withColumn("is_test", F.col("event_id") % 3 == 0)
    return M.first_by(e, ["user_id", "event_type"], "is_test", "event_id").select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL""")
def last_wins(spark, sf):
    return M.last_by(t(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


# --- links and matches ------------------------------------------------------------------------------

PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def paths(spark, sf) -> DataFrame:
    p = t(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))


@query(f"""WITH k AS (SELECT page_id, 'GET ' || trim(lower({PATH_SQL}), '/') AS key FROM pages), f AS (SELECT key, min(page_id) AS hit FROM k WHERE page_id % 2 = 0 GROUP BY key)
SELECT CAST(page_id AS VARCHAR) AS from_id, coalesce(CAST(hit AS VARCHAR), 'none') AS to_id FROM k LEFT JOIN f USING (key) WHERE page_id % 2 = 1""")
def link_http(spark, sf):
    k = paths(spark, sf).select("page_id", S.route_key(F.lit("get"), F.col("path")).alias("key"))
    e = k.where("page_id % 2 = 1").select(F.col("page_id").cast("string").alias("from_id"), F.lit("none").alias("to_id"), "key")
    return M.link_by_key(e, k.where("page_id % 2 = 0").select("key", F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("ord")))


@query(f"""WITH p AS (SELECT page_id, {HOST_SQL} || {PATH_SQL} AS path FROM pages), x AS (SELECT {HOST_SQL} AS prefix FROM pages WHERE page_id % 3 = 0 UNION SELECT {HOST_SQL} || '/en' FROM pages WHERE page_id % 4 = 0)
SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM p LEFT JOIN x ON starts_with(p.path, x.prefix || '/') GROUP BY page_id""")
def longest_prefix_owner(spark, sf):
    p = paths(spark, sf)
    files = p.select("page_id", F.concat("host", "path").alias("file"))
    x = p.where("page_id % 3 = 0").select(F.col("host").alias("prefix")).union(p.where("page_id % 4 = 0").select(F.concat("host", F.lit("/en")))).distinct()
    return M.owning_project(files, x.select("prefix", F.col("prefix").alias("project"), F.lit(0).alias("ord"))).select("page_id", "prefix")


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '') AS s FROM pages),
h AS (SELECT page_id, 't1' AS t, 1 AS score FROM p WHERE len(s) = 2 AND lower(s[1]) = 'en' UNION ALL SELECT page_id, 't2', 1 FROM p WHERE len(s) = 2 AND s[2] = '231' UNION ALL SELECT page_id, 't3', 0 FROM p WHERE len(s) = 2),
b AS (SELECT page_id, max(score) AS score FROM h GROUP BY 1), w AS (SELECT page_id, count(*) AS k, min(t) AS t FROM h JOIN b USING (page_id, score) GROUP BY 1)
SELECT p.page_id AS call, CASE WHEN k = 1 THEN t END AS template, CASE WHEN k IS NULL THEN 'unmatched' WHEN k > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM p LEFT JOIN w USING (page_id)""")
def route_match(spark, sf):
    calls = paths(spark, sf).select(F.col("page_id").alias("call"), F.lit("GET").alias("verb"), "path")
    templates = spark.createDataFrame([("t1", "GET", "/en/{id}"), ("t2", "get", "/{lang}/231"), ("t3", "GET", "/[lang]/:id")], "template string, verb string, route string")
    return J.match_routes(calls, templates)


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '') AS s FROM pages) SELECT page_id FROM p WHERE NOT (len(s) = 2 AND lower(s[1]) IN ('en', 'de'))""")
def route_gaps(spark, sf):
    calls = paths(spark, sf).select(F.col("page_id").alias("call"), F.lit("GET").alias("verb"), "path")
    templates = spark.createDataFrame([("e", "GET", "/en/{id}"), ("d", "GET", "/de/{id}")], "template string, verb string, route string")
    return J.match_routes(calls, templates).where("status = 'unmatched'").select(F.col("call").alias("page_id"))


@query("""WITH s AS (SELECT user_id, min(extract('day' FROM ts)) AS a, max(extract('day' FROM ts)) AS b, event_type FROM events WHERE user_id < 40 GROUP BY user_id, event_type),
h AS (SELECT DISTINCT user_id, extract('day' FROM ts) AS d FROM events WHERE user_id < 40 AND event_type = 'error')
SELECT h.user_id, CAST(h.d AS INT) AS day, s.event_type FROM h JOIN s ON h.user_id = s.user_id AND s.a <= h.d + 1 AND s.b >= h.d""")
def interval_touch(spark, sf):
    return touched(t(spark, sf, "events").where("user_id < 40"))


@query(whole("interval_touch", "user_id < 40 AND ", " WHERE user_id < 40"))
def interval_touch_all(spark, sf):
    return touched(t(spark, sf, "events"))


def touched(events: DataFrame) -> DataFrame:
    e = events.select("user_id", F.dayofmonth("ts").alias("day"), "event_type")
    spans = e.groupBy("user_id", "event_type").agg(F.min("day").alias("line"), F.max("day").alias("end_line"))
    hunks = e.where("event_type = 'error'").select("user_id", F.col("day").alias("first"), (F.col("day") + 1).alias("last")).distinct()
    return J.overlapping(hunks, spans, ["user_id"]).select("user_id", F.col("first").alias("day"), "event_type")


@query("""WITH s AS (SELECT user_id, event_type, min(extract('day' FROM ts)) AS a, max(extract('day' FROM ts)) AS b FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND x.a <= y.a AND x.b >= y.b AND (x.a < y.a OR x.b > y.b))""")
def innermost_touch(spark, sf):
    e = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.dayofmonth("ts")).alias("line"), F.max(F.dayofmonth("ts")).alias("end_line"))
    return J.innermost(e, ["user_id"]).select("user_id", "event_type")


@query("""WITH n AS (SELECT p_name, count(*) AS k, min(p_partkey) AS id FROM part GROUP BY p_name) SELECT s_suppkey, CASE WHEN k = 1 THEN id END AS hit FROM supplier LEFT JOIN (SELECT p_name, k, id FROM n) ON p_name = (SELECT p_name FROM part WHERE p_partkey = s_suppkey)""")
def unique_name_join(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_name")
    s = t(spark, sf, "supplier").select("s_suppkey").join(part.withColumnRenamed("p_partkey", "s_suppkey"), "s_suppkey", "left")
    return J.unique_join(s, part.withColumnRenamed("p_partkey", "hit"), "p_name", "hit").select("s_suppkey", "hit")


@query("""WITH r AS (SELECT c_custkey, c_name, CASE WHEN lower(c_name) = 'customer#000000012' THEN 0 WHEN starts_with(lower(c_name), 'customer#000000012') THEN 1 WHEN contains(lower(c_name), 'customer#000000012') THEN 2 END AS rank FROM customer)
SELECT c_custkey, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, length(c_name), c_name LIMIT 10""")
def fuzzy_find(spark, sf):
    return J.find_names(t(spark, sf, "customer"), "customer#000000012", 10, "c_name").select("c_custkey", "rank")


@query("""SELECT DISTINCT p_partkey AS id, w.word AS name FROM part, (SELECT unnest(['red', 'ring', 'small']) AS word) w WHERE list_contains(regexp_extract_all(p_name, '\\w+'), w.word)""")
def word_hits(spark, sf):
    names = spark.createDataFrame([("red",), ("ring",), ("small",)], "name string")
    return J.word_hits(F.broadcast(names), t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))


@query("""WITH m AS (SELECT l_orderkey, min(l_suppkey) AS a, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS from_id, CASE WHEN n = 1 THEN 's' || a ELSE 'o' || o_orderkey END AS to_id, CASE WHEN n = 1 THEN 'calls' ELSE 'accesses' END AS kind
FROM orders JOIN m ON l_orderkey = o_orderkey""")
def resolve_calls(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("type"), F.concat(F.lit("s"), "l_suppkey").alias("id")).distinct().withColumns({"method": F.lit("m"), "arity": F.lit(1)})
    calls = t(spark, sf, "orders").select(F.col("o_orderkey").alias("from_id"), F.concat(F.lit("o"), "o_orderkey").alias("type"), F.lit("m").alias("method"), F.lit(1).alias("arity"))
    return M.resolve_calls(calls.join(lines.select("type").distinct(), "type", "left_semi"), lines)


# --- load, history, evidence ------------------------------------------------------------------------


@query("""SELECT event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1""")
def load_newest_run(spark, sf):
    return J.newest(t(spark, sf, "events"), ["event_type"], "ts", "event_id").select("event_type", "ts", "value")


@query("""WITH d AS (SELECT event_type, CAST(extract('day' FROM ts) AS INT) AS day, max(value) AS p95 FROM events GROUP BY ALL)
SELECT event_type, day, p95, lag(p95) OVER w AS previous, round(CASE WHEN lag(p95) OVER w <> 0 THEN 100 * (p95 - lag(p95) OVER w) / lag(p95) OVER w END, 4) AS change FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def load_trend(spark, sf):
    d = t(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.max("value").alias("p95"))
    return W.trend(d, ["event_type"], "day", "p95").withColumn("change", F.round("change", 4))


@query("""WITH h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hr, count(*) AS n, max(value) AS p95 FROM events GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY hr) - 1) // CAST(ceil(count(*) OVER (PARTITION BY event_type) / 60.0) AS BIGINT) AS chunk FROM h)
SELECT event_type, chunk, max(hr) AS "end", round(sum(n) / greatest(max(hr) - min(hr) + 1, 1), 6) AS rate, max(p95) AS p95 FROM r GROUP BY event_type, chunk""")
def load_buckets(spark, sf):
    h = t(spark, sf, "events").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("at")).agg(F.count("*").alias("n"), F.max("value").alias("p95"))
    return W.buckets(h, ["event_type"], "at", "n", "p95").withColumn("rate", F.round("rate", 6))


@query("""WITH e AS (SELECT o_custkey AS symbol, c_mktsegment AS requirement, bool_or(o_orderstatus = 'F') AS confirmed, max(o_orderkey) AS newest, count(*) AS evidence, arg_max(o_orderpriority, o_orderkey) AS was FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT symbol, requirement, confirmed, newest, evidence, was IS DISTINCT FROM CASE WHEN symbol % 2 = 0 THEN '1-URGENT' END AS changed_since FROM e""")
def requirement_status(spark, sf):
    o = t(spark, sf, "orders").join(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    ev = o.select(F.col("o_custkey").alias("symbol"), F.col("c_mktsegment").alias("requirement"), F.when(F.col("o_orderstatus") == "F", "commit").otherwise("file").alias("strength"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("hash"))
    now = t(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").alias("hash"))
    return A.requirement_status(ev, now)


def evidence_links(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("requirement"), F.col("o_orderkey").alias("architecture"))
    return o, t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("architecture"), F.col("l_linenumber").alias("test"))


@query("""WITH a AS (SELECT o_custkey AS r, o_orderkey AS k, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS ok FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT r, count(*) AS n, count(*) FILTER (ok) AS m FROM a GROUP BY r)
SELECT c_custkey AS requirement, coalesce(n, 0) AS architectures, coalesce(m, 0) AS tested, CASE WHEN n IS NULL THEN 'no-architecture' WHEN m = 0 THEN 'no-test' WHEN m < n THEN 'partial' ELSE 'linked' END AS status FROM customer LEFT JOIN g ON r = c_custkey""")
def traceability_rows(spark, sf):
    a, b = evidence_links(spark, sf)
    return A.traceability(t(spark, sf, "customer").select(F.col("c_custkey").alias("requirement")), a, b)


@query("""SELECT 'unlinked-architecture' AS gap, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'untested-architecture', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def traceability_gaps(spark, sf):
    a, b = evidence_links(spark, sf)
    return A.traceability_gaps(t(spark, sf, "orders").select(F.col("o_orderkey").alias("architecture")), b.select("test").distinct(), a, b)


@query("""WITH d AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS test FROM lineitem WHERE l_quantity = 50),
u AS (SELECT id, test, 0 AS r, 'direct' AS via FROM d UNION ALL SELECT p_partkey, test, 1, 'interface' FROM part JOIN d ON d.id = p_partkey // 2 UNION ALL SELECT p_partkey // 2, test, 2, 'implementation' FROM part JOIN d ON d.id = p_partkey)
SELECT id, test, arg_min(via, r) AS via FROM u GROUP BY id, test""")
def test_links(spark, sf):
    return tested(spark, sf, t(spark, sf, "lineitem").where("l_quantity = 50"))


@query(whole("test_links", " WHERE l_quantity = 50"))
def test_links_all(spark, sf):
    return tested(spark, sf, t(spark, sf, "lineitem"))


def tested(spark, sf, lines: DataFrame) -> DataFrame:
    d = lines.select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("id")).distinct()
    i = t(spark, sf, "part").select(F.col("p_partkey").alias("from_id"), F.floor(F.col("p_partkey") / 2).alias("to_id"))
    return G.test_links(d, i, i.limit(0).select(F.col("from_id").alias("parent"), F.col("to_id").alias("child")))


# --- packages, entities, texts ----------------------------------------------------------------------


def package_uses(spark, sf) -> DataFrame:
    return t(spark, sf, "part").select(F.col("p_brand").alias("package"), F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 3, F.lit("0")).alias("version"), F.col("p_type").alias("project"))


VERSION_SQL = "p_size || '.' || (p_partkey % 3) || '.0'"


@query(f"""SELECT p_brand AS package, {VERSION_SQL} AS version, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS projects FROM part GROUP BY 1, 2""")
def sbom_inventory(spark, sf):
    return A.inventory(package_uses(spark, sf))


@query(f"""SELECT p_brand AS package, count(DISTINCT {VERSION_SQL}) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT {VERSION_SQL}) > 1""")
def version_conflicts(spark, sf):
    return A.version_conflicts(package_uses(spark, sf))


@query(f"""SELECT p_brand AS package, count(DISTINCT {VERSION_SQL}) AS versions, arg_max({VERSION_SQL}, p_size * 10 + p_partkey % 3) AS target FROM part GROUP BY 1 HAVING count(DISTINCT {VERSION_SQL}) > 1""")
def version_drift(spark, sf):
    return A.version_drift(package_uses(spark, sf))


@query(f"""SELECT p_type AS project, kind FROM (SELECT p_type, max(CASE WHEN p_size < 20 THEN 3 WHEN p_size > 20 THEN 4 WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 2 THEN 4 ELSE 0 END) AS r FROM part GROUP BY 1) JOIN (VALUES (3, 'major'), (2, 'minor'), (4, 'downgrade'), (0, 'same')) v(r, kind) USING (r)""")
def worst_change(spark, sf):
    plan = R.change_plan(package_uses(spark, sf), F.lit("20.1.0"))
    return A.worst_change(plan, ["project"], ["same", "patch", "minor", "major", "downgrade", "unknown"])


@query("""WITH e AS (SELECT n_nationkey AS id FROM nation), l AS (SELECT DISTINCT c_nationkey AS a, c_nationkey * 3 % 25 AS b, c_nationkey % 4 = 0 AS i FROM customer),
d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM l WHERE NOT i UNION ALL SELECT b FROM l WHERE NOT i AND a <> b) GROUP BY id),
o AS (SELECT a AS id, count(*) AS n FROM l WHERE NOT i GROUP BY a), f AS (SELECT b AS id, count(*) AS n FROM l WHERE NOT i GROUP BY b), h AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM l WHERE i UNION ALL SELECT b FROM l WHERE i AND a <> b) GROUP BY id),
m AS (SELECT e.id, coalesce(d.n, 0) AS degree, coalesce(f.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(h.n, 0) AS inheritance FROM e LEFT JOIN d USING (id) LEFT JOIN o USING (id) LEFT JOIN f USING (id) LEFT JOIN h USING (id)),
s AS (SELECT *, CAST(degree * 1.0 + fan_in * 0.5 + fan_out * 0.5 + inheritance * 2.0 AS DOUBLE) AS score FROM m)
SELECT *, degree + inheritance = 0 AS isolated, score = (SELECT max(score) FROM s) AND score > 0 AS central FROM s""")
def edmx_metrics(spark, sf):
    links = t(spark, sf, "customer").select(F.col("c_nationkey").alias("a"), (F.col("c_nationkey") * 3 % 25).alias("b"), (F.col("c_nationkey") % 4 == 0).alias("inheritance")).distinct()
    m = A.entity_metrics(t(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), links, {"degree": "1", "fan_in": "0.5", "fan_out": "0.5", "inheritance": "2"})
    return m.withColumn("score", F.col("score").cast("double"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '[0-9]+')) > 0 AS has_digit FROM conversations""")
def texts_with_digits(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", (F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))) > 0).alias("has_digit"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 OR CAST(json_extract_string(props, '$.k') AS INT) % 100 = 0 AS meets, 1 AS stated FROM events WHERE event_id % 10 = 0""")
def numbers_crosscheck(spark, sf):
    return crosschecked(t(spark, sf, "events").where("event_id % 10 = 0"))


@query(whole("numbers_crosscheck", " WHERE event_id % 10 = 0"))
def numbers_crosscheck_all(spark, sf):
    return crosschecked(t(spark, sf, "events"))


def crosschecked(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    said = e.select(F.col("event_id").alias("key"), F.concat(F.lit("limit of "), F.col("k").cast("string"), F.lit(" items")).alias("text"))
    code = e.select(F.col("event_id").alias("key"), F.concat(F.lit("if (n > "), F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(F.col("k") + 1).cast("string"), F.lit(")")).alias("body"))
    return R.number_checks(said, code).select(F.col("key").alias("event_id"), "meets", "stated")


@query("""SELECT s_nationkey, s_suppkey, CAST(rank AS INT) AS rank, greatest(n - 3, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE rank <= 3""")
def topk_plus_more(spark, sf):
    return W.top_with_rest(t(spark, sf, "supplier"), ["s_nationkey"], 3, F.desc("s_acctbal"), "s_suppkey").select("s_nationkey", "s_suppkey", "rank", "more")


@query("""SELECT user_id, string_agg(DISTINCT v, ',' ORDER BY v) AS values FROM (SELECT user_id, unnest([event_type, CAST(extract('month' FROM ts) AS VARCHAR)]) AS v FROM events) GROUP BY user_id""")
def config_union(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.array("event_type", F.month("ts").cast("string")).alias("values"))
    return A.union_of_sets(e, "user_id", "values")


@query("""SELECT lang || ':' || source AS key, CASE WHEN lang IN ('en') THEN 'used' ELSE 'unread' END AS status FROM documents GROUP BY lang, source
UNION ALL SELECT 'x:' || n_nationkey || ':y', CASE WHEN n_nationkey % 2 = 0 THEN 'bound' ELSE 'unread' END FROM nation UNION ALL SELECT 'x:' || n_nationkey, 'undefined' FROM nation WHERE n_nationkey % 2 = 0""")
def config_status(spark, sf):
    d = t(spark, sf, "documents").select(F.concat("lang", F.lit(":"), "source").alias("key"), F.lit(True).alias("defined"), (F.col("lang") == "en").alias("read")).distinct()
    n = t(spark, sf, "nation").withColumn("x", F.concat(F.lit("x:"), "n_nationkey"))
    sub = n.select(F.concat("x", F.lit(":y")).alias("key"), F.lit(True).alias("defined"), F.lit(False).alias("read"))
    top = n.where("n_nationkey % 2 = 0").select(F.col("x").alias("key"), F.lit(False).alias("defined"), F.lit(True).alias("read"))
    return A.config_status(d.union(sub).union(top))


@query("""SELECT 'nation' AS kind, n_name AS name, CAST(n_nationkey AS VARCHAR) AS ref FROM nation UNION ALL SELECT 'region', r_name, CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'part', p_name, CAST(p_partkey AS VARCHAR) FROM part""")
def search_index(spark, sf):
    pick = lambda name, p: t(spark, sf, name).select(F.col(f"{p}_name").alias("name"), F.col(f"{p}_{name}key" if name != "part" else "p_partkey").alias("ref"))
    return A.search_index({"nation": pick("nation", "n"), "region": pick("region", "r"), "part": pick("part", "p")})


@query("""SELECT to_key AS id, count(DISTINCT a) AS fan_in FROM (SELECT o_custkey AS a, l_suppkey AS to_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 40
UNION SELECT o_custkey, l_suppkey + 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey + 1 WHERE l_quantity >= 40 AND l_suppkey % 2 = 0) GROUP BY 1""")
def fan_in(spark, sf):
    return fanned_in(spark, sf, t(spark, sf, "lineitem").where("l_quantity >= 40"))


@query(whole("fan_in", "l_quantity >= 40 AND ", " WHERE l_quantity >= 40"))
def fan_in_all(spark, sf):
    return fanned_in(spark, sf, t(spark, sf, "lineitem"))


def fanned_in(spark, sf, lines: DataFrame) -> DataFrame:
    e = lines.join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    i = t(spark, sf, "supplier").where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("from_id"), (F.col("s_suppkey") - 1).alias("to_id"))
    return A.fan_in(e, i)


@query("""SELECT p_partkey, CASE WHEN length(p_name) > 4 AND p_name LIKE '%ies' THEN left(p_name, length(p_name) - 3) || 'y' WHEN length(p_name) > 3 AND p_name LIKE '%s' AND p_name NOT LIKE '%ss' THEN left(p_name, length(p_name) - 1) ELSE p_name END AS stem,
trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def name_functions(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.stem(F.col("p_name")).alias("stem"), S.slug(F.col("p_name")).alias("slug"))


@query("""SELECT doc_id, CASE WHEN x = '' THEN 'none' WHEN length(x) > 40 THEN rtrim(left(x, 40), ' ') || '…' ELSE x END AS title FROM (SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], ' +', ' ', 'g'), ' ') AS x FROM documents)""")
def clean_titles(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.clean_text(F.split("text", "\n")[0], 40, F.lit("none")).alias("title"))


@query("""WITH u AS (SELECT DISTINCT p_brand AS package, p_type AS project FROM part), c AS (SELECT * FROM (VALUES ('ECONOMY', 'PROMO'), ('SMALL', 'ECONOMY'), ('SMALL', 'PROMO')) v(src, dst))
SELECT package, project, bool_or(d) AS direct FROM (SELECT package, project, true AS d FROM u UNION ALL SELECT package, src, false FROM u JOIN c ON dst = project) GROUP BY ALL""")
def package_impact(spark, sf):
    closed = G.closure(spark.createDataFrame([("ECONOMY", "PROMO"), ("SMALL", "ECONOMY")], "src string, dst string"))
    return R.package_impact(package_uses(spark, sf), closed)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 4 = 0 THEN 'missing' WHEN o_custkey % 4 = 1 THEN 'unverified' WHEN o_orderstatus = 'F' THEN 'current' ELSE 'stale' END AS status FROM orders""")
def source_freshness(spark, sf):
    o = t(spark, sf, "orders")
    ev = o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.when(F.col("o_custkey") % 4 != 1, F.when(F.col("o_orderstatus") == "F", "h").otherwise("x")).alias("source_hash"))
    files = t(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.lit("h").alias("hash"))
    return R.source_freshness(ev, files).select("id", "status")


@query("""WITH e AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, 400 - length(role) - coalesce(sum(length(role) + length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM conversations)
SELECT conv_id, turn AS ord, role AS title, CASE WHEN length(text) <= room THEN text WHEN room > 0 THEN substr(text, 1, CAST(room AS INT) - 1) || '…' ELSE '' END AS body FROM e WHERE k <= 3 AND room >= 0""")
def budget_fit(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("title"), F.col("text").alias("body"))
    return W.fit_budget(c, "conv_id", most=3, budget=400)


@query("""WITH e AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM e WHERE used <= 500""")
def context_budget(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    return W.within_budget(c, ["conv_id"], ["turn"], F.length("text"), 500).select("conv_id", "turn", "used")

from . import rule_queries  # noqa: E402, F401  registers further queries
from . import deep_queries  # noqa: E402, F401

# queries that a filter keeps to a part of their tables give way to those over every row
for _name in [n for n in QUERIES if f"{n}_all" in QUERIES]:
    del QUERIES[_name]
    ORACLE_SQL.pop(_name, None)
