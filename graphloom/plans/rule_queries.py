"""Queries of assembling, rules, tests, releases and texts over whole tables, with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import assembly as M
from ..operators import graph as G
from ..operators import projects as P
from ..operators import rules as R
from ..operators import windows as W
from .queries import PATH_SQL, package_uses, paths, query, t

# --- security and design rules ----------------------------------------------------------------------

VERB_SQL = "CASE WHEN o_orderpriority LIKE '1%' THEN 'POST' WHEN o_orderpriority LIKE '2%' THEN 'DELETE' ELSE 'GET' END"
AUTH_SQL = "CASE o_orderstatus WHEN 'F' THEN 'authorize' WHEN 'O' THEN 'none' ELSE 'anonymous' END"


@query(f"""SELECT * FROM (SELECT CASE WHEN {VERB_SQL} <> 'GET' AND {AUTH_SQL} <> 'authorize' THEN 'SEC-002' WHEN {VERB_SQL} = 'GET' AND {AUTH_SQL} = 'none' THEN 'SEC-001' END AS rule, o_orderkey AS id FROM orders) WHERE rule IS NOT NULL""")
def endpoint_auth(spark, sf):
    return R.endpoint_auth(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(VERB_SQL).alias("verb"), F.expr(AUTH_SQL).alias("auth")))


@query("""SELECT DISTINCT 'SEC-003' AS rule, l_orderkey AS id, l_suppkey AS to_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
WHERE o_orderpriority LIKE '1%' AND s_acctbal < 3000""")
def direct_store_access(spark, sf):
    edges = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    layers = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority").startswith("1"), "api").alias("layer"))
    return R.direct_store_access(edges, layers, t(spark, sf, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").alias("id")))


NAMESPACE_SQL = "CASE p_size % 4 WHEN 0 THEN 'Microsoft.AspNetCore.Mvc' WHEN 1 THEN 'Microsoft.AspNetCoreX' WHEN 2 THEN 'javax.servlet' ELSE p_brand END"


@query(f"""SELECT DISTINCT 'SEC-004' AS rule, p_partkey AS id, {NAMESPACE_SQL} AS namespace FROM part WHERE p_partkey % 3 = 0 AND p_size % 4 IN (0, 2)""")
def framework_coupling(spark, sf):
    p = t(spark, sf, "part")
    return R.framework_coupling(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "domain").otherwise("api").alias("layer"), F.expr(NAMESPACE_SQL).alias("namespace")))


@query("""WITH m AS (SELECT l_suppkey AS module, count(DISTINCT l_partkey) AS fan_out, max(l_linenumber) * 3 AS complexity, count(*) FILTER (l_returnflag = 'R') AS docs FROM lineitem GROUP BY 1)
SELECT module, 'depends on many' AS observation FROM m WHERE fan_out >= 10 UNION ALL SELECT module, 'complex' FROM m WHERE complexity >= 15 UNION ALL SELECT module, 'undocumented' FROM m WHERE docs = 0""")
def module_observations(spark, sf):
    m = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("module")).agg(F.countDistinct("l_partkey").alias("fan_out"), (F.max("l_linenumber") * 3).alias("complexity"), F.count_if(F.col("l_returnflag") == "R").alias("docs"))
    return R.module_observations(m)


@query("""SELECT 'entity-exposed' AS risk, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'api-logic', o_orderkey FROM orders WHERE o_custkey % 10 >= 8
UNION ALL SELECT 'domain-namespace', o_orderkey FROM orders WHERE o_custkey % 7 = 0""")
def design_risks(spark, sf):
    o = t(spark, sf, "orders")
    returns = F.when(F.col("o_orderstatus") == "F", "Task<List<Order>>").otherwise("Task<OrderDto>")
    endpoints = o.select(F.col("o_orderkey").alias("id"), returns.alias("returns"), (F.col("o_custkey") % 10).alias("complexity"))
    names = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 == 0, "Shop.Domain.Sql").otherwise("Shop.Domain.Sqlite").alias("namespace"))
    return P.design_risks(endpoints, spark.createDataFrame([("Order",)], "name string"), names)


# --- changes ----------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, part FROM (SELECT *, unnest([CASE WHEN p_size % 2 = 0 THEN 'parameters' END, CASE WHEN p_size % 3 = 0 THEN 'returns' END, CASE WHEN p_size % 7 = 0 THEN 'throws' END, CASE WHEN p_size % 5 = 0 THEN 'route' END]) AS part FROM part) WHERE part IS NOT NULL""")
def contract_changes(spark, sf):
    p = t(spark, sf, "part")
    every = lambda k: F.col("p_size") % k == 0
    before = p.select(F.col("p_partkey").alias("id"), F.array("p_name", "p_type").alias("parameters"), F.lit(None).cast("string").alias("returns"), F.array("p_brand", F.lit("E")).alias("throws"), "p_type", F.col("p_name").alias("route")).drop("p_type")
    after = p.select(
        F.col("p_partkey").alias("id"), F.when(every(2), F.array("p_type", "p_name")).otherwise(F.array("p_name", "p_type")).alias("parameters"), F.when(every(3), "x").alias("returns"),
        F.when(every(7), F.array("p_brand")).otherwise(F.array(F.lit("E"), "p_brand")).alias("throws"), F.when(every(5), F.concat("p_name", F.lit("/"))).otherwise(F.col("p_name")).alias("route"),
    )
    return R.contract_changes(before, after)


@query("""SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0 AND text IS NOT NULL""")
def stale_docs(spark, sf):
    d = t(spark, sf, "documents")
    before = d.select(F.col("doc_id").alias("id"), F.lit("h").alias("hash"), F.col("text").alias("doc"))
    spaced = F.concat(F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" \n  ")))
    after = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "g").otherwise("h").alias("hash"), F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" more"))).otherwise(spaced).alias("doc"))
    return R.stale_docs(before, after)


@query("""WITH k AS (SELECT o_orderdate, c_mktsegment || '>' || o_orderpriority AS key, o_custkey % 50 AS m FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT 'layer' AS kind, key || m AS key FROM k WHERE key || m NOT IN (SELECT key || m FROM k WHERE o_orderdate < DATE '1994-01-01')""")
def decision_candidates(spark, sf):
    k = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = k.select("o_orderdate", F.concat("c_mktsegment", F.lit(">"), "o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("key"))
    return R.decision_candidates(k.where("o_orderdate < DATE '1994-01-01'"), k, "layer")


@query("""SELECT p_brand AS package, p_type AS project, v AS version, '20.1.0' AS target, CASE WHEN p_size < 20 THEN 'major' WHEN p_size > 20 THEN 'downgrade' WHEN p_partkey % 3 = 0 THEN 'minor' WHEN p_partkey % 3 = 2 THEN 'downgrade' ELSE 'same' END AS kind,
CASE WHEN v = '20.1.0' THEN 'keep' ELSE 'update' END AS action FROM (SELECT *, p_size || '.' || (p_partkey % 3) || '.0' AS v FROM part)""")
def change_plan(spark, sf):
    return R.change_plan(package_uses(spark, sf), F.lit("20.1.0"))


@query("""SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS critical, count(*) FILTER (lang = 'en') AS violations, count(*) FILTER (n_chars > 5000) AS complex, count(*) FILTER (quality = 0) AS contradictions,
count(*) FILTER (quality IS NULL AND doc_id % 3 = 0 AND n_chars > 2000) AS untested, false AS ok FROM documents LEFT JOIN labels USING (doc_id)""")
def diff_gate(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    null = F.lit(None)

    def row(kind, on, complexity=null, critical=null, fact=null, added=null, tests=null, level=null):
        typed = zip(("complexity", "critical", "fact", "added", "tests", "level"), (complexity, critical, fact, added, tests, level), ("long", "boolean", "boolean", "boolean", "long", "string"), strict=True)
        return F.when(on, F.struct(F.lit(kind).alias("kind"), F.col("doc_id").alias("id"), *[v.cast(k).alias(n) for n, v, k in typed]))

    level = F.when(F.col("n_chars") > 5000, "high").when(F.col("n_chars") > 2000, "medium").when(F.col("n_chars") > 500, "low").otherwise("none")
    rows = [row("gap", F.col("quality") == 0, critical=F.col("toxic") == 1), row("violation", F.col("lang") == "en"), row("symbol", F.lit(True), complexity=F.col("n_chars")), row("flag", F.col("quality") == 0, fact=F.lit(True)), row("test", F.col("quality").isNull(), added=F.lit(True), tests=F.col("doc_id") % 3, level=level)]
    return A.diff_gate(d.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*"), 5000, "medium")


# --- assembling -------------------------------------------------------------------------------------


@query(f"""SELECT page_id AS file, {PATH_SQL} ILIKE '%/1%' OR page_id % 5 = 0 AS is_test FROM pages""")
def test_files(spark, sf):
    p = paths(spark, sf).select(F.concat(F.lit("p"), F.col("page_id") % 5, "path").alias("file"), "page_id")
    projects = spark.createDataFrame([(f"P{k}", f"p{k}", k, ["test"] if k == 0 else None) for k in range(5)], "project string, prefix string, ord int, tags array<string>")
    # files are matched by what follows their project's folder
    got = M.test_files(p.select("file").distinct(), ["*/1*"], projects)
    return p.join(got, "file").select(F.col("page_id").alias("file"), "is_test")


@query("""SELECT DISTINCT p_type AS project, 'ext:' || lower(p_brand) AS to_id, 'inferred' AS certainty FROM part WHERE p_brand LIKE 'Brand#1%' AND p_brand <> 'Brand#13'""")
def inferred_externals(spark, sf):
    p = t(spark, sf, "part")
    depends = p.select(F.col("p_type").alias("project"), F.col("p_brand").alias("package"))
    known = p.where("p_brand LIKE 'Brand#1%'").select(F.col("p_brand").alias("package"), F.lower("p_brand").alias("system")).distinct()
    return M.inferred_externals(depends, known, spark.createDataFrame([("ext:brand#13",)], "id string"))


@query("""SELECT 'n' || c_nationkey AS from_id, c_custkey AS to_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey < 20""")
def orphan_externals(spark, sf):
    ext = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("src/n"), "c_nationkey", F.lit("/c.cs")).alias("file"))
    return M.orphan_externals(ext, t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("to_id")), nation_projects(spark, sf))


def nation_projects(spark, sf):
    return t(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey").alias("project"), F.concat(F.lit("src/n"), "n_nationkey").alias("prefix"), F.col("n_nationkey").alias("ord"))


@query("""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey ELSE 'n' || c_nationkey END AS from_id, 'cfg:' || c_mktsegment AS to_id, 'reads' AS kind FROM customer WHERE c_custkey % 2 = 0 OR c_nationkey < 20""")
def link_config(spark, sf):
    c = t(spark, sf, "customer")
    start = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("T"), "c_custkey")).otherwise(F.concat(F.lit("file:src/n"), "c_nationkey", F.lit("/p.cs")))
    return M.link_config(c.select(start.alias("from_id"), F.concat(F.lit("cfg:"), "c_mktsegment").alias("to_id"), F.lit("reads").alias("kind")), nation_projects(spark, sf))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey < 20 THEN 'n' || c_nationkey WHEN c_custkey % 2 = 0 THEN 'root' END AS project FROM customer""")
def owners_by_language(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("src/n"), "c_nationkey", F.lit("/"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, ".cs").otherwise(".ts")).alias("file"))
    projects = nation_projects(spark, sf).withColumn("ecosystem", F.lit("nuget")).unionByName(spark.createDataFrame([("root", "", 99, "nuget")], "project string, prefix string, ord int, ecosystem string"))
    got = M.owners_by_language(c.select("file"), projects, {"nuget": ["cs", "vb"], "npm": ["ts", "js"]})
    return c.join(got, "file").select(F.col("c_custkey").alias("id"), "project")


@query("""SELECT s_suppkey AS id, array_to_string(list_sort(list_filter(['supplier', CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') THEN 'entity' END, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50) THEN 'hosted' END], lambda x: x IS NOT NULL)), ',') AS tags FROM supplier""")
def tag_targets(spark, sf):
    nodes = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.lit("supplier")).alias("tags"))
    kind = F.when(F.col("l_returnflag") == "R", F.array(F.lit("persists"))).otherwise(F.array())
    kinds = F.concat(kind.cast("array<string>"), F.when(F.col("l_quantity") == 50, F.array(F.lit("hosts"))).otherwise(F.array()).cast("array<string>"), F.array(F.lit("calls")))
    edges = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("to_id"), F.explode(kinds).alias("kind"))
    return M.tag_targets(nodes, edges, {"persists": "entity", "hosts": "hosted"}).select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("""SELECT c_custkey AS id, 'customer' AS origin FROM customer UNION ALL SELECT DISTINCT o_custkey * 2, 'read' FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)""")
def defined_over_read(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    return M.defined_over_read(c, t(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id"), F.lit("read").alias("origin")).distinct())


@query("""WITH named AS (SELECT p_partkey AS id, p_brand || '.' || p_name || p_size AS f, p_name || p_size AS b FROM part), full_ AS (SELECT f, min(id) AS id FROM named GROUP BY f), bare AS (SELECT b, min(id) AS id FROM named GROUP BY b HAVING count(*) = 1),
e AS (SELECT l_orderkey AS from_id, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN p_brand || '.' || p_name || p_size ELSE p_name || p_size END AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT from_id, n, coalesce(full_.id, bare.id) AS to_id FROM e LEFT JOIN full_ ON e.name = f LEFT JOIN bare ON e.name = b WHERE coalesce(full_.id, bare.id) IS NOT NULL""")
def link_names(spark, sf):
    bare = F.concat("p_name", F.col("p_size").cast("string"))
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("."), bare).alias("full"), bare.alias("bare"))
    e = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_linenumber").alias("n"), "l_partkey").join(p, F.col("l_partkey") == F.col("id"))
    e = e.select("from_id", "n", F.when(F.col("n") % 2 == 0, F.col("full")).otherwise(F.col("bare")).alias("name"))
    return M.link_names(e, p).select("from_id", "n", "to_id")


HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query(f"""SELECT DISTINCT page_id AS from_id, 'ext:http:' || {HOST} AS to_id, 'connects' AS kind, 'detected' AS label FROM pages WHERE page_id % 3 <> 0""")
def external_hosts(spark, sf):
    p = t(spark, sf, "pages")
    return M.external_hosts(p.select(F.col("page_id").alias("from_id"), F.concat(F.lit("http:GET "), "url").alias("to_id"), F.when(F.col("page_id") % 3 == 0, "calls").otherwise("http").alias("kind")))


@query("""WITH own AS (SELECT s_nationkey AS nation, count(*) AS n, min(s_suppkey) AS s FROM supplier WHERE s_acctbal < 2000 GROUP BY 1), a AS (SELECT count(*) AS n FROM supplier WHERE s_acctbal < 2000)
SELECT c_custkey AS id, CASE WHEN own.n = 1 THEN 's' || s ELSE 'ext:database' END AS target, CASE WHEN own.n = 1 THEN 'inferred' ELSE 'unknown' END AS certainty FROM customer LEFT JOIN own ON c_nationkey = nation""")
def only_candidate(spark, sf):
    asking = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return M.only_candidate(asking, t(spark, sf, "supplier").where("s_acctbal < 2000").select(F.col("s_nationkey").alias("nation"), F.concat(F.lit("s"), "s_suppkey").alias("target")), ["nation"])


@query("""WITH e AS (SELECT l_suppkey AS f, l_partkey AS p, CASE WHEN l_returnflag = 'R' THEN 'calls' ELSE 'reads' END AS kind FROM lineitem)
SELECT DISTINCT 's' || f AS from_id, 'p' || p AS to_id, CASE WHEN f % 2 = 0 THEN 'tests' ELSE kind END AS kind FROM e WHERE p % 3 <> 0 AND (f % 2 = 1 OR kind = 'calls')""")
def collapse_tests(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "calls").otherwise("reads")
    edges = t(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), kind.alias("kind"), F.lit(None).cast("string").alias("label"))
    tests = t(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(t(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey")))
    return M.collapse_tests(tests, edges, tests)[1].select("from_id", "to_id", "kind")


@query("""SELECT coalesce(l, '(none)') AS language, count(*) AS files FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'csharp' WHEN 1 THEN 'typescript' WHEN 2 THEN 'dockerfile' WHEN 3 THEN 'yaml' END AS l FROM part) GROUP BY 1""")
def language(spark, sf):
    ending = F.get(F.array(*map(F.lit, (".CS", ".tsx", "/Dockerfile", ".yml", ".bin"))), F.col("p_size") % 5)
    p = t(spark, sf, "part").select(M.language(F.concat(F.lit("src/f"), "p_partkey", ending)).alias("l"))
    return p.groupBy(F.coalesce("l", F.lit("(none)")).alias("language")).agg(F.count("*").alias("files"))


@query("""WITH n AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), p AS (SELECT p_partkey AS id FROM part WHERE p_size < 25), need AS (SELECT DISTINCT b AS id FROM n WHERE b NOT IN (SELECT id FROM p) AND b % 5 <> 0)
SELECT 'project' AS what, id, false AS stub FROM p UNION ALL SELECT 'project', id, true FROM need UNION ALL SELECT 'edge', b, false FROM n WHERE b IN (SELECT id FROM p UNION ALL SELECT id FROM need)""")
def complete_references(spark, sf):
    part = t(spark, sf, "part")
    edges = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.lit("references").alias("kind")).distinct()
    known = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"))
    every, kept = M.complete_references(part.where("p_size < 25").select(F.col("p_partkey").alias("id")), edges, known)
    return every.select(F.lit("project").alias("what"), "id", "stub").union(kept.select(F.lit("edge"), "to_id", F.lit(False)))


@query("""SELECT source, substr(sha256(string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id || ':' || n_chars)), 1, 16) AS print FROM documents GROUP BY source""")
def fingerprint(spark, sf):
    d = t(spark, sf, "documents")
    return d.groupBy("source").agg(M.fingerprint(F.collect_list(F.concat_ws(":", "doc_id", "n_chars"))).alias("print"))


@query("""SELECT o_orderkey AS sha, CASE WHEN o_orderstatus = 'F' THEN 'update' ELSE 'previous' END AS origin FROM orders""")
def merge_history(spark, sf):
    o = t(spark, sf, "orders")
    return M.merge_history(o.select(F.col("o_orderkey").alias("sha"), F.lit("previous").alias("origin")), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sha"), F.lit("update").alias("origin")), "sha")


@query("""WITH t AS (SELECT p_brand AS bare, min(p_partkey) AS hit FROM part WHERE p_size < 5 GROUP BY 1), i AS (SELECT l_orderkey AS from_id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'Own.' WHEN 1 THEN 'Ownership.' ELSE 'System.' END || p_brand AS name, p_brand AS bare FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT from_id, coalesce(CAST(hit AS VARCHAR), 'ns:' || name) AS to_id, CASE WHEN hit IS NULL THEN 'uses-namespace' ELSE 'imports' END AS kind FROM i LEFT JOIN t USING (bare) WHERE hit IS NOT NULL OR n % 3 = 1""")
def classify_imports(spark, sf):
    p = t(spark, sf, "part")
    start = F.get(F.array(*map(F.lit, ("Own.", "Ownership.", "System."))), F.col("l_linenumber") % 3)
    i = t(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("from_id"), F.concat(start, "p_brand").alias("name"), F.col("p_brand").alias("bare"))
    types = p.where("p_size < 5").select(F.col("p_brand").alias("bare"), F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ord"))
    return M.classify_imports(i, types, ["Own"], ["System"])


@query("""SELECT l_orderkey AS from_id, l_linenumber AS n, CASE WHEN l_suppkey % 5 = 1 THEN 'outside-root' WHEN l_suppkey % 5 = 2 THEN 'not-parsed' WHEN l_suppkey % 5 = 3 THEN 'not-scanned' ELSE 'not-found' END AS reason FROM lineitem WHERE l_suppkey % 5 <> 0""")
def missing_reason(spark, sf):
    path = lambda c: F.concat(F.when(F.col(c) % 5 == 1, "../").otherwise("src/"), F.col(c).cast("string")).alias("path")
    s = t(spark, sf, "supplier").select(path("s_suppkey"), F.col("s_suppkey").alias("k"))
    refs = t(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("from_id"), path("l_suppkey"))
    out = M.missing_reason(refs, s.where("k % 5 = 0"), s.where("k % 5 = 2"), s.where("k % 5 = 3"))
    return out.select("from_id.l_orderkey", F.col("from_id.l_linenumber").alias("n"), "reason").withColumnRenamed("l_orderkey", "from_id")


@query("""SELECT i.p_partkey AS interface, m.p_size AS type, min(m.p_partkey) AS id FROM part i JOIN part m ON m.p_size = i.p_size + 1 AND m.p_name = i.p_name AND m.p_brand = i.p_brand GROUP BY 1, 2""")
def implementing_methods(spark, sf):
    m = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("type"), F.col("p_name").alias("method"), F.col("p_brand").alias("arity"), F.col("p_partkey").alias("ord"))
    return M.implementing_methods(m, m.select((F.col("type") + 1).alias("from_id"), F.col("type").alias("to_id")).distinct()).drop("ord")


# --- counts, statuses, orders -----------------------------------------------------------------------


@query("""SELECT coalesce(CASE WHEN lang <> 'en' THEN lang END, '(none)') AS layer, count(DISTINCT source) AS files FROM documents GROUP BY 1""")
def layer_files(spark, sf):
    return A.layer_files(t(spark, sf, "documents").select(F.when(F.col("lang") != "en", F.col("lang")).alias("layer"), F.col("source").alias("file")))


@query("""SELECT id, count(*) AS degree FROM (SELECT 's' || l_suppkey AS id FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) GROUP BY id""")
def degrees(spark, sf):
    return A.degrees(t(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id")))


@query("""SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS used_by FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1""")
def used_by(spark, sf):
    return A.used_by(t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id")))


@query("""WITH c AS (SELECT c_custkey AS id, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT id, CASE WHEN p = 1 THEN 'one' WHEN p > 1 THEN 'several' WHEN f > 0 THEN 'inferred' WHEN id % 2 = 0 THEN 'none' ELSE 'unknown' END AS outcome FROM c""")
def outcome(spark, sf):
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0)).alias("f"))
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left").na.fill(0)
    return c.select("id", A.outcome(F.col("p"), F.col("f"), F.col("id") % 2 == 0).alias("outcome"))


@query("""SELECT p_partkey AS id, CASE WHEN count(*) OVER (PARTITION BY p_name || p_size) > 1 THEN p_name || p_size || ' (' || p_brand || ')' ELSE p_name || p_size END AS label FROM part""")
def disambiguated(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.col("p_size").cast("string")).alias("name"), "p_brand")
    return A.disambiguated(p, "name", "p_brand").select("id", "label")


@query("""SELECT 'English' AS role, count(*) FILTER (lang = 'en') AS n FROM documents UNION ALL SELECT 'First source', count(*) FILTER (source = 'src1') FROM documents""")
def role_counts(spark, sf):
    return A.role_counts(t(spark, sf, "documents").select(F.col("lang").alias("kind"), F.array("source").alias("tags")), {"English": "en", "First source": "src1"})


@query("""SELECT doc_id, n_chars AS complexity FROM documents WHERE n_chars > 1 AND lang <> 'fr' ORDER BY n_chars DESC, doc_id LIMIT 20""")
def most_complex(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("complexity"), F.when(F.col("lang") == "fr", "component").otherwise("method").alias("kind"), F.col("doc_id").alias("ord"))
    return A.most_complex(d).select("doc_id", "complexity")


@query("""SELECT 'DOC-' || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS number, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0)""")
def numbered_findings(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels").where("quality = 0"), "doc_id").select("doc_id", "n_chars")
    return W.numbered(d, "DOC", F.desc("n_chars"), "doc_id").select("number", "doc_id")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def page_of_orders(spark, sf):
    return W.page(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, 50, F.desc("o_totalprice"), "o_orderkey")


@query("""SELECT o_custkey AS symbol, o_orderkey AS requirement, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderpriority LIKE '1%', o_orderdate DESC, o_orderkey) AS rank FROM orders""")
def ranked_requirements(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("requirement"), (F.col("o_orderstatus") == "P").alias("confirmed"), F.col("o_orderpriority").startswith("1").alias("changed_since"), F.col("o_orderdate").alias("newest"))
    return W.ranked_requirements(o, "symbol").select("symbol", "requirement", "rank")


@query("""SELECT user_id AS from_id, event_id AS to_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events""")
def pipeline_order(spark, sf):
    return W.pipeline_order(t(spark, sf, "events").select(F.col("user_id").alias("from_id"), F.col("event_id").alias("to_id"), F.col("ts").alias("ord")))


@query("""WITH c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place, role FROM conversations)
SELECT conv_id, u.place, length(u.text) AS asked, length(a.text) AS said FROM c u JOIN c a USING (conv_id, place) WHERE u.role = 'user' AND a.role = 'assistant'""")
def zipped_turns(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", "turn", F.col("n").alias(name))
    return W.zipped(side("user", "asked"), side("assistant", "said"), "conv_id", "turn")


RELEASE_SQL = "CASE WHEN {b} THEN 'breaking' WHEN {c} IN ('feature', 'fix', 'performance') THEN {c} ELSE 'other' END"


@query(f"""WITH k AS (SELECT o_orderkey, o_orderpriority AS release, o_custkey % 11 = 0 AS breaking, ['feature', 'fix', 'performance', 'chore', 'security', NULL][o_custkey % 6 + 1] AS category, o_orderkey % 9 = 0 AS merge FROM orders)
SELECT o_orderpriority AS release, {RELEASE_SQL.format(b="l_quantity = 50", c="CASE l_returnflag WHEN 'R' THEN 'fix' WHEN 'A' THEN 'feature' ELSE 'docs' END")} AS section, 'pull' AS source, '#' || l_orderkey || '.' || l_linenumber AS ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.05
UNION ALL SELECT release, {RELEASE_SQL.format(b="breaking", c="category")}, 'change', 'c' || o_orderkey FROM k WHERE NOT merge AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)""")
def released(spark, sf):
    category = F.get(F.array(*map(F.lit, ("feature", "fix", "performance", "chore", "security", None))), F.col("o_custkey") % 6)
    o, lines = t(spark, sf, "orders"), t(spark, sf, "lineitem").where("l_discount > 0.05")
    kind = F.when(F.col("o_orderkey") % 9 == 0, "merge").otherwise("commit")
    owned = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("pull"))
    changes = o.join(owned, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderpriority").alias("release"), F.concat(F.lit("c"), "o_orderkey").alias("sha"), category.alias("category"), (F.col("o_custkey") % 11 == 0).alias("breaking"), kind.alias("kind"), "pull")
    docs = F.when(F.col("l_returnflag") == "R", "fix").when(F.col("l_returnflag") == "A", "feature").otherwise("docs")
    pulls = lines.join(o.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("release"), F.concat(F.lit("#"), "l_orderkey", F.lit("."), "l_linenumber").alias("id"), docs.alias("category"), (F.col("l_quantity") == 50).alias("breaking"))
    return A.released(changes, pulls)


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS plan, l_partkey AS k FROM lineitem)
SELECT plan, count(*) AS cases, count(*) FILTER (k IN (SELECT p_partkey FROM part WHERE p_size < 10)) AS linked FROM c GROUP BY plan""")
def test_plans(spark, sf):
    return A.test_plans(t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("plan"), F.col("l_partkey").alias("case")), t(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("case")))


@query("""SELECT c_custkey AS item, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'linked' ELSE 'not-linked' END AS code_status,
CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'linked' WHEN c_acctbal > 0 THEN 'not-linked' ELSE 'not-assessed' END AS test_status FROM customer""")
def overlay_status(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    item = lambda df, k: df.select(F.col(k).alias("item"))
    return A.overlay_status(item(c, "c_custkey"), item(o, "o_custkey"), item(o.where("o_orderstatus = 'P'"), "o_custkey"), item(c.where("c_acctbal > 0"), "c_custkey"))


@query("""SELECT DISTINCT l_suppkey AS file, l_orderkey AS requirement FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""")
def file_evidence(spark, sf):
    e = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("requirement"))
    return A.file_evidence(e, t(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("symbol")))


@query("""WITH f AS (SELECT p_brand, arg_min(p_type, p_partkey) AS label, arg_min(p_size, p_partkey) AS version, min(p_partkey) AS o FROM part GROUP BY 1) SELECT label, arg_min(version, o) AS version FROM f GROUP BY label""")
def technologies(spark, sf):
    return A.technologies(t(spark, sf, "part").select(F.col("p_brand").alias("package"), F.col("p_type").alias("label"), F.col("p_size").alias("version"), F.col("p_partkey").alias("ord")))


@query("""SELECT 'layer ' || coalesce(CASE WHEN p_size > 3 THEN p_type END, '(none)') AS what, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT CASE WHEN l_quantity < 25 THEN 'allowed' ELSE 'not allowed' END, count(*) FROM lineitem GROUP BY 1""")
def description_totals(spark, sf):
    c = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 3, F.col("p_type")).alias("layer"))
    return A.description_totals(c, t(spark, sf, "lineitem").select((F.col("l_quantity") < 25).alias("allowed")))


@query("""WITH m AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS type, 'n' || c_nationkey AS folder FROM customer UNION ALL SELECT 's' || s_suppkey, 'S' || n_regionkey, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'i' || s_suppkey // 2, 'I', 'api' FROM supplier),
e AS (SELECT DISTINCT 'c' || o_custkey AS f, 's' || l_suppkey AS g FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderpriority LIKE '1%' UNION SELECT 'c' || (c_custkey * 2), 'c' || c_custkey FROM customer WHERE c_nationkey < 3 AND c_custkey > 0),
c AS (SELECT a.id, a.folder, a.type, b.id AS to_id, b.type AS to_type, b.folder AS to_folder FROM e JOIN m a ON a.id = f JOIN m b ON b.id = g),
inner_ AS (SELECT DISTINCT to_folder AS folder FROM c WHERE to_folder <> folder),
moved AS (SELECT id, min(to_type) AS tt, arg_min(to_folder, to_id) AS tf FROM c WHERE folder NOT IN (SELECT folder FROM inner_) GROUP BY id HAVING count(DISTINCT to_type) = 1 AND min(to_type) <> min(type)),
a AS (SELECT m.id, coalesce(tf, folder) AS area, CASE WHEN tt IS NULL THEN 'folder' ELSE 'delegates to ' || tt END AS reason FROM m LEFT JOIN moved USING (id)),
i AS (SELECT 'i' || s_suppkey // 2 AS k, 's' || s_suppkey AS f FROM supplier UNION SELECT 'i' || c_custkey % 5, 'c' || c_custkey FROM customer WHERE c_acctbal > 9900),
g AS (SELECT k, min(area) AS area, string_agg(f, ', ' ORDER BY f) AS by_ FROM i JOIN a ON a.id = f WHERE k IN (SELECT id FROM m) GROUP BY k HAVING count(DISTINCT area) = 1)
SELECT a.id, coalesce(g.area, a.area) AS area, CASE WHEN by_ IS NULL THEN reason ELSE 'implemented by ' || by_ END AS reason FROM a LEFT JOIN g ON a.id = g.k""")
def domain_areas(spark, sf):
    """Customers call their urgent orders' first suppliers (several or none); pairs of suppliers implement an interface."""
    c, s, o, n = (t(spark, sf, k) for k in ("customer", "supplier", "orders", "nation"))
    name = lambda p, x: F.concat(F.lit(p), x.cast("long").cast("string"))
    region = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    half = F.floor(F.col("s_suppkey") / 2)
    method = lambda df, i, kind, folder: df.select(i.alias("id"), kind.alias("type"), F.concat(folder, F.lit("/f.cs")).alias("file"))
    methods = method(c, name("c", F.col("c_custkey")), F.col("c_mktsegment"), name("n", F.col("c_nationkey"))).union(method(region, name("s", F.col("s_suppkey")), name("S", F.col("n_regionkey")), name("r", F.col("n_regionkey")))).union(method(s, name("i", half), F.lit("I"), F.lit("api")).distinct())
    first = t(spark, sf, "lineitem").where("l_linenumber = 1").join(o.where("o_orderpriority LIKE '1%'"), F.col("l_orderkey") == F.col("o_orderkey"))
    edge = lambda df, f, g: df.select(f.alias("from_id"), g.alias("to_id"))
    calls = edge(first, name("c", F.col("o_custkey")), name("s", F.col("l_suppkey"))).union(edge(c.where("c_nationkey < 3 AND c_custkey > 0"), name("c", F.col("c_custkey") * 2), name("c", F.col("c_custkey"))))
    implements = edge(s, name("s", F.col("s_suppkey")), name("i", half)).union(edge(c.where("c_acctbal > 9900"), name("c", F.col("c_custkey")), name("i", F.col("c_custkey") % 5)))
    return A.domain_areas(methods, calls, implements)


# --- requirements, history, evidence ----------------------------------------------------------------


@query("""SELECT c_mktsegment || c_custkey AS repo, w AS warning FROM (SELECT *, unnest([CASE WHEN c_custkey % 3 = 0 THEN 'later commits' END, CASE WHEN c_custkey % 4 = 0 THEN 'truncated' END, CASE WHEN c_custkey % 5 = 0 THEN 'shallow' END]) AS w FROM customer) WHERE w IS NOT NULL""")
def coverage_warnings(spark, sf):
    head = F.when(F.col("c_custkey") % 3 == 0, "beef").when(F.col("c_custkey") % 3 == 1, "cafe").otherwise("cafe0123456789")
    h = t(spark, sf, "customer").select(F.concat("c_mktsegment", F.col("c_custkey").cast("string")).alias("repo"), F.lit("cafe0123").alias("end"), head.alias("head"), (F.col("c_custkey") % 4 == 0).alias("truncated"), (F.col("c_custkey") % 5 == 0).alias("shallow"))
    return R.coverage_warnings(h)


@query("""WITH e AS (SELECT l_suppkey AS symbol, l_partkey AS requirement, l_returnflag = 'R' AS confirmed, l_orderkey AS ord FROM lineitem WHERE l_suppkey % 4 <> 0), asked AS (SELECT s_suppkey AS a FROM supplier),
s AS (SELECT a, a AS symbol FROM asked WHERE a IN (SELECT symbol FROM e) UNION ALL SELECT a, a - 1 FROM asked WHERE a NOT IN (SELECT symbol FROM e) AND a > 0),
r AS (SELECT a AS asked, symbol, requirement, row_number() OVER (PARTITION BY a ORDER BY bool_or(confirmed) DESC, max(ord) DESC, requirement) AS rank, count(*) OVER (PARTITION BY a) AS n FROM s JOIN e USING (symbol) GROUP BY a, symbol, requirement)
SELECT asked, symbol, requirement, rank, greatest(n - 5, 0) AS more FROM r WHERE rank <= 5""")
def requirement_answers(spark, sf):
    e = t(spark, sf, "lineitem").where("l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("symbol"), F.col("l_partkey").alias("requirement"), (F.col("l_returnflag") == "R").alias("confirmed"), F.col("l_orderkey").alias("ord"))
    asked = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("asked"))
    return R.requirement_answers(asked, e, asked.select(F.col("asked").alias("id"), (F.col("asked") - 1).alias("was")), most=5)


@query("""SELECT l_partkey AS requirement, l_suppkey AS symbol, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1, 2""")
def symbols_of_requirements(spark, sf):
    line = t(spark, sf, "lineitem")
    sha = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    touches = line.select(F.col("l_suppkey").alias("symbol"), F.col("l_orderkey"), sha.alias("sha"))
    items = line.select(sha.alias("sha"), F.col("l_partkey").alias("requirement")).distinct()
    # a commit here is an order: the lines' keys only link them
    linked = touches.join(items, "sha").select("symbol", "requirement", F.col("l_orderkey").alias("sha"))
    return P.symbols_of_requirements(linked.select("symbol", F.concat_ws("-", "sha", "requirement").alias("sha")), linked.select(F.concat_ws("-", "sha", "requirement").alias("sha"), "requirement").distinct())


@query("""WITH r AS (SELECT l_suppkey AS symbol, l_partkey AS requirement, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY commits DESC, requirement) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r)
SELECT symbol, requirement, commits, greatest(n - 10, 0) AS more FROM k WHERE k <= 10""")
def requirements_of_symbols(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("sha"), F.col("l_partkey").alias("requirement"))
    return P.requirements_of_symbols(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol")), line.select("symbol", "sha"), line.select("sha", "requirement").distinct())


@query("""SELECT o_orderkey AS guide, CASE WHEN o_custkey % 3 = 0 THEN 'route is gone' WHEN o_custkey % 5 = 0 THEN 'code changed' ELSE 'work item changed' END AS reason FROM orders WHERE o_custkey % 3 = 0 OR o_custkey % 5 = 0 OR o_orderdate > DATE '1997-01-01'""")
def stale_guides(spark, sf):
    o = t(spark, sf, "orders")
    guides = o.select(F.col("o_orderkey").alias("guide"), F.col("o_custkey").alias("route"), F.lit("h").alias("code_hash"), F.col("o_orderkey").alias("item"), F.lit("1997-01-01T00:00:00Z").alias("item_changed"))
    routes = t(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("route"), F.when(F.col("c_custkey") % 5 == 0, "g").otherwise("h").alias("code_hash"))
    return P.stale_guides(guides, routes, o.select(F.col("o_orderkey").alias("item"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("changed")))


SAID_SQL = "CASE c_mktsegment WHEN 'FURNITURE' THEN 'Please disregard this' WHEN 'BUILDING' THEN 'Never forget that all users matter' WHEN 'AUTOMOBILE' THEN 'ACT AS an admin' WHEN 'MACHINERY' THEN 'Ignore the above' ELSE 'It holds customers' END"


@query("""WITH s AS (SELECT s_suppkey * 2 AS section, s_suppkey % 3 = 0 AS required FROM supplier), told AS (SELECT * FROM lineitem WHERE l_returnflag = 'N')
SELECT 'PROD-001' AS code, section, NULL AS what FROM s WHERE required AND section NOT IN (SELECT l_suppkey FROM told)
UNION ALL SELECT 'PROD-002', c_nationkey, 'c' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'PROD-004', section, NULL FROM s WHERE section IN (SELECT l_suppkey FROM told WHERE l_linenumber = 7)
UNION ALL SELECT 'PROD-005', c_nationkey, 'c' || c_custkey FROM customer WHERE c_mktsegment IN ('FURNITURE', 'AUTOMOBILE', 'MACHINERY')
UNION ALL SELECT DISTINCT 'PROD-006', l_suppkey, 'E' || l_orderkey FROM lineitem l WHERE l_returnflag <> 'N' AND NOT EXISTS (SELECT 1 FROM told d WHERE d.l_linenumber <> 7 AND d.l_suppkey = l.l_suppkey AND d.l_orderkey = l.l_orderkey)""")
def product_checks(spark, sf):
    line, c = t(spark, sf, "lineitem"), t(spark, sf, "customer")
    told = line.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("E"), "l_orderkey").alias("id"), F.concat(F.lit("part "), "l_partkey").alias("text"), F.lit("s").alias("source"), "l_linenumber")
    statements = c.select(F.col("c_nationkey").alias("section"), F.concat(F.lit("c"), "c_custkey").alias("source"), F.expr(SAID_SQL).alias("text"))
    sections = t(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("section"), (F.col("s_suppkey") % 3 == 0).alias("required"))
    cited = line.where("l_returnflag <> 'N'").select(F.col("l_suppkey").alias("section"), F.concat(F.lit("E"), "l_orderkey").alias("id"))
    return R.product_checks(sections, told.drop("l_linenumber"), statements, t(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source")).distinct(), told.where("l_linenumber <> 7").drop("l_linenumber"), cited)


@query("""SELECT 'PROD-003' AS code, p_brand AS product, p_type AS "on" FROM (SELECT DISTINCT p_brand, p_type FROM part) WHERE p_type NOT LIKE 'E%'""")
def missing_drafts(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_brand").alias("product"), F.col("p_type").alias("on")).distinct()
    return R.missing_drafts(p, p.where("`on` LIKE 'E%'").select(F.col("on").alias("product")).distinct()).select("code", "product", "on")


@query("""SELECT doc_id AS id, s AS section FROM (SELECT doc_id, unnest(['summary', CASE WHEN doc_id % 4 > 0 THEN 'param' END, CASE WHEN lang = 'en' THEN 'returns' END, CASE WHEN n_chars > 1000 THEN 'exception' END, CASE WHEN doc_id % 6 > 4 THEN 'authorization' END]) AS s FROM documents) WHERE s IS NOT NULL""")
def applying_sections(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("params"), F.when(F.col("lang") == "en", "x").alias("returns"), F.when(F.col("n_chars") > 1000, "E").alias("throws"), F.when(F.col("doc_id") % 6 > 4, 1).otherwise(0).alias("endpoints"), F.array().cast("array<string>").alias("state"), F.lit(None).cast("array<string>").alias("events"))
    return R.applying_sections(d, ["summary", "param", "returns", "exception", "authorization", "state", "events"])


@query("""SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' AND p_brand LIKE 'Brand#1%' THEN 'cheap' WHEN p_name LIKE '%widget' THEN 'widget' ELSE 'default' END AS pattern FROM part""")
def first_pattern(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.array(F.lit("x"), "p_brand").alias("tags"), F.col("p_name").alias("name"))
    return R.first_pattern(p, [("cheap", {"kind": "economy", "tags": "brand#1*"}), ("widget", {"name": "*widget"})], "default").select("id", "pattern")


@query("""SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1""")
def critical_gaps(spark, sf):
    d = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id").withColumns({"level": F.when(F.col("toxic") == 1, "high").otherwise("low"), "status": F.when(F.col("quality") == 0, "undocumented").otherwise("documented")})
    return R.critical_gaps(d).select("doc_id")


# --- graphs -----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN o_orderkey WHEN o_custkey % 2 = 0 THEN o_custkey ELSE o_orderkey END AS unit FROM orders""")
def units(spark, sf):
    o = t(spark, sf, "orders")
    nodes = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "method").otherwise("file").alias("kind"), (F.col("o_custkey") % 3 == 0).alias("endpoint"))
    return G.units(nodes, o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("root")))


@query("""WITH RECURSIVE e AS (SELECT c_custkey // 3 AS p, c_custkey AS c FROM customer WHERE c_custkey > 0), r AS (SELECT c_custkey AS target, c_custkey AS id FROM customer WHERE c_custkey % 10 = 1 UNION SELECT target, c FROM r JOIN e ON r.id = e.p) SELECT * FROM r""")
def target_scope(spark, sf):
    c = t(spark, sf, "customer")
    return G.target_scope(c.where("c_custkey > 0").select(F.floor(F.col("c_custkey") / 3).alias("parent"), F.col("c_custkey").alias("child")), c.where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("id")))


@query("""SELECT src, dst, label, CASE WHEN label LIKE '%inferred%' THEN 'inferred' ELSE 'detected' END AS certainty FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'inferred: r' ELSE l_returnflag END AS label FROM lineitem WHERE l_suppkey % 3 = 0 AND l_partkey % 3 = 0) ORDER BY src, dst, label LIMIT 120""")
def crawl_relations(spark, sf):
    e = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "inferred: r").otherwise(F.col("l_returnflag")).alias("label"))
    return G.crawl_relations(e, t(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id")), 10)


# --- texts ------------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, trim(regexp_extract(l, '^\\s*(?:[-*+]|\\d+[.)])\\s+(.*\\S)\\s*$', 1)) AS text FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '- ' || replace(text, chr(10), ' ') ELSE 'plain' END AS l FROM conversations) WHERE turn > 0 AND turn % 2 = 0 AND regexp_extract(l, '^\\s*(?:[-*+]|\\d+[.)])\\s+(.*\\S)\\s*$', 1) <> ''""")
def criteria_lines(spark, sf):
    c = t(spark, sf, "conversations")
    line = F.when(F.col("turn") == 0, "## Acceptance criteria").when(F.col("turn") % 2 == 0, F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise("plain")
    return W.criteria(c.select(F.col("conv_id").alias("item"), F.col("turn").alias("pos"), line.alias("line"))).select(F.col("item").alias("conv_id"), F.col("pos").alias("turn"), F.btrim("text").alias("text"))


@query("""SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 1 + doc_id % 4), chr(10)) AS body FROM documents""")
def body_slice(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.body_slice(F.col("text"), F.lit(2), (1 + F.col("doc_id") % 4).cast("int")).alias("body"))


@query("""SELECT p_partkey, p_name || ',' || p_brand AS names FROM part""")
def parameter_names(spark, sf):
    given = F.array(F.concat("p_name", F.lit(": "), "p_type"), F.concat(F.lit("[FromBody] "), "p_brand", F.lit(" : List<x>")))
    return t(spark, sf, "part").select("p_partkey", F.array_join(S.parameter_names(given), ",").alias("names"))


@query("""SELECT p_partkey, 'The ' || p_name || ' of Type as ' || p_brand AS text FROM part""")
def xml_texts(spark, sf):
    doc = F.concat(F.lit("<doc><summary>\n  The "), "p_name", F.lit(' of <see cref="T:A.B.Type"/>\n as <c>'), "p_brand", F.lit("</c></summary><returns>x</returns></doc>"))
    return t(spark, sf, "part").select("p_partkey", S.xml_text(doc, "summary").alias("text"))


@query("""SELECT p_partkey, 1 + p_size % 4 * 2 AS complexity FROM part""")
def complexity(spark, sf):
    code = F.concat(F.lit("var a; "), F.repeat(F.lit("if (a && b) { f(); } "), (F.col("p_size") % 4).cast("int")))
    return t(spark, sf, "part").select("p_partkey", S.complexity(code).cast("int").alias("complexity"))


@query("""SELECT source, round_even(100.0 * count(*) FILTER (lang = 'en') / count(*), 2) AS share, max(CASE lang WHEN 'en' THEN 'db' WHEN 'de' THEN 'http' ELSE lang END) AS effect FROM documents GROUP BY source""")
def percent_and_effect(spark, sf):
    kind = F.when(F.col("lang") == "en", "database").when(F.col("lang") == "de", "http-api").otherwise(F.col("lang"))
    return t(spark, sf, "documents").groupBy("source").agg(S.percent(F.count_if(F.col("lang") == "en"), F.count("*")).alias("share"), F.max(S.effect_kind(kind)).alias("effect"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate > DATE '1995-06-15'""")
def later_than(spark, sf):
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T02:00:00+02:00"))
    return t(spark, sf, "orders").where(S.later_than(day, F.lit("1995-06-15T00:00:00Z"))).select("o_orderkey")


@query("""SELECT p_partkey, 'pkg:nuget/' || replace(p_name, ' ', '%20') || CASE WHEN p_size % 2 = 0 THEN '@' || p_size || '.1.0' ELSE '' END AS purl FROM part""")
def package_urls(spark, sf):
    version = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".1.0"))).otherwise(F.lit("[1.0,)"))
    return t(spark, sf, "part").select("p_partkey", S.package_url(F.lit("nuget"), F.col("p_name"), version).alias("purl"))


@query("""SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' OR p_size % 3 = 0 OR p_type = 'ECONOMY'""")
def in_package(spark, sf):
    namespace = F.when(F.col("p_size") % 3 == 0, F.lit("Own.Sub")).when(F.col("p_type") == "ECONOMY", F.lit("Other.Web.Api")).when(F.col("p_brand") == "Brand#1", F.lit("Own")).otherwise(F.lit("Owner.X"))
    hit = S.in_package(namespace, F.lit("Own")) | S.in_package(namespace, F.lit("*.Web.*"))
    return t(spark, sf, "part").where(hit).select("p_partkey")


@query(f"""SELECT page_id FROM pages WHERE {PATH_SQL} = '/en' OR {PATH_SQL} LIKE '/en/%' OR page_id % 9 = 0""")
def might_belong(spark, sf):
    p = paths(spark, sf).withColumn("path", F.when(F.col("page_id") % 9 == 0, F.lit("x/app.csproj")).otherwise(F.col("path")))
    return p.where(P.might_belong(F.col("path"), ["/en"])).select("page_id")


@query("""WITH o AS (SELECT s_nationkey AS folder, s_suppkey % 2 = 0 AS i FROM supplier) SELECT folder FROM o GROUP BY folder HAVING bool_or(i) AND NOT bool_and(i)""")
def shared_folders(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("project"), F.col("s_nationkey").alias("folder"))
    return P.shared_folders(s, s.where("project % 2 = 0"))


@query("""SELECT CASE WHEN c_nationkey < 20 THEN 'n' || c_nationkey END AS project, count(DISTINCT c_nationkey || ':' || c_custkey % 50) AS files, count(DISTINCT c_nationkey) AS modules, count(*) AS symbols FROM customer GROUP BY 1""")
def hierarchy(spark, sf):
    nodes = t(spark, sf, "customer").select(F.concat(F.lit("src/n"), "c_nationkey", F.lit("/"), F.col("c_custkey") % 50).alias("file"))
    return P.hierarchy(nodes, nation_projects(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS s, s_suppkey // 2 AS d FROM supplier WHERE s_suppkey > 0), i AS (SELECT s_suppkey AS k FROM supplier WHERE s_name LIKE '%7'), r AS (SELECT d AS k FROM e WHERE s IN (SELECT k FROM i) UNION SELECT d FROM r JOIN e ON e.s = r.k)
SELECT 'P' || k AS project, 'included' AS role FROM i UNION ALL SELECT DISTINCT 'P' || k, 'stub' FROM r WHERE k NOT IN (SELECT k FROM i)""")
def scope(spark, sf):
    s = t(spark, sf, "supplier")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    projects = s.select(name(F.col("s_suppkey")).alias("project"))
    return P.scope(projects, s.where("s_suppkey > 0").select(name(F.col("s_suppkey")).alias("src"), name(F.floor(F.col("s_suppkey") / 2)).alias("dst")), ["P*7"])


@query("""WITH e AS (SELECT event_id // 2 AS id, user_id, event_type AS kind, 'f' || user_id % 3 AS file, CAST(floor(value) AS INT) % 2 AS line, event_id AS o FROM events),
x AS (SELECT *, min(o) OVER (PARTITION BY id) AS a, max(o) OVER (PARTITION BY id) AS z FROM e)
SELECT b.id, arg_max(e.id, e.o) AS was FROM x b JOIN x e ON b.user_id = e.user_id AND b.kind = e.kind AND b.file = e.file AND b.line = e.line AND e.o <= b.o AND e.id <> b.id WHERE b.o = b.a AND e.o = e.z AND e.id % 5 <> 1 GROUP BY 1""")
def renamed_from(spark, sf):
    e = t(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("id"), F.col("user_id").alias("owner"), F.lit("()").alias("args"), F.col("event_type").alias("kind"), F.concat(F.lit("f"), F.col("user_id") % 3).alias("file"), (F.floor("value").cast("int") % 2).alias("line"), F.col("event_id").alias("order"))
    return P.renamed_from(e, e.where("id % 5 = 1"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN p_name WHEN p_partkey > 0 AND (SELECT p.p_size FROM part p WHERE p.p_partkey = part.p_partkey // 2) % 2 = 1 THEN (SELECT p.p_name FROM part p WHERE p.p_partkey = part.p_partkey // 2) END AS doc FROM part""")
def inherited_docs(spark, sf):
    p = t(spark, sf, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 1, F.col("p_name")).alias("doc"))
    return R.inherited_docs(nodes, p.where("p_partkey > 0").select(F.col("p_partkey").alias("from_id"), F.floor(F.col("p_partkey") / 2).alias("to_id"), F.lit(1).alias("ord")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'documented' WHEN doc_id % 3 = 1 THEN 'partial' ELSE 'undocumented' END AS status FROM documents""")
def doc_status(spark, sf):
    written = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("summary"), F.lit("param"), F.lit("x"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("param"))).otherwise(F.array(F.lit("x")))
    return t(spark, sf, "documents").select("doc_id", R.doc_status(F.array(F.lit("summary"), F.lit("param")), written).alias("status"))
