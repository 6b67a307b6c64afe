"""General operators on small hand-made tables."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from graphloom import config, model
from graphloom.functions import scalars as S
from graphloom.operators import aggregates as A
from graphloom.operators import assembly as M
from graphloom.operators import graph as G
from graphloom.operators import joins as J
from graphloom.operators import rules as R
from graphloom.operators import windows as W


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "glob", "hit"),
    [("src/Api/Orders.cs", "*/Api/*.cs", True), ("Api/X.cs", "*/Api/*.cs", False), ("a_b", "A_B", True), ("axb", "a_b", False), ("100%", "1?0%", True), (None, "*", False)],
)
def test_glob(spark, value, glob, hit):
    assert one(spark, S.glob_match(F.lit(value).cast("string"), glob)) is hit


def test_words_and_numbers(spark):
    assert one(spark, S.stem(F.lit("entries"))) == "entry" and one(spark, S.stem(F.lit("class"))) == "class" and one(spark, S.stem(F.lit("ties"))) == "tie"
    assert [float(x) for x in one(spark, S.numbers(F.lit("v1.2 costs 3.50, not 7 or x9")))] == [3.5, 7]
    assert one(spark, S.clean_text(F.lit("a\u0000  b\n\n \n c​d"), 40)) == "a b\nc d"
    assert one(spark, S.slug(F.lit("Größe & Straße"))) == "groesse-strasse"
    assert one(spark, S.doc_flags(F.lit("Gets the order items"), F.lit("getOrderItems"))) == ["echo"]
    assert one(spark, S.doc_flags(F.lit("TODO"), F.lit("x"))) == ["placeholder", "too-short"]
    assert one(spark, S.xml_text(F.lit('<summary>Uses <see cref="T:A.B.Order"/>  now</summary>'), "summary")) == "Uses Order now"


def test_versions(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-2x", "1.0.0", "1.0.1", "1.2", "1.10", "2"]
    df = spark.createDataFrame([(v,) for v in order], "v string").orderBy(S.version_key(F.col("v")))
    got = [r.v for r in df.collect()]
    assert got[-5:] == ["1.0.0", "1.0.1", "1.2", "1.10", "2"] and got.index("1.0.0-alpha") < got.index("1.0.0-alpha.1") < got.index("1.0.0-alpha.beta")
    assert one(spark, S.change_kind(F.lit("1.2.3"), F.lit("1.3.0"))) == "minor"
    assert one(spark, S.package_url(F.lit("npm"), F.lit("@a/b c"), F.lit("1.0.0"))) == "pkg:npm/%40a/b%20c@1.0.0"


def test_layers(spark):
    n = spark.createDataFrame([("c", "src/Api/CoinsController.cs", 0), ("s", "src/Application/CoinService.cs", 1), ("o", "src/Domain/Order.cs", 2), ("r", "src/Infrastructure/CoinRepository.cs", 3), ("x", "x.txt", 4)], "id string, file string, ord long")
    layers = dict(rows(R.with_layer(n, config.LAYERS), "id", "layer"))
    assert layers == {"c": "api", "s": "application", "o": "domain", "r": "infrastructure", "x": None}
    e = spark.createDataFrame([("domain", "infrastructure", "d", "r", "calls", 0), ("domain", "infrastructure", "d", "r", "calls", 1), ("ui", None, "u", "http:GET /a", "http", 2), ("api", "application", "a", "s", "calls", 3), ("application", "infrastructure", "a", "r", "calls", 4)], "from_layer string, to_layer string, from_file string, to_key string, kind string, ord long")
    assert rows(R.layer_violations(e), "rule", "severity", "from_file") == [("ARCH-001", "high", "a"), ("ARCH-001", "high", "d"), ("ARCH-002", "medium", "u")]
    via = R.layer_violations(e.limit(0).union(spark.createDataFrame([("ui", "data", "u", "d", "calls", 0)], e.schema)), {"ui": ["app"], "app": ["data"], "data": []})
    assert rows(via, "rule", "via") == [("ARCH-004", "app")]
    assert config.problems(config.Architecture(rules=(config.Rule("R", config.Selector()),)), {"calls"}) == ["R: from selects nothing", "R: forbids nothing"]


def test_security_and_need(spark):
    e = spark.createDataFrame([("a", "POST", "anonymous"), ("b", "GET", "none"), ("c", "GET", "anonymous"), ("d", "PUT", "authorize")], "id string, verb string, auth string")
    assert rows(R.endpoint_auth(e)) == [("SEC-001", "b"), ("SEC-002", "a")]
    n = spark.createDataFrame([("x", "public", 15, 4, 3, 1, False), ("y", None, 3, None, 0, 1, True)], "id string, visibility string, complexity int, params int, fan_in int, effects int, is_type boolean")
    assert rows(R.need_score(n), "id", "score", "level", "reasons") == [("x", 8, "high", "public, complexity 15, 4 params, 3 callers, side effects"), ("y", 0, "none", "")]
    assert one(spark, S.change_kind(F.lit("2.0.0"), F.lit("1.9"))) == "downgrade"


def test_hash_merge_and_first_wins(spark):
    n = spark.createDataFrame([("a", "2", False, 1), ("a", "1", True, 0), ("b", None, False, 2)], "id string, hash string, is_test boolean, ord long")
    merged = dict(rows(M.merge_hashes(n), "id", "hash"))
    assert len(merged["a"]) == 12 and merged["b"] is None
    assert rows(M.distinct_nodes(n), "id", "ord") == [("a", 1), ("b", 2)]


def test_links(spark):
    e = spark.createDataFrame([("x", "http:GET /a", "GET a"), ("y", "http:GET /b", "GET b")], "from_id string, to_id string, key string")
    t = spark.createDataFrame([("GET a", "second", 5), ("GET a", "first", 1)], "key string, id string, ord long")
    assert rows(M.link_by_key(e, t), "from_id", "to_id") == [("x", "first"), ("y", "http:GET /b")]
    files = spark.createDataFrame([("a/b/c.cs",), ("a/x.cs",), ("z.cs",), (None,)], "file string")
    p = spark.createDataFrame([("a", "P", 0), ("a/b", "Q", 1)], "prefix string, project string, ord long")
    assert rows(M.owning_project(files, p), "file", "project") == [("a/b/c.cs", "Q"), ("a/x.cs", "P"), ("z.cs", None), (None, None)]
    calls = spark.createDataFrame([("f", "T", "m", 1), ("f", "T", "m", 3), ("f", "T", "q", 0)], "from_id string, type string, method string, arity int")
    ms = spark.createDataFrame([("m1", "T", "m", 1), ("m2", "T", "m", 2)], "id string, type string, method string, arity int")
    assert rows(M.resolve_calls(calls, ms), "to_id", "kind") == [("T", "accesses"), ("T", "accesses"), ("m1", "calls")]


def test_routes(spark):
    calls = spark.createDataFrame([(1, "GET", "/api/items/7"), (2, "get", "/api/items/special?x=1"), (3, "GET", "/nothing"), (4, "GET", "/t/1")], "call int, verb string, path string")
    t = spark.createDataFrame([("item", "GET", "/api/items/{id}"), ("special", "GET", "/api/items/special"), ("a", "GET", "/t/{id}"), ("b", "GET", "/t/[name]")], "template string, verb string, route string")
    assert rows(J.match_routes(calls, t)) == [(1, "item", "matched"), (2, "special", "matched"), (3, None, "unmatched"), (4, None, "ambiguous")]


def test_intervals(spark):
    s = spark.createDataFrame([("f", "class", 1, 100), ("f", "method", 10, 20), ("f", "same", 10, 20), ("f", "other", 30, 40)], "file string, id string, line int, end_line int")
    h = spark.createDataFrame([("f", 12, 13), ("f", 20, 19)], "file string, first int, last int")
    hits = J.overlapping(h, s, ["file"])
    assert rows(hits, "first", "id") == [(12, "class"), (12, "method"), (12, "same"), (20, "class"), (20, "method"), (20, "same")]
    assert rows(J.innermost(hits, ["file", "first"]), "first", "id") == [(12, "method"), (12, "same"), (20, "method"), (20, "same")]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src int, dst int")
    assert rows(G.strong_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert rows(G.closure(e, spark.createDataFrame([(7,)], "src int"))) == [(7, 1, 1), (7, 2, 2), (7, 3, 3), (7, 4, 4), (7, 5, 5)]
    assert rows(G.weak_components(e, spark.createDataFrame([(9,), (6,), (7,)], "id int"))) == [(6, 6, 2), (7, 1, 1), (9, 9, 3)]
    c = spark.createDataFrame([("p", "c", 0), ("c", "m", 0), ("z", "m", 1)], "parent string, child string, ord int")
    assert rows(G.containment_roots(c)) == [("c", "p"), ("m", "p")]
    flow = spark.createDataFrame([("a", "b", 1), ("b", "c", 0), ("c", "d", 1), ("a", "d", 1), ("d", "e", 1)], "u string, v string, cost int")
    trace = G.flow_trace(flow, spark.createDataFrame([("a",), ("d",)], "start string"), spark.createDataFrame([("d",)], "node string"))
    assert rows(trace, "start", "node", "depth") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 1), ("d", "d", 0), ("d", "e", 1)]
    assert rows(G.effects_closure(flow, spark.createDataFrame([("e", "db")], "node string, effect string"))) == [(x, "db") for x in "abcde"]
    assert G.layer_via({"ui": ["app"], "app": ["data"]}, "ui", "data") == "app"


def test_aggregates(spark):
    assert rows(A.coupling(spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b"), ("b", "b")], "a string, b string"))) == [("a", 1, 0, 1.0), ("b", 0, 2, 0.0), ("c", 1, 0, 1.0)]
    empty = spark.createDataFrame([], "status string, written boolean, flags int")
    assert empty.agg(A.coverage(F.col("status")).alias("c"), A.quality(F.col("written"), F.col("flags")).alias("q")).first() == (100.0, 100.0)
    req = spark.createDataFrame([("R1",), ("R2",), ("R3",)], "requirement string")
    to_a, to_t = spark.createDataFrame([("R1", "A1"), ("R1", "A2"), ("R2", "A2")], "requirement string, architecture string"), spark.createDataFrame([("A1", "T1")], "architecture string, test string")
    assert rows(A.traceability(req, to_a, to_t), "requirement", "status") == [("R1", "partial"), ("R2", "no-test"), ("R3", "no-architecture")]
    assert A.gate(79, 0, 1, 0, config.GATE) == ["coverage", "violations"]


def test_windows(spark):
    lines = ["# Story", "- no", "## Acceptance criteria", "- [ ] one", "```", "- code", "```", "* two", "## Notes", "- no"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "item int, pos int, line string")
    assert [r.text for r in W.criteria(df).orderBy("pos").collect()] == ["one", "two"]
    s = spark.createDataFrame([("e", t, 10, float(t)) for t in range(130)], "k string, t int, n int, p double")
    b = W.buckets(s, ["k"], "t", "n", "p")
    assert b.count() == 44 and b.agg(F.max("p95")).first()[0] == 129.0
    e = spark.createDataFrame([("k", 1, "t", "x" * 20), ("k", 2, "u", "y" * 20), ("k", 3, "v", "z")], "key string, ord int, title string, body string")
    assert rows(W.fit_budget(e, "key", budget=31), "title", "body") == [("t", "x" * 20), ("u", "y" * 8 + "…")]


def test_model_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("a", "class", "A", "a.cs", 0), ("a", "class", "A", "b.cs", 1)], "id string, kind string, name string, file string, ord long")
    e = spark.createDataFrame([("a", "gone", "calls", None, 0)], "from_id string, to_id string, kind string, label string, ord long")
    assert rows(model.model_problems(n, e)) == [("dangling-end", "gone", 1), ("duplicate-id", "a", 2)]
    model.write_snapshot(n, e, str(tmp_path), "s1")
    nodes, edges = model.read_snapshot(spark, str(tmp_path), "s1")
    assert nodes.count() == 2 and edges.columns == ["from_id", "to_id", "kind", "label", "ord"]


def brute_strong(edges):
    reach = {}
    for start in {x for e in edges for x in e}:
        stack, seen = [start], set()
        while stack:
            x = stack.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    stack.append(b)
        reach[start] = seen
    return sorted(((v, min({v} | {w for w in reach[v] if v in reach[w]})) for v in reach if any(w != v and v in reach[w] for w in reach[v])), key=str)


def test_strong_components_of_long_chains(spark):
    """More cycles than any number of rounds, in rising and falling order of the ids."""
    n = 300
    chain = [e for k in range(0, 2 * n, 2) for e in ((k, k + 1), (k + 1, k), (k + 1, k + 2))][:-1]
    want = sorted(((k, k - k % 2) for k in range(2 * n)), key=str)
    assert rows(G.strong_components(spark.createDataFrame(chain, "src int, dst int"))) == want
    assert rows(G.strong_components(spark.createDataFrame([(b, a) for a, b in chain], "src int, dst int"))) == want


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 12, 16), (2, 40, 55)])
def test_strong_components_of_random_graphs(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    assert rows(G.strong_components(spark.createDataFrame(edges, "src int, dst int"))) == brute_strong(edges)


def brute_crawl(edges, seed, depth, limit):
    heap, done, out = [(0, 0, seed)], set(), []
    while heap and len(out) < limit:
        tier, d, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        out.append((at, tier, d))
        if d < depth:
            for src, dst, deferred in edges:
                if src == at and dst not in done:
                    heapq.heappush(heap, (max(tier, int(deferred)), d + 1, dst))
    return out


@pytest.mark.parametrize(("seed", "depth", "limit"), [(1, 3, 100), (2, 5, 12), (3, 4, 25)])
def test_crawl(spark, seed, depth, limit):
    r = random.Random(seed)
    edges = [(f"v{r.randrange(40)}", f"v{r.randrange(40)}", r.random() < 0.4) for _ in range(90)] + [("v0", "v1", False), ("v0", "v2", True)]
    assert G.crawl(spark.createDataFrame(edges, "src string, dst string, deferred boolean"), "v0", depth, limit) == brute_crawl(edges, "v0", depth, limit)


def test_crawl_and_closure_stop_at_their_depth(spark, monkeypatch):
    """A chain longer than the most rounds."""
    monkeypatch.setattr(G, "MOST_ROUNDS", 6)
    e = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}", False) for k in range(30)], "src string, dst string, deferred boolean")
    assert G.crawl(e, "000", 3) == [(f"{k:03}", 0, k) for k in range(4)]
    assert rows(G.closure(e, e.where("src = '000'").select("src"), 2)) == [("000", "001", 1), ("000", "002", 2)]


def test_shortest_paths(spark):
    r = random.Random(4)
    edges = {(f"{r.randrange(12)}", f"{r.randrange(12)}") for _ in range(26)}
    want = []
    for start in map(str, range(12)):
        level, seen = {start: [start]}, set()
        while level:
            seen |= set(level)
            want += [(start, v, p) for v, p in level.items() if v in "0123"]
            nxt = {}
            for a, b in edges:
                if a in level and b not in seen:
                    nxt[b] = min(nxt.get(b, ["z"]), [*level[a], b])
            level = nxt if len(next(iter(level.values()))) <= 8 else {}
    v = spark.createDataFrame([(str(k),) for k in range(12)], "start string")
    got = G.shortest_paths(spark.createDataFrame(list(edges), "src string, dst string"), v, v.where("start < '4' AND length(start) = 1").selectExpr("start AS id"))
    want = [w for w in want if w[1] in {"0", "1", "2", "3"}]
    assert sorted((g.start, g.target, g.path) for g in got.collect()) == sorted(want)
