"""Bounded walks, routes and intervals against plain Python."""

import heapq
import random

from graphloom.operators import joins as J
from graphloom.operators import paths as P
from graphloom.operators import projects


def brute_paths(edges, seeds, depth, most):
    out = []

    def walk(path, labels):
        on = [(o, d, k) for s, d, k, o in sorted(edges, key=lambda e: e[3]) if s == path[-1] and d not in path] if len(labels) < depth else []
        if not on:
            if labels:
                out.append((path, labels))
            return
        for _, d, k in on:
            walk([*path, d], [*labels, k])

    for _, s in sorted(seeds):
        walk([s], [])
    return out[:most], len(out) > most


def test_simple_paths_equal_a_walk(spark):
    r = random.Random(1)
    edges = [(f"v{r.randrange(9)}", f"v{r.randrange(9)}", r.choice("ab"), k) for k in range(40)]
    edges += [("hub", f"v{k % 9}", "h", 100 + k) for k in range(60)]
    seeds = [(n, f"v{r.randrange(9)}" if k else "hub", k) for n in range(6) for k in range(n % 3 + (n == 5))] + [(9, "alone", 0)]
    e = spark.createDataFrame(edges, "src string, dst string, label string, ord long")
    s = spark.createDataFrame(seeds, "report int, seed string, ord int")
    for depth, most in ((1, 3), (3, 10), (4, 2)):
        got: dict = {}
        for x in P.simple_paths(e, s, depth, most).orderBy("report", "place").collect():
            got.setdefault(x.report, []).append((x.path, x.labels, x.capped))
        for n in {x[0] for x in seeds}:
            want, capped = brute_paths(edges, [(o, v) for m, v, o in seeds if m == n], depth, most)
            assert got.get(n, []) == [(p, k, capped) for p, k in want]


def brute_crawl(steps, starts, depth, limit):
    seen, heap, cut = {}, [(0, 0, s) for s in set(starts)], False
    heapq.heapify(heap)
    while heap:
        tier, d, v = heapq.heappop(heap)
        if v in seen:
            continue
        if len(seen) >= limit:
            cut = True
            break
        seen[v] = (tier, d)
        if d < depth:
            for s, t, deferred, seed_only in steps:
                if s == v and t not in seen and (d == 0 or not seed_only):
                    heapq.heappush(heap, (1 if deferred else tier, d + 1, t))
    return {(v, *k, cut) for v, k in seen.items()}


def test_crawls_equal_a_queue(spark):
    r = random.Random(2)
    steps = sorted({(f"v{r.randrange(30)}", f"v{r.randrange(30)}", r.random() < 0.3, r.random() < 0.2) for _ in range(90)})
    seeds = [(k, f"v{r.randrange(30)}") for k in range(12)] + [(0, "v3"), (0, "v4"), (12, "alone")]
    e, s = spark.createDataFrame(steps, "src string, dst string, deferred boolean, seed_only boolean"), spark.createDataFrame(seeds, "crawl int, id string")
    for depth, limit in ((3, 100), (4, 7), (2, 1), (0, 5)):
        got = P.crawls(e, s, depth, limit).collect()
        for k in {k for k, _ in seeds}:
            assert {(x.id, x.tier, x.depth, x.truncated) for x in got if x.crawl == k} == brute_crawl(steps, [v for n, v in seeds if n == k], depth, limit)


def test_crawls_that_are_truncated_go_no_further(spark, monkeypatch):
    """A vertex's steps are kept as far as a limit needs them, and a crawl over its limit takes part in no later round."""
    steps = [("a", f"b{k}", False, False) for k in range(50)] + [(f"b{k}", f"c{j}", False, False) for k in range(50) for j in range(50)] + [("x", "y", False, False), ("y", "z", True, False), ("z", "a", False, False)]
    written, real = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, *rows: written.append(out := real(df, *rows)) or out)
    seeds = [(1, "a"), (2, "x")]
    got = P.crawls(spark.createDataFrame(steps, "src string, dst string, deferred boolean, seed_only boolean"), spark.createDataFrame(seeds, "crawl int, id string"), 3, 4).collect()
    for k, start in seeds:
        assert {(x.id, x.tier, x.depth, x.truncated) for x in got if x.crawl == k} == brute_crawl(steps, [start], 3, 4)
    assert sum(df.count() for df in written if "at" in df.columns) <= 5 * 51 + 3
    assert sum(df.where("crawl = 1").count() > 0 for df in written if "crawl" in df.columns) == 2  # its start and the round that cuts it


def test_chains_are_put_together_level_by_level(spark, monkeypatch):
    """A short chain isn't joined and written again for each level of the longest one."""
    steps = [(f"a{k}", "g", "calls") for k in range(20)] + [("b", "v1", "calls")] + [(f"v{k}", f"v{k + 1}", "calls") for k in range(1, 6)] + [("v6", "g", "injects"), ("v2", "v1", "calls")]
    written, real = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, *rows: written.append(out := real(df, *rows)) or out)
    chains, findings = P.action_chains(spark.createDataFrame([(f"a{k}",) for k in range(20)] + [("b",), ("g",)], "action string"), spark.createDataFrame(steps, "src string, dst string, kind string"), spark.createDataFrame([("g",)], "id string"))
    got = {r.action: (r.path, r.kinds, r.depth) for r in chains.collect()}
    assert got == {f"a{k}": ([f"a{k}", "g"], ["calls"], 1) for k in range(20)} | {"b": (["b", *(f"v{k}" for k in range(1, 7)), "g"], ["calls"] * 6 + ["injects"], 7), "g": (["g"], [], 0)}
    assert findings.count() == 0 and sum(df.count() for df in written if "path" in df.columns) <= 22 + 5 + 21 + 22


def test_crawl_steps(spark):
    nodes = [("T", "class", False), ("T.m", "method", False), ("R", "record", False), ("I", "interface", False), ("X", "external", False), ("t", "class", True), ("p", "package", False), ("m", "method", None)]
    edges = [("T", "T.m", "contains"), ("T.m", "m", "contains"), ("T.m", "R", "calls"), ("T.m", "T", "creates"), ("T", "I", "implements"), ("X", "T", "calls"), ("T", "t", "calls"), ("T", "p", "calls"), ("T", "m", "mentions"), ("T", "X", "http"), ("T", "gone", "calls")]
    out = P.crawl_steps(spark.createDataFrame(nodes, "id string, kind string, test boolean"), spark.createDataFrame(edges, "src string, dst string, kind string"))
    assert {tuple(x) for x in out.collect()} == {("T", "T.m", False, True), ("T.m", "R", True, False), ("T.m", "T", True, False), ("T", "I", False, False), ("I", "T", False, False), ("T", "X", False, False)}


def brute_chains(edges, action, goals, depth, visits):
    queue, seen, out = [(action, [])], {action}, {}
    nexts: dict = {}
    for s, d, k in sorted(edges, key=lambda e: (e[1], e[2])):
        if k in P.CHAIN_KINDS and s != d:
            nexts.setdefault(s, []).append((d, k))
    while queue:
        v, path = queue.pop(0)
        if v in goals:
            out[v] = ([action, *[x for x, _ in path]], [k for _, k in path])
        if len(path) < depth and len(seen) < visits:
            for x, k in nexts.get(v, []):
                if x not in seen:
                    seen.add(x)
                    queue.append((x, [*path, (x, k)]))
    return out, len(seen)


def test_chains_equal_a_queue(spark):
    r = random.Random(4)
    edges = [(f"v{r.randrange(25)}", f"v{r.randrange(25)}", r.choice([*P.CHAIN_KINDS, "contains"])) for _ in range(80)]
    actions, goals = [f"v{k}" for k in range(10)], {"v3", "v20", "v21", "v22", "v9"}
    e = spark.createDataFrame(edges, "src string, dst string, kind string")
    a, g = spark.createDataFrame([(x,) for x in actions], "action string"), spark.createDataFrame([(x,) for x in goals], "id string")
    for depth, visits in ((8, 5000), (2, 5000), (8, 6), (8, 3)):
        chains, findings = P.action_chains(a, e, g, depth, visits)
        got: dict = {}
        for x in chains.collect():
            got.setdefault(x.action, {})[x.goal] = (x.path, x.kinds)
        over = {x.action: x.visited for x in findings.collect()}
        for x in actions:
            want, seen = brute_chains(edges, x, goals, depth, visits)
            assert got.get(x, {}) == want and over.get(x) == (seen if seen >= visits else None)


def test_traces_are_cut_and_told(spark):
    links = spark.createDataFrame([("E", "entity-class", "cs:E"), ("E", "dbcontext-persists", "db"), ("F", "entity-class", "cs:F"), ("F", "dbcontext-persists", "none")], "entity string, kind string, symbol string")
    controllers = spark.createDataFrame([("c", f"a{k}", " " if k else "/x") for k in range(4)], "controller string, action string, route string")
    steps = spark.createDataFrame([(f"a{k}", "db", "calls") for k in range(4)], "src string, dst string, kind string")
    chains, _ = P.action_chains(controllers.select("action"), steps, spark.createDataFrame([("db",)], "id string"))
    traces, missing, findings = P.entity_traces(links, controllers, chains, most=3)
    assert sorted((x.action, x.route, x.path) for x in traces.collect()) == [("a0", "/x", ["a0", "db", "cs:E"]), ("a1", None, ["a1", "db", "cs:E"]), ("a2", None, ["a2", "db", "cs:E"])]
    assert [x.entity for x in missing.collect()] == ["F"] and [x.action for x in findings.collect()] == ["a2"]


def test_routes_equal_all_pairs(spark):
    r = random.Random(5)
    word = lambda: r.choice(["api", "API", "items", "a", "7"])
    templates = sorted({(r.choice(["GET", "post"]), "/".join(["", *[r.choice([word(), "{id}", ":x", "[y]"]) for _ in range(r.randint(0, 4))]]) or "/") for _ in range(60)})
    calls = [(k, r.choice(["get", "POST"]), "/".join(["", *[word() for _ in range(r.randint(0, 5))]]) or "/") for k in range(200)]
    parts = lambda p: [x for x in p.split("/") if x]
    parameter = lambda x: x[0] in "{:["
    want = []
    for k, verb, path in calls:
        fits = [(sum(not parameter(b) for b in parts(t)), n) for n, (v, t) in enumerate(templates) if v.upper() == verb.upper() and len(parts(t)) == len(parts(path)) and all(parameter(b) or a.lower() == b.lower() for a, b in zip(parts(path), parts(t), strict=True))]
        best = [n for s, n in fits if s == max(fits)[0]]
        want.append((k, f"t{best[0]}" if len(best) == 1 else None, "matched" if len(best) == 1 else "ambiguous" if best else "unmatched"))
    t = spark.createDataFrame([(f"t{n}", v, p) for n, (v, p) in enumerate(templates)], "template string, verb string, route string")
    got = J.match_routes(spark.createDataFrame(calls, "call int, verb string, path string"), t)
    assert sorted(tuple(x) for x in got.collect()) == want and {w[2] for w in want} == {"matched", "ambiguous", "unmatched"}


def test_intervals_equal_all_pairs(spark):
    r = random.Random(6)
    length = lambda: r.choice([0, 0, 1, 3, 9, 100, 3000])
    symbols = [(r.choice("fg"), k, a := r.randrange(4000), a + length()) for k in range(250)]
    hunks = [(r.choice("fgh"), a := r.randrange(4000), a + length() if r.random() < 0.8 else a - 1) for _ in range(80)]
    s, h = spark.createDataFrame(symbols, "file string, id int, line int, end_line int"), spark.createDataFrame(hunks, "file string, first int, last int")
    got = sorted((x.file, x.first, x.last, x.id) for x in J.overlapping(h, s, ["file"]).collect())
    assert got == sorted((f, a, b, k) for f, a, b in hunks for g, k, c, d in symbols if f == g and c <= b and d >= a)
    inner = sorted(x.id for x in J.innermost(s, ["file"]).collect())
    assert inner == sorted(k for f, k, a, b in symbols if not any(f == g and a <= c and b >= d and (a < c or b > d) for g, _, c, d in symbols))
    assert J.overlapping(h.limit(0), s.limit(0), ["file"]).count() == 0


def test_renames_equal_all_pairs(spark):
    r = random.Random(8)
    touches = [(f"s{r.randrange(40)}", r.choice("ab"), "()", "m", r.choice("fg"), r.randrange(2), r.randrange(60)) for _ in range(120)]
    t = spark.createDataFrame(touches, "id string, owner string, args string, kind string, file string, line int, order int")
    alive = {f"s{k}" for k in range(0, 40, 3)}
    first, last = ({x: f(t[6] for t in touches if t[0] == x) for x in {t[0] for t in touches}} for f in (min, max))
    want = {}
    for b in touches:
        ends = [(e[6], e[0]) for e in touches if e[6] == last[e[0]] and e[0] not in alive and e[1:6] == b[1:6] and e[6] <= b[6] and e[0] != b[0]]
        if b[6] == first[b[0]] and ends:
            want[b[0]] = max(want.get(b[0], (-1, "")), max(ends))
    got = projects.renamed_from(t, spark.createDataFrame([(x,) for x in alive], "id string")).collect()
    assert {x.id: x.was for x in got} == {k: was for k, (_, was) in want.items()} and len(got) == len(want)
