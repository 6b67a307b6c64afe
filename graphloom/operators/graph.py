"""Graph operators on edge tables. Loops run on the driver over DataFrames; each round is written to the
shared scratch folder, so that plans stay short and lost executors cost one round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected_components

MOST_ROUNDS = 200


def closure(edges: DataFrame, starts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(src, dst, depth): all that each start (src; all sources without starts) reaches in one step or more, and in
    at most so many, at its least depth. Semi-naive: a round extends only what the last one found. Cycles end by
    themselves."""
    e = edges.select("src", "dst").distinct()
    first = e if starts is None else e.join(starts.select("src").distinct(), "src", "left_semi")
    found = frontier = materialize(first.withColumn("depth", F.lit(1)))
    step = e.withColumnsRenamed({"src": "mid", "dst": "next"})
    for depth in range(2, MOST_ROUNDS if most is None else most + 1):
        more = frontier.join(step, frontier.dst == step.mid).select(frontier.src, F.col("next").alias("dst")).distinct()
        frontier = materialize(more.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    if most is not None:
        return found.where(F.col("depth") <= most)
    raise RuntimeError("closure: too many rounds")


def containment_roots(contains: DataFrame) -> DataFrame:
    """(id, root) from (parent, child, ord) by pointer jumping; of several parents the first counts. A cycle of
    parents has no root and raises."""
    w = Window.partitionBy("child").orderBy("ord", "parent")
    up = contains.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("child").alias("id"), F.col("parent").alias("root"))
    up = materialize(up)
    for _ in range(64):
        jump = up.select(F.col("id").alias("root"), F.col("root").alias("further"))
        out = materialize(up.join(jump, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        up = out.select("id", "root")
        if out.where("moved").isEmpty():
            return up
    raise RuntimeError("containment_roots: parents form a cycle")


def ancestors(contains: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, ancestor): each id itself and all that contain it."""
    up = closure(contains.select(F.col("child").alias("src"), F.col("parent").alias("dst")), ids.select(F.col("id").alias("src")))
    return ids.select("id", F.col("id").alias("ancestor")).union(up.select("src", "dst"))


def hops(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(start, id, hop, via): neighbours in either direction up to k hops, at the least hop; via the least neighbour before."""
    both = edges.select(F.col("src").alias("mid"), F.col("dst").alias("next")).union(edges.select("dst", "src")).distinct()
    found = frontier = materialize(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via")))
    for hop in range(1, k + 1):
        more = frontier.join(both, frontier.id == both.mid).groupBy("start", F.col("next").alias("id")).agg(F.min(F.col("mid").cast("string")).alias("via"))
        frontier = materialize(more.join(found, ["start", "id"], "left_anti").select("start", "id", F.lit(hop).alias("hop"), "via"))
        found = found.unionByName(frontier)
    return found.where("hop > 0")


def flow_trace(edges: DataFrame, starts: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, via): least number of cost-1 steps from every start at once, over edges (u, v, cost of
    0 or 1). Stop nodes are reached but not passed, unless they are the start. Rounds go depth by depth: first
    the free steps to a fixpoint, then one paid step; so each (start, node) is settled once. via is the least
    node that a settled node was reached from."""
    e = edges.groupBy("u", "v").agg(F.min("cost").alias("cost"))
    halt = (stops if stops is not None else edges.limit(0).select(F.col("u").alias("node"))).select("node").distinct().withColumn("halt", F.lit(True))

    def onward(frontier: DataFrame, cost: int) -> DataFrame:
        live = frontier.join(halt, "node", "left").where("halt IS NULL OR node = start")
        return live.join(e.where(F.col("cost") == cost), live.node == e.u).groupBy("start", F.col("v").alias("node")).agg(F.min("u").alias("via"))

    settled = level = materialize(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct())
    for depth in range(MOST_ROUNDS):
        free = level
        while True:
            free = materialize(onward(free, 0).join(settled, ["start", "node"], "left_anti").select("start", "node", F.lit(depth).alias("depth"), "via"))
            if free.isEmpty():
                break
            level = level.unionByName(free)
            settled = settled.unionByName(free)
        level = materialize(onward(level, 1).join(settled, ["start", "node"], "left_anti").select("start", "node", F.lit(depth + 1).alias("depth"), "via"))
        if level.isEmpty():
            return settled
        settled = settled.unionByName(level)
    raise RuntimeError("flow_trace: too many rounds")


def flow_units(trace: DataFrame, units: DataFrame, dispatched: DataFrame | None = None) -> DataFrame:
    """(start, unit, hop): units (node, unit) of a trace by least depth, without the start's own and without the
    dispatched ones (start, unit)."""
    own = units.select(F.col("node").alias("start"), F.col("unit").alias("own"))
    out = trace.join(units, "node").groupBy("start", "unit").agg(F.min("depth").alias("hop")).join(own, "start", "left").where("own IS NULL OR unit != own").drop("own")
    return out if dispatched is None else out.join(dispatched, ["start", "unit"], "left_anti")


def backlinks(units: DataFrame) -> DataFrame:
    """(unit, starts): how many starts reach each unit."""
    return units.groupBy("unit").agg(F.countDistinct("start").alias("starts"))


def flow_chains(units: DataFrame, per_hop: int = 6) -> DataFrame:
    """One line per start: the units of each hop, at most so many with the number of the rest."""
    w = Window.partitionBy("start", "hop")
    r = units.withColumn("k", F.row_number().over(w.orderBy("unit"))).withColumn("n", F.count("*").over(w)).where(F.col("k") <= per_hop)
    names = r.groupBy("start", "hop").agg(F.array_join(F.array_sort(F.collect_list("unit")), ", ").alias("names"), F.max("n").alias("n"))
    hop = names.withColumn("text", F.when(F.col("n") > per_hop, F.concat("names", F.lit(" +"), F.col("n") - per_hop)).otherwise(F.col("names")))
    return hop.groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", "text"))), lambda x: x["text"]), " > ").alias("chain"))


def effects_closure(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, effect): effects of a node and of all that it reaches over (u, v). Only new rows travel back; on a
    cycle every member has the whole set."""
    e = edges.select("u", "v").distinct()
    found = frontier = materialize(own.select("node", "effect").distinct())
    for _ in range(MOST_ROUNDS):
        more = frontier.join(e, frontier.node == e.v).select(F.col("u").alias("node"), "effect").distinct()
        frontier = materialize(more.join(found, ["node", "effect"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise RuntimeError("effects_closure: too many rounds")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the vertices in strongly connected components of two or more; component is its least member.

    Colouring both ways: each vertex learns the least id that reaches it and the least that it reaches. Where both
    are the same, that id's component is settled and leaves. Members of a component agree in both colours, so edges
    between unlike vertices leave as well, and the rest is coloured again until no edge is left: the least vertex
    of the rest is always settled.
    """
    e = materialize(edges.select("src", "dst").where("src != dst").distinct())
    out = None
    while not e.isEmpty():
        ways = e.select(F.lit(True).alias("on"), "src", "dst").union(e.select(F.lit(False), "dst", "src"))
        colour = materialize(ways.select("on", F.col("src").alias("id")).union(ways.select("on", "dst")).distinct().withColumn("c", F.col("id")))
        while True:
            reached = ways.join(colour.withColumnRenamed("id", "src"), ["on", "src"]).groupBy("on", F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            nxt = colour.withColumnRenamed("c", "was").join(reached, ["on", "id"], "left").select("on", "id", "was", F.least("was", F.coalesce("m", "was")).alias("c"))
            nxt = materialize(nxt)
            # what reaches the colour's own vertex reaches what it colours
            jump = nxt.select("on", F.col("id").alias("c"), F.col("c").alias("further"))
            nxt = materialize(nxt.join(jump, ["on", "c"]).select("on", "id", "was", F.col("further").alias("c")))
            colour = nxt.select("on", "id", "c")
            if nxt.where("c != was").isEmpty():
                break
        both = colour.where("on").select("id", F.col("c").alias("f")).join(colour.where("not on").select("id", F.col("c").alias("b")), "id")
        both = materialize(both)
        alike = both.where("f = b")
        big = alike.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
        found = alike.join(big, "f").select("id", F.col("f").alias("component"))
        out = found if out is None else out.union(found)
        left = both.where("f != b")
        side = lambda k: left.select(F.col("id").alias(k), "f", "b")
        e = materialize(e.join(side("src"), "src").join(side("dst"), ["dst", "f", "b"]).select("src", "dst"))
    return out if out is not None else edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)


def ordinals(df: DataFrame, *key) -> DataFrame:
    """df with number, from 1 in order of a unique key (columns or sort orders): ranges are numbered apart, and only the ranges' counts meet."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *key).withColumn("part", F.spark_partition_id()))
    ranges = dealt.groupBy("part").agg(F.count("*").alias("k"))  # as many rows as partitions
    ranges = ranges.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    return dealt.withColumn("own", own).join(F.broadcast(ranges), "part").withColumn("number", (F.col("before") + F.col("own")).cast("int")).drop("part", "own", "k", "before")


def weak_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component, number): vertices alone included; numbers follow the least members."""
    parts = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    out = vertices.select("id").distinct().join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    roots = ordinals(out.select("component").distinct(), "component")
    return out.join(roots, "component").select("id", "component", "number")


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, most: int = 8) -> DataFrame:
    """(start, target, path): one shortest path of at most so many steps, as an array of ids. Of equal ones the
    one whose ids are least from the start on."""
    e = edges.select("src", "dst").distinct()
    level = materialize(starts.select("start", F.col("start").alias("id"), F.array("start").alias("path")))
    seen = level.select("start", "id")
    found = level.join(targets.select(F.col("id").alias("id")), "id", "left_semi").select("start", "id", "path")
    for _ in range(most):
        more = level.join(e, level.id == e.src).select("start", F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        level = materialize(more.groupBy("start", "id").agg(F.min("path").alias("path")).join(seen, ["start", "id"], "left_anti"))
        if level.isEmpty():
            break
        seen = materialize(seen.union(level.select("start", "id")))
        found = found.unionByName(level.join(targets.select("id"), "id", "left_semi").select("start", "id", "path"))
    return found.withColumnRenamed("id", "target")


def test_links(tests: DataFrame, implements: DataFrame, contains: DataFrame) -> DataFrame:
    """(id, test, via): tests (test, id) of a node directly, or of its interface, implementation or member; direct first."""
    parts = [
        tests.select("id", "test", F.lit(0).alias("rank"), F.lit("direct").alias("via")),
        implements.join(tests, implements.to_id == tests.id).select(F.col("from_id").alias("id"), "test", F.lit(1).alias("rank"), F.lit("interface").alias("via")),
        implements.join(tests, implements.from_id == tests.id).select(F.col("to_id").alias("id"), "test", F.lit(2).alias("rank"), F.lit("implementation").alias("via")),
        contains.join(tests, contains.child == tests.id).select(F.col("parent").alias("id"), "test", F.lit(3).alias("rank"), F.lit("member").alias("via")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id", "test").agg(F.min_by("via", "rank").alias("via"))


def layer_via(allow: dict[str, list[str]], start: str, goal: str) -> str | None:
    """The first layer on a shortest allowed way from start to goal. Configuration, so a small loop."""
    queue, came = [start], {start: None}
    while queue:
        at = queue.pop(0)
        for nxt in allow.get(at, []):
            if nxt in came:
                continue
            came[nxt] = at
            if nxt == goal:
                while came[nxt] != start:
                    nxt = came[nxt]
                return None if nxt == goal else nxt
            queue.append(nxt)
    return None


def crawl(edges: DataFrame, seed: str, depth: int = 3, limit: int = 100) -> list[tuple[str, int, int]]:
    """(id, tier, depth) best first by tier, depth and id, from one seed; edges: src, dst, deferred. Depth is at most
    8 and the limit at most 500.

    A vertex always comes after the one that it is found from, and all of tier 0 before tier 1. So the search is
    one round per tier and depth, and a round fetches no more than the vertices that the limit still has room for.
    """
    if depth > 8 or limit > 500:
        raise ValueError("crawl: depth is at most 8 and the limit at most 500")
    spark = edges.sparkSession
    e = materialize(edges.select("src", "dst", "deferred").where("dst IS NOT NULL").distinct())
    out, done, levels = [(seed, 0, 0)][:limit], {seed}, {(0, 0): [seed]}

    def table(ids) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(x,) for x in ids], "id string"))

    for tier in (0, 1):
        for d in range(1, depth + 1):
            # from tier 0: its plain edges to tier 0, its deferred ones to tier 1; from tier 1: any edge
            parts = [e.where(F.col("deferred") == bool(tier)).join(table(levels[0, d - 1]), F.col("src") == F.col("id"), "left_semi")] if levels.get((0, d - 1)) else []
            if tier and levels.get((1, d - 1)):
                parts.append(e.join(table(levels[1, d - 1]), F.col("src") == F.col("id"), "left_semi"))
            if not parts or len(out) >= limit:
                continue
            near = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
            fresh = near.select(F.col("dst").alias("id")).distinct().join(table(done), "id", "left_anti")
            found = [r.id for r in fresh.orderBy("id").limit(limit - len(out)).collect()]
            levels[tier, d] = found
            done.update(found)
            out += [(x, tier, d) for x in found]
    return out


def crawl_relations(edges: DataFrame, visited: DataFrame, limit: int) -> DataFrame:
    """Edges (src, dst, label) with both ends visited (id), in order of ends and label, at most 12 times the limit: a fixed
    number of rows. certainty is inferred where the label says so."""
    v = visited.select("id")
    both = edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct()
    certainty = F.when(F.contains("label", F.lit("inferred")), "inferred").otherwise("detected")
    return both.select("src", "dst", "label", certainty.alias("certainty")).orderBy("src", "dst", "label").limit(12 * limit)


def units(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, unit): members (method, constructor, property, event) that aren't endpoints stand for themselves, all else
    for the top of what contains it. nodes: id, kind, endpoint; roots: id, root."""
    own = F.col("kind").isin("method", "constructor", "property", "event") & ~F.col("endpoint")
    return nodes.join(roots, "id", "left").select("id", F.when(own, F.col("id")).otherwise(F.coalesce("root", "id")).alias("unit"))


def target_scope(contains: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id): each target (id) and all that it contains, at any depth."""
    down = closure(contains.select(F.col("parent").alias("src"), F.col("child").alias("dst")), targets.select(F.col("id").alias("src")))
    return targets.select(F.col("id").alias("target"), "id").union(down.select("src", "dst"))
