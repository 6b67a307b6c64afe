"""Joins on prefixes, routes, intervals, names and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize


def longest_prefix(items: DataFrame, prefixes: DataFrame, path: str, prefix: str) -> DataFrame:
    """Each item with the prefix row whose folder is the longest that holds its path; null columns without one.

    The item's folders are exploded, so that the join is an equi-join. prefixes needs ord: of equal
    prefixes the first wins.
    """
    own = [c for c in prefixes.columns if c not in (prefix, "ord")]
    parts = F.split(path, "/")
    depth = F.sequence(F.lit(0), F.size(parts) - 1)
    each = items.select(path).where(F.col(path).isNotNull()).distinct().withColumn("k", F.explode(F.transform(depth, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    hit = each.join(prefixes.withColumnRenamed(prefix, "k"), "k").groupBy(path).agg(F.max_by(F.struct(*own, F.col("k").alias(prefix)), F.struct(F.length("k"), -F.col("ord"))).alias("hit"))
    return items.join(hit, path, "left").select(*items.columns, *[F.col(f"hit.{c}").alias(c) for c in [*own, prefix]])


#: Most nodes of a trie's level, of two short strings each, that are broadcast.
BROADCAST_NODES = 1 << 17
PARAMETER = "{}"


def route_trie(templates: DataFrame) -> DataFrame:
    """The templates' trie: node, parent, key (a literal in lower case, or {} for a parameter), level, template (at its last
    node, else null) and literals so far. A root is a verb and a number of segments; a node is named by its way from there."""
    seg = S.segments(F.col("route"))
    keys = F.transform(seg, lambda x: F.when(S.is_parameter(x), PARAMETER).otherwise(F.lower(x)))
    t = templates.select("template", F.upper("verb").alias("verb"), keys.alias("keys")).withColumn("n", F.size("keys"))
    root = F.concat_ws("/", "verb", F.col("n").cast("string"))
    upto = lambda k: F.concat_ws("/", root, F.slice("keys", F.lit(1), k))
    each = t.select("template", "keys", "n", "verb", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("level"))
    literals = F.size(F.filter(F.slice("keys", F.lit(1), F.col("level")), lambda x: x != PARAMETER))
    own = F.when(F.col("level") == F.col("n"), F.col("template"))
    parent, key = F.when(F.col("level") > 0, upto(F.col("level") - 1)), F.when(F.col("level") > 0, F.get("keys", F.col("level") - 1))
    return each.select(upto(F.col("level")).alias("node"), parent.alias("parent"), key.alias("key"), "level", literals.alias("literals"), own.alias("template")).distinct()


def match_routes(calls: DataFrame, templates: DataFrame) -> DataFrame:
    """Calls (call, verb, path) against route templates (template, verb, route).

    Calls descend the templates' trie, level by level: a call's places join the nodes below them on equality with
    its next segment, in lower case, or a parameter. So a call is never held against templates that leave its way. The
    template with most literals wins; where several do, the call is ambiguous. Returns call, template, status (matched,
    ambiguous, unmatched).
    """
    trie = materialize(route_trie(templates))
    deepest = trie.agg(F.max("level")).first()[0] or 0
    c = calls.select("call", F.upper("verb").alias("verb"), S.segments(F.col("path")).alias("cs")).withColumn("n", F.size("cs"))
    nodes = lambda k: small(trie.where(F.col("level") == k), BROADCAST_NODES)
    at = c.withColumn("parent", F.concat_ws("/", "verb", F.col("n").cast("string"))).where(F.col("n") <= deepest)
    at = at.join(nodes(0).select(F.col("node").alias("parent"), "literals", "template"), "parent")
    ends = [at.where("n = 0")]
    for k in range(1, deepest + 1):
        ways = F.explode(F.array_distinct(F.array(F.lower(F.get("cs", F.lit(k - 1))), F.lit(PARAMETER))))
        down = at.where(F.col("n") >= k).select("call", "cs", "n", "parent").withColumn("key", ways)
        at = materialize(down.join(nodes(k).select("parent", "key", "node", "literals", "template"), ["parent", "key"]).select("call", "cs", "n", F.col("node").alias("parent"), "literals", "template"))
        ends.append(at.where(F.col("n") == k))
    hits = reduce(DataFrame.unionByName, [e.select("call", "template", "literals") for e in ends]).where("template IS NOT NULL")
    best = hits.groupBy("call").agg(F.max("literals").alias("literals"))
    won = hits.join(best, ["call", "literals"]).groupBy("call").agg(F.count("*").alias("k"), F.min("template").alias("template"))
    out = calls.select("call").join(won, "call", "left")
    return out.select("call", F.when(F.col("k") == 1, F.col("template")).alias("template"), F.when(F.col("k").isNull(), "unmatched").when(F.col("k") > 1, "ambiguous").otherwise("matched").alias("status"))


def small(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def levels(first: Column, last: Column) -> Column:
    """The power of two that an interval fits into: 0 for one place, 1 for two, 2 for four."""
    return F.ceil(F.log2((last - first + 1).cast("double"))).cast("int")


def overlapping(hunks: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Hunks (keys, first, last) with the symbols (keys, id, line, end_line) that they touch. A hunk without
    lines (last < first) is a deletion between two lines and is touched by what holds both.

    Lines are cut into bins of 2^k for each level k that is the level of an interval (bins of a level are at least as long
    as its intervals, so that each lies in two at most). Every interval is put into the bins of its own level and of those
    above that the other side has; sides meet on equal keys, level and bin, where at least one is at its own level. A
    pair that shares two bins counts in the later of their first ones. So a key's pairs that are far apart never meet.
    """
    # lo to hi are the places that an interval has to share with another one; a deletion's are the two lines around it
    h = hunks.withColumns({"_lo": F.least("first", "last"), "_hi": F.greatest("first", "last")})
    s = symbols.withColumns({"_lo": F.col("line"), "_hi": F.col("end_line")}).where(F.col("end_line") >= F.col("line"))
    h, s = (x.withColumn("_own", levels(F.col("_lo"), F.col("_hi"))) for x in (h, s))
    has = [sorted(r[0] for r in x.select("_own").distinct().collect()) for x in (h, s)]  # at most 64 numbers each
    every = sorted({*has[0], *has[1]})

    def binned(x: DataFrame, mark: str) -> DataFrame:
        x = x.withColumn("_level", F.explode(F.array(*map(F.lit, every)).cast("array<int>"))).where(F.col("_level") >= F.col("_own"))
        at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
        x = x.withColumns({f"{mark}bin": at("_lo"), "_bin": F.explode(F.sequence(at("_lo"), at("_hi")))})
        return x.withColumn(f"{mark}own", F.col("_own") == F.col("_level")).drop("_lo", "_hi", "_own")

    if not every:
        return hunks.join(symbols, keys).limit(0)
    both = binned(h, "_a").join(binned(s, "_b"), [*keys, "_level", "_bin"]).where("(_aown OR _bown) AND _bin = greatest(_abin, _bbin)")
    touch = (F.col("line") <= F.col("last")) & (F.col("end_line") >= F.col("first"))
    return both.where(touch).select(*keys, *[c for c in hunks.columns if c not in keys], *[c for c in symbols.columns if c not in keys])


#: Lines to a stretch of the sweep.
STRETCH = 1024


def innermost(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits (keys, id, line, end_line) but those that strictly hold another hit of the same keys.

    A sweep from the last line to the first carries the least end seen: a hit holds another if one that begins further
    on, or at its line, ends no later (and isn't the same range). It runs within stretches of lines, and over the
    stretches' least ends, so that a key with very many hits isn't one sorted window.
    """
    at = F.floor(F.col("line") / STRETCH)
    x = hits.withColumn("_stretch", at)
    ends = x.groupBy(*keys, "_stretch").agg(F.min("end_line").alias("_least"))
    after = Window.partitionBy(*keys).orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_later", F.min("_least").over(after)).drop("_least")
    own = Window.partitionBy(*keys, "_stretch")
    beyond = F.min("end_line").over(own.orderBy(F.col("line").cast("long").desc()).rangeBetween(Window.unboundedPreceding, -1))
    beside = F.min("end_line").over(Window.partitionBy(*keys, "_stretch", "line"))
    x = x.withColumns({"_beyond": beyond, "_beside": beside}).join(ends, [*keys, "_stretch"])
    holds = (F.least("_beyond", "_later") <= F.col("end_line")) | (F.col("_beside") < F.col("end_line"))
    return x.where(~F.coalesce(holds, F.lit(False))).select(*hits.columns)


def unique_join(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left with right's value where the key has exactly one row there, else null."""
    one = right.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")
    return left.join(one, key, "left")


def same_name_pairs(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Removed and added ids of one name before the parameters, where each side has only one."""
    one = lambda df, name: df.withColumn("key", F.substring_index("id", "(", 1)).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return one(removed, "was").join(one(added, "now"), "key").select("was", "now")


def newest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row of each key with the greatest at; of equal ones the least tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), tie)
    return df.withColumn("newest_rank", F.row_number().over(w)).where("newest_rank = 1").drop("newest_rank")


def row_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed; null values equal each other."""
    b, a = before.select(key, F.col(value).alias("b"), F.lit(True).alias("was")), after.select(key, F.col(value).alias("a"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return b.join(a, key, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def word_hits(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts (id, text) that hold a name (name) as a whole word: words are exploded, the join is on equality."""
    tokens = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    return tokens.join(names, "name").select("id", "name").distinct()


def two_hop(a_to_b: DataFrame, b_to_c: DataFrame) -> DataFrame:
    """(a, c) over a shared b, once each."""
    return a_to_b.join(b_to_c, "b").select("a", "c").distinct()


def name_rank(name: Column, wanted: str) -> Column:
    """0 equal, 1 begins with, 2 holds, null else; case doesn't matter."""
    n, w = F.lower(name), wanted.lower()
    return F.when(n == w, 0).when(n.startswith(w), 1).when(F.contains(n, F.lit(w)), 2)


def find_names(df: DataFrame, wanted: str, limit: int, name: str = "name") -> DataFrame:
    """The best matches by rank, length and name."""
    out = df.withColumn("rank", name_rank(F.col(name), wanted)).where("rank IS NOT NULL")
    return out.orderBy("rank", F.length(name), name).limit(limit)


def catalog_links(catalogs: DataFrame, items: DataFrame, histories: DataFrame, links: DataFrame) -> DataFrame:
    """(catalog, item, status, symbols): the items of work-item catalogs with the number of symbols that the catalog's history
    links to them.

    catalogs: catalog, source, project; items: catalog, item; histories: catalog, provider, repository (one for a catalog at
    most); links: catalog, item, symbol. Ids are only unique within a server's project: where a catalog and its history aren't
    of one origin, none of its links count and all its items are labelled history-unavailable. That is decided once per
    catalog. Without a history the items are not-assessed, else linked or not-linked.
    """
    same = S.same_origin(F.col("source"), F.col("project"), F.col("provider"), F.col("repository"))
    told = catalogs.join(histories.withColumn("has", F.lit(True)), "catalog", "left")
    told = told.select("catalog", F.when(F.col("has"), F.when(same, "same").otherwise("history-unavailable")).otherwise("not-assessed").alias("origin"))
    good = links.join(told.where("origin = 'same'").select("catalog"), "catalog", "left_semi")
    n = good.groupBy("catalog", "item").agg(F.countDistinct("symbol").alias("symbols"))
    out = items.select("catalog", "item").distinct().join(told, "catalog").join(n, ["catalog", "item"], "left")
    status = F.when(F.col("origin") != "same", F.col("origin")).when(F.col("symbols") > 0, "linked").otherwise("not-linked")
    return out.select("catalog", "item", status.alias("status"), F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"))
