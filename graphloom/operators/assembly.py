"""Assembling a model from scans: unions, first-wins rows, links between files, calls and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import longest_prefix


def merge_hashes(nodes: DataFrame, side: Column | None = None) -> DataFrame:
    """Rows that share an id (and side) get the hash of their sorted hashes, if any has one."""
    w = Window.partitionBy("id", *([side] if side is not None else []))
    hashes = F.collect_list(F.coalesce("hash", F.lit(""))).over(w)
    known = F.max(F.col("hash").isNotNull()).over(w)
    return nodes.withColumn("hash", F.when((F.count("*").over(w) > 1) & known, S.short_hash(hashes)).otherwise(F.col("hash")))


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("first_rank", F.row_number().over(w)).where("first_rank = 1").drop("first_rank")


def last_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return first_by(df, keys, *[F.desc(c) for c in order])


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """First row per id, production before test code. Needs is_test and ord."""
    return first_by(nodes, ["id"], "is_test", "ord")


def defined_over_read(defined: DataFrame, read: DataFrame, key: str = "id") -> DataFrame:
    """Definitions, and reads of what nobody defines."""
    return defined.unionByName(read.join(defined.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def link_by_key(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with key: to_id becomes the first target of that key (targets: key, id, ord), else stays."""
    first = first_by(targets, ["key"], "ord").select("key", F.col("id").alias("hit"))
    return edges.join(first, "key", "left").withColumn("to_id", F.coalesce("hit", "to_id")).drop("hit", "key")


def link_names(edges: DataFrame, named: DataFrame) -> DataFrame:
    """Edges to a name: the node of that full name, else the only node of that bare name; edges without either go.
    named: id, full, bare."""
    full = named.groupBy("full").agg(F.min("id").alias("by_full")).withColumnRenamed("full", "name")
    bare = named.groupBy("bare").agg(F.count("*").alias("n"), F.min("id").alias("by_bare")).where("n = 1").select(F.col("bare").alias("name"), "by_bare")
    out = edges.join(full, "name", "left").join(bare, "name", "left").withColumn("to_id", F.coalesce("by_full", "by_bare"))
    return out.where("to_id IS NOT NULL").drop("by_full", "by_bare")


def collapse_tests(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test nodes go; their uses of production code become edges of kind tests, other edges that touch them go."""
    t = tests.select(F.col("id").alias("test")).distinct()
    e = edges.join(t.withColumnRenamed("test", "from_id").withColumn("from_test", F.lit(True)), "from_id", "left")
    e = e.join(t.withColumnRenamed("test", "to_id").withColumn("to_test", F.lit(True)), "to_id", "left")
    use = F.col("kind").isin("calls", "creates", "imports", "renders", "injects", "http")
    e = e.where(F.col("to_test").isNull() & (F.col("from_test").isNull() | use)).withColumn("kind", F.when(F.col("from_test"), "tests").otherwise(F.col("kind")))
    return nodes.join(t.withColumnRenamed("test", "id"), "id", "left_anti"), e.select("from_id", "to_id", "kind", "label").distinct()


#: Languages by file ending.
LANGUAGES = {"cs": "csharp", "java": "java", "php": "php", "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "vue": "vue", "sql": "sql", "yml": "yaml", "yaml": "yaml", "json": "json", "xml": "xml"}


def language(file: Column) -> Column:
    ending = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        out = F.when(ending == k, v).otherwise(out)
    return F.when(F.lower(file).endswith("dockerfile"), "dockerfile").otherwise(out)


def owning_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each file with the project of the longest folder that holds it. projects: project, prefix, ord."""
    return longest_prefix(files, projects, "file", "prefix")


def external_hosts(edges: DataFrame) -> DataFrame:
    """Edges from whoever calls an absolute URL to ext:http:<host>."""
    h = S.host(F.regexp_extract("to_id", r"^http:[A-Z]+ (.*)$", 1))
    return edges.where("kind = 'http'").withColumn("host", h).where("host IS NOT NULL").select("from_id", F.concat(F.lit("ext:http:"), F.col("host")).alias("to_id"), F.lit("connects").alias("kind"), F.lit("detected").alias("label")).distinct()


def only_candidate(asking: DataFrame, candidates: DataFrame, local: list[str]) -> DataFrame:
    """For each asking id: its one candidate on its own keys, else the one there is at all, else none.
    Returns id, target, certainty (inferred or unknown)."""
    one = lambda g: g.agg(F.count("*").alias("n"), F.min("target").alias("target"))
    own = one(candidates.groupBy(*local)).withColumnsRenamed({"n": "own_n", "target": "own"})
    every = one(candidates).withColumnsRenamed({"n": "all_n", "target": "any"})
    out = asking.join(own, local, "left").join(F.broadcast(every))  # every is one row
    hit = F.when(F.col("own_n") == 1, F.col("own")).when(F.col("own_n").isNull() & (F.col("all_n") == 1), F.col("any"))
    return out.select("id", F.coalesce(hit, F.lit("ext:database")).alias("target"), F.when(hit.isNotNull(), "inferred").otherwise("unknown").alias("certainty"))


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Deferred calls (from_id, type, method, arity) against methods (id, type, method, arity): the only one of
    that arity, else the only one of that name, else an access to the type."""
    by = lambda *k: methods.groupBy(*k).agg(F.count("*").alias("n"), F.min("id").alias("hit")).where("n = 1").drop("n")
    out = calls.join(by("type", "method", "arity").withColumnRenamed("hit", "exact"), ["type", "method", "arity"], "left")
    out = out.join(by("type", "method").withColumnRenamed("hit", "named"), ["type", "method"], "left")
    hit = F.coalesce("exact", "named")
    return out.select("from_id", F.coalesce(hit, "type").alias("to_id"), F.when(hit.isNull(), "accesses").otherwise("calls").alias("kind"))


def implementing_methods(methods: DataFrame, implements: DataFrame) -> DataFrame:
    """Interface methods with the first method of that name and arity on each implementing type."""
    i = methods.alias("i").join(implements.alias("x"), F.col("i.type") == F.col("x.to_id")).join(methods.alias("m"), (F.col("m.type") == F.col("x.from_id")) & (F.col("m.method") == F.col("i.method")) & (F.col("m.arity") == F.col("i.arity")))
    return first_by(i.select(F.col("i.id").alias("interface"), F.col("m.type").alias("type"), F.col("m.id").alias("id"), F.col("m.ord").alias("ord")), ["interface", "type"], "ord")


def classify_imports(imports: DataFrame, types: DataFrame, own: list[str], platform: list[str]) -> DataFrame:
    """Imports (from_id, name, bare): of a known type: imports; of a foreign namespace: uses-namespace; own and
    platform namespaces without a type go."""
    known = first_by(types, ["bare"], "ord").select("bare", F.col("id").alias("hit"))
    out = imports.join(known, "bare", "left")
    drop = F.lit(False)
    for p in [*own, *platform]:
        drop = drop | (F.col("name") == p) | F.col("name").startswith(p + ".")
    return out.where(F.col("hit").isNotNull() | ~drop).select("from_id", F.coalesce("hit", F.concat(F.lit("ns:"), "name")).alias("to_id"), F.when(F.col("hit").isNotNull(), "imports").otherwise("uses-namespace").alias("kind"))


def complete_references(projects: DataFrame, edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Referenced projects that are known but not in scope come in as stubs; references to unknown ones go."""
    need = edges.where("kind = 'references'").select(F.col("to_id").alias("id")).distinct()
    stubs = need.join(projects, "id", "left_anti").join(known, "id").withColumn("stub", F.lit(True))
    every = projects.withColumn("stub", F.lit(False)).unionByName(stubs, allowMissingColumns=True)
    ends = every.select(F.col("id").alias("to_id"))
    return every, edges.where("kind != 'references'").unionByName(edges.where("kind = 'references'").join(ends, "to_id", "left_semi").select(edges.columns))


def fingerprint(parts: Column) -> Column:
    """16 hex digits of SHA-256 over sorted lines."""
    return F.substring(F.sha2(F.array_join(F.array_sort(parts), "\n"), 256), 1, 16)


def merge_history(previous: DataFrame, update: DataFrame, key: str = "sha") -> DataFrame:
    """The update's rows and the previous rows of other keys."""
    return update.unionByName(previous.join(update.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def missing_reason(references: DataFrame, parsed: DataFrame, scanned: DataFrame, present: DataFrame) -> DataFrame:
    """References (from_id, path) that don't resolve, with why: not-parsed, not-scanned, not-found or outside-root."""
    mark = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    out = references.join(mark(parsed, "p"), "path", "left").join(mark(scanned, "s"), "path", "left").join(mark(present, "f"), "path", "left")
    why = F.when(F.col("path").startswith("../"), "outside-root").when(F.col("s"), "not-parsed").when(F.col("f"), "not-scanned").otherwise("not-found")
    return out.where("p IS NULL").select("from_id", "path", why.alias("reason"))


def test_files(files: DataFrame, globs: list[str], projects: DataFrame) -> DataFrame:
    """files with is_test: the path matches a glob, or the owning project is tagged test. projects: project, prefix, ord, tags."""
    owned = longest_prefix(files, projects, "file", "prefix")
    tagged = F.coalesce(F.array_contains("tags", "test"), F.lit(False))
    return owned.select("file", (S.any_glob(F.col("file"), globs) | tagged).alias("is_test"))


def inferred_externals(depends: DataFrame, known: DataFrame, externals: DataFrame) -> DataFrame:
    """Projects whose package (depends: project, package) points to a known system (known: package, system) that no
    external (id) shows yet: project, to_id, certainty."""
    hit = depends.join(known, "package").select("project", F.concat(F.lit("ext:"), "system").alias("to_id")).distinct()
    return hit.join(externals.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("project", "to_id", F.lit("inferred").alias("certainty"))


def orphan_externals(externals: DataFrame, connects: DataFrame, projects: DataFrame) -> DataFrame:
    """Externals (id, file) that nothing connects to, with the project that owns their file: from_id, to_id."""
    alone = externals.join(connects.select(F.col("to_id").alias("id")), "id", "left_anti")
    return longest_prefix(alone, projects, "file", "prefix").where("project IS NOT NULL").select(F.col("project").alias("from_id"), F.col("id").alias("to_id"))


def link_config(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """Edges from file:<path> start at the project that owns the file, or go; other edges stay."""
    reads = edges.where(F.col("from_id").startswith("file:")).withColumn("file", F.substring("from_id", 6, 1 << 20))
    owned = longest_prefix(reads, projects, "file", "prefix").where("project IS NOT NULL")
    return edges.where(~F.col("from_id").startswith("file:")).unionByName(owned.withColumn("from_id", F.col("project")).select(edges.columns))


def owners_by_language(files: DataFrame, projects: DataFrame, endings: dict[str, list[str]]) -> DataFrame:
    """(file, project): the longest folder that holds the file; a project at the root only owns files with an ending of
    its ecosystem. projects: project, prefix, ecosystem, ord."""
    below = longest_prefix(files, projects.where("prefix != ''"), "file", "prefix").select("file", F.col("project").alias("near"))
    table = files.sparkSession.createDataFrame([(e, x) for e, xs in endings.items() for x in xs], "ecosystem string, ending string")
    root = first_by(projects.where("prefix = ''").join(F.broadcast(table), "ecosystem"), ["ending"], "ord").select("ending", F.col("project").alias("top"))
    ending = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    return below.withColumn("ending", ending).join(root, "ending", "left").select("file", F.coalesce("near", "top").alias("project"))


def tag_targets(nodes: DataFrame, edges: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Nodes with their tags and those that edges of a kind give their targets (persists: entity, hosts: hosted)."""
    kinds = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    given = edges.where(F.col("kind").isin(*tags)).groupBy(F.col("to_id").alias("id")).agg(F.collect_set(kinds[F.col("kind")]).alias("given"))
    none = F.array().cast("array<string>")
    return nodes.join(given, "id", "left").withColumn("tags", F.array_union(F.coalesce("tags", none), F.array_sort(F.coalesce("given", none)))).drop("given")
