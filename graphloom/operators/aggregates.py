"""Aggregations: coverage, coupling, inventories, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def coverage(status: Column) -> Column:
    """Percent documented, a partial item counting half; 100 for no items."""
    return F.coalesce(100 * F.avg(F.when(status == "documented", 1.0).when(status == "partial", 0.5).otherwise(0.0)), F.lit(100.0))


def quality(written: Column, flags: Column) -> Column:
    """Percent of written items without flags; 100 for none."""
    return F.coalesce(100 * F.avg(F.when(written, F.when(flags == 0, 1.0).otherwise(0.0))), F.lit(100.0))


def coverage_by(items: DataFrame, *keys: str) -> DataFrame:
    """items: status, written, flags (a number), by keys."""
    return items.groupBy(*keys).agg(
        F.count("*").alias("items"), coverage(F.col("status")).alias("coverage"), quality(F.col("written"), F.col("flags")).alias("quality"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("documented", "partial", "undocumented")],
    )


def fan_in(edges: DataFrame, implements: DataFrame) -> DataFrame:
    """(id, fan_in): distinct callers, those of an implemented interface included."""
    via = edges.join(implements.select(F.col("to_id"), F.col("from_id").alias("id")), "to_id").select("id", "from_id")
    return edges.select(F.col("to_id").alias("id"), "from_id").union(via).groupBy("id").agg(F.countDistinct("from_id").alias("fan_in"))


def layer_files(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("layer", F.lit("(none)")).alias("layer")).agg(F.countDistinct("file").alias("files"))


def layer_dependencies(edges: DataFrame, allowed: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges between layers (from_layer, to_layer) counted, a row for as many as its weight, with whether the allow list
    has the pair. A layer that the list doesn't name at all may use any."""
    n = F.count("*") if weight is None else F.sum(weight)
    counts = edges.where("from_layer IS NOT NULL AND to_layer IS NOT NULL AND from_layer != to_layer").groupBy("from_layer", "to_layer").agg(n.alias("edges"))
    pairs = allowed.select("from_layer", F.explode_outer("may").alias("to_layer")).withColumn("ok", F.lit(True))
    named = allowed.select("from_layer").distinct().withColumn("named", F.lit(True))
    out = counts.join(F.broadcast(pairs), ["from_layer", "to_layer"], "left").join(F.broadcast(named), "from_layer", "left")
    return out.select("from_layer", "to_layer", "edges", (F.col("ok").isNotNull() | F.col("named").isNull()).alias("allowed"))


def coupling(pairs: DataFrame) -> DataFrame:
    """Modules' fan-out and fan-in over distinct pairs of different modules (a, b), and instability out / (in + out)."""
    p = pairs.where("a != b").select("a", "b").distinct()
    out = p.groupBy(F.col("a").alias("module")).agg(F.count("*").alias("fan_out"))
    into = p.groupBy(F.col("b").alias("module")).agg(F.count("*").alias("fan_in"))
    both = out.join(into, "module", "full_outer").na.fill(0, ["fan_out", "fan_in"])
    return both.withColumn("instability", F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): each edge counts at both ends."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def entity_metrics(entities: DataFrame, links: DataFrame, weights: dict[str, str]) -> DataFrame:
    """entities (id), links (a, b, inheritance): degree, fan_in, fan_out, inheritance and their weighted decimal score.
    A self loop counts once as degree; the entities of the highest positive score are central."""
    ends = links.where("NOT inheritance").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    out = links.where("NOT inheritance").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("fan_out"))
    into = links.where("NOT inheritance").groupBy(F.col("b").alias("id")).agg(F.count("*").alias("fan_in"))
    inherit = links.where("inheritance").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy("id").agg(F.count("*").alias("inheritance"))
    names = ["degree", "fan_in", "fan_out", "inheritance"]
    m = entities
    for part in (ends, into, out, inherit):
        m = m.join(part, "id", "left")
    m = m.na.fill(0, names)
    score = sum((F.col(n) * F.lit(weights[n]).cast("decimal(10,4)") for n in names), F.lit(0).cast("decimal(10,4)"))
    m = m.withColumn("score", score.cast("decimal(38,6)")).withColumn("isolated", (F.col("degree") + F.col("inheritance")) == 0)
    top = m.agg(F.max("score").alias("top"))
    return m.join(F.broadcast(top)).withColumn("central", (F.col("score") == F.col("top")) & (F.col("top") > 0)).drop("top")  # top is one row


def inventory(uses: DataFrame) -> DataFrame:
    """(package, version, projects): uses of packages by declared version."""
    return uses.groupBy("package", "version").agg(F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"))


def version_conflicts(uses: DataFrame) -> DataFrame:
    return uses.groupBy("package").agg(F.countDistinct("version").alias("versions")).where("versions > 1")


def version_drift(uses: DataFrame) -> DataFrame:
    """Packages with two or more exact versions, and the highest."""
    exact = uses.where(S.is_exact_version(F.col("version"))).select("package", "version").distinct()
    return exact.groupBy("package").agg(F.count("*").alias("versions"), F.max_by("version", S.version_key(F.col("version"))).alias("target")).where("versions > 1")


def worst_change(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The kind of greatest rank of each key; order names kinds from least to greatest."""
    return changes.groupBy(*keys).agg(F.max_by("kind", F.array_position(F.array(*map(F.lit, order)), F.col("kind"))).alias("kind"))


def requirement_status(evidence: DataFrame, hashes: DataFrame) -> DataFrame:
    """Evidence (symbol, requirement, strength, ord, hash) to one row per pair: confirmed if any evidence is a
    commit's own work item, the newest order, and whether the symbol changed since."""
    out = evidence.groupBy("symbol", "requirement").agg(
        F.bool_or(F.col("strength") == "commit").alias("confirmed"), F.max("ord").alias("newest"), F.max_by("hash", "ord").alias("was"), F.count("*").alias("evidence"))
    out = out.join(hashes.select("symbol", F.col("hash").alias("now")), "symbol", "left")
    return out.select("symbol", "requirement", "confirmed", "newest", "evidence", (~F.col("was").eqNullSafe(F.col("now"))).alias("changed_since"))


def outcome(confirmed: Column, inferred: Column, verified: Column) -> Column:
    """What is known of a symbol's requirements. Verified emptiness differs from not knowing."""
    return F.when(confirmed == 1, "one").when(confirmed > 1, "several").when(inferred > 0, "inferred").when(verified, "none").otherwise("unknown")


def traceability(requirements: DataFrame, to_architecture: DataFrame, to_test: DataFrame) -> DataFrame:
    """Each requirement's status: no-architecture, no-test, partial (some architecture without a test) or linked.
    to_architecture: requirement, architecture; to_test: architecture, test."""
    tests = to_test.groupBy("architecture").agg(F.countDistinct("test").alias("tests"))
    per = to_architecture.select("requirement", "architecture").distinct().join(tests, "architecture", "left")
    per = per.groupBy("requirement").agg(F.count("*").alias("architectures"), F.count_if(F.coalesce("tests", F.lit(0)) > 0).alias("tested"))
    out = requirements.select("requirement").join(per, "requirement", "left").na.fill(0)
    status = F.when(F.col("architectures") == 0, "no-architecture").when(F.col("tested") == 0, "no-test").when(F.col("tested") < F.col("architectures"), "partial").otherwise("linked")
    return out.withColumn("status", status)


def traceability_gaps(architectures: DataFrame, tests: DataFrame, to_architecture: DataFrame, to_test: DataFrame) -> DataFrame:
    """(gap, id): architectures no requirement links, architectures without tests, tests of nothing."""
    a, t = architectures.select("architecture"), tests.select("test")
    parts = (("unlinked-architecture", a.join(to_architecture, "architecture", "left_anti")), ("untested-architecture", a.join(to_test, "architecture", "left_anti")), ("orphan-test", t.join(to_test, "test", "left_anti")))
    frames = [df.select(F.lit(gap).alias("gap"), df[df.columns[0]].cast("string").alias("id")) for gap, df in parts]
    return frames[0].union(frames[1]).union(frames[2])


def union_of_sets(df: DataFrame, key: str, values: str) -> DataFrame:
    """The sorted union of each key's arrays, comma-joined."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))), ",").alias(values))


def config_status(keys: DataFrame) -> DataFrame:
    """Status of configuration keys (key, defined, read): bound where a section above is read, else defined, read."""
    read = keys.where("read").select(F.col("key").alias("above"))
    parts = F.split("key", ":")
    each = keys.withColumn("above", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))))
    bound = each.where("above != key").join(read, "above", "left_semi").select("key").distinct().withColumn("bound", F.lit(True))
    status = F.when(F.col("defined") & F.col("read"), "used").when(F.col("defined") & F.col("bound"), "bound").when(F.col("defined"), "unread").otherwise("undefined")
    return keys.join(bound, "key", "left").select("key", status.alias("status"))


def disambiguated(df: DataFrame, name: str, extra: str) -> DataFrame:
    """Names that several rows have get the extra column in brackets."""
    n = F.count("*").over(Window.partitionBy(name))
    return df.withColumn("label", F.when(n > 1, F.concat(name, F.lit(" ("), F.col(extra), F.lit(")"))).otherwise(F.col(name)))


def role_counts(nodes: DataFrame, roles: dict[str, str]) -> DataFrame:
    """How many nodes have a role as their kind or among their tags."""
    sums = [F.count_if((F.col("kind") == tag) | F.coalesce(F.array_contains("tags", tag), F.lit(False))).alias(role) for role, tag in roles.items()]
    row = nodes.agg(*sums)
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, roles)), F.array(*[F.col(r) for r in roles]))).alias("role", "n"))


def gate(coverage: float, critical: int, violations: int, cycles: int, limits: dict[str, float]) -> list[str]:
    """The limits that a run misses, in words."""
    out = []
    if coverage < limits.get("min_coverage", 80):
        out.append("coverage")
    for name, n in (("critical", critical), ("violations", violations), ("cycles", cycles)):
        if n > limits.get(f"max_{name}", 0):
            out.append(name)
    return out


def folder_layers(nodes: DataFrame) -> DataFrame:
    """A folder's layer: that of its first node, in model order, that has one."""
    return nodes.where("layer IS NOT NULL").groupBy(S.folder(F.col("file")).alias("folder")).agg(F.min_by("layer", "ord").alias("layer"))


def most_complex(nodes: DataFrame, k: int = 20) -> DataFrame:
    return nodes.where("complexity > 1 AND kind != 'component'").orderBy(F.desc("complexity"), "ord").limit(k)


#: The sections of a release's notes, in order.
SECTIONS = ("breaking", "feature", "fix", "performance", "other")


def release_section(category: Column, breaking: Column) -> Column:
    """The section of a change: breaking ones first, then by category; all else is other."""
    return F.when(breaking, "breaking").when(category.isin(*SECTIONS[1:-1]), category).otherwise("other")


def search_index(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, ref) of all tables' rows (name, ref), to be sorted by name without case, then kind."""
    out = None
    for kind, df in tables.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name"), F.col("ref").cast("string").alias("ref"))
        out = rows if out is None else out.unionByName(rows)
    return out


def used_by(edges: DataFrame) -> DataFrame:
    """(id, used_by): distinct other users of a component."""
    return edges.where("from_id != to_id").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("used_by"))


def technologies(packages: DataFrame) -> DataFrame:
    """(label, version): each package's version in the first row (package, label, version, ord); one row per label."""
    first = packages.groupBy("package").agg(F.min_by(F.struct("label", "version"), "ord").alias("x"), F.min("ord").alias("ord")).select("x.*", "ord")
    return first.groupBy("label").agg(F.min_by("version", "ord").alias("version"))


def test_plans(cases: DataFrame, links: DataFrame) -> DataFrame:
    """(plan, cases, linked): distinct test cases (plan, case) of each plan, and those that a requirement is linked to."""
    on = links.select("case").distinct().withColumn("on", F.lit(True))
    return cases.select("plan", "case").distinct().join(on, "case", "left").groupBy("plan").agg(F.count("*").alias("cases"), F.count("on").alias("linked"))


def overlay_status(items: DataFrame, code: DataFrame, tests: DataFrame, assessed: DataFrame | None) -> DataFrame:
    """(item, code_status, test_status): linked, not-linked, and for tests not-assessed where nobody looked, or
    unavailable without any assessment. code, tests, assessed: item."""
    mark = lambda df, c: df.select("item").distinct().withColumn(c, F.lit(True))
    out = items.select("item").join(mark(code, "c"), "item", "left").join(mark(tests, "t"), "item", "left")
    out = out.withColumn("a", F.lit(None)) if assessed is None else out.join(mark(assessed, "a"), "item", "left")
    missing = "unavailable" if assessed is None else "not-assessed"
    test = F.when(F.col("t"), "linked").when(F.col("a"), "not-linked").otherwise(missing)
    return out.select("item", F.when(F.col("c"), "linked").otherwise("not-linked").alias("code_status"), test.alias("test_status"))


def file_evidence(evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """Evidence (file, symbol, requirement) that only names a file: no symbol of it is known."""
    return evidence.join(symbols.select("symbol"), "symbol", "left_anti").select("file", "requirement").distinct()


def description_totals(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(what, n): components (id, layer) per layer, and layer dependencies (allowed) that are allowed and not."""
    layers = components.groupBy(F.concat(F.lit("layer "), F.coalesce("layer", F.lit("(none)"))).alias("what")).agg(F.count("*").alias("n"))
    return layers.union(dependencies.groupBy(F.when(F.col("allowed"), "allowed").otherwise("not allowed")).agg(F.count("*")))


#: Documentation levels, in order.
LEVELS = ("none", "low", "medium", "high")


def diff_gate(diff: DataFrame, most_complex: int, require_tests: str | None = None) -> DataFrame:
    """One row: what a change introduces, and whether it passes. Rows of diff are of a kind: gaps count where critical,
    violations all, symbols where complexity is above most_complex, flags where they contradict the code (fact), and, if
    require_tests names a level, tests (added, tests, level) of new symbols of that level or above without a linked test."""
    k = F.col("kind")
    untested = F.lit(0).cast("long")
    if require_tests is not None:
        at_least = F.col("level").isin(*LEVELS[LEVELS.index(require_tests) :])
        untested = F.count_if((k == "test") & F.col("added") & (F.col("tests") == 0) & at_least)
    out = diff.agg(
        F.count_if((k == "gap") & F.col("critical")).alias("critical"), F.count_if(k == "violation").alias("violations"),
        F.count_if((k == "symbol") & (F.col("complexity") > most_complex)).alias("complex"), F.count_if((k == "flag") & F.col("fact")).alias("contradictions"),
        untested.alias("untested"),
    )
    return out.withColumn("ok", (F.col("critical") + F.col("violations") + F.col("complex") + F.col("contradictions") + F.col("untested")) == 0)


def domain_areas(methods: DataFrame, calls: DataFrame, implements: DataFrame) -> DataFrame:
    """(id, area, reason): methods (id, file, type) by folder; one in a folder that no other folder calls into, whose calls
    (from_id, to_id) reach exactly one other type, goes to that type's folder; an interface's method goes to its
    implementations' (from_id) area where they agree. Methods of tests (test, if there is such a column) don't count."""
    if "test" in methods.columns:
        methods = methods.where(~F.coalesce("test", F.lit(False)))
    m = methods.select("id", "type", S.folder(F.col("file")).alias("folder"))
    end = lambda p: m.select(F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"), F.col("folder").alias(f"{p}_folder"))
    c = calls.where("from_id != to_id").select("from_id", "to_id").distinct().join(end("from"), "from_id").join(end("to"), "to_id")
    inner = c.where("from_folder != to_folder").select(F.col("to_folder").alias("folder")).distinct()
    one = c.groupBy(F.col("from_id").alias("id")).agg(F.count_distinct("to_type").alias("types"), F.min("to_type").alias("to_type"), F.min_by("to_folder", "to_id").alias("to_folder"))
    moved = m.join(inner, "folder", "left_anti").join(one.where("types = 1"), "id").where("to_type != type").select("id", "to_folder", "to_type")
    area = m.join(moved, "id", "left").select("id", F.coalesce("to_folder", "folder").alias("area"), F.when(F.col("to_type").isNotNull(), F.concat(F.lit("delegates to "), "to_type")).otherwise("folder").alias("reason"))
    impl = implements.join(area.select(F.col("id").alias("from_id"), F.col("area").alias("theirs")), "from_id").join(m.select(F.col("id").alias("to_id")), "to_id")
    agreed = impl.groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("theirs").alias("n"), F.min("theirs").alias("theirs"), F.array_join(F.array_sort(F.collect_set("from_id")), ", ").alias("by")).where("n = 1")
    out = area.join(agreed, "id", "left")
    return out.select("id", F.coalesce("theirs", "area").alias("area"), F.when(F.col("by").isNotNull(), F.concat(F.lit("implemented by "), "by")).otherwise(F.col("reason")).alias("reason"))


def released(changes: DataFrame, pulls: DataFrame) -> DataFrame:
    """(release, section, source, ref): the notes' lines. Pull requests (release, id, category, breaking) own their commits: of
    the changes (release, sha, category, breaking, kind, pull) only those without one are listed, and no merges. A change's
    ref is the first 8 characters of its sha."""
    section = release_section(F.col("category"), F.coalesce("breaking", F.lit(False))).alias("section")
    own = changes.where("pull IS NULL AND NOT (kind <=> 'merge')").select("release", section, F.lit("change").alias("source"), F.left(F.col("sha").cast("string"), F.lit(8)).alias("ref"))
    return pulls.select("release", section, F.lit("pull").alias("source"), F.col("id").cast("string").alias("ref")).union(own)
