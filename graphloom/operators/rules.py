"""Composite rules: documentation need, architecture, security, differences, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALLOW, FRAMEWORKS, MUTATING, SEVERITY, Architecture, Selector
from ..functions import scalars as S
from .assembly import first_by
from .graph import layer_via, strong_components
from .joins import row_diff
from .windows import top_with_rest


def with_layer(nodes: DataFrame, layers: dict[str, list[str]]) -> DataFrame:
    """The first layer that a node's file matches; matched once per file."""
    files = nodes.select("file").distinct().withColumn("layer", S.first_match(F.col("file"), layers))
    return nodes.join(files, "file", "left")


def need_score(n: DataFrame) -> DataFrame:
    """Documentation need of nodes (visibility, complexity, params, fan_in, effects, is_type): score, level and
    the reasons in order. Items below medium are dropped by callers, before coverage is taken."""
    c, params, callers = (F.coalesce(x, F.lit(0)) for x in ("complexity", "params", "fan_in"))
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    parts = [
        (F.coalesce(F.col("visibility").isin("public", "protected"), F.lit(False)), F.lit(2), F.col("visibility")),
        (c >= 4, F.when(c >= 15, 3).when(c >= 8, 2).otherwise(1), say("complexity ", c)),
        (params >= 4, F.lit(1), say(params, " params")),
        (callers >= 3, F.lit(1), say(callers, " callers")),
        ((F.coalesce("effects", F.lit(0)) > 0) & ~F.col("is_type"), F.lit(1), F.lit("side effects")),
    ]
    score = sum((F.when(cond, pts).otherwise(0) for cond, pts, _ in parts), F.lit(0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(cond, why) for cond, _, why in parts])), ", ")
    out = n.withColumn("score", score).withColumn("reasons", reasons)
    return out.withColumn("level", F.when(F.col("score") >= 6, "high").when(F.col("score") >= 4, "medium").when(F.col("score") >= 1, "low").otherwise("none"))


def doc_status(required: Column, written: Column) -> Column:
    """documented, partial or undocumented, from arrays of section names."""
    missing = F.size(F.array_except(required, written))
    return F.when(missing == 0, "documented").when(missing < F.size(F.array_distinct(required)), "partial").otherwise("undocumented")


def inherited_docs(nodes: DataFrame, implements: DataFrame) -> DataFrame:
    """Nodes without a doc take that of the first implemented interface that has one."""
    docs = implements.join(nodes.select(F.col("id").alias("to_id"), F.col("doc").alias("theirs")), "to_id").where("theirs IS NOT NULL")
    best = docs.groupBy(F.col("from_id").alias("id")).agg(F.min_by("theirs", "ord").alias("theirs"))
    return nodes.join(best, "id", "left").withColumn("doc", F.coalesce("doc", "theirs")).drop("theirs")


def _pairs(allow: dict[str, list[str]], layers) -> list[tuple[str, str, str | None]]:
    """Forbidden pairs of layers, with the layer by which the target may be reached."""
    return [(a, b, layer_via(allow, a, b)) for a in allow for b in [*layers, "http"] if a != b and b not in allow[a]]


def layer_violations(edges: DataFrame, allow: dict[str, list[str]] = ALLOW, severity: dict[str, str] = SEVERITY) -> DataFrame:
    """Edges (from_layer, to_layer, from_file, to_key, kind, ord) that their layers don't allow.

    ARCH-002: a layer calls http itself; ARCH-004: the target is allowed over another layer, which is named;
    ARCH-001: else. One row per rule, file and target: the first edge.
    """
    layers = sorted({*allow, *(b for v in allow.values() for b in v if b != "http")})
    rows = _pairs(allow, layers)
    table = edges.sparkSession.createDataFrame(rows or [("", "", None)], "from_layer string, to_layer string, via string")
    target = F.when(F.col("kind") == "http", "http").otherwise(F.col("to_layer"))
    bad = edges.withColumn("to_layer", target).join(F.broadcast(table), ["from_layer", "to_layer"])
    rule = F.when(F.col("to_layer") == "http", "ARCH-002").when(F.col("via").isNotNull(), "ARCH-004").otherwise("ARCH-001")
    bad = bad.withColumn("rule", rule)
    sev = F.lit("medium")
    for r, s in severity.items():
        sev = F.when(F.col("rule") == r, s).otherwise(sev)
    out = first_by(bad, ["rule", "from_file", "to_key"], "ord")
    return out.select("rule", sev.alias("severity"), "from_layer", "to_layer", "from_file", "to_key", "via", "ord")


def folder_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, members): folders that depend on each other, http edges aside."""
    at = nodes.select("id", S.folder(F.col("file")).alias("folder"))
    e = edges.where("kind != 'http'").join(at.withColumnsRenamed({"id": "from_id", "folder": "src"}), "from_id").join(at.withColumnsRenamed({"id": "to_id", "folder": "dst"}), "to_id")
    return strong_components(e.select("src", "dst")).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("members"))


def selected(s: Selector, p: str = "") -> Column:
    """Whether a row (layer, file, kinds, all_tags, names: those of the symbol and its containers) is selected."""
    out = F.lit(True)
    if s.layer:
        out = out & (F.col(f"{p}layer") == s.layer)
    if s.path:
        out = out & S.glob_match(F.col(f"{p}file"), s.path)
    for value, column in ((s.kind, "kinds"), (s.tag, "all_tags"), (s.name, "names")):
        if value:
            out = out & _any(F.col(f"{p}{column}"), value)
    return F.coalesce(out, F.lit(False))


def _any(values: Column, glob: str) -> Column:
    return F.exists(values, lambda x: S.glob_match(x, glob))


def custom_violations(edges: DataFrame, config: Architecture) -> DataFrame:
    """Edges (from_ and to_ columns as of selected(), kind, to_namespace, to_key, ord) that custom rules forbid.
    Rules are configuration: one plan branch each."""
    out = None
    for r in config.rules:
        bad = selected(r.source, "from_")
        if r.to:
            bad = bad & selected(r.to, "to_")
        if r.packages:
            hit = F.lit(False)
            for p in r.packages:
                hit = hit | F.coalesce(S.in_package(F.col("to_namespace"), F.lit(p)), F.lit(False))
            bad = bad & hit
        if r.kinds:
            bad = bad & F.col("kind").isin(*r.kinds)
        if r.exceptions:
            bad = bad & ~selected(r.exceptions, "from_")
        rows = first_by(edges.where(bad), ["from_file", "to_key"], "ord").select(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), "from_file", "to_key")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else edges.select(F.lit("").alias("rule"), F.lit("").alias("severity"), "from_file", "to_key").limit(0)


def endpoint_auth(endpoints: DataFrame) -> DataFrame:
    """SEC-002: a mutating endpoint that doesn't require authorization, anonymous ones too; SEC-001: another one that
    declares neither. endpoints: id, verb, auth (authorize, anonymous or none)."""
    rule = F.when(F.col("verb").isin(*MUTATING) & (F.col("auth") != "authorize"), "SEC-002").when(~F.col("verb").isin(*MUTATING) & (F.col("auth") == "none"), "SEC-001")
    return endpoints.select(rule.alias("rule"), "id").where("rule IS NOT NULL")


def direct_store_access(edges: DataFrame, layers: DataFrame, stores: DataFrame) -> DataFrame:
    """SEC-003: an api node that uses a store itself."""
    api = layers.where("layer = 'api'").select(F.col("id").alias("from_id"))
    return edges.join(api, "from_id", "left_semi").join(stores.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.lit("SEC-003").alias("rule"), F.col("from_id").alias("id"), "to_id").distinct()


def framework_coupling(uses: DataFrame, prefixes: tuple[str, ...] = FRAMEWORKS) -> DataFrame:
    """SEC-004: a domain node that uses a framework namespace. uses: id, layer, namespace."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (F.col("namespace") == p) | F.col("namespace").startswith(p + ".")
    return uses.where((F.col("layer") == "domain") & hit).select(F.lit("SEC-004").alias("rule"), "id", "namespace").distinct()


def sensitive_reach(trace: DataFrame, open_starts: DataFrame, sensitive: DataFrame) -> DataFrame:
    """SEC-005: unprotected starts that reach a sensitive node, at the least depth."""
    hit = trace.join(open_starts.select("start"), "start", "left_semi").join(sensitive.select("node"), "node", "left_semi")
    return hit.groupBy("start", "node").agg(F.min("depth").alias("depth")).select(F.lit("SEC-005").alias("rule"), "start", "node", "depth")


def module_observations(modules: DataFrame) -> DataFrame:
    """(module, observation) of modules (module, fan_out, complexity, docs): wide use, complexity, no docs."""
    rows = F.array_compact(F.array(F.when(F.col("fan_out") >= 10, "depends on many"), F.when(F.col("complexity") >= 15, "complex"), F.when(F.col("docs") == 0, "undocumented")))
    return modules.select("module", F.explode(rows).alias("observation"))


def contract_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, part): parameters (in order), returns, throws (in any order) and route that differ."""
    j = before.alias("b").join(after.alias("a"), "id")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    throws = ~F.array_sort(F.col("a.throws")).eqNullSafe(F.array_sort(F.col("b.throws")))
    rows = F.array_compact(F.array(F.when(differs("parameters"), "parameters"), F.when(differs("returns"), "returns"), F.when(throws, "throws"), F.when(differs("route"), "route")))
    return j.select("id", F.explode(rows).alias("part"))


def stale_docs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids whose code changed while the doc's text (white space aside) did not. Columns: id, hash, doc."""
    body = lambda c: F.btrim(F.regexp_replace(F.col(c), r"\s+", " "))
    j = before.alias("b").join(after.alias("a"), "id").where("b.doc IS NOT NULL")
    return j.where(~F.col("a.hash").eqNullSafe(F.col("b.hash")) & body("a.doc").eqNullSafe(body("b.doc"))).select("id")


def snapshot_diff(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Differences of two snapshots with tables nodes (id, hash), edges, gaps (id), violations (rule, from_file, to_key)."""
    new = lambda name, keys: after[name].select(*keys).distinct().join(before[name].select(*keys).distinct(), keys, "left_anti")
    gone = lambda name, keys: before[name].select(*keys).distinct().join(after[name].select(*keys).distinct(), keys, "left_anti")
    ends = ["from_id", "to_id", "kind"]
    return {
        "symbols": row_diff(before["nodes"], after["nodes"], "id", "hash"),
        "edges": new("edges", ends).withColumn("change", F.lit("added")).union(gone("edges", ends).withColumn("change", F.lit("removed"))),
        "gaps": new("gaps", ["id"]),
        "violations": new("violations", ["rule", "from_file", "to_key"]),
    }


def decision_candidates(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """New externals or layer pairs (key) that may deserve a decision record."""
    return after.select("key").distinct().join(before.select("key").distinct(), "key", "left_anti").select(F.lit(kind).alias("kind"), "key")


def source_freshness(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence (id, source, source_hash) against files (source, hash): missing, unverified, current or stale."""
    j = evidence.join(files.withColumn("there", F.lit(True)), "source", "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("source_hash").isNull(), "unverified").when(F.col("source_hash") == F.col("hash"), "current").otherwise("stale")
    return j.select("id", "source", status.alias("status"))


def package_impact(uses: DataFrame, closure: DataFrame) -> DataFrame:
    """(package, project, direct): projects that use a package, and those that reference them. closure: src, dst."""
    direct = uses.select("package", "project").distinct()
    up = direct.join(closure.select(F.col("dst").alias("project"), F.col("src").alias("user")), "project").select("package", F.col("user").alias("project"))
    return direct.withColumn("direct", F.lit(True)).union(up.withColumn("direct", F.lit(False))).groupBy("package", "project").agg(F.bool_or("direct").alias("direct"))


def change_plan(uses: DataFrame, target: Column) -> DataFrame:
    """What to do for each use (package, project, version) to reach the target version."""
    kind = S.change_kind(F.col("version"), target)
    action = F.when(~S.is_exact_version(F.col("version")), "review").when(kind == "same", "keep").when(kind == "unknown", "review").otherwise("update")
    return uses.select("package", "project", "version", target.alias("target"), kind.alias("kind"), action.alias("action"))


def number_checks(statements: DataFrame, code: DataFrame) -> DataFrame:
    """Statements (key, text) and code (key, body): numbers stated that the code lacks, as a count, and whether any meets."""
    j = statements.join(code, "key")
    said, there = S.stated_numbers(F.col("text")), S.numbers(F.col("body"))
    plain = S.numbers(F.col("text"))
    return j.select("key", F.size(F.array_distinct(plain)).alias("stated"), F.coalesce(F.arrays_overlap(said, there), F.lit(False)).alias("meets"))


#: Fixed value: texts that read like instructions to a model.
INSTRUCTIONS = r"(?i)\b(ignore (all |the )?(previous|above)|disregard|system prompt|you are (now )?an?|act as|new instructions)\b"


def product_checks(sections: DataFrame, evidence: DataFrame, statements: DataFrame, files: DataFrame, drafted: DataFrame, cited: DataFrame) -> DataFrame:
    """(code, section, what) of product evidence. PROD-001: a required section (section, required) without evidence (section,
    ord, id, text, source); PROD-002: a statement (section, source, text) whose source isn't among files (source); PROD-004:
    a section whose evidence, in order, differs from what was drafted (as evidence); PROD-005: a statement that reads
    like an instruction; PROD-006: a citation (section, id) of what isn't the section's drafted evidence."""
    none = F.lit(None).cast("string")
    code = lambda df, c, what=none: df.select(F.lit(c).alias("code"), F.col("section"), what.alias("what"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "text", "source"))), lambda x: F.concat_ws("|", x["id"], x["text"], x["source"]))
    told = lambda df, c: df.groupBy("section").agg(line.alias(c))
    both = sections.select("section").join(told(evidence, "now"), "section", "left").join(told(drafted, "was"), "section", "left")
    changed = both.where(~F.col("now").eqNullSafe(F.col("was")))
    return (
        code(sections.where("required").join(evidence, "section", "left_anti"), "PROD-001")
        .union(code(statements.join(files.select("source"), "source", "left_anti"), "PROD-002", F.col("source")))
        .union(code(changed, "PROD-004"))
        .union(code(statements.where(F.col("text").rlike(INSTRUCTIONS)), "PROD-005", F.col("source")))
        .union(code(cited.distinct().join(drafted, ["section", "id"], "left_anti"), "PROD-006", F.col("id")))
    )


def missing_drafts(depends: DataFrame, drafts: DataFrame) -> DataFrame:
    """PROD-003: products (product, on) that another depends on and that have no draft (product)."""
    return depends.join(drafts.select(F.col("product").alias("on")), "on", "left_anti").select(F.lit("PROD-003").alias("code"), "product", "on")


def coverage_warnings(histories: DataFrame) -> DataFrame:
    """(repo, warning): what a history (repo, end, head, truncated, shallow) doesn't cover: commits after its end (ids agree
    where one begins with the other), older ones where it was cut or shallow."""
    differ = ~(F.col("end").startswith(F.col("head")) | F.col("head").startswith(F.col("end")))
    rows = F.array_compact(F.array(F.when(differ, "later commits"), F.when(F.col("truncated"), "truncated"), F.when(F.col("shallow"), "shallow")))
    return histories.select("repo", F.explode(rows).alias("warning"))


def applying_sections(nodes: DataFrame, sections: list[str]) -> DataFrame:
    """(id, section): the documentation sections that apply to a node (params, returns, throws, endpoints, state, events)."""
    given = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rule = {"param": F.col("params") > 0, "returns": F.col("returns").isNotNull(), "exception": F.col("throws").isNotNull(), "endpoint": F.col("endpoints") > 0, "state": given("state"), "events": given("events")}
    for other, same in (("input", "param"), ("output", "returns"), ("authorization", "endpoint")):
        rule[other] = rule[same]
    rows = F.array_compact(F.array(*[F.when(rule.get(s, F.lit(True)), s) for s in sections]))
    return nodes.select("id", F.explode(rows).alias("section"))


def first_pattern(nodes: DataFrame, patterns: list[tuple[str, dict[str, str]]], default: str) -> DataFrame:
    """nodes with pattern: the first whose globs match all the columns that it names; a tag glob matches any tag."""
    out = F.lit(default)
    for name, globs in reversed(patterns):
        hit = F.lit(True)
        for c, g in globs.items():
            hit = hit & (_any(F.coalesce(c, F.array().cast("array<string>")), g) if c == "tags" else S.glob_match(F.col(c), g))
        out = F.when(hit, name).otherwise(out)
    return nodes.withColumn("pattern", out)


def critical_gaps(findings: DataFrame) -> DataFrame:
    """Undocumented nodes of high need."""
    return findings.where("level = 'high' AND status = 'undocumented'")


def requirement_answers(asked: DataFrame, evidence: DataFrame, renamed: DataFrame, most: int = 10) -> DataFrame:
    """(asked, symbol, requirement, rank, more): each asked symbol's requirements, confirmed first, then newest, at most so
    many. A symbol without evidence (symbol, requirement, confirmed, ord) is answered by its former id (renamed: id, was)."""
    known = evidence.select(F.col("symbol").alias("asked")).distinct()
    own = asked.select("asked").distinct().join(known, "asked", "left_semi").select("asked", F.col("asked").alias("symbol"))
    old = asked.select("asked").distinct().join(known, "asked", "left_anti").join(renamed.select(F.col("id").alias("asked"), F.col("was").alias("symbol")), "asked")
    per = evidence.groupBy("symbol", "requirement").agg(F.bool_or("confirmed").alias("confirmed"), F.max("ord").alias("newest"))
    return top_with_rest(own.union(old).join(per, "symbol"), ["asked"], most, F.desc("confirmed"), F.desc("newest"), "requirement").select("asked", "symbol", "requirement", "rank", "more")
