"""Projects, scope, requirements of symbols, guides and design risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .assembly import first_by, owning_project
from .graph import closure


def scope(projects: DataFrame, references: DataFrame, include: list[str], follow: str = "metadata") -> DataFrame:
    """(project, role): included ones by glob, and what they reference: as metadata stubs, included, or left out.
    references: src, dst."""
    inside = projects.where(S.any_glob(F.col("project"), include)).select("project").distinct()
    if follow == "exclude":
        return inside.withColumn("role", F.lit("included"))
    down = closure(references, inside.select(F.col("project").alias("src"))).select(F.col("dst").alias("project")).distinct()
    more = down.join(inside, "project", "left_anti").join(projects.select("project").distinct(), "project", "left_semi")
    return inside.withColumn("role", F.lit("included")).union(more.withColumn("role", F.lit("included" if follow == "include" else "stub")))


def shared_folders(owned: DataFrame, inside: DataFrame) -> DataFrame:
    """Folders whose files belong to projects both in and out of scope: they come whole or not at all. owned: project, folder."""
    mark = owned.join(inside.select("project").withColumn("in", F.lit(True)), "project", "left").withColumn("in", F.coalesce("in", F.lit(False)))
    return mark.groupBy("folder").agg(F.bool_or("in").alias("some"), F.bool_and("in").alias("all")).where("some AND NOT all").select("folder")


def might_belong(path: Column, folders: list[str]) -> Column:
    """Whether a historical path can be of the scope: under one of its folders, or a manifest above them."""
    out = path.rlike(r"\.(?:csproj|sln|slnx|props)$|(?:^|/)(?:package\.json|pom\.xml|build\.gradle(?:\.kts)?)$")
    for f in folders:
        out = out | S.under(path, f)
    return out


def hierarchy(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project: files, modules (folders) and symbols; the row without a project holds what no project owns."""
    files = owning_project(nodes.select("file").distinct(), projects.select("prefix", "project", "ord"))
    own = nodes.join(files.select("file", "project"), "file")
    return own.groupBy("project").agg(F.countDistinct("file").alias("files"), F.countDistinct(S.folder(F.col("file"))).alias("modules"), F.count("*").alias("symbols"))


def renamed_from(touches: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, was): one hop of a rename: in one commit and file a symbol ends that has the owner, kind, arguments and
    line of one that begins. touches: id, owner, args, kind, file, line, order; existing: id."""
    w = Window.partitionBy("id")
    t = touches.withColumn("first", F.min("order").over(w)).withColumn("last", F.max("order").over(w))
    same = ["file", "owner", "args", "kind", "line"]
    ends = t.where("order = last").join(existing.select("id"), "id", "left_anti").select(F.struct(F.col("order").alias("till"), F.col("id").alias("was")).alias("end"), *same)
    # each end with the one before it, for a symbol that would be followed by itself
    ends = ends.withColumn("end", F.struct("end.*", F.lag("end").over(Window.partitionBy(*same).orderBy("end.till", "end.was")).alias("other")))
    begins = t.where("order = first").select("id", F.col("order").alias("at"), *same)
    rows = begins.withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)).unionByName(ends.withColumns({"id": F.lit(None), "at": F.col("end.till")}))
    asof = Window.partitionBy(*same).orderBy("at", F.col("id").isNotNull(), "end.was").rowsBetween(Window.unboundedPreceding, 0)
    hit = rows.withColumn("hit", F.last("end", ignorenulls=True).over(asof)).where("id IS NOT NULL AND hit IS NOT NULL")
    best = F.when(F.col("hit.was") != F.col("id"), F.struct("hit.till", "hit.was")).otherwise(F.col("hit.other"))
    return hit.select("id", best.alias("best")).where("best IS NOT NULL").groupBy("id").agg(F.max("best")["was"].alias("was"))


def symbols_of_requirements(touches: DataFrame, items: DataFrame) -> DataFrame:
    """(requirement, symbol, commits): all symbols of all requirements in one pass. touches: symbol, sha; items: sha, requirement."""
    return touches.join(items, "sha").groupBy("requirement", "symbol").agg(F.countDistinct("sha").alias("commits"))


def requirements_of_symbols(symbols: DataFrame, touches: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(symbol, requirement, commits, more): at most so many requirements per symbol, most commits first."""
    r = symbols_of_requirements(touches, items).join(symbols.select("symbol"), "symbol", "left_semi")
    w = Window.partitionBy("symbol")
    out = r.withColumn("rank", F.row_number().over(w.orderBy(F.desc("commits"), "requirement"))).withColumn("more", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return out.where(F.col("rank") <= most).select("symbol", "requirement", "commits", "more")


def stale_guides(guides: DataFrame, routes: DataFrame, items: DataFrame) -> DataFrame:
    """(guide, reason): guides (guide, route, code_hash, item, item_changed) whose route went, code changed or work item changed."""
    j = guides.join(routes.select("route", F.col("code_hash").alias("now")), "route", "left").join(items.select("item", F.col("changed").alias("item_now")), "item", "left")
    reason = F.when(F.col("now").isNull(), "route is gone").when(F.col("now") != F.col("code_hash"), "code changed").when(S.later_than(F.col("item_now"), F.col("item_changed")), "work item changed")
    return j.select("guide", reason.alias("reason")).where("reason IS NOT NULL")


def design_risks(endpoints: DataFrame, entities: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(risk, id): endpoints (id, returns, complexity) that return an entity (name) or hold logic; domain namespaces
    (id, namespace) named after technology."""
    words = endpoints.select("id", F.explode(F.array_distinct(F.regexp_extract_all("returns", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    exposed = words.join(entities.select("name").distinct(), "name", "left_semi").select(F.lit("entity-exposed").alias("risk"), "id").distinct()
    logic = endpoints.where("complexity >= 8").select(F.lit("api-logic"), "id")
    named = namespaces.where(F.col("namespace").rlike(r"(?i)(?:^|\.)(?:http|sql|json|efcore|entityframework|web)(?:\.|$)")).select(F.lit("domain-namespace"), "id")
    return exposed.union(logic).union(named)


def entity_model(files: DataFrame) -> dict[str, DataFrame]:
    """Entities, associations and navigations of EDMX files (file, text), by XPath; namespaces are taken off first."""
    x = F.regexp_replace(F.regexp_replace("text", r"\sxmlns(?::\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1")
    f = files.select("file", x.alias("x"))
    end = lambda k: F.xpath("x", F.lit(f"//ConceptualModels//Association/End[{k}]/@Type"))
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    a = f.select("file", F.explode(F.arrays_zip(F.xpath("x", F.lit("//ConceptualModels//Association/@Name")).alias("name"), end(1).alias("a"), end(2).alias("b"))).alias("z"))
    return {
        "entities": f.select("file", F.explode(F.xpath("x", F.lit("//ConceptualModels//EntityType/@Name"))).alias("entity")),
        "associations": a.select("file", F.col("z.name").alias("name"), short(F.col("z.a")).alias("a"), short(F.col("z.b")).alias("b")),
        "navigations": f.select("file", F.explode(F.xpath("x", F.lit("//ConceptualModels//NavigationProperty/@Relationship"))).alias("relationship")).withColumn("relationship", short(F.col("relationship"))),
    }


def entity_findings(model: dict[str, DataFrame]) -> DataFrame:
    """(code, file, name): association ends without an entity, navigations without an association."""
    e = model["entities"]
    ends = model["associations"].select("file", F.explode(F.array("a", "b")).alias("entity"))
    lost = ends.join(e, ["file", "entity"], "left_anti").select(F.lit("missing-type").alias("code"), "file", F.col("entity").alias("name"))
    nav = model["navigations"].join(model["associations"].select("file", F.col("name").alias("relationship")), ["file", "relationship"], "left_anti")
    return lost.union(nav.select(F.lit("missing-association"), "file", "relationship")).distinct()


def latest_answers(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key, of equal ones the first by all columns."""
    return first_by(rows, [key], F.desc("order"), *[c for c in rows.columns if c not in (key, "order")])
