"""Solution files and package manifests: folders of projects, and which version a package reference gets from where.

Parsing is per file, inside tasks; what needs other files (parents, the nearest props file, its entries) is joins."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: Fixed value: the type of a solution folder.
FOLDER_TYPE = "2150E333-8FDC-42A3-9474-1A3956D46DE8"
#: Deepest solution folder; what isn't at the top by then lies on a cycle.
MOST_FOLDERS = 64


def per_file(files: DataFrame, parse: Callable[[str], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """file and a row for each that parse finds in its text. Null text has none."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, *r) for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None for r in parse(t)]
            if rows:
                yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(["file", *names], zip(*rows, strict=True), strict=True)}, schema=pa.schema(types))

    out = files.sparkSession.createDataFrame([], f"file string, {schema}").schema
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [(f.name, kinds[f.dataType.simpleString()]) for f in out.fields]
    return files.select("file", "text").mapInArrow(run, out)


def xml_folders(text: str) -> list[tuple[str, str]]:
    """(path, folder) of the projects of an XML solution; none if it isn't XML."""
    try:
        top = ET.fromstring(text)
    except ET.ParseError:
        return []
    out = []

    def walk(e: ET.Element, folders: list[str]) -> None:
        tag = e.tag.rpartition("}")[2]
        if tag == "Project" and e.get("Path") is not None:
            out.append((e.get("Path").replace("\\", "/"), "/".join(folders)))
        inner = [*folders, *[n for n in [(e.get("Name") or "").strip("/")] if tag == "Folder" and n]]
        for x in e:
            walk(x, inner)

    walk(top, [])
    return out


def solution_folders(files: DataFrame) -> DataFrame:
    """(file, path, folder): the projects of solution files (file, text; .sln and .slnx) with their solution folder, "" at the
    top. In .sln files folders are entries, nested by id: the ids' parents are followed, a level a round, for all files
    together. What lies on a cycle of parents has a null folder."""
    named = F.lower("file")
    entry = r'(?m)^Project\("\{([^}]+)\}"\)\s*=\s*"([^"]*)"\s*,\s*"([^"]*)"\s*,\s*"\{([^}]+)\}'
    group = lambda text, pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    sln = files.where(named.endswith(".sln")).select("file", "text")
    entries = sln.select("file", F.posexplode(F.arrays_zip(*[group("text", entry, k).alias(n) for k, n in ((1, "type"), (2, "name"), (3, "path"), (4, "id"))])).alias("pos", "e"))
    entries = materialize(entries.select("file", "pos", F.upper("e.type").alias("type"), "e.name", F.replace("e.path", F.lit("\\"), F.lit("/")).alias("path"), F.upper("e.id").alias("id")))
    section = F.regexp_extract("text", r"(?s)GlobalSection\(NestedProjects\)(.*?)EndGlobalSection", 1)
    pair = r"\{([^}]+)\}\s*=\s*\{([^}]+)\}"
    nested = sln.select("file", F.posexplode(F.arrays_zip(group(section, pair, 1).alias("id"), group(section, pair, 2).alias("up"))).alias("pos", "n"))
    folders = entries.where(F.col("type") == FOLDER_TYPE).groupBy("file", "id").agg(F.min_by("name", "pos").alias("name"))
    up = nested.groupBy("file", F.upper("n.id").alias("id")).agg(F.upper(F.min_by("n.up", "pos")).alias("up"))
    # an entry's parent counts if it is a folder
    up = materialize(up.join(folders.select("file", F.col("id").alias("up"), F.col("name").alias("up_name")), ["file", "up"]))
    step = up.select("file", F.col("id").alias("at"), F.col("up").alias("next"), "up_name")
    projects = entries.join(folders.select("file", "id"), ["file", "id"], "left_anti").select("file", "pos", "path", "id")
    live, done = projects.select("file", "pos", "path", F.col("id").alias("at"), F.lit("").alias("folder")), []
    for _ in range(MOST_FOLDERS + 1):
        on = live.join(step, ["file", "at"], "left")
        higher = F.when(F.col("folder") == "", F.col("up_name")).otherwise(F.concat_ws("/", "up_name", "folder"))
        now = materialize(on.select("file", "pos", "path", F.col("next").alias("at"), F.when(F.col("next").isNull(), F.col("folder")).otherwise(higher).alias("folder")))
        done.append(now.where("at IS NULL"))
        live = now.where("at IS NOT NULL")
        if live.isEmpty():
            break
    else:
        done.append(live.withColumn("folder", F.lit(None).cast("string")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("file", "path", "folder").unionByName(per_file(files.where(named.endswith(".slnx")), xml_folders, ["path", "folder"], "path string, folder string"))


def xml_elements(text: str) -> list[tuple[str, dict[str, str], int, dict[str, str], str]]:
    """(name, attributes, line, texts of its children, own text) of all elements in the order of their tags; none if it isn't XML."""
    parser = expat.ParserCreate()
    out, open_ = [], []

    def start(name: str, attributes: dict[str, str]) -> None:
        e = (name.rpartition(":")[2], attributes, parser.CurrentLineNumber, {}, [])
        out.append(e)
        open_.append(e)

    def end(_: str) -> None:
        e = open_.pop()
        if open_:
            open_[-1][3].setdefault(e[0], "".join(e[4]).strip())

    def data(x: str) -> None:
        for e in open_:
            e[4].append(x)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(text.lstrip("﻿"), True)
    except expat.ExpatError:
        return []
    return [(n, a, line, kids, "".join(own).strip()) for n, a, line, kids, own in out]


def package_facts(text: str) -> list[tuple]:
    """(kind, package, version, override, line) of a project or props file: its references (ref), central entries (central) and
    the last switch of central management (switch)."""
    out, switch = [], None
    for name, attributes, line, kids, own in xml_elements(text):
        value = lambda k, a=attributes, c=kids: a[k] if k in a else c.get(k)
        if name == "ManagePackageVersionsCentrally":
            switch = ("switch", None, str(own.lower() == "true").lower(), None, line)
        elif name in ("PackageReference", "PackageVersion") and "Include" in attributes:
            out.append(("ref" if name == "PackageReference" else "central", attributes["Include"], value("Version"), value("VersionOverride"), line))
    return out + ([switch] if switch else [])


def nuget_references(files: DataFrame) -> DataFrame:
    """(project, package, version, declared_in, line, central, problem): the package references of .csproj files (file, text) with
    the version each resolves to and the line that declares it.

    The nearest Directory.Packages.props in the project's folder or above is the only one that counts. The project's own
    switch wins over its. An override wins over everything; without central management the reference's version counts;
    with it the props file's last entry for the package, whose case doesn't matter. A version with an MSBuild property is
    no literal: null, with the problem.
    """
    name = F.element_at(F.split("file", "/"), -1)
    known = files.where(F.lower("file").endswith(".csproj") | (name == "Directory.Packages.props"))
    facts = materialize(per_file(known, package_facts, ["kind", "package", "version", "override", "line"], "kind string, package string, version string, override string, line int"))
    is_props = F.element_at(F.split("file", "/"), -1) == "Directory.Packages.props"
    projects = known.where(F.lower("file").endswith(".csproj")).select(F.col("file").alias("project"))
    parts = F.split("project", "/")
    folders = projects.select("project", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "folder"))
    props = known.where(is_props).select(F.col("file").alias("props"), F.regexp_replace("file", "/?Directory[.]Packages[.]props$", "").alias("folder")).distinct()
    nearest = folders.join(props, "folder").groupBy("project").agg(F.max_by("props", "depth").alias("props"))
    switches = facts.where("kind = 'switch'").select("file", F.col("version").alias("on"))
    scope = projects.distinct().join(nearest, "project", "left").join(switches.select(F.col("file").alias("project"), F.col("on").alias("own")), "project", "left")
    scope = scope.join(switches.select(F.col("file").alias("props"), F.col("on").alias("theirs")), "props", "left")
    scope = scope.select("project", "props", (F.coalesce("own", "theirs", F.lit("false")) == "true").alias("managed"))
    central = facts.where((F.col("kind") == "central") & is_props).withColumn("k", F.lower("package"))
    last = Window.partitionBy("file", "k").orderBy(F.desc("line"), F.desc("version"))
    central = central.withColumn("n", F.row_number().over(last)).where("n = 1").select(F.col("file").alias("props"), "k", F.col("version").alias("central_version"), F.col("line").alias("central_line"))
    refs = facts.where((F.col("kind") == "ref") & ~is_props).select(F.col("file").alias("project"), "package", F.lower("package").alias("k"), "version", "override", "line").join(scope, "project")
    refs = refs.join(central, ["props", "k"], "left")
    over, found = F.col("override").isNotNull(), F.col("central_line").isNotNull()
    from_props = ~over & F.col("managed") & found
    raw = F.when(over, F.col("override")).when(~F.col("managed"), F.col("version")).otherwise(F.col("central_version"))
    literal = F.when(~F.contains(raw, F.lit("$(")), raw)
    missing = F.concat(F.lit("centrally managed, but no PackageVersion in "), F.coalesce("props", F.lit("a Directory.Packages.props")))
    problem = F.when(F.contains(raw, F.lit("$(")), F.concat(F.lit("version comes from an MSBuild property ("), raw, F.lit(")"))).when(raw.isNull(), F.when(~over & F.col("managed") & ~found, missing).otherwise("no version declared"))
    return refs.select(
        "project", "package", literal.alias("version"), F.when(from_props, F.col("props")).otherwise(F.col("project")).alias("declared_in"),
        F.when(from_props, F.col("central_line")).otherwise(F.col("line")).alias("line"), (over | F.col("managed")).alias("central"), problem.alias("problem"),
    )
