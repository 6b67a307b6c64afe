"""Scanners of source text: SQL, configuration, manifests, deployment files. Text in, fact rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import ordinals

SQL_NAME = r"((?:\[[^\]]+\]|\"[^\"]+\"|[\w$]+)(?:\s*\.\s*(?:\[[^\]]+\]|\"[^\"]+\"|[\w$]+))*)"


def bare_sql(text: Column) -> Column:
    """SQL with comments and literals blanked."""
    return F.regexp_replace(text, r"(?s)/\*.*?\*/|--[^\n]*|'(?:[^']|'')*'", " ")


def sql_name(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, r"[\[\]\"\s]", ""))


def sql_objects(files: DataFrame) -> DataFrame:
    """(file, pos, kind, name, body, complexity): one row per CREATE statement of files (file, text)."""
    parts = F.split(bare_sql(F.col("text")), r"(?i)(?=\bcreate\s)")
    each = files.select("file", F.posexplode(parts).alias("pos", "body"))
    head = rf"(?is)^create\s+(?:or\s+(?:alter|replace)\s+)?(procedure|proc|function|view|table|trigger)\s+(?:if\s+not\s+exists\s+)?{SQL_NAME}"
    kind = F.lower(F.regexp_extract("body", head, 1))
    out = each.withColumn("kind", F.when(kind == "proc", "procedure").otherwise(kind)).where("kind != ''")
    return out.select("file", "pos", "kind", sql_name(F.regexp_extract("body", head, 2)).alias("name"), "body", (F.lit(1) + F.regexp_count("body", F.lit(r"(?i)\b(?:if|while|case\s+when|when|catch)\b"))).alias("complexity"))


SQL_HIDDEN = r"(?s)/\*.*?\*/|--[^\n]*+|'(?:[^']++|'')*+'"
SQL_KINDS = "procedure|proc|function|view|table|trigger"


def blanked_sql(text: Column) -> Column:
    """SQL with every character of comments and literals as a space, line ends kept: all places stay where they are."""
    gaps, hidden = F.split(text, SQL_HIDDEN, -1), F.regexp_extract_all(text, F.lit(SQL_HIDDEN), F.lit(0))
    blank = F.transform(hidden, lambda x: F.regexp_replace(x, r"[^\n]", " "))
    return F.array_join(F.zip_with(gaps, blank, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")


#: Characters of a text that are looked through for a place in it.
BLOCK = 1024


def cut_like(text: Column, parts: Column) -> Column:
    """The parts (part) of a text of the same length, each with what the text has there (raw). The text is cut into blocks
    first, so that a part is found without going through the text from its start."""
    at = F.aggregate(parts, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x)))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    near = lambda b, s, n: F.array_join(F.slice(b, F.floor(s / BLOCK).cast("int") + 1, F.floor(n / BLOCK).cast("int") + 2), "")
    cut = lambda b, x, s: F.struct(x.alias("part"), F.substring(near(b, s, F.length(x)), s % BLOCK + 1, F.length(x)).alias("raw"))
    # the blocks as the one element of an array: they are made once, not for each part
    return F.transform(F.array(blocks), lambda b: F.zip_with(parts, F.slice(at, F.lit(1), F.size(parts)), lambda x, s: cut(b, x, s)))[0]


def sql_comment(before: Column) -> Column:
    """The block comment, or the lines of line comments, right at the end of a text, in one line; null without one."""
    x = F.rtrim(before, F.lit(" \t\r\n"))
    block = F.regexp_replace(F.substring_index(x, "/*", -1), r"\*/\z", "")
    lines = F.regexp_replace(F.regexp_extract(x, r"(?:^|\n)((?:[^\S\n]*--[^\n]*(?:\n|\z))+)\z", 1), r"(?m)^[^\S\n]*--", "")
    said = F.when(F.endswith(x, F.lit("*/")) & F.contains(x, F.lit("/*")), block).otherwise(lines)
    said = F.btrim(F.regexp_replace(F.replace(said, F.lit("*"), F.lit(" ")), r"\s+", " "))
    return F.when(said != "", said)


def sql_statements(files: DataFrame) -> DataFrame:
    """(file, kind, name, line, end_line, doc, parameters, complexity, body): one row per CREATE statement of files (file, text).

    Statements are cut on the blanked text, which has every place where the text has it; the text is cut at the same places,
    so that the comment right above a statement ends the part before and becomes its doc, and lines are those of the file.
    No row holds more of a file than its part and the one before. Parameters (name: type)
    are those of the header of procedures and functions, before AS, BEGIN or RETURNS. Tables have no complexity. body is
    the text from the statement on to the next one.
    """
    start = rf"(?i)(?=\bcreate\s+(?:or\s+(?:alter|replace)\s+)?(?:{SQL_KINDS})\s)"
    parts = files.select("file", "text", F.split(blanked_sql(F.col("text")), start, -1).alias("parts"))
    each = parts.select("file", F.posexplode(cut_like(F.col("text"), F.col("parts"))).alias("pos", "x")).select("file", "pos", "x.*")
    lines = lambda x: F.regexp_count(x, F.lit("\n"))
    in_file = Window.partitionBy("file").orderBy("pos")
    each = each.withColumns({
        "line": (F.coalesce(F.sum(lines("part")).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int"),
        "before": F.coalesce(F.lag("raw").over(in_file), F.lit("")),
    })
    head = rf"(?is)^create\s+(?:or\s+(?:alter|replace)\s+)?({SQL_KINDS})\s+(?:if\s+not\s+exists\s+)?{SQL_NAME}"
    kind = F.lower(F.regexp_extract("part", head, 1))
    each = each.withColumn("kind", F.when(kind == "proc", "procedure").otherwise(kind)).where("kind != ''")
    header = F.split("part", r"(?i)\b(?:AS|BEGIN|RETURNS)\b", 2)[0]
    found = lambda k: F.regexp_extract_all(header, F.lit(r"(@\w+)\s+(\w+(?:\s*\([\d\s,]+\))?)"), F.lit(k))
    parameters = F.when(F.col("kind").isin("procedure", "function"), F.zip_with(found(1), found(2), lambda n, t: F.concat(n, F.lit(": "), t))).otherwise(F.array().cast("array<string>"))
    complexity = F.when(F.col("kind") != "table", 1 + F.regexp_count("part", F.lit(r"(?i)\b(?:if|while|case\s+when|when)\b")))
    return each.select(
        "file", "kind", sql_name(F.regexp_extract("part", head, 2)).alias("name"), "line", (F.col("line") + lines(F.left("part", F.length("part") - 1))).alias("end_line"),
        sql_comment(F.col("before")).alias("doc"), parameters.alias("parameters"), complexity.alias("complexity"), F.col("raw").alias("body"),
    )


def sql_references(objects: DataFrame) -> DataFrame:
    """(file, name, kind, target): tables read or written and procedures run by each object, once each."""
    find = lambda verb: F.regexp_extract_all("body", F.lit(rf"(?i)\b{verb}\s+{SQL_NAME}"), F.lit(1))
    reads = F.transform(find("(?:from|join)"), lambda x: F.struct(F.lit("reads").alias("kind"), sql_name(x).alias("target")))
    writes = F.transform(find("(?:insert\\s+into|update|delete\\s+from|merge\\s+into)"), lambda x: F.struct(F.lit("writes").alias("kind"), sql_name(x).alias("target")))
    runs = F.transform(find("exec(?:ute)?"), lambda x: F.struct(F.lit("calls").alias("kind"), sql_name(x).alias("target")))
    return objects.select("file", "name", F.explode(F.array_distinct(F.concat(reads, writes, runs))).alias("r")).select("file", "name", "r.kind", "r.target").where("target != name")


def migrations(files: DataFrame) -> DataFrame:
    """(file, version, ord): files in a migrations folder or named V1__x.sql, in order of their names without case."""
    name = F.element_at(F.split("file", "/"), -1)
    rows = files.where(F.col("file").rlike(r"(?i)/migrations?/") | name.rlike(r"^V[0-9._]+__")).withColumn("version", F.regexp_extract(name, r"^V?([0-9]+(?:[._][0-9]+)*)", 1))
    return ordinals(rows.withColumn("_name", F.lower(name)), "_name", "file").select("file", "version", F.col("number").alias("ord"))


def properties(files: DataFrame) -> DataFrame:
    """(file, key, host): key=value lines of .env and .properties files; only the host of URL values is kept."""
    line = F.explode(F.split("text", r"\r?\n"))
    rows = files.select("file", line.alias("line")).where(~F.col("line").rlike(r"^\s*(?:[#!;]|$)"))
    key = F.btrim(F.regexp_extract("line", r"^\s*(?:export\s+)?([\w.\-:]+)\s*[=:]", 1))
    return rows.select("file", F.replace(key, F.lit("__"), F.lit(":")).alias("key"), F.try_parse_url(F.btrim(F.regexp_extract("line", r"[=:]\s*(.*)$", 1)), F.lit("HOST")).alias("host")).where("key != ''")


def json_settings(files: DataFrame) -> DataFrame:
    """(file, key, host): flattened keys of JSON settings files, sections joined by colons. What lies deeper than
    five sections comes under the key of the fifth, without a host."""
    level = files.select("file", F.lit("").alias("prefix"), F.from_json("text", "map<string,string>").alias("m"))
    out = None
    for _ in range(5):
        flat = level.select("file", "prefix", F.explode("m").alias("k", "v")).select("file", F.concat("prefix", "k").alias("key"), "v")
        nested = F.from_json("v", "map<string,string>")
        flat = flat.withColumn("sub", F.when(F.col("v").startswith("{"), nested))
        rows = flat.where("sub IS NULL").select("file", "key", F.try_parse_url("v", F.lit("HOST")).alias("host"))
        out = rows if out is None else out.unionByName(rows)
        level = flat.where("sub IS NOT NULL").select("file", F.concat("key", F.lit(":")).alias("prefix"), F.col("sub").alias("m"))
    return out.unionByName(level.select("file", F.regexp_replace("prefix", ":$", "").alias("key"), F.lit(None).cast("string").alias("host")))


def package_manifests(files: DataFrame) -> DataFrame:
    """(file, ecosystem, package, version) of package.json, .csproj, pom.xml and gradle files."""
    name = F.element_at(F.split("file", "/"), -1)
    npm = files.where(name == "package.json").select("file", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    deps = [npm.select("file", F.explode(F.map_entries(f"j.{c}")).alias("d")) for c in ("dependencies", "devDependencies")]
    npm = deps[0].unionByName(deps[1]).select("file", F.lit("npm").alias("ecosystem"), F.col("d.key").alias("package"), F.col("d.value").alias("version"))
    found = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))

    def pairs(rows: DataFrame, eco: str, pattern: str) -> DataFrame:
        z = F.explode(F.arrays_zip(found(pattern, 1).alias("p"), found(pattern, 2).alias("v")))
        return rows.select("file", z.alias("z")).select("file", F.lit(eco).alias("ecosystem"), F.col("z.p").alias("package"), F.when(F.col("z.v") != "", F.col("z.v")).alias("version"))

    nuget = pairs(files.where(name.endswith(".csproj")), "nuget", r"<PackageReference\s+Include=\"([^\"]+)\"(?:\s+Version=\"([^\"]*)\")?")
    maven = pairs(files.where(name == "pom.xml"), "maven", r"(?s)<dependency>.*?<artifactId>([^<]+)</artifactId>\s*(?:<version>([^<]*)</version>)?")
    gradle = pairs(files.where(name.rlike(r"\.gradle(?:\.kts)?$")), "maven", r"(?:implementation|api|testImplementation)\s*\(?[\"']([^\"':]+:[^\"':]+)(?::([^\"']+))?[\"']")
    return npm.unionByName(nuget).unionByName(maven).unionByName(gradle)


def deployment_files(files: DataFrame) -> DataFrame:
    """(file, kind): compose files, Dockerfiles, infrastructure code, and Kubernetes manifests told by their first 50 lines."""
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    head = F.slice(F.split("text", "\n"), 1, 50)
    k8s = F.exists(head, lambda x: x.rlike(r"^apiVersion:")) & F.exists(head, lambda x: x.rlike(r"^kind:"))
    kind = F.when(name.rlike(r"^(?:docker-)?compose.*\.ya?ml$"), "compose").when(name.rlike(r"^dockerfile|\.dockerfile$"), "dockerfile").when(name.rlike(r"\.(?:tf|bicep)$"), "infrastructure").when(name.rlike(r"\.ya?ml$") & k8s, "kubernetes")
    return files.select("file", kind.alias("kind")).where("kind IS NOT NULL")


def php_symbols(files: DataFrame) -> DataFrame:
    """(file, kind, name): classes, interfaces, traits and functions of PHP text, comments and literals blanked."""
    code = F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*|#[^\n\[][^\n]*|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", " ")
    types = F.transform(F.regexp_extract_all(code, F.lit(r"\b(class|interface|trait|enum)\s+(\w+)"), F.lit(0)), lambda x: F.struct(F.split(x, r"\s+")[0].alias("kind"), F.split(x, r"\s+")[1].alias("name")))
    functions = F.transform(F.regexp_extract_all(code, F.lit(r"\bfunction\s+&?(\w+)\s*\("), F.lit(1)), lambda x: F.struct(F.lit("method").alias("kind"), x.alias("name")))
    return files.select("file", F.explode(F.concat(types, functions)).alias("s")).select("file", "s.kind", "s.name")
