"""Written documentation: comments parsed as XML, sections that are written, derived or inherited, quality flags."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import ship_package
from .rules import inherited_docs

XML = "struct<inherit:boolean,cref:boolean,source:string,texts:map<string,string>,params:array<struct<name:string,filled:boolean>>>"
XML_TYPE = pa.struct([("inherit", pa.bool_()), ("cref", pa.bool_()), ("source", pa.string()), ("texts", pa.map_(pa.string(), pa.string())), ("params", pa.list_(pa.struct([("name", pa.string()), ("filled", pa.bool_())])))])


def generic_name(name: str) -> str:
    """A reference's generic type as it is written in code: List{T} and List`1 as List<T>, Map`2 as Map<T1, T2>."""
    name = name.replace("{", "<").replace("}", ">")
    arity = re.search(r"`(\d+)$", name)
    if not arity:
        return name
    n = int(arity[1])
    return name[: arity.start()] + ("<T>" if n == 1 else "<" + ", ".join(f"T{i + 1}" for i in range(n)) + ">")


def element_text(e: ET.Element) -> str:
    """An element's text in one line; empty elements that refer to something stand for its last name."""

    def parts(x: ET.Element) -> Iterator[str]:
        yield x.text or ""
        for c in x:
            to = next((c.get(k) for k in ("cref", "name", "langword") if c.get(k) is not None), None)
            if to is not None and len(c) == 0 and not c.text:
                yield f"`{generic_name(to.split(':')[-1].split('(')[0].split('.')[-1])}`"
            else:
                yield element_text(c)
            yield c.tail or ""

    return " ".join("".join(parts(e)).split())


def parsed(doc: str | None) -> dict | None:
    """What a comment says, by the first element of each name; null where it isn't XML."""
    try:
        top = ET.fromstring(doc) if doc is not None else None
    except ET.ParseError:
        return None
    if top is None:
        return None
    texts: dict[str, str] = {}
    for e in top:
        texts.setdefault(e.tag, element_text(e))
    inherit = top.find("inheritdoc")
    params = [{"name": e.get("name"), "filled": bool("".join(e.itertext()).strip())} for e in top if e.tag == "param"]
    return {"inherit": inherit is not None, "cref": inherit is not None and inherit.get("cref") is not None, "source": inherit.get("source") if inherit is not None else None, "texts": list(texts.items()), "params": params}


def parse_docs(df: DataFrame, doc: str = "doc") -> DataFrame:
    """df with xml, what its comments say as XML; null for null comments and those that aren't XML."""
    ship_package(df.sparkSession)
    columns = [c for c in df.columns if c.lower() != "xml"]
    base = df.select(*columns)
    at, names = columns.index(doc), [*columns, "xml"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([parsed(x) for x in b.column(at).to_pylist()], XML_TYPE)], names)

    return base.mapInArrow(run, base.withColumn("xml", F.lit(None).cast(XML)).schema)


def lower_all(names: Column) -> Column:
    return F.transform(names, F.lower)


def written(section: Column, xml: Column, n_params: Column, names: Column, inherits: Column) -> Column:
    """The written text of a section, or null. An inheritdoc covers every section, where there is something to inherit.
    Parameters are documented when all their names are (case doesn't matter), or, of unknown names, as many as there are."""
    filled = F.array_distinct(lower_all(F.transform(F.filter(xml["params"], lambda p: p["filled"]), lambda p: F.coalesce(p["name"], F.lit("")))))
    counted = lambda n: F.concat(n.cast("string"), F.lit(" documented"))
    by_name = F.when(F.size(F.array_except(lower_all(names), filled)) == 0, counted(F.size(names)))
    params = F.when(names.isNotNull(), by_name).when(F.size(filled) >= n_params, counted(F.size(filled)))
    text = F.try_element_at(xml["texts"], section)
    return F.when(xml.isNull(), None).when(xml["inherit"] & inherits, "inherited").when(section == "param", params).when(F.btrim(text) != "", text)


def plain_names(parameters: Column) -> Column:
    """Parameter names without markers; null where one isn't a plain identifier, so that it can't be looked for."""
    names = F.transform(S.parameter_names(parameters), lambda n: F.regexp_replace(n, r"^@+|\?+$", ""))
    return F.when(F.forall(names, lambda n: n.rlike(r"^[\w$]+$")), names)


FLAG = "array<struct<flag:string,origin:string,detail:string>>"


def flag(name: str, origin: str, *detail: Column | str) -> Column:
    return F.struct(F.lit(name).alias("flag"), F.lit(origin).alias("origin"), F.concat(*[F.lit(d) if isinstance(d, str) else d for d in detail]).alias("detail"))


def quality_flags(xml: Column, kind: Column, language: Column, returns: Column, name: Column, type_name: Column, names: Column) -> Column:
    """Flags of a written comment: facts where it contradicts the code, inferences where it looks as if it added nothing."""
    told = F.array_distinct(F.filter(F.transform(xml["params"], lambda p: p["name"]), lambda n: n.isNotNull()))
    gone = F.filter(told, lambda n: ~F.array_contains(lower_all(names), F.lower(n)))
    drift = F.when(names.isNotNull(), F.transform(gone, lambda n: flag("param-drift", "fact", "documents parameter `", n, "`, which doesn't exist"))).otherwise(F.array().cast(FLAG))
    result = F.coalesce(F.try_element_at(xml["texts"], F.lit("returns")), F.lit(""))
    void = (kind == "method") & language.isin("csharp", "java") & returns.isNull() & (result != "")
    summary = F.coalesce(F.try_element_at(xml["texts"], F.lit("summary")), F.lit(""))
    own = S.words(summary)
    meant = F.transform(F.filter(own, lambda w: ~F.lower(w).isin(*S.FILLER) & ~S.stem(w).isin(*S.FILLER)), S.stem)
    known = F.transform(S.words(F.concat_ws(" ", name, type_name, names), camel=True), S.stem)
    says = lambda x: F.concat(F.lit(x), summary, F.lit('"'))
    empty = (
        F.when(summary == "", None)
        .when(summary.rlike(S.PLACEHOLDER), flag("placeholder", "inferred", says('summary is a placeholder: "')))
        .when(F.size(own) < 3, flag("placeholder", "inferred", says('summary is too short to explain anything: "')))
        .when(F.size(F.array_except(meant, known)) == 0, flag("echo", "inferred", says('summary only restates the name: "')))
    )
    rest = F.array_compact(F.array(F.when(void, flag("returns-on-void", "fact", "documents a return value, but returns nothing")), empty))
    return F.when(xml.isNull(), F.array().cast(FLAG)).otherwise(F.concat(drift, rest))


def documentation_items(nodes: DataFrame, implements: DataFrame) -> DataFrame:
    """(id, status, sections, missing, flags): what nodes' comments cover of their required sections.

    nodes: id, kind, name, type_name, language, returns, parameters (list), params (number), doc, required (list of sections),
    derived (map of section to text); implements: from_id, to_id, ord. A node without a comment takes that of the
    first interface it implements that has one. Comments are read as XML; what isn't has no sections and no flags.
    Sections are written (an inheritdoc covers all, if there is something to inherit) or derived, as struct<origin, text> by
    name. Status: documented if none is missing, else partial if one is written. An inheritdoc from nothing is a flag.
    """
    own = nodes.withColumnRenamed("doc", "own_doc")
    docs = inherited_docs(nodes.select("id", "doc"), implements)
    has = implements.join(nodes.select(F.col("id").alias("to_id"), F.col("doc").isNotNull().alias("has")), "to_id", "left")
    has = has.groupBy(F.col("from_id").alias("id")).agg(F.min_by("to_id", "ord").alias("first"), F.max(F.coalesce("has", F.lit(False))).alias("has"))
    x = parse_docs(own.join(docs, "id").join(has, "id", "left"))
    x = x.withColumn("names", plain_names(F.col("parameters")))
    bare = F.col("xml.inherit") & ~F.col("xml.cref")
    nothing = bare & (F.col("xml.source") == "none")
    undocumented = bare & (F.col("xml.source") == "interface") & ~F.col("has")
    x = x.withColumn("empty", F.when(nothing, flag("empty-inheritdoc", "fact", "`<inheritdoc/>`, but there is nothing to inherit from")).when(undocumented, flag("empty-inheritdoc", "fact", "`<inheritdoc/>` from `", F.col("first").cast("string"), "`, which has no docs")))
    required = F.array_distinct(F.coalesce("required", F.array().cast("array<string>")))
    text = lambda s: written(s, F.col("xml"), F.coalesce("params", F.lit(0)), F.col("names"), F.col("empty").isNull())
    found = F.transform(required, lambda s: F.struct(s.alias("section"), text(s).alias("written"), F.try_element_at("derived", s).alias("derived")))
    x = x.withColumn("found", found)
    kept = F.filter("found", lambda f: f["written"].isNotNull() | f["derived"].isNotNull())
    origin = lambda f: F.struct(F.when(f["written"].isNotNull(), "written").otherwise("derived").alias("origin"), F.coalesce(f["written"], f["derived"]).alias("text"))
    sections = F.map_from_entries(F.transform(kept, lambda f: F.struct(f["section"], origin(f))))
    missing = F.transform(F.filter("found", lambda f: f["written"].isNull() & f["derived"].isNull()), lambda f: f["section"])
    status = F.when(F.size(missing) == 0, "documented").when(F.exists("found", lambda f: f["written"].isNotNull()), "partial").otherwise("undocumented")
    flags = F.concat(F.array_compact(F.array("empty")), quality_flags(F.col("xml"), F.col("kind"), F.col("language"), F.col("returns"), F.col("name"), F.col("type_name"), F.col("names")))
    return x.select("id", status.alias("status"), sections.alias("sections"), missing.alias("missing"), flags.alias("flags"))
