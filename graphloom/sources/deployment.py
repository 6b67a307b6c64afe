"""Deployment descriptors: services, workloads, images and resources of files, and the known systems behind them.

Files are parsed one by one inside tasks. YAML needs PyYAML on the executors; without it reading YAML is an error."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

try:
    import yaml
except ImportError:  # an optional package
    yaml = None

#: Kinds of workloads.
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob", "Pod")
LISTS = ("ports", "env", "depends_on", "volumes", "networks")
UNITS = "file string, line int, unit string, image string, build string, " + ", ".join(f"{c} array<string>" for c in LISTS)


def _get(node, *keys: str):
    """The value under a way of keys of mapping nodes, or null."""
    for k in keys:
        if node is None or node.id != "mapping":
            return None
        node = next((v for n, v in node.value if n.id == "scalar" and n.value == k), None)
    return node


def _text(node) -> str | None:
    return node.value if node is not None and node.id == "scalar" else None


def _items(node) -> list:
    return node.value if node is not None and node.id == "sequence" else []


def _keys(node) -> list[str]:
    return [k.value for k, _ in node.value if k.id == "scalar"]


def _present(values) -> list[str]:
    return [v for v in values if v is not None]


def env_names(node) -> list[str]:
    """Names of variables, never their values: keys of a mapping, what is before "=" in a list, or its items' names."""
    if node is not None and node.id == "mapping":
        return _keys(node)
    return _present((_text(x) or "").split("=")[0] if _text(x) is not None else _text(_get(x, "name")) for x in _items(node))


def scalars(node) -> list[str]:
    """A mapping's keys, a list's scalars (or published:target, source:target of its mappings), a scalar alone."""
    if node is None:
        return []
    if node.id == "mapping":
        return _keys(node)
    if node.id == "scalar":
        return [node.value]
    pair = lambda x: f"{_text(_get(x, 'published')) or _text(_get(x, 'source')) or ''}:{_text(_get(x, 'target')) or ''}"
    return [_text(x) if _text(x) is not None else pair(x) for x in node.value]


def units_of(text: str) -> list[tuple]:
    """The units of all documents of a YAML text, each with its line (from 1); none if it isn't YAML, as templates aren't."""
    try:
        docs = list(yaml.compose_all(text, Loader=yaml.SafeLoader))
    except (yaml.YAMLError, RecursionError):
        return []
    out = []
    for d in docs:
        services = _get(d, "services")
        for k, v in services.value if services is not None and services.id == "mapping" else []:
            build = _text(_get(v, "build")) or _text(_get(v, "build", "context"))
            out.append((k.start_mark.line + 1, k.value, _text(_get(v, "image")), build, scalars(_get(v, "ports")), env_names(_get(v, "environment")), scalars(_get(v, "depends_on")), scalars(_get(v, "volumes")), scalars(_get(v, "networks"))))
        kind, name = _text(_get(d, "kind")), _text(_get(d, "metadata", "name"))
        if kind is None or name is None:
            continue
        line = d.start_mark.line + 1
        if kind in WORKLOADS:
            way = {"Pod": ("spec",), "CronJob": ("spec", "jobTemplate", "spec", "template", "spec")}.get(kind, ("spec", "template", "spec"))
            pod = _get(d, *way)
            containers = _items(_get(pod, "containers"))
            image = ", ".join(_present(_text(_get(c, "image")) for c in containers)) or None
            ports = _present(_text(_get(p, "containerPort")) for c in containers for p in _items(_get(c, "ports")))
            env = [e for c in containers for e in env_names(_get(c, "env"))]
            out.append((line, f"{kind}/{name}", image, None, ports, env, [], _present(_text(_get(v, "name")) for v in _items(_get(pod, "volumes"))), []))
        elif kind == "Service":
            port = lambda p: f"{_text(_get(p, 'port')) or ''}→{_text(_get(p, 'targetPort')) or _text(_get(p, 'port')) or ''}"
            out.append((line, f"Service/{name}", None, None, [port(p) for p in _items(_get(d, "spec", "ports"))], [], [], [], []))
    return out


def deployment_units(files: DataFrame) -> DataFrame:
    """file, line, unit, image, build, ports, env (names only), depends_on, volumes and networks: a row per compose service,
    workload or cluster service of YAML files (file, text), whatever number of documents they hold. Null text has none."""
    if yaml is None:
        raise RuntimeError("reading YAML needs PyYAML")
    ship_package(files.sparkSession)
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()] + [pa.list_(pa.string())] * len(LISTS)
    names = [c.split(" ")[0] for c in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(f, *u) for u in units_of(t)] if t is not None else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.where(F.lower("file").rlike(r"\.ya?ml$")).select("file", "text").mapInArrow(run, UNITS)


def image_stages(files: DataFrame) -> DataFrame:
    """file, bases (distinct images that a Dockerfile's stages begin from) and exposes, in order."""
    name = F.element_at(F.split("file", "/"), -1)
    own = files.where(name.startswith("Dockerfile") | name.endswith(".Dockerfile"))
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    exposed = F.flatten(F.transform(found(r"(?im)^[ \t]*EXPOSE[ \t]+(.+)$"), lambda x: F.filter(F.split(x, r"[ \r]"), lambda y: y != "")))
    return own.select("file", F.array_distinct(found(r"(?im)^[ \t]*FROM[ \t]+(?:--\S+[ \t]+)*(\S+)")).alias("bases"), exposed.alias("exposes"))


def resources(files: DataFrame) -> DataFrame:
    """file, type and n: resource types that infrastructure code (.tf, .bicep) declares, and how often."""
    own = files.where(F.col("file").rlike(r"\.(?:tf|bicep)$"))
    each = own.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*resource[ \t]+(?:\"[^\"\n]+\"|\w+[ \t]+'[^'@\n]+@)"), F.lit(0))).alias("x"))
    return each.groupBy("file", F.regexp_extract("x", r"[\"']([^\"'@]+)[\"@]", 1).alias("type")).agg(F.count("*").alias("n"))


def prefixes(c: Column) -> Column:
    """All starts of a text, the empty one left out."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(c)), lambda n: n > 0), lambda n: F.left(c, n))


def first_prefix(items: DataFrame, table: DataFrame, key: str, texts: Column) -> DataFrame:
    """items (key) with system: that of the first row (by ord) of table (ord, prefix, system) that one of the item's texts begins
    with; null without one. Texts are exploded into their starts, so the join is on equality and an item meets only what fits."""
    starts = items.select(key).distinct().select(key, F.explode(F.array_distinct(F.flatten(F.transform(texts, prefixes)))).alias("prefix"))
    hit = starts.join(table.select("ord", "prefix", "system"), "prefix").groupBy(key).agg(F.min_by("system", "ord").alias("system"))
    return items.join(hit, key, "left")


def systems_of_images(items: DataFrame, table: DataFrame, image: str = "image") -> DataFrame:
    """items with the system that an image is: any part of its path after a registry (a first part with a dot), without tag
    and digest, begins with a known image name; the first known one wins."""
    parts = F.split(F.split(image, "@")[0], "/")
    parts = F.when(F.contains(parts[0], F.lit(".")), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return first_prefix(items, table, image, F.transform(parts, lambda x: F.split(x, ":")[0]))


def systems_of_resources(items: DataFrame, table: DataFrame, type_: str = "type") -> DataFrame:
    """items with the system that a resource type provisions; case doesn't matter, the first known prefix wins."""
    lower = table.withColumn("prefix", F.lower("prefix"))
    return first_prefix(items, lower, type_, F.array(F.lower(type_)))


def systems_of_calls(items: DataFrame, table: DataFrame) -> DataFrame:
    """items (name, qualified) with the system that a call uses, from table (ord, prefix, system): an entry with a dot has to begin
    the qualified name, one without has to be the name. The first wins."""
    dotted = F.contains("prefix", F.lit("."))
    ways = F.concat(F.array(F.struct(F.col("name").alias("prefix"), F.lit(False).alias("dotted"))), F.coalesce(F.transform(prefixes(F.col("qualified")), lambda x: F.struct(x.alias("prefix"), F.lit(True).alias("dotted"))), F.array()))
    each = items.select("name", "qualified").distinct().select("name", "qualified", F.explode(ways).alias("w")).select("name", "qualified", "w.*")
    hit = each.join(table.select("ord", "prefix", "system", dotted.alias("dotted")), ["prefix", "dotted"]).groupBy("name", "qualified").agg(F.min_by("system", "ord").alias("system"))
    hit = hit.select(F.col("name").alias("_name"), F.col("qualified").alias("_qualified"), "system")
    return items.join(hit, (F.col("name") == F.col("_name")) & F.col("qualified").eqNullSafe(F.col("_qualified")), "left").drop("_name", "_qualified")
