"""Budgets on the serialised size of answers: nested JSON trimmed where it is largest, entries cut until they fit."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructType

from ..session import ship_package
from .windows import top_with_rest


class Number(str):
    """A number as it was written."""


def units(text: str) -> int:
    """The length in UTF-16 units."""
    return len(text) + sum(c > "\uffff" for c in text)


def written(x) -> str:
    """Compact JSON, with all but control characters, quotes and backslashes as they are."""
    if isinstance(x, Number):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(written, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


class Sizes:
    """The arrays of a document with the sizes of their elements; sizes follow when elements go, nothing is written anew."""

    def __init__(self, body):
        self.arrays: list[tuple[str, list, list[int], list[tuple[int, int]]]] = []  # path, items, their sizes, (array, place) around it
        self.size: list[int] = []
        self.total = self._measure(body, "", [])

    def _measure(self, x, path: str, around: list[tuple[int, int]]) -> int:
        if isinstance(x, dict):
            each = [units(json.dumps(k, ensure_ascii=False)) + 1 + self._measure(v, f"{path}.{k}" if path else k, around) for k, v in x.items()]
            return 2 + sum(each) + max(len(each) - 1, 0)
        if isinstance(x, list):
            me = len(self.arrays)
            sizes: list[int] = []
            self.arrays.append((path, x, sizes, around))
            self.size.append(0)
            for i, v in enumerate(x):
                sizes.append(self._measure(v, f"{path}[{i}]", [*around, (me, i)]))
            self.size[me] = 2 + sum(sizes) + max(len(sizes) - 1, 0)
            return self.size[me]
        return units(written(x))

    def fit(self, budget: int) -> dict[str, int]:
        """Cuts the largest array (ties: the least path) from its end, by what is over at its elements' average size, until
        all fits. Returns how many elements of each path went."""
        dropped: dict[str, int] = {}
        heap = [(-s, a[0], k) for k, (s, a) in enumerate(zip(self.size, self.arrays, strict=True))]
        heapq.heapify(heap)
        while self.total > budget and heap:
            size, path, k = heapq.heappop(heap)
            _, items, sizes, around = self.arrays[k]
            if not items or any(place >= len(self.arrays[a][1]) for a, place in around):
                continue  # empty, or gone with an element
            if -size != self.size[k]:
                heapq.heappush(heap, (-self.size[k], path, k))
                continue
            average = max(1.0, self.size[k] / len(items))
            cut = min(max(-int(-(self.total - budget) // average), 1), len(items))
            less = sum(sizes[-cut:]) + cut - (cut == len(items))
            del items[-cut:], sizes[-cut:]
            dropped[path] = dropped.get(path, 0) + cut
            self.size[k] -= less
            self.total -= less
            for a, place in around:
                self.size[a] -= less
                self.arrays[a][2][place] -= less
            heapq.heappush(heap, (-self.size[k], path, k))
        return dict(sorted(dropped.items()))


def fitted(body: str | None, budget: int) -> tuple[str | None, dict[str, int] | None]:
    """The document within the budget and what went; what isn't JSON comes back as it is, with null."""
    try:
        x = json.loads(body, parse_float=Number, parse_int=Number, parse_constant=Number) if body is not None else None
    except ValueError:
        return body, None
    if body is None:
        return None, None
    sizes = Sizes(x)
    dropped = sizes.fit(budget)
    return written(x), dropped


def fit_json(df: DataFrame, column: str, budget: int) -> DataFrame:
    """df with its JSON column cut to a budget of characters, and truncated: the elements that went, by the path of their list.

    As long as a document is too long, its largest list (at any depth; ties: the least path) loses elements from
    its end: as many as are over at that list's average size, at least one. A document without lists stays whatever its
    size. The column comes back in compact form. Null stays null and text that isn't JSON stays as it is, both with null
    for truncated. A document is a row; nothing else is held together.
    """
    ship_package(df.sparkSession)
    at = df.columns.index(column)
    schema = StructType([f for f in df.schema.fields if f.name.lower() != "truncated"]).add("truncated", MapType(StringType(), IntegerType()))
    keep = [k for k, f in enumerate(df.schema.fields) if f.name.lower() != "truncated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.int32())
        for b in batches:
            out = [fitted(x, budget) for x in b.column(at).to_pylist()]
            told = pa.array([None if d is None else list(d.items()) for _, d in out], kind)
            columns = [pa.array([x for x, _ in out], pa.string()) if k == at else b.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, told], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


ENTRY = ("id", "status", "type", "state", "title", "description", "labels", "criteria")


def fit_entries(entries: DataFrame, key: str, most: int = 3, budget: int = 1200) -> DataFrame:
    """The first entries of each key (by ord) within a budget on their size as JSON, each cut as far as it has to be.

    entries: key, ord, id, status, type, state, title, description (strings), labels and criteria (lists of strings). An
    entry that is too long for what is left first has its description cut, with an ellipsis, then loses criteria
    from the end, then its labels; if it still is, it and all after it are left out. Members that are null aren't
    written. Returns the entries with place, size, body_cut and criteria_cut, and left_out (of the key's entries).
    """
    first = top_with_rest(entries.select(key, "ord", *ENTRY), [key], most, "ord")
    struct = F.struct("ord", *ENTRY)
    rows = first.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(struct)).alias("rows"), (F.count("*") + F.max("more")).alias("n"))
    shape = first.select(struct.alias("r")).schema["r"].dataType.simpleString()
    fact = lambda e: F.struct(*[e[c].alias(c) for c in ENTRY])
    size = lambda e: F.length(F.to_json(fact(e)))

    def cut_body(e: Column, room: Column) -> Column:
        keep = F.length(e["description"]) - (size(e) - room) - 1
        short = F.when(keep > 0, F.concat(F.left(e["description"], keep), F.lit("…")))
        return F.when((size(e) > room) & e["description"].isNotNull(), e.withField("description", short)).otherwise(e)

    def cut_criteria(e: Column, room: Column) -> Column:
        bare = size(e.withField("criteria", F.array().cast("array<string>")))

        def step(a: Column, c: Column) -> Column:
            used = a["used"] + F.length(F.to_json(F.array(c))) - 2 + F.when(a["k"] > 0, 1).otherwise(0)
            return F.when(a["on"] & (used <= room), F.struct((a["k"] + 1).alias("k"), used.alias("used"), F.lit(True).alias("on"))).otherwise(a.withField("on", F.lit(False)))

        kept = F.aggregate(e["criteria"], F.struct(F.lit(0).alias("k"), bare.alias("used"), F.lit(True).alias("on")), step, lambda a: a["k"])
        return F.when((size(e) > room) & (F.size(e["criteria"]) > 0), e.withField("criteria", F.slice(e["criteria"], F.lit(1), kept))).otherwise(e)

    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  evaluates x once
    none = F.lit(None).cast("array<string>")

    def step(acc: Column, e: Column) -> Column:
        room = F.lit(budget) - acc["used"]

        def done(x: Column) -> Column:
            n = size(x)
            mark = F.struct(x.alias("e"), n.alias("size"), (~x["description"].eqNullSafe(e["description"])).alias("body_cut"), (F.size(x["criteria"]) < F.size(e["criteria"])).alias("criteria_cut"))
            going = F.struct(F.lit(True).alias("on"), (acc["used"] + n).alias("used"), F.concat(acc["out"], F.array(mark)).alias("out"))
            return F.when(acc["on"] & (n <= room), going).otherwise(acc.withField("on", F.lit(False)))

        shorter = once(cut_body(e, room), lambda x: once(cut_criteria(x, room), lambda y: F.when(size(y) > room, y.withField("labels", none)).otherwise(y)))
        return once(shorter, done)

    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("used"), F.array().cast(f"array<struct<e:{shape},size:int,body_cut:boolean,criteria_cut:boolean>>").alias("out"))
    got = rows.select("_key", "n", F.aggregate("rows", start, step, lambda a: a["out"]).alias("out")).withColumn("left_out", (F.col("n") - F.size("out")).cast("long"))
    each = got.select("_key", "left_out", F.posexplode("out").alias("at", "x"))
    return each.select(F.col("_key").alias(key), (F.col("at") + 1).alias("place"), *[F.col(f"x.e.{c}").alias(c) for c in ("ord", *ENTRY)], "x.size", "x.body_cut", "x.criteria_cut", "left_out")
