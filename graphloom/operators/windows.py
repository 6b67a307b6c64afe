"""Rankings, tops, trends and state over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ordinals


def top_with_rest(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key with rank and more, the number of rows beyond k."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - k, F.lit(0)))
    return out.where(F.col("rank") <= k)


def trend(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each row with the value before it and the change in percent; null where the one before is 0 or missing."""
    was = F.lag(value).over(Window.partitionBy(*keys).orderBy(at))
    return df.withColumn("previous", was).withColumn("change", F.when(F.col("previous") != 0, 100 * (F.col(value) - F.col("previous")) / F.col("previous")))


def buckets(series: DataFrame, keys: list[str], at: str, requests: str, p95: str, most: int = 60) -> DataFrame:
    """At most so many chunks of equal count: end, requests per second of the chunk's span, highest p95. at is in seconds."""
    w = Window.partitionBy(*keys)
    size = F.ceil(F.count("*").over(w) / most)
    cut = series.withColumn("chunk", F.floor((F.row_number().over(w.orderBy(at)) - 1) / size))
    return cut.groupBy(*keys, "chunk").agg(
        F.max(at).alias("end"), (F.sum(requests) / F.greatest(F.max(at) - F.min(at) + 1, F.lit(1))).alias("rate"), F.max(p95).alias("p95"))


def numbered(df: DataFrame, prefix: str, *order, digits: int = 3) -> DataFrame:
    """Finding numbers prefix-001 in order, which is total. Ranges of rows are numbered apart."""
    n = F.col("number").cast("string")
    return ordinals(df, *order).withColumn("number", F.concat(F.lit(prefix + "-"), F.when(F.length(n) < digits, F.lpad(n, digits, "0")).otherwise(n)))


def criteria(lines: DataFrame) -> DataFrame:
    """Bullet lines of an acceptance-criteria section: after its heading and before the next one, outside code
    fences. lines: item, pos, line."""
    w = Window.partitionBy("item").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("line").rlike(r"^\s*(?:```|~~~)").cast("int")).over(w) % 2 == 1
    heading = F.col("line").rlike(r"^\s*#{1,6}\s")
    on = F.last(F.when(heading & ~fence, F.col("line").rlike(r"(?i)acceptance criteria")), ignorenulls=True).over(w)
    text = F.regexp_extract("line", r"^\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?(.*\S)\s*$", 1)
    return lines.select("item", "pos", "line", fence.alias("fence"), on.alias("on")).where("on AND NOT fence").select("item", "pos", text.alias("text")).where("text != ''")


def page(df: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    """One page of an ordered table, with the total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # total is one row


def ranked_requirements(df: DataFrame, key: str) -> DataFrame:
    """Confirmed first, then unchanged, newest, id."""
    w = Window.partitionBy(key).orderBy(F.desc("confirmed"), "changed_since", F.desc("newest"), "requirement")
    return df.withColumn("rank", F.row_number().over(w))


def fit_budget(entries: DataFrame, key: str, most: int = 3, budget: int = 1200) -> DataFrame:
    """Entries (key, ord, title, body) that fit a character budget per key, in order: of at most so many, a body that
    doesn't fit is cut to what is left with an ellipsis, an entry whose title doesn't fit ends the list. A key's
    entries are cut to the first few before they are gathered."""
    cols = entries.columns
    first = top_with_rest(entries, [key], most, "ord").drop("rank", "more")
    rows = first.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in cols if c != "ord"]))).alias("rows"))
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    shape = first.select(F.struct("ord", *[c for c in cols if c != "ord"]).alias("r")).schema["r"].dataType.simpleString()

    def step(acc: Column, r: Column) -> Column:
        left = acc["left"] - length(r["title"])
        cut = F.when(left > 0, F.concat(F.left(r["body"], left - 1), F.lit("…"))).otherwise("")
        body = F.when(length(r["body"]) > left, cut).otherwise(F.coalesce(r["body"], F.lit("")))
        going = F.struct(F.lit(True).alias("on"), (left - F.length(body)).alias("left"), F.concat(acc["out"], F.array(r.withField("body", body))).alias("out"))
        return F.when(acc["on"] & (left >= 0), going).otherwise(acc.withField("on", F.lit(False)))

    start = F.struct(F.lit(True).alias("on"), F.lit(budget).alias("left"), F.array().cast(f"array<{shape}>").alias("out"))
    return rows.select(F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in cols])


def within_budget(lines: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """The lines whose running size stays within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def pipeline_order(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, place): middleware in registration order, from 1. edges: from_id, to_id, ord."""
    w = Window.partitionBy("from_id").orderBy("ord", "to_id")
    return edges.select("from_id", "to_id", F.row_number().over(w).alias("place"))


def zipped(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both that have the same place under their key, in the given order; what has no counterpart goes."""
    place = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop(order)
    return place(left).join(place(right), [key, "place"])
