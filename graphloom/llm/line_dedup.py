"""Line dedup: lines whose normalised key is found in many documents are dropped everywhere.

Lines are exploded with their positions, keys are hashed to 128 bits, distinct documents are counted
per hash with partial aggregation, and only the positions to drop travel back to the documents. The
common hashes are counted: a small table of them is broadcast, and of a large one the hottest, so that a very
common line's places aren't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, lower_ascii, packed, spread_join, text_of, unpacked


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with each line dropped whose key has min_chars code points and is in min_docs documents.

    Adds n_lines (before dropping) and n_dropped, and replaces text; other columns stay.
    Null or empty text is one empty line and comes back as the empty string. A document is a doc_id:
    rows that repeat one count once, and rows without one count together as one document. Repeated
    rows are each returned. An empty table gives an empty table.
    """
    base = packed(docs).select("row", F.col("row.doc_id").alias("d"), text_of("row.text").alias("t"))
    base = base.withColumn("th", F.xxhash64("t"))
    lines = (
        base.select("d", "th", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
        .select("d", "th", "pos", line_key(F.col("line")).alias("k"))
        .where(F.length("k") >= min_chars)
        .select("d", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))
    )
    common = (
        lines.groupBy("h1", "h2")
        .agg(F.countDistinct(F.coalesce("d", F.lit(-(2**63)))).alias("n"))
        .where(F.col("n") >= min_docs)
    )
    drops = (
        spread_join(lines, common, ["h1", "h2"], weight="n")
        .groupBy(F.coalesce("d", F.lit(-(2**63))).alias("dk"), "th")
        .agg(F.collect_set("pos").alias("drop"))
    )
    joined = base.withColumn("dk", F.coalesce("d", F.lit(-(2**63)))).join(drops, ["dk", "th"], "left")
    joined = joined.withColumn("lines", F.split("t", "\n"))
    n = F.size("lines")
    keep = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("t")).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return unpacked(
        joined,
        docs.columns,
        {"text": kept, "n_lines": n.cast("long"), "n_dropped": F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long")},
    )
