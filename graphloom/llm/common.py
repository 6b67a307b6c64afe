"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: The white space that ends a word, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table that is broadcast (of a few numbers each, under 32 MB); rows that make a key hot beyond that.
BROADCAST_ROWS, HOT_ROWS = 1 << 19, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def text_of(c: Column | str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def source_key(*cols: str) -> Column:
    """A string key that tells null from every value, so it can be joined with plain equality."""
    return F.concat_ws(
        "\x01", *[F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c).cast("string"))) for c in cols]
    )


def packed(docs: DataFrame) -> DataFrame:
    """All of a row's columns as one struct, out of the way of the operator's own names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], replaced: dict[str, Column]) -> DataFrame:
    """The packed columns again; a column that an output replaces gives way to it, whatever its case."""
    new = {k.lower() for k in replaced}
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns if c.lower() not in new], *[v.alias(k) for k, v in replaced.items()])


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", weight: str | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """left joined to right, a narrow table with few rows per key, so that a hot key's left rows don't meet in one task.

    right is written and counted: up to most rows are broadcast. Of a larger one, the rows whose weight (the
    number of left rows of the key) is HOT_ROWS or more are broadcast, at most one for so many left rows; the others
    are shuffled. The result is the same either way.
    """
    right = materialize(right)
    if right.count() <= most:
        return left.join(F.broadcast(right), keys, how)
    if weight is None:
        return left.join(right, keys, how)
    hot = F.broadcast(right.where(F.col(weight) >= HOT_ROWS))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(weight) < HOT_ROWS), keys, how)
    return left.join(hot, keys).unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut to rows whose texts (column number text) have about so many bytes together; a longer text is alone."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            end = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
            yield b.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()
