"""Periodic runs of words, by harmonic grid probing.

A run is a maximal stretch of words with smallest period q that is at least max(6, 4 q) words long. Such a stretch
holds four consecutive points of any grid of spacing q, so for each period p only the words at the grid's points are
compared: those at jp and (j + 1)p. All periods together cost n/1 + n/2 + n/3 + ... comparisons. Where three
neighbouring pairs agree, the point survives and its stretch is extended both ways, comparing arrays in chunks that
double in size. Grid points within runs found before are skipped: of the same period, and of periods that divide p,
as a stretch of period p that overlaps such a run by 3p words is that run.

The texts of a batch lie one after another with a word between them that equals no other, so a period is probed in
all of them with one comparison of two strided views. Words are numbered by dictionary, not hashed: the result is
exact. Nothing is shuffled; memory is bounded by a batch of BATCH_BYTES or, beyond that, by one text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import WORD, packed, slices, text_of, unpacked
from .shingles import utf8

#: Bytes of text to a batch, and words compared at first when a stretch is extended.
BATCH_BYTES, CHUNK, LONGEST_CHUNK = 1 << 20, 64, 1 << 16
#: Least words of a run, and least periods.
LEAST, TIMES = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word of all rows, equal for equal words; the words' first and last bytes; each row's first word."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.append(0, np.cumsum(e - s)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[~space]))])
    return words.dictionary_encode().indices.to_numpy(), s, e, np.searchsorted(s, offsets)


def _agree(w: np.ndarray, i: int, p: int, step: int) -> int:
    """How many of i, i + step, i + 2 step, ... have the word at p places on in common with the word there, until one hasn't."""
    n, size = 0, CHUNK
    while True:
        most = len(w) - p - i - n if step > 0 else i - n + 1
        size = min(size, most)
        if size <= 0:
            return n
        a = i + n if step > 0 else i - n - size + 1
        differs = np.flatnonzero(w[a : a + size] != w[a + p : a + p + size])
        if len(differs):
            return n + int(differs[0] if step > 0 else size - 1 - differs[-1])
        n += size
        size = min(2 * size, LONGEST_CHUNK)


def runs_of(w: np.ndarray, longest: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of w as (start, end, period). longest[k] is the place up to which texts of 4 k words or more reach."""
    out: list[tuple[int, int, int]] = []
    found: dict[int, tuple[list[int], list[int]]] = {}  # period: starts and ends, in order
    for p in range(1, len(longest)):
        x = w[: longest[p] : p]
        same = x[1:] == x[:-1]
        if len(same) < 3:
            continue
        alive = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if not len(alive):
            continue
        within = [found[q] for q in found if p % q == 0]
        done = 0
        for at in (alive * p).tolist():
            if at < done:
                continue
            skip = False
            for starts, ends in within:
                k = bisect_right(starts, at) - 1
                skip = skip or (k >= 0 and ends[k] > at + 3 * p)
            if skip:
                continue
            b = done = at + _agree(w, at, p, 1)
            if b <= at + 2 * p:
                continue  # the four points agree, not what lies between them
            a = at - _agree(w, at - 1, p, -1)
            if b - a + p >= max(LEAST, TIMES * p):
                out.append((a, b + p, p))
                starts, ends = found.setdefault(p, ([], []))
                starts.append(a)
                ends.append(b + p)
    return out


def _batch(part: pa.RecordBatch) -> pa.RecordBatch:
    """The rows with their runs and what is left of them."""
    data, offsets = utf8(part.column(1))
    rows = part.num_rows
    words, s, e, bounds = word_numbers(data, offsets)
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")  # longest first, so that long periods look at the first texts alone
    at = np.empty(rows, np.int64)
    at[order] = np.append(0, np.cumsum(n[order] + 1))[:-1]
    w = np.empty(len(words) + rows, np.int64)
    w[at + n] = -1 - np.arange(rows)
    row = np.repeat(np.arange(rows), n)
    w[np.arange(len(words)) - bounds[:-1][row] + at[row]] = words
    most = int(n.max()) // TIMES if rows else 0
    reach = np.append(0, np.cumsum(n[order] + 1))
    longest = np.append(0, reach[np.searchsorted(-n[order], -TIMES * np.arange(1, most + 1), "right")])
    found = runs_of(w, longest)
    # places in w back to rows and their words
    starts, lasts, periods = (np.array([r[k] for r in found], np.int64) for k in range(3))
    of = order[np.searchsorted(reach, starts, "right") - 1] if len(found) else starts
    begins, lengths = starts - at[of], lasts - starts
    sort = np.lexsort((periods, begins, of))
    lists = np.append(0, np.cumsum(np.bincount(of, minlength=rows)))
    runs = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays([pa.array(v[sort]) for v in (begins, lengths, periods)], ["start", "length", "period"]))
    # what any run holds after its first period goes
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, bounds[of] + begins + periods, 1)
    np.add.at(depth, bounds[of] + begins + lengths, -1)
    keep = np.cumsum(depth[:-1]) == 0
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s[keep]] += 1
    inside[e[keep]] -= 1
    kept = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # the first white space after a kept word stays as the space to the next kept word of the row
    k = np.flatnonzero(keep)
    joins = k[:-1][row[k[:-1]] == row[k[1:]]] if len(k) else k
    text = data.copy()
    text[e[joins]], kept[e[joins]] = 32, True
    cut = np.append(0, np.cumsum(kept))[offsets].astype(np.int64)
    collapsed = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(text[kept])))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), runs.cast(RUNS_TYPE), collapsed.cast(pa.string())], ["row", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs (in order of start, then period) and collapsed (the words that no run holds after its
    first period, joined by one space).

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Every row is judged by itself,
    repeated ones alike. Columns of docs that are named like an output give way to it; an empty table gives an empty table.
    """
    ship_package(docs.sparkSession)
    base = packed(docs).withColumn("t", text_of("row.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, BATCH_BYTES):
            yield _batch(part)

    schema = base.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema
    out = base.mapInArrow(run, schema)
    return unpacked(out, docs.columns, {c: F.col(c) for c in ("n_words", "runs", "collapsed")})


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs with a run planted in the texts whose id's crc32 is a multiple of 10: from word a on, p words repeat to the end.
    Such a text is its words joined by spaces. Rows without doc_id stay."""
    w = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))
    n, h = F.size(w), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = lambda c: c.cast("int")
    unit = F.slice(w, whole(a + 1), whole(p))
    words = F.slice(F.concat(F.slice(w, F.lit(1), whole(a)), F.flatten(F.array_repeat(unit, whole(F.ceil((n - a) / p))))), F.lit(1), n)
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").rlike(WORD), F.array_join(words, " ")).otherwise(F.col("text")))


def listed(runs: Column) -> Column:
    """start,length,period of each run, a line each."""
    return F.array_join(F.transform(runs, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")


def longest_run(runs: Column) -> Column:
    """The longest run (ties: least start, then period) as a struct of length, start and period, the latter two negated."""
    return F.array_max(F.transform(runs, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
