"""Spelling variants: words one edit apart, from forward and reversed sorted dictionaries.

If two words differ by one inserted, deleted or replaced code point and the shorter has m code points, then they share
their first floor(m/2) code points or their last m - floor(m/2). So every word is posted four times: by prefix (the
forward dictionary) and by suffix (the reversed one), for m its own length and one less. The postings are sorted by
ranges of the shared part, and each task scans its ranges block by block.

Skewed blocks are subdivided: of a block that shares p code points at the front and s at the end, the m - s - p between
them are halved again, and a pair is in the block of one more half at the front or, failing that, at the end. Blocks of
more than BLOCK_ROWS postings are subdivided before the sort, in rounds of counts; smaller ones by the task that scans
them, down to FEW words or to blocks whose words share all but one place. Only there pairs are looked at, and verified
code point by code point. A pair counts in exactly one block: that which its common prefix leads to.

Tasks return one row per word and scan (number of near words, best of them), never pairs. Counts of words combine before
they are shuffled. Forms lead to words of ten times the count, so roots are found in a few rounds of pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import lower_ascii, spread_join, text_of

#: The letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
#: Postings of a block beyond which it is subdivided before the sort; words of a block whose pairs are looked at; rows
#: and bytes of words that a task handles at once.
BLOCK_ROWS, FEW, CHUNK_ROWS, CHUNK_BYTES = 1 << 13, 16, 1 << 17, 1 << 23
#: Places that are compared for all pairs at once.
TOGETHER = 64
FOUND = "word string, n_near long, best_n long, best string"


def document_words(docs: DataFrame, least: int = 7, delete_every: int | None = None) -> DataFrame:
    """word and n (long): the maximal runs of letters with at least so many code points, A-Z lower-cased, counted.

    With delete_every, a run for which that number divides h, the crc32 of doc_id:run, loses its code point
    h % length first. Null text has no words; a null doc_id counts as the empty string; repeated rows count each.
    """
    run = F.regexp_extract_all(lower_ascii(text_of()), F.lit(rf"(?<![{LETTERS}])[{LETTERS}]{{{least},}}+"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(run).alias("word"))
    if delete_every:
        words = words.withColumn("h", F.crc32(F.concat(F.col("d"), F.lit(":"), F.col("word"))))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % delete_every == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def postings(words: DataFrame, least: int) -> DataFrame:
    """A row per word, dictionary and least length m of a pair: word, n, m, p and s (code points shared at the front, at the end)."""
    size = F.length("word")
    each = words.withColumn("m", F.explode(F.array(size, size - 1))).where(F.col("m") >= least)
    half = F.floor(F.col("m") / 2).cast("int")
    of = F.explode(F.array(F.struct(half.alias("p"), F.lit(0).alias("s")), F.struct(F.lit(0).alias("p"), (F.col("m") - half).alias("s"))))
    return each.withColumn("x", of).select("word", "n", "m", "x.p", "x.s")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.concat(F.substring("word", F.lit(1), F.col("p")), F.right("word", F.col("s"))))


def subdivided(rows: DataFrame, most: int) -> DataFrame:
    """The postings, with those of blocks of more than most postings in the blocks' halves, and so on."""
    keys, done = ["m", "p", "s", "key"], []
    rows = materialize(keyed(rows))
    while True:
        large = rows.groupBy(*keys).agg(F.count("*").alias("size")).where((F.col("size") > most) & (F.col("m") - F.col("p") - F.col("s") > 1))
        large = materialize(large)
        if large.isEmpty():
            out = rows
            for d in done:
                out = out.unionByName(d)
            return out
        marked = materialize(spread_join(rows, large.withColumn("large", F.lit(True)), keys, "left", weight="size"))
        done.append(marked.where("large IS NULL").drop("size", "large"))
        between = F.col("m") - F.col("p") - F.col("s")
        half = F.floor(between / 2).cast("int")
        both = F.explode(F.array(F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("s") + between - half).alias("s"))))
        rows = materialize(keyed(marked.where("large").select("word", "n", "m", both.alias("x")).select("word", "n", "m", "x.p", "x.s")))


class Words:
    """The words of a chunk as code points, with hashes of their parts."""

    def __init__(self, column: pa.Array):
        self.column = column
        text = "".join(column.to_pylist())
        self.c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.size))
        longest = int(self.size.max()) + 1
        with np.errstate(over="ignore"):
            step = np.full(longest, 0x5851F42D4C957F2D, np.uint64)
            step[0] = 1
            back = np.full(longest, pow(0x5851F42D4C957F2D, -1, 1 << 64), np.uint64)
            back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
            place = np.arange(len(self.c)) - np.repeat(self.at[:-1], self.size)
            self.sums = np.append(np.uint64(0), np.cumsum((self.c.astype(np.uint64) + np.uint64(1)) * self.up[place]))

    def part(self, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A hash of the code points i to j of each word."""
        with np.errstate(over="ignore"):
            return (self.sums[self.at[w] + j] - self.sums[self.at[w] + i]) * self.down[i]

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: np.ndarray, end: bool) -> np.ndarray:
        """How many code points each pair has in common at the front, or at the end; known of them for certain, most at most."""
        out = known.copy()
        x, y = (self.at[a + 1] - 1, self.at[b + 1] - 1) if end else (self.at[a], self.at[b])
        sign = -1 if end else 1
        left = np.flatnonzero(out < most)
        for _ in range(TOGETHER):
            if not len(left):
                return out
            k = sign * out[left]
            left = left[self.c[x[left] + k] == self.c[y[left] + k]]
            out[left] += 1
            left = left[out[left] < most[left]]
        for i in left.tolist():  # the few that agree so far are compared whole
            n = int(most[i] - out[i])
            u, v = int(x[i] + sign * out[i]), int(y[i] + sign * out[i])
            differs = self.c[u : u + n] != self.c[v : v + n] if not end else self.c[u - n + 1 : u + 1][::-1] != self.c[v - n + 1 : v + 1][::-1]
            out[i] += int(np.argmax(differs)) if differs.any() else n
        return out


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by keys, and the number of each sorted row's group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def near_pairs(words: Words, w: np.ndarray, m: np.ndarray, p: np.ndarray, s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows w one edit apart that share a group: the shorter word's number and the other's, each pair once."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while len(w):
        order, g = _numbered(group)
        w, m, p, s = w[order], m[order], p[order], s[order]
        size = np.bincount(g)
        short = words.size[w] == m
        shorts = np.bincount(g, short)
        live = (size > 1) & (shorts > 0)
        between = (m - p - s)[np.append(0, np.cumsum(size))[:-1]]
        ready = live & ((size <= FEW) | (between <= 1))
        # pairs of the groups that are ready: each short word with every word, the other short ones after it
        first = np.append(0, np.cumsum(size))[:-1]
        a = np.flatnonzero(ready[g] & short)
        many = size[g[a]]
        # whole groups at a time, so that no more than so many pairs are held
        upto = np.cumsum(many)
        for lo, hi in _stretches(upto, 1 << 21):
            i = np.repeat(a[lo:hi], many[lo:hi])
            j = np.arange(len(i)) - np.repeat(upto[lo:hi] - many[lo:hi] - (upto[lo - 1] if lo else 0), many[lo:hi]) + first[g[i]]
            use = ~short[j] | (j > i)
            i, j = i[use], j[use]
            x, y = w[i], w[j]
            front = words.common(x, y, p[i], m[i], False)
            mine = (s[i] == 0) | (front < m[i] - s[i])  # the block that the common prefix leads to
            i, x, y, front = i[mine], x[mine], y[mine], front[mine]
            back = words.common(x, y, s[i], m[i], True)
            one = np.where(words.size[y] == m[i], front + back == m[i] - 1, front + back >= m[i])
            pairs.append((x[one], y[one]))
        rest = np.flatnonzero((live & ~ready)[g])
        w, m, p, s, g = w[rest], m[rest], p[rest], s[rest], g[rest]
        half = (m - p - s) // 2
        end = words.size[w] - s
        both = words.part(w, p, p + half), words.part(w, end - (m - p - s - half), end)
        order, number = _numbered(np.concatenate([g, g]), np.repeat([0, 1], len(g)), np.concatenate(both))
        group = np.empty(len(number), np.int64)
        group[order] = number
        w, m, p, s = np.tile(w, 2), np.tile(m, 2), np.concatenate([p + half, p]), np.concatenate([s, m - p - half])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])


def _stretches(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of rows whose sizes, summed in upto, add up to about most."""
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def scanned(chunk: pa.Table) -> pa.RecordBatch:
    """Near words of each word, within the blocks of a chunk of sorted postings."""
    column = chunk.column("word").combine_chunks()
    numbers = column.dictionary_encode()
    words, w = Words(numbers.dictionary), numbers.indices.to_numpy().astype(np.int64)
    m, p, s, n = (chunk.column(c).to_numpy().astype(np.int64) for c in ("m", "p", "s", "n"))
    key = chunk.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    order, g = _numbered(m, p, s, key)
    group = np.empty(len(g), np.int64)
    group[order] = g
    x, y = near_pairs(words, w, m, p, s, group)
    count = np.empty(len(words.size), np.int64)
    count[w] = n
    of, near = np.concatenate([x, y]), np.concatenate([y, x])
    rank = np.empty(len(words.size), np.int64)
    rank[pc.sort_indices(words.column.cast(pa.binary())).to_numpy()] = np.arange(len(rank))
    order = np.lexsort((rank[near], -count[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
    take = lambda k: words.column.take(pa.array(k))
    best = near[first]
    many = np.diff(np.append(first, len(of)))
    return pa.RecordBatch.from_arrays([take(of[first]), pa.array(many, pa.int64()), pa.array(count[best], pa.int64()), take(best)], ["word", "n_near", "best_n", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted postings in chunks of whole blocks."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows < CHUNK_ROWS and size < CHUNK_BYTES:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.slice(t.num_rows - 1)
        same = np.ones(t.num_rows, bool)
        for c in ("m", "p", "s", "key"):
            same &= pc.equal(t.column(c), last.column(c)[0]).to_numpy()
        cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield scanned(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        rows, size = t.num_rows - cut, sum(x.nbytes for x in held)
    if rows:
        yield scanned(pa.Table.from_batches(held))


def near_words(words: DataFrame, least: int = 7, most: int = BLOCK_ROWS) -> DataFrame:
    """For each word that has near ones: word, n_near, best_n and best (the near word of largest n; ties: the smallest)."""
    ship_package(words.sparkSession)
    rows = subdivided(postings(words, least), most)
    rows = rows.repartitionByRange("m", "p", "s", "key").sortWithinPartitions("m", "p", "s", "key")
    found = rows.mapInArrow(_scan, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("x"))
    return found.select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, from word and form: forms followed to the last, in rounds that double the way. Forms have no cycles."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now, before = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))), now
        if now.where("moved").isEmpty():
            return before.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, min_count: int = 2, ratio: int = 10, least: int = 7, most: int = BLOCK_ROWS) -> DataFrame:
    """One row per word (word, n) of at least min_count occurrences: word, form, root, n, n_near and form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n
    (ties: smallest in code point order) if that is ratio times the word's n or more. The root is where forms lead,
    the word itself without one. Words are distinct, of least code points or more; null words and counts are left out.
    An empty table gives an empty table.
    """
    words = materialize(words.select("word", "n").where((F.length("word") >= least) & (F.col("n") >= min_count)))
    near = near_words(words, least, most)
    has = F.col("best_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    out = materialize(out)
    ends = roots(out.where("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
