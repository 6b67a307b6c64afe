"""Suffix-array dedup by bucket-pointer refinement: bytes of long strings that a smaller doc_id also holds go.

Suffixes only have to be told apart to the depth of the string length (50). Documents are dealt once into
blocks of about BLOCK_BYTES by a hash of doc_id, and most suffixes are settled by their first bucket:

  round 1  Each 50-byte window has one anchor, its 24-gram of least hash; equal windows have equal anchors. The
           anchors' 24-gram buckets are counted over all blocks. What starts at an anchor whose bucket holds one
           document is unique: such a bucket is final, as in any bucket sort.
  round 2  A run of windows with one anchor is a span (76 bytes at most). A span that a smaller document also has goes
           whole; of each distinct span only the least document remains, where its bucket holds several spans.
  round 3  The suffixes in what remains are sorted within their block by bucket-pointer refinement: from buckets of 8
           bytes on, unfinished buckets alone are split by the bucket pointers at the later offset that their depth
           reaches, from a stack, each time with the pointers that the splits before have refined. Each
           bucket of depth 50 then takes one name, a 64-bit hash of its string, and meets the other blocks'.

In a round a block sends a key once, whatever number of its documents have it, and gets one bit for it; so a
string that a third of all documents share costs one key a block. Keys are dealt by their own hash, so that no
part collects the spans around one very common string. A row holds all keys of a block for a part, as a segment
of a shuffle does: total / BLOCK_BYTES times total / PART_BYTES rows. The text is shuffled once: all rounds read
the same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import text_of
from .shingles import U, mix, utf8

#: Depth of the first buckets; bytes of text to a block, and to a part of the keys.
Q, BLOCK_BYTES, PART_BYTES = 24, 5_000_000, 20_000_000
#: Depth of the first buckets in the blocks' suffix sort.
SHORT_Q = 8
#: Suffixes that are refined at once, a batch of the stack.
BATCH = 1 << 16
#: Window starts that are handled at once.
STRETCH = 1 << 19
#: Kinds of keys: anchors' buckets, spans, the spans' buckets, windows.
ANCHOR, SPAN, BUCKET, WINDOW = 1, 2, 3, 4

REPLY = "block long, kind int, part long, bits binary, n long"
SENT = "kind int, part long, block long, x binary, y binary, d binary"


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view("<u8").ravel() if len(at) else np.zeros(0, np.uint64)


def _q_bucket(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(_eight(data, at), _eight(data, at + 8)), _eight(data, at + 16))


def _name(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the length bytes from each position; Q <= length <= 3 * Q."""
    far = _q_bucket(data, at + (length - Q))
    return mix(mix(_q_bucket(data, at), _q_bucket(data, at + min(Q, length - Q))), far)


def suffix_buckets(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The rank of the suffix at each start among all, told apart to the given depth, by bucket-pointer refinement.

    text holds depth bytes from each start. Every suffix points to its bucket, by the place of the bucket's first suffix in
    the sorted order; a bucket knows to what depth its suffixes agree. Buckets of several suffixes that agree to less than
    depth are unfinished and wait on a stack. One batch of them at a time is sorted on the pointers at the later offsets
    that the buckets' depths reach, and split; the new pointers are written at once, so that what is refined next reads
    them, and with them the depth that they have reached by then. What is still unfinished goes back on the stack.
    Buckets of one suffix, and finished ones, are never sorted again. Ranks follow the byte order of the strings.
    """
    n = len(text)
    padded = np.append(text, np.zeros(SHORT_Q, np.uint8))
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, SHORT_Q)[:n]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order][1:] != first[order][:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    pointer = np.zeros(n + depth + SHORT_Q, np.uint64)  # 0 beyond the text; a bucket's place plus one
    pointer[order] = np.repeat(begin, size).astype(np.uint64) + U(1)
    reach = np.full(n + 2, SHORT_Q, np.int32)  # by pointer
    alive = order[np.repeat(size > 1, size)]
    stack = []
    while len(alive):  # whole buckets to a batch
        at = min(len(alive), BATCH)
        if at < len(alive):
            at += int(np.argmax(pointer[alive[at:]] != pointer[alive[at - 1]])) if pointer[alive[-1]] != pointer[alive[at - 1]] else len(alive) - at
        stack.append(alive[:at])
        alive = alive[at:]
    while stack:
        batch = stack.pop()
        own = pointer[batch]
        far = reach[own.astype(np.int64)]
        later = pointer[batch + far]
        key = own << U(32) | later
        by = np.argsort(key, kind="stable")
        key, batch, own = key[by], batch[by], own[by]
        split, edge = np.ones(len(key), bool), np.ones(len(key), bool)
        split[1:] = key[1:] != key[:-1]
        edge[1:] = own[1:] != own[:-1]
        at = np.flatnonzero(split)
        size = np.diff(np.append(at, len(key)))
        lead = np.flatnonzero(edge)
        place = at - np.repeat(lead, np.diff(np.append(np.searchsorted(at, lead), len(at))))  # within the bucket it comes from
        pointers = own[at] + place.astype(np.uint64)
        depths = np.minimum(far[by][at] + reach[(key[at] & U(0xFFFFFFFF)).astype(np.int64)], depth)
        pointer[batch] = np.repeat(pointers, size)
        reach[pointers.astype(np.int64)] = depths
        rest = batch[np.repeat((size > 1) & (depths < depth), size)]
        if len(rest):
            stack.append(rest)
    # pointers may tell suffixes apart beyond depth; neighbours in the order that agree to depth have one rank
    order = np.argsort(pointer[starts], kind="stable")
    s = starts[order]
    new = np.zeros(len(s), bool)
    for k in (*range(0, depth - 8, 8), depth - 8):
        x = _eight(text, s + k)
        new[1:] |= x[1:] != x[:-1]
    out = np.empty(len(s), np.uint64)
    out[order] = np.cumsum(new)
    return out


def _anchors(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor, first and last window start of each span. offsets bound the rows; only wanted rows count."""
    use = np.flatnonzero((np.diff(offsets) >= length) & wanted)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[offsets[:-1][use]] = 1
    edge[offsets[1:][use] - length + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8)
    width = length - Q + 1
    anchors, firsts, lasts = [], [], []
    before, of_before = -2, -1
    for a in range(0, len(data), STRETCH):
        s = np.flatnonzero(valid[a : a + STRETCH])
        if not len(s):
            continue
        x = data[a : min(len(data), a + STRETCH + length)].astype(np.uint64)
        x = x[:-1] | x[1:] << U(8)
        x = x[:-2] | x[2:] << U(16)
        x = x[:-4] | x[4:] << U(32)
        h = mix(mix(x[:-16], x[8:-8]), x[16:])
        h &= ~U((1 << 24) - 1)
        h |= np.arange(len(h), dtype=np.uint64)
        done = 1
        while done < width:  # minimum over width neighbours; of equal hashes the first
            step = min(done, width - done)
            h = np.minimum(h[:-step], h[step:])
            done += step
        chosen = (h[s] & U((1 << 24) - 1)).astype(np.int64) + a
        s = s + a
        new = np.ones(len(s), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (s[1:] != s[:-1] + 1)
        new[0] = s[0] != before + 1 or chosen[0] != of_before
        first = np.flatnonzero(new)
        ends = np.where(first > 0, s[first - 1], before)
        lasts.append(ends if firsts else ends[1:])
        firsts.append(s[first])
        anchors.append(chosen[first])
        before, of_before = int(s[-1]), int(chosen[-1])
    if not firsts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(anchors), np.concatenate(firsts), np.append(np.concatenate(lasts), before)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the order that sorts all keys, and where each run of equal ones begins in it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    return s[at], order, at


def _classes(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the least document of each, and each row's class."""
    distinct, order, at = _runs(keys)
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
    least = np.minimum.reduceat(doc[order], at) if len(at) else np.zeros(0, np.int64)
    return distinct, least, of


class Block:
    """A block's documents and what each round finds in it. Nothing depends on the order of its rows."""

    def __init__(self, table: pa.Table, parts: int, length: int):
        t = table.combine_chunks()
        column = t.column("t")
        self.data, self.offsets = utf8(column.chunk(0) if column.num_chunks else pa.array([], pa.string()))
        ids = t.column("d")
        self.known = ~ids.is_null().to_numpy()
        self.d = ids.fill_null(0).to_numpy().astype(np.int64)
        self.parts, self.length = parts, length
        self.p, self.s1, self.s2 = _anchors(self.data, self.offsets, self.known, length)
        self.g = _q_bucket(self.data, self.p)
        self.doc = self.d[np.searchsorted(self.offsets, self.s1, "right") - 1] if len(self.p) else np.zeros(0, np.int64)

    def code(self) -> np.ndarray:
        """The anchors' buckets as part and 32 bits. Buckets that agree in these are kept together, no more."""
        return part_of(self.g, self.parts) << U(32) | (self.g & U(0xFFFFFFFF))

    def keep(self, which: np.ndarray) -> None:
        self.p, self.s1, self.s2, self.g, self.doc = (x[which] for x in (self.p, self.s1, self.s2, self.g, self.doc))

    def recurring(self, told: dict[int, np.ndarray]) -> None:
        """Keeps the anchors that another block has, or another document of this one."""
        code = self.code()
        distinct, order, at = _runs(code)
        found = told[ANCHOR]
        if len(at):
            d = self.doc[order]
            found = found | (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at))
        which = np.empty(len(code), bool)
        which[order] = np.repeat(found, np.diff(np.append(at, len(code))))
        self.keep(which)

    def span_names(self) -> np.ndarray:
        shape = (self.s2 - self.s1).astype(np.uint64) << U(8) | (self.p - self.s1).astype(np.uint64)
        return mix(mix(_name(self.data, self.s1, self.length), _name(self.data, self.s2, self.length)), shape)

    def settle_spans(self, told: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the spans that go whole; those whose windows are still in question are kept."""
        names = self.span_names()
        _, least, of = _classes(names, self.doc)
        goes = told[SPAN][of] | (self.doc > least[of])
        _, _, bucket = _classes(self.g, self.doc)
        s1, s2 = self.s1[goes], self.s2[goes]
        self.keep(~goes & told[BUCKET][bucket])
        return s1, s2

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and class of each window of the kept spans; the classes' names and least documents, by name."""
        n = self.s2 - self.s1 + 1
        starts = np.repeat(self.s1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = np.repeat(self.doc, n)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint64), doc
        size = len(self.data) + 1
        inside = np.cumsum((np.bincount(self.s1, minlength=size) - np.bincount(self.s2 + self.length, minlength=size))[:-1]) > 0
        place = np.cumsum(inside) - 1
        rank = suffix_buckets(self.data[inside], place[starts], self.length)
        distinct, least, of = _classes(rank, doc)
        one = np.empty(len(distinct), np.int64)
        one[of] = starts
        names = _name(self.data, one, self.length)
        # two strings of one name would be one class in every block
        named, least_named, of_named = _classes(names, least)
        return starts, of_named[of], named, least_named


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; it grows with the key."""
    return (keys >> U(32)) * U(parts) >> U(32)


def _sent(kind: int, block: int, part: np.ndarray, columns: dict[str, np.ndarray]) -> list[dict]:
    """A row for each part: part is sorted. Without keys there is none."""
    if not len(part):
        return []
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(cut[1:], len(part))
    return [{"kind": kind, "part": int(part[a]), "block": block, **{k: v[a:b].tobytes() for k, v in columns.items()}} for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]


SENT_TYPE = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("d", pa.binary())])
REPLY_TYPE = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("bits", pa.binary()), ("n", pa.int64())])


def _told(table: pa.Table) -> dict[int, np.ndarray]:
    """The answers of each kind, in the order of the keys."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "bits", "n")), strict=True))
    return {k: np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for kind, _, b, n in rows if kind == k]]) for k in (ANCHOR, SPAN, BUCKET, WINDOW)}


def answer(table: pa.Table) -> pa.Table:
    """A bit for each key that the blocks sent to a part: whether another block has the anchor's bucket, whether a
    smaller document of another block has the span or window, whether the bucket holds several spans."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    cat = lambda c, t: np.concatenate([np.frombuffer(x or b"", t) for x in table.column(c).to_pylist()])
    keys = cat("x", np.uint32 if kind == ANCHOR else np.uint64)
    width = 4 if kind == ANCHOR else 8
    n = [len(x) // width for x in table.column("x").to_pylist()]
    _, order, at = _runs(keys)
    size = np.diff(np.append(at, len(keys)))
    bits = np.empty(len(keys), bool)
    if kind == ANCHOR:
        bits[order] = np.repeat(size > 1, size)
    elif kind == BUCKET:
        low, high = cat("y", np.uint64)[order], cat("d", np.uint64)[order]
        bits[order] = np.repeat(np.minimum.reduceat(low, at) != np.maximum.reduceat(high, at), size)
    else:
        doc = cat("d", np.int64)[order]
        bits[order] = np.repeat(np.minimum.reduceat(doc, at), size) < doc
    cut = np.append(0, np.cumsum(n))
    each = [np.packbits(bits[a:b]).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return pa.table([table.column("block").combine_chunks(), pa.array([kind] * len(n), pa.int32()), pa.array([part] * len(n), pa.int64()), pa.array(each, pa.binary()), pa.array(n, pa.int64())], schema=REPLY_TYPE)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), n_bytes, n_removed, n_spans (maximal removed runs)
    and kept (binary, the remaining bytes).

    Every byte goes that is covered by a string of length bytes which also starts in a document with a
    smaller doc_id, judged on the input's UTF-8 bytes; matches don't cross documents. Null text is
    empty. Rows of one doc_id are alike: neither is smaller, each gets a row. Rows without doc_id lose
    nothing and take nothing. length is from 24 to 72; an empty table gives an empty table.
    """
    if not Q <= length <= 3 * Q:
        raise ValueError(f"length must be from {Q} to {3 * Q}")
    ship_package(docs.sparkSession)
    base = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), text_of().alias("t"))
    total = base.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n_blocks, parts = max(16, -(-total // BLOCK_BYTES)), max(16, -(-total // PART_BYTES))
    base = base.withColumn("block", F.pmod(F.xxhash64(F.coalesce("d", "th")), F.lit(n_blocks)))
    blocks = base.groupBy("block")

    def number(left: pa.Table) -> int:
        return left.column("block")[0].as_py()

    def send_1(left: pa.Table) -> pa.Table:
        code = _runs(Block(left, parts, length).code())[0]
        return pa.Table.from_pylist(_sent(ANCHOR, number(left), code >> U(32), {"x": code.astype(np.uint32)}), SENT_TYPE)

    def send_2(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SENT_TYPE.empty_table()
        b = Block(left, parts, length)
        b.recurring(_told(right))
        names = b.span_names()
        x, least, _ = _classes(names, b.doc)
        g, order, at = _runs(b.g)
        low, high = (f.reduceat(names[order], at) if len(at) else names for f in (np.minimum, np.maximum))
        rows = _sent(SPAN, number(left), part_of(x, parts), {"x": x, "d": least})
        return pa.Table.from_pylist(rows + _sent(BUCKET, number(left), part_of(g, parts), {"x": g, "y": low, "d": high}), SENT_TYPE)

    def send_3(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SENT_TYPE.empty_table()
        b, told = Block(left, parts, length), _told(right)
        b.recurring(told)
        b.settle_spans(told)
        _, _, names, least = b.windows()
        return pa.Table.from_pylist(_sent(WINDOW, number(left), part_of(names, parts), {"x": names, "d": least}), SENT_TYPE)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b, told = Block(left, parts, length), _told(right)
        b.recurring(told)
        s1, s2 = b.settle_spans(told)
        doc = np.repeat(b.doc, b.s2 - b.s1 + 1)
        s, of, names, least = b.windows()
        if len(told[WINDOW]) != len(names):
            raise AssertionError("a block changed between rounds")
        s = s[told[WINDOW][of] | (doc > least[of])] if len(s) else s
        size = len(b.data) + 1
        depth = np.bincount(np.concatenate([s1, s]), minlength=size) - np.bincount(np.concatenate([s2, s]) + length, minlength=size)
        gone = np.cumsum(depth[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        at = b.offsets[:-1]
        inner = at[at < len(gone)]
        begins[inner] |= gone[inner]
        sums = lambda v: np.diff(np.append(0, np.cumsum(v))[b.offsets])
        removed, spans = sums(gone), sums(begins)
        rest = b.data[~gone]
        bounds = np.append(0, np.cumsum(np.diff(b.offsets) - removed)).astype(np.int64)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(rest)])
        return pa.table({"doc_id": left.column("d"), "th": left.column("th"), "n_bytes": pa.array(np.diff(b.offsets)), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(spans.astype(np.int64)), "kept": kept.cast(pa.binary())})

    answered = lambda sent: sent.groupBy("kind", "part").applyInArrow(answer, REPLY)
    r1 = answered(blocks.applyInArrow(send_1, SENT))
    r2 = r1.union(answered(blocks.cogroup(r1.groupBy("block")).applyInArrow(send_2, SENT)))
    r3 = r2.union(answered(blocks.cogroup(r2.groupBy("block")).applyInArrow(send_3, SENT)))
    return blocks.cogroup(r3.groupBy("block")).applyInArrow(finish, "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept binary")
