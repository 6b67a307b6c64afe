"""N-gram Jaccard join: a grouped prefix join on word shingles, and the components of its links.

1. One pass over the texts finds each document's distinct shingles, as 64-bit hashes. Documents with equal
   sets (128-bit fingerprint and size) are one set.
2. Prefix filter: in one global order of the shingles, two sets can only reach the threshold t if their
   first size - ceil(t * size) + 1 shingles meet. The order is by hash, but the shingles that head many
   prefixes come last; which ones do is counted over all documents and only affects the work, so the
   list of them has a fixed bound and is broadcast.
3. Sets with the same prefix and size form one group, and its head posts the prefix once.
4. Group pairs meet on short token lists and count their common prefix tokens. Pairs whose common tokens,
   with all that may be common beyond the prefixes, can't reach the threshold are dropped exactly (count
   and size filter). What is left is expanded to the groups' members and verified on whole texts.
5. Token lists with more than SHORT_LIST sets behind them aren't paired off. Where they hold many sets, what is shared by
   chance or by passages would connect most of a corpus; so their tokens go to the end of the order too, and the sets on
   them, with new groups, post again. A pair that only long lists join has both its sets there.
6. What long lists hold in the end (copies with edits by the thousand): their
   groups form components over shared tokens; a component is expanded to its members and verified in chunks
   of bounded weight. Of a component of several chunks, each is verified alone first; then only the sets outside the
   component's largest cluster go on, against one chunk of that cluster, and what still stays outside against
   all the rest. Groups of several members are such components too.

Both ways are exact and give the same links up to connectivity; the bounds only say which does the work. Links
are only needed up to connectivity, so what leaves a block is linear in its sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize, ship_package
from .common import packed, slices, spread_join, text_of, unpacked
from .shingles import K1, U, mix, shingle_sets

#: A token on this many prefixes goes to the end of the order; at most so many are told to all tasks.
COMMON, COMMON_KEPT = 48, 1 << 20
#: A list of so many sets is paired off. Most sets of a chunk and most shingles of it (about 24 MB of text), of which
#: two meet in a task; a longer set is alone.
SHORT_LIST, BLOCK_SETS, BLOCK_SHINGLES = 64, 2048, 1 << 22
#: A token on so many prefixes is a long list unseen, and is dealt out in parts of about so many rows.
HOT_TOKEN = 1 << 16
#: While long lists hold more sets or shingles than these, their tokens go to the end of the order and the sets post again;
#: prefixes are posted so often at most.
ROUND_SETS, ROUND_SHINGLES, ROUNDS = 1 << 14, 1 << 25, 4
#: Edges that a task contracts at once.
EDGES = 1 << 20
#: Sets of ids up to this size (8 MB) are broadcast, larger ones shuffled.
BROADCAST_IDS = 1 << 20
#: Bytes of text whose shingles are held at once.
SLICE_BYTES = 1 << 22


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def _repeated(seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that are in seen more than twice, and how often; seen is empty then."""
    token, n = np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)]), return_counts=True)
    seen.clear()
    return token[n > 2].view(np.int64), n[n > 2].astype(np.int64)


def common_tokens(texts: DataFrame, width: int, percent: int) -> np.ndarray:
    """Sorted hashes of tokens that head many prefixes in hash order. Counts that a task sees only once
    or twice aren't sent: a token of a notable share of all documents repeats within tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _repeated(seen)], ["token", "n"])

        for b in slices(batches, 0, SLICE_BYTES):
            for s in shingle_sets(b.column(0), width):
                if len(s):
                    seen.append(_prefix(s, s[:0], percent))
            if sum(map(len, seen)) > 1_000_000:
                yield flush()
        yield flush()

    counts = texts.select("t").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return _most_common(counts.where(F.col("n") >= COMMON), COMMON_KEPT)


def _most_common(counts: DataFrame, most: int) -> np.ndarray:
    """The sorted hashes of the so many most frequent tokens (token, n)."""
    top = counts.orderBy(F.desc("n"), "token").limit(most)
    return np.sort(np.array([r[0] for r in top.select("token").toLocalIterator()], np.int64).view(np.uint64))


def _prefix(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set, in memory of its own: prefixes are kept long after their sets."""
    k = int(prefix_sizes(len(s), percent))
    if len(common):
        at = np.searchsorted(common, s)
        late = common[np.minimum(at, len(common) - 1)] == s
        if late.any():
            s = np.concatenate([s[~late], s[late]])
    return s[:k].copy()


def document_sets(texts: DataFrame, width: int, percent: int, common) -> DataFrame:
    """d, th, n (distinct shingles), f1 and f2 (fingerprint of the set), g (hash of prefix and size).

    Rows of n = -1 tell of a token (f1) that a million prefix tokens of a task have more than twice, and how often (f2).
    """
    names = ["d", "th", "n", "f1", "f2", "g"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            token, k = _repeated(seen)
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(token), -1)), pa.array(token), pa.array(k), none], names)

        for b in slices(batches, 2, SLICE_BYTES):
            sets = shingle_sets(b.column(2), width)
            n = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):
                f1 = np.array([np.bitwise_xor.reduce(s * K1 ^ (s >> U(7))) for s in sets], np.uint64)
                f2 = np.array([np.add.reduce(mix(s, s)) for s in sets], np.uint64)
                heads = [_prefix(s, common.value, percent) for s in sets]
                g = mix(np.array([np.add.reduce(mix(p, p >> U(3))) for p in heads], np.uint64), n.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), *[pa.array(x.view(np.int64)) for x in (f1, f2, g)]], names)
            seen += [p for p, s in zip(heads, sets, strict=True) if len(s)]
            if sum(map(len, seen)) > 1_000_000:
                yield flush()
        yield flush()

    return texts.select("d", "th", "t").mapInArrow(describe, "d long, th long, n long, f1 long, f2 long, g long")


def prefix_postings(texts: DataFrame, width: int, percent: int, common) -> DataFrame:
    """token, s (the set's document) and n (its size) for every prefix token."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE_BYTES):
            sets = shingle_sets(b.column(1), width)
            heads = [_prefix(s, common.value, percent) if len(s) else s for s in sets]
            k = np.array([len(h) for h in heads], np.int64)
            n = np.repeat(np.array([len(s) for s in sets], np.int64), k)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(ids), pa.array(n)], ["token", "s", "n"])

    return texts.select("d", "t").mapInArrow(post, "token long, s long, n long")


def shared_postings(posted: DataFrame, hot: DataFrame) -> DataFrame:
    """token, s, n and long of the postings (token, s, n, members) whose token another one has too, once each.

    One exchange brings a token's postings together. Those of hot tokens (token, parts) are dealt in parts, and count as a
    long list without being counted. long: whether more than SHORT_LIST sets are behind the token.
    """
    posted = posted.join(F.broadcast(hot), "token", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("s"), F.col("parts"))))
    same = Window.partitionBy("token", "part")
    counted = posted.withColumns({"k": F.count("*").over(same), "m": F.sum("members").over(same)}).where("k > 1 OR parts IS NOT NULL")
    long = (F.col("parts").isNotNull() | (F.col("m") > SHORT_LIST)).alias("long")
    return counted.select("token", "part", "s", "n", long).distinct().drop("part")


class Union:
    """Union-find over the ids of a block or task."""

    def __init__(self):
        self.root: dict = {}

    def top(self, x):
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x


def forest(edges: DataFrame, *keys: str) -> DataFrame:
    """edges (keys, a, b) with the same components; of the edges that a task holds at once, one star per component is left."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = Union()

        def flush() -> pa.RecordBatch:
            least: dict = {}
            for v in union.root:
                top = union.top(v)
                least[top] = min(v, least.get(top, v))
            found = [(*v, least[union.top(v)][-1]) for v in union.root]
            union.root.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(len(keys) + 2)], [*keys, "a", "b"])

        for batch in batches:
            *of, a, b = (c.to_pylist() for c in batch.columns)
            for *k, x, y in zip(*of, a, b, strict=True):
                union.root[union.top((*k, x))] = union.top((*k, y))
            if len(union.root) > EDGES:
                yield flush()
        yield flush()

    columns = [F.col(c).cast("long").alias(c) for c in (*keys, "a", "b")]
    return edges.select(*columns).mapInArrow(contract, ", ".join(f"{c} long" for c in (*keys, "a", "b")))


def only(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """df joined to a table of ids, which is broadcast only where it has been counted and is small."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def chunks_of(sets: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1))


def blocked(pairs: DataFrame, rows: int) -> DataFrame:
    """pairs (a, b, na, nb), so many rows, with block: pairs of one small component of candidates share a block, so that its texts
    travel once; the pairs of a larger one are dealt by b and, where b has many, by parts of its partners."""
    parts = connected_components(forest(pairs), rows=rows)
    sized = parts.join(pairs.select(F.col("a").alias("id"), F.col("na").alias("n")).union(pairs.select("b", "nb")).distinct(), "id")
    size = sized.groupBy("component").agg(chunks_of(F.count("*"), F.sum("n")).alias("chunks"))
    homes = parts.join(size, "component").select(F.col("id").alias("b"), F.when(F.col("chunks") == 1, F.col("component")).alias("home"))
    degree = pairs.groupBy("b").agg(chunks_of(F.count("*"), F.sum("na")).alias("k")).join(homes, "b")
    own = F.xxhash64(F.lit("b"), "b", F.pmod(F.xxhash64("a"), F.col("k")))
    return pairs.join(degree, "b").select("a", "b", F.when(F.col("home").isNotNull(), F.xxhash64(F.lit("home"), "home")).otherwise(own).alias("block"))


def with_texts(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members (block, d, ...) with their texts; a small list of members is broadcast, a larger one shuffled."""
    return texts.select("d", "t").join(F.broadcast(members) if members.count() <= BROADCAST_IDS else members, "d")


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def _sets(table: pa.Table, width: int) -> list[np.ndarray]:
    """The shingle sets of a block's texts, hashed SLICE_BYTES at a time."""
    texts = pa.RecordBatch.from_arrays([_column(table, "t")], ["t"])
    return [s for b in slices(iter([texts]), 0, SLICE_BYTES) for s in shingle_sets(b.column(0), width)]


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([r[0] for r in found], pa.int64()), "b": pa.array([r[1] for r in found], pa.int64())})


def verify_pairs(left: pa.Table, right: pa.Table, width: int, percent: int) -> pa.Table:
    """The listed pairs (right: a, b) of a block that link on their whole texts (left: d, t). A pair that earlier
    links already connect isn't looked at."""
    sets: dict[int, list[np.ndarray]] = {}
    for d, s in zip(left.column("d").to_pylist(), _sets(left, width), strict=True):
        sets.setdefault(d, []).append(s)
    union, out = Union(), []
    for a, b in sorted(zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True)):
        ra, rb = union.top(a), union.top(b)
        if ra == rb:
            continue
        for x, y in ((x, y) for x in sets[a] for y in sets[b]):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                union.root[ra] = rb
                out.append((a, b))
                break
    return _links(out)


def verify_chunks(table: pa.Table, width: int, percent: int) -> pa.Table:
    """The links within a chunk, or only between its two sides (across), that connect something new. rows: d, t, side,
    own, root (sets of one root are known to be connected).

    A prefix join of its own, with shingles ordered by their frequency here, finds the candidates; the likeliest
    are verified first, and those that a link has meanwhile connected are left out. Pairs of which neither
    set is of the block's own size band are left to another block.
    """
    ids, side, own = (table.column(c).to_numpy() for c in ("d", "side", "own"))
    across = table.column("across")[0].as_py()
    known = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
    sets = _sets(table, width)
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, n))
    order = order[n[order] > 0]
    ids, side, own, known, n, sets = ids[order], side[order], own[order], known[order], n[order], [sets[i] for i in order.tolist()]
    if not len(n):
        return _links([])
    entry = np.concatenate(sets)
    del sets
    entry = np.unique(entry, return_inverse=True)[1].astype(np.int32)
    starts = np.cumsum(n) - n
    head = prefix_sizes(n, percent)
    often, heads = np.bincount(entry), []
    for at, k, h in zip(starts.tolist(), n.tolist(), head.tolist(), strict=True):
        x = entry[at : at + k]
        heads.append(x[np.lexsort((x, often[x]))[:h]])
    heads = np.concatenate(heads)
    first = np.cumsum(head) - head
    owner = np.repeat(np.arange(len(n)), head)
    by_token = np.argsort(heads, kind="stable")
    lists, bounds = owner[by_token], np.append(0, np.cumsum(np.bincount(heads, minlength=int(entry.max()) + 1)))
    root, mark, out = known, np.zeros(len(bounds), np.int64), []
    for i in range(len(n)):
        tokens = heads[first[i] : first[i] + head[i]]
        c = np.bincount(np.concatenate([lists[bounds[k] : bounds[k + 1]] for k in tokens.tolist()]), minlength=len(n))[:i]
        j = np.flatnonzero(c)
        fit = (100 * n[j] >= percent * n[i]) & (root[j] != root[i]) & (own[j] | own[i])
        fit &= (c[j] + np.maximum(n[i] - head[i], n[j] - head[j])) * (100 + percent) >= (n[i] + n[j]) * percent
        if across:
            fit &= side[j] != side[i]
        j = j[fit]
        j = j[np.argsort(-c[j], kind="stable")]
        if len(j):
            mark[entry[starts[i] : starts[i] + n[i]]] = 1
        while len(j):
            now, j = j[:16], j[16:]
            shared = np.array([mark[entry[starts[k] : starts[k] + n[k]]].sum() for k in now.tolist()])
            for k in now[100 * shared >= percent * (n[i] + n[now] - shared)].tolist():
                if root[k] != root[i]:
                    root[root == root[k]] = root[i]
                    out.append((int(ids[i]), int(ids[k])))
            j = j[root[j] != root[i]]
        mark[entry[starts[i] : starts[i] + n[i]]] = 0
    return _links(out)


def short_list_pairs(short: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """Pairs (a > b) of sets on a common short list that the count filter can't drop.

    Common tokens up to the lesser of the two prefixes' ends are all in both prefixes. So the overlap is at
    most: the common short-list tokens, the long-list tokens of the set that has fewer, and what lies
    beyond the prefix of one of the two.
    """
    # tokens of one list count together: copies share a list over and over
    lists = short.repartition("token").groupBy("token").agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("l")).groupBy("l").agg(F.count("*").alias("k"))
    each = lists.select("k", "l", F.posexplode("l").alias("i", "y"))
    met = each.select("k", "y", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("x"))
    meet = (F.col("x.s") > F.col("y.s")) & (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    pairs = met.where(meet).groupBy(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.sum("k").alias("c"))
    many = long.groupBy("s").agg(F.countDistinct("token").alias("h"))
    pairs = pairs.join(many.withColumnsRenamed({"s": "a", "h": "ha"}), "a", "left").join(many.withColumnsRenamed({"s": "b", "h": "hb"}), "b", "left").na.fill(0, ["ha", "hb"])
    beyond = lambda n: F.floor((F.col(n) * percent + 99) / 100) - 1  # noqa: E731  size less prefix
    most = F.col("c") + F.least("ha", "hb") + F.greatest(beyond("na"), beyond("nb"))
    return pairs.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b", "na", "nb")


def long_list_members(long: DataFrame, inside: DataFrame, percent: int) -> DataFrame:
    """(component, d, n, own): the members of the groups of each component over long lists.

    Sizes fall into bands such that links stay within a band or join neighbours. A band's sets (own) meet each
    other and those of the band below; a list counts once per band, so that components don't run through
    sizes that can't link.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + F.lit(1e-9))
    listed = long.select("s", "n", "token", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))).alias("x")).select("s", "n", "token", "x.*")
    first = listed.groupBy("token", "band").agg(F.min("s").alias("b"), F.bool_or("own").alias("some"), F.count("*").alias("k")).where("some").drop("some")
    edges = spread_join(listed, first, ["token", "band"], weight="k").select("band", "own", "n", F.col("s").alias("a"), "b")
    edges = materialize(edges)
    at = lambda c: F.struct("band", F.col(c).alias("s"))
    heads = edges.select(at("a").alias("id"), "own", "n").distinct()
    links = forest(edges, "band").select(at("a").alias("a"), at("b").alias("b"))
    parts = heads.join(connected_components(links, rows=edges.count()), "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = parts.select("component", F.col("id.s").alias("head"), "own", "n")
    members = heads.join(inside.select("head", "s"), "head", "left")
    return members.select("component", F.coalesce("s", "head").alias("d"), "n", "own")


def verified(blocks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The links of blocks (block, d, side, own, root, across)."""
    return with_texts(blocks, texts).groupBy("block").applyInArrow(lambda t: verify_chunks(t, width, percent), "a long, b long")


def long_list_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The links of all components' members (component, d, n, own), a written table, up to connectivity.

    Components of one chunk are one block. Of others, chunks are verified alone; the largest cluster that links make is
    the component's main one. The sets outside are verified against one chunk of it, and those that are outside
    still against each other and the other chunks: sets that are connected already are never compared.
    """
    size = members.groupBy("component").agg(chunks_of(F.count("*"), F.sum("n")).alias("chunks"), F.count("*").alias("k"))
    dealt = materialize(spread_join(members, size, ["component"], weight="k").withColumn("side", F.pmod(F.xxhash64("d"), F.col("chunks"))))
    alone = dealt.select(F.xxhash64("component", F.lit("alone"), "side").alias("block"), "d", "side", "own", F.col("d").alias("root"), F.lit(False).alias("across"))
    links = materialize(verified(materialize(alone), texts, width, percent))
    large = materialize(dealt.where("chunks > 1").select("component", "d", "n", "own"))
    rows = large.count()
    if not rows:
        return links

    def clustered(links: DataFrame) -> DataFrame:
        """large with root, main (whether it is in its component's main cluster) and chunk, within its kind."""
        roots = large.join(connected_components(forest(links), rows=links.count()).withColumnsRenamed({"id": "d", "component": "root"}), "d", "left").withColumn("root", F.coalesce("root", "d"))
        most = roots.groupBy("component", "root").agg(F.count("*").alias("k")).groupBy("component").agg(F.max_by("root", F.struct("k", "root")).alias("top"))
        out = spread_join(roots, most, ["component"]).withColumn("main", F.col("root") == F.col("top")).drop("top")
        count = out.groupBy("component", "main").agg(chunks_of(F.count("*"), F.sum("n")).alias("chunks"))
        return materialize(spread_join(out, count, ["component", "main"]).withColumn("chunk", F.pmod(F.xxhash64("d", F.lit("chunk")), F.col("chunks"))), rows)

    def across(rest: DataFrame, main: DataFrame, name: str) -> DataFrame:
        """Blocks of every chunk of rest with every chunk of main."""
        u = rest.select("component", F.col("chunk").alias("u")).distinct()
        v = main.select("component", F.col("chunk").alias("v")).distinct()
        block = F.xxhash64("component", F.lit(name), "u", "v").alias("block")
        left = rest.withColumnRenamed("chunk", "u").join(v, "component").select(block, "d", F.lit(0).cast("long").alias("side"), "own", "root", F.lit(True).alias("across"))
        right = main.withColumnRenamed("chunk", "v").join(u, "component").select(block, "d", F.lit(1).cast("long").alias("side"), "own", "root", F.lit(True).alias("across"))
        return left.union(right)

    first = clustered(links)
    rest, main = first.where("NOT main"), first.where("main AND chunk = 0")
    links = materialize(links.union(verified(materialize(across(rest, main, "one")), texts, width, percent)))
    second = clustered(links)
    rest, main = second.where("NOT main"), second.where("main")
    if rest.isEmpty():
        return links
    w = rest.select("component", F.col("chunk").alias("w")).distinct()
    low, high = F.least("chunk", "w"), F.greatest("chunk", "w")
    inner = rest.join(w, "component").select(F.xxhash64("component", F.lit("rest"), low, high).alias("block"), "d", F.col("chunk").alias("side"), "own", "root", (F.col("chunk") != F.col("w")).alias("across"))
    return links.union(verified(materialize(inner.union(across(rest, main, "all"))), texts, width, percent))


def described_sets(texts: DataFrame, width: int, percent: int, told) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """What document_sets tells, written: rows of documents, the sets of those with an id (f1, f2, n, s, g, copies), hot
    tokens (token, parts) and the number of rows. The least document stands for an equal set."""
    described = materialize(document_sets(texts, width, percent, told))
    rows = described.count()
    some = described.where("n > 0 AND d IS NOT NULL")
    sets = materialize(some.groupBy("f1", "f2", "n").agg(F.min("d").alias("s"), F.first("g").alias("g"), F.count("*").alias("copies")), rows)
    hot = described.where("n < 0").groupBy(F.col("f1").alias("token")).agg(F.sum("f2").alias("k")).where(F.col("k") >= HOT_TOKEN)
    return described.where("n >= 0"), sets, hot.select("token", F.ceil(F.col("k") / HOT_TOKEN).alias("parts")), rows


def met_on_lists(texts: DataFrame, width: int, percent: int, told, described: tuple) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of the described texts (d, t): pairs (a, b, na, nb) of sets that meet on short lists and pass the filter, long lists
    (token, s, n) of groups' heads, the groups of several as lists of their own, and their members (head, s, members)."""
    docs_sets, sets, hot, rows = described
    # the least set's document stands for a group
    heads = materialize(sets.groupBy("g").agg(F.min("s").alias("d"), F.first("n").alias("n"), F.count("*").alias("members")), rows)
    extra = materialize(docs_sets.select("d").where("d IS NOT NULL").distinct().join(heads, "d", "left_anti"), rows)
    several = heads.where("members > 1").select("g", F.col("d").alias("head"), "n", "members")
    inside = materialize(sets.join(several.drop("n"), "g").select("head", "s", "members"), rows)

    # groups post their prefixes; lists are counted in sets
    posted = prefix_postings(only(texts.where("d IS NOT NULL"), extra, "d", "left_anti"), width, percent, told)
    posted = spread_join(posted, several.select(F.col("head").alias("s"), "members"), ["s"], "left").na.fill(1, ["members"])
    shared = materialize(shared_postings(posted, hot))
    short, long = shared.where("NOT long").drop("long"), shared.where("long").drop("long")

    # group pairs that pass the filter are expanded to their members: at most SHORT_LIST in both groups together
    pairs = materialize(short_list_pairs(short, long, percent))
    of = inside.select("head", "s")
    for side in "ab":
        pairs = pairs.join(of.withColumnsRenamed({"head": side, "s": "m"}), side, "left").withColumn(side, F.coalesce("m", side)).drop("m")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(F.col("a") > F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") > F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    return materialize(pairs), long.select("token", "s", "n"), several.select(F.col("g").alias("token"), F.col("head").alias("s"), "n"), inside


def met_in_rounds(texts: DataFrame, width: int, percent: int, common: np.ndarray, told, described: tuple) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b, na, nb) that short lists leave, and what is left on long lists (token, s, n) of groups (head, s, members).

    Any order has every pair on some list. A pair that a round has on no short list has both its sets on long ones, so they
    all go on to the next round; there the long lists' tokens are the last, so that its lists are shorter.
    """
    pairs, long, groups, inside = met_on_lists(texts, width, percent, told, described)
    for _ in range(ROUNDS - 1):
        on = long.select("s", "n").union(groups.select("s", "n")).distinct().join(inside.select(F.col("head").alias("s"), F.col("s").alias("m")), "s", "left")
        on = materialize(on.select(F.coalesce("m", "s").alias("d"), "n").distinct())
        sets, shingles = on.agg(F.count("*"), F.sum("n")).first()
        if sets <= ROUND_SETS and (shingles or 0) <= ROUND_SHINGLES:
            break
        late = np.setdiff1d(_most_common(long.groupBy("token").agg(F.count("*").alias("n")), COMMON_KEPT), common)[: max(0, COMMON_KEPT - len(common))]
        if not len(late):
            break
        common = np.union1d(common, late)
        told = texts.sparkSession.sparkContext.broadcast(common)
        # further documents do no harm: a text is only left out where that saves more than it costs
        some = texts if 2 * sets > described[-1] else only(texts, on.select("d").distinct(), "d")
        described = described_sets(some, width, percent, told)
        more, long, groups, inside = met_on_lists(some, width, percent, told, described)
        pairs = pairs.union(more)
    return pairs, long.union(groups), inside


def linked_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), n_shingles, component_id.

    Two documents link if 100 * intersection >= percent * union of their sets of distinct shingles of width
    words (A-Z lower-cased; with fewer words the whole sequence is the one shingle). Null or empty text
    has no shingle, links with nothing and is its own component. Rows of one doc_id are one vertex that
    links as any of them does, and each gets a row; rows without doc_id link with nothing and have no
    component. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), text_of().alias("t"))
    common = common_tokens(texts, width, percent)
    told = spark.sparkContext.broadcast(common)
    described = described_sets(texts, width, percent, told)
    docs_sets, sets, _, rows = described
    pairs, long, inside = met_in_rounds(texts, width, percent, common, told, described)
    found_pairs = pairs.count()
    pairs = materialize(blocked(pairs, found_pairs), found_pairs)
    need = materialize(pairs.select("block", F.col("a").alias("d")).union(pairs.select("block", "b")).distinct(), found_pairs)
    found = with_texts(need, texts).groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(lambda x, y: verify_pairs(x, y, width, percent), "a long, b long")

    alike = long_list_links(materialize(long_list_members(long, inside, percent), 2 * rows), texts, width, percent)
    # written first: a task that verifies and contracts at once would hold two Python workers
    links = materialize(forest(materialize(found).union(materialize(alike))))
    parts = connected_components(links, rows=links.count())

    named = sets.join(parts.withColumnRenamed("id", "s"), "s", "left").select("f1", "f2", "n", "copies", F.coalesce("component", "s").alias("c"))
    out = spread_join(docs_sets, named, ["f1", "f2", "n"], "left", weight="copies")
    component = F.when((F.col("n") > 0) & F.col("d").isNotNull(), F.col("c")).otherwise(F.col("d"))
    return out.select(F.col("d").alias("doc_id"), "th", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of least id; documents alone stay, as do rows without doc_id.
    Null and empty texts link with nothing and stay; repeated rows of the id that stays all stay; an empty table gives
    an empty table."""
    none = F.lit(-(2**63))
    out = linked_documents(docs, width, percent).where("doc_id IS NULL OR doc_id = component_id").select(F.coalesce("doc_id", none).alias("dk"), "th").distinct()
    base = packed(docs).withColumn("dk", F.coalesce("row.doc_id", none)).withColumn("th", F.xxhash64("row.text"))
    return unpacked(base.join(out, ["dk", "th"], "left_semi"), docs.columns, {})
