"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors of one label are collapsed first. The upper levels of the trees are fitted on a bounded sample (SAMPLE
vectors, least hashes of vec_id): each node splits at the sample's median along a random direction. Every vector is
then routed through every tree; within MARGIN of a split it goes both ways (spill), so that a linked pair
seldom parts. Leaves that hold more than LEAF_CAP vectors of a label are split on, in rounds, at the median of their own
vectors along a further random direction, so that leaves stay as small at every size of table. Vectors are compared
with the others of their label in each leaf, by cosine in double precision, so every link is verified.

A leaf returns one row per vector, not pairs: its number of links that no earlier leaf of both vectors
has counted, and its component within the leaf. A leaf that splitting doesn't shrink (most of its vectors lie within
the margin: one dense cluster) is compared chunk by chunk, each pair of chunks a group of its own; none is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize, ship_package
from .common import spread_join

SAMPLE, TREES, LEAF, LEAST_SAMPLE, LEAF_CAP = 16_384, 6, 1024, 32, 4096
#: Half the width of the overlap at a split, in units of the projected length of a threshold pair's difference.
MARGIN = 0.4
#: A leaf is split if at most this share of its vectors goes both ways.
MOST_SPILL = 0.5
BLOCK_ROWS = 512
#: Most vectors that are broadcast.
BROADCAST_VECTORS = 1 << 13


def fit_forest(sample: np.ndarray, n: int, threshold: float, trees: int, seed: int) -> tuple[list[list], float]:
    """Trees as lists of nodes (direction, split, left, right) or None for a leaf; and the margin."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    depth = int(np.ceil(np.log2(max(n, 1) / LEAF))) if n > LEAF else 0
    forest = []
    for _ in range(trees):
        nodes: list = [None]
        work = [(0, np.arange(len(sample)), 0)]
        while work:
            at, rows, level = work.pop()
            if level >= depth or len(rows) < LEAST_SAMPLE:
                continue
            r = rng.standard_normal(dim)
            r /= np.linalg.norm(r)
            p = sample[rows] @ r
            split = float(np.median(p))
            nodes[at] = (r, split, len(nodes), len(nodes) + 1)
            work += [(len(nodes), rows[p < split], level + 1), (len(nodes) + 1, rows[p >= split], level + 1)]
            nodes += [None, None]
        forest.append(nodes)
    return forest, MARGIN * float(np.sqrt(2 - 2 * threshold)) / np.sqrt(dim)


def route(forest: list[list], margin: float, x: np.ndarray) -> list[np.ndarray]:
    """The sorted leaf codes (tree << 32 | node) of each row of unit vectors."""
    found: list[list[int]] = [[] for _ in range(len(x))]
    for t, nodes in enumerate(forest):
        work = [(0, np.arange(len(x)))]
        while work:
            at, rows = work.pop()
            if nodes[at] is None:
                for i in rows:
                    found[i].append(t << 32 | at)
                continue
            r, split, left, right = nodes[at]
            p = x[rows] @ r
            work += [(left, rows[p < split + margin]), (right, rows[p >= split - margin])]
    return [np.sort(np.array(f, np.int64)) for f in found]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, in dim columns: shorter ones are filled with zeros, what is longer is left out after scaling."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(n) - n
    out = np.zeros((len(n), dim))
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.add.reduceat(np.append(flat * flat, 0.0), start)) if len(n) else n
    for i in range(len(n)):
        k = min(dim, n[i])
        out[i, :k] = flat[start[i] : start[i] + k] / norm[i]
    return out


def compare(table: pa.Table, threshold: float) -> pa.Table:
    """The links of one leaf, or of two chunks of it, as counts and local components."""
    t = table.combine_chunks()
    col = lambda c: t.column(c).chunk(0)
    order = np.argsort(col("v").to_numpy(), kind="stable")
    v, k, side = (col(c).to_numpy()[order] for c in ("v", "k", "side"))
    e = col("e")
    x = _matrix(e, int(e.value_lengths()[0].as_py()))[order]
    here, ids = t.column("leaf")[0].as_py(), t.column("u")[0].as_py() != t.column("w")[0].as_py()
    codes = [np.array(c, np.int64) for c in col("codes").to_pylist()]
    codes = [codes[i] for i in order]
    linked = np.zeros((len(v), len(v)), bool)
    for a in range(0, len(v), BLOCK_ROWS):
        near = x[a : a + BLOCK_ROWS] @ x.T >= threshold
        near[np.arange(len(near)), a + np.arange(len(near))] = False
        if ids:
            near &= side[a : a + BLOCK_ROWS, None] != side[None, :]
        linked[a : a + BLOCK_ROWS] = near
    # only vectors with links go on
    some = np.flatnonzero(linked.any(axis=1))
    linked, v, k, codes = linked[np.ix_(some, some)], v[some], k[some], [codes[i] for i in some.tolist()]
    early = np.unique(np.concatenate([np.zeros(0, np.int64), *[c[c < here] for c in codes]]))
    member = np.zeros((len(v), len(early)), np.float32)
    for i, c in enumerate(codes):
        member[i, np.searchsorted(early, c[c < here])] = 1
    links = np.zeros(len(v), np.int64)
    root = np.arange(len(v))
    for a in range(0, len(v), BLOCK_ROWS):
        near = linked[a : a + BLOCK_ROWS]
        if len(early):
            fresh = near & (member[a : a + BLOCK_ROWS] @ member.T == 0)
        else:
            fresh = near
        links[a : a + BLOCK_ROWS] = fresh @ k
        for i in np.flatnonzero(fresh.any(axis=1)):
            row = np.flatnonzero(fresh[i])
            both = np.unique(root[np.append(row, a + i)])
            if len(both) > 1:
                root[np.isin(root, both[1:])] = both[0]
    some = links > 0
    return pa.table({"v": pa.array(v[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(v[root][some], pa.int64())})


def split_on(placed: DataFrame, threshold: float, dim: int, seed: int) -> DataFrame:
    """placed (v, e, label, k, codes, dim) with codes of leaves that hold at most LEAF_CAP vectors of a label and
    dimension, but for those that splitting doesn't shrink. A round splits all larger leaves at once, each at the median
    of its own projections: the larger leaves' vectors are shuffled once a round to be projected, then only
    (v, leaf, projection) rows. A leaf's children have hashes for codes."""
    keys = ["label", "dim", "leaf"]
    at = placed.select("v", "label", "dim", F.explode("codes").alias("leaf"))
    whole = at.limit(0).select(*keys)
    margin = MARGIN * float(np.sqrt(2 - 2 * threshold)) / np.sqrt(dim)
    changed = False

    def project(batches):
        directions: dict[int, np.ndarray] = {}
        for b in batches:
            x = _matrix(b.column(1), dim)
            p = np.empty(len(x))
            for i, leaf in enumerate(b.column(4).to_pylist()):
                if leaf not in directions:
                    if len(directions) > 10_000:
                        directions.clear()
                    r = np.random.default_rng([seed, leaf & 0xFFFFFFFF, leaf >> 32 & 0xFFFFFFFF]).standard_normal(dim)
                    directions[leaf] = r / np.linalg.norm(r)
                p[i] = x[i] @ directions[leaf]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(p)], ["v", "label", "dim", "leaf", "p"])

    while True:
        large = materialize(at.groupBy(*keys).agg(F.count("*").alias("m")).where(F.col("m") > LEAF_CAP).join(whole, keys, "left_anti"))
        if large.isEmpty():
            break
        some = spread_join(at, large, keys, weight="m").select("v", "leaf")
        some = some.join(placed.select("v", "e", "label", "dim"), "v").select("v", "e", "label", "dim", "leaf")
        shape = some.select("v", "label", "dim", "leaf", F.lit(0.0).alias("p")).schema
        along = materialize(some.mapInArrow(project, shape))
        middle = along.groupBy(*keys).agg(F.percentile_approx("p", 0.5, 1000).alias("s"), F.count("*").alias("m"))
        along = spread_join(along, middle, keys, weight="m")
        low, high = F.col("p") < F.col("s") + margin, F.col("p") >= F.col("s") - margin
        shrinks = along.groupBy(*keys).agg(F.avg(F.when(low & high, 1.0).otherwise(0.0)).alias("both"), F.avg(F.when(low, 1.0).otherwise(0.0)).alias("left"), F.count("*").alias("m"))
        shrinks = materialize(shrinks.withColumn("go", (F.col("both") <= MOST_SPILL) & F.col("left").between(0.05, 0.95)))
        whole = materialize(whole.union(shrinks.where("NOT go").select(*keys)))
        going = shrinks.where("go").select(*keys, "m")
        child = lambda side: F.xxhash64(F.lit(side), "leaf")
        children = F.filter(F.array(F.when(low, child(0)), F.when(high, child(1))), lambda x: x.isNotNull())
        fresh = spread_join(along, going, keys, weight="m").select("v", "label", "dim", F.explode(children).alias("leaf"))
        at = materialize(at.join(going.select(*keys), keys, "left_anti").select("v", "label", "dim", "leaf").unionByName(fresh))
        changed = True
    if not changed:
        return placed
    codes = at.groupBy("v").agg(F.sort_array(F.collect_list("leaf")).alias("codes"))
    return materialize(placed.drop("codes").join(codes, "v").select("v", "e", "label", "k", "codes", "dim"))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, seed: int = 10) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (least vec_id
    reachable), kept (vec_id = component_id).

    Vectors link within a label and a dimension if their cosine is at least threshold. Null labels,
    null, empty and zero vectors, and vectors with null or non-finite components link with nothing, as do
    rows without vec_id; each is kept. Equal rows link with each other. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col("vec_id").alias("v"), F.col("label").alias("label"), F.col("embedding").alias("e"))
    fit = F.coalesce(F.forall("e", lambda c: c.isNotNull() & (c - c == 0)) & F.exists("e", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("fit", fit & F.col("label").isNotNull() & F.col("v").isNotNull())
    same = rows.where("fit").groupBy("label", "e").agg(F.min("v").alias("v"), F.count("*").alias("k"))
    reps = materialize(same)
    n = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # vectors meet within labels
    sample = reps.select("v", "e").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(SAMPLE).toArrow()
    e = sample.column("e").combine_chunks()
    e = e.chunk(0) if isinstance(e, pa.ChunkedArray) else e
    dim = max([1, *e.value_lengths().to_pylist()]) if len(e) else 1
    forest = spark.sparkContext.broadcast((*fit_forest(_matrix(e, dim) if len(e) else np.zeros((0, 1)), n, threshold, trees, seed), dim))

    def leaves(batches):
        nodes, margin, dim = forest.value
        for b in batches:
            codes = route(nodes, margin, _matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.list_(pa.int64()))], ["v", "e", "label", "k", "codes"])

    label, kind = (vectors.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    placed = reps.select("v", "e", "label", "k").mapInArrow(leaves, f"v long, e {kind}, label {label}, k long, codes array<long>")
    placed = materialize(placed.select("*", F.size("e").alias("dim")))
    placed = split_on(placed, threshold, dim, seed)
    each = placed.withColumn("leaf", F.explode("codes"))
    sizes = placed.select("label", "dim", F.explode("codes").alias("leaf")).groupBy("label", "dim", "leaf").agg(F.count("*").alias("m")).where("m > 1")
    chunks = F.ceil(F.col("m") / LEAF_CAP)
    each = spread_join(each, sizes, ["label", "dim", "leaf"], weight="m").withColumn("side", F.pmod(F.xxhash64(F.lit(seed), "v"), chunks))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    each = each.select("label", "dim", "leaf", F.least("side", "other").alias("u"), F.greatest("side", "other").alias("w"), "side", "v", "k", "e", "codes")
    found = materialize(each.groupBy("label", "dim", "leaf", "u", "w").applyInArrow(lambda t: compare(t, threshold), "v long, links long, root long"))
    counts = found.groupBy("v").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    about = reps.join(counts, "v", "left").join(parts.withColumnRenamed("id", "v"), "v", "left")
    about = about.select("label", "e", "k", (F.col("k") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "v").alias("c"))
    out = spread_join(rows.where("fit").select("v", "label", "e"), about, ["label", "e"], weight="k", most=BROADCAST_VECTORS).select("v", "n", "c").unionByName(rows.where("NOT fit").select("v", F.lit(0).cast("long").alias("n"), F.col("v").alias("c")))
    return out.select(F.col("v").alias("vec_id"), F.col("n").alias("n_links"), F.col("c").cast("long").alias("component_id"), F.coalesce(F.col("v") == F.col("c"), F.lit(True)).alias("kept"))
