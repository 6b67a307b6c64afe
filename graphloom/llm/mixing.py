"""Mixing sources to target weights, on whole words packed into fixed-length blocks.

1. Targets: the sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; they share 150 % of
   all words, no source more than twice its own size, the excess reshared by weight (water filling,
   solved in closed form over the sources ordered by cap / weight).
2. Each source is one stream of words, cut into blocks of block_words words. Positions come from a prefix
   sum in two levels over a fixed number of parts by a hash of the document, so that a source with a third of
   all rows is many tasks and the second level is as short at every size.
3. A source's draws are its target in blocks, of the mean size that its blocks have: the last may be short, and
   a source capped at twice its size takes every block twice.
4. The draws of a source come in runs of RUN. How many of a run fall on each output shard is drawn by binomial
   splitting: a node of n draws sends Binomial(n, 1/2) of them, the set bits of hashes, to its left half. So
   a shard's source counts are multinomial, under the condition that the sources' totals meet their targets.
5. Whole passes take every block once, so their counts say only which shard a block goes to. In the last, partial pass
   they say which blocks are taken: a shard's counted number of blocks from its own class of block indices, what is
   beyond a class from the next shards with room. No block is taken more than ceil(draws / blocks) <= 2 times.
6. Slots become block indices by pseudorandom permutations (swap-or-not: exact on any number of indices), one per
   source and pass, and one per source and shard in the partial pass.
7. Draws join documents by block index. No Python runs here.

The seed is fixed, so reruns agree; another seed or number of shards is another draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, packed, source_key, spread_join, text_of, unpacked

#: The weights, in turn.
WEIGHTS = (5, 2, 1)
#: Parts of a source in the prefix sum; draws of a run; rounds of the permutation.
PARTS, RUN, ROUNDS = 1 << 12, 1 << 12, 10


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (sk, source, source_size) with weight and target. One row per source goes through one window."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(w) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("all", F.sum("source_size").over(every) * share).withColumn("all_w", F.sum("weight").over(every))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source in this order that the level doesn't fill sets the level of all that follow
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return s.select("sk", "source_size", "weight", F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row per document: d, th (hash of the text), source, sk, size (words) and start (words
    before it in its source). Written once, so that the texts are read and counted once."""
    base = docs.select(
        F.col("doc_id").alias("d"),
        F.xxhash64("text").alias("th"),
        "source",
        source_key("source").alias("sk"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
    )
    base = materialize(base).withColumn("part", F.pmod(F.xxhash64("d", "th"), F.lit(PARTS)))
    lead = Window.partitionBy("sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = base.groupBy("sk", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("sk", "part", F.coalesce(F.sum("n").over(lead), F.lit(0)).alias("lead"))
    within = Window.partitionBy("sk", "part").orderBy("d", "th").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return spread_join(base, parts, ["sk", "part"]).withColumn("start", F.col("lead") + F.col("own")).drop("part", "own", "lead")


def shard_counts(n: Column, shards: int, *key: Column) -> Column:
    """How many of n draws fall on each of the shards, all alike: an array that sums to n. n is at most RUN.

    shards is a power of two. Each level halves every node of the one before: of n draws, as many go left as
    n hash bits are set.
    """
    bits = lambda n, level: F.aggregate(
        F.sequence(F.lit(0), F.floor((n["n"] - 1) / 32).cast("int")), F.lit(0),
        lambda a, i: a + F.bit_count(F.xxhash64(*key, F.lit(level), n["at"], i).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n["n"] - 32 * i, F.lit(32)).cast("int")) - 1)),
    )
    def halved(level: int, half: int):
        def split(x: Column) -> Column:
            left = F.when(x["n"] > 0, bits(x, level)).otherwise(0).cast("int")
            return F.array(F.struct(x["at"].alias("at"), left.alias("n")), F.struct((x["at"] + half).alias("at"), (x["n"] - left).alias("n")))

        return split

    nodes = F.array(F.struct(F.lit(0).alias("at"), n.cast("int").alias("n")))
    for level in range(shards.bit_length() - 1):
        nodes = F.flatten(F.transform(nodes, halved(level, shards >> (level + 1))))
    return F.transform(nodes, lambda x: x["n"])


def permuted(x: Column, n: Column, key: list[Column]) -> Column:
    """The image of x under a keyed permutation of 0 to n - 1, by swap-or-not: a round pairs x with k - x (mod n), k the
    round's key, and a hash of the pair's greater member says whether x becomes the other."""

    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, one)


def run_counts(t: DataFrame, n: str, shards: int, seed: int, part: str) -> DataFrame:
    """A row per run of RUN of a source's n draws: sk, skh, blocks, run and counts (how many of its draws fall on each shard)."""
    t = t.where(F.col(n) > 0)
    # a row per 16 runs, dealt out before it becomes runs
    rows = t.select("sk", "skh", "blocks", F.col(n).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / (RUN * 16)))).alias("r"))
    rows = rows.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sk", "r")
    last = F.floor((F.col("n") - 1) / RUN)
    runs = rows.select("sk", "skh", "blocks", "n", F.explode(F.sequence(F.col("r") * 16, F.least(F.col("r") * 16 + 15, last))).alias("run"))
    return runs.withColumn("counts", shard_counts(F.least(F.col("n") - F.col("run") * RUN, F.lit(RUN)), shards, F.lit(seed), F.lit(part), F.col("skh"), F.col("run")))


def shard_shares(runs: DataFrame, shards: int) -> DataFrame:
    """How many blocks each shard takes in the last, partial pass: sk, skh, blocks, shard, take and before (taken by the shards before).

    A shard takes from the blocks of its own class: those whose index leaves its number when divided by shards. It
    takes as many as the multinomial counts say, at most all; what is beyond goes to the next shards that have room.
    """
    c = runs.select("sk", "skh", "blocks", F.posexplode("counts").alias("shard", "k")).groupBy("sk", "skh", "blocks", "shard").agg(F.sum("k").alias("c"))
    c = c.withColumn("size", F.floor((F.col("blocks") - F.col("shard") + (shards - 1)) / shards)).withColumn("own", F.least("c", "size"))
    mine = Window.partitionBy("sk")
    lead = mine.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("size") - F.col("own")
    over = F.sum(F.col("c") - F.col("own")).over(mine) - F.coalesce(F.sum(free).over(lead), F.lit(0))
    c = c.withColumn("take", F.col("own") + F.greatest(F.least(over, free), F.lit(0)))
    return c.withColumn("before", F.coalesce(F.sum("take").over(lead), F.lit(0))).where("take > 0").select("sk", "skh", "blocks", "shard", "size", "take", "before")


def draws(targets: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """One row per drawn block: sk, shard, slot (its place among the source's draws) and block. shards is a power of two.

    Of a source's draws, whole passes take every block; their slots go through one permutation a pass. In the last,
    partial pass each shard takes its counted number of blocks of its class, through a permutation of its own.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    b = F.ceil(F.col("source_size") / block_words)
    t = targets.where("source_size > 0").withColumn("blocks", b).withColumn("n", F.least(F.round(F.col("target") * b / F.col("source_size")).cast("long"), b * 2))
    t = t.where("n > 0").withColumn("skh", F.xxhash64("sk")).withColumn("passes", F.floor(F.col("n") / F.col("blocks")))
    t = t.withColumn("whole", F.col("passes") * F.col("blocks")).withColumn("rest", F.col("n") - F.col("whole"))
    t = materialize(t.select("sk", "skh", "blocks", "passes", "whole", "rest"))
    runs = run_counts(t, "whole", shards, seed, "whole")
    slots = runs.select("sk", "skh", "blocks", (F.col("run") * RUN).alias("slot"), F.posexplode("counts").alias("shard", "k"), "counts").where("k > 0")
    before = F.aggregate(F.slice("counts", F.lit(1), F.col("shard")), F.lit(0), lambda a, x: a + x)
    slots = slots.select("sk", "skh", "blocks", "shard", F.explode(F.sequence(F.col("slot") + before, F.col("slot") + before + F.col("k") - 1)).alias("slot"))
    key = [F.lit(seed), F.lit(shards), F.col("skh"), F.floor(F.col("slot") / F.col("blocks"))]
    every = slots.select("sk", "shard", "slot", permuted(F.pmod("slot", "blocks"), F.col("blocks"), key).alias("block"))
    shares = shard_shares(run_counts(t, "rest", shards, seed, "rest"), shards).join(F.broadcast(t.select("sk", "whole")), "sk")  # one row per source
    parts = shares.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - 1) / RUN))))
    parts = parts.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sk", "shard", "chunk")
    parts = parts.withColumn("k", F.explode(F.sequence(F.col("chunk") * RUN, F.least(F.col("chunk") * RUN + (RUN - 1), F.col("take") - 1))))
    own = permuted(F.col("k"), F.col("size"), [F.lit(seed), F.col("skh"), F.col("shard")])
    last = parts.select("sk", "shard", (F.col("whole") + F.col("before") + F.col("k")).alias("slot"), (F.col("shard") + own * shards).alias("block"))
    return every.unionByName(last)


def block_words_of(base: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block that it reaches into: sk, start, block, first (the first of its words there, from
    0) and words."""
    end = F.col("start") + F.col("size")
    cover = base.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    lead = F.greatest(F.col("start"), F.col("block") * block_words)
    return cover.withColumn("first", lead - F.col("start")).withColumn("words", F.least(end, (F.col("block") + 1) * block_words) - lead)


def mix_plan(docs: DataFrame, block_words: int = 32, shards: int = 64, seed: int = 20) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source
    and th (hash of the text).

    Null text has size 0 and takes nothing; an empty table gives an empty table. Null is a source of its
    own, last in order. Repeated rows are each a document with words of their own.
    """
    base = materialize(sized(docs))
    targets = materialize(source_targets(sizes_of(base)))
    times = draws(targets, block_words, shards, seed).groupBy("sk", "block").agg(F.count("*").alias("times"))
    cover = block_words_of(base.select("sk", "start", "size"), block_words)
    # the draws come from a table of few rows, which mustn't be taken for their size
    taken = cover.join(times.hint("merge"), ["sk", "block"]).groupBy("sk", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = spread_join(base, targets, ["sk"]).join(taken, ["sk", "start"], "left")
    got = lambda c: F.when(F.col("size") > 0, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return out.select(F.col("d").alias("doc_id"), "size", "source_size", "target", got("taken"), "source", "th")


def sizes_of(base: DataFrame) -> DataFrame:
    return base.groupBy("sk").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))


def mixed_blocks(docs: DataFrame, block_words: int = 32, shards: int = 64, seed: int = 20) -> DataFrame:
    """The mix itself: shard, source, slot, block and text (the block's words, joined by spaces), one row per drawn
    block of the shard. A text's words travel once for each time that they are taken. Null and empty texts have no words;
    an empty table gives an empty table."""
    base = materialize(sized(docs))
    sizes = materialize(sizes_of(base))
    drawn = draws(source_targets(sizes), block_words, shards, seed)
    cover = block_words_of(base, block_words).select("d", "th", "sk", "start", "block", "first", "words").distinct()
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), source_key("source").alias("sk"), F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)).alias("w")).dropDuplicates(["d", "th", "sk"])
    same = cover["d"].eqNullSafe(texts["d"]) & (cover["th"] == texts["th"]) & (cover["sk"] == texts["sk"])
    parts = cover.join(texts, same).select(cover["sk"], "block", "start", F.array_join(F.slice("w", F.col("first").cast("int") + 1, F.col("words").cast("int")), " ").alias("part"))
    blocks = parts.groupBy("sk", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), " ").alias("text"))
    return spread_join(drawn.hint("merge").join(blocks, ["sk", "block"]), sizes.select("sk", "source"), ["sk"]).select("shard", "source", "slot", "block", "text")


def repeat_taken(docs: DataFrame, seed: int = 20, **kw) -> DataFrame:
    """The mixed corpus in whole documents, columns of docs: each row comes taken / size times, rounded up
    or down by a hash of its id, so that a source keeps the words that the mix takes in expectation.

    Rows of one id and text come equally often. Rows without words go.
    """
    none = F.lit(-(2**63))
    luck = (F.xxhash64(F.lit(seed), F.lit("copy"), "doc_id") % (1 << 20)) / (1 << 21) + 0.5
    plan = mix_plan(docs, seed=seed, **kw).where("taken > 0")
    plan = plan.select(F.coalesce("doc_id", none).alias("dk"), "th", F.floor(F.col("taken") / F.col("size") + luck).cast("int").alias("copies"))
    plan = plan.groupBy("dk", "th").agg(F.max("copies").alias("copies"))
    base = packed(docs).withColumn("dk", F.coalesce("row.doc_id", none)).withColumn("th", F.xxhash64("row.text"))
    each = base.join(plan, ["dk", "th"]).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return unpacked(each, docs.columns, {})
