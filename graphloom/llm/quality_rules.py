"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

The base statistics are computed within the row by built-in functions. The method takes a transformed
statistic vector per document, fits a minimum-covariance-determinant (MCD) estimate for each
(lang, source) by concentration steps, and rejects documents by their squared Mahalanobis distance.
An estimate of n rows is drawn towards its language's: the two are mixed with weights n and PRIOR, at
every size of group, so that a group of few rows is judged mostly by its language.

A concentration step is two aggregations over the narrow vector table: a histogram of distances per
group gives the distance that holds the h closest rows, then sums over those rows give the next mean
and covariance. Only groups meet in a task, never a group's rows. Two starts run side by side (all rows;
medians and quartile ranges) and the smaller determinant wins. No Python runs here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACES, packed, source_key, spread_join, text_of, unpacked

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: Words of the shortest document that passes the base rules.
LEAST_WORDS = 50
#: Least standard deviation of each feature, from its own resolution: lengths that differ by a factor of 2 (of words,
#: 1.5) are two of them; the least event in the shortest document (one symbol, one line, one repeat of 3 words) is three.
FLOORS = (math.log(2) / 2, math.log(1.5) / 2, math.sqrt(1 / LEAST_WORDS) / 3, math.sqrt(10 / LEAST_WORDS) / 3, math.sqrt(6 / LEAST_WORDS) / 3)
P = len(FEATURES)
#: Chi-square with 5 and 7 degrees of freedom: consistency of the covariance of the closest 3/4.
COVERAGE, CONSISTENCY = 0.75, 1.412
#: Squared distance above which a document goes (chi-square with 5 degrees of freedom, tail 1e-6).
CUTOFF = 35.9
#: Rows that the language's estimate counts for in that of a group.
PRIOR = 30
STEPS = 3
BINS = 16


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeat_words(h: Column) -> Column:
    """Words in 3-word windows that are found twice or more, from the windows' hashes: windows are sorted with
    their positions, equal neighbours mark windows, and the marked windows' words are counted once each."""
    n = F.size(h)
    order = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), n - 1).alias("p")))

    def marked(o: Column) -> Column:
        same = F.zip_with(o, F.slice(o, 2, F.size(o)), lambda x, y: F.when(x["h"] == y["h"], F.struct(x["p"].alias("a"), y["p"].alias("b"))))
        words = lambda x: F.array(x["a"], x["a"] + 1, x["a"] + 2, x["b"], x["b"] + 1, x["b"] + 2)
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(same, lambda x: x.isNotNull()), words))))

    # the sorted windows are an element of an array, so that they are sorted once
    return F.when(F.size(F.array_distinct(h)) < n, F.get(F.transform(F.array(order), marked), F.lit(0))).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """Packed rows and the base statistics. Null text: no words."""
    t = F.col("t")
    df = packed(docs).withColumn("t", text_of("row.text")).withColumn("w", F.transform(words_of(t), lambda x: F.xxhash64(x)))
    df = df.withColumn("n_words", F.size("w"))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    windows = F.slice(joined(joined("w", F.slice("w", 2, F.col("n_words"))), F.slice("w", 3, F.col("n_words"))), F.lit(1), F.col("n_words") - 2)
    df = df.withColumn("h", F.when(F.col("n_words") > 3, windows)).drop("w")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return df.select(
        "row",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col("h").isNull(), 0).otherwise(repeat_words(F.col("h"))).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """lang and source keys and the transformed features of the rows that pass the base rules."""
    n = F.col("n_words").cast("double")
    return stats.select(
        "*",
        F.log(n + 1).alias("f_words"),
        F.log(F.col("word_chars") / n).alias("f_length"),
        F.sqrt(F.col("n_symbols") / n).alias("f_symbols"),
        F.sqrt(F.col("n_dup_lines") / n * 10).alias("f_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("f_repeats"),
    )


def moments(extra: list[Column] = ()) -> list[Column]:
    x = [F.col(f) for f in FEATURES]
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)], *extra]


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MEANS, COVARIANCES = [f"mu{i}" for i in range(P)], [f"c{i}{j}" for i, j in PAIRS]


def from_sums(est: DataFrame) -> DataFrame:
    """Means and covariances from sums; rounded so that the order of summation doesn't show. Keeps g and start."""
    n = F.col("n")
    mu = [F.round(F.col(f"s{i}") / n, 9).alias(f"mu{i}") for i in range(P)]
    return est.select("g", "start", *mu, *[F.round(F.col(f"q{i}{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n, 9).alias(f"c{i}{j}") for i, j in PAIRS])


def cholesky(est: DataFrame) -> DataFrame:
    """Adds columns l{i}{j} of the factor of (consistency * covariance + floors), and ld, its log determinant."""
    for i, j in PAIRS:
        v = F.col(f"c{i}{j}") * CONSISTENCY + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 / 4))) if i == j else v / F.col(f"l{j}{j}"))
    return est.withColumn("ld", sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0)))


def distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i, f in enumerate(FEATURES):
        v = F.col(f) - F.col(f"mu{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", v / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))
    return df.withColumn("d2", d2).drop(*[f"z{i}" for i in range(P)])


def estimates(vec: DataFrame) -> DataFrame:
    """The MCD estimate (n, means, covariances) of each group: vec has g and FEATURES."""
    whole = vec.groupBy("g").agg(*moments()).withColumn("start", F.lit("all"))
    q = [F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, f in enumerate(FEATURES)]
    robust = vec.groupBy("g").agg(F.count("*").alias("n"), *q).select(
        "g", "n", F.lit("quartiles").alias("start"), *[F.col(f"p{i}")[1].alias(f"mu{i}") for i in range(P)],
        *[(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    robust = materialize(robust)
    est = cholesky(from_sums(whole).unionByName(robust.drop("n")))
    for _ in range(STEPS):
        rows = distance(spread_join(vec, est, ["g"])).withColumn("bin", F.floor(F.log2(F.col("d2") + 1) * BINS).cast("int")).select("g", "start", "bin", *FEATURES)
        along = Window.partitionBy("g", "start").orderBy("bin")
        every = Window.partitionBy("g", "start")
        hist = rows.groupBy("g", "start", "bin").agg(F.count("*").alias("k"))
        hist = hist.withColumn("upto", F.sum("k").over(along)).withColumn("h", F.sum("k").over(every) * COVERAGE)
        edge = hist.where("upto >= h").groupBy("g", "start").agg(F.min("bin").alias("edge"))
        near = spread_join(rows, edge, ["g", "start"]).where("bin <= edge")
        est = cholesky(from_sums(near.groupBy("g", "start").agg(*moments())))
    best = Window.partitionBy("g").orderBy("ld", "start")
    est = est.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("g", *MEANS, *COVARIANCES)
    return materialize(est.join(robust.select("g", "n"), "g"))


def shrunk(est: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each group's estimate mixed with that of its pool, with weights n and PRIOR: pairs has g and pool."""
    both = [*MEANS, *COVARIANCES]
    pool = est.select(F.col("g").alias("pool"), *[F.col(c).alias(f"p_{c}") for c in both])
    w = F.col("n") / (F.col("n") + PRIOR)
    mixed = lambda c: w * F.col(c) + (1 - w) * F.col(f"p_{c}")
    apart = lambda i: F.col(f"mu{i}") - F.col(f"p_mu{i}")
    out = est.join(pairs, "g").join(pool, "pool")
    return out.select("g", *[mixed(c).alias(c) for c in MEANS], *[(mixed(f"c{i}{j}") + w * (1 - w) * apart(i) * apart(j)).alias(f"c{i}{j}") for i, j in PAIRS])


def judged(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept, d2 and th (hash of the text).

    Null text has no words and fails the base rules, as does empty text. Null lang or source is a value
    of its own. Repeated rows are judged alike; an empty table gives an empty table.
    """
    stats = statistics(docs.select("doc_id", "text", "lang", "source"))
    keys = [F.concat(F.lit("l"), source_key("row.lang")).alias("pool"), F.concat(F.lit("s"), source_key("row.lang", "row.source")).alias("g")]
    stats = stats.select(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("th"), *keys, *[c for c in stats.columns if c != "row"])
    stats = materialize(stats)
    good = vectors(stats.where("not base_failed"))
    est = estimates(good.select(F.explode(F.array("g", "pool")).alias("g"), *FEATURES))
    est = cholesky(shrunk(est, good.select("g", "pool").distinct())).drop("ld", *COVARIANCES)
    out = distance(spread_join(good, est, ["g"])).withColumn("kept", F.col("d2") <= CUTOFF)
    bad = stats.where("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "th"]
    return out.select(*names).unionByName(bad.select(*names))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Null and empty texts go; repeated rows are kept or go
    together; an empty table gives an empty table."""
    none = F.lit(-(2**63))
    kept = judged(docs).where("kept").select(F.coalesce("doc_id", none).alias("dk"), "th").distinct()
    base = packed(docs).withColumn("dk", F.coalesce("row.doc_id", none)).withColumn("th", F.xxhash64("row.text"))
    return unpacked(base.join(kept, ["dk", "th"], "left_semi"), docs.columns, {})
