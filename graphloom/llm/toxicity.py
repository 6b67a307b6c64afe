"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters. Lexicons are mined from a bounded sample of labelled documents that aren't held out: starts of words and whole
   words that toxic documents hold (at one of three densities) and clean ones hardly do. Each (density, kind, half) is a
   voter: 1 where the text holds enough of its entries, 0 where fewer, -1 where none. Pattern voters look at marks,
   capitals, masked and stretched words, forms of address, and address next to an entry.
2. Label model. The votes of all documents are counted by pattern. Expectation-maximisation estimates, for each voter,
   how it votes given the class and given the voter that it depends on most: a tree of the voter pairs with most
   conditional mutual information, so that voters which say the same thing twice don't count twice. It starts from
   the labelled sample, whose counts keep as much weight as all unlabelled documents together.
3. Classifier. A logistic regression on votes and densities is trained on the label model's posteriors of the sample's
   documents. It alone scores: whole texts, in place.

The texts are read twice, by Arrow batches of bounded size, and never shuffled; what is shuffled is vote patterns. The
label model's counts are added up by SUMMERS tasks, whatever the input's size. Near copies in the sample share their weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import WORD, packed, slices, text_of, unpacked
from .shingles import K1, U, mix, utf8

#: Bounds of the labelled sample: documents of each class, in order of a hash of doc_id, and words of all together.
SAMPLE_DOCS, SAMPLE_WORDS = 1500, 1_500_000
#: Code points of the entries that are starts of words; a whole word counts to LONGEST, and then by its length.
STARTS, LONGEST = (4, 5, 6), 16
KINDS = len(STARTS) + 1
#: Densities: least occurrences, and words of text that each occurrence may stand for.
LEVELS = ((1, 1 << 40), (1, 400), (2, 100))
#: Entries of a voter at most, halves of each (density, kind); least documents (and share of the toxic ones) and odds of an entry.
ENTRIES, HALVES, LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 40, 2, 2.5, 0.01, 40.0
LEXICONS = len(LEVELS) * KINDS * HALVES
PATTERNS = ("marks", "capitals", "masked", "stretched", "address", "addressed_entry", "repeated_entry")
VOTERS = LEXICONS + len(PATTERNS)
#: Steps of the label model, tasks that add up its counts, weight of the labelled counts against all others.
ROUNDS, SUMMERS, LABELLED = 6, 64, 1.0
SLICE_BYTES = 1 << 19
#: Forms of address in the languages of the corpus.
ADDRESS = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te vous votre vos usted ustedes vosotros eres".split()


def _letters() -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[65:91] = lut[97:123] = lut[128:] = True
    return lut


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last bytes of the maximal runs of letters (ASCII letters and all other code points), and each row's first run."""
    on = _letters()[data]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = on[inner]
    last[inner - 1] = on[inner - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, offsets)


def entries_of(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind (starts by length, then whole words) the words that have an entry and its hash; cases fold."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    x = np.append(data, np.zeros(3, np.uint8))
    v = x[at].astype(np.uint64)
    lead = x[at]
    fold = (lead >= 65) & (lead <= 90)
    v[fold] += U(32)
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = np.flatnonzero(lead >= least)
        v[more] = v[more] << U(8) | x[at[more] + k]
    upper = (v >= 0xC380) & (v <= 0xC39E) & (v != 0xC397)
    v[upper] += U(32)
    first = np.searchsorted(at, s)
    size = np.searchsorted(at, e) - first
    h = np.full(len(s), K1)
    out, alive = [], np.arange(len(s))
    with np.errstate(over="ignore"):
        for k in range(LONGEST):
            alive = alive[size[alive] > k]
            if not len(alive):
                break
            g = (h[alive] ^ v[first[alive] + k]) * K1
            h[alive] = g ^ g >> U(29)
            if k + 1 in STARTS:
                out.append((alive, mix(h[alive], np.full(len(alive), k + 1, np.uint64))))
        while len(out) < len(STARTS):
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
        out.append((np.arange(len(s)), mix(h, np.maximum(size, LONGEST).astype(np.uint64) << U(8))))
    return out


def _address() -> np.ndarray:
    column = pa.array(ADDRESS, pa.string())
    data, offsets = utf8(column)
    return np.sort(entries_of(data, offsets[:-1], offsets[1:])[-1][1])


def _found(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in the sorted table, and where."""
    if not len(table) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(table >> U(48)).astype(np.int64)] = True
    i = np.flatnonzero(maybe[(hashes >> U(48)).astype(np.int64)])
    j = np.minimum(np.searchsorted(table, hashes[i]), len(table) - 1)
    hit = table[j] == hashes[i]
    return i[hit], j[hit]


def described(column: pa.Array, lexicon: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its votes (VOTERS of -1, 0, 1) and its features. lexicon has entry (sorted hashes) and voter."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    s, e, bounds = words_of(data, offsets)
    n = np.diff(bounds)
    row = np.repeat(np.arange(rows), n)
    kinds = entries_of(data, s, e)
    hits = np.zeros((rows, LEXICONS))
    entry_at = np.zeros(len(s) + 1, bool)
    twice = np.zeros(rows)
    table, voter = lexicon["entry"], lexicon["voter"]
    for w, h in kinds:
        i, j = _found(h, table)
        if len(i):
            hits += np.bincount(row[w[i]] * LEXICONS + voter[j], minlength=rows * LEXICONS).reshape(rows, LEXICONS)
            entry_at[w[i]] = True
            pair, times = np.unique(row[w[i]] * len(table) + j, return_counts=True)
            np.maximum.at(twice, pair // len(table), times)
    words = np.maximum(n, 1)[:, None]
    level = np.repeat(np.arange(len(LEVELS)), KINDS * HALVES)
    least, share = np.array([x for x, _ in LEVELS])[level], np.array([x for _, x in LEVELS])[level]
    enough = (hits >= least) & (hits * share >= words)
    lexical = np.where(enough, 1, np.where(hits > 0, 0, -1))
    # patterns, as rates by word
    sums = lambda flag, where: np.add.reduceat(np.append(flag, 0).astype(np.float64), np.minimum(where[:-1], len(flag))) * (np.diff(where) > 0)
    by_byte = lambda flag: sums(flag, offsets) if rows else np.zeros(0)
    by_word = lambda flag: sums(flag, bounds) if rows else np.zeros(0)
    ascii_letter = _letters()[data] & (data < 128)
    capital = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
    small = np.append(0, np.cumsum((data >= 97) & (data <= 122)))
    shout = (capital[e] - capital[s] >= 3) & (small[e] == small[s])
    mask = np.isin(data, np.frombuffer(b"*#@$", np.uint8))
    masked = np.zeros(len(data), bool)
    if len(data) > 2:
        masked[1:-1] = mask[1:-1] & ascii_letter[:-2] & ascii_letter[2:]
    stretched = np.zeros(len(data), bool)
    if len(data) > 2:
        stretched[2:] = ascii_letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    address = np.zeros(len(s) + 1, bool)
    address[_found(kinds[-1][1], _address())[0]] = True
    beside = address[:-1] & entry_at[1:]
    beside[1:] |= address[1:-1] & entry_at[: len(s) - 1] if len(s) > 1 else False
    entry = entry_at[:-1]
    rates = np.column_stack([by_byte(data == 33), by_word(shout), by_byte(masked), by_byte(stretched), by_word(address[:-1]), by_word(beside), np.maximum(twice - 1, 0)])
    cut = np.array([0.02, 0.05, 0.01, 0.02, 0.02, 0.002, 0.002])
    patterns = np.where(rates >= np.maximum(cut * words, 1), 1, np.where(rates > 0, 0, -1))
    votes = np.column_stack([lexical, patterns]).astype(np.int8)
    every = by_word(entry)[:, None]
    rate = every / words
    features = np.column_stack([
        np.minimum(rate * 50, 3), rate >= 0.01, (rate >= 0.01) & (every >= 2), np.log1p(100 * hits / words), lexical == 1, np.minimum(rates / words * 20, 3),
    ]).astype(np.float32)
    return votes, features


def mined(row: np.ndarray, kind: np.ndarray, entry: np.ndarray, count: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray, clean_weight: float) -> dict[str, np.ndarray]:
    """The lexicons, from the entries of the sample's documents: one row per document and distinct entry.

    words, y and weight are by document. A clean document stands for clean_weight of them.
    """
    distinct, number = np.unique(entry, return_inverse=True)
    toxic, w = y[row] == 1, weight[row]
    totals = weight[y == 1].sum(), weight[y == 0].sum() * clean_weight
    best = np.zeros(len(distinct))
    level = np.zeros(len(distinct), np.int64)
    for k, (least, share) in enumerate(LEVELS):
        on = (count >= least) & (count * float(share) >= words[row])
        p = np.bincount(number[on & toxic], w[on & toxic], len(distinct))
        q = np.bincount(number[on & ~toxic], w[on & ~toxic], len(distinct)) * clean_weight
        odds = (p + 0.25) / (totals[0] + 0.5) / ((q + 0.25) / (totals[1] + 0.5))
        gain = np.where((p >= max(LEAST_DOCS, LEAST_SHARE * totals[0])) & (odds >= LEAST_ODDS) & (p > q), p * np.log(odds), 0)
        level[gain > best] = k
        best = np.maximum(best, gain)
    kinds = np.zeros(len(distinct), np.int64)
    kinds[number] = kind
    chosen, voter = [], []
    for k in range(len(LEVELS)):
        for j in range(KINDS):
            of = np.flatnonzero((best > 0) & (level == k) & (kinds == j))
            of = of[np.lexsort((distinct[of], -best[of]))][: HALVES * ENTRIES]
            chosen.append(distinct[of])
            voter.append((k * KINDS + j) * HALVES + np.arange(len(of)) % HALVES)
    entries, voters = np.concatenate(chosen), np.concatenate(voter)
    order = np.argsort(entries)
    return {"entry": entries[order], "voter": voters[order]}


def one_hot(votes: np.ndarray) -> np.ndarray:
    return (votes[:, :, None] == np.array([-1, 0, 1])).reshape(len(votes), -1).astype(np.float64)


class LabelModel:
    """Two classes; each voter's votes given the class and its parent's vote. counts[c] are weighted co-occurrences of votes."""

    def __init__(self, counts: np.ndarray, parents: list[int] | None = None):
        self.counts = counts
        total = np.array([np.trace(c) for c in counts]) / VOTERS
        self.prior = np.log((total + 1) / (total.sum() + 2))
        self.parents = parents if parents is not None else self.tree()
        pairs = counts.reshape(2, VOTERS, 3, VOTERS, 3)
        self.table = np.zeros((2, VOTERS, 3, 3))  # class, voter, parent's vote, own vote
        for i, j in enumerate(self.parents):
            own = pairs[:, i][:, :, i].diagonal(axis1=1, axis2=2) + 0.5
            own = own / own.sum(1, keepdims=True)
            if j < 0:
                self.table[:, i] = np.log(own)[:, None, :]
            else:  # what a parent's vote hasn't been seen with goes by the voter alone
                x = pairs[:, j][:, :, i] + 2 * own[:, None, :]
                self.table[:, i] = np.log(x / x.sum(2, keepdims=True))

    def tree(self) -> list[int]:
        """The spanning tree of most conditional mutual information between voters, given the class."""
        pairs = self.counts.reshape(2, VOTERS, 3, VOTERS, 3)
        info = np.zeros((VOTERS, VOTERS))
        total = sum(np.trace(c) for c in self.counts) / VOTERS + 1e-9
        for c in (0, 1):
            joint = pairs[c].transpose(0, 2, 1, 3) + 0.1
            joint = joint / joint.sum((2, 3), keepdims=True)
            apart = joint.sum(3, keepdims=True) * joint.sum(2, keepdims=True)
            info += np.trace(self.counts[c]) / VOTERS / total * (joint * np.log(joint / apart)).sum((2, 3))
        parents, best, by = [-1] * VOTERS, np.full(VOTERS, -1.0), np.full(VOTERS, -1)
        left = set(range(VOTERS))
        while left:
            i = max(left, key=lambda k: (best[k], -k))
            left.remove(i)
            parents[i] = int(by[i]) if best[i] > 0.01 else -1
            for k in left:
                if info[i, k] > best[k]:
                    best[k], by[k] = info[i, k], i
        return parents

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(np.int64) + 1
        above = np.where(np.array(self.parents) < 0, 0, v[:, self.parents])
        k = np.arange(VOTERS)
        z = self.prior[1] - self.prior[0] + (self.table[1, k, above, v] - self.table[0, k, above, v]).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, goal: np.ndarray, weight: np.ndarray, decay: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights (bias last) of a logistic regression on soft labels, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    share = weight / weight.sum()
    keep = np.full(len(w), decay)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - goal)) + keep * w
        hess = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(keep)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y and t of the sample, and the number of labelled documents of each class."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where("y IN (0, 1)")
    known = materialize(known)
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    first = [known.where(F.col("y") == k).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(SAMPLE_DOCS) for k in (0, 1)]
    texts = docs.select("doc_id", F.col("text").alias("t")).where("t IS NOT NULL")
    some = texts.join(F.broadcast(first[0].unionByName(first[1])), "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "y")).alias("x")).select("doc_id", "x.*")
    size = F.regexp_count("t", F.lit(WORD))
    upto = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    some = materialize(some.withColumn("size", size)).withColumn("upto", upto).where(F.col("upto") <= SAMPLE_WORDS // 2)
    return some.select("doc_id", "y", "t").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id"), totals


SAMPLED = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("t", pa.large_string()), ("words", pa.int64()), ("kind", pa.binary()), ("entry", pa.binary()), ("count", pa.binary()), ("least", pa.binary())])


def sample_entries(part: pa.RecordBatch) -> pa.RecordBatch:
    """Each document's distinct entries with their kinds and counts, and the least hash of its neighbouring word pairs."""
    data, offsets = utf8(part.column(2))
    s, e, bounds = words_of(data, offsets)
    kinds = entries_of(data, s, e)
    rows = part.num_rows
    row = np.repeat(np.arange(rows), np.diff(bounds))
    out = []
    whole = kinds[-1][1]
    with np.errstate(over="ignore"):
        pair = mix(whole[:-1], whole[1:]) if len(whole) else whole
    each = [np.split(h, np.searchsorted(row[w], np.arange(1, rows))) for w, h in kinds]
    for r in range(rows):
        got = [np.unique(x[r], return_counts=True) for x in each]
        kind = np.repeat(np.arange(KINDS, dtype=np.uint8), [len(h) for h, _ in got])
        least = pair[bounds[r] : max(bounds[r + 1] - 1, bounds[r])]
        out.append((kind.tobytes(), np.concatenate([h for h, _ in got]).tobytes(), np.concatenate([c for _, c in got]).astype(np.uint32).tobytes(), (least.min() if len(least) else U(r)).tobytes()))
    cols = [pa.array([o[k] for o in out], pa.binary()) for k in range(4)]
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2).cast(pa.large_string()), pa.array(np.diff(bounds).astype(np.int64)), *cols], schema=SAMPLED)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 11) -> dict[str, np.ndarray] | None:
    """The model, from labelled documents that aren't held out and the votes on all documents.

    Null labels, ids and texts are left out of the sample; an id with several labels counts as toxic. Without
    labels of both classes there is no model.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sample, totals = labelled_sample(docs, labels, label, seed)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, SLICE_BYTES):
            got = sample_entries(part)
            yield got.set_column(2, "t", part.column(2))

    got = sample.mapInArrow(entries, "doc_id long, y int, t string, words long, kind binary, entry binary, count binary, least binary").orderBy("doc_id").toArrow()
    y = np.array(got.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return None
    words = np.array(got.column("words").to_pylist(), np.int64)
    join = lambda c, t: [np.frombuffer(x, t) for x in got.column(c).to_pylist()]
    each = join("entry", np.uint64)
    row = np.repeat(np.arange(len(y)), [len(x) for x in each])
    least = np.concatenate(join("least", np.uint64))
    _, copy, times = np.unique(least, return_inverse=True, return_counts=True)
    weight = 1 / times[copy]
    clean = totals[0] / totals[1] * (y == 1).sum() / (y == 0).sum()  # documents that a clean one of the sample stands for, as against a toxic one
    lexicon = mined(row, np.concatenate(join("kind", np.uint8)).astype(np.int64), np.concatenate(each), np.concatenate(join("count", np.uint32)).astype(np.int64), words, y, weight, clean)
    parts = [described(pa.array(c.to_pylist(), pa.string()), lexicon) for c in (got.column("t").slice(k, 200) for k in range(0, len(y), 200))]
    votes, features = np.concatenate([v for v, _ in parts]), np.concatenate([f for _, f in parts])
    shares = np.where(y == 1, weight, weight * clean)
    x = one_hot(votes)
    known = np.stack([(x * (shares * (y == c))[:, None]).T @ x for c in (0, 1)])

    told = spark.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, SLICE_BYTES):
            v, _ = described(part.column(0), told.value)
            distinct, n = np.unique(v, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in distinct], pa.binary()), pa.array(n.astype(np.int64))], ["votes", "n"])

    patterns = materialize(docs.select(text_of().alias("t")).mapInArrow(vote, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).repartition(SUMMERS))
    model = LabelModel(known)
    for _ in range(ROUNDS):
        model = LabelModel(_anchored(known, _expected(patterns, model)))
    goal = with_label(model.posterior(votes), y, shares)
    return {**lexicon, "w": logistic(features, goal, shares), "parents": np.array(model.parents), "posterior": goal, "y": y}


def with_label(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Posteriors of labelled documents once their label has voted too, as reliable as it agrees with the others."""
    told = [(weight * q * (y == 1)).sum() + 1 for q in (1 - p, p)]
    rate = [t / ((weight * q).sum() + 2) for t, q in zip(told, (1 - p, p), strict=True)]
    odds = np.where(y == 1, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0])))
    return 1 / (1 + np.exp(-np.clip(np.log(p / (1 - p)) + odds, -30, 30)))


def _expected(patterns: DataFrame, model: LabelModel) -> np.ndarray:
    """Co-occurrences of votes over all documents, by the model's posteriors: one small table from each of the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 3 * VOTERS, 3 * VOTERS))
        for b in batches:
            for part in (b.slice(k, 4096) for k in range(0, b.num_rows, 4096)):
                v = np.frombuffer(b"".join(part.column(0).to_pylist()), np.int8).reshape(-1, VOTERS)
                n, x, p = part.column(1).to_numpy(), one_hot(v), model.posterior(v)
                for c, q in ((0, 1 - p), (1, p)):
                    out[c] += (x * (q * n)[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["x"])

    sums = [np.frombuffer(r.x).reshape(2, 3 * VOTERS, 3 * VOTERS) for r in patterns.mapInArrow(add, "x binary").toLocalIterator()]
    return np.sum(sums, axis=0)


def _anchored(known: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The labelled counts, with LABELLED times the weight of all others, and these."""
    return known * (LABELLED * seen.trace(axis1=1, axis2=2).sum() / max(known.trace(axis1=1, axis2=2).sum(), 1e-9)) + seen


def scores(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    _, x = described(column, model)
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ model["w"][:-1] + model["w"][-1], -30, 30)))


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """docs with score (0 to 1, higher: more likely toxic) and predicted (1 if score >= 0.3).

    Null text is scored as empty; repeated rows get equal scores; without a model every score is 0. Columns of docs
    that are named like an output give way to it. An empty table gives an empty table.
    """
    if model is None:
        return unpacked(packed(docs), docs.columns, {"score": F.lit(0.0), "predicted": F.lit(0)})
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("entry", "voter", "w")})
    base = packed(docs).withColumn("t", text_of("row.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1), told.value))], ["row", "score"])

    out = base.mapInArrow(run, base.select("row", F.lit(0.0).alias("score")).schema)
    return unpacked(out, docs.columns, {"score": F.col("score"), "predicted": (F.col("score") >= 0.3).cast("int")})
