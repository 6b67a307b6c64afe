"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line has a state, good or bad. Its features describe the line and its two neighbours; transition
weights tie the states of consecutive lines. Training maximises the conditional likelihood of the state
sequences, where each line of a labelled document takes the document's label. It runs on a bounded sample
of labelled rows: at most SAMPLE_DOCS documents (in order of a hash of doc_id) of at most SAMPLE_LINES lines each,
and of these the first whose lines add up to SAMPLE_TOTAL; their features are computed by tasks, and only those
reach the driver. Scoring runs on every whole text, in place: forward-backward gives each line's marginal, and the
marginals, weighted by the lines' lengths, add up to the document's score.

Lines are handled in stretches of bounded memory, and a long chain is cut into segments whose transfer matrices are
found together and then multiplied along the chain, so that a text of millions of lines is scored like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import packed, slices, text_of, unpacked
from .shingles import utf8, word_hashes

#: Bounds of the training sample. SAMPLE_TOTAL lines are 40 MB of features.
SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_TOTAL = 4000, 2000, 200_000
#: Most bytes of text whose lines are described at once, and lines of a chain's segment.
SLICE_BYTES, SEGMENT = 1 << 19, 1024
STEPS, RATE, DECAY = 250, 0.05, 1e-3
NAMES = ("chars", "words", "symbols", "punctuation", "capitals", "digits", "spaces", "word_length", "repeats", "single", "empty", "copied", "some_symbols", "much_punctuation", "most_capitals", "many_repeats")
WIDTH = 3 * len(NAMES) + 1


def _classes() -> np.ndarray:
    """0 continuation byte, 1 letter, 2 capital, 3 digit, 4 space, 5 symbol, 6 other."""
    lut = np.full(256, 6, np.uint8)
    lut[128:192], lut[192:] = 0, 1
    for k, chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\x0b\x0c\r"), (5, b"#*$%&|<>")):
        lut[list(chars)] = k
    return lut


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line by itself, each line's length, and the bounds of each row's lines."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # a row of k breaks has k + 1 lines
    row_of = np.searchsorted(offsets, breaks, "right") - 1
    counts = np.bincount(row_of, minlength=rows) + 1 if rows else np.zeros(0, np.int64)
    bounds = np.append(0, np.cumsum(counts)).astype(np.int64)
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    inner = np.arange(len(breaks)) + row_of  # the line that a break ends
    ends[inner], starts[inner + 1] = breaks, breaks + 1
    starts[bounds[:-1]], ends[bounds[1:] - 1] = offsets[:-1], offsets[1:]
    kind = _classes()[data]
    tally = []
    for k in range(1, 7):
        c = np.append(0, np.cumsum(kind == k, dtype=np.int64))
        tally.append((c[ends] - c[starts]).astype(np.float64))
    letters, capitals, digits, spaces, symbols, other = tally
    chars = letters + capitals + digits + spaces + symbols + other
    # words, line by line: line ends are white space, so the lines' words are the rows' words in order
    hashes, _ = word_hashes(data, np.append(starts, len(data)) if len(starts) else np.zeros(1, np.int64))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space
    first[1:] &= space[:-1]
    at = offsets[1:-1][offsets[1:-1] < len(data)]
    first[at] = ~space[at]
    c = np.append(0, np.cumsum(first, dtype=np.int64))
    words = (c[ends] - c[starts]).astype(np.int64)
    line = np.repeat(np.arange(len(starts)), words)
    order = np.lexsort((hashes, line))
    h, ln = hashes[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (ln[1:] != ln[:-1])
    distinct = np.bincount(ln[new], minlength=len(starts))
    last = np.append(first[1:], True) | np.append(space[1:], True)
    single = first & last
    c1 = np.append(0, np.cumsum(single, dtype=np.int64))
    n, w = np.maximum(chars, 1), np.maximum(words, 1)
    # a line's words in order, as one hash; equal lines of a row are copies
    weight = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        place = (np.arange(len(hashes)) - np.repeat(np.cumsum(words) - words, words)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        sums = np.append(np.uint64(0), np.cumsum(hashes * place))
        stop = np.cumsum(words)
        weight = sums[stop] - sums[stop - words]
    row = np.repeat(np.arange(rows), counts)
    order = np.lexsort((weight, row))
    same = np.zeros(len(order), bool)
    equal = (weight[order][1:] == weight[order][:-1]) & (row[order][1:] == row[order][:-1])
    same[1:] |= equal
    same[:-1] |= equal
    copied = np.zeros(len(order))
    copied[order] = same
    copied[words == 0] = 0
    repeats = 1 - distinct / w
    upper = capitals / np.maximum(letters + capitals, 1)
    x = np.column_stack([
        np.log1p(chars), np.log1p(words), symbols / n, other / n, upper, digits / n, spaces / n, (chars - spaces) / w / 10, repeats * (words > 0), (c1[ends] - c1[starts]) / w,
        words == 0, copied, symbols / n > 0.03, other / n > 0.12, upper > 0.5, repeats * (words > 0) > 0.5,
    ]).astype(np.float64)
    return x, chars, bounds


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One, the line's features, and those of the lines before and after it in its row (0 where there is none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        before[bounds[:-1]], after[bounds[1:] - 1] = 0, 0
    return np.column_stack([np.ones(len(x)), x, before, after])


def log_odds(x: np.ndarray, bounds: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Each line's log odds of being good before its neighbours' states count: with_neighbours(x) @ w, without that table."""
    k, w = x.shape[1], model["w"]
    z = x @ w[1 : k + 1] + (w[0] + model["shift"][0])
    if len(x):
        before, after = x[:-1] @ w[k + 1 : 2 * k + 1], x[1:] @ w[2 * k + 1 :]
        z[1:] += before
        z[:-1] += after
        first = bounds[:-1][bounds[:-1] > 0]
        z[first] -= before[first - 1]
        z[first - 1] -= after[first - 1]
    return z


def _chains(z: np.ndarray, t: np.ndarray, bounds: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log weights of both states of each line, advancing all rows together. begin and end are each
    row's log weights of the state of its first line (before its own emission) and of its last line's successors."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    start, n = bounds[:-1][order], n[order]
    emit = np.column_stack([np.zeros(len(z)), z])
    a, b = np.zeros((len(z), 2)), np.zeros((len(z), 2))
    longest = int(n[0]) if len(n) else 0
    active = [int(np.searchsorted(-n, -k, "left")) for k in range(longest)]  # rows of more than k lines
    if longest:
        a[start] = emit[start] + begin[order]
        b[start + n - 1] = end[order]
    for k in range(1, longest):
        at = start[: active[k]] + k
        p = a[at - 1]
        a[at] = emit[at] + np.column_stack([np.logaddexp(p[:, 0] + t[0, j], p[:, 1] + t[1, j]) for j in (0, 1)])
    for k in range(longest - 2, -1, -1):
        at = start[: active[k + 1]] + k
        q = b[at + 1] + emit[at + 1]
        b[at] = np.column_stack([np.logaddexp(q[:, 0] + t[i, 0], q[:, 1] + t[i, 1]) for i in (0, 1)])
    return a, b


def forward_backward(z: np.ndarray, t: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for each line, and the expected transition counts (2 x 2) over all rows.

    z: log odds of state 1 by line; t[i, j]: weight of going from i to j. Rows of more than SEGMENT lines are cut into
    segments: each segment's weights are found for either state at its start, chained along the row forwards and
    backwards, and then give every segment its true ends.
    """
    n = np.diff(bounds)
    pieces = np.maximum(-(-n // SEGMENT), 1)
    row = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.append(bounds[:-1][row] + nth * SEGMENT, bounds[-1] if len(bounds) else 0)
    begin, end = np.zeros((len(row), 2)), np.zeros((len(row), 2))
    several = np.flatnonzero(pieces > 1)
    if len(several):
        inner = np.flatnonzero((pieces[row] > 1) & (np.diff(cuts) > 0))
        last = cuts[inner + 1] - 1
        through = np.empty((len(row), 2, 2))  # log weight from the state of a segment's first line to that of its last
        for i in (0, 1):
            only = np.full((len(row), 2), -np.inf)
            only[:, i] = 0
            with np.errstate(invalid="ignore"):
                through[inner, i] = _chains(z, t, cuts, only, end)[0][last]
        for r in several:
            k0 = int(np.cumsum(pieces)[r] - pieces[r])
            for k in range(k0 + 1, k0 + int(pieces[r])):
                out = np.logaddexp(begin[k - 1, 0] + through[k - 1, 0], begin[k - 1, 1] + through[k - 1, 1])
                begin[k] = np.logaddexp(out[0] + t[0], out[1] + t[1])
            for k in range(k0 + int(pieces[r]) - 2, k0 - 1, -1):
                # the successors of a segment's last line: into the next segment's first line and on to its end
                beyond = np.logaddexp(through[k + 1, :, 0] + end[k + 1, 0], through[k + 1, :, 1] + end[k + 1, 1])
                end[k] = np.logaddexp(t[:, 0] + beyond[0], t[:, 1] + beyond[1])
    a, b = _chains(z, t, cuts, begin, end)
    emit = np.column_stack([np.zeros(len(z)), z])
    total = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    second = np.ones(len(z), bool)
    second[bounds[:-1][n > 0]] = False
    at = np.flatnonzero(second)
    pairs = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = np.exp(a[at - 1, i] + t[i, j] + emit[at, j] + b[at, j] - total[at]).sum()
    return np.exp(a[:, 1] + b[:, 1] - total), pairs


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Weights by Adam on the mean negative log likelihood; y is each row's state. Rows weigh alike, whatever their length."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[0] = 0, 1
    sd[sd < 1e-6] = 1
    s = (x - mean) / sd
    n = np.diff(bounds)
    state = np.repeat(y, n).astype(np.float64)
    share = 1 / np.repeat(np.maximum(n, 1), n)
    classes = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5
    weight = share * np.repeat(classes, n)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    seen = np.array([[(np.maximum(n - 1, 0) * (y == i)).sum() if i == j else 0 for j in (0, 1)] for i in (0, 1)], np.float64)
    for step in range(1, STEPS + 1):
        p, pairs = forward_backward(s @ w, t, bounds)
        g = [s.T @ ((p - state) * weight) / len(y) + DECAY * w, (pairs - seen) / max(1, seen.sum()) + 0.02 * t]
        for k, (par, grad) in enumerate(zip((w, t), g, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            par -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {"w": w / sd, "shift": np.array([-(w * mean / sd).sum()]), "t": t}


def document_scores(x: np.ndarray, chars: np.ndarray, bounds: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    p, _ = forward_backward(log_odds(x, bounds, model), model["t"], bounds)
    weight = chars + 1
    top, below = np.append(0, np.cumsum(p * weight)), np.append(0, np.cumsum(weight))
    return np.clip((top[bounds[1:]] - top[bounds[:-1]]) / np.maximum(below[bounds[1:]] - below[bounds[:-1]], 1e-9), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 9) -> dict[str, np.ndarray]:
    """The model from labelled documents that aren't held out. Null labels, ids and texts are left out; an id
    with several labels counts as bad. Without labels, or with one class only, every score is 0.5."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(SAMPLE_DOCS)
    texts = docs.select("doc_id", F.col("text").alias("t")).where("t IS NOT NULL")
    lines = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1
    some = texts.join(F.broadcast(known), "doc_id").withColumn("lines", lines).where(F.col("lines") <= SAMPLE_LINES)
    # at most SAMPLE_DOCS documents and their repeated rows: the first of each, up to the total
    some = some.groupBy("doc_id").agg(F.min(F.struct("lines", "t", "y")).alias("x")).select("doc_id", "x.*")
    upto = F.sum("lines").over(Window.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    some = some.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_TOTAL).select("doc_id", "t", "y").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            x, _, bounds = line_features(part.column(1))
            each = [x[i:j].astype(np.float32).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(each, pa.binary())], ["doc_id", "y", "x"])

    got = some.mapInArrow(describe, "doc_id long, y int, x binary").orderBy("doc_id").toArrow()
    rows = [np.frombuffer(v, np.float32).reshape(-1, len(NAMES)) for v in got.column("x").to_pylist()]
    y = np.array(got.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return {"w": np.zeros(WIDTH), "shift": np.zeros(1), "t": np.zeros((2, 2))}
    bounds = np.append(0, np.cumsum([len(r) for r in rows]))
    return fit(with_neighbours(np.concatenate(rows).astype(np.float64), bounds), bounds, y)


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 if score >= 0.5). Null text is scored as
    empty; repeated rows get equal scores; an empty table gives an empty table."""
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    base = packed(docs).withColumn("t", text_of("row.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(document_scores(*line_features(part.column(1)), told.value))], ["row", "score"])

    out = base.mapInArrow(run, base.select("row", F.lit(0.0).alias("score")).schema)
    return unpacked(out, docs.columns, {"score": F.col("score"), "predicted": (F.col("score") >= 0.5).cast("int")})
