"""Periodic runs against looking at every period and place."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import periodic_runs as P

from . import docs as D


def brute(w):
    """Runs (start, length, period) by comparing every word with every later one; what is left of the words."""
    n, out = len(w), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.add((i, j - i + p, p))
            i = j
    gone = {k for s, n_, p in out for k in range(s + p, s + n_)}
    return sorted(out, key=lambda r: (r[0], r[2])), " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(d, w):
    h = zlib.crc32(str(d).encode())
    if d is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        w = []
        while len(w) < r.choice([0, 5, 6, 20, 60]):
            unit = [r.choice("abcA") for _ in range(r.randint(1, 5))]
            if r.random() < 0.4:
                unit = (unit * r.randint(1, 3) + unit[:1]) * r.randint(1, 5)  # runs within runs
            w += unit * r.choice([1, 1, 3, 4, 7])
        out.append(w)
    return out


def test_runs_equal_brute_force():
    for seed in range(6):
        for space in (" ", "\n\t "):
            rows = [*texts(seed), [], ["x"] * 6, ["x"] * 5, "a b a b a b a b".split(), "a b a b a b a".split(), ["é", "中"] * 9]
            got = P._batch(pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([space + space.join(w) + space for w in rows])], ["row", "t"])).to_pylist()
            for w, x in zip(rows, got, strict=True):
                runs, rest = brute(w)
                assert [(r["start"], r["length"], r["period"]) for r in x["runs"]] == runs and x["collapsed"] == rest and x["n_words"] == len(w)


def test_very_long_texts():
    n = 300_000
    r = np.random.default_rng(1)
    rows = [["a", "b"] * n, ["a"] * n, [str(x) for x in np.tile(r.integers(0, 99, n // 10), 4)], [str(x) for x in r.integers(0, 50, n)], ["w" * 3_000_000] * 7]
    got = P._batch(pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([" ".join(w) for w in rows])], ["row", "t"])).to_pylist()
    assert [[(x["start"], x["length"], x["period"]) for x in g["runs"] if x["length"] > 30] for g in got[:3]] == [[(0, 2 * n, 2)], [(0, n, 1)], [(0, n // 10 * 4, n // 10)]]
    assert got[0]["collapsed"] == "a b" and got[4]["collapsed"] == "w" * 3_000_000 and got[4]["runs"] == [{"start": 0, "length": 7, "period": 1}]


def test_query_columns(spark, tmp_path):
    from graphloom.llm.queries import op13_periodic_runs

    rows = D.documents(3, 200)
    D.frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t, *_ in rows:
        runs, rest = brute(planted(d, D.WORD.findall(t or "")))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((d, len(runs), *first, D.sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), D.sha(rest)))
    assert sum(w[1] > 0 for w in want) > 5
    out = op13_periodic_runs(spark, str(tmp_path))
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert out.columns == cols and [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2
    key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
    assert D.as_rows(out, *cols) == sorted(want, key=key)


def test_awkward_tables(spark):
    rows = D.documents(4, 30)
    out = P.find_runs(D.frame(spark, rows).withColumn("runs", F.lit("clash")).withColumn("Collapsed", F.lit(1)))
    assert out.count() == len(rows) and out.columns.count("runs") == 1 and "row" in out.columns and "Collapsed" not in out.columns
    assert P.find_runs(D.frame(spark, [])).count() == 0
