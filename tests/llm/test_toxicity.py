"""Toxicity: planted words found on held-out documents, counts against plain Python, awkward tables."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import toxicity as T

from . import docs as D

BAD = ["grubnik", "plofter", "Zwackel", "brémiste", "snudge"]


def corpus(n=900, seed=2):
    r = random.Random(seed)
    syl = ["an", "the", "in", "er", "ou", "ñ", "st", "é", "re", "ti", "ver"]
    word = lambda: "".join(r.choices(syl, k=r.randint(1, 4)))
    rows, labels = [], []
    for d in range(n):
        w = [word() for _ in range(r.choice([15, 60, 200, 700]))]
        bad = d % 7 == 0
        if bad:
            for _ in range(max(2, len(w) // 40)):
                # a start of words that ends in every way, and whole words
                w[r.randrange(len(w))] = r.choice(BAD) if d % 2 else "quorb" + word()
        rows.append((d, " ".join(w), None, None, 1, *"xyzwv"))
        if d % 5 != 4:
            labels.append((d, 1, int(bad)))
    return rows, labels


def test_planted_words_are_found(spark):
    rows, labels = corpus()
    docs, marks = D.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(docs, marks)
    got = {r.doc_id: r for r in T.score(docs, model).withColumn("h", T.held_out(F.col("doc_id"))).collect()}
    assert all(r.h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    for held in (True, False):
        bad = [r.predicted for d, r in got.items() if d % 7 == 0 and r.h == held]
        good = [r.predicted for d, r in got.items() if d % 7 and r.h == held]
        assert np.mean(bad) >= 0.95 and np.mean(good) <= 0.01
    # held-out labels are never learned from
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    again = T.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert all(np.array_equal(model[k], again[k]) for k in ("entry", "voter", "w"))
    # the linear classifier follows the label model's posteriors
    assert np.mean((model["posterior"] > 0.5) == (model["y"] == 1)) > 0.97
    # the voters depend on one another, and no voter on itself
    parents = model["parents"].tolist()
    assert any(p >= 0 for p in parents)
    for k in range(T.VOTERS):
        seen = set()
        while k >= 0:
            assert k not in seen
            seen.add(k)
            k = parents[k]


def test_words_and_entries_equal_plain_python():
    rows = D.documents(3, 40)
    texts = [r[1] or "" for r in rows] + ["ÉCOLE école Straße 中文字 x*y", "😀a"]
    data, offsets = T.utf8(pa.array(texts))
    s, e, bounds = T.words_of(data, offsets)
    want = [re.findall(r"[A-Za-z\u0080-\U0010ffff]+", t) for t in texts]
    assert [[data[i:j].tobytes().decode() for i, j in zip(s[a:b], e[a:b], strict=True)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    fold = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in w)
    flat = [fold(w) for t in want for w in t]
    kinds = T.entries_of(data, s, e)
    for k, (at, h) in zip((*T.STARTS, None), kinds, strict=True):
        parts = [w[:k] if k else (w[: T.LONGEST], max(len(w), T.LONGEST)) for w in flat]
        assert at.tolist() == [i for i, w in enumerate(flat) if k is None or len(w) >= k]
        names = {}
        for i, x in zip(at.tolist(), h.tolist(), strict=True):
            assert names.setdefault(parts[i], x) == x
        assert len(set(names.values())) == len(names)


def test_expectations_equal_enumeration():
    r = np.random.default_rng(3)
    y = r.random(400) < 0.3
    votes = np.where(r.random((400, T.VOTERS)) < 0.8, np.where(y, 1, -1)[:, None], r.integers(-1, 2, (400, T.VOTERS))).astype(np.int8)
    votes[:, 5] = votes[:, 4]  # two that say the same
    x = T.one_hot(votes)
    model = T.LabelModel(np.stack([x[y == c].T @ x[y == c] for c in (False, True)]))
    assert model.parents[5] == 4 or model.parents[4] == 5
    for v in votes[:20]:
        z = model.prior.copy()
        for k, p in enumerate(model.parents):
            for c in (0, 1):
                z[c] += model.table[c, k, v[p] + 1 if p >= 0 else 0, v[k] + 1]
        assert model.posterior(v[None])[0] == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-9)
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.99


def test_awkward_tables(spark):
    rows, labels = corpus(300)
    rows += [*D.documents(4, 30), (5000, "quorban " * 400_000, None, None, 1, *"xyzwv"), (5001, "a" * 3_000_000, None, None, 1, *"xyzwv")]
    labels += [(None, 1, 1), (3, None, None), (5000, 0, 1), (12345, 0, 1), (0, 1, 0)]
    docs = D.frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("t", F.lit(1)).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(docs, marks)
    out = T.score(docs, model)
    assert out.columns.count("score") == 1 and "t" in out.columns
    got = out.select("doc_id", "text", "score", "predicted").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.predicted for r in got if r.doc_id == 5000} == {1}
    assert len({r.score for r in got if not r.text}) == 1 and all(r.predicted == 0 for r in got if not r.text)
    none = T.train(docs, marks.where("toxic = 0"))
    assert none is None and {r.score for r in T.score(docs, none).collect()} == {0.0}
    assert T.score(D.frame(spark, []), model).count() == 0 and T.train(D.frame(spark, []), marks) is None
