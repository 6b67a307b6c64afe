"""Spelling variants against comparing all words."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import spelling as S

from . import docs as D

KEY = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count):
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 10 * words[w] else None for w, b in best.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=KEY)


def vocabulary(seed, n):
    r = random.Random(seed)
    words = set()
    for _ in range(n):
        w = "".join(r.choice(["an", "é", "st", "aa", "b"]) for _ in range(r.randint(3, 7)))
        words.add(w)
        for _ in range(r.randint(0, 6)):
            k = r.randint(0, len(w) - 1)
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abéz") + w[k:], w[:k] + r.choice("abéz") + w[k + 1 :]])
            words.add(w)
    return {w: r.choice([1, 2, 3, 20, 25, 200, 2000]) for w in words}


@pytest.mark.parametrize(("seed", "most"), [(1, S.BLOCK_ROWS), (2, 40), (3, 3)])
def test_variants_equal_brute_force(spark, seed, most):
    count = vocabulary(seed, 120)
    if seed == 1:  # one block of words that share either half, and words that differ in every place
        count |= {"abcdefg" + x + y + "hijklmn": 3 for x in "pqrstuvwxyz" for y in "pqrstuvw"} | {"q" * k: 10**k for k in range(7, 12)}
    table = spark.createDataFrame([*count.items(), (None, 5), ("nocounts", None)], "word string, n long")
    want = brute(count)
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want)
    got = S.variants(table, most=most)
    assert D.as_rows(got, "word", "form", "root", "n", "n_near", "form_n") == want


def test_long_words(spark):
    a = "ab" * 40_000
    count = {a: 50, a + "c": 2, a[:30_000] + "x" + a[30_001:]: 3, "y" + a: 2, a[:-1]: 4, a[1:]: 2, "c" + a[:-1]: 2}
    got = {r.word: r for r in S.variants(spark.createDataFrame([*count.items()], "word string, n long")).collect()}
    assert {w: (got[w].n_near, got[w].form) for w in count} == {w: (sum(one_edit(v, w) for v in count), min((v for v in count if one_edit(v, w) and count[v] >= 10 * n), key=lambda v: -count[v], default=None)) for w, n in count.items()}


def test_query_columns(spark, tmp_path):
    from graphloom.llm.queries import op12_spelling

    r = random.Random(5)
    vocab = list(vocabulary(6, 30))
    rows = D.documents(5, 60)
    rows += [(1000 + k, " ".join(r.choices(vocab[:12] if k % 3 else vocab, k=300)).upper() + "×÷ŒABCDEFGHÿ 12Zebrafisch3", "en", "s", 1, *"xyzwv") for k in range(40)]
    D.frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    count: dict = {}
    for d, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(D.LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            count[w] = count.get(w, 0) + 1
    out = op12_spelling(spark, str(tmp_path))
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    assert out.columns == cols and [t for _, t in out.dtypes] == ["string"] * 3 + ["bigint"] * 3
    want = brute(count)
    assert sum(w[1] is not None for w in want) > 10
    assert D.as_rows(out, *cols) == want


def test_awkward_tables(spark):
    none = S.document_words(D.frame(spark, []), delete_every=31)
    assert none.count() == 0 and S.variants(none).count() == 0
    rows = D.documents(4, 30)
    plain = S.document_words(D.frame(spark, rows).withColumn("h", F.lit(1)).withColumn("word", F.lit("clash")))
    assert {w: n for w, n in plain.collect()}["x" * 3000] == 1 and plain.columns == ["word", "n"]
