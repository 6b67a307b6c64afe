"""Small documents with every awkward case, and plain-Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, size string, token string, kept string, row string"
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    syl = ["an", "the", "in", "er", "ou", "ñ", "st", "é", "re", "ti"]
    word = lambda: "".join(r.choices(syl, k=r.randint(1, 4)))
    line = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    shared = [line(14) for _ in range(3)]
    texts = [None, "", " ", "\n", "\n\n", "one two", "one  two \t three", "x" * 3000, "a b " * 400, "😀 中文 ▁ \x00 end", "   nbsp", "Same line\nsame LINE \n\nSame line"]
    base = [" ".join(line(r.randint(5, 20)) for _ in range(r.randint(1, 6))) for _ in range(n // 3)]
    for k in range(n):
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 3])):
            t[r.randrange(len(t))] = word()
        texts.append(" ".join(t) + ("\n" + r.choice(shared) if k % 2 else ""))
    rows = [(10 + k, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "z", None]), len(t or ""), "x", "y", "z", "w", "v") for k, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "no id here at all my friend", None, None, 3, None, None, None, None, None), (5, rows[25][1], "en", "s1", 1, "", "", "", "", "")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def as_rows(df, *cols):
    key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def words(t) -> list[str]:
    return WORD.findall((t or "").translate(LOWER))


def shingles(t, width=5) -> frozenset:
    w = words(t)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, percent=80) -> dict:
    """doc_id to (set size, least id reachable), over rows with ids."""
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], shingles(r[1]))
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}
