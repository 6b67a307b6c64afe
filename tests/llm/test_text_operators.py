"""Operators on whole texts against plain Python."""

import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import line_crf, line_dedup, mixing, ngram_join, pii, quality_rules, sentencepiece_codec, suffix_dedup
from graphloom.llm.queries import model_path

from . import docs as D


@pytest.fixture(scope="module")
def rows():
    return D.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return D.frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return D.frame(spark, [])


def test_line_dedup(spark, docs, rows, none):
    key = lambda x: x.strip(D.SPACES).translate(D.LOWER)
    seen = {}
    for r in rows:
        for x in {key(x) for x in (r[1] or "").split("\n")}:
            seen.setdefault(x, set()).add(r[0])
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if not (key(x) and len(seen[key(x)]) >= 10)]
        want.append((r[0], len(lines), len(lines) - len(keep), "\n".join(keep)))
    out = line_dedup.drop_common_lines(docs)
    assert out.columns.count("text") == 1 and out.columns.count("n_lines") == 1 and "row" in out.columns
    assert D.as_rows(out, "doc_id", "n_lines", "n_dropped", "text") == sorted(want, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    assert any(w[2] for w in want)
    assert line_dedup.drop_common_lines(none).count() == 0
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert out.agg(F.min("n_dropped")).first()[0] == 0
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def brute_repeats(texts):
    """Per document: bytes, removed bytes, runs and hash of the rest, from every 50-byte window."""
    least = {}
    for d, b in texts:
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                least[w] = min(least.get(w, d), d)
    want = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        want.append((d, len(b), sum(gone), spans, D.sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(want, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def removed(docs):
    return D.as_rows(suffix_dedup.remove_repeats(docs).withColumn("h", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "h")


def test_suffix_dedup(docs, rows, none):
    want = brute_repeats([(r[0], (r[1] or "").encode()) for r in rows])
    assert removed(docs) == want
    assert sum(w[2] for w in want) > 1000
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_shifted_passages(spark):
    """Parts of few different passages, cut at any byte, so that spans, buckets and windows differ by a byte or two."""
    r = random.Random(8)
    passages = ["".join(r.choices("ab cé", k=300)) for _ in range(4)] + ["ab" * 100, "x" * 150]
    rows = []
    for d in range(150):
        parts = []
        for _ in range(r.randint(0, 4)):
            t = r.choice(passages)
            a = r.randrange(len(t))
            parts.append(t[a : a + r.randint(30, 120)] + r.choice(["", "!", "q"]))
        rows.append((d - 20, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_repeats([(d, t.encode()) for d, t in rows])
    assert removed(docs) == want and sum(w[2] for w in want) > 5000


def test_suffix_dedup_without_repeats(spark):
    """Blocks in which nothing recurs, and blocks of short texts only."""
    r = random.Random(2)
    rows = [(d, "".join(r.choices("abcdefghij", k=400))) for d in range(40)] + [(100 + d, "short") for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(docs) == brute_repeats([(d, t.encode()) for d, t in rows]) and removed(docs.where("doc_id >= 100")) == brute_repeats([(d, t.encode()) for d, t in rows if d >= 100])


def test_suffix_buckets_follow_the_order_of_the_suffixes():
    r = np.random.default_rng(3)
    for depth in (8, 16, 24, 33, 50, 72):
        text = r.integers(97, 99, 400).astype(np.uint8)
        text[100:200] = text[:100]
        starts = np.sort(r.choice(400 - depth, 200, replace=False))
        strings = [text[s : s + depth].tobytes() for s in starts]
        order = {s: k for k, s in enumerate(sorted(set(strings)))}
        assert [order[s] for s in strings] == suffix_dedup.suffix_buckets(text, starts, depth).tolist()


def test_sentencepiece(docs, rows, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = {}
    for r in rows:
        ids = sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want[r[0], r[1]] = (struct.pack(f"<{len(ids)}I", *ids), len(ids), sp.decode(ids))
    out = sentencepiece_codec.encode_documents(docs, model_path())
    got = out.select("doc_id", "text", "ids", "n_tokens", "decoded").collect()
    assert len(got) == len(rows)
    assert all((bytes(g.ids), g.n_tokens, g.decoded) == want[g.doc_id, g.text] for g in got)
    assert sentencepiece_codec.encode_documents(none, model_path()).count() == 0


def test_codec_on_random_pieces():
    import sentencepiece

    with open(model_path(), "rb") as f:
        model = f.read()
    sp, codec, r = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.codec_of(model), random.Random(4)
    pieces = list(codec.ids)
    for _ in range(3000):
        text = "".join(r.choices(pieces, k=r.randint(0, 9))).replace("▁", " ") + r.choice(["", "\n", "  ", "▁", "😀", "\x00"])
        ids = sp.encode(text, add_bos=True, add_eos=True)
        got = codec.encode(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids
        assert codec.decode(ids) == sp.decode(ids)


def brute_statistics(t):
    w = D.WORD.findall(t or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in tri if tri.count(x) > 1} if len(tri) < 2000 else {x for x, n in __import__("collections").Counter(tri).items() if n > 1}
    marked = {i + k for i, x in enumerate(tri) if x in many for k in range(3)}
    lines = [x for x in (t or "").split("\n") if D.WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark, docs, rows, none):
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute_statistics(r[1]) for r in rows}
    for g in got:
        w = want[g.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == w
        assert g.base_failed == (w[0] < 50 or 100 * w[4] > 50 * w[0])
        assert g.kept is not None and not (g.base_failed and g.kept)
    assert quality_rules.judged(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns


def test_quality_rules_find_outliers(spark):
    good = [(k, " ".join(f"w{(k * 7 + i * i) % 997}" for i in range(80 + k % 40)), "en", "s") for k in range(300)]
    bad = [(1000 + k, " ".join(f"w{(k * 5 + i * i) % 991}%%%" for i in range(90)), "en", "s") for k in range(12)]
    out = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[r[0]] for r in good) and not any(out[r[0]] for r in bad)


def brute_distances(rows):
    """doc_id to squared distance of the rows (doc_id, text, lang, source) that pass the base rules, with numpy alone."""
    R = quality_rules
    x, group = {}, {}
    for d, t, lang, source in rows:
        n, chars, symbols, dup, rep = brute_statistics(t)
        if n >= 50 and 100 * rep <= 50 * n:
            x[d] = np.array([np.log(n + 1), np.log(chars / n), np.sqrt(symbols / n), np.sqrt(dup / n * 10), np.sqrt(rep / n)])
            group[d] = (lang, source)
    floors = np.array(R.FLOORS)

    def factor(c):
        c, low = c * R.CONSISTENCY + np.diag(floors**2), np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                v = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(v, floors[i] ** 2 / 4)) if i == j else v / low[j, j]
        return low

    def d2(v, mu, c):
        z = np.linalg.solve(factor(c), (v - mu).T)
        return (z * z).sum(0)

    def estimate(v):
        s = np.sort(v, axis=0)
        q = [s[max(int(np.ceil(p * len(v))), 1) - 1] for p in (0.25, 0.5, 0.75)]
        found = []
        for start, (mu, c) in (("all", (v.mean(0), np.cov(v.T, bias=True))), ("quartiles", (q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)))):
            for _ in range(R.STEPS):
                bins = np.floor(np.log2(d2(v, mu, c) + 1) * R.BINS)
                edge = min(b for b in set(bins) if (bins <= b).sum() >= R.COVERAGE * len(v))
                near = v[bins <= edge]
                mu, c = near.mean(0), np.cov(near.T, bias=True)
            found.append((np.log(np.diag(factor(c))).sum(), start, mu, c))
        return (len(v), *min(found, key=lambda f: f[:2])[2:])

    by = lambda key: {k: estimate(np.array([x[d] for d in x if key(d) == k])) for k in {key(d) for d in x}}
    own, pool, out = by(lambda d: group[d]), by(lambda d: group[d][0]), {}
    for d in x:
        (n, mu, c), (_, pmu, pc) = own[group[d]], pool[group[d][0]]
        w, gap = n / (n + R.PRIOR), mu - pmu
        out[d] = d2(x[d][None], w * mu + (1 - w) * pmu, w * c + (1 - w) * pc + w * (1 - w) * np.outer(gap, gap))[0]
    return out


def test_quality_rules_against_numpy(spark):
    """Groups of 3 to 120 rows, ordinary documents and outliers of every feature."""
    r = random.Random(6)
    rows = []
    for lang, source, size in (("en", "a", 120), ("en", "b", 12), ("en", "c", 3), ("de", "a", 60), (None, None, 20)):
        for k in range(size):
            words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9 if lang == "en" else 13))) for _ in range(r.randint(50, 300))]
            if k % 9 == 4:
                words = [w + r.choice(["%", "#*", ""]) for w in words]
            if k % 11 == 5:
                words = words[: len(words) // 4] * 2 + words
            text = " ".join(words[:40]) + "\n" + " ".join(words[40:])
            rows.append((len(rows), text + ("\nagain and again" * 3 if k % 7 == 2 else ""), lang, source))
    want = brute_distances(rows)
    got = {g.doc_id: g for g in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    assert {d for d, g in got.items() if not g.base_failed} == set(want) and len(want) > 150
    assert all(abs(got[d].d2 - v) <= 1e-4 * (1 + v) for d, v in want.items())
    assert all(got[d].kept == (v <= quality_rules.CUTOFF) for d, v in want.items())
    assert 5 < sum(v > quality_rules.CUTOFF for v in want.values()) < len(want) / 2


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, goal, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            goal |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            goal[s] = most * sizes[s]
        left -= sum(goal[s] for s in over)
        open_ -= over
    return goal


def test_mixing(docs, rows, none):
    got = mixing.mix_plan(docs, block_words=8).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(D.WORD.findall(r[1] or ""))
    goal = brute_targets(sizes)
    for s in sizes:
        mine = [g for g in got if g.source == s]
        assert all(abs(g.target - goal[s]) < 1e-6 and g.source_size == sizes[s] and 0 <= g.taken <= 2 * g.size for g in mine)
        assert abs(sum(g.taken for g in mine) - goal[s]) <= 16
    again = mixing.mix_plan(docs.repartition(5), block_words=8)
    assert D.as_rows(again, "doc_id", "size", "taken") == sorted([(g.doc_id, g.size, g.taken) for g in got], key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    other = mixing.mix_plan(docs, block_words=8, shards=32).select("doc_id", "taken")
    assert D.as_rows(other, "doc_id", "taken") != D.as_rows(again, "doc_id", "taken")
    assert mixing.mix_plan(none).count() == 0
    whole = mixing.repeat_taken(docs)
    assert whole.columns == docs.columns and whole.count() > 0


def test_draws_are_multinomial_and_permuted(spark):
    t = spark.createDataFrame([("a", 320_000, 400_000.0), ("b", 33, 66.0)], "sk string, source_size long, target double")
    got = {s: mixing.draws(t, 32, s, 20).collect() for s in (1, 16)}
    for rows in got.values():
        a = [r for r in rows if r.sk == "a"]
        assert sorted(r.slot for r in a) == list(range(12_500)) and set(r.block for r in a if r.slot < 10_000) == set(range(10_000))
        again = [r.block for r in a if r.slot >= 10_000]
        assert len(set(again)) == 2_500 and 4_500 < np.mean(again) < 5_500
        assert sorted(r.block for r in rows if r.sk == "b") == [0, 0, 1, 1]
    shards = np.bincount([r.shard for r in got[16] if r.sk == "a"], minlength=16)
    # chi-square with 15 degrees of freedom: neither far off nor dealt out evenly
    assert 3 < ((shards - 12_500 / 16) ** 2 / (12_500 / 16)).sum() < 45
    place = {s: {r.slot: r.block for r in rows if r.sk == "a"} for s, rows in got.items()}
    assert sum(place[1][k] == place[16][k] for k in place[1]) < 50
    with pytest.raises(ValueError):
        mixing.draws(t, 32, 12, 20)


def spark_hash(*xs):
    """Spark's xxhash64 of strings, 8-byte and (as a tuple) 4-byte integers; null leaves the hash as it is."""
    h = 42
    for x in xs:
        if x is not None:
            h = xxhash.xxh64(x.encode() if isinstance(x, str) else struct.pack("<i", x[0]) if isinstance(x, tuple) else struct.pack("<q", x), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_counts(n, shards, *key):
    nodes = [(0, n)]
    for level in range(shards.bit_length() - 1):
        half, out = shards >> (level + 1), []
        for at, m in nodes:
            left = sum(bin(spark_hash(*key, (level,), (at,), (i,)) & 0xFFFFFFFF & ((1 << min(m - 32 * i, 32)) - 1)).count("1") for i in range((m + 31) // 32))
            out += [(at, left), (at + half, m - left)]
        nodes = out
    return [m for _, m in nodes]


def brute_perm(x, n, *key):
    for r in range(1, mixing.ROUNDS + 1):
        other = (spark_hash(*key, (r,)) % n - x) % n
        if spark_hash(*key, (r,), max(x, other)) % 2 == 0:
            x = other
    return x


def brute_taken(rows, block_words, shards, seed=20, counts=brute_counts):
    """doc_id and taken of each row, block by block."""
    sources, out = {}, []
    for r in rows:
        sources.setdefault(r[3], []).append((spark_hash(r[0], spark_hash(r[1])) % mixing.PARTS, r[0] is not None, r[0] or 0, spark_hash(r[1]), len(D.WORD.findall(r[1] or "")), r[0]))
    goal = brute_targets({s: sum(x[4] for x in v) for s, v in sources.items()})
    for s, docs in sources.items():
        size = sum(x[4] for x in docs)
        if not size:
            out += [(x[5], 0) for x in docs]
            continue
        blocks = -(-size // block_words)
        n = min(math.floor(goal[s] * blocks / size + 0.5), 2 * blocks)
        times, rest, skh = [n // blocks] * blocks, n % blocks, spark_hash("n" if s is None else "s" + s)
        by_shard = [0] * shards
        for run in range(-(-rest // mixing.RUN)):
            by_shard = [a + b for a, b in zip(by_shard, counts(min(rest - run * mixing.RUN, mixing.RUN), shards, (seed,), "rest", skh, run), strict=True)]
        classes = [(blocks - j + shards - 1) // shards for j in range(shards)]
        take = [min(c, k) for c, k in zip(by_shard, classes, strict=True)]
        over = rest - sum(take)
        for j in range(shards):
            more = min(over, classes[j] - take[j])
            take[j], over = take[j] + more, over - more
            for k in range(take[j]):
                times[j + shards * brute_perm(k, classes[j], (seed,), skh, (j,))] += 1
        at = 0
        for x in sorted(docs):
            out.append((x[5], sum(times[w // block_words] for w in range(at, at + x[4]))))
            at += x[4]
    return out


def test_taken_equals_brute_force(docs, rows):
    key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
    for block_words, shards in ((8, 64), (3, 4), (50, 1)):
        got = D.as_rows(mixing.mix_plan(docs, block_words=block_words, shards=shards), "doc_id", "taken")
        assert got == sorted(brute_taken(rows, block_words, shards), key=key)


def test_counts_decide_what_is_taken(docs, monkeypatch):
    """All draws on one shard take other blocks, and as many; a source capped at two passes takes all all the same."""
    plan = lambda: {(g.source, g.doc_id, g.size): g for g in mixing.mix_plan(docs.dropDuplicates(["doc_id"]), block_words=8, shards=16).collect()}
    was = plan()
    monkeypatch.setattr(mixing, "shard_counts", lambda n, shards, *key: F.concat(F.array(n.cast("int")), F.array_repeat(F.lit(0), shards - 1)))
    now = plan()
    assert sum(was[k].taken != now[k].taken for k in was) > 5
    for s in {k[0] for k in was}:
        a, b = (sum(g.taken for k, g in x.items() if k[0] == s) for x in (was, now))
        assert abs(a - b) <= 16


def test_mixed_blocks(docs, rows, none):
    """Every drawn block holds whole words of its source, and a document's words come as often as the plan takes them."""
    got = mixing.mixed_blocks(docs, block_words=8, shards=4).collect()
    assert {g.shard for g in got} == {0, 1, 2, 3} and all(0 < len(g.text.split(" ")) <= 8 for g in got if "\x00" not in g.text)
    plan = mixing.mix_plan(docs.dropDuplicates(["doc_id", "text"]), block_words=8, shards=4).collect()
    whole = mixing.mixed_blocks(docs.dropDuplicates(["doc_id", "text"]), block_words=8, shards=4).collect()
    for s in {r.source for r in plan}:
        assert sum(len(D.WORD.findall(g.text)) for g in whole if g.source == s) == sum(r.taken for r in plan if r.source == s)
    # repeated rows are documents of their own, one after the other: with them too, words come as often as planned
    plan, whole = mixing.mix_plan(docs, block_words=8, shards=4).collect(), got
    for s in {r.source for r in plan}:
        assert sum(len(D.WORD.findall(g.text)) for g in whole if g.source == s) == sum(r.taken for r in plan if r.source == s)
    assert mixing.mixed_blocks(none).count() == 0


def test_mixing_of_short_sources(spark):
    """A source capped at twice its size takes every word twice, however short its last block."""
    sizes = {"a": 7, "b": 20, "c": 33, "d": 0, "z": 4000}
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes.items())]
    got = {g.source: g for g in mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {s: got[s].target for s in "abc"} == {"a": 14, "b": 40, "c": 66}
    assert {s: got[s].taken for s in "abcd"} == {"a": 14, "b": 40, "c": 66, "d": 0}
    assert abs(got["z"].taken - got["z"].target) <= 32


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(t):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, f in forms.items():
        for m in re.finditer(f, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, none):
    texts = [None, "", "é mail a.b@c.de and x@y, a@b.c_d@e.f.g", "ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.0001 1..2.3.4", "10.0.0.1 192.168.0.1 0.0.0.0 8.8.8.0 00.000.0255.0 0256.1.1.0 host 1.2.3.00000000000000000000000000000000000000", "card 4539 1488 0343 6467 4539148803436467 5-5-5", "+1 (017) 555-7713 and +4912345 then +1+22 333 4444444",
             "9" * 30000, "a" * 30000 + "@b.c", "1 2 " * 3000, "b@c" + ".d" * 5000, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "😀 +1 (017) 555-7713 😀 q@w.er", "@".join(["ab.c"] * 40), "x@y.zz 1.2.3.4 " * 1100]
    docs = spark.createDataFrame([(k, t, "keep") for k, t in enumerate(texts)] * 2, "doc_id long, text string, spans string")
    for g in pii.find_spans(docs).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect():
        assert g.base == brute_base(texts[g.doc_id]), g.doc_id
        assert set(filter(None, g.base.split(","))) <= set(g.spans.split(","))
    assert pii.find_spans(none).count() == 0


def test_pii_spans_of_planted_kinds(spark):
    """Recall and precision of the added spans by kind, with look-alikes that aren't personal."""
    r = random.Random(1)
    word = lambda n: " ".join("".join(r.choices("aeioulnrst", k=r.randint(2, 8))) for _ in range(n))
    digit = lambda n: "".join(r.choices("0123456789", k=n))
    name = lambda: "".join(r.choices("aeiounrst", k=6)).capitalize()
    planted = [
        ("email", "contact: ", lambda: f"{word(1)}(at){word(1)}(dot)com", "", True), ("secret", 'api_key = "', lambda: "".join(r.choices("abcdef0123456789", k=40)), '"', True),
        ("ssn", "ssn: ", lambda: f"{r.randint(100, 599)}-{digit(2)}-{digit(4)}", "", True), ("iban", "IBAN: ", lambda: "DE" + digit(2) + " " + " ".join(digit(4) for _ in range(4)) + " " + digit(2), "", True),
        ("name", "call ", lambda: f"Mr {name()} {name()}", "", True), ("ssn", "version ", lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", "", False),
        ("ssn", "section ", lambda: f"000-{digit(2)}-{digit(4)}", "", False), ("secret", "token=", lambda: "a" * 20, "", False), None, None,
    ]
    rows, good, bad = [], set(), set()
    for d in range(600):
        text = word(12) + " "
        if (p := planted[d % 10]) is not None:
            kind, before, make, after, personal = p
            x = make()
            (good if personal else bad).add((d, kind, len(text) + len(before), len(text) + len(before) + len(x)))
            text += before + x + after
        rows.append((d, text + " " + word(6)))
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*").collect()
    found = {(g.doc_id, g.kind, g.s, g.e) for g in got}
    for kind in ("email", "secret", "ssn", "iban", "name"):
        mine = {g for g in good if g[1] == kind}
        assert len(mine & found) >= 0.9 * len(mine), kind
    assert len(found - good) <= 0.05 * len(found) and len(bad & found) <= 0.05 * len(bad)


LEADS = ["call", "then", "said", "paid", "casino", "hotel", "met", "from", "with", "about", "asks", "avoid", "piano", "grid"]


def made_iban(r):
    country, length = r.choice([("DE", 22), ("FR", 27), ("ES", 24), ("GB", 22), ("NL", 18)])
    rest = "".join(r.choices("0123456789", k=length - 4))
    if country in ("GB", "NL"):
        rest = "".join(r.choices("ABCDEFGHIJ", k=4)) + rest[4:]
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    whole = f"{country}{98 - number % 97:02}{rest}"
    return " ".join(whole[k : k + 4] for k in range(0, length, 4)) if r.random() < 0.5 else whole


def made_card(r):
    d = [int(c) for c in "4" + "".join(r.choices("0123456789", k=14))]
    total = sum(x if k % 2 else x * 2 - 9 * (x > 4) for k, x in enumerate(d))
    s = "".join(map(str, d)) + str(-total % 10)
    return r.choice("./_").join(s[k : k + 4] for k in range(0, 16, 4))


def test_pii_after_ordinary_words(spark):
    """Recall by kind and lead, with and without cue words, and look-alikes; base spans stay as they are."""
    r = random.Random(2)
    digit = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda n: " ".join("".join(r.choices("aeioulnrst", k=r.randint(2, 8))) for _ in range(n))
    name = lambda: r.choice(["Anna Keller", "Tom Young", "".join(r.choices("aeiounrst", k=6)).capitalize() + " " + "".join(r.choices("aeiounrst", k=5)).capitalize()])
    make = {
        "email": lambda: (f"{word(1)}(at){word(1)}(dot)com", "mail "), "secret": lambda: ("".join(r.choices("abcdef0123456789", k=32)), "token = "), "iban": lambda: (made_iban(r), "IBAN "),
        "ssn": lambda: (f"{r.randint(100, 599)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", "ssn "), "name": lambda: (f"{r.choice(['Mr', 'Mrs', 'Dr'])} {name()}", "contact "), "card": lambda: (made_card(r), "card "),
    }
    rows, planted = [], []
    for kind, one in make.items():
        for lead in LEADS:
            for k in range(12):
                x, cue = one()
                text = f"{word(5)} {lead} " + (cue if k % 2 or kind == "secret" else "")
                planted.append((len(rows), kind, len(text), len(text) + len(x), lead))
                rows.append((len(rows), text + x + " " + word(4)))
    first = len(rows)
    for k in range(240):  # numbers of versions and pages, masks, and words after a title
        x = [f"version {digit(3)}-{digit(2)}-{digit(4)}", f"page 000-{digit(2)}-{digit(4)}", "token=" + "a" * 24, f"section {digit(3)}-00-{digit(4)}"][k % 4]
        rows.append((len(rows), f"{word(5)} {x} {word(4)}"))
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("base")).alias("base"), F.explode_outer("spans").alias("x")).select("doc_id", "base", "x.*").collect()
    found = {(g.doc_id, g.kind, g.s, g.e) for g in got if g.kind}
    for kind in make:
        for lead in LEADS:
            mine = [p[:4] for p in planted if p[1] == kind and p[4] == lead]
            assert sum(p in found for p in mine) >= 0.9 * len(mine), (kind, lead)
    wrong = [f for f in found if f[0] >= first]
    assert len(wrong) <= 0.05 * 240 and len([f for f in found if f[0] < first]) <= 1.02 * len(planted)
    texts = dict(rows)
    assert all(g.base == brute_base(texts[g.doc_id]) for g in got)


def test_account_and_card_checks(spark):
    r = random.Random(3)
    ibans = [made_iban(r).replace(" ", "") for _ in range(50)] + ["GB82WEST12345698765432", "DE89370400440532013000"]
    wrong = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in ibans]
    df = spark.createDataFrame([(x, True) for x in ibans] + [(x, False) for x in wrong], "x string, want boolean")
    assert df.where(pii.mod_97(F.col("x")) != F.col("want")).count() == 0


def test_one_very_long_text(spark):
    """A text of 10 MB beside small ones, through every operator on texts."""
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghijé", k=r.randint(2, 9))) for _ in range(5000)]
    line = lambda: " ".join(r.choices(vocabulary, k=12))
    long = "\n".join(line() for _ in range(130_000)) + " a.b@c.de 10.0.0.1"
    assert len(long.encode()) > 10_000_000
    rows = [(1, long, "en", "s"), (2, "x" * 3_000_000 + " y", "en", "s"), (3, "\n" * 200_000, "en", "s"), (4, long[5_000_000:5_000_400], "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    first = lambda df: {g.doc_id: g for g in df.collect()}
    stats = first(quality_rules.judged(docs))
    assert stats[1].n_words == len(long.split()) and stats[2].n_words == 2 and stats[3].base_failed
    gone = first(suffix_dedup.remove_repeats(docs).drop("kept"))
    assert gone[1].n_bytes == len(long.encode()) and gone[4].n_removed == len(rows[3][1].encode())
    tokens = first(sentencepiece_codec.encode_documents(docs, model_path()).select("doc_id", "n_tokens", (F.col("decoded") == F.col("text")).alias("same")))
    assert all(t.same for t in tokens.values()) and tokens[1].n_tokens > 2_000_000
    assert sum(g.taken for g in mixing.mix_plan(docs).collect()) > 0
    lines = first(line_dedup.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped"))
    assert lines[1].n_lines == 130_000 and lines[3].n_lines == 200_001 and not lines[3].n_dropped
    spans = first(pii.find_spans(docs).select("doc_id", F.size("base").alias("n")))
    assert spans[1].n == 2 and spans[2].n == 0
    links = first(ngram_join.linked_documents(docs))
    assert links[1].n_shingles > 1_000_000 and [links[d].component_id for d in (1, 2, 3, 4)] == [1, 2, 3, 4]
    model = {"w": np.linspace(-1, 1, line_crf.WIDTH), "shift": np.zeros(1), "t": np.zeros((2, 2))}
    assert all(0 <= g.score <= 1 for g in line_crf.score(docs, model).select("doc_id", "score").collect())
