"""Joins, classifiers and pages against plain Python."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import embedding_forest, html_diff, line_crf, ngram_join
from graphloom.operators.components import connected_components

from . import docs as D


@pytest.fixture(scope="module")
def rows():
    return D.documents(3, 90)


def test_ngram_join(spark, rows):
    docs = D.frame(spark, rows).repartition(3)
    want = D.components(rows)
    got = ngram_join.linked_documents(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None:
            assert (g.n_shingles, g.component_id) == want[g.doc_id]
    assert len({c for _, c in want.values()}) < len(want) - 5
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} | {None}
    assert ngram_join.linked_documents(D.frame(spark, [])).count() == 0


def test_ngram_join_at_the_threshold(spark):
    """80 of 100 shingles link, one less doesn't; the same through short and long lists."""
    base = [f"w{k}" for k in range(94)]
    same = base + [f"a{k}" for k in range(0)]
    # 90 shingles each with 80 of 100 in common, and 89 of which 79 of 99 are
    near = base[:84] + [f"b{k}" for k in range(10)]
    far = base[:83] + [f"c{k}" for k in range(10)]
    docs = [(1, " ".join(same)), (2, " ".join(near)), (3, " ".join(far))]
    sets = {d: D.shingles(t) for d, t in docs}
    assert (len(sets[1] & sets[2]), len(sets[1] | sets[2])) == (80, 100) and (len(sets[1] & sets[3]), len(sets[1] | sets[3])) == (79, 100)
    for many in (1, 63, 64, 65, 66):
        rows = docs + [(1000 + k, " ".join([*base[:93], f"z{k}"])) for k in range(many - 1)]
        got = {g.doc_id: g.component_id for g in ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = {d: c for d, (_, c) in D.components(rows).items()}
        assert got == want and got[2] == 1, many


def test_ngram_join_large_group(spark, monkeypatch):
    """Copies with edits beyond the short-list limit, in small chunks."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    r = random.Random(2)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for d in range(60):
        t = base.copy()
        for _ in range(r.randint(0, 5)):
            t[r.randrange(70)] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(t), None, None, 0, "", "", "", "", ""))
    want = D.components(rows)
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in ngram_join.linked_documents(D.frame(spark, rows)).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 60


def test_ngram_join_memory(spark, rows, monkeypatch):
    """No task has a chain of Python workers, prefixes don't hold their sets, and a chunk's texts are hashed in slices."""
    chained, real = [], ngram_join.materialize

    def written(df, *a):
        chained.append(df._jdf.queryExecution().optimizedPlan().toString().count("InArrow"))
        return real(df, *a)

    monkeypatch.setattr(ngram_join, "materialize", written)
    assert ngram_join.linked_documents(D.frame(spark, rows)).count() == len(rows)
    assert max(chained) == 1

    s = np.arange(1000, dtype=np.uint64)
    for common in (s[:0], s[:5]):
        assert ngram_join._prefix(s, common, 80).base is None

    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 1 << 18)
    n, each = 400, 1000
    texts = [" ".join(f"w{(d // 2 * each + k) % 10**6:06}" for k in range(each)) for d in range(n)]
    table = pa.table({"d": range(n), "t": texts, "side": [0] * n, "own": [True] * n, "root": range(n), "across": [False] * n})
    tracemalloc.start()
    found = ngram_join.verify_chunks(table, 5, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(found["b"].to_pylist(), found["a"].to_pylist(), strict=True)) == [(d, d + 1) for d in range(0, n, 2)]
    assert peak < 70 * n * each


def test_ngram_join_passages(spark, monkeypatch):
    """Passages in many documents connect most of them over long lists; yet few texts are exchanged, and no link is lost."""
    for name, value in (("SHORT_LIST", 4), ("BLOCK_SETS", 8), ("ROUND_SETS", 8), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    r = random.Random(8)
    passages = [[f"p{k}_{j}" for j in range(9)] for k in range(12)]
    rows = []
    for d in range(160):
        w = [f"d{d}_{j}" for j in range(40)] + r.choice(passages) + r.choice(passages)
        rows.append((1000 - d, " ".join(w), "en", "s", 0, "", "", "", "", ""))
        if d % 8 == 0:
            rows.append((2000 + d, " ".join([*w[:20], "x", *w[21:]]), "en", "s", 0, "", "", "", "", ""))
        if d < 9:  # a cluster beyond the short lists
            rows.append((3000 + d, " ".join([*(f"c{j}" for j in range(60)), f"y{d}"]), "en", "s", 0, "", "", "", "", ""))
    sent, real = [], ngram_join.with_texts
    monkeypatch.setattr(ngram_join, "with_texts", lambda members, texts: sent.append(members.count()) or real(members, texts))
    want = D.components(rows)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in ngram_join.linked_documents(D.frame(spark, rows)).collect()} == want
    assert len(rows) - 40 < len({c for _, c in want.values()}) < len(rows) - 20
    assert sum(sent) < len(rows), sent


def test_ngram_join_computes_prefixes_once(spark, rows, monkeypatch):
    """The postings of all prefixes are made once and exchanged once, whatever is broadcast; hot tokens go in parts."""
    want = D.components(rows)
    posted, real = spark.sparkContext.accumulator(0), ngram_join.prefix_postings

    def seen(batches):
        for b in batches:
            posted.add(b.num_rows)
            yield b

    monkeypatch.setattr(ngram_join, "prefix_postings", lambda *a: real(*a).mapInArrow(seen, "token long, s long, n long"))
    monkeypatch.setattr("graphloom.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join.spread_join, "__defaults__", ("inner", None, 0))
    docs, n = D.frame(spark, rows).repartition(3), {}
    for hot in (1 << 16, 3):
        posted.value = 0
        monkeypatch.setattr(ngram_join, "HOT_TOKEN", hot)
        got = ngram_join.linked_documents(docs).collect()
        assert {g.doc_id: (g.n_shingles, g.component_id) for g in got if g.doc_id is not None} == want
        n[hot] = posted.value
    sizes = {d: len(D.shingles(t)) for d, t, *_ in rows if d is not None}
    assert 0 < n[1 << 16] == n[3] <= sum(k - -(-k * 80 // 100) + 1 for k in sizes.values() if k) + 100


def test_forest_keeps_components(spark, monkeypatch):
    """Contracted in one piece or in many, edges have the components they had."""
    r = random.Random(5)
    edges = spark.createDataFrame([(k, r.randrange(150), r.randrange(150)) for k in (1, 2) for _ in range(90)], "k long, a long, b long").repartition(3)
    one = edges.where("k = 1")
    want = {tuple(x) for x in connected_components(one).collect()}
    for most in (1 << 20, 4):
        monkeypatch.setattr(ngram_join, "EDGES", most)
        star = ngram_join.forest(edges, "k").where("k = 1 AND a != b")
        assert {tuple(x) for x in connected_components(star).collect()} == want


@pytest.mark.parametrize("leaf, sample", [(64, 16_384), (10_000, 16_384), (64, 40)])
def test_embedding_forest(spark, monkeypatch, leaf, sample):
    """With leaves from the sample, with all leaves split on in rounds, and with both."""
    monkeypatch.setattr(embedding_forest, "LEAF", leaf)
    monkeypatch.setattr(embedding_forest, "SAMPLE", sample)
    monkeypatch.setattr(embedding_forest, "LEAF_CAP", 40)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((60, 16))
    rows = [(k, [float(x) for x in (centres[k % 60] + 0.12 * rng.standard_normal(16))], int(k % 60 % 2)) for k in range(500)]
    rows += [(1000, rows[3][1], rows[3][2]), (1001, rows[3][1], None), (1002, None, 1), (1003, [0.0] * 16, 1), (1004, [float("nan")] * 16, 1), (1005, [None] + [1.0] * 15, 1), (1006, [], 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (None, [1.0] * 16, 0)]
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    links, root = {r[0]: 0 for r in ok}, {r[0]: r[0] for r in ok}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93:
                links[a[0]] += 1
                links[b[0]] += 1
                x, y = top(a[0]), top(b[0])
                root[max(x, y)] = min(x, y)
    got = embedding_forest.near_vectors(spark.createDataFrame([(*x, 7, "b") for x in rows], "vec_id long, embedding array<float>, label int, n_links int, component_id string")).collect()
    assert len(got) == len(rows)
    known = {g.vec_id: g for g in got}
    assert sum(known[v].n_links for v in links) >= 0.9 * sum(links.values()) > 100
    assert all(known[v].n_links <= n for v, n in links.items())
    assert sum(known[v].component_id == top(v) for v in links) >= 0.95 * len(links)
    assert all(g.n_links == 0 and g.kept for v, g in known.items() if v not in links)
    assert all(g.kept == (g.vec_id == g.component_id) for g in got if g.vec_id is not None)
    assert embedding_forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_forward_backward_sums_over_all_sequences(monkeypatch):
    for segment in (1, 2, 3, 1024):
        monkeypatch.setattr(line_crf, "SEGMENT", segment)
        forward_backward_case()


def test_log_odds_are_those_of_the_whole_table():
    rng = np.random.default_rng(4)
    x, k = rng.standard_normal((9, 16)), 16
    model = {"w": rng.standard_normal(3 * k + 1), "shift": rng.standard_normal(1)}
    whole = line_crf.with_neighbours(x, np.array([0, 1, 4, 9]))
    assert np.allclose(line_crf.log_odds(x, np.array([0, 1, 4, 9]), model), whole @ model["w"] + model["shift"])


def forward_backward_case():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 1, 4, 9])
    z, t = rng.standard_normal(9), rng.standard_normal((2, 2))
    p, pairs = line_crf.forward_backward(z, t, bounds)
    want, total = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        weights = []
        for s in range(2**n):
            y = [(s >> k) & 1 for k in range(n)]
            weights.append((np.exp(sum(z[a + k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1))), y))
        norm = sum(w for w, _ in weights)
        for w, y in weights:
            want[a:b] += w / norm * np.array(y)
            for k in range(n - 1):
                total[y[k], y[k + 1]] += w / norm
    assert np.allclose(p, want) and np.allclose(pairs, total)


def brute_score(text, model):
    """The document's score with plain Python: features line by line, marginals by products along the chain."""
    import math

    rows, lines = [], (text or "").split("\n")
    words = [D.words(x) for x in lines]
    for x, w in zip(lines, words):
        count = lambda f: sum(map(f, x))
        capital, digit, space, symbol = (count(lambda c, s=s: c in s) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "#*$%&|<>"))
        letter = count(lambda c: "a" <= c <= "z" or ord(c) > 127)
        other, n, k = len(x) - capital - digit - space - symbol - letter, max(len(x), 1), max(len(w), 1)
        upper, repeats = capital / max(letter + capital, 1), (1 - len(set(w)) / k) * bool(w)
        single = sum(len(y.encode()) == 1 for y in w) / k
        rows.append([math.log1p(len(x)), math.log1p(len(w)), symbol / n, other / n, upper, digit / n, space / n, (len(x) - space) / k / 10, repeats, single, not w, bool(w) and words.count(w) > 1, symbol / n > 0.03, other / n > 0.12, upper > 0.5, repeats > 0.5])
    none = [0] * 16
    z = [sum(a * b for a, b in zip([1, *rows[i], *(rows[i - 1] if i else none), *(rows[i + 1] if i + 1 < len(rows) else none)], model["w"])) + model["shift"][0] for i in range(len(rows))]
    e, t = [(1.0, math.exp(v)) for v in z], [[math.exp(v) for v in r] for r in model["t"]]
    ahead, back = [list(e[0])], [[1.0, 1.0]]
    for i in range(1, len(z)):
        row = [e[i][j] * sum(ahead[-1][k] * t[k][j] for k in (0, 1)) for j in (0, 1)]
        ahead.append([v / sum(row) for v in row])
    for i in range(len(z) - 1, 0, -1):
        row = [sum(t[k][j] * e[i][j] * back[0][j] for j in (0, 1)) for k in (0, 1)]
        back.insert(0, [v / sum(row) for v in row])
    p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back)]
    weight = [len(x) + 1 for x in lines]
    return sum(a * b for a, b in zip(p, weight)) / sum(weight)


def test_line_crf_against_plain_python(spark, rows):
    rng = np.random.default_rng(12)
    model = {"w": rng.standard_normal(line_crf.WIDTH) * 0.7, "shift": np.array([0.3]), "t": np.array([[0.5, -0.4], [0.1, 0.9]])}
    got = line_crf.score(D.frame(spark, rows).repartition(3), model).select("doc_id", "text", "score", "predicted").collect()
    assert len(got) == len(rows)
    for g in got:
        want = brute_score(g.text, model)
        assert abs(g.score - want) < 1e-6 and (g.predicted == (want >= 0.5) or abs(want - 0.5) < 1e-6), g.doc_id


def test_line_crf(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("aeioulnrst", k=r.randint(2, 8)))
    rows, labels = [(0, None), (1, ""), (2, "\n\n"), (3, "x")], []
    for k in range(10, 310):
        good = k % 3 > 0
        lines = [" ".join(word() + ("" if good else r.choice(["%%%", "&&&", "!!"])) for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 7))]
        rows.append((k, "\n".join(lines)))
        labels.append((k, int(good)))
    docs = spark.createDataFrame([(*x, "a", "b") for x in rows], "doc_id long, text string, score string, predicted string")
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, quality int")
    out = {g.doc_id: g for g in line_crf.score(docs, line_crf.train(docs, lab)).withColumn("held", line_crf.held_out(F.col("doc_id"))).collect()}
    assert len(out) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in out.values())
    held = [(out[d].predicted, y) for d, y in labels if out[d].held]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    assert all(abs(g.score - 0.5) < 1e-9 for g in line_crf.score(docs, line_crf.train(docs, lab.limit(0))).collect())
    assert line_crf.score(docs.limit(0), line_crf.train(docs, lab)).count() == 0


def test_embedding_threshold_ties(spark):
    """A cosine of exactly the threshold links."""
    rows = [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.0, 1.0], 0), (4, [3.0, 4.0], 1)]
    got = {g.vec_id: g.n_links for g in embedding_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 0}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="home"><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- c --><div class="ad">Buy</div><div id="cookie-notice">We use</div>BODY<section id="comments"><article>Nice post</article></section><form>Mail</form><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    article = '<article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Sh&eacute;ared<ul><li>x<li>y</ul><aside>side</aside></article>'
    pages = [
        (1, "http://h.com/a/1", PAGE.replace("BODY", article)),
        (2, "http://h.com/a/2", PAGE.replace("BODY", "<article><p>Sh&eacute;ared</p><p>Own</p></article>")),
        (3, "http://g.com/b/1", PAGE.replace("BODY", "<div>Top line</div><p>Mine</p>")),
        (4, "http://g.com/b/2", PAGE.replace("BODY", "<div>Top line</div><p>Yours</p>")),
        (5, None, None), (6, "http://x.y", ""), (7, "http://x.y", "<p>a &lt;b&gt; c"), (8, "", "plain  text"),
    ]
    rows = [(*p, "keep") for p in pages] + [(*pages[6], "keep")]
    got = html_diff.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(1)).collect()
    text = {g.page_id: g.text for g in got}
    assert len(got) == 9 and all(g.n_chars == len(g.text) for g in got)
    assert text[1] == "A & B\nOne two three\nShéared\nx\ny"
    assert text[2] == "Shéared\nOwn"
    assert (text[3], text[4]) == ("Mine", "Yours")
    assert (text[5], text[6], text[7], text[8]) == ("", "", "a <b> c", "plain text")
    assert html_diff.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(7)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(html_diff.common_lines(a, b))
        it = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in it for i in got)


def test_common_lines_in_linear_space(monkeypatch):
    monkeypatch.setattr(html_diff, "MOST_BITS", 6)
    test_common_lines_is_a_longest_common_subsequence()


def brute_pages(rows):
    """Each page's text, with its partner found by looking at all pages."""
    import re

    def place(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", re.match(r"[^?#]*", url or "")[0])

    order = sorted(range(len(rows)), key=lambda k: (*place(rows[k][1]), k))
    out = {}
    for at, k in enumerate(order):
        host, path = place(rows[k][1])
        near = [order[x] for x in (at - 1, at + 1) if 0 <= x < len(order) and place(rows[order[x]][1])[0] == host and host]
        lines = html_diff.page_lines(rows[k][2] or "")
        shared = set()
        if near:
            same = lambda p: sum(1 for _ in iter_same(path.split("/"), place(rows[p][1])[1].split("/")))
            shared = html_diff.common_lines([x.text for x in lines], [x.text for x in html_diff.page_lines(rows[max(near, key=same)][2] or "")])
        out[rows[k][0]] = "\n".join(x.text for n, x in enumerate(lines) if not x.noise and (x.main or n not in shared))
    return out


def iter_same(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


def test_html_against_all_pairs(spark):
    """Pages with and without a declared main part; the alignment decides on both kinds."""
    r = random.Random(11)
    line = lambda: " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=r.randint(1, 2)))
    rows = []
    for k in range(80):
        body = "".join(f"<div>{line()}</div>" for _ in range(r.randint(0, 6)))
        if k % 3:
            body += f"<main><p>{line()}</p><p>own {k}</p></main><div>{line()}</div>"
        rows.append((k, f"http://h{k % 3}.org/{r.randrange(4)}/{r.randrange(3)}/{k:02}?q", f"<nav>x</nav>{body}<footer>y</footer>"))
    rows += [(90, None, "<p>a"), (91, "HTTP://H0.org", None)]
    got = {g.page_id: g.text for g in html_diff.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == brute_pages(rows)
    alone = {k: "\n".join(x.text for x in html_diff.page_lines(h or "") if not x.noise) for k, _, h in rows}
    assert sum(got[k] != alone[k] for k in range(80) if k % 3) > 10 and sum(got[k] != alone[k] for k in range(80) if not k % 3) > 3


def test_html_tokens_are_linear():
    import time

    began = time.time()
    for part in ('<a b="x ', "<a ", "<a b='x \" ", "<!x ", "<b>", "<b></i>", "<!-- "):
        html_diff.page_lines(part * 100_000)
    assert time.time() - began < 20
    many = [str(k % 997) for k in range(30_000)]
    assert len(html_diff.common_lines(many, many[5000:] + many[:5000])) >= 25_000


def test_html_pairs_across_ranges(spark):
    """However many ranges the pages are dealt to, each has the neighbour that it has in one range."""
    page = "<div>Site {0}</div><p>Part {1}</p><p>Own {2}</p>"
    rows = [(k, f"http://h{k // 12}.com/p{k // 4}/{k:03}", page.format(k // 12, k // 4, k)) for k in range(36)] + [(99, "http://alone.com/", "<p>Only</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {g.page_id: g.text for g in html_diff.extract_text(pages).collect()}
            assert got == {k: f"Own {k}" for k in range(36)} | {99: "Only"}, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
