"""Budgets on serialised sizes against writing everything anew after each cut."""

import json
import random

from graphloom.operators import budgets as B

SIZE = lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode("utf-16-le")) // 2


def arrays(x, path=""):
    if isinstance(x, list):
        yield path, x
        for i, v in enumerate(x):
            yield from arrays(v, f"{path}[{i}]")
    elif isinstance(x, dict):
        for k, v in x.items():
            yield from arrays(v, f"{path}.{k}" if path else k)


def brute(x, budget):
    dropped = {}
    while (over := SIZE(x) - budget) > 0:
        full = [(p, a) for p, a in arrays(x) if a]
        if not full:
            break
        path, a = min(full, key=lambda pa: (-SIZE(pa[1]), pa[0]))
        average = max(1.0, SIZE(a) / len(a))
        cut = min(max(-int(-over // average), 1), len(a))
        del a[-cut:]
        dropped[path] = dropped.get(path, 0) + cut
    return x, dropped


def made(r, depth=0):
    kind = r.random()
    if depth < 4 and kind < 0.35:
        return [made(r, depth + 1) for _ in range(r.randint(0, 6))]
    if depth < 4 and kind < 0.6:
        return {r.choice("abcdé\"") + str(i): made(r, depth + 1) for i in range(r.randint(0, 4))}
    return r.choice([None, True, r.randint(-99, 10**12), 'x"\\\n\u0001é😀' * r.randint(0, 5), "z" * r.randint(0, 60)])


def test_fit_json_equals_brute_force(spark):
    r = random.Random(7)
    rows = [(k, json.dumps([made(r) for _ in range(5)] if k % 2 else {"a": made(r), "b": [made(r) for _ in range(6)]}), "kept") for k in range(400)]
    rows += [(1000, None, ""), (1001, "not json", ""), (1002, "[]", ""), (1003, '"a long text without any list, which stays as it is"', ""), (1004, "[1.50,2e3,[],[[[1]]],7]", "")]
    df = spark.createDataFrame(rows, "id long, body string, truncated string")
    for budget in (0, 40, 150, 10**6):
        got = {x.id: x for x in B.fit_json(df, "body", budget).collect()}
        assert len(got) == len(rows)
        for k, body, _ in rows[:400]:
            want, dropped = brute(json.loads(body), budget)
            assert json.loads(got[k].body) == want and got[k].truncated == dropped
        assert got[1000].body is None and got[1000].truncated is None and got[1001].body == "not json" and got[1001].truncated is None
        assert got[1003].truncated == {}
    assert got[1004].body == rows[-1][1]  # numbers stay as they are written


def brute_entries(entries, most, budget):
    size = lambda e: len(json.dumps({k: v for k, v in e.items() if v is not None}, ensure_ascii=False, separators=(",", ":")))
    out, used = [], 0
    for e in entries[:most]:
        was, e, room = e, dict(e), budget - used
        while size(e) > room and e["description"] is not None:
            keep = len(e["description"]) - (size(e) - room) - 1
            e["description"] = e["description"][:keep] + "…" if keep > 0 else None
        while size(e) > room and e["criteria"]:
            e["criteria"] = e["criteria"][:-1]
        if size(e) > room:
            e["labels"] = None
        if size(e) > room:
            break
        used += size(e)
        out.append((e, size(e), e["description"] != was["description"], len(e["criteria"]) < len(was["criteria"])))
    return out


def test_fit_entries_equals_brute_force(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice('ab "\\é\n') for _ in range(r.randint(0, n)))
    keys = {k: [{"id": f"AB#{i}", "status": r.choice(["confirmed", None]), "type": "Bug", "state": None, "title": text(60), "description": r.choice([None, text(300)]), "labels": r.choice([None, [], [text(9)] * 3]), "criteria": [text(80) for _ in range(r.randint(0, 6))]} for i in range(r.randint(1, 5))] for k in range(150)}
    rows = [(k, i, *e.values()) for k, v in keys.items() for i, e in enumerate(v)]
    df = spark.createDataFrame(rows, "k long, ord long, id string, status string, type string, state string, title string, description string, labels array<string>, criteria array<string>")
    for budget in (150, 400, 1200):
        got: dict = {}
        for x in B.fit_entries(df, "k", 3, budget).orderBy("k", "place").collect():
            got.setdefault(x.k, []).append(x)
        for k, v in keys.items():
            want = brute_entries(v, 3, budget)
            assert [({c: x[c] for c in B.ENTRY}, x.size, x.body_cut, x.criteria_cut) for x in got.get(k, [])] == want
            assert {x.left_out for x in got.get(k, [])} <= {len(v) - len(want)}
