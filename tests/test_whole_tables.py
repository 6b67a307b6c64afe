"""Queries over whole tables against plain Python."""

import os

import pyarrow.parquet as pq
import pytest

from graphloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def columns(folder, name, *cols):
    return list(zip(*(pq.read_table(f"{folder}/{name}.parquet", columns=[c])[c].to_pylist() for c in cols), strict=True))


def brute_components(edges, vertices):
    beside = {v: set() for v in vertices}
    for a, b in edges:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    least = {}
    for v in sorted(beside):
        stack = [] if v in least else [v]
        while stack:
            x = stack.pop()
            if x not in least:
                least[x] = v
                stack += beside[x]
    number = {c: k + 1 for k, c in enumerate(sorted(set(least.values())))}
    return {(v, c, number[c]) for v, c in least.items()}


def test_weak_components_of_all_rows(spark):
    customer = dict(columns(DATA, "orders", "o_orderkey", "o_custkey"))
    edges = {(f"c{customer[k]}", f"s{s}") for k, s in columns(DATA, "lineitem", "l_orderkey", "l_suppkey") if k in customer}
    vertices = [f"c{k}" for (k,) in columns(DATA, "customer", "c_custkey")] + [f"s{k}" for (k,) in columns(DATA, "supplier", "s_suppkey")]
    got = plans.QUERIES["weak_components_all"](spark, DATA).collect()
    assert len(got) == len({g.id for g in got}) and {(g.id, g.component, g.number) for g in got} == brute_components(edges, vertices)
    assert {a for a, _ in edges} <= {g.id for g in got}


def test_weak_components_of_a_fixture(spark, tmp_path):
    rows = {"orders": "o_orderkey long, o_custkey long", "lineitem": "l_orderkey long, l_suppkey long", "customer": "c_custkey long", "supplier": "s_suppkey long"}
    data = {"orders": [(k, k // 2) for k in range(12)], "lineitem": [(k, (k + 1) // 2 if k < 5 else 10 + k // 4) for k in range(12)], "customer": [(k,) for k in range(8)], "supplier": [(k,) for k in range(20)]}
    for name, schema in rows.items():
        spark.createDataFrame(data[name], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    customer = dict(data["orders"])
    edges = {(f"c{customer[k]}", f"s{s}") for k, s in data["lineitem"]}
    want = brute_components(edges, [f"c{k}" for k in range(8)] + [f"s{k}" for k in range(20)])
    got = plans.QUERIES["weak_components_all"](spark, str(tmp_path)).collect()
    assert {(g.id, g.component, g.number) for g in got} == want and len({c for _, c, _ in want}) > 5


def test_every_event_counts(spark):
    events = columns(DATA, "events", "event_id")
    got = {n: plans.QUERIES[n](spark, DATA) for n in ("merge_hashes_all", "numbers_crosscheck_all")}
    assert all(sorted(r.event_id for r in df.select("event_id").collect()) == sorted(e for (e,) in events) for df in got.values())
    users = {u for u, k in columns(DATA, "events", "user_id", "event_type") if k == "error"}
    assert {r.user_id for r in plans.QUERIES["interval_touch_all"](spark, DATA).collect()} == users


def test_every_row_is_an_edge_and_every_vertex_a_start(spark):
    """The starts, and a cyclic closure, against plain Python."""
    edges = {(a, (a * 7 + k % 3) % 50) for a, k in columns(DATA, "part", "p_size", "p_partkey")}
    least = {}
    for start in {a for a, _ in edges}:
        level, depth = {start}, 0
        while level:
            depth += 1
            level = {b for a, b in edges if a in level} - {b for s, b in least if s == start}
            least |= {(start, b): depth for b in level}
    got = {(r.src, r.dst): r.depth for r in plans.QUERIES["reference_closure_all"](spark, DATA).collect()}
    assert got == least and any(a == b for a, b in least)
    effects = columns(DATA, "part", "p_size", "p_type")
    want = set(effects) | {(a, x) for a, b in least for n, x in effects if n == b}
    assert {tuple(r) for r in plans.QUERIES["side_effects_closure_all"](spark, DATA).select("node", "effect").collect()} == want
    orders = {f"o{k}" for (k,) in columns(DATA, "lineitem", "l_orderkey")}
    assert orders == {r.node for r in plans.QUERIES["flow_trace_all"](spark, DATA).collect() if r.node[0] == "o"}
    assert {r.id for r in plans.QUERIES["ancestors_all"](spark, DATA).collect()} >= {f"c{k}" for (k,) in columns(DATA, "customer", "c_custkey")}
