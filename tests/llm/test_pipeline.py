"""The pipeline's stages on a small table, each against plain Python."""

import math
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import quality_rules

from . import docs as D
from .test_text_operators import brute_distances, brute_taken, spark_hash

COLUMNS = ("doc_id", "text", "lang", "source")


def kept_rows(rows):
    far = brute_distances([(k, r.text, r.lang, r.source) for k, r in enumerate(rows)])
    return [r for k, r in enumerate(rows) if k in far and far[k] <= quality_rules.CUTOFF]


def without_common_lines(rows):
    key = lambda x: x.strip(D.SPACES).translate(D.LOWER)
    seen: dict = {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            seen.setdefault(key(x), set()).add(r.doc_id)
    return [(r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if not (key(x) and len(seen[key(x)]) >= 10))) for r in rows]


def copies(rows, seed=20):
    """Each row as often as the mix takes it: what is taken over its size, rounded by a hash of its id; equal rows alike."""
    taken = brute_taken([(r.doc_id, r.text, r.lang, r.source) for r in rows], 32, 64)
    sizes = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    most: dict = {}
    waiting: dict = {}
    for d, n in taken:
        waiting.setdefault(d, []).append(n)
    for r in rows:
        for n in waiting[r.doc_id]:
            if n and sizes[r]:
                luck = math.fmod(spark_hash((seed,), "copy", r.doc_id), 1 << 20) / (1 << 21) + 0.5
                most[r.doc_id, r.text] = max(most.get((r.doc_id, r.text), 0), math.floor(n / sizes[r] + luck))
    return [(r.doc_id, r.text) for r in rows for _ in range(most.get((r.doc_id, r.text), 0))]


@pytest.mark.parametrize("wide", [False, True])
def test_stages(spark, tmp_path, wide):
    # ids are unique but for repeated rows, so that a row's share of the mix can be told by its id
    rows = D.documents(9, 240)
    frame = D.frame(spark, rows)
    docs = frame if wide else frame.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pairs = lambda rs: sorted(((r.doc_id, r.text) for r in rs), key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name == "quality_rules":
            assert pairs(after) == pairs(kept_rows(before)) and 0 < len(after) < len(before)
        if name == "line_dedup":
            assert pairs(after) == sorted(without_common_lines(before), key=str)
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "ngram_join":
            want = D.components([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after if r.doc_id is not None} == {c for _, c in want.values()}
        if name == "mix_sources":
            assert pairs(after) == sorted(copies(before), key=str)
        if name == "sentencepiece":
            assert sorted(r.decoded for r in after) == sorted(r.text for r in before)


def test_empty_table(spark, tmp_path):
    D.frame(spark, []).select(*COLUMNS, "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in names)] == [] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
