"""Readers, scanners, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from graphloom.sources import readers, scanners, sinks
from graphloom.streaming import incremental


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_sql_scanner(spark):
    text = "CREATE TABLE shop.Baskets (k int);\nCREATE PROCEDURE [shop].[Pay] @basket int AS\n-- UPDATE shop.Stale\nSELECT k FROM shop.Baskets b JOIN Coins c ON b.k = c.k WHERE note = 'FROM nowhere'\nIF @basket > 0 EXEC shop.Notify"
    o = scanners.sql_objects(spark.createDataFrame([("f.sql", text)], "file string, text string"))
    assert rows(o, "kind", "name", "complexity") == [("procedure", "shop.pay", 2), ("table", "shop.baskets", 1)]
    assert rows(scanners.sql_references(o), "name", "kind", "target") == [("shop.pay", "calls", "shop.notify"), ("shop.pay", "reads", "coins"), ("shop.pay", "reads", "shop.baskets")]


def test_settings_and_manifests(spark):
    f = spark.createDataFrame([("a/appsettings.json", '{"A":{"B":"https://h.com/x","C":1},"D":true}'), ("a/.env", "# c\nexport X__Y=http://g.org\nZ = 1\n"), ("a/package.json", '{"dependencies":{"vue":"3.1.0"}}'), ("a/p.csproj", '<PackageReference Include="Dapper" Version="2.0.1" />'), ("compose.yml", "x"), ("k.yaml", "apiVersion: v1\nkind: Pod")], "file string, text string")
    assert rows(scanners.json_settings(f.where("file LIKE '%settings.json'")), "key", "host") == [("A:B", "h.com"), ("A:C", None), ("D", None)]
    assert rows(scanners.properties(f.where("file LIKE '%.env'")), "key", "host") == [("X:Y", "g.org"), ("Z", None)]
    assert rows(scanners.package_manifests(f), "ecosystem", "package", "version") == [("npm", "vue", "3.1.0"), ("nuget", "Dapper", "2.0.1")]
    assert rows(scanners.deployment_files(f)) == [("compose.yml", "compose"), ("k.yaml", "kubernetes")]


def test_deep_settings(spark):
    f = spark.createDataFrame([("s.json", '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1},"h":2},"x":3}}}}}')], "file string, text string")
    assert rows(scanners.json_settings(f), "key") == [("a:b:c:d:e",), ("a:b:c:d:x",)]


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"schema": "x", "started_at": "2024-01-01T00:00:00Z", "target": {"base_url": "u", "local": True}, "steps": [{"name": "s", "method": "GET", "path": "/a", "requests": 3, "failures": 0, "error_rate": 0.0, "latency_ms": {"p50": 1.0, "p95": 2.0, "p99": 3.0}}], "series": [{"t": 1.0, "requests": 2, "p95_ms": 5.0}]}))
    r = readers.load_report(spark, str(tmp_path / "r.json"))
    assert rows(r["steps"], "base_url", "path", F.col("latency_ms.p95")) == [("u", "/a", 2.0)] and r["series"].count() == 1
    (tmp_path / "e.md").write_text("# T\n| id | kind | text | source | version |\n|---|---|---|---|---|\n| R-1 | requirement | a \\| b | docs/x.md | 1 |\n")
    assert rows(readers.evidence_markdown(spark, str(tmp_path / "e.md"))) == [("R-1", "requirement", "a | b", "docs/x.md", "1")]
    items = spark.createDataFrame([("R-1", "requirement"), ("T-1", "test"), ("bad", "x")], "id string, kind string")
    links = spark.createDataFrame([("R-1", "T-1")], "from string, to string")
    assert rows(readers.evidence_problems(items, links), "problem") == [("bad-id",), ("bad-kind",), ("bad-link",)]


def test_sinks(spark):
    inv = spark.createDataFrame([("npm", "vue", "3.1.0"), ("npm", "vue", "3.1.0"), ("npm", "x", "^1")], "ecosystem string, package string, version string")
    got = sinks.sbom_components(inv).collect()
    assert [json.loads(r.component)["purl"] for r in got] == ["pkg:npm/vue@3.1.0", "pkg:npm/x"]
    p = lambda *r: spark.createDataFrame(r, "path string, content string")
    assert rows(sinks.changed_pages(p(("a", "1"), ("b", "2")), p(("a", "1"), ("b", "3"), ("c", "4")))) == [("b", "changed"), ("c", "removed")]


def test_stream(spark, tmp_path):
    schema = "sha string, committedAt timestamp, subject string"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"sha":"a","committedAt":"2024-01-01T00:00:00Z","subject":"x"}\n' * 2)
    q = incremental.commits_stream(spark, str(tmp_path / "in"), schema).writeStream.format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in/2.json").write_text('{"sha":"a","committedAt":"2024-01-01T00:00:00Z","subject":"x"}\n{"sha":"b","committedAt":"2024-01-02T00:00:00Z","subject":"y"}\n')
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("commits"), "sha") == [("a",), ("b",)]


def test_sql_statements_keep_places_and_comments(spark):
    text = """-- licence

/* Old
   note */
create table [Shop].Baskets (k int, note text default 'CREATE VIEW no'); -- CREATE TABLE not
CREATE INDEX i ON Baskets (k)

-- Pays *one* basket
  --  and closes it
CREATE OR ALTER PROCEDURE shop.Pay @basket int, @name varchar (20) AS
IF @basket > 0 -- WHEN hidden
  SELECT CASE WHEN 1 = 1 THEN 'it''s' END
GO
-- far

CREATE FUNCTION f() RETURNS int BEGIN RETURN 1 END"""
    o = scanners.sql_statements(spark.createDataFrame([("f.sql", text), ("n.sql", None), ("e.sql", "")], "file string, text string"))
    assert rows(o, "kind", "name", "line", "end_line", "doc", "complexity") == [("function", "f", 16, 16, "far", 1), ("procedure", "shop.pay", 10, 15, "Pays one basket and closes it", 3), ("table", "shop.baskets", 5, 9, "Old note", None)]
    assert {r.name: r.parameters for r in o.collect()} == {"f": [], "shop.pay": ["@basket: int", "@name: varchar (20)"], "shop.baskets": []}
    cut = text.splitlines(keepends=True)
    assert {r.name: r.body for r in o.collect()}["shop.pay"] == "".join(cut[9:15])
    assert spark.createDataFrame([(text,)], "t string").select((F.length(scanners.blanked_sql(F.col("t"))) == F.length("t")).alias("x")).first().x


def test_sql_statements_of_a_large_file(spark):
    """Statements over several blocks, with characters of two to four bytes; no row carries its file through the windows."""
    parts = [f"/* é😀 no {k} */\nCREATE TABLE t{k} (x int); -- ü CREATE VIEW no\n" + "-- ß😀" * ((k + 5) % 7) * 60 + "\n" for k in range(150)] + ["-- odd */\nCREATE VIEW v AS SELECT 1\n"]
    o = scanners.sql_statements(spark.createDataFrame([("f.sql", "".join(parts)), ("g.sql", "\n\ncreate view w as select '/*'")], "file string, text string"))
    got = {r.name: r for r in o.collect()}
    at, text = 0, "".join(parts)
    for k, part in enumerate(parts[:-1]):
        r, start = got[f"t{k}"], at + part.index("CREATE")
        end = at + len(part) + parts[k + 1].index("CREATE")
        assert (r.line, r.doc, r.body) == (text[:start].count("\n") + 1, f"é😀 no {k}", text[start:end])
        at += len(part)
    assert got["v"].doc == "odd /" and got["v"].body == "CREATE VIEW v AS SELECT 1\n" and (got["w"].line, got["w"].doc) == (3, None)
    plan = o._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan and "text#" not in plan[: plan.index("Generate")]


def test_history_and_work_items(spark, tmp_path):
    commit = lambda sha, files=(), items=(): {"sha": sha, "parents": [], "subject": f"s {sha}", "committedAt": "2024-01-02T00:00:00Z", "kind": "commit", "files": list(files), "workItems": list(items)}
    touched = {"path": "a.cs", "oldPath": "b.cs", "status": "renamed", "granularity": "lines", "ranges": [{"oldStart": 1, "oldCount": 1, "newStart": 4, "newCount": 3}, {"oldStart": 9, "oldCount": 2, "newStart": 9, "newCount": 0}]}
    pull = {"id": "#7", "title": "T", "status": "confirmed", "commits": ["c2"], "workItems": []}
    (tmp_path / "h.json").write_text(json.dumps({"schema": "history/v2", "provider": "github", "repository": "r", "commits": [commit("c2", [touched], [{"workItem": "#1", "source": "s", "kind": "k", "evidence": "e"}]), commit("c1")], "pullRequests": [pull]}))
    h = readers.history(spark, str(tmp_path / "h.json"))
    assert rows(h["commits"], "sha", "order") == [("c1", 0), ("c2", 1)]  # oldest first
    assert rows(h["files"], "sha", "path", "oldPath", "status") == [("c2", "a.cs", "b.cs", "renamed")]
    assert rows(h["hunks"], "path", "first", "last") == [("a.cs", 4, 6), ("a.cs", 9, 8)]  # the second only deletes
    assert rows(h["work_items"], "sha", "workItem") == [("c2", "#1")] and rows(h["pull_requests"], "id", "commits") == [("#7", ["c2"])]
    item = lambda i, rev, title, day: {"id": i, "revision": rev, "type": "Bug", "state": "New", "title": title, "changedDate": f"2024-01-0{day}T00:00:00Z", "description": {"text": "d"}, "relations": [{"kind": "parent", "id": 9}]}
    for name, content in (("w1.json", item(1, 2, "old", 1)), ("w2.json", item(1, 3, "new", 1)), ("w3.json", item(1, 3, "newest", 2)), ("w4.json", item(2, 1, "other", 1))):
        (tmp_path / name).write_text(json.dumps(content))
    assert rows(readers.work_items(spark, str(tmp_path / "w*.json")), "id", "title") == [(1, "newest"), (2, "other")]


def test_test_snapshots_and_evidence_csv(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"format": "v2", "plans": [{"id": 1, "name": "P"}], "testCases": [{"id": 5, "title": "c", "suiteIds": [2]}], "assignments": [{"planId": 1, "suiteId": 2, "testCaseId": 5}], "requirements": [{"id": 8, "title": "r", "testCaseIds": [5]}]}))
    t = readers.test_snapshot(spark, str(tmp_path / "t.json"))
    assert rows(t["plans"]) == [(1, "P")] and rows(t["testCases"]) == [(5, "c", [2])] and rows(t["assignments"]) == [(1, 2, 5)] and rows(t["requirements"]) == [(8, "r", [5])]
    (tmp_path / "e.csv").write_text('id,kind,text,source,version\nR-1,requirement,"a, b\nc",docs/x.md,1\n')
    assert rows(readers.evidence_csv(spark, str(tmp_path / "e.csv"))) == [("R-1", "requirement", "a, b\nc", "docs/x.md", "1")]


def test_listing_by_endings(spark, tmp_path):
    for name in ("src/A.cs", "src/B.CS", "src/obj/C.cs", "web/node_modules/x/D.cs", "src/E.d.ts", "src/F.ts", "src/G.txt", "gen/H.cs"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"one\ntwo {name}")
    got = readers.text_files(spark, str(tmp_path), [".cs", ".ts"], ["*/gen/*"])
    assert sorted(r.file.rpartition("/")[2] for r in got.collect()) == ["A.cs", "B.CS", "F.ts"]
    assert {r.text for r in got.where("file LIKE '%A.cs'").collect()} == {"one\ntwo src/A.cs"}
    kinds = got.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), F.lit("class").alias("kind"))
    assert rows(sinks.scan_summary(kinds)) == [("ending", ".cs", 2), ("ending", ".ts", 1), ("kind", "class", 3)]


def test_php_and_migrations(spark):
    php = "<?php\n// class No {}\nabstract class Cart extends Base { function &add(int $x) { $s = 'function no() {}'; } }\ninterface Pays {}\nfunction helper() {}\n"
    f = spark.createDataFrame([("a.php", php), ("db/migrations/V2__b.sql", "x"), ("db/V10_1__A.sql", "x"), ("db/migration/001_first.sql", "x"), ("db/other.sql", "x")], "file string, text string")
    assert rows(scanners.php_symbols(f.where("file = 'a.php'")), "kind", "name") == [("class", "Cart"), ("interface", "Pays"), ("method", "add"), ("method", "helper")]
    assert rows(scanners.migrations(f), "ord", "version", "file") == [(1, "001", "db/migration/001_first.sql"), (2, "10_1", "db/V10_1__A.sql"), (3, "2", "db/migrations/V2__b.sql")]


def test_model_file(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([("n1", "class", None), ("n2", "method", 3)], "id string, kind string, complexity int").coalesce(1), str(tmp_path / "m"))
    lines = [json.loads(x) for p in (tmp_path / "m").glob("part-*.json") for x in p.read_text().splitlines()]
    assert lines == [{"id": "n1", "kind": "class"}, {"id": "n2", "kind": "method", "complexity": 3}]


def test_same_name_pairs(spark):
    from graphloom.operators import joins

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = joins.same_name_pairs(ids("A.f(int)", "A.g()", "A.h(a)", "A.h(b)"), ids("A.f(long)", "A.g()", "A.g(int)", "A.h(c)"))
    assert rows(got) == [("A.f(int)", "A.f(long)")]
