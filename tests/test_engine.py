import pytest

from skein.engine import Engine, check_sizes


def test_index_search_and_query(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "src/a.ts").write_text("import x from 'mod';\n/** Adds a pair of numbers. */\nexport function addPair(a: number, b: number) {\n  return sum(a, b);\n}\n")
    (repo / "b.js").write_text("class Queue {\n  push(x) { return x; }\n}\n")
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.index(str(repo), dry_run=True)["files"] == 2 and not engine.store.exists("files")
    counts = engine.index(str(repo), 50, 5)
    assert counts["files"] == 2 and counts["chunks"] == 2 and counts["nodes"] >= 4 and counts["glossary"] == 1
    assert engine.index(str(repo), 50, 5)["new_files"] == 0 and engine.store.read("chunks").count() == 2
    (repo / "b.js").write_text("class Stack {}\n")
    engine.index(str(repo), 50, 5)
    assert {r.name for r in engine.store.read("nodes").where("label = 'Class'").collect()} == {"Stack"} and engine.store.read("chunks").count() == 2
    top = engine.search("return sum(a, b);", "vector", 1).collect()
    assert [r.file_path for r in top] == ["src/a.ts"]
    assert engine.search("addpair", "graph", 5).first().name == "addPair"
    hybrid = engine.search("addPair", "hybrid", 4)
    assert {"id", "score", "graph_context"} <= set(hybrid.columns) and hybrid.count() == 4 and any(r.graph_context for r in hybrid.collect())
    assert engine.search("x", "vector", 5, file_pattern="*.js").count() == 1 and engine.search("x", "vector", 5, language="typescript").count() == 1
    assert "[file: src/a.ts]" in engine.context(engine.search("sum", "vector", 2))
    rows, cut = engine.query("SELECT name FROM nodes WHERE label = :label ORDER BY name", 1, label="Class")
    assert [r.name for r in rows.collect()] == ["Stack"] and not cut
    for good in ("WITH t AS (SELECT id FROM nodes) SELECT count(*) AS n FROM t UNION SELECT 1", "SELECT * FROM (SELECT label, count(*) c FROM nodes GROUP BY label HAVING c > 0) x ORDER BY c LIMIT 3", "SELECT id FROM nodes WHERE id IN (SELECT target_id FROM edges) EXCEPT SELECT id FROM chunks"):
        assert engine.query(good)[0].count() >= 0
    for bad in (
        "DROP TABLE nodes", "CREATE TABLE x AS SELECT 1", "SET a = b", "WITH t AS (SELECT 1 AS a) INSERT INTO victim SELECT * FROM t", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'DROP TABLE x'", "ANALYZE TABLE nodes COMPUTE STATISTICS", "MSCK REPAIR TABLE nodes",
        "UNCACHE TABLE nodes", "SELECT * FROM parquet.`/etc/x`", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM other", "SELECT (SELECT max(a) FROM text.`/etc/passwd`)", "INSERT INTO nodes SELECT * FROM nodes", "SELECT 1; DROP TABLE nodes", "nonsense",
    ):
        with pytest.raises(ValueError):
            engine.query(bad)
    with pytest.raises(ValueError):
        check_sizes(10, 10, 1)


def test_edges_meet_the_nodes(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "a.ts").write_text("import x from 'mod';\nclass Base {}\n/** Keeps the rows of a queue. */\nexport class Queue extends Base {\n  push(v) { return v; }\n}\n")
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index(str(repo), 50, 5)
    names = {r.id: "file" if r.label == "File" else r.name or r.label for r in engine.store.read("nodes").collect()} | {r.id: "entry" for r in engine.store.read("glossary").collect()} | {r.id: "chunk" for r in engine.store.read("chunks").collect()}
    edges = engine.store.read("edges").collect()
    got = {(r.type, names.get(r.source_id, "file"), names.get(r.target_id)) for r in edges}
    assert {("DEFINES", "file", "Queue"), ("EXPORTS", "file", "Queue"), ("INHERITS", "Queue", "Base"), ("CONTAINS", "Queue", "push"), ("CONTAINS", "Queue", "chunk"), ("IMPORTS", "file", "Import"), ("HAS_GLOSSARY", "Queue", "entry")} <= got
    assert all(r.target_id in names for r in edges)
    (repo / "a.ts").write_text("class Other {}\n")
    engine.index(str(repo), 50, 5)
    known = {r.id for r in engine.store.read("nodes").collect()}
    assert all({r.source_id, r.target_id} <= known for r in engine.store.read("edges").collect()) and engine.store.read("edges").count() > 0
    (repo / "b.ts").write_text("/** Sums all the rows. */\nexport async function total(rows: Row[], { deep = 1 } = {}) {\n  return helper(rows.map((x) => x.n));\n}\nfunction helper(x) { return x; }\ninterface Row { n: number }\n")
    (tmp_path / "hand.yaml").write_text("entries:\n  - {term: total, kind: function, summary: Adds up., file_path: b.ts}\n  - {term: helper, kind: function, summary: Helps.}\n  - {term: gone, kind: class, summary: x, file_path: z.ts}\n  - nothing\n")
    (repo / "a.ts").unlink()
    engine.index(str(repo), 50, 5, manual_glossary=str(tmp_path / "hand.yaml"))
    for t in ("files", "chunks", "nodes", "edges", "glossary"):
        assert {r[0] for r in engine.store.read(t).select("path" if t == "files" else "file_path").collect()} == {"b.ts"}
    nodes = {(r.label, r.name): r for r in engine.store.read("nodes").collect()}
    assert nodes["Function", "total"].parameters == ["rows", "deep"] and nodes["Function", "total"].is_async and nodes["Function", "total"].call_sites == ["helper", "rows.map"]
    ids = {r.id: r.name for r in nodes.values()}
    assert {("CALLS", "total", "helper")} <= {(r.type, ids.get(r.source_id), ids.get(r.target_id)) for r in engine.store.read("edges").collect()}
    assert {(r.term, r.source, r.summary) for r in engine.store.read("glossary").collect()} == {("total", "manual", "Adds up."), ("helper", "manual", "Helps.")}
    assert engine.store.healthy() and engine.store._versions("nodes")[-1] - engine.store._versions("nodes")[0] == 1
