from datetime import datetime as T

from pyspark.sql import functions as F

from skein.operators import glossary as GL
from skein.operators import graph as G
from skein.operators import retrieval as R


def test_upserts(spark, rows):
    df = spark.createDataFrame([("a", "x", 1, T(2025, 1, 1)), ("a", None, 2, T(2025, 1, 2)), ("b", "y", 3, T(2025, 1, 1))], "id string, name string, n int, at timestamp_ntz")
    assert rows(G.latest(df, ["id"], "at").select("id", "name", "n")) == [("a", None, 2), ("b", "y", 3)]
    assert rows(G.merge_properties(df, ["id"], "at").select("id", "name", "n", "writes")) == [("a", None, 2, 2), ("b", "y", 3, 1)]
    edges = spark.createDataFrame([("CALLS", "a", "b"), ("CALLS", "a", "b"), ("CALLS", "a", "z"), ("NOPE", "a", "b"), ("CALLS", None, "b")], "type string, source_id string, target_id string")
    assert rows(G.connected_edges(edges, df)) == [("CALLS", "a", "b")] or rows(G.connected_edges(edges, df).select("type", "source_id", "target_id")) == [("CALLS", "a", "b")]


def test_traversal_and_stats(spark, rows):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "a", "c"), (5, "x", None)], "edge_id bigint, source_id string, target_id string")
    start = spark.createDataFrame([("a",)], "id string")
    paths = rows(G.paths_out(edges, start, 3).select("id", "hops", "path"))
    assert ("a", 3, [1, 2, 3]) in paths and ("b", 3, [4, 3, 1]) in paths and len(paths) == 6
    assert rows(G.reach(edges, start, 2)) == [("a", 0), ("b", 1), ("c", 1)]
    nodes = spark.createDataFrame([("1", "Class"), ("2", "Class"), ("3", "Odd"), ("4", None)], "id string, label string")
    stats = {r.name: (r["count"], r.total) for r in G.counts_with_zeros(nodes, "label", G.LABELS).collect()}
    assert stats["Class"] == (2, 2) and stats["Method"] == (0, 2) and len(stats) == 12
    assert rows(G.bars(G.counts_with_zeros(nodes, "label", G.LABELS), 5)) == [("Class", 2, 100)]


def test_rebuild(spark, rows):
    schema = "id string, file_path string, start_line int, class_name string, function_name string, parent_function string, imports array<string>, exports array<string>, symbols_defined array<string>, call_sites array<string>"
    df = spark.createDataFrame([("c1", "f.ts", 3, "K", "go", None, ["m", "m", ""], ["K", "v", "zz"], ["v"], ["call"]), ("c2", "", 1, "K", None, None, None, None, None, None), ("c3", "g.ts", 0, None, None, None, None, None, None, None)], schema)
    nodes, edges = G.graph_from_chunks(df)
    assert sorted(r.label for r in nodes.collect()) == ["Chunk", "Chunk", "Class", "File", "File", "Function", "Function", "Import", "Variable"]
    kinds = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert kinds == {"CONTAINS": 8, "DEFINES": 3, "IMPORTS": 1, "DEPENDS_ON": 1, "EXPORTS": 2, "CALLS": 1}


def test_fusion_and_search(spark, rows):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    b = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = {r.id: r.score for r in R.reciprocal_rank_fusion([a, b], [0.7, 0.3]).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"b": 0.016208, "a": 0.011475, "c": 0.004839}
    assert {r.id: r.score for r in R.reciprocal_rank_fusion([a, b, b], [0.7]).collect()}["c"] == 0.0
    nodes = spark.createDataFrame([("1", "Class", "src/a", "Alpha"), ("2", "Method", "src/b", "beta"), ("3", "Import", "alpha/c", None)], "id string, label string, file_path string, name string")
    edges = spark.createDataFrame([("CALLS", "2", "1"), ("CALLS", "2", "9")], "type string, source_id string, target_id string")
    assert rows(R.graph_search(nodes, edges, "ALPHA", 10)) == [("1", 1.0), ("2", 0.8), ("3", 1.0)]
    assert rows(R.name_search(nodes, "alp", 10).select("id")) == [("1",)]
    points = spark.createDataFrame([("p", [1.0, 0.0], "x.ts"), ("q", [0.0, 1.0], None), ("r", None, "y"), ("s", [1.0, 0.0], "z.js")], "id string, embedding array<float>, file_path string")
    top = R.vector_topk(points, [1.0, 0.0], 2)
    assert rows(top.select("id", "score")) == [("p", 1.0), ("s", 1.0)]
    assert rows(R.post_filter(top, "*.ts", 0.5).select("id")) == [("p",)]
    hybrid = R.hybrid_search(points, nodes, [1.0, 0.0], "beta", 3)
    assert [r.id for r in hybrid.orderBy(F.desc("score"), "first_list", "first_rank").collect()] == ["p", "s", "q"]
    assert {r.id: len(r.graph_context) for r in R.enrich(spark.createDataFrame([("2", 1.0), ("7", 0.5)], "id string, score double"), edges, nodes).collect()} == {"2": 2, "7": 0}


def test_glossary(spark, rows):
    schema = "id string, term string, kind string, summary string, source string, confidence string, file_path string, updated_at string"
    df = spark.createDataFrame([("1", " A ", "Type-Alias", "s", None, None, "f", "2"), ("2", "A", "type_alias", "t", "manual", "0.5", "f", "1"), ("3", "B", "class", " ", "comment", "x", "f", "1"), ("4", "C", "property", "u", "comment", "bad", "f", None)], schema)
    normal = GL.normal_entries(df)
    assert rows(normal.select("id", "term", "kind", "source", "confidence")) == [("1", "A", "type_alias", "comment", 0.75), ("2", "A", "type_alias", "manual", 0.5), ("4", "C", "field", "comment", 0.75)]
    assert rows(GL.preferred(normal).select("id")) == [("2",), ("4",)]
    c = spark.createDataFrame([("f", 3), ("f", 9), ("g", 1), ("f", None)], "path string, end_line int")
    s = spark.createDataFrame([("f", 4, "b"), ("f", 5, "a"), ("f", 4, "c"), ("f", 12, "d"), ("g", 1, "e")], "path string, start_line int, id string")
    assert rows(GL.forward_asof(c, s, "path", "end_line", "start_line", 2, "id").select("path", "end_line", "matched.id")) == [("f", 3, "b")]
    pairs = spark.createDataFrame([("", "x"), ("a/b.ts", "b.ts"), ("b.ts", "/r/b.ts"), ("c", "d")], "a string, b string")
    assert [r[0] for r in pairs.select(GL.same_path(F.col("a"), F.col("b"))).collect()] == [True, True, True, False]
