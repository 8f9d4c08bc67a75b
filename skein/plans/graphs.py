"""Queries on the property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.plans.references import TABLES, named_table
from skein.sources.tables import table

_NODE = ("id", "label", "file_path", "name", "start_line", "end_line")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationships", "edge_id", "type", "source_id", "target_id").dropDuplicates(["edge_id"])


def _start(spark: SparkSession, d: str) -> DataFrame:
    """The source of most edges among methods and functions, by number, then id."""
    e = _edges(spark, d).join(table(spark, d, "nodes", "id").distinct().withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return e.groupBy(F.col("source_id").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def graph_stats_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return G.counts_with_zeros(table(spark, d, "nodes", "id", "label").distinct(), "label", G.LABELS)


def relationship_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.counts_with_zeros(_edges(spark, d), "type", G.TYPES)


def top_labels(spark: SparkSession, d: str) -> DataFrame:
    return G.bars(G.counts_with_zeros(table(spark, d, "nodes", "id", "label").distinct(), "label", G.LABELS), 12)


def browse_nodes_page(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", *_NODE).where("label = 'Function'").distinct()
    return n.orderBy("id", "start_line").offset(40).limit(20)


def node_captions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "name", "module")
    full = lambda c: F.nullif(c, F.lit(""))
    return n.select("id", F.coalesce(full("name"), full("module"), F.substr("id", F.lit(1), F.lit(20))).alias("caption")).distinct()


def validate_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").withColumn("missing", G.missing_properties(table(spark, d, "nodes")))
    return n.groupBy("label").agg(F.count_if(F.size("missing") == 0).alias("valid"), F.count_if(F.size("missing") > 0).alias("invalid"))


def upsert_nodes_merge(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "label", "name", "end_line", "visibility", "indexed_at").distinct()
    return G.merge_properties(n, ["label", "id"], "indexed_at").select("label", "id", "name", "end_line", "visibility", "writes")


def upsert_edges_drop_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Each end is looked for in the table that its label names."""
    edges = table(spark, d, "relationships", "edge_id", "type", "source_label", "source_id", "target_label", "target_id").dropDuplicates(["edge_id"])
    key = lambda name, i: F.concat(name, F.lit(":"), i)  # noqa: E731 - null for a null id
    keyed = edges.select("type", *[c for side in ("source", "target") for c in (key(named_table(F.col(f"{side}_label")), F.col(f"{side}_id")).alias(f"{side}_id"), F.col(f"{side}_id").alias(f"_{side}"))])
    ids = [table(spark, d, t, "id").select(key(F.lit(t), F.col("id")).alias("id")) for t in ("nodes", *TABLES.values())]
    kept = G.connected_edges(keyed, reduce(DataFrame.unionByName, ids))
    return kept.select("type", F.col("_source").alias("source_id"), F.col("_target").alias("target_id")).distinct()


def edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("source_id", "target_id").alias("pairs"))


def graph_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    return G.placeholders(table(spark, d, "files", "path"), table(spark, d, "nodes", "file_path", "label"))


def k_hop_out(spark: SparkSession, d: str) -> DataFrame:
    paths = G.paths_out(_edges(spark, d), _start(spark, d), 2)
    return paths.groupBy("id").agg(F.min("hops").alias("hops"), F.count("*").alias("paths"))


def related_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.paths_out(_edges(spark, d), _start(spark, d), 1).select("source_id", "id", "hops").orderBy("id").limit(10)


def subgraph_undirected(spark: SparkSession, d: str) -> DataFrame:
    return G.reach(_edges(spark, d), _start(spark, d), 2).orderBy("hops", "id").limit(100)


def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges among the nodes that the subgraph shows."""
    e = _edges(spark, d).where("source_id IS NOT NULL AND target_id IS NOT NULL")
    return G.reach_edges(e, subgraph_undirected(spark, d)).select("type", "source_id", "target_id").distinct()


def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return G.resolved_calls(table(spark, d, "nodes", "id", "label", "file_path", "name", "start_line", "call_sites"))


def export_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.export_edges(table(spark, d, "files", "id", "path", "exports"), table(spark, d, "nodes", "id", "file_path", "name", "start_line"))


_CHUNK = ("id", "file_path", "start_line", "class_name", "function_name", "parent_function", "imports", "exports", "symbols_defined", "call_sites")


def rebuild_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_from_chunks(table(spark, d, "chunks", *_CHUNK))[0]


def rebuild_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = G.graph_from_chunks(table(spark, d, "chunks", *_CHUNK))[1]
    return edges.groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("source_id").alias("sources"), F.count_distinct("target_id").alias("targets"))


_E = "e AS (SELECT DISTINCT edge_id, type, source_id, target_id FROM relationships)"
_S = f"{_E}, st AS (SELECT source_id AS id FROM e WHERE source_id IN (SELECT id FROM nodes) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 1)"
_VALUES = lambda v: ", ".join(f"('{x}')" for x in v)
_STATS = lambda v, rows: f"SELECT n.name, count(r.k) AS count, sum(count(r.k)) OVER ()::bigint AS total FROM (VALUES {_VALUES(v)}) n(name) LEFT JOIN ({rows}) r ON r.k = n.name GROUP BY n.name"
_ID = lambda name: f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3)::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name})) AS h))"
_MISSING = " ".join(f"WHEN '{label}' THEN {' AND '.join(f'{p} IS NOT NULL' for p in need)}" for label, need in G.REQUIRED.items())
_B = """b AS (SELECT DISTINCT id, file_path, CASE WHEN start_line > 0 THEN start_line ELSE 1 END AS line, nullif(class_name, '') AS cls, coalesce(nullif(function_name, ''), nullif(parent_function, '')) AS fn,
    coalesce(imports, []) AS imports, coalesce(exports, []) AS exports, coalesce(symbols_defined, []) AS symbols, coalesce(call_sites, []) AS calls FROM chunks WHERE length(file_path) > 0),
  raw AS (SELECT 'Chunk' AS label, id AS nm, file_path, 0 AS line FROM b UNION SELECT 'File', file_path, file_path, 1 FROM b UNION SELECT 'Class', cls, file_path, line FROM b WHERE cls IS NOT NULL UNION SELECT 'Function', fn, file_path, line FROM b WHERE fn IS NOT NULL
    UNION SELECT 'Import', unnest(imports), file_path, line FROM b UNION SELECT 'Variable', unnest(symbols), file_path, line FROM b UNION SELECT 'Function', unnest(calls), file_path, 1 FROM b WHERE fn IS NOT NULL)"""

QUERIES = {
    f.__name__: f
    for f in (graph_stats_zero_fill, relationship_stats, top_labels, browse_nodes_page, node_captions, validate_nodes, upsert_nodes_merge, upsert_edges_drop_dangling, edge_dedupe, graph_fallbacks, k_hop_out, related_nodes, subgraph_undirected, subgraph_edges, resolved_calls, export_edges, rebuild_nodes, rebuild_edges)
}
SQL = {
    "graph_stats_zero_fill": _STATS(G.LABELS, "SELECT label AS k FROM (SELECT DISTINCT id, label FROM nodes)"),
    "relationship_stats": _STATS(G.TYPES, "SELECT type AS k FROM (SELECT DISTINCT edge_id, type FROM relationships)"),
    "top_labels": f"WITH c AS ({_STATS(G.LABELS, 'SELECT label AS k FROM (SELECT DISTINCT id, label FROM nodes)')}), t AS (SELECT name, count FROM c WHERE count > 0 ORDER BY count DESC, name LIMIT 12) SELECT name, count, round(100.0 * count / max(count) OVER ())::int AS width FROM t",
    "browse_nodes_page": "SELECT DISTINCT id, label, file_path, name, start_line, end_line FROM nodes WHERE label = 'Function' ORDER BY id, start_line LIMIT 20 OFFSET 40",
    "node_captions": "SELECT DISTINCT id, coalesce(nullif(name, ''), nullif(module, ''), substr(id, 1, 20)) AS caption FROM nodes",
    "validate_nodes": f"WITH v AS (SELECT label, CASE label {_MISSING} END AS ok FROM nodes) SELECT label, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM v GROUP BY label",
    "upsert_nodes_merge": "WITH n AS (SELECT DISTINCT id, label, name, end_line, visibility, indexed_at FROM nodes) SELECT label, id, name, end_line, visibility, count(*) OVER (PARTITION BY label, id) AS writes FROM n QUALIFY row_number() OVER (PARTITION BY label, id ORDER BY indexed_at DESC) = 1",
    "upsert_edges_drop_dangling": f"""WITH k AS (SELECT 'nodes' AS t, id FROM nodes UNION SELECT 'files', id FROM files UNION SELECT 'chunks', id FROM chunks UNION SELECT 'modules', id FROM modules UNION SELECT 'glossary', id FROM glossary),
        t AS (SELECT * FROM (VALUES ('File', 'files'), ('Chunk', 'chunks'), ('Module', 'modules'), ('GlossaryEntry', 'glossary')) v(label, name))
        SELECT DISTINCT type, source_id, target_id FROM relationships r LEFT JOIN t a ON a.label = source_label LEFT JOIN t b ON b.label = target_label WHERE type IN ({', '.join(repr(t) for t in G.TYPES)})
          AND source_label IS NOT NULL AND target_label IS NOT NULL AND (coalesce(a.name, 'nodes'), source_id) IN (SELECT t, id FROM k) AND (coalesce(b.name, 'nodes'), target_id) IN (SELECT t, id FROM k)""",
    "edge_dedupe": f"WITH {_E} SELECT type, count(*) AS edges, count(DISTINCT (source_id, target_id)) FILTER (source_id IS NOT NULL AND target_id IS NOT NULL) AS pairs FROM e GROUP BY type",
    "graph_fallbacks": "WITH w AS (SELECT DISTINCT path, unnest(['Class', 'Function', 'Import']) AS label, unnest(['AnonymousClass', 'anonymous', './module']) AS name FROM files) SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.file_path = w.path AND n.label = w.label)",
    "k_hop_out": f"""WITH RECURSIVE {_S}, p AS (SELECT id AS node, 0 AS hops, []::bigint[] AS path FROM st UNION ALL SELECT e.target_id, hops + 1, list_append(path, edge_id) FROM p JOIN e ON e.source_id = p.node WHERE hops < 2 AND NOT list_contains(path, edge_id))
        SELECT node AS id, min(hops) AS hops, count(*) AS paths FROM p WHERE hops > 0 GROUP BY 1""",
    "related_nodes": f"WITH {_S} SELECT source_id, target_id AS id, 1 AS hops FROM e WHERE source_id IN (SELECT id FROM st) ORDER BY target_id NULLS FIRST LIMIT 10",
    "subgraph_undirected": f"""WITH {_S}, l AS (SELECT source_id AS a, target_id AS b FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION SELECT target_id, source_id FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
        x AS (SELECT DISTINCT b FROM l WHERE a IN (SELECT id FROM st)), y AS (SELECT DISTINCT b FROM l WHERE a IN (SELECT b FROM x)), u AS (SELECT id, 0 AS hops FROM st UNION ALL SELECT b, 1 FROM x UNION ALL SELECT b, 2 FROM y)
        SELECT id, min(hops) AS hops FROM u GROUP BY id ORDER BY hops, id LIMIT 100""",
    "subgraph_edges": f"""WITH {_S}, l AS (SELECT source_id AS a, target_id AS b FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION SELECT target_id, source_id FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
        x AS (SELECT DISTINCT b FROM l WHERE a IN (SELECT id FROM st)), y AS (SELECT DISTINCT b FROM l WHERE a IN (SELECT b FROM x)), u AS (SELECT id, 0 AS hops FROM st UNION ALL SELECT b, 1 FROM x UNION ALL SELECT b, 2 FROM y)
        , r AS (SELECT id, min(hops) AS hops FROM u GROUP BY id ORDER BY hops, id LIMIT 100) SELECT DISTINCT type, source_id, target_id FROM e WHERE source_id IN (SELECT id FROM r) AND target_id IN (SELECT id FROM r)""",
    "resolved_calls": """WITH c AS (SELECT DISTINCT id AS source_id, file_path, unnest(call_sites) AS name FROM nodes WHERE label IN ('Function', 'Method')),
        t AS (SELECT file_path, name, id FROM nodes WHERE label = 'Function' AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path, name ORDER BY start_line, id) = 1)
        SELECT DISTINCT source_id, t.id AS target_id FROM c JOIN t USING (file_path, name)""",
    "export_edges": """WITH c AS (SELECT DISTINCT id AS source_id, path AS file_path, unnest(exports) AS name FROM files), t AS (SELECT file_path, name, id FROM nodes WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path, name ORDER BY start_line, id) = 1)
        SELECT DISTINCT source_id, t.id AS target_id FROM c JOIN t USING (file_path, name)""",
    "rebuild_edges": f"""WITH {_B}, f AS (SELECT *, file_path || ':File' AS f, 'C:' || file_path || ':' || cls || ':' || line::varchar AS ci, 'F:' || file_path || ':' || fn || ':' || line::varchar AS fi FROM b),
        i AS (SELECT f, 'I:' || file_path || ':' || m || ':' || line::varchar AS m FROM (SELECT *, unnest(imports) AS m FROM f) WHERE m <> ''), v AS (SELECT f, 'V:' || file_path || ':' || s || ':' || line::varchar AS v FROM (SELECT *, unnest(symbols) AS s FROM f) WHERE s <> ''),
        x AS (SELECT f, CASE WHEN e = cls THEN ci WHEN e = fn THEN fi WHEN list_contains(symbols, e) THEN 'V:' || file_path || ':' || e || ':' || line::varchar END AS t FROM (SELECT *, unnest(exports) AS e FROM f) WHERE e <> ''),
        k AS (SELECT fi, 'F:' || file_path || ':' || c || ':1' AS t FROM (SELECT *, unnest(calls) AS c FROM f WHERE fn IS NOT NULL) WHERE c <> ''),
        r AS (SELECT 'CONTAINS' AS type, f AS a, id AS z FROM f UNION SELECT unnest(['CONTAINS', 'DEFINES']), f, ci FROM f WHERE cls IS NOT NULL UNION SELECT 'CONTAINS', ci, id FROM f WHERE cls IS NOT NULL UNION SELECT unnest(['CONTAINS', 'DEFINES']), f, fi FROM f WHERE fn IS NOT NULL
          UNION SELECT 'CONTAINS', fi, id FROM f WHERE fn IS NOT NULL UNION SELECT unnest(['CONTAINS', 'IMPORTS', 'DEPENDS_ON']), f, m FROM i UNION SELECT unnest(['CONTAINS', 'DEFINES']), f, v FROM v UNION SELECT 'EXPORTS', f, t FROM x WHERE t IS NOT NULL UNION SELECT 'CALLS', fi, t FROM k)
        SELECT type, count(*) AS edges, count(DISTINCT a) AS sources, count(DISTINCT z) AS targets FROM r GROUP BY type""",
    "rebuild_nodes": f"WITH {_B}, d AS (SELECT DISTINCT label, nm, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(file_path || ':' || label || ':' || nm || ':' || line::varchar)) AS h FROM raw WHERE nm <> '') SELECT label, CASE WHEN label = 'Chunk' THEN nm ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3)::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS id FROM d",
}
