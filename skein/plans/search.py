"""Queries that find and present: vectors, names, fusion, results, impact, glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import EXPANSIONS, clean_comment, expand_query
from skein.functions.vectors import l2_normalize, norm, usable
from skein.operators import glossary as G
from skein.operators import impact, parse
from skein.operators import retrieval as R
from skein.sources.tables import table


def _first_vector(rows: DataFrame, identity: str = "id") -> list[float]:
    """The query: the vector with the smallest identity."""
    found = rows.where(usable(F.col("embedding"), 64)).orderBy(identity).select("embedding").first()
    return [float(x) for x in found.embedding] if found else [1.0] + [0.0] * 63


def _points(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Chunks as they are delivered, some twice: ranking counts each once."""
    return table(spark, d, "chunks", "id", "embedding", *more)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return R.vector_topk(e, _first_vector(e, "vec_id"), 20, "vec_id").select("vec_id", "label", "score")


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = _points(spark, d, "language")
    return R.vector_topk(c, _first_vector(c), 20, where=F.col("language") == "typescript").select("id", "score")


def vector_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return R.vector_topk_per_group(e, _first_vector(e, "vec_id"), 3, "label", "vec_id").select("label", "rank", "vec_id", "score")


def vector_post_filter(spark: SparkSession, d: str) -> DataFrame:
    c = _points(spark, d, "file_path")
    return R.post_filter(R.vector_topk(c, _first_vector(c), 40), "*/src/*", 0.5).select("id", "file_path", "score")


def l2_normalized(spark: SparkSession, d: str) -> DataFrame:
    c = _points(spark, d).where(usable(F.col("embedding"), 64)).dropDuplicates(["id"])
    v = l2_normalize(F.col("embedding"))
    return c.select("id", F.round(norm(v), 6).alias("norm"), F.round(F.element_at(v, 1), 6).alias("first"))


def name_contains_search(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "label", "name", "file_path").distinct()
    return R.name_search(n, "Ledger", 25, ("name", "file_path"))


def graph_three_strategy(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "label", "name", "file_path").distinct()
    return R.graph_search(n, table(spark, d, "relationships", "source_id", "target_id"), "Method", 30)


def _arms(spark: SparkSession, d: str) -> list[DataFrame]:
    c = table(spark, d, "chunks", "id", "embedding", "text_content").dropDuplicates(["id"])
    near = R.ranked(R.vector_topk(c, _first_vector(c), 40), F.desc("score"), "id")
    held = c.where(F.contains(F.lower("text_content"), F.lit("ledger")))
    return [near, R.ranked(held.orderBy("id").limit(40), "id"), R.ranked(held.orderBy(F.desc("id")).limit(40), F.desc("id"))]


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.reciprocal_rank_fusion(_arms(spark, d)[:2], [0.7, 0.3])


def rrf_three_lists_zero_weight(spark: SparkSession, d: str) -> DataFrame:
    return R.reciprocal_rank_fusion(_arms(spark, d), [0.7, 0.3])


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    c = _points(spark, d)
    n = table(spark, d, "nodes", "id", "name").distinct()
    return R.hybrid_search(c, n, _first_vector(c), "ledger", 20)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("id", "score")


def hybrid_enriched(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "relationships", "type", "source_id", "target_id")
    out = R.enrich(_hybrid(spark, d), edges, table(spark, d, "nodes", "id", "name"))
    return out.select("id", "score", F.size("graph_context").alias("neighbours"), F.array_join(F.transform("graph_context", lambda x: x["id"]), ",").alias("near"))


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "title").where("title IS NOT NULL")
    return t.select("doc_id", expand_query(F.concat("title", F.lit(" test function"))).alias("query"))


def result_dedupe(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path", "function_name", "chunk_index").dropDuplicates(["id"])
    return R.first_per(c, ["file_path", "function_name"], "chunk_index", "id")


def source_citations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path", "start_line").dropDuplicates(["id"])
    return R.first_per(c, ["file_path", "start_line"], "id")


def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "repo", "file_path", "text_content").dropDuplicates(["id"])
    top = R.first_per(c, ["repo", "file_path"], "id").withColumn("block", R.context_block(F.col("file_path"), F.col("text_content")))
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("id"))).where("n <= 3")
    return top.groupBy("repo").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n")).alias("digest"), F.sum(F.length("block")).alias("characters"))


def format_results(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "embedding", "file_path", "start_line", "end_line", "function_name", "class_name", "language", "text_content")
    top = R.vector_topk(c, _first_vector(c), 10)
    top = top.join(R.ranked(top, F.desc("score"), "id"), "id")
    symbol = F.coalesce(F.nullif("function_name", F.lit("")), "class_name")
    block = R.result_block(F.col("rank"), F.col("score"), F.col("file_path"), F.col("start_line"), F.col("end_line"), symbol, F.col("language"), F.col("text_content"))
    return top.select("id", "rank", block.alias("block"))


def json_projection(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    top = R.vector_topk(c, _first_vector(c), 10)
    return top.select("id", R.result_json(top).alias("json"))


def impact_importers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path", "imports")
    return impact.importers(c, ["osprey-log", "ember-grid"]).select("id", "file_path").distinct()


def impact_callers(spark: SparkSession, d: str) -> DataFrame:
    return impact.callers(table(spark, d, "chunks", "id", "file_path", "call_sites"), "request").select("id", "file_path").distinct()


def impact_class_members(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "label", "name", "parent_class", "is_exported").where("parent_class LIKE '%Service'")
    return impact.exported_members(n, "LedgerService").select("id", "label", "name").distinct()


def impact_high_risk(spark: SparkSession, d: str) -> DataFrame:
    return impact.high_risk(table(spark, d, "chunks", "id", "text_content", "is_exported"), 3).select("id", "depth").distinct()


def semantic_structural(spark: SparkSession, d: str) -> DataFrame:
    c = _points(spark, d, "node_type", "is_exported")
    return R.vector_topk(c, _first_vector(c), 15, where=(F.col("node_type") == "program") & F.col("is_exported")).select("id", "score")


def glossary_normalize(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "glossary", "id", "term", "kind", "summary", "source", "confidence")
    return G.normal_entries(g).distinct()


def clean_comments(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "glossary", "id", "summary").where("summary IS NOT NULL")
    return g.select("id", clean_comment(F.col("summary")).alias("clean")).distinct()


def import_asof_symbol(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "label", "file_path", "start_line", "end_line").distinct()
    left = n.where("label IN ('Class', 'Interface', 'Function')").select(F.col("id").alias("before"), "file_path", "end_line")
    found = G.forward_asof(left, n.where("label <> 'Import'").select("id", "file_path", "start_line"), "file_path", "end_line", "start_line", 2, "id")
    return found.select("before", F.col("matched.id").alias("after"), F.col("matched.start_line").alias("line"))


def comment_asof_symbol(spark: SparkSession, d: str) -> DataFrame:
    c = parse.comments(table(spark, d, "files", "path", "content").distinct()).withColumnRenamed("path", "file_path")
    n = table(spark, d, "nodes", "id", "label", "file_path", "name", "start_line").where(F.col("label").isin(*G.LABEL_KINDS)).distinct()
    found = G.forward_asof(c, n, "file_path", "end_line", "start_line", 2, "id")
    return found.select("file_path", "end_line", F.col("matched.id").alias("symbol_id"), clean_comment(F.col("text")).alias("summary"))


def glossary_precedence(spark: SparkSession, d: str) -> DataFrame:
    g = G.normal_entries(table(spark, d, "glossary", "id", "term", "kind", "summary", "source", "confidence", "file_path", "updated_at").distinct())
    return G.preferred(g).select("file_path", "kind", "term", "id", "source")


def symbol_index(spark: SparkSession, d: str) -> DataFrame:
    return G.symbol_index(table(spark, d, "nodes", "id", "label", "file_path", "name", "start_line"))


def glossary_graph(spark: SparkSession, d: str) -> DataFrame:
    g = G.normal_entries(table(spark, d, "glossary", "id", "term", "kind", "summary", "source", "confidence"))
    return G.searchable(g).distinct()


_U = "(len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"
_E = f"q AS (SELECT embedding::double[] AS v FROM embeddings WHERE {_U} ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::double[], v), 6) AS score FROM embeddings, q WHERE {_U})"
_C = f"c AS (SELECT DISTINCT ON (id) * FROM chunks), q AS (SELECT embedding::double[] AS v FROM c WHERE {_U} ORDER BY id LIMIT 1), s AS (SELECT c.*, round(list_cosine_similarity(embedding::double[], v), 6) AS score FROM c, q WHERE {_U})"
_ARMS = f"""{_C}, v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 40), h AS (SELECT id FROM c WHERE contains(lower(text_content), 'ledger')),
    a AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM h QUALIFY rank <= 40), b AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS rank FROM h QUALIFY rank <= 40)"""
_FUSE = "SELECT id, round(sum(w / (60 + rank)), 9) AS score, min(l * 1000 + rank) // 1000 AS first_list, min(l * 1000 + rank) % 1000 AS first_rank FROM u GROUP BY id"
_HYBRID = f"""{_C}, v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 40),
    n AS (SELECT DISTINCT id, name FROM nodes), a AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM n WHERE contains(lower(name), 'ledger') QUALIFY rank <= 40),
    u AS (SELECT id, 0 AS l, rank, 0.7 AS w FROM v UNION ALL SELECT id, 1, rank, 0.3 FROM a), f AS (SELECT id, round(sum(w::double / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS seen FROM u GROUP BY id ORDER BY score DESC, seen, id LIMIT 20)"""
_EXPAND = " || ".join(f"CASE WHEN contains(l, '{t}') AND NOT contains(l, '{o}') THEN ' {o}' ELSE '' END" for t, others in EXPANSIONS.items() for o in others)
_TRIM = lambda c: f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
_KIND = f"CASE lower({_TRIM('kind')}) WHEN 'typealias' THEN 'type_alias' WHEN 'type-alias' THEN 'type_alias' WHEN 'property' THEN 'field' ELSE lower({_TRIM('kind')}) END"
_NORMAL = f"""g AS (SELECT * REPLACE ({_TRIM('term')} AS term, {_KIND} AS kind, {_TRIM('summary')} AS summary, coalesce(nullif({_TRIM('source')}, ''), 'comment') AS source,
    coalesce(confidence, CASE WHEN coalesce(nullif({_TRIM('source')}, ''), 'comment') = 'manual' THEN 1.0 ELSE 0.75 END) AS confidence) FROM glossary), e AS (SELECT * FROM g WHERE term <> '' AND kind <> '' AND summary <> '')"""

QUERIES = {
    f.__name__: f
    for f in (vector_topk, vector_topk_filtered, vector_topk_per_label, vector_post_filter, l2_normalized, name_contains_search, graph_three_strategy, rrf_fusion, rrf_three_lists_zero_weight, hybrid_search, hybrid_enriched, query_expansion, result_dedupe, source_citations, context_assembly, format_results, json_projection, impact_importers, impact_callers, impact_class_members, impact_high_risk, semantic_structural, glossary_normalize, clean_comments, import_asof_symbol, comment_asof_symbol, glossary_precedence, symbol_index, glossary_graph)
}
SQL = {
    "json_projection": f"""WITH {_C}, t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 10) SELECT id, to_json(struct_pack(id := id, score := round(score, 4), file_path := file_path, language := language, start_line := start_line, end_line := end_line,
        function_name := function_name, class_name := class_name, node_type := node_type, text_content := text_content, imports := imports, exports := exports, symbols_defined := symbols_defined, call_sites := call_sites, token_count := token_count))::varchar AS json FROM t""",
    "vector_topk": f"WITH {_E} SELECT vec_id, label, score FROM s ORDER BY score DESC, vec_id LIMIT 20",
    "vector_topk_filtered": f"WITH {_C} SELECT id, score FROM s WHERE language = 'typescript' ORDER BY score DESC, id LIMIT 20",
    "vector_topk_per_label": f"WITH {_E} SELECT label, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 3",
    "vector_post_filter": f"WITH {_C}, t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 40) SELECT id, file_path, score FROM t WHERE score >= 0.5 AND file_path LIKE '%/src/%'",
    "l2_normalized": f"WITH {_C}, n AS (SELECT id, embedding[1]::double AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) AS n FROM s) SELECT id, 1.0::double AS norm, round(e / n, 6) AS first FROM n",
    "name_contains_search": "SELECT DISTINCT id, label, name, file_path, 1.0::double AS score FROM nodes WHERE contains(lower(name), 'ledger') OR contains(lower(file_path), 'ledger') ORDER BY id LIMIT 25",
    "graph_three_strategy": """WITH a AS (SELECT DISTINCT id, 1.0 AS score FROM nodes WHERE contains(lower(name), 'method') OR contains(lower(file_path), 'method') ORDER BY id LIMIT 30),
        b AS (SELECT DISTINCT source_id AS id, 0.8 AS score FROM relationships WHERE target_id IN (SELECT id FROM nodes WHERE contains(lower(name), 'method')) AND source_id IN (SELECT id FROM nodes) ORDER BY id LIMIT 30),
        c AS (SELECT DISTINCT id, 0.6 AS score FROM nodes WHERE contains(lower(label), 'method') ORDER BY id LIMIT 30)
        SELECT id, max(score)::double AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id ORDER BY score DESC, id LIMIT 30""",
    "rrf_fusion": f"WITH {_ARMS}, u AS (SELECT id, 0 AS l, rank, 0.7::double AS w FROM v UNION ALL SELECT id, 1, rank, 0.3 FROM a) {_FUSE}",
    "rrf_three_lists_zero_weight": f"WITH {_ARMS}, u AS (SELECT id, 0 AS l, rank, 0.7::double AS w FROM v UNION ALL SELECT id, 1, rank, 0.3 FROM a UNION ALL SELECT id, 2, rank, 0.0 FROM b) {_FUSE}",
    "hybrid_search": f"WITH {_HYBRID} SELECT id, score FROM f",
    "hybrid_enriched": f"""WITH {_HYBRID}, e AS (SELECT DISTINCT source_id, type, target_id FROM relationships WHERE source_id IN (SELECT id FROM f)),
        k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY type, target_id) AS n FROM e QUALIFY n <= 5), g AS (SELECT source_id, count(*) AS neighbours, string_agg(target_id, ',' ORDER BY type, target_id) AS near FROM k GROUP BY 1)
        SELECT f.id, score, coalesce(neighbours, 0) AS neighbours, coalesce(near, '') AS near FROM f LEFT JOIN g ON g.source_id = f.id""",
    "query_expansion": f"WITH x AS (SELECT doc_id, title || ' test function' AS q, lower(title || ' test function') AS l FROM documents WHERE title IS NOT NULL) SELECT doc_id, q || {_EXPAND} AS query FROM x",
    "result_dedupe": "WITH c AS (SELECT DISTINCT id, file_path, function_name, chunk_index FROM chunks) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_path, function_name ORDER BY chunk_index, id) = 1",
    "source_citations": "WITH c AS (SELECT DISTINCT id, file_path, start_line FROM chunks) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_path, start_line ORDER BY id) = 1",
    "context_assembly": """WITH c AS (SELECT DISTINCT id, repo, file_path, text_content FROM chunks), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY id) = 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS n, CASE WHEN length(text_content) > 0 THEN '[file: ' || file_path || ']' || chr(10) || '```' || chr(10) || text_content || chr(10) || '```' END AS block FROM t QUALIFY n <= 3)
        SELECT repo, md5(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY n), '')) AS digest, sum(length(block))::bigint AS characters FROM n GROUP BY repo""",
    "format_results": f"""WITH {_C}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)
        SELECT id, rank, '[' || rank || '] ' || CASE WHEN start_line > 0 AND end_line > 0 THEN file_path || ':' || start_line || '-' || end_line ELSE file_path END
        || CASE WHEN length(coalesce(nullif(function_name, ''), class_name)) > 0 THEN ' (' || coalesce(nullif(function_name, ''), class_name) || ')' ELSE '' END
        || ' | score: ' || printf('%.4f', score) || chr(10) || '```' || coalesce(language, '') || chr(10) || text_content || chr(10) || '```' AS block FROM t""",
    "impact_importers": "SELECT DISTINCT id, file_path FROM chunks WHERE list_has_any(imports, ['osprey-log', 'ember-grid'])",
    "impact_callers": "SELECT DISTINCT id, file_path FROM chunks WHERE list_contains(call_sites, 'request')",
    "impact_class_members": "SELECT DISTINCT id, label, name FROM nodes WHERE parent_class = 'LedgerService' AND is_exported",
    "impact_high_risk": "WITH x AS (SELECT DISTINCT id, greatest(0, list_max(list_transform(string_split(text_content, chr(10)), lambda x: (length(x) - length(translate(x, '{([', ''))) - (length(x) - length(translate(x, '})]', '')))))) AS depth FROM chunks WHERE is_exported) SELECT * FROM x WHERE depth >= 3",
    "semantic_structural": f"WITH {_C} SELECT id, score FROM s WHERE node_type = 'program' AND is_exported ORDER BY score DESC, id LIMIT 15",
    "glossary_normalize": f"WITH {_NORMAL} SELECT DISTINCT id, term, kind, summary, source, confidence FROM e",
    "clean_comments": r"""WITH x AS (SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(summary, '^\s+|\s+$', '', 'g'), '^/\*\*?', ''), '\*/$', '') AS s FROM glossary WHERE summary IS NOT NULL)
        SELECT DISTINCT id, array_to_string(list_filter(list_transform(regexp_split_to_array(s, '\r\n|\n|\r'), lambda l: regexp_replace(regexp_replace(regexp_replace(l, '^\s*//\s?', ''), '^\s*\*\s?', ''), '^\s+|\s+$', '', 'g')), lambda l: l <> '' AND NOT starts_with(l, '@')), ' ') AS clean FROM x""".replace("\\\\", "\\"),
    "import_asof_symbol": """WITH n AS (SELECT DISTINCT id, label, file_path, start_line, end_line FROM nodes), b AS (SELECT id AS before, file_path, end_line FROM n WHERE label IN ('Class', 'Interface', 'Function'))
        SELECT before, n.id AS after, n.start_line AS line FROM b JOIN n ON n.file_path = b.file_path AND n.label <> 'Import' AND n.start_line > b.end_line AND n.start_line <= b.end_line + 2
        QUALIFY row_number() OVER (PARTITION BY before, b.end_line ORDER BY n.start_line, n.id) = 1""",
    "glossary_precedence": f"WITH {_NORMAL}, d AS (SELECT DISTINCT id, term, kind, summary, source, file_path, updated_at FROM e) SELECT file_path, kind, term, id, source FROM d QUALIFY row_number() OVER (PARTITION BY file_path, kind, term ORDER BY (source = 'manual')::int DESC, updated_at DESC NULLS LAST, id DESC) = 1",
    "symbol_index": """WITH n AS (SELECT DISTINCT id, file_path, name AS term, start_line, CASE label WHEN 'Class' THEN 'class' WHEN 'Field' THEN 'field' WHEN 'Function' THEN 'function' WHEN 'Method' THEN 'method' WHEN 'Variable' THEN 'variable' WHEN 'Interface' THEN 'interface' WHEN 'TypeAlias' THEN 'type_alias' END AS kind FROM nodes)
        SELECT file_path, kind, term, id AS symbol_id FROM n WHERE kind IS NOT NULL AND term IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path, kind, term ORDER BY start_line DESC, id DESC) = 1""",
    "glossary_graph": f"WITH {_NORMAL} SELECT DISTINCT id, term || ' (' || kind || '): ' || summary AS text_content, 'glossary_entry' AS node_type, term, kind FROM e",
}
