"""Queries on the index itself: identifiers, files, chunks, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import ids, text
from skein.operators import chunking, embed, parse
from skein.operators.graph import latest
from skein.sources import scan, store
from skein.sources.tables import table

_UUID = """
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || substr('89ab', 1 + ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3)::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({}))"
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


def uuid5_file_ids(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "id", "path")
    new = ids.node_id(F.col("path"), F.lit("File"), F.col("path"), F.lit(1))
    return f.select("path", new.alias("computed"), (new == F.col("id")).alias("matches")).distinct()


def uuid5_node_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "label", "file_path", "name", "module", "start_line")
    new = ids.node_id(F.col("file_path"), F.col("label"), F.coalesce("name", "module"), F.col("start_line"))
    return n.select("id", new.alias("computed"), (new == F.col("id")).alias("matches")).distinct()


def uuid5_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path", "chunk_index", "file_hash")
    return c.select("id", ids.chunk_id(F.col("file_path"), F.col("chunk_index"), F.col("file_hash")).alias("point_id")).distinct()


def content_hash16(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "path", "content")
    return f.select("path", ids.content_hash(F.col("content")).alias("hash16")).distinct()


def collection_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "repo", "embedding").where("embedding IS NOT NULL")
    return c.select(ids.collection_name(F.lit("code_chunks"), F.concat("repo", F.lit(":v1")), F.size("embedding")).alias("collection")).groupBy("collection").agg(F.count("*").alias("points"))


def file_scan_filter(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "path").distinct()
    kept = f.where(~scan.skipped(F.col("path")) & scan.language(F.col("path")).isNotNull())
    return kept.select("path", scan.extension(F.col("path")).alias("extension"), scan.language(F.col("path")).alias("language"), scan.grammar(F.col("path")).alias("grammar"))


def binary_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "path", "content")
    return f.groupBy(scan.is_binary(F.col("content")).alias("binary")).agg(F.count_distinct("path").alias("files"))


def fnmatch_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path")
    return c.where(text.fnmatch(F.col("file_path"), "*/src/*[a-m]*.ts?")).distinct()


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "path", "content").where("content IS NOT NULL")
    return f.select("path", text.line_count(F.col("content")).alias("lines")).distinct()


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "text_content", "token_count")
    n = text.token_count(F.col("text_content"))
    return c.select("id", n.alias("tokens"), (n == F.col("token_count")).alias("as_stored")).distinct()


def nesting_depths(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "text_content").where("text_content IS NOT NULL")
    return c.select("id", text.nesting_depth(F.col("text_content")).alias("depth")).distinct()


def long_line_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.long_line_pieces(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 40)


def chunk_greedy(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_text(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 60, 12)


def chunk_numbering(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path", "start_line").dropDuplicates(["id"])
    return chunking.number_chunks(c, "file_path", "start_line", "id").select("id", "file_path", "chunk_index", "total_chunks")


def ordered_dedupe_cap(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "path", "exports", "imports")
    return f.select("path", F.array_join(text.distinct_capped(F.concat("imports", "exports"), 5), "|").alias("kept")).distinct()


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "label", "name", "start_line", "indexed_at", "deleted_at")
    return latest(n, ["id"], "indexed_at").select("id", "label", "name", "start_line", "indexed_at")


def scroll_page(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path", "language", "chunk_index").distinct()
    page = store.scroll(c, 20, cursor="8", language="typescript")
    return page.withColumn("is_next", F.row_number().over(Window.orderBy("id")) == 21)  # of 21 rows


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path", "start_line", "end_line", "text_content")
    least = c.agg(F.min("id").alias("id"))
    return c.join(F.broadcast(least), "id", "left_semi").distinct()


def collection_info(spark: SparkSession, d: str) -> DataFrame:
    return store.collection_info(table(spark, d, "chunks", "id", "embedding").dropDuplicates(["id"]))


def unique_id_violations(spark: SparkSession, d: str) -> DataFrame:
    return store.duplicate_ids(table(spark, d, "nodes", "label", "id"), ["label", "id"])


def prefix_passages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "text_content")
    return c.select("id", F.md5(text.prefixed(F.col("text_content"), "jina")).alias("digest")).distinct()


def hashing_embed(spark: SparkSession, d: str) -> DataFrame:
    return embed.embed_texts(table(spark, d, "documents", "doc_id", "text"), "text", embed.HashingEmbedder(64)).drop("text")


def pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "path", "content", "language").dropDuplicates(["path"])
    c = table(spark, d, "chunks", "id", "embedding", "token_count").dropDuplicates(["id"])
    files = f.agg(F.count("*").alias("files_scanned"), F.count_if(F.length("content") > 0).alias("files_parsed"), F.count_distinct("language").alias("languages"))
    both = files.unionByName(c.agg(F.count("*").alias("chunks_created"), F.count("embedding").alias("chunks_embedded"), F.sum("token_count").alias("tokens")), allowMissingColumns=True)
    return both.agg(*[F.max(x).alias(x) for x in both.columns])


def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    return parse.strip_comments(table(spark, d, "files", "path", "content")).distinct()


def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    return parse.file_metadata(table(spark, d, "files", "path", "content").distinct())


def parsed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The types, fields and variables that the index lists, as the parser reads them from the sources."""
    listed = table(spark, d, "nodes", "id").distinct()
    found = parse.detailed_nodes(table(spark, d, "files", "path", "content").distinct())
    own = found.where(F.col("label").isin("Interface", "TypeAlias", "Field", "Variable")).join(listed, "id", "left_semi")
    return own.select("id", "label", "file_path", "name", "start_line", "end_line", "parent_class", "is_constant", "type_expression")


def parsed_imports(spark: SparkSession, d: str) -> DataFrame:
    """The modules that a source imports or requires, with their lines."""
    found = parse.detailed_nodes(table(spark, d, "files", "path", "content").distinct()).where("label = 'Import'")
    return found.select("id", "file_path", "module", "start_line", "end_line")


def parsed_modules(spark: SparkSession, d: str) -> DataFrame:
    """All modules of each source; none for a source without."""
    found = parse.file_metadata(table(spark, d, "files", "path", "content").distinct())
    return found.select("path", F.array_join(F.array_sort("imports"), " ").alias("imports"))


def extracted_nodes(spark: SparkSession, d: str) -> DataFrame:
    return parse.extracted_nodes(table(spark, d, "files", "path", "content"))


def merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    return chunking.merged_ranges(table(spark, d, "chunks", "file_path", "start_line", "end_line").distinct(), "file_path", "start_line", "end_line")


def locations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", "id", "file_path", "start_line", "end_line")
    return c.select("id", text.location(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("location")).distinct()


def first_export_lines(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files", "path", "content").where("contains(content, 'export ')")
    return f.select("path", text.line_of(F.col("content"), F.expr("position('export ' IN content) - 1")).alias("line")).distinct()


_SKIP = ", ".join(f"'{x}'" for x in scan.SKIPPED)
_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"
_CASE = lambda k: "CASE " + _EXT + " " + " ".join(f"WHEN '{e}' THEN '{v[k]}'" for e, v in scan.ENDINGS.items()) + " END"
_OPENED = "(length(x) - length(translate(x, '{([', ''))) - (length(x) - length(translate(x, '})]', '')))"

QUERIES = {
    f.__name__: f
    for f in (uuid5_file_ids, uuid5_node_ids, uuid5_chunk_ids, content_hash16, collection_names, file_scan_filter, binary_files, fnmatch_filter, line_counts, token_counts, nesting_depths, long_line_split, chunk_greedy, chunk_numbering, ordered_dedupe_cap, upsert_last_wins, scroll_page, point_lookup, collection_info, unique_id_violations, prefix_passages, hashing_embed, pipeline_stats, strip_comments, file_metadata, parsed_symbols, parsed_imports, parsed_modules, extracted_nodes, merged_ranges, locations, first_export_lines)
}
SQL = {
    "parsed_symbols": "SELECT DISTINCT id, label, file_path, name, start_line, end_line, parent_class, is_constant, type_expression FROM nodes WHERE label IN ('Interface', 'TypeAlias', 'Field', 'Variable')",
    "parsed_imports": "SELECT DISTINCT id, file_path, module, start_line, end_line FROM nodes WHERE label = 'Import'",
    "parsed_modules": "SELECT DISTINCT path, array_to_string(list_sort(list_distinct(imports)), ' ') AS imports FROM files",
    "uuid5_file_ids": f"WITH x AS (SELECT DISTINCT id, path, {_SHA.format("path || ':File:' || path || ':1'")} AS h FROM files) SELECT path, {_UUID} AS computed, {_UUID} = id AS matches FROM x",
    "uuid5_node_ids": f"WITH x AS (SELECT DISTINCT id, {_SHA.format("file_path || ':' || label || ':' || coalesce(name, module) || ':' || start_line::varchar")} AS h FROM nodes) SELECT id, {_UUID} AS computed, {_UUID} = id AS matches FROM x",
    "uuid5_chunk_ids": f"WITH x AS (SELECT DISTINCT id, {_SHA.format("file_path || ':' || chunk_index::varchar || ':' || file_hash")} AS h FROM chunks) SELECT id, {_UUID} AS point_id FROM x",
    "content_hash16": "SELECT DISTINCT path, coalesce(substr(sha256(content), 1, 16), '') AS hash16 FROM files",
    "collection_names": "SELECT 'code_chunks_' || split_part(repo, '/', -1) || '_' || len(embedding)::varchar AS collection, count(*) AS points FROM chunks WHERE embedding IS NOT NULL GROUP BY 1",
    "file_scan_filter": f"WITH x AS (SELECT DISTINCT path FROM files) SELECT path, {_EXT} AS extension, {_CASE(0)} AS language, {_CASE(1)} AS grammar FROM x WHERE {_CASE(0)} IS NOT NULL AND NOT list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), [{_SKIP}])",
    "binary_files": "SELECT coalesce(contains(substr(content, 1, 8192), chr(0)), NULL) AS binary, count(DISTINCT path) AS files FROM files GROUP BY 1",
    "fnmatch_filter": "SELECT DISTINCT id, file_path FROM chunks WHERE regexp_full_match(file_path, '.*/src/.*[a-m].*\\.ts.', 's')",
    "line_counts": "SELECT DISTINCT path, length(content) - length(replace(content, chr(10), '')) + CASE WHEN content LIKE '%' || chr(10) THEN 0 ELSE 1 END AS lines FROM files WHERE content IS NOT NULL",
    "token_counts": f"SELECT DISTINCT id, len({_WORDS.format('text_content')}) AS tokens, len({_WORDS.format('text_content')}) = token_count AS as_stored FROM chunks",
    "nesting_depths": f"SELECT DISTINCT id, greatest(0, list_max(list_transform(string_split(text_content, chr(10)), lambda x: {_OPENED}))) AS depth FROM chunks WHERE text_content IS NOT NULL",
    "long_line_split": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        w AS (SELECT doc_id, line, {_WORDS.format('x')} AS w FROM l), p AS (SELECT doc_id, line, w, unnest(generate_series(0, len(w) - 1, 40)) AS i FROM w WHERE len(w) > 40)
        SELECT doc_id, line, (i // 40 + 1) AS piece, len(list_slice(w, i + 1, i + 40)) AS words, array_to_string(list_slice(w, i + 1, i + 40), ' ') AS text FROM p""",
    "chunk_numbering": "WITH x AS (SELECT DISTINCT id, file_path, start_line FROM chunks) SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS chunk_index, count(*) OVER (PARTITION BY file_path) AS total_chunks FROM x",
    "ordered_dedupe_cap": """WITH x AS (SELECT DISTINCT path, list_concat(imports, exports) AS l FROM files), u AS (SELECT path, unnest(l) AS v, generate_subscripts(l, 1) AS n FROM x),
        f AS (SELECT path, v, min(n) AS n FROM u WHERE v <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS k FROM f)
        SELECT path, coalesce((SELECT string_agg(v, '|' ORDER BY n) FROM r WHERE r.path = x.path AND k <= 5), '') AS kept FROM x""",
    "upsert_last_wins": "SELECT DISTINCT ON (id) id, label, name, start_line, indexed_at FROM nodes ORDER BY id, indexed_at DESC",
    "scroll_page": "WITH x AS (SELECT DISTINCT id, file_path, language, chunk_index FROM chunks WHERE language = 'typescript' AND id >= '8' ORDER BY id LIMIT 21) SELECT *, row_number() OVER (ORDER BY id) = 21 AS is_next FROM x",
    "merged_ranges": """WITH r AS (SELECT DISTINCT file_path, start_line, end_line FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL), m AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM r),
        i AS (SELECT *, sum(n) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS parts FROM i GROUP BY file_path, k""",
    "locations": "SELECT DISTINCT id, array_to_string(list_slice(string_split(file_path, '/'), greatest(len(string_split(file_path, '/')) - 1, 1), len(string_split(file_path, '/'))), '/') || CASE WHEN start_line > 0 THEN ':' || start_line || '-' || end_line ELSE '' END AS location FROM chunks",
    "first_export_lines": "SELECT DISTINCT path, 1 + length(left(content, strpos(content, 'export ') - 1)) - length(replace(left(content, strpos(content, 'export ') - 1), chr(10), '')) AS line FROM files WHERE contains(content, 'export ')",
    "point_lookup": "SELECT DISTINCT id, file_path, start_line, end_line, text_content FROM chunks WHERE id = (SELECT min(id) FROM chunks)",
    "collection_info": "WITH x AS (SELECT DISTINCT ON (id) id, embedding FROM chunks) SELECT count(*) AS points_count, max(len(embedding)) AS vector_size, count(embedding) AS with_vector, 'Cosine' AS distance FROM x",
    "unique_id_violations": "SELECT label, id, count(*) AS count FROM nodes GROUP BY ALL HAVING count(*) > 1",
    "prefix_passages": "SELECT DISTINCT id, md5('Candidate code snippet:' || chr(10) || text_content) AS digest FROM chunks",
    "pipeline_stats": """SELECT * FROM (SELECT count(*) AS files_scanned, count(*) FILTER (length(content) > 0) AS files_parsed, count(DISTINCT language) AS languages FROM (SELECT DISTINCT ON (path) path, content, language FROM files)),
        (SELECT count(*) AS chunks_created, count(embedding) AS chunks_embedded, sum(token_count)::bigint AS tokens FROM (SELECT DISTINCT ON (id) id, embedding, token_count FROM chunks))""",
}
