"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.credentials import credential_lines, redact
from skein.llm.docpairs import documented_symbols, function_pairs
from skein.llm.languages import document_languages, fit, language_faults
from skein.llm.leaks import leaks
from skein.llm.mixing import mix
from skein.llm.neighbours import neighbour_pairs, similar_vectors
from skein.llm.origin import file_origins
from skein.llm.syntax import fault_rates, syntax_faults
from skein.sources.tables import table


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores is dealt out to all of them; larger tables stay where they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_origins(spread(table(spark, sf_dir, "files", "path", "repo", "content")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_kinds(spark, sf_dir).select("path").distinct()


def p4_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_faults(spread(table(spark, sf_dir, "files", "path", "extension", "content")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_faults(spark, sf_dir).select("path").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fault_rates(table(spark, sf_dir, "files", "repo", "path", "extension"), p4_faults(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credential_lines(spread(table(spark, sf_dir, "chunks", "id", "text_content")), "id", "text_content")
    return rows.select(F.col("id").alias("chunk_id"), "line").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as they may be passed on; only those that change, with how many bytes they hold then."""
    rows = redact(spread(table(spark, sf_dir, "chunks", "id", "text_content")), "text_content")
    return rows.where("redacted <> text_content").select(F.col("id").alias("chunk_id"), "redacted", F.octet_length("redacted").alias("bytes")).distinct()


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "chunks", "id", "embedding"), "id", "embedding", 64)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(p6_neighbours(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "nodes", "id", "label", "file_path", "name", "start_line").where(F.col("label").isin("Function", "Method"))
    symbols = symbols.select("id", F.col("file_path").alias("path"), "name", F.col("start_line").alias("line"))
    return documented_symbols(spread(table(spark, sf_dir, "files", "path", "content")), symbols).select("symbol_id").distinct()


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_pairs(spread(table(spark, sf_dir, "files", "path", "content")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("kind = 'literal'").select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items: documents and longest passage by kind."""
    return _leaks(spark, sf_dir).groupBy("item_id", "kind").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return language_faults(documents, fit(documents)).select("doc_id", "lang").distinct()


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return document_languages(documents, fit(documents))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p3_found": p3_found, "p3_kinds": p3_kinds, "p4_found": p4_found, "p4_faults": p4_faults, "p4_rates": p4_rates, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_found": p7_found, "p7_items": p7_items, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_segments": p9_segments}
#: The exact answer; with few blocks the operator gives it too.
SQL: dict[str, str] = {
    "p6_found": """WITH c AS (SELECT DISTINCT id, embedding::double[] AS v FROM chunks WHERE len(embedding) = 64
          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        n AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) AS k FROM c a JOIN c b ON a.id <> b.id)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM n WHERE k <= 5""",
}
