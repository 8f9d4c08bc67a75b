"""Queries on references between the tables of the code index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.orphans import orphan_references, orphan_report
from skein.sources.tables import table

#: Labels with a table of their own; every other label is in nodes.
TABLES = {"File": "files", "Chunk": "chunks", "Module": "modules", "GlossaryEntry": "glossary"}


def named_table(label: Column) -> Column:
    return F.when(label.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in TABLES.items()], F.lit("nodes")))


def plain_id(column: Column) -> Column:
    """The id without regard to letter case and outer white space."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def reference_ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge as one row each: edge_id, side, table_name, id, at."""
    ends = [F.struct(F.lit(side).alias("side"), F.col(f"{side}_label").alias("label"), F.col(f"{side}_id").alias("id")) for side in ("source", "target")]
    ends = edges.select("edge_id", F.col("indexed_at").alias("at"), F.explode(F.array(*ends)).alias("end"))
    return ends.select("edge_id", "end.side", named_table(F.col("end.label")).alias("table_name"), plain_id(F.col("end.id")).alias("id"), "at")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lives of all records: table_name, id, indexed_at, deleted_at."""
    parts = [table(spark, sf_dir, t, "id", "indexed_at", "deleted_at").select(F.lit(t).alias("table_name"), plain_id(F.col("id")).alias("id"), "indexed_at", "deleted_at") for t in ("nodes", *TABLES.values())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "relationships", "edge_id", "source_label", "source_id", "target_label", "target_id", "indexed_at")
    return orphan_references(
        reference_ends(edges), records(spark, sf_dir), ["table_name", "id"],
        match="partial", required=("id",), at="at", valid_from="indexed_at", valid_to="deleted_at",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dangling(spark, sf_dir).select("edge_id", "side").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(dangling(spark, sf_dir), "table_name", "at", ["edge_id", "side"])


_ENDS = """
WITH ends AS (
  SELECT edge_id, 'source' AS side, source_label AS label, source_id AS rid, indexed_at AS ref_at FROM relationships
  UNION ALL SELECT edge_id, 'target', target_label, target_id, indexed_at FROM relationships),
refs AS (
  SELECT edge_id, side, ref_at, lower(regexp_replace(rid, '^\\s+|\\s+$', '', 'g')) AS id,
         CASE label WHEN 'File' THEN 'files' WHEN 'Chunk' THEN 'chunks' WHEN 'Module' THEN 'modules'
                    WHEN 'GlossaryEntry' THEN 'glossary' ELSE 'nodes' END AS table_name
  FROM ends WHERE rid IS NOT NULL),
recs AS (
  SELECT 'nodes' AS table_name, lower(id) AS id, indexed_at, deleted_at FROM nodes
  UNION ALL SELECT 'files', lower(id), indexed_at, deleted_at FROM files
  UNION ALL SELECT 'chunks', lower(id), indexed_at, deleted_at FROM chunks
  UNION ALL SELECT 'modules', lower(id), indexed_at, deleted_at FROM modules
  UNION ALL SELECT 'glossary', lower(id), indexed_at, deleted_at FROM glossary),
orphans AS (
  SELECT DISTINCT edge_id, side, table_name, ref_at FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM recs t WHERE t.table_name = r.table_name AND t.id = r.id
      AND t.indexed_at <= r.ref_at AND (t.deleted_at IS NULL OR t.deleted_at > r.ref_at)))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _ENDS + "SELECT DISTINCT edge_id, side FROM orphans",
    "p2_report": _ENDS + "SELECT table_name, strftime(ref_at, '%Y-%m') AS month, count(DISTINCT edge_id::varchar || side) AS orphans FROM orphans GROUP BY ALL",
}
