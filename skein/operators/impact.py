"""What a change would touch: importers, callers, members, risky code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import nesting_depth


def importers(chunks: DataFrame, modules: list[str]) -> DataFrame:
    return chunks.where(F.arrays_overlap("imports", F.lit(modules)))


def callers(chunks: DataFrame, function: str) -> DataFrame:
    return chunks.where(F.array_contains("call_sites", function))


def exported_members(nodes: DataFrame, cls: str) -> DataFrame:
    return nodes.where((F.col("parent_class") == cls) & F.col("is_exported"))


def high_risk(chunks: DataFrame, depth: int) -> DataFrame:
    """Exported code nested at least this deep on one line."""
    return chunks.withColumn("depth", nesting_depth(F.col("text_content"))).where(F.col("is_exported") & (F.col("depth") >= depth))
