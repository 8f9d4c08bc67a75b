"""Source trees and manual glossaries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import content_hash

#: Directories that are not descended into, and the language and grammar of each ending.
SKIPPED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", ".next")
ENDINGS = {
    ".js": ("javascript", "javascript"), ".jsx": ("javascript", "javascript"), ".mjs": ("javascript", "javascript"), ".cjs": ("javascript", "javascript"),
    ".ts": ("typescript", "typescript"), ".tsx": ("tsx", "tsx"), ".mts": ("typescript", "typescript"), ".cts": ("typescript", "typescript"),
}


def skipped(path: Column) -> Column:
    """Whether a directory on the way to the file is left out; ``path`` is relative to the root."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(list(SKIPPED)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in ENDINGS.items() for x in (k, v[0])]), extension(path))


def grammar(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in ENDINGS.items() for x in (k, v[1])]), extension(path))


def is_binary(content: Column) -> Column:
    """A zero byte in the first 8192."""
    return F.contains(F.substr(content.cast("binary"), F.lit(1), F.lit(8192)), F.unhex(F.lit("00")))


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` in a known language: path (relative), extension, language, grammar, file_hash, content."""
    base = root.rstrip("/") + "/"
    endings = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in ENDINGS)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{endings}}}").load(root)
    # the folders that are left out hold files of these endings too: their contents are not read, as the path is judged first
    rows = rows.withColumn("path", F.element_at(F.split("path", base.replace("file://", ""), 2), -1))
    kept = rows.where(~skipped(F.col("path")) & language(F.col("path")).isNotNull() & ~is_binary(F.col("content")))
    return kept.select("path", extension(F.col("path")).alias("extension"), language(F.col("path")).alias("language"), grammar(F.col("path")).alias("grammar"), content_hash(F.col("content")).alias("file_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def manual_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a YAML file; none if it is missing or has no list of entries. Entries that are no mappings are skipped."""
    fields = ("term", "kind", "file_path", "summary", "source", "confidence", "symbol_id", "created_at", "updated_at")
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            entries = (yaml.safe_load(f) or {}).get("entries")
    except (OSError, AttributeError):
        entries = None
    rows = [tuple(None if e.get(k) is None else str(e.get(k)) for k in fields) for e in entries if isinstance(e, dict)] if isinstance(entries, list) else []
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in fields))
