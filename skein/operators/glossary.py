"""Glossary entries: normal forms, comments met with symbols, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Other names of kinds, and the kind of each label that can be explained.
KIND_ALIASES = {"typealias": "type_alias", "type-alias": "type_alias", "property": "field"}
LABEL_KINDS = {"Class": "class", "Field": "field", "Function": "function", "Method": "method", "Variable": "variable", "Interface": "interface", "TypeAlias": "type_alias"}


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def normal_kind(kind: Column) -> Column:
    plain = F.lower(_trim(kind))
    return F.coalesce(*[F.when(plain == a, F.lit(b)) for a, b in KIND_ALIASES.items()], plain)


def same_path(a: Column, b: Column) -> Column:
    """An empty path fits every file, and paths fit if one is the end of the other."""
    return (a == "") | (a == b) | F.endswith(a, b) | F.endswith(b, a)


def path_ends(path: Column) -> Column:
    """A path and what it ends in, from each of its parts on."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def met_paths(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Left rows with the right rows whose path is the end of theirs, by whole parts, or the other way round; equi-joins on the ends."""
    longer = left.withColumn("_end", F.explode(path_ends(F.col(left_path)))).join(right, F.col("_end") == F.col(right_path))
    shorter = right.withColumn("_end", F.explode(path_ends(F.col(right_path)))).join(left, F.col("_end") == F.col(left_path))
    columns = [*left.columns, *right.columns]
    return longer.select(*columns).unionByName(shorter.select(*columns)).distinct()


def normal_entries(entries: DataFrame, source_default: str = "comment") -> DataFrame:
    """Entries with a term, kind and summary, in normal form; the others drop out. Confidence defaults to 1.0 for manual, else 0.75."""
    source = F.coalesce(F.nullif(_trim(F.col("source")), F.lit("")), F.lit(source_default))
    rows = entries.withColumns({"term": _trim(F.col("term")), "kind": normal_kind(F.col("kind")), "summary": _trim(F.col("summary")), "source": source})
    rows = rows.withColumn("confidence", F.coalesce(F.expr("try_cast(confidence AS double)"), F.when(F.col("source") == "manual", 1.0).otherwise(0.75)))
    return rows.where("term <> '' AND kind <> '' AND summary <> ''")


def forward_asof(left: DataFrame, right: DataFrame, key: str, at: str, of: str, reach: int, tie: str) -> DataFrame:
    """Each left row with the first right row of the same key that starts 1 to ``reach`` lines behind it; ties by ``tie``.

    The lines within reach are listed on the left, so this is an equi-join. Left columns, then ``matched`` (struct of the right row).
    """
    spread = left.withColumn("_n", F.monotonically_increasing_id()).withColumn("_line", F.explode(F.sequence(F.col(at) + 1, F.col(at) + reach)))
    lines = right.groupBy(F.col(key).alias("_key"), F.col(of).alias("_line")).agg(F.min_by(F.struct(*right.columns), F.col(tie)).alias("matched"))
    found = spread.join(lines, (spread[key] == lines["_key"]) & (spread["_line"] == lines["_line"]))
    first = found.groupBy("_n").agg(F.min_by(F.struct(*left.columns, "matched"), spread["_line"]).alias("r"))
    return first.select("r.*")


def preferred(entries: DataFrame) -> DataFrame:
    """One entry for each file, kind and term: manual before comment, then the one updated last, then the largest id."""
    order = [F.desc((F.col("source") == "manual").cast("int")), F.desc_nulls_last("updated_at"), F.desc("id")]
    return entries.withColumn("_place", F.row_number().over(Window.partitionBy("file_path", "kind", "term").orderBy(*order))).where("_place = 1").drop("_place")


def symbol_index(nodes: DataFrame) -> DataFrame:
    """kind, term and the last symbol's id: by start line, then id."""
    kind = F.coalesce(*[F.when(F.col("label") == a, F.lit(b)) for a, b in LABEL_KINDS.items()])
    return nodes.where(kind.isNotNull() & F.col("name").isNotNull()).groupBy("file_path", kind.alias("kind"), F.col("name").alias("term")).agg(F.max_by("id", F.struct("start_line", "id")).alias("symbol_id"))


def searchable(entries: DataFrame) -> DataFrame:
    """The entries as records that a search finds: id, text_content, node_type, term, kind."""
    return entries.select("id", F.concat("term", F.lit(" ("), "kind", F.lit("): "), "summary").alias("text_content"), F.lit("glossary_entry").alias("node_type"), "term", "kind")
