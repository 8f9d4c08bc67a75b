"""Vector search, name search, rank fusion and the shaping of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import fnmatch
from skein.functions.vectors import cosine, usable
from skein.session import materialize

#: Results up to which the edges and nodes come to them, not they to the edges and nodes.
BROADCAST_RESULTS = 10_000


def vector_topk(points: DataFrame, query: list[float], k: int, identity: str = "id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """``points`` with ``score`` (cosine, 6 decimals), the k best; ties by identity. ``where`` holds before ranking.

    Vectors that are null, of another length, not finite or zero are left out. A point delivered several times
    counts once. Only identities and scores are shuffled, and each task keeps its own k best of them; the other
    columns are read for the k best alone.
    """
    rows = points.where(usable(F.col(vector), len(query)))
    if where is not None:
        rows = rows.where(where)
    scored = rows.select(identity, F.round(cosine(F.col(vector), F.lit(query).cast("array<double>")), 6).alias("score"))
    top = scored.groupBy(identity).agg(F.max("score").alias("score")).orderBy(F.desc("score"), identity).limit(k)
    if set(points.columns) <= {identity, vector}:
        return top
    rest = rows.drop("score") if "score" in points.columns else rows
    return rest.join(F.broadcast(top), identity).dropDuplicates([identity]).orderBy(F.desc("score"), identity)


def vector_topk_per_group(points: DataFrame, query: list[float], k: int, group: str, identity: str = "id", vector: str = "embedding") -> DataFrame:
    rows = points.where(usable(F.col(vector), len(query))).withColumn("score", F.round(cosine(F.col(vector), F.lit(query).cast("array<double>")), 6))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), identity))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def post_filter(results: DataFrame, pattern: str | None = None, min_score: float = 0.0, path: str = "file_path") -> DataFrame:
    """Filters that hold after ranking, so fewer than k rows may be left; a null path counts as empty."""
    if pattern:
        results = results.where(fnmatch(F.coalesce(F.col(path), F.lit("")), pattern))
    return results.where(F.col("score") >= min_score) if min_score > 0 else results


def name_search(nodes: DataFrame, text: str, limit: int, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Nodes one of whose ``columns`` holds the text, whatever the letter case; score 1.0, ordered by id."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False)) for c in columns])
    return nodes.where(hit).withColumn("score", F.lit(1.0)).orderBy("id").limit(limit)


def graph_search(nodes: DataFrame, edges: DataFrame, text: str, limit: int) -> DataFrame:
    """Three strategies, the first that finds a node counts: its name or path holds the text (1.0), that of a node it
    points to does (0.8), its label does (0.6). ``id``, ``score``, the best ``limit``, ties by id."""
    held = lambda c: F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    direct = nodes.where(held("name") | held("file_path")).select("id", F.lit(1.0).alias("score")).distinct().orderBy("id").limit(limit)
    named = nodes.where(held("name")).select(F.col("id").alias("target_id")).distinct()
    near = edges.join(named, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct().join(nodes.select("id").distinct(), "id", "left_semi").select("id", F.lit(0.8).alias("score")).orderBy("id").limit(limit)
    labelled = nodes.where(held("label")).select("id", F.lit(0.6).alias("score")).distinct().orderBy("id").limit(limit)
    return direct.union(near).union(labelled).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def reciprocal_rank_fusion(lists: list[DataFrame], weights: list[float], k: int = 60) -> DataFrame:
    """``id``, ``score``, ``first_list``, ``first_rank`` of ranked lists (id, rank from 1).

    A list adds weight / (k + rank) for each of its rows; lists beyond the weights add nothing but are present.
    Ties keep the order in which ids are first seen: by list, then by rank.
    """
    parts = [x.select("id", (F.lit(weights[i] if i < len(weights) else 0.0) / (F.lit(k) + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").cast("int").alias("rank")).alias("seen")) for i, x in enumerate(lists)]
    fused = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("seen").alias("seen"))
    return fused.select("id", "score", F.col("seen.list").alias("first_list"), F.col("seen.rank").alias("first_rank"))


def ranked(results: DataFrame, *order) -> DataFrame:
    """id and rank of a short result list (a top-k, so one task is enough)."""
    return results.select("id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"))


def hybrid_search(points: DataFrame, nodes: DataFrame, query: list[float], text: str, k: int, weights: tuple[float, float] = (0.7, 0.3), rrf_k: int = 60) -> DataFrame:
    """Weighted fusion of a vector and a name search, each over-fetched twofold; the best k by score, first seen, id."""
    fetch = max(1, 2 * k)
    arms = [ranked(vector_topk(points, query, fetch), F.desc("score"), "id"), ranked(name_search(nodes, text, fetch), "id")]
    return reciprocal_rank_fusion(arms, list(weights), rrf_k).orderBy(F.desc("score"), "first_list", "first_rank", "id").limit(k)


def enrich(results: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """``graph_context``: up to ``most`` (type, id, name) that a result points to, by type and id; empty without any."""
    results = materialize(results, "results")  # they are read three times
    small = F.broadcast if results.count() <= BROADCAST_RESULTS else (lambda rows: rows)
    near = edges.join(small(results.select(F.col("id").alias("source_id")).distinct()), "source_id", "left_semi").select("source_id", "type", "target_id").distinct()
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("type", "target_id"))).where(F.col("place") <= most)
    near = materialize(near, "near")  # at most ``most`` for each result
    names = nodes.select(F.col("id").alias("target_id"), "name").join(small(near.select("target_id").distinct()), "target_id", "left_semi").distinct()
    named = near.join(names, "target_id", "left")
    lists = named.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("type", F.col("target_id").alias("id"), "name"))).alias("graph_context"))
    out = results.join(lists.withColumnRenamed("source_id", "id"), "id", "left")
    return out.withColumn("graph_context", F.coalesce("graph_context", F.array().cast("array<struct<type:string,id:string,name:string>>")))


def first_per(results: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order; nulls are a key of their own."""
    return results.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def context_block(path: Column, text: Column) -> Column:
    """A result as it is put before a language model; null without a text."""
    return F.when(F.length(text) > 0, F.concat(F.lit("[file: "), F.coalesce(path, F.lit("unknown")), F.lit("]\n```\n"), text, F.lit("\n```")))


def result_block(rank: Column, score: Column, path: Column, start: Column, end: Column, symbol: Column, language: Column, text: Column) -> Column:
    """A result as the text answer shows it: numbered header with place, symbol and score, and the fenced text."""
    place = F.when((start > 0) & (end > 0), F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(path)
    name = F.when(F.length(symbol) > 0, F.concat(F.lit(" ("), symbol, F.lit(")"))).otherwise(F.lit(""))
    header = F.concat(F.lit("["), rank.cast("string"), F.lit("] "), place, name, F.lit(" | score: "), F.format_string("%.4f", score))
    return F.concat(header, F.lit("\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```"))


def result_json(results: DataFrame) -> Column:
    """The fifteen fields of a result as JSON."""
    fields = ["file_path", "language", "start_line", "end_line", "function_name", "class_name", "node_type", "text_content", "imports", "exports", "symbols_defined", "call_sites", "token_count"]
    return F.to_json(F.struct("id", F.round("score", 4).alias("score"), *[results[f] for f in fields]), {"ignoreNullFields": "false"})
