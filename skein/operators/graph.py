"""The property graph: validity, upserts, statistics, traversal and its rebuilding from chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import node_id
from skein.operators.skew import hot_keys, skew_join
from skein.session import materialize

#: Ids of a frontier up to which they are broadcast (counted at each step).
BROADCAST_FRONT = 100_000

#: The labels and edge types of the graph, and what a node of each label must have.
LABELS = ("File", "Module", "Class", "Function", "Method", "Field", "Variable", "Import", "Interface", "TypeAlias", "Chunk", "GlossaryEntry")
TYPES = ("CONTAINS", "CALLS", "IMPORTS", "INHERITS", "EXPORTS", "REFERENCES", "DEFINES", "TYPE_OF", "DEPENDS_ON", "HAS_GLOSSARY")
REQUIRED = {
    "Class": ("name", "start_line", "end_line", "is_exported", "visibility", "decorators"),
    "Function": ("name", "start_line", "end_line", "is_exported", "visibility", "parameters", "decorators", "is_async", "call_sites"),
    "Method": ("name", "start_line", "end_line", "is_exported", "visibility", "parameters", "decorators", "is_async", "call_sites"),
    "Field": ("name", "start_line", "end_line", "is_exported", "visibility"),
    "Variable": ("name", "start_line", "end_line", "is_exported", "visibility", "is_constant"),
    "Import": ("module", "names", "start_line", "end_line", "is_wildcard"),
    "Interface": ("name", "start_line", "end_line", "is_exported", "extends"),
    "TypeAlias": ("name", "start_line", "end_line", "is_exported", "type_expression"),
}


def missing_properties(nodes: DataFrame) -> Column:
    """Names of the required properties that a node lacks, in order; null for an unknown or null label."""
    per = [F.when(F.col("label") == label, F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in need]))) for label, need in REQUIRED.items()]
    return F.coalesce(*per)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Insert-or-replace: the last row of each key by ``order``. Rows with equal order are equal rows here."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))).where("_place = 1").drop("_place")


def merge_properties(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Key-wise merge: each property has the value of the last row, where a null removes it; one row for each key."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("p"), F.max(order).alias(order), F.count("*").alias("writes"))
    return last.select(*keys, order, "writes", *[F.col(f"p.{c}") for c in rest])


def connected_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of a known type whose two ends exist, one for each type, source and target. Null ends never exist."""
    known = ids.select("id").distinct()
    typed = edges.where(F.col("type").isin(*TYPES))
    kept = skew_join(skew_join(typed, known.withColumnRenamed("id", "source_id"), ["source_id"], "left_semi"), known.withColumnRenamed("id", "target_id"), ["target_id"], "left_semi")
    return kept.dropDuplicates(["type", "source_id", "target_id"])


def counts_with_zeros(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """``name``, ``count`` for every value of a fixed list, 0 where there is none, and their ``total``."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(v,) for v in values], "name string")
    counts = rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count"))
    full = names.join(counts, "name", "left").select("name", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    return full.withColumn("total", F.sum("count").over(Window.partitionBy()))  # over the fixed list


def bars(counts: DataFrame, most: int) -> DataFrame:
    """The largest counts above zero with the width of their bars in percent of the largest."""
    top = counts.where("count > 0").orderBy(F.desc("count"), "name").limit(most)
    return top.select("name", "count", F.round(100 * F.col("count") / F.max("count").over(Window.partitionBy())).cast("int").alias("width"))


def paths_out(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Directed paths of 1 to ``depth`` edges from the ids in ``start``, a row for each: source_id, id, hops, path (edge ids).

    No path uses an edge twice. ``edges`` has edge_id, source_id, target_id.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1, 2 or 3")
    step = edges.select("edge_id", F.col("source_id").alias("id"), "target_id")
    here = start.select(F.col("id").alias("source_id"), "id", F.lit(0).alias("hops"), F.array().cast("array<bigint>").alias("path"))
    out = []
    for _ in range(depth):
        here = here.join(step, "id").where(~F.array_contains("path", F.col("edge_id")))
        here = here.select("source_id", F.col("target_id").alias("id"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("edge_id")).alias("path"))
        out.append(here)
    return reduce(DataFrame.unionByName, out)


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps, whatever the direction: id, hops (the least); frontiers are made distinct at each step."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1, 2 or 3")
    links = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).union(edges.select("target_id", "source_id")).where("id IS NOT NULL AND to IS NOT NULL")
    seen = front = materialize(start.select("id", F.lit(0).alias("hops")), "start")
    hot: list[int] | None = None
    for hop in range(1, depth + 1):
        if front.count() <= BROADCAST_FRONT:
            met = links.join(F.broadcast(front.select("id")), "id", "left_semi")
        else:
            hot = hot_keys(links, ["id"]) if hot is None else hot  # once for all steps
            met = skew_join(links, front.select("id"), ["id"], "left_semi", hot=hot)
        front = materialize(met.select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "front")
        seen = seen.unionByName(front)
    return seen


def reach_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges both of whose ends are reached."""
    ids = reached.select("id").distinct()
    return skew_join(skew_join(edges, ids.withColumnRenamed("id", "source_id"), ["source_id"], "left_semi"), ids.withColumnRenamed("id", "target_id"), ["target_id"], "left_semi")


def graph_from_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id) and edges (type, source_id, target_id) of stored chunks, distinct.

    Each chunk gives its File and itself, and, where it names them, its Class, its Function (or the parent's),
    its Imports and Variables; the callees of a chunk with a function become Function stubs at line 1. Ids use
    the chunk's start line (1 if that is 0 or null). Exports point to the first class, function or variable of
    that name. Chunks without a path give nothing; null and empty names are skipped.
    """
    path, text = F.col("file_path"), lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    line = F.when(F.col("start_line") > 0, F.col("start_line")).otherwise(1)
    some = lambda c: F.array_distinct(F.filter(text(c), lambda x: x.isNotNull() & (x != "")))
    function = F.coalesce(F.nullif("function_name", F.lit("")), F.nullif("parent_function", F.lit("")))
    base = chunks.where(F.length("file_path") > 0).select(
        "id", "file_path", line.alias("line"), F.nullif("class_name", F.lit("")).alias("cls"), function.alias("fn"),
        some("imports").alias("imports"), some("exports").alias("exports"), some("symbols_defined").alias("symbols"), some("call_sites").alias("calls"),
        node_id(path, F.lit("File"), path, F.lit(1)).alias("file"),
    )
    ids = base.select(
        "*", node_id(path, F.lit("Class"), F.col("cls"), F.col("line")).alias("cls_id"), node_id(path, F.lit("Function"), F.col("fn"), F.col("line")).alias("fn_id"),
    )
    per = lambda label, at: lambda name: node_id(path, F.lit(label), name, at)
    node = lambda label, i: F.struct(F.lit(label).alias("label"), i.alias("id"))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.alias("source_id"), b.alias("target_id"))
    file, chunk, cls, fn = F.col("file"), F.col("id"), F.col("cls_id"), F.col("fn_id")
    nothing_n, nothing_e = F.array().cast("array<struct<label:string,id:string>>"), F.array().cast("array<struct<type:string,source_id:string,target_id:string>>")
    imports, variables = per("Import", F.col("line")), per("Variable", F.col("line"))
    stub = per("Function", F.lit(1))
    nodes = F.concat(
        F.array(node("File", file), node("Chunk", chunk)),
        F.when(cls.isNotNull(), F.array(node("Class", cls))).otherwise(nothing_n), F.when(fn.isNotNull(), F.array(node("Function", fn))).otherwise(nothing_n),
        F.transform("imports", lambda m: node("Import", imports(m))), F.transform("symbols", lambda s: node("Variable", variables(s))),
        F.when(fn.isNotNull(), F.transform("calls", lambda c: node("Function", stub(c)))).otherwise(nothing_n),
    )
    target = lambda e: F.when(e == F.col("cls"), cls).when(e == F.col("fn"), fn).when(F.array_contains("symbols", e), variables(e))
    owned = lambda i: F.array(edge("CONTAINS", file, i), edge("DEFINES", file, i), edge("CONTAINS", i, chunk))
    edges = F.concat(
        F.array(edge("CONTAINS", file, chunk)),
        F.when(cls.isNotNull(), owned(cls)).otherwise(nothing_e), F.when(fn.isNotNull(), owned(fn)).otherwise(nothing_e),
        F.flatten(F.transform("imports", lambda m: F.array(*[edge(k, file, imports(m)) for k in ("CONTAINS", "IMPORTS", "DEPENDS_ON")]))),
        F.flatten(F.transform("symbols", lambda s: F.array(*[edge(k, file, variables(s)) for k in ("CONTAINS", "DEFINES")]))),
        F.filter(F.transform("exports", lambda e: edge("EXPORTS", file, target(e))), lambda x: x["target_id"].isNotNull()),
        F.when(fn.isNotNull(), F.transform("calls", lambda c: edge("CALLS", fn, stub(c)))).otherwise(nothing_e),
    )
    return ids.select(F.explode(nodes).alias("n")).select("n.label", "n.id").distinct(), ids.select(F.explode(edges).alias("e")).select("e.type", "e.source_id", "e.target_id").distinct()


def graph_from_nodes(files: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between files (id, path, exports), chunks (id, file_path, lines) and extracted nodes, by their own ids: file_path, type, source_id, target_id.

    A file contains its chunks and nodes, defines those that are no imports, imports and depends on the others, and
    exports what is declared so or listed by name. A node contains the chunks that hold some of its lines, a class those that name it as
    parent. INHERITS and TYPE_OF go to the first class or interface (or type alias) of the name in the same file, CALLS
    to the first function of it.
    """
    edge = lambda rows, kind, a, b: rows.select("file_path", F.lit(kind).alias("type"), F.col(a).alias("source_id"), F.col(b).alias("target_id"))
    file = files.select(F.col("path").alias("file_path"), F.col("id").alias("file"))
    held, owned = chunks.select("file_path", F.col("id").alias("chunk")).join(file, "file_path"), nodes.join(file, "file_path")
    imports, defined = owned.where("label = 'Import'"), owned.where("label <> 'Import'")
    lines = chunks.select("file_path", F.col("id").alias("chunk"), F.col("start_line").alias("_from"), F.col("end_line").alias("_to"))
    within = nodes.where(F.col("label").isin("Class", "Function", "Method")).join(lines, "file_path").where("_from <= end_line AND _to >= start_line")
    first = lambda label: nodes.where(F.col("label").isin(*label) & F.col("name").isNotNull()).groupBy("file_path", F.col("name").alias("_name")).agg(F.min_by("id", F.struct("start_line", "id")).alias("_id"))
    members = nodes.where(F.col("parent_class").isNotNull()).withColumn("_name", F.col("parent_class")).join(first(("Class",)), ["file_path", "_name"])
    bases = first(("Class", "Interface"))
    derived = nodes.select("file_path", "id", F.explode("extends").alias("_name")).join(bases, ["file_path", "_name"]).where("id <> _id")
    typed = nodes.select("file_path", "id", F.explode(F.array_distinct(F.regexp_extract_all("type_annotation", F.lit(r"([A-Za-z_$][\w$]*)")))).alias("_name")).join(first(("Class", "Interface", "TypeAlias")), ["file_path", "_name"]).where("id <> _id")
    called = resolved_calls(nodes).join(nodes.select(F.col("id").alias("source_id"), "file_path"), "source_id")
    exported = export_edges(files, nodes).join(files.select(F.col("id").alias("source_id"), F.col("path").alias("file_path")), "source_id")
    parts = [
        edge(held, "CONTAINS", "file", "chunk"), edge(owned, "CONTAINS", "file", "id"), edge(defined, "DEFINES", "file", "id"), edge(imports, "IMPORTS", "file", "id"), edge(imports, "DEPENDS_ON", "file", "id"),
        edge(within, "CONTAINS", "id", "chunk"), edge(members, "CONTAINS", "_id", "id"), edge(derived, "INHERITS", "id", "_id"), edge(exported, "EXPORTS", "source_id", "target_id"), edge(owned.where("is_exported AND parent_class IS NULL"), "EXPORTS", "file", "id"),
        edge(typed, "TYPE_OF", "id", "_id"), edge(called, "CALLS", "source_id", "target_id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def named_functions(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chunks`` with function_name and parent_function: the innermost function or method that holds all lines of the chunk, and the one around that."""
    spans = nodes.where(F.col("label").isin("Function", "Method")).select("file_path", F.struct((F.col("end_line") - F.col("start_line")).alias("lines"), "start_line", "name", "parent_function").alias("s"), F.col("end_line").alias("_end"))
    held = chunks.select("id", "file_path", F.col("start_line").alias("_from"), F.col("end_line").alias("_to")).join(spans, "file_path").where("s.start_line <= _from AND _end >= _to")
    inner = held.groupBy("id").agg(F.min("s").alias("s")).select("id", F.col("s.name").alias("function_name"), F.col("s.parent_function").alias("parent_function"))
    return chunks.join(inner, "id", "left")


def placeholders(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files that have no node of a label get one made up: path, label, name (Class, Function, Import)."""
    wanted = files.select("path").where("path IS NOT NULL").distinct().select("path", F.explode(F.create_map(*[F.lit(x) for kv in (("Class", "AnonymousClass"), ("Function", "anonymous"), ("Import", "./module")) for x in kv])).alias("label", "name"))
    have = nodes.select(F.col("file_path").alias("path"), "label").distinct()
    return wanted.join(have, ["path", "label"], "left_anti")


def resolved_calls(nodes: DataFrame) -> DataFrame:
    """CALLS edges from a function or method to the first function of the called name in the same file: source_id, target_id."""
    callers = nodes.where(F.col("label").isin("Function", "Method")).select(F.col("id").alias("source_id"), "file_path", F.explode(F.array_distinct("call_sites")).alias("name"))
    targets = nodes.where((F.col("label") == "Function") & F.col("name").isNotNull()).groupBy("file_path", "name").agg(F.min_by("id", F.struct("start_line", "id")).alias("target_id"))
    return callers.join(targets, ["file_path", "name"]).select("source_id", "target_id").distinct()


def export_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """EXPORTS edges from a file to the first node that has the exported name: source_id, target_id."""
    names = files.select(F.col("id").alias("source_id"), F.col("path").alias("file_path"), F.explode(F.array_distinct("exports")).alias("name"))
    first = nodes.where("name IS NOT NULL").groupBy("file_path", "name").agg(F.min_by("id", F.struct("start_line", "id")).alias("target_id"))
    return names.join(first, ["file_path", "name"]).select("source_id", "target_id").distinct()
