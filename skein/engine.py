"""Indexing a source tree and answering questions over it: the entry points a program or the command line uses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.ids import chunk_id, glossary_id, node_id
from skein.functions.text import expand_query, fnmatch, prefixed
from skein.operators import embed, glossary, graph, parse
from skein.operators import retrieval as R
from skein.operators.chunking import chunk_text
from skein.sources.scan import discover_files
from skein.sources.scan import manual_glossary as read_manual
from skein.sources.store import TableStore

DEPTHS = (1, 2, 3)


def check_sizes(size: int, overlap: int, batch: int) -> None:
    if size <= 0 or not 0 <= overlap < size or batch <= 0:
        raise ValueError("size and batch must be positive, overlap at least 0 and smaller than size")


#: Nodes of parsed plans that only read, and functions that run other code.
_READING = frozenset(
    "Project Filter UnresolvedHaving Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedWith CTE CTERelationDef CTERelationRef WithCTE Union Distinct Intersect Except Deduplicate "
    "Window WithWindowDefinition Generate Pivot Unpivot UnresolvedPivot UnresolvedInlineTable OneRowRelation LocalRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction Sample Tail".split()
)
_OUTSIDE = re.compile(r"(?i)\b(?:reflect|java_method|try_reflect|read_files|input_file_name)\s*\(")
_VIEWS = ("files", "chunks", "nodes", "edges", "glossary")


def check_query(spark: SparkSession, text: str) -> None:
    """Raises ValueError unless every node of the parsed plan reads, and reads a view of the store or a name the query gives itself."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # noqa: BLE001 - of the parser
        raise ValueError("not a query") from error
    own = {m.lower() for m in re.findall(r"(?i)(?:\bwith|,)\s+(?:recursive\s+)?`?(\w+)`?\s*(?:\([^()]*\)\s*)?as\s*\(", text)}
    for line in plan.treeString().split("\n"):
        m = re.match(r"[\s:+|\-]*'*(\w+)(.*)", line)
        if not m:
            continue
        if m[1] not in _READING:
            raise ValueError(f"only queries are allowed, not {m[1]}")
        if m[1] == "UnresolvedRelation":
            name = re.match(r"\s*\[([^\]]*)\]", m[2])
            if not name or name[1].strip().lower() not in {*_VIEWS, *own}:
                raise ValueError("only the tables " + ", ".join(_VIEWS) + " can be read")
    if _OUTSIDE.search(text):
        raise ValueError("this function is not allowed")


class Engine:
    """``store`` holds the tables files, chunks, nodes, edges and glossary."""

    def __init__(self, spark: SparkSession, root: str, embedder: embed.Embedder | None = None, model: str = "nomic") -> None:
        self.spark, self.store, self.model = spark, TableStore(spark, root), model
        self.embedder = embedder or embed.HashingEmbedder()

    def _manual(self, path: str, files: DataFrame, nodes: DataFrame) -> DataFrame:
        """Entries written by hand in a YAML file, met with the files whose path ends like theirs and the symbol of that kind and term."""
        given = glossary.normal_entries(read_manual(self.spark, path), "manual").select("term", "kind", "summary", "source", "confidence", F.coalesce("file_path", F.lit("")).alias("_path"))
        known = glossary.symbol_index(nodes)
        placed = glossary.met_paths(given.where("_path <> ''"), files.select(F.col("path").alias("file_path")), "_path", "file_path")
        anywhere = given.where("_path = ''").join(known, ["kind", "term"])  # without a path: wherever there is such a symbol
        found = placed.join(known, ["file_path", "kind", "term"], "left").unionByName(anywhere.select(*placed.columns, "symbol_id"))
        return found.select("file_path", "term", "kind", "summary", "source", "confidence", "symbol_id")

    def index(self, repo: str, size: int = 400, overlap: int = 64, batch: int = 64, dry_run: bool = False, manual_glossary: str | None = None) -> dict[str, int]:
        """Scans, parses, chunks, embeds and stores a tree; a file's rows replace those of its older versions.

        A dry run only counts. Unchanged files (same path and hash) are not processed again; those of files that are
        gone are dropped. ``manual_glossary`` names a YAML file of entries, which come before those of comments.
        """
        check_sizes(size, overlap, batch)
        files = discover_files(self.spark, repo)
        if dry_run:
            return {"files": files.count(), "chunks": chunk_text(files, "path", "content", size, overlap).count()}
        files = files.withColumn("id", node_id(F.col("path"), F.lit("File"), F.col("path"), F.lit(1)))
        old = self.store.read("files") if self.store.exists("files") else None
        new = files if old is None else files.join(old.select("path", "file_hash"), ["path", "file_hash"], "left_anti")
        new = new.persist()
        meta = parse.file_metadata(new)
        chunks = chunk_text(new, "path", "content", size, overlap).join(new.select("path", "file_hash", "language"), "path").join(meta, "path").withColumnRenamed("path", "file_path")
        detailed = parse.detailed_nodes(new).persist()
        chunks = chunks.withColumn("id", chunk_id(F.col("file_path"), F.col("chunk_index"), F.col("file_hash")))
        chunks = graph.named_functions(chunks, detailed)
        chunks = embed.embed_texts(chunks, "text_content", self.embedder, self.model, batch).persist()
        named = new.select("id", "path").join(meta.select("path", "exports"), "path")
        edges = graph.graph_from_nodes(named, chunks, detailed)
        comments = parse.comments(new).withColumnRenamed("path", "file_path")
        symbols = detailed.where(F.col("label").isin(*glossary.LABEL_KINDS) & F.col("name").isNotNull()).select("id", "label", "name", "file_path", "start_line")
        found = glossary.forward_asof(comments, symbols, "file_path", "end_line", "start_line", 2, "id")
        kind = F.coalesce(*[F.when(F.col("matched.label") == a, F.lit(b)) for a, b in glossary.LABEL_KINDS.items()])
        from skein.functions.text import clean_comment

        entries = found.select("file_path", F.col("matched.name").alias("term"), kind.alias("kind"), clean_comment(F.col("text")).alias("summary"), F.lit("comment").alias("source"), F.lit(0.75).alias("confidence"), F.col("matched.id").alias("symbol_id")).where("summary <> ''")
        if manual_glossary is not None:
            entries = entries.unionByName(self._manual(manual_glossary, new, detailed))
        entries = entries.withColumns({"id": glossary_id(F.col("file_path"), F.col("kind"), F.col("term"), F.col("symbol_id")), "updated_at": F.lit(None).cast("string")})
        entries = glossary.preferred(entries).drop("updated_at").persist()
        edges = edges.unionByName(entries.select("file_path", F.lit("HAS_GLOSSARY").alias("type"), F.col("symbol_id").alias("source_id"), F.col("id").alias("target_id"))).distinct()
        place = lambda rows, label, name: rows.select("id", F.lit(label).alias("label"), F.col("path" if label == "File" else "file_path").alias("file_path"), name.alias("name"))
        nodes = detailed
        for rows, label, name in ((new, "File", F.col("path")), (chunks, "Chunk", F.col("function_name")), (entries.where("symbol_id IS NOT NULL"), "GlossaryEntry", F.col("term"))):
            nodes = nodes.unionByName(place(rows, label, name), allowMissingColumns=True)
        counts = {"new_files": new.count()}
        # rows of files that are new, changed or gone make way
        stays = files.select("path").join(new.select("path"), "path", "left_anti")
        for name, rows, key in (("files", new, "path"), ("chunks", chunks, "file_path"), ("nodes", nodes, "file_path"), ("glossary", entries, "file_path"), ("edges", edges, "file_path")):
            kept = rows if not self.store.exists(name) else self.store.read(name).join(stays.withColumnRenamed("path", key), key, "left_semi").unionByName(rows, allowMissingColumns=True)
            self.store.overwrite(name, kept)
            counts[name] = self.store.read(name).count()
        for rows in (new, detailed, chunks, entries):
            rows.unpersist()
        return counts

    def search(self, question: str, mode: str = "hybrid", top_k: int = 10, language: str | None = None, file_pattern: str | None = None, min_score: float = 0.0, weights: tuple[float, float] = (0.7, 0.3), expand: bool = False, strict_filters: bool = False) -> DataFrame:
        """id, score and the chunk's columns, best first. ``mode``: vector, graph, or hybrid for anything else.

        The language holds before ranking, in vector mode only; pattern and score hold after it, and a hit
        without a path has an empty one. ``strict_filters`` applies language and pattern before ranking.
        """
        if top_k <= 0:
            raise ValueError("top_k must be positive")
        chunks, nodes = self.store.read("chunks"), self.store.read("nodes")
        text = self.spark.range(1).select(expand_query(F.lit(question))).first()[0] if expand else question
        if strict_filters:
            chunks = chunks.where(F.col("language") == language) if language else chunks
            chunks = chunks.where(fnmatch(F.col("file_path"), file_pattern)) if file_pattern else chunks
            nodes = nodes.where(fnmatch(F.col("file_path"), file_pattern)) if file_pattern else nodes
        asked = self.spark.range(1).select(prefixed(F.lit(text), self.model, "query")).first()[0]
        vector = [float(x) for x in self.embedder.embed([asked])[0]]
        if mode == "vector":
            where = F.col("language") == language if language else None
            return R.post_filter(R.vector_topk(chunks, vector, top_k, where=where), file_pattern, min_score)
        if mode == "graph":
            return R.post_filter(R.name_search(nodes, question, top_k, ("name", "file_path")), file_pattern, min_score)
        fused = R.hybrid_search(chunks, nodes, vector, question, top_k, weights)
        hits = R.enrich(fused.join(chunks.drop("embedding"), "id", "left"), self.store.read("edges"), nodes)
        return R.post_filter(hits, file_pattern, min_score).orderBy(F.desc("score"), "first_list", "first_rank", "id")

    def context(self, results: DataFrame) -> str:
        """The results as context for a language model: the first of each file and function, at most top_k of them."""
        first = R.first_per(results.where("file_path IS NOT NULL"), ["file_path", "function_name"], F.desc("score"), "id")
        blocks = first.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id"))).select("n", R.context_block(F.col("file_path"), F.col("text_content")).alias("b"))
        return "\n\n".join(r.b for r in blocks.where("b IS NOT NULL").orderBy("n").collect())  # results are a top-k

    def query(self, text: str, cap: int = 500, **args) -> tuple[DataFrame, bool]:
        """Read-only SQL over the tables, and whether rows beyond ``cap`` were cut off. Only query plans run."""
        check_query(self.spark, text)
        for table in ("files", "chunks", "nodes", "edges", "glossary"):
            if self.store.exists(table):
                self.store.read(table).createOrReplaceTempView(table)
        rows = self.spark.sql(text, args=args or None)
        return rows.limit(cap), bool(rows.offset(cap).limit(1).count())
