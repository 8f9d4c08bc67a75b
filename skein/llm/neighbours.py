"""The k most similar vectors of every vector: a block matrix join with int8 product tiles.

Vectors are put into blocks by their nearest centroid; the centroids form a tree of two levels (cells of similar
blocks), so finding a vector's blocks does not take longer with more of them, and their number grows with that of
the vectors. A vector is asked against the ``probes`` blocks nearest to it, so it meets about ``probes *
block_rows`` others, however many there are. A tile is what one task multiplies: some blocks of a cell and the
vectors that ask them; both sides are bounded, a vector travels once to each tile that holds some of its blocks.
Within a tile the int8 codes of queries and data are multiplied (as whole numbers, in a float matrix product,
which is exact below 2**24); with the quantisation errors of both sides that bounds every cosine from below and
above. Pairs whose upper bound reaches the k-th best lower bound survive and are recomputed in double precision
from the original vectors; each step's are merged at once into the k best of its queries, so a tile never holds
more pairs than one step's. The tiles' best lists are merged for each query.

The loss: neighbours in blocks that weren't probed are missed. With no more blocks than ``probes`` (up to
about ``probes * block_rows`` vectors), or with ``probes=None``, the answer is exact. Equal vectors are compared
once and expanded at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.skew import skew_join
from skein.session import materialize

#: Rows of the sample that centroids are fitted on, for each centroid. The driver fits up to FLAT_BLOCKS of them; with
#: more blocks it fits those of the cells, and tasks fit the blocks' within each cell, on as many rows for each.
SAMPLE_PER_BLOCK = 24
FLAT_BLOCKS = 4096
#: Blocks are 64 MB of centroids at 64 dimensions, which every task knows; beyond this number they hold more vectors.
MAX_BLOCKS = 262_144
BLOCKS_PER_CELL, PROBED_CELLS = 32, 8
TILE_DATA, TILE_QUERIES = 32_768, 49_152
STEP, WIDTH = 1024, 4096
#: Classes of more than k equal vectors that are broadcast to find their members, at most (under 1 kB each at 64 dimensions).
BROADCAST_CLASSES = 20_000
#: Pairs for each query of a step from which they are pruned in double precision before they are listed.
MANY = 48


def unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    count = min(count, len(sample))
    found = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[i : i + 8192] @ found.T, axis=1) for i in range(0, len(sample), 8192)])
        order = np.argsort(nearest, kind="stable")
        starts = np.searchsorted(nearest[order], np.arange(count))
        filled = np.bincount(nearest, minlength=count) > 0
        sums = np.add.reduceat(sample[order], np.minimum(starts, len(sample) - 1), axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        filled &= norms[:, 0] > 1e-9
        found[filled] = (sums / np.maximum(norms, 1e-9))[filled]
    return found.astype(np.float32)


def int8_codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the scale of each row and the norm of what the codes leave out."""
    scale = np.maximum(np.abs(rows).max(axis=1), 1e-30) / 127
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(rows - codes * scale[:, None], axis=1)


def tile_steps(queries: np.ndarray, data: np.ndarray, same: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For STEP queries and WIDTH data rows at a time: pairs (query row, data row, cosine) that hold the k best of them.

    ``queries`` and ``data`` are unit vectors in double precision; ``same[i]`` is the data row that is query i
    itself, or -1. ``floor[i]`` is the cosine from which a pair of query i is of use; it may rise between steps.
    Where the int8 bounds leave many pairs, as among nearly equal vectors, a product in double precision prunes
    them before they are listed.
    """
    qc, qs, qe = int8_codes(queries)
    dc, ds, de = int8_codes(data)
    left, right = qc.astype(np.float32), dc.astype(np.float32).T
    for i in range(0, len(queries), STEP):
        part = slice(i, i + STEP)
        for j in range(0, len(data), WIDTH):
            across = slice(j, j + WIDTH)
            product = left[part] @ right[:, across]  # whole numbers below 2**24
            product *= qs[part, None].astype(np.float32)
            product *= ds[None, across].astype(np.float32)
            own = np.flatnonzero((same[part] >= j) & (same[part] < j + WIDTH))
            product[own, same[part][own] - j] = -4
            # |cos - product| <= |q| e_d + |d'| e_q, and float32 rounding
            slack = (qe[part] * (1 + de[across].max()) + de[across].max() + 1e-5).astype(np.float32)
            if product.shape[1] > k:
                least = -np.partition(-product, k - 1, axis=1)[:, k - 1] - 2 * slack
            else:
                least = np.full(len(product), -3, np.float32)
            alive = product >= np.maximum(np.maximum(least, floor[part] - slack), -3)[:, None]
            if product.shape[1] > k and np.count_nonzero(alive) > MANY * len(product):
                wide = queries[part] @ data[across].T
                wide[own, same[part][own] - j] = -4
                best = -np.partition(-wide, k - 1, axis=1)[:, k - 1]
                alive &= wide >= np.maximum(best, floor[part])[:, None] - 1e-12
            r, c = np.nonzero(alive)
            r, c = r + i, c + j
            exact = np.empty(len(r))
            for n in range(0, len(r), 65_536):
                exact[n : n + 65_536] = np.einsum("ij,ij->i", queries[r[n : n + 65_536]], data[c[n : n + 65_536]])
            yield r, c, exact


def tile_pairs(queries: np.ndarray, data: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All steps of a tile at once: pairs that hold the k best data rows of each query, and the number recomputed."""
    r, c, exact = (np.concatenate(x) for x in zip(*tile_steps(queries, data, same, k, np.full(len(queries), -np.inf))))
    return r, c, exact, len(r)


def best_of(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of each r with the largest s, at equal s those with the smaller c, in this order."""
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], s[keep]


def usable(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has ``size`` finite numbers, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    return df.where(F.coalesce((F.size(vector) == size) & fine, F.lit(False)))


class Tree(NamedTuple):
    """Centroids of blocks, in the order of their cells; block i lies in cell ``cell[i]``, ``first`` has where a cell's begin."""

    blocks: np.ndarray
    cells: np.ndarray
    cell: np.ndarray
    first: np.ndarray
    flat: bool

    def nearest(self, rows: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest blocks of each row, the nearest first: among those of its nearest cells if there are many blocks."""
        count = len(self.blocks)
        if self.flat or probes >= count:
            near = rows @ self.blocks.T
            return np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
        cells = np.argsort(-(rows @ self.cells.T), axis=1, kind="stable")[:, : max(PROBED_CELLS, -(-2 * probes // BLOCKS_PER_CELL))]
        widest = int(np.diff(self.first).max())
        score = np.full((len(rows), cells.shape[1], widest), -np.inf, np.float32)
        for c in np.unique(cells):
            who, place = np.nonzero(cells == c)
            own = slice(self.first[c], self.first[c + 1])
            score[who, place, : own.stop - own.start] = rows[who] @ self.blocks[own].T
        score = score.reshape(len(rows), -1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        best = np.where(np.take_along_axis(score, best, 1) > -np.inf, best, best[:, :1])  # fewer than asked for: the nearest again
        return (self.first[cells[np.arange(len(rows))[:, None], best // widest]] + best % widest).astype(np.int32)


def fit_tree(vectors: DataFrame, total: int, count: int, flat: int = FLAT_BLOCKS) -> Tree:
    """Centroids for ``count`` blocks of the ``vectors`` (n, v). The sample is drawn by a hash of n."""

    def sample(size: int) -> DataFrame:
        return vectors.where(F.pmod(F.xxhash64("n"), F.lit(max(1, total // size))) == 0).select("v")

    def known(size: int) -> np.ndarray:
        rows = [r.v for r in sample(size).limit(size).collect()]
        return unit(np.array(rows or [vectors.first().v], dtype=np.float32)).astype(np.float32)

    if count <= flat:
        blocks = centroids(known(count * SAMPLE_PER_BLOCK), count)
        cells = centroids(blocks, max(1, len(blocks) // BLOCKS_PER_CELL))
        cell = np.argmax(blocks @ cells.T, axis=1)
        order = np.argsort(cell, kind="stable")
        blocks, cell = blocks[order], cell[order]
    else:
        few = max(1, min(count // BLOCKS_PER_CELL, flat))
        cells = centroids(known(few * SAMPLE_PER_BLOCK), few)
        tops = vectors.sparkSession.sparkContext.broadcast(cells)

        def to_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    rows = unit(np.array(pdf["v"].tolist(), dtype=np.float32)).astype(np.float32)
                    yield pd.DataFrame({"cell": np.argmax(rows @ tops.value.T, axis=1).astype(np.int32), "vec": [x.tobytes() for x in rows]})

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(len(pdf), -1)
            own = centroids(rows, max(1, round(len(rows) / SAMPLE_PER_BLOCK)))
            return pd.DataFrame({"cell": pdf["cell"].iloc[0], "middle": [x.tobytes() for x in own]})

        rows = sample(count * SAMPLE_PER_BLOCK).mapInPandas(to_cell, "cell int, vec binary").groupBy("cell").applyInPandas(split, "cell int, middle binary").collect()  # no more than MAX_BLOCKS, about
        rows = sorted(rows, key=lambda r: (r.cell, r.middle))
        blocks, cell = np.array([np.frombuffer(r.middle, np.float32) for r in rows]), np.array([r.cell for r in rows])
    return Tree(blocks, cells, cell, np.searchsorted(cell, np.arange(len(cells) + 1)), count <= flat)


class Tiling(NamedTuple):
    """Tiles of each block: ``first`` its first one, ``many`` how many share it; ``parts``: how many each tile's queries are split into."""

    first: np.ndarray
    many: np.ndarray
    parts: np.ndarray


def lay_out(cell: np.ndarray, data: np.ndarray, asked: np.ndarray, most_data: int = TILE_DATA, most_queries: int = TILE_QUERIES) -> Tiling:
    """Blocks one after the other into tiles of their cell, as long as the data rows fit; a larger block has tiles of its own."""
    first, many = np.zeros(len(cell), np.int64), np.ones(len(cell), np.int64)
    held, queries, here = 0, [0], -1
    for b, (c, d, q) in enumerate(zip(cell.tolist(), data.tolist(), asked.tolist())):
        own = max(1, -(-d // most_data))
        if held and (c != here or held + d > most_data):
            held = 0
            queries.append(0)
        first[b], many[b], here = len(queries) - 1, own, c
        queries[-1] += q
        held += d
        if own > 1:
            queries += [q] * (own - 1)
            held = most_data
    return Tiling(first, many, np.maximum(1, -(-np.array(queries) // most_queries)))


def similar_vectors(df: DataFrame, identity: str, vector: str, size: int, k: int = 5, probes: int | None = 16, block_rows: int = 768, flat: int = FLAT_BLOCKS) -> DataFrame:
    """``id``, ``neighbour``, ``similarity``: for each usable vector the k others with the largest cosine; at equal
    cosine the smaller id comes first. Without ``probes`` all blocks are asked, which is exact.

    Null ids and vectors that are null, of another length, not finite or all zero take no part. Rows delivered
    twice count once; if an id comes with different vectors, each is a row of its own and the id is never its
    own neighbour. With fewer than k + 1 usable ids, each gets those there are. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = usable(df.where(F.col(identity).isNotNull()).select(F.col(identity).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")), "v", size)
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    classes = ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).orderBy(F.col("ids")[0])
    classes = materialize(classes.withColumn("n", F.monotonically_increasing_id()), "vectors")  # n follows the order of the ids
    total = classes.count()
    if total == 0:
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("similarity")).limit(0)
    tree = fit_tree(classes, total, int(min(MAX_BLOCKS, max(1, round(total / block_rows)))), flat)
    count = len(tree.blocks)
    probes = count if probes is None else min(probes, count)
    known = spark.sparkContext.broadcast(tree)

    def count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = known.value
        data, asked = np.zeros(count, np.int64), np.zeros(count, np.float64)
        for pdf in batches:
            if len(pdf):
                best = tree.nearest(unit(np.array(pdf["v"].tolist(), dtype=np.float32)).astype(np.float32), probes)
                data += np.bincount(best[:, 0], minlength=count)
                cells = (np.diff(np.sort(tree.cell[best], axis=1), axis=1) != 0).sum(axis=1) + 1
                once = np.repeat(cells / best.shape[1], best.shape[1])  # a query's blocks in one cell come to one tile, mostly
                asked += np.bincount(best.ravel(), weights=once, minlength=count)
        there = np.flatnonzero((data > 0) | (asked > 0))
        yield pd.DataFrame({"b": there.astype(np.int32), "d": data[there], "q": asked[there]})

    counted = classes.select("v").mapInPandas(count_rows, "b int, d bigint, q double").groupBy("b").agg(F.sum("d").alias("d"), F.sum("q").alias("q")).collect()  # one row for each block
    data, asked = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for r in counted:
        data[r.b], asked[r.b] = r.d, int(r.q) + 1
    tiling = lay_out(tree.cell, data, asked, TILE_DATA, TILE_QUERIES)
    plan = spark.sparkContext.broadcast(tiling)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, tiles = known.value, plan.value
        for pdf in batches:
            if pdf.empty:
                continue
            raw, n = np.array(pdf["v"].tolist(), dtype=np.float32), pdf["n"].to_numpy()
            best = tree.nearest(unit(raw).astype(np.float32), probes)
            home = tiles.first[best[:, 0]] + n % tiles.many[best[:, 0]]
            asks = []
            for i, blocks in zip(n.tolist(), best):
                own: dict[int, list[int]] = {}
                for b in dict.fromkeys(blocks.tolist()):
                    for t in range(tiles.first[b], tiles.first[b] + tiles.many[b]):
                        own.setdefault(t, []).append(b)
                asks.append([{"tile": t, "part": i % int(tiles.parts[t]), "blocks": bs} for t, bs in own.items()])
            yield pd.DataFrame({"n": n, "vec": [x.tobytes() for x in raw], "block": best[:, 0], "home": home.astype(np.int32), "parts": tiles.parts[home].astype(np.int32), "asks": asks})

    assigned = classes.select("n", "v").mapInPandas(assign, "n bigint, vec binary, block int, home int, parts int, asks array<struct<tile:int, part:int, blocks:array<int>>>")
    many = min(20_000, 2 * int(tiling.parts.sum()))
    data = assigned.select("n", "vec", "block", F.col("home").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(many, "tile", "part")
    asks = assigned.select(F.col("n").alias("query"), F.col("vec").alias("qvec"), F.explode("asks").alias("ask")).select("query", "qvec", "ask.*").repartition(many, "tile", "part")

    def tile(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "best": []}
        if len(q) and len(d):
            d = d.sort_values("n", ignore_index=True)
            data = unit(np.frombuffer(b"".join(d["vec"]), np.float32).reshape(len(d), -1))
            asked = unit(np.frombuffer(b"".join(q["qvec"]), np.float32).reshape(len(q), -1))
            at = {c: i for i, c in enumerate(d["n"])}
            own = np.array([at.get(c, -1) for c in q["query"]])
            of = np.repeat(np.arange(len(q)), [len(b) for b in q["blocks"]])
            wanted = np.concatenate(list(q["blocks"]))
            blocks = d["block"].to_numpy()
            top_c, top_s = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)  # the running lists
            for b in np.unique(wanted):
                here, who = np.flatnonzero(blocks == b), of[wanted == b]
                if len(here):
                    place = np.full(len(d) + 1, -1)
                    place[here] = np.arange(len(here))
                    floor = top_s[who, k - 1]
                    for r, c, s in tile_steps(asked[who], data[here], place[own[who]], k, floor):
                        r, c, s = best_of(r, here[c], s, k)
                        rows = np.unique(r)
                        n, m = np.nonzero(top_c[who[rows]] >= 0)
                        r, c, s = best_of(np.concatenate([r, rows[n]]), np.concatenate([c, top_c[who[rows[n]], m]]), np.concatenate([s, top_s[who[rows[n]], m]]), k)
                        at = np.arange(len(r)) - np.searchsorted(r, r)
                        top_c[who[r], at], top_s[who[r], at] = c, s
                        floor[rows] = top_s[who[rows], k - 1]
            r, m = np.nonzero(top_c >= 0)
            if len(r):
                c, s = top_c[r, m], top_s[r, m]
                ids, names = d["n"].to_numpy(), q["query"].to_numpy()
                lists: dict[int, list] = {}
                for x, y, z in zip(r.tolist(), ids[c].tolist(), s.tolist()):
                    lists.setdefault(x, []).append((-z, y))
                for x, best in lists.items():
                    out["query"].append(names[x])
                    out["best"].append([{"n": i, "s": -s} for s, i in heapq.nsmallest(k, best)])
        return pd.DataFrame({"query": pd.Series(out["query"], dtype="int64"), "best": pd.Series(out["best"], dtype=object)})

    found = asks.groupBy("tile", "part").cogroup(data.groupBy("tile", "part")).applyInPandas(tile, "query bigint, best array<struct<n:bigint, s:double>>")

    def better(by: str):
        return lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0)

    merged = found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best")), better("n")), 1, k).alias("best"))  # at most k for each group asked
    names = classes.select("n", "ids")
    near = merged.select("query", F.explode("best").alias("b")).select("query", F.col("b.n").alias("n"), F.col("b.s").alias("s")).join(names, "n")
    near = near.groupBy("query").agg(F.flatten(F.collect_list(F.transform(F.slice("ids", 1, k), lambda i: F.struct(i.alias("id"), F.col("s").alias("s"))))).alias("best"))
    listed = names.withColumnRenamed("n", "query").join(near, "query", "left").withColumn("best", F.coalesce("best", F.array().cast("array<struct<id:string,s:double>>")))
    # a class lists its first k + 1 ids, so only one with as many can have more
    full = classes.where(F.size("ids") > k).select(F.col("n").alias("query"), "v")
    members = listed.where(F.size("ids") <= k).select(F.explode("ids").alias("id"), "ids", "best")
    if (many := full.count()) > 0:
        several = full.join(listed, "query")
        met = rows.join(F.broadcast(several), "v") if many <= BROADCAST_CLASSES else skew_join(rows, several, ["v"], "inner")
        members = members.unionByName(met.select("id", "ids", "best").distinct())
    own = F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(1.0).alias("s")))
    every_one = F.filter(F.concat(own, "best"), lambda x: x["id"] != F.col("id"))
    top = members.select("id", F.explode(F.slice(F.array_sort(every_one, better("id")), 1, k)).alias("n"))
    return top.select("id", F.col("n.id").alias("neighbour"), F.col("n.s").alias("similarity"))


def neighbour_pairs(similar: DataFrame, first: str = "chunk_a", second: str = "chunk_b") -> DataFrame:
    """Distinct unordered pairs of which one is among the other's neighbours."""
    return similar.select(F.least("id", "neighbour").alias(first), F.greatest("id", "neighbour").alias(second)).distinct()
