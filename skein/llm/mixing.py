"""Mixing sources to target weights by systematic sampling.

Each source's expected number of copies of a document is the same for all its documents: the tokens the source
must contribute over the tokens it has. The documents of a source are laid end to end, each as long as its
expected copies; with one random offset per source a document is emitted once per whole number that its
stretch crosses. So a document comes out floor or ceil of its expectation, and never more often than allowed.

The order along the line is by size band, then by hash, then by size, so every stretch of the line takes its
share of every size, and the tokens reached stay close to the target. The prefix sums are in two levels
(within a bucket of bounded size, and over the table of buckets), so no source is ever in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialize

#: Documents of one source in one bucket of the prefix sums, about.
BUCKET_ROWS = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The byte-level BPE whose ranks are in the file at ``path``; kept by each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(path: str):
    """Tokens of a text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(path).encode_ordinary
        for part in texts:
            yield part.map(lambda t: len(encode(t)) if t else 0)

    return count


def clean_source(source: Column) -> Column:
    """Lower case, without outer white space; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), F.lit(""))


def feasible(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, float]:
    """Tokens each source shall contribute, at most ``max_repeats`` times its own.

    Sources without tokens, without a positive share or that may be used no times contribute nothing; the
    shares of the others are scaled to sum to 1. Without ``total`` it is the largest for which no source is
    short. With a ``total`` beyond that, sources that are short give all they may and the others fill up in
    proportion to their shares.
    """
    live = {s: (w, tokens[s] * r) for s, (w, r) in targets.items() if tokens.get(s) and w and w > 0 and r and r > 0}
    if not live:
        return {}
    if total is None:
        total = min(cap / w for w, cap in live.values()) * sum(w for w, _ in live.values())
    given: dict[str, float] = {}
    left = total
    while live:
        scale = left / sum(w for w, _ in live.values())
        short = {s: cap for s, (w, cap) in live.items() if w * scale >= cap}
        if not short:
            return given | {s: w * scale for s, (w, _) in live.items()}
        given |= short
        left = max(0.0, left - sum(short.values()))
        live = {s: x for s, x in live.items() if s not in short}
    return given


def sized(documents: DataFrame, identity: str, text: str, source: str, path: str) -> DataFrame:
    """id, source, tokens; written once, since totals and sampling both read it."""
    count = token_counts(path)
    rows = documents.select(F.col(identity).alias("id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("t"))
    return materialize(rows.select("id", "source", count("t").alias("tokens")), "tokens")


def mix(documents: DataFrame, targets: DataFrame, identity: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, seed: int = 42, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (id, source, tokens, copy: 1, 2, ...) and its report, a row for each source of either table.

    Report: source, documents, tokens_available, target_share, max_repeats, documents_used, copies, tokens,
    actual_share. Null and blank sources are reported as null and take no part; neither do sources that are
    not in ``targets``, nor texts that are null or empty. Targets whose source has no documents get nothing and
    the other shares are scaled. If a source is listed twice its shares add up and the larger cap holds. Empty
    documents give an empty mixture. Columns of other names are not read, whatever they are called.
    """
    spark = documents.sparkSession
    sizes = sized(documents, identity, text, source, path or default_tokenizer())
    wanted = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens_available"))
    plan = wanted.join(have, "source", "left").collect()  # one row for each target
    goal = feasible({r.source: r.tokens_available for r in plan}, {r.source: (r.target_share, r.max_repeats) for r in plan}, total)
    rate = {r.source: goal[r.source] / r.tokens_available for r in plan if goal.get(r.source)}
    rates = spark.createDataFrame(list(rate.items()) or [("", 0.0)], "source string, rate double")
    parts = max([1, *(-(-r.documents // BUCKET_ROWS) for r in plan if r.documents)])

    line = (
        sizes.where(F.col("tokens") > 0).join(F.broadcast(rates), "source")
        .withColumn("band", F.floor(F.log2("tokens") * 8).cast("int")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int"))
    )
    bucket = ["source", "band", "part"]
    before = line.groupBy(*bucket).count().withColumn("before", F.sum("count").over(Window.partitionBy("source").orderBy("band", "part")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy("tokens", "id")) - 1
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    start = (F.col("before") + F.col("place")) * F.col("rate") + offset
    copies = (F.floor(start + F.col("rate") + 1e-9) - F.floor(start + 1e-9)).cast("int")
    mixture = (
        line.withColumn("place", place).join(F.broadcast(before) if parts == 1 else before, bucket).withColumn("copies", copies).where("copies > 0")
        .select("id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    )
    used = mixture.groupBy("source").agg(F.count_if(F.col("copy") == 1).alias("documents_used"), F.count("*").alias("copies"), F.sum("tokens").alias("tokens"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    rows = have.join(wanted, same(have, wanted), "full").select(F.coalesce(have.source, wanted.source).alias("source"), "documents", "tokens_available", "target_share", "max_repeats")
    rows = rows.join(used, same(rows, used), "left").select(rows["*"], "documents_used", "copies", "tokens").na.fill(0, ["documents", "tokens_available", "target_share", "documents_used", "copies", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy())  # over one row for each source
    return mixture, rows.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
