"""Joins on keys of which a few hold a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than one HOT_SHARE-th of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000
#: No key is hot below this number of rows: one task sorts that many without trouble.
HOT_ROWS = 20_000
SALTS = 32


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE, rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys with more than ``max(rows, n / share)`` of the n rows; at most ``share`` of them.

    The counts are combined before the shuffle, so a hot key costs one partial row per task. Rows with a null
    in a key are never hot. An empty table has no hot keys. Keys may be of any type that can be grouped.
    """
    whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    return hot_among(df.where(whole).groupBy(*keys).count(), keys, share, rows, df)


def hot_among(counts: DataFrame, keys: list[str], share: int = HOT_SHARE, rows: int = HOT_ROWS, df: DataFrame | None = None) -> list[int]:
    """The same from ``counts`` of the keys (column ``count``); all rows are counted in ``df``, or else are those of the keys."""
    large = counts.where((F.col("count") > rows) & reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys]))
    top = large.orderBy(F.desc("count")).limit(share).select(F.xxhash64(*keys).alias("h"), "count").collect()
    if not top:
        return []
    total = counts.agg(F.sum("count")).first()[0] if df is None else df.count()
    return [r["h"] for r in top if r["count"] * share > total]


def _is_hot(keys: list[str], hot: list[int]) -> Column:
    """By hash: another key of the same hash is salted on both sides too, which changes no result."""
    return F.xxhash64(*keys).isin(hot)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS, hot: list[int] | None = None) -> DataFrame:
    """Equi-join of a possibly skewed ``left`` with a ``right`` that has few rows for each key.

    Rows of hot keys get a salt from their own content on the left and are repeated for each salt on the
    right; other rows join as they are. ``how`` is inner, left, left_semi or left_anti. Nulls never match.
    The result is the same as the plain join's; only where the rows meet differs.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    hot = hot_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    kinds = dict(left.dtypes)
    right = right.withColumns({k: F.col(k).cast(kinds[k]) for k, t in right.dtypes if k in keys and t != kinds[k]})
    salt = F.when(_is_hot(keys, hot), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t]), F.lit(salts))).otherwise(F.lit(0))
    copies = F.when(_is_hot(keys, hot), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return left.withColumn("_salt", salt.cast("bigint")).join(right.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how).drop("_salt")
