"""References to records that do not exist at the time of the reference.

A reference is a composite key, parts of which may be null. References are split by their null mask (which
parts are present); each mask is checked against the targets on its present parts only, under the declared
match semantics of SQL's referential constraints:

* ``simple``: a reference with any null part refers to nothing and is never an orphan;
* ``partial``: the parts that are present must all occur together in one target;
* ``full``: all parts null refers to nothing; a mix of null and present parts is an orphan.

Parts listed in ``required`` must be present in every semantics: without them there is no reference.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import skew_join

MATCHES = ("simple", "partial", "full")


def lives(targets: DataFrame, keys: list[str], valid_from: str | None, valid_to: str | None) -> DataFrame:
    """One row per key with the distinct spans of time in which a target with that key was alive."""
    if valid_from is None:
        return targets.select(*keys).distinct()
    span = F.struct(F.col(valid_from).alias("born"), F.col(valid_to).alias("died"))
    return targets.groupBy(*keys).agg(F.collect_set(span).alias("_lives"))


def alive(at: Column) -> Column:
    """Whether one of the spans in ``_lives`` holds the time ``at``; without a time, whether there is any."""
    return F.exists("_lives", lambda s: (at.isNull() | (s["born"] <= at)) & (at.isNull() | s["died"].isNull() | (s["died"] > at)))


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    keys: list[str],
    *,
    match: str = "simple",
    required: tuple[str, ...] = (),
    at: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
) -> DataFrame:
    """Rows of ``references`` whose key has no living row in ``targets``; columns as in ``references``.

    Both sides carry the key columns under the same names. With ``at``, a target counts only if
    ``valid_from <= at`` and ``valid_to`` is null or later than ``at``; a target whose ``valid_from`` is null
    never counts, and a reference whose time is null is held against targets of any time. Repeated rows stay
    repeated. An empty target table makes every checked reference an orphan; an empty reference table gives
    no rows. Other columns of either side may have any name, those of the targets are not read.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    out: DataFrame | None = None
    for mask in product((True, False), repeat=len(keys)):
        present = [k for k, here in zip(keys, mask) if here]
        if any(k not in present for k in required) or not present:
            continue  # no reference at all
        whole = len(present) == len(keys)
        if match == "simple" and not whole:
            continue
        test = F.lit(True)
        for k, here in zip(keys, mask):
            test = test & (F.col(k).isNotNull() if here else F.col(k).isNull())
        group = references.where(test)
        if match == "full" and not whole:
            part = group
        else:
            known = lives(targets, present, valid_from if at else None, valid_to)
            if at is None:
                part = skew_join(group, known, present, "left_anti")
            else:
                part = skew_join(group, known, present, "left").where(~F.coalesce(alive(F.col(at)), F.lit(False))).drop("_lives")
        part = part.select(*references.columns)
        out = part if out is None else out.unionByName(part)
    return references.limit(0) if out is None else out


def orphan_report(orphans: DataFrame, table: str, at: str, identity: list[str]) -> DataFrame:
    """Orphans per named table and month of the reference: ``month`` (yyyy-MM), ``orphans`` (distinct identities)."""
    return (
        orphans.groupBy(F.col(table).alias("table_name"), F.date_format(F.col(at), "yyyy-MM").alias("month"), *identity).agg(F.lit(1).alias("one"))
        .groupBy("table_name", "month").agg(F.count("one").alias("orphans"))
    )
