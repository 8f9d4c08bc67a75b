from datetime import datetime as T

import pytest

from skein.operators.orphans import orphan_references, orphan_report
from skein.operators.skew import hot_keys, skew_join

DAY = [T(2025, 1, d) for d in range(1, 29)]
REFS = "edge int, side string, a string, b string, at timestamp_ntz, indexed_at timestamp_ntz"
TARGETS = "a string, b string, born timestamp_ntz, died timestamp_ntz, edge string"


def brute(refs, targets, match, required, timed=True):
    out = []
    for r in refs:
        _, _, a, b, at, _ = r
        key = {"a": a, "b": b}
        present = {k: v for k, v in key.items() if v is not None}
        if not present or any(k not in present for k in required) or match == "simple" and len(present) < 2:
            continue
        if match == "full" and len(present) < 2:
            out.append(r)
            continue
        alive = lambda t: not timed or at is None or t[2] is not None and t[2] <= at and (t[3] is None or t[3] > at)
        if not any(all({"a": t[0], "b": t[1]}[k] == v for k, v in present.items()) and alive(t) for t in targets):
            out.append(r)
    return sorted(out, key=repr)


@pytest.fixture
def tables():
    refs = [
        (1, "s", "x", "1", DAY[5], DAY[0]), (2, "s", "x", "1", DAY[0], DAY[0]), (3, "s", "x", None, DAY[5], DAY[0]), (4, "s", None, "1", DAY[5], DAY[0]), (5, "s", None, None, DAY[5], DAY[0]),
        (6, "s", "x", "2", DAY[9], DAY[0]), (7, "s", "y", "9", DAY[9], DAY[0]), (8, "s", None, "9", DAY[9], DAY[0]), (9, "s", "x", "2", None, DAY[0]), (1, "s", "x", "1", DAY[5], DAY[0]), (10, "s", "x", "2", DAY[4], DAY[0]),
    ]
    targets = [("x", "1", DAY[2], None, "e"), ("x", "2", DAY[1], DAY[3], "e"), ("x", "2", DAY[4], DAY[8], "e"), ("x", "2", DAY[4], DAY[8], "e"), ("y", "3", None, None, "e"), (None, "9", DAY[1], None, "e")]
    return refs, targets


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
@pytest.mark.parametrize("required", [(), ("b",)])
def test_against_brute_force(spark, rows, tables, match, required):
    refs, targets = tables
    r, t = spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)
    got = orphan_references(r, t, ["a", "b"], match=match, required=required, at="at", valid_from="born", valid_to="died")
    assert got.columns == r.columns
    assert rows(got) == brute(refs, targets, match, required)
    got = orphan_references(r, t, ["a", "b"], match=match, required=required)
    assert rows(got) == brute(refs, targets, match, required, timed=False)


def test_empty_tables_and_report(spark, rows, tables):
    refs, targets = tables
    r, t = spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)
    assert rows(orphan_references(r.limit(0), t, ["a", "b"], at="at", valid_from="born", valid_to="died")) == []
    every = orphan_references(r, t.limit(0), ["a", "b"], at="at", valid_from="born", valid_to="died")
    assert {x.edge for x in every.collect()} == {1, 2, 6, 7, 9, 10}
    report = orphan_report(every, "a", "at", ["edge"])
    assert rows(report) == [("x", "2025-01", 4), ("x", None, 1), ("y", "2025-01", 1)]
    with pytest.raises(ValueError):
        orphan_references(r, t, ["a"], match="none")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_join_is_the_plain_join(spark, rows, how):
    left = spark.range(600).selectExpr("CASE WHEN id < 300 THEN 'hot' WHEN id < 310 THEN NULL ELSE concat('k', id % 40) END AS k", "id AS v")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 2), ("k2", 3), (None, 4)], "k string, w int")
    hot = hot_keys(left, ["k"], rows=100)
    assert len(hot) == 1
    assert rows(skew_join(left, right, ["k"], how, salts=4, hot=hot)) == rows(left.join(right, ["k"], how))
    two = left.withColumn("n", left.v % 2)
    other = right.selectExpr("k", "cast(1 as int) AS n", "w")
    hot = hot_keys(two, ["k", "n"], rows=100)
    assert len(hot) == 2
    assert rows(skew_join(two, other, ["k", "n"], how, salts=3, hot=hot)) == rows(two.join(other, ["k", "n"], how))
    lists = left.selectExpr("array(k, 'x') AS k", "v")
    both = right.selectExpr("array(k, 'x') AS k", "w")
    assert rows(skew_join(lists, both, ["k"], how, salts=4, hot=hot_keys(lists, ["k"], rows=100))) == rows(lists.join(both, ["k"], how))
    with pytest.raises(ValueError):
        skew_join(left, right, ["k"], "full")
