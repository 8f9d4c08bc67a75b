import fnmatch as stdlib
import hashlib
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import ids, text, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_uuid5_and_hash(spark):
    names = ["", "a", "src/x.ts:File:src/x.ts:1", "größe:ß:日本", "x" * 5000] + [f"f{i}:Function:n{i}:{i}" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", ids.uuid5(F.col("n")).alias("u"), ids.content_hash(F.col("n")).alias("h")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n))
        assert r.h == hashlib.sha256(r.n.encode()).hexdigest()[:16]
    assert one(spark, ids.content_hash(F.lit(None).cast("string"))) == ""
    assert one(spark, ids.collection_name(F.lit("code"), F.lit("org/model-x:v2"), F.lit(64))) == "code_model-x_64"
    assert one(spark, ids.glossary_id(F.lit(None).cast("string"), F.lit("class"), F.lit("T"), F.lit(None).cast("string"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, ":GlossaryEntry:class:T:"))


def test_counts(spark):
    df = spark.createDataFrame([("",), (" \t\n",), ("a b\n c",), (None,), ("{([\n})]\n((",), ("x\n",)], "t string")
    got = df.select(text.token_count(F.col("t")), text.line_count(F.col("t")), text.nesting_depth(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (0, 1, 0), (3, 2, 0), (0, None, 0), (3, 3, 3), (1, 1, 0)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab/.*?[]!x-", max_size=8), min_size=1, max_size=30), st.text("ab/*?x.", max_size=6))
def test_fnmatch(spark, paths, pattern):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", text.fnmatch(F.col("p"), pattern).alias("m")).collect():
        assert r.m == stdlib.fnmatchcase(r.p, pattern)


def test_expand_clean_and_dedupe(spark):
    assert one(spark, text.expand_query(F.lit("Function test"))) == "Function test def method spec it( describe("
    assert one(spark, text.expand_query(F.lit("nothing"))) == "nothing"
    assert one(spark, text.clean_comment(F.lit("/**\n * One.\n * @param x y\n *\n * Two.\n */"))) == "One. Two."
    assert one(spark, text.clean_comment(F.lit("// short"))) == "short"
    df = spark.createDataFrame([(["b", "a", "b", "", None, "c", "d"],)], "v array<string>")
    assert df.select(text.distinct_capped(F.col("v"), 3)).first()[0] == ["b", "a", "c"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] if r[0] is None else round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, None, None]
    assert [round(x, 6) for x in df.select(vectors.l2_normalize(F.col("a"))).first()[0]] == [0.6, 0.8]
    bad = spark.createDataFrame([([1.0, float("nan")],), ([1.0, float("inf")],), ([0.0, 0.0],), ([1.0],), (None,), ([1.0, None],), ([1.0, 0.0],)], "v array<float>")
    assert [r[0] for r in bad.select(vectors.usable(F.col("v"), 2)).collect()] == [False] * 6 + [True]
