import pytest
from pyspark.sql import functions as F

from skein.operators import embed, parse
from skein.sources import scan
from skein.sources.store import TableStore, scroll
from skein.streaming.ingest import chunks_of, ingest

SOURCE = """// head
import a, { b as c } from 'mod';
import * as all from "./x";
/* block
   two */
@sealed
export class Foo extends Bar {
  size: number = 1;
  /** doc */
  async run(x: Map<string, any>): Promise<any> { return this.go(x) / 2; }
}
export interface Shape extends Base { kind: string }
export type Kind = 'a' | 'b';
const re = /[/"]*\\/{2}/g, s = `t ${ '// no' } /* no */`;
export const make = (n) => { var old = helper(n); return old; };
function plain() { return "/* no */"; } // tail
export { plain, make as other };
"""


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("src/a.ts", SOURCE), ("b.js", ""), ("c.ts", "const a = 'open"), ("d.ts", None), (None, "x")], "path string, content string")


def test_symbols_and_metadata(spark, files):
    got = {(r.label, r.name or r.module): (r.start_line, r.end_line, r.is_exported) for r in parse.symbols(files).where("path = 'src/a.ts'").collect()}
    assert got[("Class", "Foo")] == (7, 11, True) and got[("Method", "run")][:2] == (10, 10) and ("Field", "size") in got
    assert {k for k in got if k[0] == "Import"} == {("Import", "mod"), ("Import", "./x")}
    assert ("Interface", "Shape") in got and ("TypeAlias", "Kind") in got and got[("Function", "make")][0] == 15 and ("Function", "plain") in got and ("Variable", "re") in got
    meta = {r.path: r for r in parse.file_metadata(files).collect()}
    m = meta["src/a.ts"]
    assert m.imports == ["mod", "./x"] and m.exports == ["plain", "make", "other"] and m.class_name == "Foo" and m.visibility == "public" and m.decorators == ["sealed"]
    assert "this.go" in m.call_sites and "helper" in m.call_sites and m.symbols_defined == ["make", "old", "plain"] or set(m.symbols_defined) == {"make", "old", "plain"}
    assert meta["c.ts"].imports == [] and meta["c.ts"].visibility == "private" and len(meta) == 4


def test_comments_are_stripped(spark, files):
    got = {r.path: r for r in parse.strip_comments(files).collect()}
    text = got["src/a.ts"].stripped_text
    assert got["src/a.ts"].comments == 4 and "head" not in text and "two" not in text and "tail" not in text
    assert "'// no'" in text and '"/* no */"' in text and "/[/\"]*\\/{2}/g" in text
    assert got["c.ts"].status == "partial" and got["b.js"].stripped_text == ""
    many = spark.createDataFrame([("m.js", "\n".join(f"import x{i} from 'm{i}';" for i in range(60)))], "path string, content string")
    assert len(parse.file_metadata(many).first().imports) == 50


def test_scan(spark, tmp_path):
    for name, data in {"a.ts": b"let a;", "node_modules/b.js": b"x", "src/C.JS": b"y\xff", "bin.js": b"a\0b", "note.txt": b"t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in scan.discover_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.ts", "src/C.JS"} and got["src/C.JS"].language == "javascript" and len(got["a.ts"].file_hash) == 16
    (tmp_path / "g.yaml").write_text("entries:\n- {term: A, kind: class, summary: s, confidence: 0.5}\n- 7\n")
    assert [r.term for r in scan.manual_glossary(spark, str(tmp_path / "g.yaml")).collect()] == ["A"]
    assert scan.manual_glossary(spark, str(tmp_path / "none.yaml")).count() == 0


def test_store_and_stream(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], "id string, v string, seq int")
    store.upsert("t", a, ["id"], "seq")
    store.upsert("t", a.withColumn("v", F.lit("new")).withColumn("seq", F.lit(2)).limit(1), ["id"], "seq")
    store.upsert("t", a, ["id"], "seq")
    assert sorted(tuple(r) for r in store.read("t").collect()) == [("1", "new", 2), ("2", "y", 1)]
    assert store.collections() == ["t"] and store.healthy() and [r.id for r in scroll(store.read("t"), 1).collect()] == ["1", "2"]
    store.clear("t")
    assert not store.exists("t")
    schema = "path string, file_hash string, seq bigint, content string"
    new = lambda seq, text: spark.createDataFrame([("f.ts", f"h{seq}", seq, text)], schema)
    new(1, "one two\nthree").write.parquet(str(tmp_path / "in/1"))
    for seq in (1, 2):
        if seq == 2:
            new(2, "four").write.parquet(str(tmp_path / "in/2"))
        ingest(spark, str(tmp_path / "in/*"), schema, store, str(tmp_path / "cp"), 5, 1).awaitTermination()
        assert {r.text_content for r in store.read("chunks").collect()} == ({"one two\nthree"} if seq == 1 else {"four"})
    assert chunks_of(new(1, ""), 5, 1).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in embed.embed_texts(df, "text", embed.HashingEmbedder(8)).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and set(got[3]) == {0.0} == set(got[4])

    class Small(embed.HashingEmbedder):
        def embed(self, texts):
            if len(texts) > 1:
                raise MemoryError
            return super().embed(texts)

    assert {r.id: r.embedding for r in embed.embed_texts(df, "text", Small(8)).collect()} == got
