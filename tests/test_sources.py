"""Readers, writers and incremental ingest on small files."""

import gzip

import pytest
from pyspark.sql import types as T

from cohortloom.sources import files
from cohortloom.streaming import ingest


def put(path, text):
    path.write_text(text)
    return str(path)


def test_code_names(spark, tmp_path):
    p = put(tmp_path / "c.csv", 'code,name,level\n1,"Heart; and, LUNG",3.0\n2,Two,2.0\n1,Last One,3.0\n')
    assert {(r.code, r.name) for r in files.code_names(spark, p).collect()} == {("1", "last one"), ("2", "two")}
    assert [r.code for r in files.code_names(spark, p, "3.0").collect()] == ["1"]


def test_maps(spark, tmp_path):
    p = put(tmp_path / "m.csv", "a,b\nx,1\nx,2\ny,3\n")
    assert {r["key"]: list(r["values"]) for r in files.multi_map(spark, p).collect()} == {"x": ["1", "2"], "y": ["3"]}
    assert {(r.key, r.value) for r in files.first_map(spark, p).collect()} == {("x", "1"), ("y", "3")}
    assert {(r.key, r.value) for r in files.first_map(spark, p, True).collect()} == {("1", "x"), ("2", "x"), ("3", "y")}


def test_triples(spark, tmp_path):
    p = put(tmp_path / "t.tsv", "a\tb\tc\nonly two\tfields\n \"q\"\tr\ts \n")
    good, bad = files.tolerant_triples(spark, p)
    assert {(r.head, r.tail) for r in good.collect()} == {("a", "c"), ('"q"', "s")} and bad.first().skipped == 1
    with pytest.raises(Exception, match="not three fields"):
        files.graph_triples(spark, p).collect()
    assert files.quoted_triples(spark, put(tmp_path / "q.tsv", '"a b"\tr\tc\td\nx\ty\n')).collect()[0].head == "a b"


def test_json(spark, tmp_path):
    p = put(tmp_path / "d.json", '{"k": ["a", "b"], "l": []}')
    assert {r.key: list(r.value) for r in files.json_documents(spark, p, T.ArrayType(T.StringType())).collect()} == {"k": ["a", "b"], "l": []}
    schema = T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StringType())])
    rows = spark.createDataFrame([("a", "b")], schema)
    files.write_jsonl(rows, str(tmp_path / "o"))
    assert files.read_jsonl(spark, str(tmp_path / "o"), schema).collect() == rows.collect()


def test_partitioned_sink_is_idempotent(spark, tmp_path):
    d = spark.createDataFrame([("m", "1", "x"), ("m", "2", "y")], "mode string, code string, head string")
    for _ in range(2):
        files.write_by_code(d, str(tmp_path / "g"))
    one = files.code_graph(spark, str(tmp_path / "g"), "m", "1")
    assert [r.head for r in one.collect()] == ["x"]
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()


XML = """<S><PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>T{0}</ArticleTitle><Abstract><AbstractText>first</AbstractText><AbstractText>second</AbstractText></Abstract>
<Journal><JournalIssue><PubDate><MedlineDate>1998 Jan</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><ForeName>A</ForeName><LastName>B</LastName></Author><Author><ForeName>C</ForeName><LastName>D</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></S>"""


def test_articles(spark, tmp_path):
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write(XML.format(7))
    r = files.articles(spark, str(tmp_path / "a.xml.gz")).collect()
    assert [tuple(x) for x in r] == [("7", "T7", "A B, C D", "first", 1998)]


def test_ingest_reads_each_file_and_key_once(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.LongType())])
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    write([("a", 1), ("a", 2), ("b", 3)])
    ingest.ingest_once(spark, src, schema, out, at, "k", "i")
    write([("b", 9), ("c", 4)])
    for _ in range(2):
        ingest.ingest_once(spark, src, schema, out, at, "k", "i")
    assert sorted((r.k, r.i) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_resume_and_counts(spark):
    a, b = spark.range(5), spark.range(3)
    assert sorted(r.id for r in files.missing(a, b, "id").collect()) == [3, 4]
    with pytest.raises(ValueError):
        files.same_rows(a, b)
