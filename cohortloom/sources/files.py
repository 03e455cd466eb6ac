"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..operators import tables


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def with_order(df: DataFrame) -> DataFrame:
    """df with ord, its rows' place in their files: file, block, place; it replaces insertion order."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")).alias("ord"))


def code_names(spark: SparkSession, path: str, level: str | None = None) -> DataFrame:
    """(code, name): a CSV with a header, all strings; names in lower case, the last of equal codes wins; level keeps its rows only."""
    header = spark.read.text(path).first()[0].split(",")
    d = with_order(spark.read.csv(path, header=True, schema=_strings(*[h.strip().strip('"').lower() for h in header]), escape='"'))
    if level is not None:
        d = d.filter(F.col("level") == level)
    return d.groupBy("code").agg(F.max_by(F.lower("name"), "ord").alias("name"))


def inverse(names: DataFrame) -> DataFrame:
    """(name, code), the greatest code of equal names."""
    return names.groupBy("name").agg(F.max("code").alias("code"))


def multi_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, values): all values of each key in file order; the header is skipped."""
    d = with_order(spark.read.csv(path, header=True, schema=_strings("key", "value")))
    return d.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).getField("value").alias("values"))


def first_map(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """(key, value): the first value of each key; reverse: the file's second column is the key."""
    d = with_order(spark.read.csv(path, header=True, schema=_strings(*(("value", "key") if reverse else ("key", "value")))))
    return d.groupBy("key").agg(F.min_by("value", "ord").alias("value"))


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, value) of two (key, value) maps, inner: keys without an end are dropped."""
    return a.select("key", F.col("value").alias("via")).join(b.select(F.col("key").alias("via"), "value"), "via").select("key", "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def graph_triples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated triples; a line of other than three fields raises."""
    p = F.split("value", "\t", -1)
    sure = F.when(F.size(p) == 3, p).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), "value")))
    return _lines(spark, path).select(sure.alias("p")).select(*[F.col("p")[i].alias(n) for i, n in enumerate(("head", "relation", "tail"))])


def tolerant_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples of trimmed lines with three fields, (skipped): how many others there were)."""
    p = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t", -1)
    rows = _lines(spark, path).select(p.alias("p"))
    good = rows.filter(F.size("p") == 3).select(*[F.col("p")[i].alias(n) for i, n in enumerate(("head", "relation", "tail"))])
    return good, rows.agg(F.count_if(F.size("p") != 3).alias("skipped"))


def quoted_triples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated triples with double quotes interpreted; the first three of three or more fields."""
    d = spark.read.csv(path, sep="\t", quote='"', escape='"', schema=_strings("head", "relation", "tail"), mode="PERMISSIVE")
    return d.filter("tail IS NOT NULL")


def write_by_code(df: DataFrame, path: str, by=("mode", "code")) -> None:
    """A table partitioned by mode and code; a run replaces the partitions that it writes, so reruns don't double rows."""
    df.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def code_graph(spark: SparkSession, path: str, mode: str, code: str) -> DataFrame:
    """One code's graph: the partition filter prunes all other files."""
    return spark.read.parquet(path).filter((F.col("mode") == mode) & (F.col("code") == code))


def json_documents(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """(key, value) of files that hold one JSON object of key to value."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias("key", "value"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; lines that don't parse raise."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


ARTICLE = """MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>,
  Journal: struct<JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>, AuthorList: struct<Author: array<struct<ForeName: string, LastName: string>>>>>"""


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, authors, abstract, publication_year) of article XML, packed or not; the first abstract text, the year or the
    first four characters of the date; those with a number and a title or an abstract."""
    x = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path).select("MedlineCitation.*")
    date = F.col("Article.Journal.JournalIssue.PubDate")
    names = F.transform("Article.AuthorList.Author", lambda a: F.concat_ws(" ", a["ForeName"], a["LastName"]))
    year = F.coalesce(date["Year"], F.substring(date["MedlineDate"], 1, 4))
    out = x.select(F.col("PMID._VALUE").alias("pmid"), F.col("Article.ArticleTitle").alias("title"), F.array_join(names, ", ").alias("authors"), F.get("Article.Abstract.AbstractText", F.lit(0)).alias("abstract"), year.try_cast("int").alias("publication_year"))
    return out.filter("pmid IS NOT NULL AND (title IS NOT NULL OR abstract IS NOT NULL)")


def insert_or_ignore(new: DataFrame, key: str, order: str | Column, existing: DataFrame | None = None) -> DataFrame:
    """The first row of each key that isn't there yet."""
    w = Window.partitionBy(key).orderBy(order)
    first = new.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def missing(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that a finished run hasn't got: what a resumed run computes."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> None:
    """Raise unless both have as many rows, as after a conversion."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows became {m}")


def search_articles(index: DataFrame, query: Column | str, batch: int = 20) -> DataFrame:
    """(batch, pmid): articles whose title or abstract has the query, in batches by number; the offline stand-in of a search service."""
    q = F.lit(query) if isinstance(query, str) else query
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    hit = index.filter(F.contains(text, F.lower(q))).select("pmid")
    return tables.numbered(hit, "place", "pmid").select(F.floor(F.col("place") / batch).alias("batch"), "pmid")


def search_service(queries: DataFrame, connector, column: str = "query", batch: int = 20) -> DataFrame:
    """(query, batch, pmid, title, abstract): what a service finds for each query, batch after batch until one isn't full.

    connector: a function of (query, first, batch) that gives (pmid, title, abstract) rows; it runs in the tasks.
    """
    schema = T.StructType([queries.schema[column], T.StructField("batch", T.LongType()), *_strings("pmid", "title", "abstract").fields])

    def ask(batches):
        import pandas as pd

        for pdf in batches:
            for q in pdf[column]:
                number = 0
                while q is not None:
                    got = list(connector(q, number * batch, batch))
                    yield pd.DataFrame([(q, number, *r) for r in got], columns=schema.names)
                    if len(got) < batch:
                        break
                    number += 1

    return queries.select(column).mapInPandas(ask, schema)
