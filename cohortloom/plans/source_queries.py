"""Queries of the ingest operators on the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import communities, ehr, providers, prompts, retrieval, tables, triples
from ..sources import clinical, files
from ..streaming import ingest
from . import ehr_queries, knowledge_queries

_READ = ehr_queries._READ


def _articles(spark, d):
    """Documents as articles: several of one source and language have one key."""
    x = clinical.read(spark, d, "documents")
    return x.select(F.concat_ws("/", "source", "lang").alias("pmid"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.col("doc_id").alias("ord"))


def first_articles(spark, d):
    """The first article of each key, but for the keys that are there: those of labelled toxic documents."""
    a = _articles(spark, d)
    there = a.join(clinical.read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("ord")), "ord", "left_semi")
    return files.insert_or_ignore(a, "pmid", "ord", there).select("pmid", "ord").unionByName(files.insert_or_ignore(a, "pmid", "ord").select(F.concat(F.lit("all "), "pmid").alias("pmid"), "ord"))


def article_search(spark, d):
    a = _articles(spark, d).withColumn("pmid", F.col("ord"))
    return files.search_articles(a, "Und", 20)


def unfinished_orders(spark, d):
    """What a resumed run has left: orders without a returned line."""
    o, li = clinical.read(spark, d, "orders"), clinical.read(spark, d, "lineitem")
    done = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.missing(o.select("o_orderkey", "o_orderpriority"), done, "o_orderkey")


def composed_codes(spark, d):
    """Suppliers to regions by way of nations, suppliers of unknown nations dropped."""
    s, n = clinical.read(spark, d, "supplier"), clinical.read(spark, d, "nation")
    return files.compose(s.select(F.col("s_name").alias("key"), F.col("s_nationkey").alias("value")), n.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value")))


def inverse_names(spark, d):
    p = clinical.read(spark, d, "part")
    return files.inverse(p.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name")))


def nested_history(spark, d):
    """Readmission samples with histories whose lists are wrapped once more, so three deep: how many lists and codes they have."""
    v = ehr.readmission(clinical.visit_lists(spark, d)).withColumns({c: F.array(c) for c in ehr.LISTS})
    h = ehr.cumulative(v)
    return h.select("visit_id", "label", *[F.size(f"hist_{c}").alias(f"visits_{c}") for c in ehr.LISTS], *[F.size(F.flatten(F.flatten(f"hist_{c}"))).alias(f"codes_{c}") for c in ehr.LISTS])


def knowledge_answers(spark, d):
    """Not SQL: the stub provider's answers to knowledge prompts."""
    c = clinical.read(spark, d, "customer").select("c_custkey", prompts.knowledge_prompt("mortality", F.col("c_name")).alias("prompt"))
    return providers.complete(c, "prompt").select("c_custkey", "answer")


def themed_summaries(spark, d):
    """Not SQL: summaries that the stub provider finds relevant."""
    return communities.theme_gate(knowledge_queries.community_summaries(spark, d), providers.stub, "summary")


def article_embeddings(spark, d):
    """Not SQL: the stub provider's embeddings of the abstract, or of the title where that is blank."""
    a = _articles(spark, d).select("ord", retrieval.document_text(F.col("title"), F.col("abstract")).alias("t"))
    return providers.embed(a, "t", prefix="search_document: ").select("ord", "embedding")


def _written(df, label, fmt, **options):
    """The path of files of df, in the shared folder."""
    path = tables.new_path(df.sparkSession, label)
    df.write.options(**options).format(fmt).save(path)
    return path


def _read(spark, d, table):
    return clinical.read(spark, d, table)


def file_code_names(spark, d):
    """Parts' sizes as codes of a CSV in order of the parts: the last name of a code wins."""
    x = _read(spark, d, "part").orderBy("p_partkey").select(F.col("p_size").cast("string").alias("code"), F.concat("p_name", F.lit('; "the" part, '), "p_brand").alias("name"))
    return files.code_names(spark, _written(x, "codes", "csv", header=True, escape='"'))


def file_code_levels(spark, d):
    x = _read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "3.0").otherwise("2.0").alias("level"))
    return files.code_names(spark, _written(x, "levels", "csv", header=True, escape='"'), "3.0")


def file_multi_map(spark, d):
    x = _read(spark, d, "orders").orderBy(F.desc("o_orderkey")).select(F.col("o_custkey").cast("string").alias("a"), F.col("o_orderkey").cast("string").alias("b"))
    return files.multi_map(spark, _written(x, "multi", "csv", header=True)).select("key", F.array_join("values", "|").alias("values"))


def file_first_map(spark, d):
    """Orders and their customers, read from right to left: each customer's first order."""
    x = _read(spark, d, "orders").orderBy(F.desc("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_custkey").cast("string").alias("b"))
    return files.first_map(spark, _written(x, "first", "csv", header=True), reverse=True)


def _suppliers(spark, d, line):
    return _read(spark, d, "supplier").join(_read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(line.alias("value"))


def _fields(*x):
    return F.concat_ws("\t", *x)


def file_graph_triples(spark, d):
    return files.graph_triples(spark, _written(_suppliers(spark, d, _fields("s_name", F.lit("of"), "n_name")), "graph", "text"))


def _tolerant(spark, d):
    """Lines of two fields, of three with blanks around, and of four."""
    k = F.col("s_suppkey") % 3
    line = F.when(k == 0, _fields("s_name", "n_name")).when(k == 1, F.concat(F.lit(" "), _fields("s_name", F.lit("of"), "n_name"), F.lit("  "))).otherwise(_fields("s_name", F.lit("of"), "n_name", F.lit("more")))
    return files.tolerant_triples(spark, _written(_suppliers(spark, d, line), "tolerant", "text"))


def file_tolerant_triples(spark, d):
    return _tolerant(spark, d)[0]


def file_skipped_lines(spark, d):
    return _tolerant(spark, d)[1]


def file_quoted_triples(spark, d):
    """Quoted heads with a tab and doubled quotes within, some lines of two fields."""
    head = F.concat(F.lit('"'), "s_name", F.lit('\tthe ""first"""'))
    line = F.when(F.col("s_suppkey") % 4 == 0, _fields(head, "n_name")).otherwise(_fields(head, F.lit("of"), "n_name", F.lit("more")))
    return files.quoted_triples(spark, _written(_suppliers(spark, d, line), "quoted", "text"))


def file_code_graph(spark, d):
    """The graph of one code of a sink written twice."""
    x = _read(spark, d, "part").select(F.lit("parts").alias("mode"), F.col("p_size").cast("string").alias("code"), F.col("p_name").alias("head"), F.lit("by").alias("relation"), F.col("p_brand").alias("tail"))
    path = tables.new_path(spark, "by-code")
    for _ in range(2):
        files.write_by_code(x, path)
    return files.code_graph(spark, path, "parts", "7").select("head", "relation", "tail")


def file_json_documents(spark, d):
    """One file of one object: nations' names to their regions' numbers as lists."""
    n = _read(spark, d, "nation")
    whole = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.array(F.col("n_regionkey").cast("string"), F.lit("x \"y\"")))))).alias("value"))
    got = files.json_documents(spark, _written(whole, "json", "text"), T.ArrayType(T.StringType()))
    return got.select("key", F.array_join("value", "|").alias("value"))


def file_jsonl(spark, d):
    x = _read(spark, d, "conversations").select(F.col("role").alias("input"), F.col("text").alias("output"))
    path = tables.new_path(spark, "lines")
    files.write_jsonl(x, path)
    return files.read_jsonl(spark, path, x.schema).groupBy("input", "output").agg(F.count(F.lit(1)).alias("n"))


def file_articles(spark, d):
    """Customers as packed article XML: some without a number, title, abstract or year."""
    k = F.col("c_custkey")
    tag = lambda name, x, there: F.when(there, F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))).otherwise("")
    year = F.when(k % 3 == 0, "<Year>1999</Year>").when(k % 3 == 1, "<MedlineDate>2001 Jan-Feb</MedlineDate>").otherwise("")
    text = F.concat(F.lit("<Abstract>"), tag("AbstractText", F.col("c_mktsegment"), k % 5 != 0), tag("AbstractText", F.lit("second"), k % 5 != 0), F.lit("</Abstract>"))
    people = F.concat(F.lit("<AuthorList><Author><ForeName>A</ForeName><LastName>"), "c_mktsegment", F.lit("</LastName></Author><Author><ForeName>B</ForeName><LastName>C</LastName></Author></AuthorList>"))
    line = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), tag("PMID", k.cast("string"), k % 11 != 0), F.lit("<Article>"), tag("ArticleTitle", F.col("c_name"), k % 7 != 0), text, F.lit("<Journal><JournalIssue><PubDate>"), year, F.lit("</PubDate></JournalIssue></Journal>"), people, F.lit("</Article></MedlineCitation></PubmedArticle>"))
    whole = _read(spark, d, "customer").agg(F.concat(F.lit("<Set>"), F.array_join(F.collect_list(line), "\n"), F.lit("</Set>")).alias("value"))  # a file of one element, as they come
    return files.articles(spark, _written(whole, "articles", "text", compression="gzip"))


def file_ingest(spark, d):
    """Two deliveries of events, the second with the first's, in three runs: the first row of each user and kind stays."""
    e = _read(spark, d, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("k"), "event_id")
    source, target, at = (tables.new_path(spark, x) for x in ("delivered", "ingested", "ledger"))
    for half in (F.col("event_id") % 2 == 0, F.lit(True)):
        e.filter(half).write.mode("append").parquet(source)
        ingest.ingest_once(spark, source, e.schema, target, at, "k", "event_id")
    ingest.ingest_once(spark, source, e.schema, target, at, "k", "event_id")
    return spark.read.schema(e.schema).parquet(target)


def _triple_stub(prompt):
    """Neighbouring concepts as triples; it fails on some prompts."""
    import hashlib

    if hashlib.md5(prompt.encode()).hexdigest()[0] in "01234":
        raise ValueError("no answer")
    names = prompt.split(": ", 1)[1].split(", ")
    return "\n".join(f"[{a}, is near, {b}]" for a, b in zip(names, names[1:]))


def provider_triples(spark, d):
    x = _read(spark, d, "part").groupBy("p_size").agg(F.array_sort(F.collect_set("p_brand")).alias("names"))
    return triples.provider_triples(x, "names", _triple_stub)


def _service_stub(query, first, batch):
    """A service that has 7 times the query's length articles."""
    return [(f"{query}-{i}", f"on {query}", None) for i in range(first, min(first + batch, 7 * len(query)))]


def service_search(spark, d):
    q = _read(spark, d, "nation").select(F.col("n_name").alias("query"))
    return files.search_service(q, _service_stub)


_fns = (file_code_names, file_code_levels, file_multi_map, file_first_map, file_graph_triples, file_tolerant_triples, file_skipped_lines, file_quoted_triples, file_code_graph, file_json_documents, file_jsonl, file_articles, file_ingest, provider_triples, service_search, first_articles, article_search, unfinished_orders, composed_codes, inverse_names, nested_history, knowledge_answers, themed_summaries, article_embeddings)
QUERIES = {f.__name__: f for f in _fns}
_SUM = lambda c, f: f"(sum({f}) OVER w)::INT AS {c}"
_SN = "sn AS (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
ORACLE_SQL = {
    "file_code_names": """SELECT p_size::VARCHAR AS code, lower(arg_max(p_name || '; "the" part, ' || p_brand, p_partkey)) AS name FROM part GROUP BY p_size""",
    "file_code_levels": "SELECT p_partkey::VARCHAR AS code, lower(p_name) AS name FROM part WHERE p_size > 25",
    "file_multi_map": "SELECT o_custkey::VARCHAR AS key, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey DESC) AS values FROM orders GROUP BY o_custkey",
    "file_first_map": "SELECT o_custkey::VARCHAR AS key, max(o_orderkey)::VARCHAR AS value FROM orders GROUP BY o_custkey",
    "file_graph_triples": f"WITH {_SN} SELECT s_name AS head, 'of' AS relation, n_name AS tail FROM sn",
    "file_tolerant_triples": f"WITH {_SN} SELECT s_name AS head, 'of' AS relation, n_name AS tail FROM sn WHERE s_suppkey % 3 = 1",
    "file_skipped_lines": f"WITH {_SN} SELECT count(*) FILTER (s_suppkey % 3 <> 1) AS skipped FROM sn",
    "file_quoted_triples": f"""WITH {_SN} SELECT s_name || chr(9) || 'the "first"' AS head, 'of' AS relation, n_name AS tail FROM sn WHERE s_suppkey % 4 <> 0""",
    "file_code_graph": "SELECT p_name AS head, 'by' AS relation, p_brand AS tail FROM part WHERE p_size = 7",
    "file_json_documents": """SELECT n_name AS key, n_regionkey || '|x "y"' AS value FROM nation""",
    "file_jsonl": "SELECT role AS input, text AS output, count(*) AS n FROM conversations GROUP BY ALL",
    "file_articles": """SELECT c_custkey::VARCHAR AS pmid, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS title, 'A ' || c_mktsegment || ', B C' AS authors, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS abstract,
  CASE c_custkey % 3 WHEN 0 THEN 1999 WHEN 1 THEN 2001 END AS publication_year FROM customer WHERE c_custkey % 11 <> 0 AND (c_custkey % 7 <> 0 OR c_custkey % 5 <> 0)""",
    "file_ingest": "SELECT event_type || '/' || user_id AS k, coalesce(min(event_id) FILTER (event_id % 2 = 0), min(event_id)) AS event_id FROM events GROUP BY 1",
    "provider_triples": """WITH p AS (SELECT list_sort(list(DISTINCT p_brand)) AS names FROM part GROUP BY p_size), q AS (SELECT names FROM p WHERE left(md5('Triples of: ' || array_to_string(names, ', ')), 1) > '4')
  SELECT DISTINCT names[i] AS head, 'is near' AS relation, names[i + 1] AS tail FROM (SELECT names, unnest(range(1, len(names))) AS i FROM q) x""",
    "service_search": "SELECT n_name AS query, i // 20 AS batch, n_name || '-' || i AS pmid, 'on ' || n_name AS title, NULL::VARCHAR AS abstract FROM (SELECT n_name, unnest(range(7 * length(n_name))) AS i FROM nation) x",
    "first_articles": "WITH a AS (SELECT source || '/' || lang AS pmid, doc_id FROM documents), f AS (SELECT pmid, min(doc_id) AS ord FROM a GROUP BY 1) SELECT pmid, ord FROM f WHERE pmid NOT IN (SELECT pmid FROM a JOIN labels USING (doc_id) WHERE toxic = 1) UNION ALL SELECT 'all ' || pmid, ord FROM f",
    "article_search": "SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch, doc_id AS pmid FROM documents WHERE contains(lower(source || ' ' || text), 'und')",
    "unfinished_orders": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "composed_codes": "SELECT s_name AS key, n_regionkey AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "inverse_names": "SELECT p_name AS name, max(CAST(p_partkey AS VARCHAR)) AS code FROM part GROUP BY 1",
    "nested_history": f"{_READ} SELECT visit_id, label, {', '.join(f'(count(*) OVER w)::INT AS visits_{c}' for c in ehr.LISTS)}, {', '.join(_SUM('codes_' + c, f'len({c})') for c in ehr.LISTS)} FROM s WINDOW w AS (PARTITION BY patient_id ORDER BY visit_ts, visit_key ROWS UNBOUNDED PRECEDING)",
}
