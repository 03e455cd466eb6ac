"""Queries of patient contexts, vectors and retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, ehr, providers, retrieval, vectors
from ..sources import clinical
from . import ehr_queries

_V, _RET = clinical.SQL_VIEWS, ehr_queries._RET


def context_texts(spark, d):
    return context.rolling_contexts(ehr_queries._samples(spark, d)).select("sample_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


def _concepts(spark, d):
    """Parts' types and names as concepts, some of several parts."""
    p = clinical.read(spark, d, "part")
    return p.select("p_partkey", F.when(F.col("p_size") > 25, F.concat_ws(";", "p_type", "p_brand", "p_name")).otherwise(F.col("p_brand")).alias("concept"))


def concept_filter(spark, d):
    p = clinical.read(spark, d, "part")
    return context.concept_filter(_concepts(spark, d), p.select(F.col("p_brand").alias("node")).union(p.select("p_name")))


def _patients(spark, d):
    """(sample_id, node): embeddings as patients, the nation of their label as concept."""
    e, n = clinical.read(spark, d, "embeddings"), clinical.read(spark, d, "nation")
    return e.join(n, e.label == n.n_nationkey).select(F.col("vec_id").alias("sample_id"), F.col("n_name").alias("node"))


def _graphs(spark, d):
    s, n, r = (clinical.read(spark, d, t) for t in ("supplier", "nation", "region"))
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("concept"), F.col("n_name").alias("head"), F.col("r_name").alias("tail"))
    return a.unionByName(s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("concept"), F.col("s_name").alias("head"), F.col("n_name").alias("tail")))


def patient_nodes(spark, d):
    return context.patient_nodes(_patients(spark, d), _graphs(spark, d))


def truncated_texts(spark, d):
    x = clinical.read(spark, d, "documents")
    return x.select("doc_id", F.md5(context.truncated(F.col("text"))).alias("digest"))


def base_parts(spark, d):
    x = clinical.read(spark, d, "documents")
    whole = F.concat("text", F.lit("Summary: of "), "source", F.lit("\n\nSupplementary Information: "), "lang")
    return x.select("doc_id", F.md5(context.base_part(whole)).alias("digest"))


def _vecs(spark, d):
    return clinical.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _info(spark, d):
    """Two following vectors are one patient's samples."""
    e = clinical.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 2).alias("patient"), F.col("label").cast("string").alias("label"), F.concat(F.lit("context "), "vec_id").alias("text"))


def similar_patients(spark, d):
    s = retrieval.similar_patients(_vecs(spark, d), _info(spark, d))
    return s.select("id", F.array_join("positive", "|").alias("positive"), F.array_join("negative", "|").alias("negative"))


def similar_patients_full(spark, d):
    return retrieval.nearest_ids(_vecs(spark, d), _info(spark, d), 1)


def dense_search(spark, d):
    v = _vecs(spark, d)
    return retrieval.dense_search(v, v, 10).select("query", "item", F.round("score", 6).alias("score"), "rank")


def article_lookup(spark, d):
    return retrieval.lookup(clinical.read(spark, d, "labels"), clinical.read(spark, d, "documents"), "doc_id").select("doc_id", "source", "n_chars")


def document_texts(spark, d):
    x = clinical.read(spark, d, "documents")
    return x.select("doc_id", F.md5(retrieval.document_text(F.col("source"), F.when(F.col("n_chars") > 200, F.col("text")).otherwise(F.lit("  ")))).alias("digest"))


def training_pairs(spark, d):
    o = clinical.read(spark, d, "orders")
    pos = o.select(F.col("o_custkey").alias("patient"), F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("item"))
    return retrieval.training_pairs(pos, pos, 10)


def keyword_queries(spark, d):
    return clinical.read(spark, d, "documents").select("doc_id", retrieval.keywords(F.col("text")).alias("query"))


def _members(spark, d):
    """A community for each nation: the nations of its region, the region and its own suppliers."""
    n, m = clinical.read(spark, d, "nation"), clinical.read(spark, d, "nation")
    m = m.select(F.col("n_name").alias("node"), F.col("n_regionkey").alias("k"))
    a = n.join(m, n.n_regionkey == m.k).select(F.col("n_nationkey").alias("community"), "node")
    g = _graphs(spark, d).select("concept", F.explode(F.array("head", "tail")).alias("node"))
    b = n.join(g, n.n_name == g.concept).select(F.col("n_nationkey").alias("community"), "node")
    return a.unionByName(b).distinct()


def _label_vecs(spark, d):
    e = clinical.read(spark, d, "embeddings")
    return vectors.cluster_means(_vecs(spark, d), e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))).withColumnRenamed("cluster", "community")


def _patient_vecs(spark, d):
    return _vecs(spark, d).select(F.col("id").alias("sample_id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))


def _one_shot(spark, d):
    of, nodes = context.profiles(_patients(spark, d), _graphs(spark, d))
    return retrieval.one_shot_scores(nodes, _members(spark, d), _patient_vecs(spark, d), _label_vecs(spark, d), of=of)


def one_shot_communities(spark, d):
    s = _one_shot(spark, d)
    return s.withColumn("score", F.round("score", 6))


def support_texts(spark, d):
    s = _one_shot(spark, d)
    t = clinical.read(spark, d, "nation").select(F.col("n_nationkey").alias("community"), F.concat(F.lit("about "), "n_name").alias("summary"))
    return retrieval.support_text(s, t)


def theme_factors(spark, d):
    c = _patient_vecs(spark, d).withColumnRenamed("sample_id", "community")
    return retrieval.theme_factor(c, _label_vecs(spark, d)).withColumn("theme", F.round("theme", 6))


def greedy_communities(spark, d):
    v = _label_vecs(spark, d)
    of, nodes = context.profiles(_patients(spark, d), _graphs(spark, d))
    visits = _patients(spark, d).withColumn("visit_idx", F.pmod(F.col("sample_id"), F.lit(4)))
    return retrieval.greedy_retrieval(nodes, _members(spark, d), _patient_vecs(spark, d), v, v, visits, of=of)


def _by_label(spark, d):
    return clinical.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def entity_clusters(spark, d):
    return vectors.clusters(_vecs(spark, d), 0.14)


def cluster_means(spark, d):
    m = vectors.cluster_means(_vecs(spark, d), _by_label(spark, d))
    return m.select("cluster", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6))


def cluster_representatives(spark, d):
    return vectors.representatives(_vecs(spark, d), _by_label(spark, d))


def cluster_mappings(spark, d):
    of = _by_label(spark, d)
    return vectors.mappings(of, vectors.representatives(_vecs(spark, d), of))[1]


def cluster_silhouette(spark, d):
    return vectors.silhouette(_vecs(spark, d), _by_label(spark, d)).select(F.round("silhouette", 6).alias("silhouette"))


def text_embeddings(spark, d):
    x = clinical.read(spark, d, "documents").select("doc_id", context.truncated(F.col("text")).alias("text"))
    return providers.embed(x, "text", prefix="search_document: ").select("doc_id", "embedding")


_fns = (context_texts, concept_filter, patient_nodes, truncated_texts, base_parts, similar_patients, similar_patients_full, dense_search, article_lookup, document_texts, training_pairs, keyword_queries, one_shot_communities, support_texts, theme_factors, greedy_communities, entity_clusters, cluster_means, cluster_representatives, cluster_mappings, cluster_silhouette, text_embeddings)
QUERIES = {f.__name__: f for f in _fns}

_G = """gr AS (SELECT n_name AS concept, n_name AS head, r_name AS tail FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
pt AS (SELECT vec_id AS sample_id, n_name AS node FROM embeddings JOIN nation ON label = n_nationkey),
gn AS (SELECT DISTINCT concept, node FROM (SELECT concept, unnest([head, tail]) AS node FROM gr) q),
pn AS (SELECT DISTINCT sample_id, 'direct' AS kind, node FROM pt UNION ALL SELECT DISTINCT sample_id, 'indirect', gn.node FROM pt JOIN gn ON pt.node = concept WHERE gn.node <> concept)"""
_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings), nv AS (SELECT id, label, vec, greatest(sqrt(list_inner_product(vec, vec)), 1e-5) AS len FROM e)"
_DOTS = f"{_E}, dots AS (SELECT a.id AS query, b.id AS item, a.label AS ql, b.label AS il, round(list_inner_product(a.vec, b.vec) / (a.len * b.len), 9) AS score FROM nv a, nv b), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM dots)"
_MEANS = "mn AS (SELECT label AS cluster, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) q GROUP BY 1, 2), mv AS (SELECT cluster, list(x ORDER BY pos) AS mean FROM mn GROUP BY 1)"
_REP = f"{_E}, {_MEANS}, rep AS (SELECT cluster, arg_min(id, (round(list_distance(vec, mean) * list_distance(vec, mean), 9), id)) AS representative FROM e JOIN mv ON label = cluster GROUP BY cluster)"
_SHOT = f"""{_G}, {_E}, {_MEANS}, mem AS (SELECT a.n_nationkey AS community, b.n_name AS node FROM nation a JOIN nation b USING (n_regionkey) UNION SELECT n_nationkey, node FROM nation JOIN gn ON n_name = concept),
base AS (SELECT sample_id, community, sum(CASE kind WHEN 'direct' THEN 10.0::DOUBLE ELSE 0.2::DOUBLE END) AS base FROM pn JOIN mem USING (node) GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY base DESC, community) AS i FROM base),
sc AS (SELECT sample_id, community, round(base * (1 + list_inner_product(vec, mean) / 10), 9) AS score FROM pool JOIN e ON id = sample_id JOIN mv ON cluster = community WHERE i <= 200),
shot AS (SELECT sample_id, community, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, community) AS rank FROM sc WHERE score > 0.3 QUALIFY rank <= 10)"""
_ITEMS = " UNION ALL ".join(f"SELECT sample_id, visit_idx, '{k}' AS kind, unnest({k}) AS name, generate_subscripts({k}, 1) - 1 AS pos FROM rd" for k in context.HEADINGS)
_PART = lambda k: f"'{context.HEADINGS[k]}:' || chr(10) || coalesce(max(lines) FILTER (kind = '{k}'), '')"
ORACLE_SQL = {
    "context_texts": f"""WITH {_V}, {_RET}, rd AS (SELECT a.patient_id || '_' || a.sample_idx AS sample_id, b.sample_idx AS visit_idx, b.conditions, b.procedures, b.drugs FROM r a JOIN r b ON a.patient_id = b.patient_id AND b.sample_idx <= a.sample_idx),
it AS ({_ITEMS}), sn AS (SELECT *, row_number() OVER (PARTITION BY sample_id, kind, name ORDER BY visit_idx, pos) AS k FROM it),
ls AS (SELECT sample_id, visit_idx, kind, string_agg((pos + 1) || '. ' || lower(name) || CASE WHEN k > 1 THEN ' (continued from previous visit)' WHEN visit_idx > 0 THEN ' (new)' ELSE '' END, chr(10) ORDER BY pos) AS lines FROM sn GROUP BY ALL),
vt AS (SELECT sample_id, visit_idx, 'Visit ' || visit_idx || ':' || chr(10) || {" || chr(10) || ".join(_PART(k) for k in context.HEADINGS)} AS t FROM ls GROUP BY sample_id, visit_idx),
tx AS (SELECT sample_id, string_agg(t, chr(10) || chr(10) ORDER BY visit_idx) AS t FROM vt GROUP BY 1) SELECT sample_id, md5(t) AS digest, length(t)::INT AS n FROM tx""",
    "concept_filter": "WITH c AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN concat_ws(';', p_type, p_brand, p_name) ELSE p_brand END AS concept FROM part), v AS (SELECT p_brand AS node FROM part UNION SELECT p_name FROM part) SELECT p_partkey, concept, node FROM c JOIN v ON concept = node UNION ALL SELECT p_partkey, concept, node FROM (SELECT p_partkey, concept, unnest(string_split(concept, ';')) AS part FROM c WHERE concept NOT IN (SELECT node FROM v)) q JOIN v ON part = node",
    "patient_nodes": f"WITH {_G} SELECT * FROM pn",
    "truncated_texts": "SELECT doc_id, md5(left(text, 30000)) AS digest FROM documents",
    "base_parts": "SELECT doc_id, md5(split_part(split_part(text || 'Summary: of ' || source || chr(10) || chr(10) || 'Supplementary Information: ' || lang, chr(10) || chr(10) || 'Supplementary Information:', 1), 'Summary:', 1)) AS digest FROM documents",
    "similar_patients": f"""WITH {_DOTS}, j AS (SELECT *, ql = il AS same, row_number() OVER (PARTITION BY query ORDER BY rank) AS r FROM rk WHERE rank <= 100 AND query // 2 <> item // 2),
j2 AS (SELECT *, row_number() OVER (PARTITION BY query, same ORDER BY rank) AS r2 FROM j WHERE r <= 50),
t AS (SELECT query, same, string_agg('context ' || item || chr(10) || chr(10) || 'Label:' || chr(10) || il || chr(10) || chr(10), '|' ORDER BY r2) AS t FROM j2 WHERE r2 <= 2 GROUP BY ALL)
SELECT id, coalesce(p.t, 'None') AS positive, coalesce(n.t, 'None') AS negative FROM e LEFT JOIN t p ON p.query = id AND p.same LEFT JOIN t n ON n.query = id AND NOT n.same""",
    "similar_patients_full": f"WITH {_DOTS}, j AS (SELECT query AS id, ql = il AS same, item AS neighbour, row_number() OVER (PARTITION BY query, ql = il ORDER BY rank) AS r FROM rk WHERE query // 2 <> item // 2) SELECT id, same, neighbour, r AS rank FROM j WHERE r <= 1",
    "dense_search": f"WITH {_DOTS} SELECT query, item, round(score, 6) AS score, rank FROM rk WHERE rank <= 10",
    "article_lookup": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "document_texts": "SELECT doc_id, md5(CASE WHEN n_chars > 200 AND trim(text) <> '' THEN trim(text) ELSE source END) AS digest FROM documents",
    "training_pairs": "WITH p AS (SELECT DISTINCT o_custkey AS patient, o_orderpriority || '-' || o_orderstatus AS item FROM orders), c AS (SELECT item, row_number() OVER (ORDER BY md5('1:' || item), item) - 1 AS place, count(*) OVER () AS m FROM (SELECT DISTINCT item FROM p)), o AS (SELECT patient, item, (place - ('0x' || left(md5('1:' || patient), 15))::BIGINT % m + m) % m AS k FROM (SELECT DISTINCT patient FROM p) a, c WHERE (patient, item) NOT IN (SELECT (patient, item) FROM p)), n AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY k) AS i FROM o) SELECT patient, item, 1.0::DOUBLE AS label FROM p UNION ALL SELECT patient, item, 0.0::DOUBLE FROM n WHERE i <= 10",
    "keyword_queries": r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 6 AND regexp_full_match(w, '\p{L}+')), ' OR ') AS query FROM documents",
    "one_shot_communities": f"WITH {_SHOT} SELECT sample_id, community, round(score, 6) AS score, rank FROM shot",
    "support_texts": f"WITH {_SHOT} SELECT sample_id, string_agg('Support Info ' || rank || ':' || chr(10) || 'about ' || n_name, chr(10) || chr(10) ORDER BY rank) AS text FROM shot JOIN nation ON n_nationkey = community GROUP BY sample_id",
    "theme_factors": f"WITH {_E}, {_MEANS} SELECT id AS community, round(1 + 0.1::DOUBLE * max(list_inner_product(vec, mean)), 6) AS theme FROM e, mv GROUP BY id",
    "cluster_means": f"WITH {_MEANS} SELECT cluster, pos::INT AS pos, round(x, 6) AS x FROM mn",
    "cluster_representatives": f"WITH {_REP} SELECT cluster, representative FROM rep",
    "cluster_mappings": f"WITH {_REP} SELECT id AS original, representative AS new FROM e JOIN rep ON label = cluster",
    "cluster_silhouette": f"WITH {_E}, m AS (SELECT a.id, a.label AS ca, b.label AS cb, avg(list_distance(a.vec, b.vec)) AS d FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL), s AS (SELECT id, max(d) FILTER (ca = cb) AS a, min(d) FILTER (ca <> cb) AS b FROM m GROUP BY id) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s",
}
