"""Graph operators on edge tables (head, relation, tail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import materialize, release


def subgraph(edges: DataFrame, roots: DataFrame, depth: int = 1, inverse: bool = False) -> DataFrame:
    """(root, head, relation, tail, level): edges of all nodes within depth of a root (so depth + 1 layers), each node once.

    inverse: edges count from both of their ends.
    """
    spark = edges.sparkSession
    e = edges.select("head", "relation", "tail", F.col("head").alias("at"), F.col("tail").alias("to"))
    if inverse:
        e = e.unionByName(edges.select("head", "relation", "tail", F.col("tail").alias("at"), F.col("head").alias("to")))
    front = roots.select(F.col("root"), F.col("root").alias("at")).distinct()
    seen, old = materialize(front, "seen")
    front = seen
    out, paths = None, [old]
    for level in range(depth + 1):
        layer = front.join(e, "at").withColumn("level", F.lit(level))
        layer, p = materialize(layer, "layer")
        paths.append(p)
        out = layer if out is None else out.unionByName(layer)
        if level < depth:
            front = layer.select("root", F.col("to").alias("at")).distinct().join(seen, ["root", "at"], "left_anti")
            front, p = materialize(front, "front")
            paths.append(p)
            seen = seen.unionByName(front)
    got, _ = materialize(out.groupBy("root", "head", "relation", "tail").agg(F.min("level").alias("level")), "subgraph")
    release(spark, *paths)
    return got


def sample_edges(edges: DataFrame, root: str = "root", most: int = 200, seed: int = 1) -> DataFrame:
    """At most so many edges of each root, in the order of a seeded md5; all if there are fewer."""
    h = F.md5(F.concat_ws("\t", F.lit(str(seed)), "head", "relation", "tail"))
    w = Window.partitionBy(root).orderBy("h", "head", "relation", "tail")
    return edges.withColumn("h", h).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most).drop("h", "i")


def _extend(front: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths longer by an edge, without returning to a node."""
    step = front.join(edges, front.at == edges["head"])
    nodes = F.transform(F.sequence(F.lit(0), F.size("path") - 1, F.lit(2)), lambda i: F.col("path")[i])
    return step.filter(~F.array_contains(nodes, F.col("tail"))).select("start", F.col("tail").alias("at"), F.concat("path", F.array("relation", "tail")).alias("path"))


def _shortest(paths: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("start", "end").orderBy(F.size("path"), F.array_join("path", "\t"))
    return paths.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most).drop("i")


def paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 3, most: int = 10, most_nodes: int | None = None) -> DataFrame:
    """(start, end, path): the most shortest simple directed paths of pairs (start, end); a path alternates nodes and relations.

    most_nodes bounds the open paths of a start at each step, by their text, where a bounded search is wanted.
    """
    e, _ = materialize(edges.select("head", "relation", "tail").distinct(), "edges")
    front = pairs.select("start").distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"))
    found = None
    for _ in range(max_hops):
        front, _p = materialize(_extend(front, e), "paths")
        if most_nodes:
            w = Window.partitionBy("start").orderBy(F.array_join("path", "\t"))
            front = front.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most_nodes).drop("i")
        hit = front.withColumnRenamed("at", "end").join(pairs.select("start", "end").distinct(), ["start", "end"])
        found = hit if found is None else found.unionByName(hit)
    return _shortest(found, most)


def paths_from_both_ends(edges: DataFrame, pairs: DataFrame, max_hops: int = 4, most: int = 10, outgoing_back: bool = False) -> DataFrame:
    """paths() by two searches of half the length that meet: at any length, each path once.

    outgoing_back: the search from the end follows outgoing edges too, so a path's second half runs against them.
    """
    e, _ = materialize(edges.select("head", "relation", "tail").distinct(), "edges")
    rev = e if outgoing_back else e.select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"))
    up, down = (max_hops + 1) // 2, max_hops // 2
    first = lambda c: pairs.select(F.col(c).alias("start")).distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"))
    a = [first("start")]
    for _ in range(up):
        a.append(materialize(_extend(a[-1], e), "forward")[0])
    b = [first("end")]
    for _ in range(down):
        b.append(materialize(_extend(b[-1], rev), "backward")[0])
    found = None
    ends = pairs.select("start", "end").distinct()
    for n in range(1, max_hops + 1):  # of n edges, the first half from the start
        i, j = (n + 1) // 2, n // 2
        right = b[j].select(F.col("start").alias("end"), F.col("at"), F.slice(F.reverse("path"), 2, F.greatest(F.size("path") - 1, F.lit(1))).alias("rest"), F.size("path").alias("k"))
        right = right.withColumn("rest", F.when(F.col("k") > 1, F.col("rest")).otherwise(F.array().cast("array<string>")))
        met = a[i].join(ends, "start").join(right, ["end", "at"])
        path = F.concat("path", "rest")
        nodes = F.transform(F.sequence(F.lit(0), F.size(path) - 1, F.lit(2)), lambda x: F.element_at(path, x + 1))
        hit = met.filter(F.size(F.array_distinct(nodes)) == F.size(nodes)).select("start", "end", path.alias("path"))
        found = hit if found is None else found.unionByName(hit)
    return _shortest(found.distinct(), most)


def path_triples(found: DataFrame) -> DataFrame:
    """Distinct (start, head, relation, tail) of paths."""
    i = F.sequence(F.lit(1), F.size("path") - 2, F.lit(2))
    t = F.transform(i, lambda k: F.struct(F.element_at("path", k).alias("head"), F.element_at("path", k + 1).alias("relation"), F.element_at("path", k + 2).alias("tail")))
    return found.filter(F.size("path") > 2).select("start", F.explode(t).alias("t")).select("start", "t.*").distinct()


def path_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Paths as text, nodes by their term (node, term) if they have one."""
    p = found.withColumn("pid", F.struct("start", "end", F.array_join("path", "\t").alias("t")))
    x = p.select("pid", F.posexplode("path").alias("pos", "item")).join(terms.select(F.col("node").alias("item"), "term"), "item", "left")
    name = F.when(F.col("pos") % 2 == 0, F.coalesce("term", "item")).otherwise(F.col("item"))
    got = x.groupBy("pid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", name.alias("n")))).getField("n"), " -> ").alias("text"))
    return got.select("pid.start", "pid.end", "text")


def undirected(triples: DataFrame, order: str = "ord") -> DataFrame:
    """Canonical edges (u, v, relation), u <= v; the last relation in order wins for both directions."""
    return triples.groupBy(F.least("head", "tail").alias("u"), F.greatest("head", "tail").alias("v")).agg(F.max_by("relation", F.struct(order, "relation")).alias("relation"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (u, v): least labels with jumps, a table each round."""
    spark = edges.sparkSession
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u")).distinct()
    both, bp = materialize(both, "both")
    labels, path = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        now = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        up = labels.select(F.col("node").alias("now"), F.col("component").alias("up"))
        new, p = materialize(now.join(up, "now", "left").select("node", "was", F.least("now", F.coalesce("up", "now")).alias("component")), "labels")
        done = new.filter("component <> was").isEmpty()
        release(spark, path)
        labels, path = new.select("node", "component"), p
        if done:
            release(spark, bp)
            return labels


def community_triples(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (u, v, relation) with both ends in one community (run, level, community, node)."""
    key = ["run", "level", "community"]
    m = members.select(*key, "node")
    a = edges.join(m.withColumnRenamed("node", "u"), "u")
    return a.join(m.withColumnRenamed("node", "v"), [*key, "v"]).select(*key, "u", "relation", "v")


def distinct_communities(triples: DataFrame) -> DataFrame:
    """(run, level, community, n_triples, digest): of communities with equal triple sets the first by run, level and name."""
    key = ["run", "level", "community"]
    text = F.array_join(F.array_sort(F.array("u", "relation", "v")), "\t")
    g = triples.withColumn("text", text).groupBy(*key).agg(F.md5(F.array_join(F.array_sort(F.collect_set("text")), "\n")).alias("digest"), F.count(F.lit(1)).alias("n_triples"))
    w = Window.partitionBy("digest").orderBy(*key)
    return g.withColumn("i", F.row_number().over(w)).filter("i = 1").drop("i")


def related_pairs(concepts: DataFrame, related: DataFrame, ids: DataFrame) -> DataFrame:
    """(concept, start, end) from related concept pairs (concept, partner) and first ids (kind, concept, cui, ord); pairs without an id for both go."""
    first = ids.groupBy("concept").agg(F.min_by("cui", "ord").alias("cui"))
    c = concepts.join(first.withColumnRenamed("cui", "start"), "concept")
    r = related.join(first.select(F.col("concept").alias("partner"), F.col("cui").alias("end")), "partner")
    return c.join(r, "concept").select("concept", "start", "end").distinct()
