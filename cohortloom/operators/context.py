"""Patient contexts as text, and the concept nodes of patients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

HEADINGS = {"conditions": "Conditions", "procedures": "Procedures", "drugs": "Medications"}


def items(docs: DataFrame) -> DataFrame:
    """(sample_id, visit_idx, kind, pos, name, seen): long form of visit lists; seen: how often the name came before in its kind, this visit too."""
    out = None
    for k in HEADINGS:
        one = docs.select("sample_id", "visit_idx", F.lit(k).alias("kind"), F.posexplode(k).alias("pos", "name"))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("sample_id", "kind", "name").orderBy("visit_idx", "pos")
    return out.withColumn("seen", F.row_number().over(w) - 1)


def contexts(docs: DataFrame) -> DataFrame:
    """(sample_id, text): numbered lists by visit; what was seen before is marked as continued, what first comes after visit 0 as new."""
    v = _visit_texts(docs)
    return v.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("visit_idx", "text"))).getField("text"), "\n\n").alias("text"))


def rolling_contexts(samples: DataFrame) -> DataFrame:
    """(sample_id, text): contexts() of rolling documents. A visit's text depends on earlier visits only, so each is made once and
    a sample has those of its patient up to its own. samples: patient_id, sample_idx, lists."""
    own = samples.withColumnsRenamed({"patient_id": "sample_id", "sample_idx": "visit_idx"})
    v = own.select("sample_id", "visit_idx").join(_visit_texts(own), ["sample_id", "visit_idx"], "left")
    w = Window.partitionBy("sample_id").orderBy("visit_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = v.select(F.concat_ws("_", "sample_id", "visit_idx").alias("sample_id"), F.collect_list("text").over(w).alias("texts"))
    return so_far.filter(F.size("texts") > 0).select("sample_id", F.array_join("texts", "\n\n").alias("text"))


def _visit_texts(docs: DataFrame) -> DataFrame:
    """(sample_id, visit_idx, text) of visits that have an item."""
    mark = F.when(F.col("seen") > 0, " (continued from previous visit)").when(F.col("visit_idx") > 0, " (new)").otherwise("")
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), F.lower("name"), mark)
    rows = items(docs).select("sample_id", "visit_idx", "kind", "pos", line.alias("line"))
    lists = rows.groupBy("sample_id", "visit_idx", "kind").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line"))).getField("line"), "\n").alias("lines"))
    by_visit = lists.groupBy("sample_id", "visit_idx").agg(F.map_from_entries(F.collect_list(F.struct("kind", "lines"))).alias("m"))
    part = lambda k: F.concat(F.lit(HEADINGS[k] + ":\n"), F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")))
    text = F.concat_ws("\n", F.concat(F.lit("Visit "), "visit_idx", F.lit(":")), *[part(k) for k in HEADINGS])
    return by_visit.select("sample_id", "visit_idx", text.alias("text"))


def concept_filter(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(…, concept, node) of rows (…, concept): the concept if the vocabulary (node) has it, else those of its parts between semicolons, untrimmed, that it has."""
    v = vocabulary.select("node").distinct()
    whole = rows.join(v, rows["concept"] == v["node"])
    rest = rows.join(v, rows["concept"] == v["node"], "left_anti").withColumn("part", F.explode(F.split("concept", ";")))
    parts = rest.join(v, F.col("part") == F.col("node")).drop("part")
    return whole.unionByName(parts)


def profiles(concepts: DataFrame, graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((sample_id, profile), (profile, kind, node)): samples of the same concepts have the same nodes and one profile."""
    sets = concepts.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.struct("node"))).alias("own")).withColumn("profile", F.sha2(F.to_json("own"), 256))
    direct = sets.select("profile", "own").distinct().select("profile", F.explode("own.node").alias("node"))
    n = graphs.select("concept", F.explode(F.array("head", "tail")).alias("node")).filter("node <> concept").distinct()
    indirect = direct.withColumnRenamed("node", "concept").join(n, "concept").select("profile", F.lit("indirect").alias("kind"), "node").distinct()
    return sets.select("sample_id", "profile"), direct.select("profile", F.lit("direct").alias("kind"), "node").unionByName(indirect)


def patient_nodes(concepts: DataFrame, graphs: DataFrame, parts: int = 64) -> DataFrame:
    """(sample_id, kind, node): direct nodes are the mapped concepts, indirect ones the other nodes of the concepts' graphs (concept, head, tail).

    A profile's nodes are made distinct once and sent in lists to each of the parts of its samples, where they are listed for each
    sample: no row of the result is shuffled, and a profile of many samples is dealt with in as many tasks as it has parts.
    """
    of, nodes = profiles(concepts, graphs)
    of = of.withColumn("part", F.pmod(F.xxhash64("sample_id"), F.lit(parts)))
    lists = nodes.groupBy("profile", F.pmod(F.xxhash64("node"), F.lit(parts)).alias("k")).agg(F.collect_list(F.struct("kind", "node")).alias("x")).drop("k")
    there = of.select("profile", "part").distinct().join(lists, "profile")
    return of.join(there, ["profile", "part"]).select("sample_id", F.explode("x").alias("x")).select("sample_id", "x.kind", "x.node")


def truncated(text: Column, most: int = 30000) -> Column:
    """The first characters of a text that a provider takes."""
    return F.left(text, F.lit(most))


def base_part(text: Column) -> Column:
    """A context without its supplement and summary."""
    return F.substring_index(F.substring_index(text, "\n\nSupplementary Information:", 1), "Summary:", 1)
