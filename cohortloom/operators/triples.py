"""Triples (head, relation, tail): parsing, combination, per-concept graphs and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Short relation names and what they stand for.
RELATIONS = {"PAR": "parent", "CHD": "child", "RB": "broader", "RN": "narrower", "RO": "related other", "SY": "synonym", "RQ": "possibly synonymous", "AQ": "allowed qualifier", "QB": "qualified by", "SIB": "sibling", "RU": "related", "RL": "similar", "XR": "not related", "DEL": "deleted"}


def brackets(text: Column) -> Column:
    """Contents of all [...] of a text that don't run over a line end."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\n]*?)\]"), F.lit(1))


def _parts(text: Column, sign: str, clean) -> Column:
    """Array of structs of the brackets that have exactly three parts."""
    split = F.filter(F.transform(brackets(text), lambda b: F.split(b, sign)), lambda p: F.size(p) == 3)
    return F.transform(split, lambda p: F.struct(clean(p[0], True).alias("head"), clean(p[1], False).alias("relation"), clean(p[2], True).alias("tail")))


def parse_strict(text: Column) -> Column:
    """Parts separated by comma and space; stray brackets are taken off entities, nothing is trimmed."""
    strip = lambda c, entity: F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", "") if entity else c
    return _parts(text, ", ", strip)


def parse_loose(text: Column) -> Column:
    """Parts separated by commas, each trimmed."""
    return _parts(text, ",", lambda c, _: F.trim(c))


def bracket_lines(text: Column) -> Column:
    """Bracket contents as lines with tabs for separators; no check of their number; first copies stay."""
    return F.array_distinct(F.transform(brackets(text), lambda b: F.replace(b, F.lit(", "), F.lit("\t"))))


def provider_triples(sets: DataFrame, concepts: str, provider, task: str = "Triples of: ") -> DataFrame:
    """(head, relation, tail): the different triples that a provider names for each set of concepts; sets on which it fails are passed over."""

    def ask(batches):
        import pandas as pd

        for pdf in batches:
            got = []
            for p in pdf["prompt"]:
                try:
                    got.append(provider(p))
                except Exception:  # noqa: BLE001  a provider's failure drops the set, as documented
                    got.append(None)
            yield pd.DataFrame({"answer": pd.Series(got, dtype=object)})

    prompts = sets.select(F.concat(F.lit(task), F.array_join(concepts, ", ")).alias("prompt")).filter("prompt IS NOT NULL")
    answers = prompts.mapInPandas(ask, "answer string").filter("answer IS NOT NULL")
    return answers.select(F.explode(parse_strict(F.col("answer"))).alias("t")).select("t.*").distinct()


def chunks(text: Column, size: int = 800) -> Column:
    """A text in pieces of size characters; an empty text has none."""
    n = F.length(text)
    first = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(first, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def needs_refill(lines: DataFrame, files: DataFrame, key: str, least: int = 300) -> DataFrame:
    """The files (key) with fewer than least lines, those without any too."""
    n = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))
    return files.select(key).distinct().join(n, key, "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0))).filter(F.col("n_lines") < least)


def attribute(triples: DataFrame, concepts: DataFrame) -> DataFrame:
    """Triples with the concept found in their head or tail: the longest, then the first by name; others are dropped.

    Entities are matched by their distinct values, so the substring join isn't repeated for every triple.
    """
    names = triples.select(F.col("head").alias("e")).union(triples.select(F.col("tail").alias("e"))).distinct()
    inside = names.join(concepts.select("concept").distinct(), F.col("e").contains(F.col("concept")))
    best = inside.groupBy("e").agg(F.max_by("concept", F.struct(F.length("concept"), F.lit(0))).alias("any"), F.min(F.struct((-F.length("concept")).alias("l"), "concept")).alias("best"))
    b = best.select("e", "best")
    h, t = b.withColumnsRenamed({"e": "head", "best": "bh"}), b.withColumnsRenamed({"e": "tail", "best": "bt"})
    return triples.join(h, "head", "left").join(t, "tail", "left").withColumn("concept", F.least("bh", "bt").getField("concept")).filter("concept IS NOT NULL").drop("bh", "bt")


def expand_relation(relation: Column, names: dict[str, str] | None = None) -> Column:
    """A relation's full name; unknown ones stay."""
    known = F.create_map(*[F.lit(x) for kv in (names or RELATIONS).items() for x in kv])
    return F.coalesce(F.try_element_at(known, relation), relation)


def strip_quotes(s: Column) -> Column:
    """If the first or the last character is an apostrophe both end characters go."""
    return F.when(s.startswith("'") | s.endswith("'"), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def strip_double_quotes(s: Column) -> Column:
    """Double quotes go if they are at both ends."""
    return F.when(s.startswith('"') & s.endswith('"') & (F.length(s) > 1), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def combine(sources: dict[str, DataFrame], abbreviated: str) -> DataFrame:
    """All sources' triples as a bag; relations of the abbreviated source are expanded, apostrophes stripped, lower case."""
    out = None
    for name, d in sources.items():
        d = d.select("head", (expand_relation(F.col("relation")) if name == abbreviated else F.col("relation")).alias("relation"), "tail", F.lit(name).alias("source"))
        out = d if out is None else out.unionByName(d)
    return out.withColumns({c: F.lower(strip_quotes(F.col(c))) for c in ("head", "relation", "tail")})


def combine_distinct(sources: dict[str, DataFrame]) -> DataFrame:
    """Distinct triples after expansion, with their sources; lower case comes after, so copies can be left."""
    out = None
    for name, d in sources.items():
        d = d.select("head", expand_relation(F.col("relation")).alias("relation"), "tail", F.lit(name).alias("source"))
        out = d if out is None else out.unionByName(d)
    got = out.groupBy("head", "relation", "tail").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return got.withColumns({c: F.lower(c) for c in ("head", "relation", "tail")})


def first_hop(triples: DataFrame, concepts: DataFrame) -> DataFrame:
    """Triples that have a concept (any case) as head or tail, with that concept."""
    c = concepts.select("concept", F.lower("concept").alias("key"))
    t = triples.withColumns({"h": F.lower("head"), "t": F.lower("tail")})
    by_head = t.join(c, t.h == c.key).select("concept", "head", "relation", "tail")
    by_tail = t.filter("h <> t").join(c, F.col("t") == F.col("key")).select("concept", "head", "relation", "tail")
    return by_head.unionByName(by_tail)


def second_hop(triples: DataFrame, concepts: DataFrame, k: int = 3) -> DataFrame:
    """Each concept's k triples of the highest score (concept, head, relation, tail, score): the sum over both ends of how
    often the end is a neighbour in the first hop; the concept itself doesn't count. Ties by text, descending."""
    hop = first_hop(triples, concepts)
    ends = hop.select("concept", F.explode(F.array(F.lower("head"), F.lower("tail"))).alias("e")).filter(F.col("e") != F.lower("concept"))
    freq = ends.groupBy("concept", "e").agg(F.count(F.lit(1)).alias("f"))
    t = triples.select("head", "relation", "tail").withColumn("tid", F.struct("head", "relation", "tail"))
    sides = t.select("tid", F.explode(F.array(F.lower("head"), F.lower("tail"))).alias("e"))
    score = sides.join(freq, "e").groupBy("concept", "tid").agg(F.sum("f").alias("score"))
    text = F.concat_ws("\t", "tid.head", "tid.relation", "tid.tail")
    w = Window.partitionBy("concept").orderBy(F.desc("score"), F.desc("text"))
    return score.withColumn("text", text).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).select("concept", "tid.*", "score")


def concept_graph(concepts: DataFrame, exact_a: DataFrame, general: DataFrame, exact_b: DataFrame, k: int = 3) -> DataFrame:
    """A concept's triples: both exact sources' (concept, triple), the general source's first hop and its top second hop; a bag."""
    cols = ["concept", "head", "relation", "tail"]
    own = lambda d, n: d.join(concepts.select("concept").distinct(), "concept").select(*cols, F.lit(n).alias("part"))
    return own(exact_a, "exact a").unionByName(first_hop(general, concepts).select(*cols, F.lit("hop 1").alias("part"))).unionByName(second_hop(general, concepts, k).select(*cols, F.lit("hop 2").alias("part"))).unionByName(own(exact_b, "exact b"))


def systematic_sample(rows: DataFrame, order: str, every: int = 6) -> DataFrame:
    """The first of every so many rows in order; ranks are made by ranges of order, not in one task."""
    from .tables import materialize

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = materialize(rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(order))).join(F.broadcast(before), "__part")
    return r.filter((F.col("__before") + F.col("__r") - 1) % every == 0).select(*rows.columns)


def entities(triples: DataFrame) -> DataFrame:
    """Distinct heads and tails (entity)."""
    return triples.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


def relations(triples: DataFrame) -> DataFrame:
    """Distinct relations."""
    return triples.select("relation").distinct()


def rewrite(triples: DataFrame, entity_map: DataFrame, relation_map: DataFrame) -> DataFrame:
    """Distinct triples with entities and relations replaced (maps: original, new); unmapped ones stay."""
    clean = triples.select(*[strip_double_quotes(F.col(c)).alias(c) for c in ("head", "relation", "tail")])
    for c, m in (("head", entity_map), ("tail", entity_map), ("relation", relation_map)):
        clean = clean.join(m.select(F.col("original").alias(c), F.col("new").alias(f"new_{c}")), c, "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
    return clean.select("head", "relation", "tail").distinct()


def preferred_term(terms: DataFrame, concept_names: DataFrame, related_names: DataFrame) -> DataFrame:
    """(cui, term): a related name, else the concept's name, else the first term (ord) in plain English letters, else none."""
    english = F.col("term").rlike(r"^[\x20-\x7e]+$") & F.col("term").rlike("(?i)[aeiouy]")
    first = terms.filter(english).groupBy("cui").agg(F.min_by("term", "ord").alias("t3"))
    a = related_names.groupBy("cui").agg(F.min("name").alias("t1"))
    b = concept_names.groupBy("cui").agg(F.min("name").alias("t2"))
    all_cui = terms.select("cui").union(a.select("cui")).union(b.select("cui")).distinct()
    return all_cui.join(a, "cui", "left").join(b, "cui", "left").join(first, "cui", "left").select("cui", F.coalesce("t1", "t2", "t3").alias("term")).filter("term IS NOT NULL")
