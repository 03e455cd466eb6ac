"""Training-data operators: chat examples, mixing, decontamination by substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string>"


def chat_examples(rows: DataFrame, source: str = "input", target: str = "output") -> DataFrame:
    """rows with messages: the input as the user's turn, the output as the assistant's."""
    return rows.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col(source).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col(target).alias("content"))))


def seeded_order(key: Column, seed: int = 42) -> Column:
    """A column whose order is a shuffle that depends on the seed only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) of turns (conv_id, turn, role, text)."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def with_system(messages: Column, template: str = "system") -> Column:
    """An empty system message in front if there is none and the template knows of one."""
    if "system" not in template and "<|im_start|>" not in template:
        return messages
    empty = F.array(F.struct(F.lit("system").alias("role"), F.lit("").alias("content")))
    return F.when((F.size(messages) > 0) & (F.element_at(messages, 1)["role"] == "system"), messages).otherwise(F.concat(empty, messages))


def render(messages: Column, generation: bool = False) -> Column:
    """Messages as text: role mark, content and end mark, each turn on its lines; generation: with the assistant's mark at the end."""
    turn = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("</s>\n")))
    return F.concat(F.array_join(turn, ""), F.lit("<|assistant|>\n" if generation else ""))


def preference(chosen: Column, rejected: Column) -> list[Column]:
    """[prompt, chosen, rejected] texts: the last turns differ, all before is the prompt."""
    last = lambda c: F.slice(c, F.size(c), 1)
    return [render(F.slice(chosen, 1, F.greatest(F.size(chosen) - 1, F.lit(0)))).alias("prompt"), render(last(chosen)).alias("chosen_text"), render(last(rejected)).alias("rejected_text")]


def well_formed(messages: Column) -> Column:
    """There are messages, and all have a role and a content."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))


def mix(parts: list[tuple[DataFrame, float]], key: str, columns: list[str], seed: int = 42) -> DataFrame:
    """The first floor(fraction * n) rows by key of each part, its columns only, with their place in a seeded shuffle as shuffle_key."""
    out = None
    for d, fraction in parts:
        if fraction < 0:
            raise ValueError("fractions must not be negative")
        n = d.agg(F.count(F.lit(1)).alias("n")).first()[0]
        # a global first-n: TakeOrdered at small n, a range sort beyond
        part = d.select(key, *columns).orderBy(key).limit(int(fraction * n)) if fraction < 1 else d.select(key, *columns)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("shuffle_key", seeded_order(F.concat_ws("|", key, *columns), seed))


def normalize_space(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def drop_contaminated(rows: DataFrame, key: str, text: str, benchmark: DataFrame, bench_text: str) -> DataFrame:
    """rows whose normalised text holds none of the benchmark's as a substring; rows without a text stay.

    Texts are normalised once. The inner words of an item are whole words of a text that holds it, so items of five words or
    more meet the texts by the hash of their first three inner words and those of three or four by an inner word; only
    items of one or two words are compared with every text.
    """
    b = benchmark.select(normalize_space(F.col(bench_text)).alias("__b")).filter("__b <> ''").distinct().withColumn("__w", F.split("__b", " "))
    of = F.when(F.size("__w") >= 5, 3).when(F.size("__w") >= 3, 1)
    gram = lambda w, at, n: F.xxhash64(F.array_join(F.slice(w, at, n), " "))
    probes = b.select("__b", of.alias("__n"), gram(F.col("__w"), F.lit(2), F.coalesce(of, F.lit(0))).alias("__g"))
    ids = [F.col(key).alias("__id"), F.xxhash64(text).alias("__th")]
    texts = rows.filter(F.col(text).isNotNull()).select(*ids, normalize_space(F.col(text)).alias("__t")).withColumn("__w", F.split("__t", " "))
    have = lambda n: F.when(F.size("__w") >= n, F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: gram(F.col("__w"), i, F.lit(n)))).otherwise(F.array().cast("array<bigint>"))
    met = None
    for n in (3, 1):
        some = texts.select("__id", "__th", "__t", F.explode(F.array_distinct(have(n))).alias("__g")).join(probes.filter(F.col("__n") == n), "__g")
        met = some if met is None else met.unionByName(some)
    held = met.filter(F.contains("__t", F.col("__b"))).select("__id", "__th")
    short = texts.join(probes.filter("__n IS NULL").select("__b"), F.contains("__t", F.col("__b")), "left_semi").select("__id", "__th")
    found = held.unionByName(short).distinct().withColumnsRenamed({"__id": "__fid", "__th": "__fth"})
    return rows.join(found, F.col(key).eqNullSafe(F.col("__fid")) & (F.xxhash64(text) == F.col("__fth")), "left_anti")


def docstring(code: Column) -> Column:
    """What stands between the first pair of three double quotes; null without one."""
    return F.when(F.size(F.split(code, '"""')) >= 3, F.trim(F.split(code, '"""')[1]))


def column_values(rows: DataFrame, column: str, allowed: list[str] | None = None) -> DataFrame:
    """(value): trimmed values that aren't empty, those of the list only if there is one."""
    v = rows.select(F.trim(column).alias("value")).filter("value <> ''")
    return v.filter(F.col("value").isin(allowed)) if allowed else v


