"""Prompts, training examples and predictor rounds. Texts are our own; what goes where is the operators' behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .providers import complete, stub

TASKS = {"mortality": "Will the patient die during the next visit? Answer 1 for yes, 0 for no.", "readmission": "Will the patient be back within 15 days? Answer 1 for yes, 0 for no."}
CONFIDENCE = "\n# Confidence #\n"
REASONING = "# Reasoning Chain #\n"
PREDICTION = "\n# Prediction #\n"


def section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"# {title} #\n"), F.coalesce(body, F.lit("")), F.lit("\n\n"))


def reasoning_prompt(task: str, context: Column, label: Column, similar: Column | None = None, knowledge: Column | None = None) -> Column:
    """Asks for the steps that lead to a known label; without similar patients and knowledge it is the plain variant."""
    parts = [F.lit(f"Explain step by step why the answer is right.\n{TASKS[task]}\n\n"), section("Patient", context)]
    parts += [section("Similar Patients", similar)] if similar is not None else []
    parts += [section("Knowledge", knowledge)] if knowledge is not None else []
    return F.concat(*parts, section("Answer", label.cast("string")), F.lit("End with how confident you are under # Confidence #."))


def knowledge_prompt(task: str, context: Column) -> Column:
    """Asks for ten pieces of knowledge, without the label."""
    return F.concat(F.lit(f"List ten facts that help to decide.\n{TASKS[task]}\n\n"), section("Patient", context))


def numbered(items: Column, n: int = 10) -> Column:
    """The first n items as numbered lines; raises if there are fewer."""
    sure = F.when(F.size(items) >= n, F.slice(items, 1, n)).otherwise(F.raise_error(F.lit(f"fewer than {n} items")))
    return F.array_join(F.transform(sure, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def zero_shot(task: str, context: Column, support: Column | None = None) -> Column:
    """Asks for reasoning and a prediction; with support texts in the augmented and retrieval variants."""
    parts = [F.lit(f"{TASKS[task]}\nWrite your reasoning, then the label under # Prediction #.\n\n"), section("Patient", context)]
    return F.concat(*parts, *([section("Support", support)] if support is not None else []))


def few_shot(task: str, context: Column, examples: Column, support: Column | None = None) -> Column:
    """zero_shot() with solved patients (an array of texts) in front."""
    return F.concat(section("Examples", F.array_join(examples, "\n")), zero_shot(task, context, support))


def example_texts(task: str, context: Column, reasoning: Column, label: Column, similar: Column | None = None, knowledge: Column | None = None) -> list[Column]:
    """[input, output] of a training example: reasoning, then the label."""
    src = [F.lit(TASKS[task] + "\n\n"), section("Patient", context)]
    src += [section("Similar Patients", F.array_join(F.array_sort(similar), "\n"))] if similar is not None else []
    src += [section("Knowledge", knowledge)] if knowledge is not None else []
    return [F.concat(*src).alias("input"), F.concat(F.lit(REASONING), reasoning, F.lit(PREDICTION), label.cast("string")).alias("output")]


def direct_example(task: str, context: Column, label: Column) -> list[Column]:
    """[input, output]: the label alone."""
    return [F.concat(F.lit(TASKS[task] + "\n\n"), section("Patient", context)).alias("input"), label.cast("string").alias("output")]


def label_first(reasoning: Column, label: Column, times: int = 8) -> Column:
    """The label repeated on lines ahead of the reasoning."""
    return F.concat(F.array_join(F.array_repeat(label.cast("string"), times), "\n"), F.lit("\n"), reasoning)


def confident(rows: DataFrame, text: str = "reasoning", split: str = "split") -> DataFrame:
    """rows without those of train and val that say they aren't confident; "Very Not Confident" stays."""
    low = F.contains(F.col(text), F.lit(CONFIDENCE + "Not Confident"))
    return rows.filter(~(F.col(split).isin("train", "val") & F.coalesce(low, F.lit(False))))


def without_tail(text: Column) -> Column:
    """Reasoning without its confidence part and heading."""
    return F.replace(F.substring_index(text, CONFIDENCE, 1), F.lit(REASONING), F.lit(""))


def files(rows: DataFrame) -> dict[str, DataFrame]:
    """The rows of each file: train holds train and val, val and test their own."""
    return {"train": rows.filter(F.col("split").isin("train", "val")), "val": rows.filter("split = 'val'"), "test": rows.filter("split = 'test'")}


def references(rows: DataFrame) -> DataFrame:
    """All reference rounds (ref_id) for train, round 0 only elsewhere."""
    return rows.filter((F.col("split") == "train") | (F.col("ref_id") == 0))


def multitask(rows: DataFrame, instruction: str, label_instruction: str) -> dict[str, DataFrame]:
    """train: label rows (changed instruction, the output's last character) and reasoning rows; test: label rows."""
    label = rows.withColumns({"input": F.replace("input", F.lit(instruction), F.lit(label_instruction)), "output": F.right("output", F.lit(1))})
    train = F.col("split") != "test"
    return {"train": label.filter(train).unionByName(rows.filter(train)), "test": label.filter(~train)}


def consolidate(rows: DataFrame, group: str, text: str, provider=stub, whole: int = 10, chunk: int = 5) -> DataFrame:
    """(group, text): texts of a group become one by calls on whole texts or fewer, else first on chunks, again and again."""
    from pyspark.sql import Window

    from .tables import materialize

    level, _ = materialize(rows.select(group, F.col(text).alias("t"), F.row_number().over(Window.partitionBy(group).orderBy(text)).alias("i")), "texts")
    while True:
        sized = level.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
        part = F.when(F.col("n") <= whole, F.lit(0)).otherwise(F.floor((F.col("i") - 1) / chunk))
        joined = sized.withColumn("part", part).groupBy(group, "part", "n").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "t"))).getField("t"), "\n").alias("p"))
        told, _ = materialize(complete(joined, "p", provider, "t", keep_prompt=False).select(group, "t", (F.col("part") + 1).cast("int").alias("i"), "n"), "texts")
        if told.filter(F.col("n") > whole).isEmpty():
            return told.select(group, F.col("t").alias("text"))
        level = told.drop("n")


def predictor_rounds(rows: DataFrame, predictor=stub, critic=stub, rounds: int = 4, batch: int = 5) -> DataFrame:
    """(id, round, prediction, wrong): predictions whose last character isn't the label are criticised in batches by id in a round, and
    the critics' joined feedback goes into the next round's prompts. rows: id, prompt, label."""
    from .tables import materialize, numbered

    feedback, out = None, None
    for r in range(rounds):
        p = rows.withColumn("full", F.col("prompt")) if feedback is None else rows.crossJoin(feedback).withColumn("full", F.concat("prompt", F.lit("\n# Feedback #\n"), "feedback"))
        told, _ = materialize(complete(p.select("id", "label", "full"), "full", predictor, "prediction", keep_prompt=False).withColumn("wrong", F.right("prediction", F.lit(1)) != F.col("label").cast("string")).select("id", F.lit(r).alias("round"), "prediction", "wrong"), "round")
        out = told if out is None else out.unionByName(told)
        wrong = numbered(told.filter("wrong"), "place", "id").withColumn("b", F.floor(F.col("place") / batch)).groupBy("b").agg(F.array_join(F.array_sort(F.collect_list("prediction")), "\n").alias("errors"))
        said = complete(wrong, "errors", critic, "f", keep_prompt=False).withColumn("g", F.lit(0))
        feedback = consolidate(said, "g", "f", critic).select(F.col("text").alias("feedback"))
        if feedback.isEmpty():
            feedback = None
    return out
