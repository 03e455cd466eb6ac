"""Samples from patient visits: labels from the next visit, histories, cohorts and splits.

All functions take visits with code lists (``sources.clinical.visit_lists``). Every window is over one patient; its rows
are shuffled by patient once and that partitioning serves all further windows of a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

LISTS = ("conditions", "procedures", "drugs")


def by_time():
    """A patient's visits in order of time."""
    return Window.partitionBy("patient_id").orderBy("visit_ts", "visit_key")


def full_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days between two times, rounded down, as timedelta.days has them."""
    a, b = later.cast("timestamp_ntz"), earlier.cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", b, a)
    return F.floor(micros / F.lit(86400000000)).cast("int")


def complete() -> Column:
    """All three code lists have entries."""
    return (F.size("conditions") > 0) & (F.size("procedures") > 0) & (F.size("drugs") > 0)


def next_visit_mortality(visits: DataFrame) -> DataFrame:
    """All but a patient's last visit; label: the next visit's discharge status if it is 1, else 0."""
    nxt = visits.withColumns({"next_id": F.lead("visit_id").over(by_time()), "next_status": F.lead("discharge_status").over(by_time())})
    label = F.when(F.col("next_status").isin(0, 1), F.col("next_status")).otherwise(0)
    return nxt.filter(F.col("next_id").isNotNull() & complete()).withColumn("label", label).drop("next_id", "next_status")


def readmission(visits: DataFrame, time_window: int = 15) -> DataFrame:
    """All but a patient's last visit; label 1 if the next one begins within fewer than time_window full days."""
    nxt = visits.withColumn("next_ts", F.lead("visit_ts").over(by_time())).withColumn("next_id", F.lead("visit_id").over(by_time()))
    label = F.when(full_days(F.col("next_ts"), F.col("visit_ts")) < time_window, 1).otherwise(0)
    return nxt.filter(F.col("next_id").isNotNull() & complete()).withColumn("label", label).drop("next_ts", "next_id")


def los_category(days: Column) -> Column:
    """Length of stay in ten classes: under a day, each of seven days, the second week, longer."""
    return F.when(days < 1, 0).when(days <= 7, days).when(days <= 14, 8).otherwise(9)


def length_of_stay(visits: DataFrame) -> DataFrame:
    """Every visit with its stay's class."""
    return visits.filter(complete()).withColumn("label", los_category(full_days(F.col("discharge_ts"), F.col("visit_ts"))))


def retained(visits: DataFrame) -> DataFrame:
    """Visits with all lists, numbered from 0 in each patient's order as sample_idx."""
    return visits.filter(complete()).withColumn("sample_idx", F.row_number().over(by_time()) - 1)


def cumulative(visits: DataFrame, columns=LISTS) -> DataFrame:
    """Retained visits with hist_* columns: the lists of all visits up to this one, in order."""
    w = Window.partitionBy("patient_id").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return retained(visits).withColumns({f"hist_{c}": F.collect_list(c).over(w) for c in columns})


def drug_history(visits: DataFrame, code_length: int | None = None, least_visits: int = 1) -> DataFrame:
    """Drug recommendation samples: this visit's drugs with all histories; codes cut to code_length (copies stay)."""
    if code_length:
        visits = visits.withColumn("drugs", F.transform("drugs", lambda d: F.substring(d, 1, code_length)))
    out = cumulative(visits).withColumn("n_visits", F.count(F.lit(1)).over(Window.partitionBy("patient_id")))
    return out.filter(F.col("n_visits") >= least_visits).drop("n_visits")


def onset_mortality(visits: DataFrame, codes: list[str]) -> DataFrame:
    """next_visit_mortality() of patients who ever had one of codes; others have one sentinel row of label 1000 from their first visit."""
    has = F.exists("conditions", lambda c: c.isin(codes))
    flagged = visits.withColumn("ever", F.bool_or(has).over(Window.partitionBy("patient_id")))
    inside = next_visit_mortality(flagged.filter("ever")).drop("ever")
    first = flagged.filter("NOT ever").withColumn("i", F.row_number().over(by_time())).filter("i = 1").drop("i", "ever")
    sentinel = first.withColumns({"visit_id": F.lit("None"), "label": F.lit(1000)})
    return inside.unionByName(sentinel)


def onset(visits: DataFrame, codes: list[str], most_negative: int = 5) -> DataFrame:
    """Positives: all visits before the first with one of codes. Negatives: of patients without, the first
    min(most_negative, n - 1) visits, then only those with all lists."""
    has = F.exists("conditions", lambda c: c.isin(codes))
    by_patient = Window.partitionBy("patient_id")
    i = visits.withColumn("idx", F.row_number().over(by_time()) - 1)
    i = i.withColumns({"onset": F.min(F.when(has, F.col("idx"))).over(by_patient), "n": F.count(F.lit(1)).over(by_patient)})
    positive = F.col("onset").isNotNull() & (F.col("idx") < F.col("onset"))
    negative = F.col("onset").isNull() & (F.col("idx") < F.least(F.lit(most_negative), F.col("n") - 1)) & complete()
    return i.filter(positive | negative).withColumn("label", F.when(F.col("onset").isNull(), 0).otherwise(1)).drop("idx", "onset", "n")


def rolling_docs(samples: DataFrame) -> DataFrame:
    """For retained sample i of a patient the visits 0 to i: (sample_id, sample_idx, visit_idx, lists, label of sample i).

    samples need sample_idx and label; the range join stays within a patient.
    """
    a = samples.select("patient_id", F.col("sample_idx"), F.concat_ws("_", "patient_id", F.col("sample_idx")).alias("sample_id"), "label")
    b = samples.select(F.col("patient_id").alias("p"), F.col("sample_idx").alias("visit_idx"), *LISTS)
    return a.join(b, (F.col("patient_id") == F.col("p")) & (F.col("visit_idx") <= F.col("sample_idx"))).drop("p")


def map_names(rows: DataFrame, key: list[str], list_col: str, names: DataFrame) -> DataFrame:
    """(key, names): a flat or nested code list as names in order; raises on codes without a name or empty lists."""
    flat = F.flatten(list_col) if "array<array" in dict(rows.dtypes)[list_col] else F.col(list_col)
    items = rows.select(*key, F.posexplode_outer(flat).alias("pos", "code"))
    got = items.join(names.select("code", "name"), "code", "left")
    sure = F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("no name for code "), F.coalesce("code", F.lit("(empty list)"))))).otherwise(F.col("name"))
    return got.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", sure.alias("name")))).getField("name").alias("names"))


def balanced_cohort(samples: DataFrame, most_visits: int = 9, most_positive: int = 5000, most: int = 10000) -> DataFrame:
    """(patient_id, sample_id, label): the first eligible positive sample of each patient up to most_positive, then the first
    eligible negative one of patients not yet taken, up to most in all. Order: ord, the samples' input order."""
    ok = samples.filter(F.col("sample_idx") + 1 <= most_visits)
    first = lambda d: d.withColumn("i", F.row_number().over(Window.partitionBy("patient_id").orderBy("ord"))).filter("i = 1").drop("i")
    pos = first(ok.filter("label = 1")).orderBy("ord").limit(most_positive)
    neg = first(ok.filter("label = 0")).join(pos.select("patient_id"), "patient_id", "left_anti")
    left = F.lit(most) - pos.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    # a limit that depends on data: rank within the most rows that can be taken at all
    ranked = neg.orderBy("ord").limit(most).withColumn("i", F.row_number().over(Window.orderBy("ord"))).filter(F.col("i") <= left).drop("i")
    out = ["patient_id", "sample_id", "label"]
    return pos.select(*out).unionByName(ranked.select(*out))


def restrict(samples: DataFrame, patients: DataFrame) -> DataFrame:
    """Samples of the chosen patients."""
    return samples.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")


def split(ids: DataFrame, column: str, ratios=(0.8, 0.1, 0.1), seed: int = 528, train_ratio: float = 1.0) -> DataFrame:
    """(column, split) of the distinct ids in the order of md5(seed:id), cut at floor(n * ratio) bounds; train may be cut to train_ratio of it.

    The ranks of all ids are made in two steps, by range of md5 and within a range, so no task orders all of them.
    """
    d = ids.select(F.col(column).cast("string").alias("id")).distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "id")))
    d = d.withColumn("part", F.substring("h", 1, 3))
    w = Window.partitionBy("part").orderBy("h", "id")
    sizes = d.groupBy("part").agg(F.count(F.lit(1)).alias("n_part"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("n_part").alias("n"))
    ranked = d.withColumn("r", F.row_number().over(w)).join(F.broadcast(before), "part").crossJoin(F.broadcast(total)).withColumn("rank", F.col("before") + F.col("r") - 1)
    n = F.col("n")
    first, second = F.floor(n * ratios[0]), F.floor(n * (ratios[0] + ratios[1]))
    where = F.when(F.col("rank") < F.floor(first * train_ratio), "train").when(F.col("rank") < first, None).when(F.col("rank") < second, "val").otherwise("test")
    return ranked.select(F.col("id").alias(column), where.alias("split")).filter("split IS NOT NULL")
