"""Label parsing and classification metrics, all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.tables import materialize


def label_after(text: Column, marker: str) -> Column:
    """The character after the first marker; "0" without one."""
    return F.when(F.contains(text, F.lit(marker)), F.substring(F.split_part(text, F.lit(marker), F.lit(2)), 1, 1)).otherwise("0")


def label_few_shot(text: Column) -> Column:
    return label_after(text, "\n# Prediction #  \n")


def label_dialogue(text: Column) -> Column:
    return label_after(text, "\n# Prediction # \n")


def label_direct(text: Column, truth: Column) -> Column:
    """A text of one character is the label; any other is counted as wrong."""
    return F.when(F.length(text) == 1, text).otherwise(F.when(truth == "1", "0").otherwise("1"))


def label_last(text: Column) -> Column:
    """The first word after the last marker; "0" without one."""
    marker = "\n# Prediction #\n"
    return F.when(F.contains(text, F.lit(marker)), F.substring_index(F.substring_index(text, marker, -1), " ", 1)).otherwise("0")


def rates(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """(sensitivity, specificity) of 0/1 columns; null where a class has no rows."""
    n = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    return df.agg(F.try_divide(n(1, 1), n(1, 1) + n(1, 0)).alias("sensitivity"), F.try_divide(n(0, 0), n(0, 0) + n(0, 1)).alias("specificity"))


def by_class(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """(class, tp, fp, fn, support) of all classes in truth or prediction; rows are first counted by (truth, prediction)."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    x = cells.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("class"), "t", "p", "n")
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    is_t, is_p = F.col("t") == F.col("class"), F.col("p") == F.col("class")
    return x.groupBy("class").agg(s(is_t & is_p).alias("tp"), s(~is_t & is_p).alias("fp"), s(is_t & ~is_p).alias("fn"), s(is_t).alias("support"))


def multiclass(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """(accuracy, f1_macro, f1_weighted, precision_weighted, recall_weighted); 0/0 is 1 in macro, 0 in weighted figures."""
    c = by_class(df, truth, pred)
    div = lambda a, b, z: F.coalesce(F.try_divide(a, b), F.lit(z))
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "support"))
    f1 = lambda z: div(2 * tp, 2 * tp + fp + fn, z)
    return c.agg((F.sum(tp) / F.sum(n)).alias("accuracy"), F.avg(f1(1.0)).alias("f1_macro"), (F.sum(f1(0.0) * n) / F.sum(n)).alias("f1_weighted"), (F.sum(div(tp, tp + fp, 0.0) * n) / F.sum(n)).alias("precision_weighted"), (F.sum(div(tp, n, 0.0) * n) / F.sum(n)).alias("recall_weighted"))


def multilabel(df: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """(accuracy, jaccard_samples, f1_samples, f1_micro, f1_macro) of arrays of labels: accuracy wants equal sets; figures of rows
    without a label on either side are 1 in accuracy and 0 else; labels are those that occur. A null array is empty."""
    none = lambda c: F.coalesce(F.array_distinct(c), F.array().cast(df.schema[truth].dataType))
    x = df.select(none(truth).alias("t"), none(pred).alias("p")).withColumn("both", F.size(F.array_intersect("t", "p")))
    n = F.size("t") + F.size("p")
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by_row = x.agg(F.avg(((F.col("both") == F.size("t")) & (F.col("both") == F.size("p"))).cast("int")).alias("accuracy"), F.avg(div(F.col("both"), n - F.col("both"))).alias("jaccard_samples"), F.avg(div(2 * F.col("both"), n)).alias("f1_samples"), F.try_divide(2 * F.sum("both"), F.sum(n)).alias("f1_micro"))
    each = x.select(F.explode(F.array_union("t", "p")).alias("label"), "t", "p")
    f1 = each.groupBy("label").agg((F.sum(2 * (F.array_contains("t", F.col("label")) & F.array_contains("p", F.col("label"))).cast("int")) / F.sum(F.array_contains("t", F.col("label")).cast("int") + F.array_contains("p", F.col("label")).cast("int"))).alias("f1"))
    return by_row.crossJoin(f1.agg(F.avg("f1").alias("f1_macro")))


def binary(df: DataFrame, truth: str = "y", score: str = "s", threshold: float = 0.5) -> DataFrame:
    """(pr_auc, roc_auc, accuracy, balanced_accuracy, f1_macro, precision, recall, cohen_kappa, jaccard).

    The curves come from counts by distinct score, cumulated over their order: average precision is the sum of recall steps
    times precision, the area under the ROC curve the sum of its trapezoids. Scores of threshold or more are positive.
    """
    cells = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth)).alias("pos"), F.sum(1 - F.col(truth)).alias("neg"))
    # running sums within ranges of scores, on top of the sums of the ranges before: no task orders all scores
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells, _ = materialize(cells.repartitionByRange(n, F.desc("s")).withColumn("part", F.spark_partition_id()), "scores")
    sums = cells.groupBy("part").agg(F.sum("pos").alias("pos_part"), F.sum("neg").alias("neg_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", *[F.coalesce(F.sum(f"{c}_part").over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")])
    w = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = cells.join(sums, "part").withColumns({"tp": F.sum("pos").over(w) + F.col("pos_before"), "fp": F.sum("neg").over(w) + F.col("neg_before")})
    tot = cells.agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    curve = cum.crossJoin(tot).agg(
        F.sum(F.try_divide(F.col("pos"), F.col("p_all")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"),
        F.sum(F.try_divide(F.col("neg"), F.col("n_all")) * F.try_divide(F.col("tp") - F.col("pos") / 2, F.col("p_all"))).alias("roc_auc"))
    hit = F.when(F.col("s") >= threshold, 1).otherwise(0)
    m = cells.agg(F.sum(F.col("pos") * hit).alias("tp"), F.sum(F.col("neg") * hit).alias("fp"), F.sum(F.col("pos") * (1 - hit)).alias("fn"), F.sum(F.col("neg") * (1 - hit)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    po, pe = (tp + tn) / n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    out = m.select(po.alias("accuracy"), ((z(tp, tp + fn) + z(tn, tn + fp)) / 2).alias("balanced_accuracy"), ((z(2 * tp, 2 * tp + fp + fn) + z(2 * tn, 2 * tn + fp + fn)) / 2).alias("f1_macro"), z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(po - pe, 1 - pe).alias("cohen_kappa"), z(tp, tp + fp + fn).alias("jaccard"))
    return curve.crossJoin(out)


def over_runs(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, mean, std): mean and population deviation over runs."""
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def best(df: DataFrame, step: str, value: str, criterion: str = "max") -> DataFrame:
    """(best_step, best_value) by max or min; the first step among equals."""
    v = F.col(value) if criterion == "max" else -F.col(value)
    return df.agg(F.min_by(step, F.struct((-v).alias("v"), F.col(step))).alias("best_step"), (F.max(value) if criterion == "max" else F.min(value)).alias("best_value"))
