"""Metrics over scored and labelled rows: one aggregate with map-side combine each, whatever the number of rows.

Defined results for odd input: a ratio without a denominator is 0, a mean or extreme of no rows null; a null score predicts
nothing and counts as unsupported; null labels are a group of their own; empty tables give zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidelta.functions.lexical import ratio


def predict(score: Column, threshold: float) -> Column:
    return F.when(F.coalesce(score, F.lit(0.0)) >= threshold, "supported").otherwise("unsupported")


def binary_counts(rows: DataFrame, predicted: Column, expected: Column, by: list[str] = ()) -> DataFrame:
    """``tp``, ``fn``, ``fp``, ``tn``, ``total``, of all rows or of each group; what is none of the first three is a tn."""
    tp = (expected == "supported") & (predicted == "supported")
    fn = (expected == "supported") & (predicted == "unsupported")
    fp = (expected == "unsupported") & (predicted == "supported")
    counts = rows.groupBy(*by).agg(F.count_if(tp).alias("tp"), F.count_if(fn).alias("fn"), F.count_if(fp).alias("fp"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("tn", F.col("total") - F.col("tp") - F.col("fn") - F.col("fp"))


def ratios(counts: DataFrame) -> DataFrame:
    """``counts`` with accuracy, precision, recall and the rates of false positives and negatives."""
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    return counts.withColumns({"accuracy": ratio(tp + tn, F.col("total")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp)})


def distribution(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """Rows, mean, least and greatest score of each label."""
    return rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("greatest"))


def accuracy_by(rows: DataFrame, expected: Column, predicted: Column, by: Column) -> DataFrame:
    """``total``, ``correct`` and ``accuracy`` of each group."""
    grouped = rows.groupBy(by.alias("group")).agg(F.count(F.lit(1)).alias("total"), F.count_if(expected == predicted).alias("correct"))
    return grouped.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def confusion(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    return rows.groupBy(expected.alias("expected"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("rows"))


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key`` and ``outcome`` (fixed, broken, same_correct, same_wrong) of the rows that both models, with a boolean ``correct``, have."""
    pairs = left.select(key, F.col("correct").alias("_a")).join(right.select(key, F.col("correct").alias("_b")), key)
    outcome = F.when(~F.col("_a") & F.col("_b"), "fixed").when(F.col("_a") & ~F.col("_b"), "broken").when(F.col("_a"), "same_correct").otherwise("same_wrong")
    return pairs.select(key, outcome.alias("outcome"))


def differs(have: DataFrame, want: DataFrame) -> DataFrame:
    """Rows of an expected distribution that aren't there, and the reverse; empty if both are equal."""
    return have.exceptAll(want).withColumn("side", F.lit("unexpected")).unionByName(want.exceptAll(have).withColumn("side", F.lit("missing")))


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key`` and ``side`` of the keys that stand on one side only; empty if both sets are equal."""
    l, r = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right_only")))


def top_with_margin(rows: DataFrame, group: str, score: Column, order: str, least: float = 0.5, margin: float = 0.15) -> DataFrame:
    """The best row of each group, if its score is at least ``least`` and ``margin`` above the next one; of equal ones the first by ``order``.

    The two first rows of a group are picked before the shuffle too, so a group of any size is no burden.
    """
    ordered = Window.partitionBy(group).orderBy(F.desc("_s"), order)
    two = rows.withColumn("_s", score).withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= 2)
    row = F.struct(*rows.columns)
    best = two.groupBy(group).agg(F.max_by(row, -F.col("_n")).alias("row"), F.max("_s").alias("score"), F.min(F.when(F.col("_n") == 2, F.col("_s"))).alias("next"))
    clear = (F.col("score") >= least) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)
    return best.where(clear).select("row.*", "score")
