"""Scores of answers: accuracy, recall, abstention, ablation, error categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ABSENT = "info_not_found"


def document_recall(got: Column, expected: Column) -> Column:
    want = F.size(F.array_distinct(expected))
    return F.when(want > 0, F.size(F.array_intersect(got, expected)) / want)


def by_category(rows: DataFrame) -> DataFrame:
    """Accuracy, average recall (nulls left out) and abstention rate per question_type."""
    return rows.groupBy("question_type").agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("recall").alias("avg_recall"), F.avg(F.col("abstained").cast("double")).alias("abstention_rate")
    )


def abstention(rows: DataFrame) -> DataFrame:
    """Precision and recall of abstaining, false abstention and confabulation; null where there is nothing to divide by."""
    absent, out = F.col("question_type") == ABSENT, F.col("abstained")
    n = lambda c: F.count_if(c).cast("double")
    return rows.agg(
        F.try_divide(n(absent & out), n(out)).alias("precision"),
        F.try_divide(n(absent & out), n(absent)).alias("recall"),
        F.try_divide(n(~absent & out), n(~absent)).alias("false_abstention"),
        F.try_divide(n(absent & ~out), n(absent)).alias("confabulation"),
    )


def ablation(with_er: DataFrame, without_er: DataFrame) -> DataFrame:
    """Accuracies of two runs over the questions both have, overall and on multi-hop ones."""
    a = with_er.select("question_id", F.col("correct").alias("a"), F.col("plan_class").alias("pa"))
    b = without_er.select("question_id", F.col("correct").alias("b"), F.col("plan_class").alias("pb"))
    hop = (F.col("pa") == "MULTIHOP") | (F.col("pb") == "MULTIHOP")
    mean = lambda c, cond=None: F.avg(F.when(cond, c.cast("double")) if cond is not None else c.cast("double"))
    out = a.join(b, "question_id").agg(
        F.count("*").alias("n"), mean(F.col("a")).alias("accuracy_with"), mean(F.col("b")).alias("accuracy_without"),
        mean(F.col("a"), hop).alias("multihop_with"), mean(F.col("b"), hop).alias("multihop_without"),
    )
    return out.withColumn("delta", F.col("accuracy_with") - F.col("accuracy_without")).withColumn("multihop_delta", F.col("multihop_with") - F.col("multihop_without"))


def error_category(question_type: Column, abstained: Column, recall: Column, correct: Column) -> Column:
    """The first category of failure that fits."""
    return (
        F.when(abstained & (question_type != ABSENT), "false_abstention")
        .when(~abstained & (question_type == ABSENT), "confabulation")
        .when(recall < 0.5, "low_document_recall")
        .when(~correct, "wrong_answer")
        .otherwise("other")
    )


def error_counts(rows: DataFrame) -> DataFrame:
    """(category, n) of the answers that aren't correct."""
    kind = error_category(F.col("question_type"), F.col("abstained"), F.col("recall"), F.col("correct"))
    return rows.where("NOT correct").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def failure_sample(rows: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """`n` of the answers that aren't correct, with their category: those of least hash of the id, so reruns agree."""
    from loomgraph.operators.sampling import simple_sample

    kind = error_category(F.col("question_type"), F.col("abstained"), F.col("recall"), F.col("correct"))
    return simple_sample(rows.where("NOT correct").withColumn("category", kind), "question_id", n, seed)
