"""Evaluation metrics, score-table losses and metric summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def confusion_matrix(df: DataFrame, n_classes: int, label: str = "label", predicted: str = "predicted",
                     mask: str | None = None) -> DataFrame:
    """Counts of every (label, predicted) cell, absent cells included; rows where ``mask`` is false are left out.

    A label or prediction outside 0 .. n_classes - 1, or a missing one, that the mask lets through fails the job.
    """
    if mask is not None:
        df = df.filter(F.col(mask))
    spark = df.sparkSession
    ids = F.sequence(F.lit(0), F.lit(n_classes - 1))
    cells = spark.range(1).select(F.explode(ids).alias("label")).select(
        "label", F.explode(ids).alias("predicted"), F.lit(0).cast("bigint").alias("n"))
    def known(c: str) -> Column:
        value = F.col(c).cast("int")
        return (F.when(value.between(0, n_classes - 1), value)
                .otherwise(F.raise_error(F.concat(F.lit(f"{c} is not one of {n_classes} classes: "), F.coalesce(value.cast("string"), F.lit("NULL")))).cast("int")))

    counts = df.groupBy(known(label).alias("label"), known(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.unionByName(cells).groupBy("label", "predicted").agg(F.sum("n").alias("n"))


def _class_counts(matrix: DataFrame) -> DataFrame:
    """TP, FP, FN and label totals per class from the n x n cells: each cell feeds its row and its column."""
    hit = F.col("label") == F.col("predicted")
    parts = F.array(
        F.struct(F.col("label").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn")))
    return (matrix.select(F.explode(parts).alias("p")).groupBy(F.col("p.class").alias("class"))
            .agg(F.sum("p.tp").alias("tp"), F.sum("p.fp").alias("fp"), F.sum("p.fn").alias("fn")))


def _rates(tp: Column, fp: Column, fn: Column, zero_f1: bool = False) -> dict[str, Column]:
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.try_divide(precision * recall * 2, precision + recall)
    if zero_f1:
        f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(f1)
    return {"accuracy": recall, "precision": precision, "recall": recall, "f1": f1,
            "iou": F.try_divide(tp, tp + fp + fn)}


def class_metrics(df: DataFrame, n_classes: int, label: str = "label", predicted: str = "predicted",
                  mask: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and IoU per class, micro (summed counts) and macro (mean over defined classes).

    Undefined class values are left out of the macro mean and reported as 0.
    """
    counts = _class_counts(confusion_matrix(df, n_classes, label, predicted, mask))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    rated = counts.withColumns(_rates(tp, fp, fn))
    names = ["accuracy", "precision", "recall", "f1", "iou"]
    per_class = rated.select(F.lit("class").alias("scope"), "class", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    none = F.lit(None).cast("int").alias("class")
    macro = rated.agg(*[F.avg(n).alias(n) for n in names]).select(F.lit("macro").alias("scope"), none, *names)
    sums = counts.agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn")])
    micro = sums.select(F.lit("micro").alias("scope"), none,
                        *[v.alias(n) for n, v in _rates(F.col("tp"), F.col("fp"), F.col("fn"), zero_f1=True).items()])
    return per_class.unionByName(micro).unionByName(macro)


def iou_report(df: DataFrame, n_classes: int, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """inter / max(union, 1) per class and their plain mean (class NULL)."""
    counts = _class_counts(confusion_matrix(df, n_classes, label, predicted))
    union = F.greatest(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1).cast("bigint"))
    each = counts.select("class", (F.col("tp") / union).alias("iou"))
    return each.unionByName(each.agg(F.lit(None).cast("int").alias("class"), F.avg("iou").alias("iou")))


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted", mask: str | None = None) -> DataFrame:
    if mask is not None:
        df = df.filter(F.col(mask))
    hit = (F.col(label) == F.col(predicted)).cast("bigint")
    return df.agg(F.sum(hit).alias("n_correct"), F.count("*").alias("n_total"), F.avg(hit).alias("accuracy"))


def per_class_loss(df: DataFrame, loss: str = "loss", label: str = "label", mask: str | None = None) -> DataFrame:
    if mask is not None:
        df = df.filter(F.col(mask))
    return df.groupBy(label).agg(F.avg(loss).alias("mean_loss"))


def log_softmax_at(scores: str | Column, index: str | Column) -> Column:
    """Log-softmax of the score array at a 0-based index, shifted by the largest score."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    index = F.col(index) if isinstance(index, str) else index
    top = F.array_max(scores).cast("double")
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s.cast("double") - top))
    return F.get(scores, index).cast("double") - top - F.log(total)


def _reduce(losses: DataFrame, reduction: str | None) -> DataFrame:
    if reduction is None:
        return losses
    if reduction == "sum":
        return losses.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"))
    if reduction == "mean":
        return losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))
    raise ValueError(f"reduction must be mean, sum or None, not {reduction!r}")


def masked_cross_entropy(df: DataFrame, scores: str = "scores", label: str = "label", ignore_class: int | None = 0,
                         reduction: str | None = "mean") -> DataFrame:
    """-log softmax at the label; rows of the ignored class are excluded, an empty selection gives 0."""
    kept = df if ignore_class is None else df.filter(F.col(label) != ignore_class)
    return _reduce(kept.withColumn("loss", -log_softmax_at(scores, label)), reduction)


def masked_focal(df: DataFrame, scores: str = "scores", label: str = "label", gamma: float = 2.0,
                 alpha: Sequence[float] | None = None, ignore_class: int | None = None,
                 reduction: str | None = "mean") -> DataFrame:
    """Focal loss -(1 - p)^gamma * log p with optional class weights on log p."""
    kept = df if ignore_class is None else df.filter(F.col(label) != ignore_class)
    log_p = log_softmax_at(scores, label)
    weighted = log_p if alpha is None else log_p * F.get(F.array(*[F.lit(float(a)) for a in alpha]), F.col(label))
    loss = -F.pow(1.0 - F.exp(log_p), F.lit(float(gamma))) * weighted
    return _reduce(kept.withColumn("loss", loss), reduction)


def metrics_summary(df: DataFrame, group_by: Sequence[str] | str, values: Sequence[str],
                    fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Summarise numeric columns per '-'-joined key; the default mean skips NaN and NULL.

    ``fn`` may be any aggregate from column to column.
    """
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    summarise = fn or (lambda c: F.avg(F.nanvl(c.cast("double"), F.lit(None))))
    return (df.withColumn("group_key", F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
            .groupBy("group_key").agg(*[summarise(F.col(v)).alias(v) for v in values]))
