"""Training-log metrics: mean loss per epoch and phase, overfit flags,
cumulative metrics.

The per-batch log is aggregated first (partial + final hash aggregation);
windows only run over the per-epoch table, which has one row per (epoch,
phase) and is therefore bounded by the number of epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_loss(log: DataFrame, epoch: str = "epoch", phase: str = "phase", loss: str = "loss") -> DataFrame:
    """Mean loss per (epoch, phase) = sum / number of batches."""
    return log.groupBy(epoch, phase).agg(
        F.sum(loss).alias("sum_loss"),
        F.count(loss).alias("n_batches"),
    ).withColumn("mean_loss", F.col("sum_loss") / F.col("n_batches"))


def overfit_flags(per_epoch: DataFrame, phase_value: str = "val") -> DataFrame:
    """For one phase: best loss so far, epochs since the best, rising flag."""
    v = per_epoch.filter(F.col("phase") == phase_value).select("epoch", "mean_loss")
    w = Window.orderBy("epoch")  # one row per epoch
    prev_best = F.min("mean_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = F.min("mean_loss").over(w.rowsBetween(Window.unboundedPreceding, 0))
    v = v.withColumn("best_so_far", best).withColumn("_prev_best", prev_best)
    best_epoch = F.max(F.when(F.col("mean_loss") == F.col("best_so_far"), F.col("epoch"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    return v.select(
        "epoch",
        "mean_loss",
        "best_so_far",
        (F.col("epoch") - best_epoch).alias("epochs_since_best"),
        F.coalesce(F.col("mean_loss") > F.col("_prev_best"), F.lit(False)).alias("is_rising"),
    )


def cumulative_mean(per_epoch: DataFrame) -> DataFrame:
    """Running mean over epochs, weighted by batches (a never-reset metric)."""
    w = Window.partitionBy("phase").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return per_epoch.select(
        "epoch", "phase", (F.sum("sum_loss").over(w) / F.sum("n_batches").over(w)).alias("cumulative_loss")
    )
