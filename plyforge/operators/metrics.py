"""Masked losses over supplied logits, and statistics of vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label] of one token, in double precision."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - most))
    return F.log(total) + most - F.element_at(logits, (label + 1).cast("int"))


def masked_losses(tokens: DataFrame, value_start: int, value_end: int, weight: float = 1.0, ignored: int = -100) -> DataFrame:
    """One row: ce over other tokens, hl over value tokens, and ce + weight * hl; 0 where there are none. tokens: (logits, label)."""
    is_value = (F.col("label") >= value_start) & (F.col("label") < value_end)
    valid = tokens.where(F.col("label") != ignored)
    losses = valid.select(
        F.when(~is_value, cross_entropy(F.col("logits"), F.col("label"))).alias("ce"),
        F.when(is_value, gaussian_histogram_loss(value_end - value_start)(F.slice("logits", value_start + 1, value_end - value_start), (F.col("label") - value_start).cast("double"))).alias("hl"),
    )
    means = losses.agg(F.coalesce(F.avg("ce"), F.lit(0.0)).alias("ce"), F.coalesce(F.avg("hl"), F.lit(0.0)).alias("hl"))
    return means.withColumn("total", F.col("ce") + weight * F.col("hl"))


def gaussian_histogram_loss(bins: int = 64, ratio: float = 2.0):
    """Cross-entropy against a Gaussian around the target cut to histogram bins over [0, bins - 1]; its width is ratio bins."""
    edges = np.linspace(0, bins - 1, bins + 1)
    sigma = ratio * (edges[1] - edges[0])
    erf = np.vectorize(math.erf)

    @pandas_udf("double")
    def loss(logits: pd.Series, target: pd.Series) -> pd.Series:
        if not len(logits):
            return pd.Series([], dtype="float64")
        # Spark evaluates both branches of a condition for a batch, so rows of the other kind come as null
        x = np.stack([np.zeros(bins) if v is None or len(v) != bins else np.asarray(v, float) for v in logits])
        cdf = erf((edges[None, :] - target.to_numpy(float)[:, None]) / (sigma * math.sqrt(2)))
        p = np.diff(cdf, axis=1) / (cdf[:, -1:] - cdf[:, :1])
        most = x.max(1, keepdims=True)
        return pd.Series((p * (np.log(np.exp(x - most).sum(1, keepdims=True)) + most - x)).sum(1))

    return loss


def dimension_stats(rows: DataFrame, vector: str) -> DataFrame:
    """dim, mean and sample standard deviation of each vector dimension."""
    return rows.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_samp(F.col("v").cast("double")).alias("std"))


def mean_by_steps(rows: DataFrame, step: str, loss: str, every: int) -> DataFrame:
    """The mean loss of each run of ``every`` steps."""
    return rows.groupBy(F.floor(F.col(step) / every).alias("window")).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("n"))
