"""Counters and running statistics as ordinary, partially aggregated aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def running_count(x: Column) -> Column:
    return F.count(_finite(x))


def running_mean(x: Column) -> Column:
    """Mean of the finite values, 0 for none."""
    return F.coalesce(F.avg(_finite(x)), F.lit(0.0))


def running_sd(x: Column) -> Column:
    """Sample deviation of the finite values, 0 for fewer than two."""
    return F.coalesce(F.stddev_samp(_finite(x)), F.lit(0.0))


def match_counts(df: DataFrame, condition: Column, *more: Column) -> DataFrame:
    """processed, matched and more aggregates, in one pass."""
    return df.agg(F.count("*").alias("processed"), F.count_if(F.coalesce(condition, F.lit(False))).alias("matched"), *more)


def plugin_stats(calls: DataFrame, output_plugin: bool = False) -> DataFrame:
    """Per plugin: counts, failures and times of its calls (plugin, rv, seconds, messages, bytes).

    A failure is rv -1; an output's retries (-3) aren't counted as processed. A
    column ``timer`` tells calls of timer events, which have times of their own.
    """
    timer = F.col("timer") if "timer" in calls.columns else F.lit(False)
    counted = ~timer & (F.col("rv") != -3 if output_plugin else F.lit(True))
    seconds, ticks = F.when(~timer, F.col("seconds")), F.when(timer, F.col("seconds"))
    more = [running_mean(ticks).alias("te_avg"), running_sd(ticks).alias("te_sd")] if "timer" in calls.columns else []
    return calls.groupBy("plugin").agg(
        F.sum("messages").alias("im_cnt"), F.sum("bytes").alias("im_bytes"), F.count_if(counted).alias("pm_cnt"), F.count_if(F.col("rv") == -1).alias("pm_failures"),
        running_mean(seconds).alias("pm_avg"), running_sd(seconds).alias("pm_sd"), F.max("bytes").alias("out_max"), *more,
    )


def least(*values: Column) -> Column:
    return F.least(*values)


def greatest(*values: Column) -> Column:
    """The largest argument; NaN counts only where all are NaN or null."""
    real = F.greatest(*[F.when(~F.isnan(v), v) for v in values])
    return F.coalesce(real, F.greatest(*values))
