"""Rules over messages in one pass: which of many matchers hold, and lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.operators.matcher import Nested, matched


def rules_that_hold(rules: dict[str, str], columns: Nested | None = None) -> Column:
    """The names of the rules (name: matcher expression) that hold for a row, in the order of the rules."""
    if not rules:
        return F.array().cast("array<string>")
    each = [F.when(matched(expression, columns), F.lit(name)) for name, expression in rules.items()]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def fan_out(messages: DataFrame, rules: dict[str, str], columns: Nested | None = None, name: str = "rule") -> DataFrame:
    """A row for each message and rule that holds for it, as a host hands each message to every plugin whose matcher it passes.

    One scan and no join, however many rules there are; messages that pass none are left out.
    """
    return messages.withColumn(name, F.explode(rules_that_hold(rules, columns)))


def enrich(messages: DataFrame, table: DataFrame, key: Column, names: dict[str, str], by: str) -> DataFrame:
    """``messages`` with columns (name: column of ``table``) of the row whose ``by`` is ``key``; null where there is none.

    A key that repeats in the table keeps one row, the least by those columns,
    so no message is doubled. Spark broadcasts the table where its size allows.
    """
    held = table.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.min(F.struct(*[F.col(c).alias(n) for n, c in names.items()])).alias("_row"))
    return messages.withColumn("_key", key).join(held, F.col("_key") == F.col("_by"), "left").select(*messages.columns, *[F.col(f"_row.{n}").alias(n) for n in names])
