"""Turning violation tables into errors at the edge, and previews of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import stage


class GateError(ValueError):
    """A gate found violations."""


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when a violation table has rows. Says how many, never what they hold."""
    count = violations.count()
    if count:
        raise GateError(f"{message}: {count} violation(s)")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise GateError(message)
    return df


def broken_rules(rules: list[tuple[str, Column]]) -> Column:
    """Array of (position, rule) for every rule whose condition holds; null conditions do not."""
    flags = [
        F.when(broken, F.struct(F.lit(i).alias("position"), F.lit(name).alias("rule")))
        for i, (name, broken) in enumerate(rules)
    ]
    return F.filter(F.array(*flags), lambda flag: flag.isNotNull())


def explode_rules(df: DataFrame, rules: list[tuple[str, Column]], keep: list[str]) -> DataFrame:
    """One row per broken rule: the kept columns, ``rule_position`` and ``rule``."""
    broken = df.select(*keep, F.explode(broken_rules(rules)).alias("broken"))
    return broken.select(
        *keep, F.col("broken.position").alias("rule_position"), F.col("broken.rule").alias("rule")
    )


def first_violations(violations: DataFrame, order: list[str], count: int = 25) -> DataFrame:
    """The first ``count`` violations in order, each with the number left out.

    The violations are written out once, to be both counted and cut.
    """
    if count < 1:
        raise ValueError("count must be positive")
    violations = stage(violations, "violations")
    total = violations.groupBy().agg(F.greatest(F.count("*") - count, F.lit(0)).alias("n"))
    top = violations.orderBy(*order).limit(count)
    return top.withColumn("remaining", total.select("n").scalar())
