"""The verdict on a change, and the gate for the review prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake import catalog


def verdict_case() -> Column:
    """Which of the four verdicts applies; a missing count is 0."""

    def count(name):
        return F.coalesce(name, F.lit(0))

    return (
        F.when(count("critical") > 0, "critical")
        .when(count("high") > 0, "high")
        .when(count("quality_issues") > catalog.MAX_QUALITY_ISSUES, "quality")
        .otherwise("none")
    )


def with_verdict(summary: DataFrame) -> DataFrame:
    """Adds ``mark``, ``verdict`` and ``reason`` to rows of change counters."""
    texts = F.create_map(*[
        part for case, values in catalog.VERDICTS.items()
        for part in (F.lit(case), F.array(*[F.lit(value) for value in values]))
    ])
    chosen = summary.withColumn("verdict_case", verdict_case())
    columns = [
        F.element_at(F.element_at(texts, F.col("verdict_case")), at + 1).alias(name)
        for at, name in enumerate(("mark", "verdict", "reason"))
    ]
    return chosen.select("*", *columns).drop("verdict_case")


def needs_review(summary: DataFrame, enabled: bool = True) -> DataFrame:
    """Changes that get a review prompt: any finding at all, and reviews enabled."""
    return summary.where(
        F.lit(enabled) & (F.col("security_issues") + F.col("quality_issues") > 0)
    )
