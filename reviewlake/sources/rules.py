"""User rules kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake import catalog
from reviewlake.catalog import Rule
from reviewlake.functions.regex import java_pattern

RULES = (
    "name string, pattern string, severity string, description string, recommendation string, "
    "extensions array<string>, multiline boolean"
)
TEXTS = ("name", "pattern", "severity", "description", "recommendation")


def check_rules(spark: SparkSession, rules: Sequence[Rule]) -> None:
    """Refuses, before a scan runs on executors, rules that would fail there or tell an unknown severity.

    All patterns are tried in one job; where that fails, halves of them are, down to the rule to name.
    """
    for rule in rules:
        if rule.severity not in catalog.SEVERITIES:
            raise ValueError(f"rule {rule.name!r}: severity must be one of {catalog.SEVERITIES}, not {rule.severity!r}")
    patterns = [(java_pattern(rule.pattern, ignore_case=True, multiline=rule.multiline),) for rule in rules]
    if not patterns:
        return
    try:
        spark.createDataFrame(patterns, "pattern string").agg(F.count_if(F.rlike(F.lit(""), F.col("pattern")))).collect()
    except PySparkException as wrong:
        if len(rules) == 1:
            raise ValueError(f"rule {rules[0].name!r}: the pattern can't be run: {rules[0].pattern!r}") from wrong
        half = len(rules) // 2
        check_rules(spark, rules[:half])
        check_rules(spark, rules[half:])


def rules_from_table(rows: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table with the columns of ``RULES``, by name; without ``extensions`` a rule is for all files.

    Rules are configuration, a row each, and are prepared here: for ``scan``, which makes each an expression of its plan, or
    for ``rule_index``, which writes them as a table and suits thousands. An optional column ``literals`` is taken over.
    Names must differ, and texts must be there; a missing ``multiline`` counts as false.
    """
    literals = F.col("literals") if "literals" in rows.columns else F.array().cast("array<string>")
    rules = tuple(
        Rule(*(row[name] for name in TEXTS), None if row["extensions"] is None else tuple(row["extensions"]),
             multiline=bool(row["multiline"]), literals=tuple(row["literals"] or ()))
        for row in rows.select(*TEXTS, "extensions", "multiline", literals.alias("literals")).orderBy("name").collect()
    )
    names = [rule.name for rule in rules]
    if len(set(names)) < len(names):
        raise ValueError("names of rules must differ")
    for rule in rules:
        if any(getattr(rule, name) is None for name in TEXTS):
            raise ValueError(f"rule {rule.name!r}: {', '.join(TEXTS)} must be given")
    check_rules(rows.sparkSession, rules)
    return rules
