"""Building blocks for findings: one struct per hit, arrays of hits per line or file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.catalog import Check
from reviewlake.schemas import FILE_KEYS, FINDING, FINDINGS


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def finding(**values) -> Column:
    """A finding struct; fields that are not given are NULL."""
    fields = []
    for field in FINDING.fields:
        value = values.get(field.name)
        column = value if isinstance(value, Column) else F.lit(value)
        fields.append(column.cast(field.dataType).alias(field.name))
    return F.struct(*fields)


def check_finding(check: Check, **values) -> Column:
    texts = {
        "severity": check.severity, "issue": check.name,
        "description": check.description, "recommendation": check.recommendation,
    }
    return finding(**{**texts, **values})


def one_if(condition: Column, hit: Column) -> Column:
    return F.when(condition, F.array(hit)).otherwise(no_findings())


def file_keys(df: DataFrame) -> list[str]:
    return [name for name in FILE_KEYS if name in df.columns]


def explode_findings(df: DataFrame, findings: Column) -> DataFrame:
    """One row per finding; see ``scan`` for why the explode is an outer one."""
    exploded = df.select(*file_keys(df), F.explode_outer(findings).alias("finding"))
    return exploded.where(F.col("finding").isNotNull()).select(*file_keys(df), "finding.*")
