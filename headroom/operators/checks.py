"""Checks that stop a job."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_ok(checks: DataFrame) -> DataFrame:
    """`checks` (name, status) as they are; a check that failed raises, a warning does not."""
    failed = [r.name for r in checks.where("status = 'fail'").orderBy("name").collect()]  # a row per check
    if failed:
        raise RuntimeError("checks failed: " + ", ".join(failed))
    return checks
