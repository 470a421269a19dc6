"""The daily job: due patterns -> tasks, advanced patterns, audit, report (T-09, T-11, T-15, W-08)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.tasks import generate_tasks, run_report
from paperloom.sources.tables import write_snapshot


def run_daily(patterns: DataFrame, members: DataFrame, day: str, folder: str) -> None:
    """Write one run's outputs as new snapshots below ``folder``; a scheduler calls it once a day at the hour it likes."""
    at = F.lit(day).cast("timestamp")
    tasks, updated, audit = generate_tasks(patterns, F.lit(day).cast("date"), at)
    write_snapshot(tasks, f"{folder}/tasks")
    write_snapshot(updated, f"{folder}/recurring_patterns")
    write_snapshot(audit, f"{folder}/audit_log")
    write_snapshot(run_report(tasks, members), f"{folder}/run_report")
