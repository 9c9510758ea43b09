"""The status report: what ``info`` shows for each database of a fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import state


def info(history: DataFrame, scripts: DataFrame, target: str | None = None) -> DataFrame:
    """All rows of the report."""
    return state.info(history, scripts, target)


def older_info(history: DataFrame, scripts: DataFrame, target: str | None = None) -> DataFrame:
    """The report where a later undo alone makes a version undone, even if it was applied once more after that."""
    return state.info(history, scripts, target, need_undone=False)


def overview(history: DataFrame, scripts: DataFrame) -> DataFrame:
    """A row for each database."""
    return state.snapshot(history, scripts)
