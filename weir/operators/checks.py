"""The extension surface for checks: functions from tables to findings, registered by id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["check", "rule", "level", "unit", "message"]
Check = Callable[[DataFrame], DataFrame]
_CHECKS: dict[str, tuple[Check, tuple[str, ...]]] = {}


def register_check(name: str, check: Check, phases: Sequence[str] = ("default",)) -> None:
    """check takes the facts and returns findings (rule, level, unit, message)."""
    if name in _CHECKS:
        raise ValueError(f"registered twice: {name}")
    _CHECKS[name] = (check, tuple(phases))


def unregister_check(name: str) -> None:
    _CHECKS.pop(name, None)


def run_checks(facts: DataFrame, phase: str = "default") -> DataFrame:
    """Findings of all checks of a phase; a check that fails while its plan is made is a finding itself."""
    out = facts.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
    for name, (check, phases) in sorted(_CHECKS.items()):
        if phase not in phases:
            continue
        try:
            found = check(facts).select(F.lit(name).alias("check"), *(F.col(c).cast("string").alias(c) for c in COLUMNS[1:]))
        except Exception as e:  # any fault of a plugin is reported, none stops the others
            found = facts.sparkSession.createDataFrame([(name, "check-failed", "error", "", f"{type(e).__name__}: {str(e)[:200]}")], ", ".join(f"{c} string" for c in COLUMNS))
        out = out.unionByName(found)
    return out
