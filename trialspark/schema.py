"""Column roles of a trial table, assigned by name and never by position."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class TrialError(ValueError):
    """Raised when inputs break a rule an operator depends on."""


@dataclass(frozen=True)
class TrialSchema:
    """Names of the key, group, target and feature columns."""

    id: str = "id"
    env: str = "env"
    target: str = "yield_mg"
    metadata: tuple[str, ...] = ("year", "location", "hybrid", "parent1", "parent2")
    markers: tuple[str, ...] = ()
    env_numeric: tuple[str, ...] = ()
    env_categorical: tuple[str, ...] = field(default_factory=tuple)

    @property
    def features(self) -> tuple[str, ...]:
        return self.markers + self.env_numeric + self.env_categorical


def require_columns(df: DataFrame, names, what: str = "input") -> None:
    """Fail with the sorted list of absent columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise TrialError(f"{what} lacks required columns: {missing}")
