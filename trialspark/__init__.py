"""Multi-environment trial analytics expressed as Spark DataFrame jobs."""

from trialspark.schema import TrialError, TrialSchema

__all__ = ["TrialError", "TrialSchema"]
