"""End-to-end workflows built from the operators: fit and predict, evaluate, stack, cross-validate."""

from trialspark.plans.decompose import decompose
from trialspark.plans.evaluate import evaluate
from trialspark.plans.rolling import rolling_cv
from trialspark.plans.stack import stack

__all__ = ["decompose", "evaluate", "rolling_cv", "stack"]
