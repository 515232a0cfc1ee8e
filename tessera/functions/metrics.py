"""Metric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """The F score of a precision and a recall, 0 where both are."""
    weight = beta * beta
    return ratio((1 + weight) * precision * recall, weight * precision + recall)


def entity_f05(truth: Column, predicted: Column, right: Column) -> Column:
    """F0.5 of one entity from counts; an entity without matches scores 1 if nothing is
    predicted for it, and 0 otherwise."""
    return (
        F.when(truth == 0, F.when(predicted == 0, 1.0).otherwise(0.0))
        .when((predicted == 0) | (right == 0), 0.0)
        .otherwise(1.25 * right / (0.25 * truth + predicted))
    )


def reduction_ratio(candidates: Column, left: Column, right: Column) -> Column:
    """The share of all pairs that blocking spares."""
    space = left.cast("double") * right.cast("double")
    return F.when(space > 0, 1.0 - candidates / space).otherwise(1.0)


def pair_space(left: Column, right: Column) -> Column:
    """The number of all pairs, exact beyond 64 bits."""
    return left.cast("decimal(19,0)") * right.cast("decimal(19,0)")
