"""The six vector metrics as column functions over ``array<float|double>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric name -> whether larger is better.
METRICS = {
    "cosine_distance": False,
    "cosine_similarity": True,
    "euclidean_distance": False,
    "inner_product": True,
    "manhattan_distance": False,
    "squared_euclidean_distance": False,
}

SCORE_DIGITS = 9


def _sum_of_pairs(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(
        F.raise_error(F.lit("vectors of different length")).cast("double")
    )


def inner_product(a: Column, b: Column) -> Column:
    return _sum_of_pairs(a, b, lambda x, y: x * y)


def squared_euclidean_distance(a: Column, b: Column) -> Column:
    return _sum_of_pairs(a, b, lambda x, y: (x - y) * (x - y))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean_distance(a, b))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _sum_of_pairs(a, b, lambda x, y: F.abs(x - y))


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL when one vector has no length."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


_BY_NAME = {
    f.__name__: f
    for f in (
        cosine_distance,
        cosine_similarity,
        euclidean_distance,
        inner_product,
        manhattan_distance,
        squared_euclidean_distance,
    )
}


def metric(name: str, a: Column, b: Column) -> Column:
    if name not in _BY_NAME:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(_BY_NAME)}")
    return _BY_NAME[name](a, b)


def flatten_embedding(nested: Column) -> Column:
    """``array<array<float>>``, as a model server returns it, to one flat vector."""
    return F.flatten(nested)
