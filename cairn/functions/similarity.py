"""Similarities of texts, token arrays and vectors, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double; the shorter vector counts as padded with zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to 0..1; 0 if either vector is empty, null or of length 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def token_counts(tokens: Column) -> Column:
    """Map of token to count."""
    return F.map_from_arrays(F.array_distinct(tokens), F.transform(F.array_distinct(tokens), lambda t: F.size(F.filter(tokens, lambda x: x == t))))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of the token counts of two arrays; 0 if either is empty."""
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t)).cast("double")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    square = lambda arr: total(F.transform(F.array_distinct(arr), lambda t: count(arr, t) * count(arr, t)))
    both = total(F.transform(F.array_intersect(a, b), lambda t: count(a, t) * count(b, t)))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(norm > 0, F.least(F.lit(1.0), both / norm)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens over all distinct tokens; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, on raw code points; 0 if either is empty (even both)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / longest).otherwise(0.0)
