"""Vector and tag-set arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector: Column) -> Column:
    """Vector over its length; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.element_at(F.transform(F.array(F.when(norm > 0, norm).otherwise(1.0)), lambda n: F.transform(
        vector, lambda x: x.cast("double") / n)), 1)


def confidence(score: Column) -> Column:
    """Similarity in [-1, 1] as a confidence in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def tag_set(tags: Column, underscored: bool = False) -> Column:
    """Distinct trimmed lower-case tags, sorted, blanks removed."""
    def clean(t: Column) -> Column:
        text = F.lower(F.trim(t))
        return F.translate(text, " -", "__") if underscored else text

    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(tags, none), clean), lambda t: t != "")))


# Agreement scores (exact, subset, partial, none) of the two scales.
OVERLAP_SCALES = {
    "similarity": (1.0, 0.85, 0.55, 0.0),
    "bonus": (0.14, 0.10, 0.06, -0.08),
}


def overlap_score(detected: Column, reference: Column, scale: str = "similarity") -> Column:
    """Agreement of two tag lists; zero when either is empty."""
    exact, subset, partial, none = OVERLAP_SCALES[scale]
    a, b = tag_set(detected, scale == "bonus"), tag_set(reference, scale == "bonus")
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(a == b, exact).when(F.size(F.array_except(a, b)) == 0, subset)
        .when(F.arrays_overlap(a, b), partial).otherwise(none)
    )
