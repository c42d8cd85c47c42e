"""Array-valued vector arithmetic as built-in higher-order functions (H5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import col_of


def l2_norm(a: Column | str) -> Column:
    """H5: Euclidean norm of a vector."""
    return F.sqrt(F.aggregate(col_of(a), F.lit(0.0), lambda acc, x: acc + x * x))
