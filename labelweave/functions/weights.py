"""TF and IDF weighting schemes as column expressions.

The operand order is part of the definition: it fixes the floating-point result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TfIdfSettings


def tf_weight(settings: TfIdfSettings, cnt: Column, total: Column, mx: Column) -> Column:
    """Weight of a term that occurs ``cnt`` > 0 times; an absent term has no row and weighs 0."""
    k = settings.double_normalization_k
    schemes = {
        "binary": lambda: F.lit(1.0),
        "raw_count": lambda: cnt.cast("double"),
        "normalization": lambda: cnt / total,
        "double_normalization_half": lambda: F.lit(0.5) + F.lit(0.5) * cnt / mx,
        "double_normalization_variable": lambda: F.lit(k) + F.lit(1.0 - k) * cnt / mx,
    }
    return schemes[settings.tf_scheme]()


def idf_weight(settings: TfIdfSettings, n: Column, df: Column, max_df: Column) -> Column:
    """Weight of a vocabulary term (``df`` > 0) over ``n`` fitted documents, empty ones included."""
    schemes = {
        "base": lambda: F.log(n / df),
        "smooth": lambda: F.log(n / (df + 1)) + 1.0,
        # Goes negative for the most frequent terms, and is left so.
        "maximum": lambda: F.log(max_df / (df + 1)),
        "probabilistic": lambda: F.when(df >= n, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.log((n - df) / df))
        ),
    }
    return schemes[settings.idf_scheme]()
