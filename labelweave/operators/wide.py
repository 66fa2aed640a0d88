"""Sums of products that neither overflow nor vanish, whatever the size of the factors.

A product is kept in one of nine sums by its magnitude, scaled to the middle of a double's range, so
a value is the sum of ``s_k * 2^(512 k)`` for k from -4 to 4.  The sums add up in any order and on
any task like plain ones, and are put together only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of two between neighbouring sums.
WIDTH = 512
LEVELS = range(-4, 5)
#: Within these powers of two sums of squares fit a double.
SAFE_POWER = 480


def _level(value: str) -> str:
    """Where a factor lies, from -2 to 2: within 2^-256 and 2^256 it is 0."""
    power = f"floor((log2(abs({value})) + {WIDTH // 2}) / {WIDTH})"
    return f"CASE WHEN {value} = 0D THEN 0 ELSE CAST({power} AS INT) END"


def _moved(value: str, level: str) -> str:
    """A factor moved to the middle; half of the way at a time, as the whole would overflow."""
    half = f"power(2D, -{WIDTH // 2} * ({level}))"
    return f"({value} * {half} * {half})"


def product_sums(left: str, right: str, name: str) -> list[Column]:
    """Aggregates ``<name>_0 .. <name>_8`` that hold the sum of products of two columns."""
    a, b = _level(left), _level(right)
    product = f"{_moved(left, a)} * {_moved(right, b)}"
    return [
        F.expr(f"sum(CASE WHEN ({a}) + ({b}) = {k} THEN {product} ELSE 0D END) AS {name}_{k + 4}")
        for k in LEVELS
    ]


def names(name: str) -> list[str]:
    return [f"{name}_{k + 4}" for k in LEVELS]


def zeros(*sums: str) -> list[Column]:
    return [F.lit(0.0).alias(c) for name in sums for c in names(name)]


def combined(formula: str, *sums: str) -> tuple[Column, Column]:
    """``(level, value)`` of a formula of sums, such as ``n / 2D - d``, as ``value * 2^(512 level)``.

    Two sums below the highest in use there is nothing a double could show.
    """
    top = "CASE"
    parts = []
    for k in reversed(LEVELS):
        used = " OR ".join(f"{name}_{k + 4} <> 0D" for name in sums)
        top += f" WHEN {used} THEN {k}"
    top += " ELSE 0 END"
    for k in LEVELS:
        part = formula
        for name in sums:
            part = part.replace(f"{{{name}}}", f"{name}_{k + 4}")
        parts.append(part)
    values = F.array(*[F.expr(p) for p in parts])
    level = F.expr(top)
    below = F.coalesce(F.get(values, level + 3), F.lit(0.0)) * F.lit(2.0**-WIDTH)
    return level, F.get(values, level + 4) + below


def order_key(level: Column, value: Column) -> Column:
    """A struct that orders such values: sign, power of two, and what is left."""
    sign = F.signum(value).cast("int")
    power = F.when(value == 0, 0).otherwise(F.floor(F.log2(F.abs(value))).cast("int"))
    rest = value / F.pow(F.lit(2.0), power)
    return F.struct(
        sign.alias("sign"), (sign * (power + level * WIDTH)).alias("power"), rest.alias("rest")
    )


def root(level: Column, value: Column) -> Column:
    """The square root of a sum of squares; rounding may have left it slightly negative."""
    half = F.pow(F.lit(2.0), level * (WIDTH // 4))
    return F.sqrt(F.greatest(F.lit(0.0), value)) * half * half


def rounded(value: Column, size: Column, bits: int) -> Column:
    """A value without the digits that rounding errors of numbers of some size reach."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size)) - bits)
    return F.when(size > 0, F.rint(value / step) * step).otherwise(0.0)
