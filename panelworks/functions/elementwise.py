"""Element-wise formula vocabulary.

NULL means missing. Arithmetic on a NULL gives NULL; the two comparisons give
0.0 instead, and ``where`` takes its right branch on a NULL condition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest divisor magnitude that still counts as non-zero.
DIVISOR_FLOOR = 1e-12


def finite(x: Column) -> Column:
    """NULL for NaN and both infinities (NaN sorts above infinity in Spark)."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def neg(x: Column) -> Column:
    return -x


def absolute(x: Column) -> Column:
    return F.abs(x)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def sign(x: Column) -> Column:
    return F.signum(x)


def signedpower(x: Column) -> Column:
    return F.signum(x) * x * x


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= DIVISOR_FLOOR, a / b)


def gt(a: Column, b: Column) -> Column:
    return F.coalesce((a > b).cast("double"), F.lit(0.0))


def lt(a: Column, b: Column) -> Column:
    return F.coalesce((a < b).cast("double"), F.lit(0.0))


def maximum(a: Column, b: Column) -> Column:
    """Larger operand, NULL when either one is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a: Column, b: Column) -> Column:
    """Smaller operand, NULL when either one is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def where(condition: Column, left: Column, right: Column) -> Column:
    return F.when(condition > 0, left).otherwise(right)


UNARY = {"neg": neg, "abs": absolute, "log": log, "sqrt": sqrt, "sign": sign, "signedpower": signedpower}
BINARY = {"add": add, "sub": sub, "mul": mul, "div": div, "gt": gt, "lt": lt, "max": maximum, "min": minimum}
TERNARY = {"where": where}
ELEMENTWISE = {
    **{name: (1, fn) for name, fn in UNARY.items()},
    **{name: (2, fn) for name, fn in BINARY.items()},
    **{name: (3, fn) for name, fn in TERNARY.items()},
}
