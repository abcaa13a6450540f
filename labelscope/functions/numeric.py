"""Numeric coercion of free-text scores, and numbers as fixed-point text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscope.functions.text import bind

# Plain decimal or scientific number, optional sign, optional white space.
# try_cast alone accepts suffixes such as '12d' and '12f'; pandas does not.
NUMBER_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def strict_number(c: Column | str) -> Column:
    """DOUBLE of a numeric text, NULL for anything else (NaN included)."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    v = F.when(F.regexp_like(s, F.lit(NUMBER_RE)), s.try_cast("double"))
    return F.when(~F.isnan(v), v)


#: Splits a double into two halves whose products are exact.
_SPLIT = float(2 ** 27 + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * _SPLIT - (x * _SPLIT - x)
    return high, x - high


def fixed(c: Column | str, digits: int) -> Column:
    """A number as text with ``digits`` decimals, rounded as Python prints it:
    the exact value of the double, and halves to the even digit. (Java's
    formatter rounds halves up, of the shortest decimal that reads back as the
    same double.) For numbers below 2^63; NULL stays NULL, NaN is 'nan'."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = 10 ** digits

    def of_fraction(whole: Column, f: Column) -> Column:
        """The whole part is exact, and so is the fraction f; their product
        with the scale is the double p and an error that is found exactly."""
        def of_product(p: Column) -> Column:
            (fh, fl), high = _halves(f), float(scale)          # the scale has few bits: its low half is 0
            error = (fh * high - p) + fl * high
            down = F.floor(p)
            beyond = (p - down - 0.5) + error
            odd = (down if digits else whole) % 2 == 1
            up = F.when((beyond > 0) | ((beyond == 0) & odd), 1).otherwise(0)
            return bind(down + up, lambda m: F.concat(
                F.when(m == scale, whole + 1).otherwise(whole).cast("string"),
                *([F.lit("."), F.lpad(F.when(m == scale, F.lit(0)).otherwise(m).cast("string"), digits, "0")]
                  if digits else [])))

        return bind(f * float(scale), of_product)

    def of(v: Column) -> Column:
        size = F.abs(v)
        text = bind(F.floor(size), lambda whole: bind(size - whole, lambda f: of_fraction(whole, f)))
        return F.when(F.isnan(v), F.lit("nan")).when(v < 0, F.concat(F.lit("-"), text)).otherwise(text)

    return F.when(x.isNotNull(), bind(x, of))
