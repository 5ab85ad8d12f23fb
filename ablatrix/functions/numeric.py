"""Column kernels on numbers: rounding to 8-bit mantissas, ordering keys, k labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def format_k(k: Column) -> Column:
    """Ten decimals without trailing zeros or a trailing dot."""
    return F.regexp_replace(F.format_string("%.10f", k.cast("double")), r"\.?0+$", "")


def _exponent(magnitude: Column) -> Column:
    # Exact for float32 input: its distance to a power of two is far above double rounding.
    return F.floor(F.log2(magnitude)).cast("double")


def round_bf16(v: Column) -> Column:
    """Round a float32 value to the nearest bfloat16, ties to even."""
    x = v.cast("double")
    a = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(_exponent(a), F.lit(-126.0)) - 7.0)
    plain = F.isnan(x) | (a == 0.0) | (a == float("inf"))
    return F.when(plain, x).otherwise(F.rint(x / step) * step).cast("float")


def magnitude_key(v: Column) -> Column:
    """The bit pattern of a float32 magnitude: an integer below 2**31 in the order of magnitudes.

    The upper bits (key >> 16) are the exponent and seven mantissa bits, so values already
    rounded to bfloat16 never share them.
    """
    a = F.abs(v.cast("double"))
    e = _exponent(a)
    fraction = a / F.pow(F.lit(2.0), e) - 1.0
    return (
        F.when(a < 2.0**-126, a * 2.0**149)
        .when(a == float("inf"), F.lit(255 * 2.0**23))
        .otherwise((e + 127.0) * 2.0**23 + fraction * 2.0**23)
        .cast("bigint")
    )


def two_decimals(percent: Column) -> Column:
    """A percentage (0 to 100) rounded as ``"%.2f"`` does: by the exact binary value, exact ties to even.

    Times 2**56 such a double is a whole number, or below any tie, so the rest is integer arithmetic.
    """
    unit = F.lit(1 << 56).cast("decimal(20,0)")
    hundredths = F.floor(percent * float(1 << 56)).cast("decimal(20,0)") * 100
    rest = hundredths % unit
    down = ((hundredths - rest) / unit).cast("bigint")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (down % 2 == 1))
    return (down + up.cast("int")) / 100
