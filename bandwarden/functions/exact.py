"""Exact comparisons of unsigned 64-bit powers.

Spark has no unsigned 64-bit type, so powers are ``DECIMAL(20,0)`` or, where a
bound is known, ``LONG``.  A product with a ``DECIMAL(10,0)`` norm fits
``DECIMAL(31,0)``.  Almost every frame is far from the boundary, where doubles
already decide with a proven error bound; only near ties pay for decimals.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CERTAIN = 2.0**-48  # three roundings of 2**-53 on each side stay below this


def _dec(col: Column, digits: int) -> Column:
    return col.cast(f"decimal({digits},0)")


def exact_greater(a: Column, b: Column, c: Column, d: Column, right_digits: int = 10) -> Column:
    """``a*b > c*d`` exactly, for non-negative integer columns."""
    left, right = a.cast("double") * b.cast("double"), c.cast("double") * d.cast("double")
    return (
        F.when(left > right * (1.0 + _CERTAIN), F.lit(True))
        .when(left < right * (1.0 - _CERTAIN), F.lit(False))
        .otherwise(
            _dec(a, 20) * _dec(b, right_digits) > _dec(c, 20) * _dec(d, right_digits)
        )
    )


def exact_equal(a: Column, b: Column, c: Column, d: Column, right_digits: int = 10) -> Column:
    """``a*b == c*d`` exactly, for non-negative integer columns."""
    left, right = a.cast("double") * b.cast("double"), c.cast("double") * d.cast("double")
    far = (left > right * (1.0 + _CERTAIN)) | (left < right * (1.0 - _CERTAIN))
    return F.when(far, F.lit(False)).otherwise(
        _dec(a, 20) * _dec(b, right_digits) == _dec(c, 20) * _dec(d, right_digits)
    )


def reject_mask(p_target: Column, p_ref: Column, t_norm: Column, r_norm: Column) -> Column:
    """Valid frame whose normalised power ratio exceeds one; a tie keeps."""
    return F.coalesce((p_ref > 0) & exact_greater(p_target, r_norm, p_ref, t_norm), F.lit(False))


def wide_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """``a*b > c*d`` exactly for integers from 0 up, ``a`` and ``c`` below 10**24, ``b`` and ``d`` below 2**64; the products pass the 38
    digits of a decimal.

    The right factors are split into limbs of nine digits.  With ``high`` the difference of the products by the upper limbs and
    ``low`` that by the lower ones, the sign is that of ``high * 10**9 + low``, where ``low`` stays below 10**33: ``high`` decides alone
    from 10**24 on, and below that the sum fits."""
    limb = F.lit(10**9).cast("decimal(10,0)")

    def parts(x: Column, y: Column) -> tuple[Column, Column]:
        low = (_dec(y, 20) % limb).cast("decimal(10,0)")
        high = ((_dec(y, 20) - low) / limb).cast("decimal(12,0)")
        return _dec(x, 24) * high, _dec(x, 24) * low

    (left_high, left_low), (right_high, right_low) = parts(a, b), parts(c, d)
    high, low = left_high - right_high, left_low - right_low
    return F.when(F.abs(high) >= F.lit(str(10**24)).cast("decimal(25,0)"), high > 0).otherwise(high.cast("decimal(25,0)") * limb + low > 0)


def rational_mask(p_target: Column, p_ref: Column, half_num: Column, half_den: Column) -> Column:
    """``p_target/p_ref > half_num/half_den`` exactly, for powers of up to 24 digits and thresholds of up to 64 bits; near ties alone pay for limbs."""
    left = p_target.cast("double") * half_den.cast("double")
    right = p_ref.cast("double") * half_num.cast("double")
    over = (F.when(left > right * (1.0 + _CERTAIN), F.lit(True)).when(left < right * (1.0 - _CERTAIN), F.lit(False))
            .otherwise(wide_greater(p_target, half_den, p_ref, half_num)))
    return F.coalesce((p_ref > 0) & over, F.lit(False))


def rational_overflow(half_num: Column, half_den: Column) -> Column:
    """True where a threshold is beyond the 63 bits of a stored one."""
    limit = F.lit(str(2**63)).cast("decimal(20,0)")
    return (half_num >= limit) | (half_den >= limit)


def coarse_ratio(p_target: Column, p_ref: Column) -> Column:
    """``2*p_target/p_ref``, undefined on a zero denominator."""
    return F.when(p_ref > 0, F.lit(2.0) * p_target.cast("double") / p_ref.cast("double"))


def null_ratio(t_norm: Column, r_norm: Column) -> Column:
    return F.when(r_norm > 0, F.lit(2.0) * t_norm.cast("double") / r_norm.cast("double"))


def normalized_ratio(p_target: Column, p_ref: Column, t_norm: Column, r_norm: Column) -> Column:
    return F.when(
        (p_ref > 0) & (t_norm > 0),
        p_target.cast("double") * r_norm.cast("double")
        / (p_ref.cast("double") * t_norm.cast("double")),
    )
