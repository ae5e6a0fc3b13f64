"""Scalar expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen. Where a DuckDB oracle must reproduce a value
bit-for-bit, the arithmetic is written in the same order in both places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Modulus and multipliers of the portable (id, seed) hash: products of a value
# below 2**31 and a multiplier below 2**31 stay far below 2**63.
HASH_P = 2147483629  # prime just below 2**31
HASH_ROUNDS = ((1103515245, 48271, 15), (1664525, 69621, 13), (22695477, 39373, 16))


def portable_hash(id_col: Column | str, seed: int | Column) -> Column:
    """Deterministic integer hash of (id, seed) in [0, HASH_P).

    Integer-only arithmetic, so any engine (DuckDB oracle included) computes the
    identical value (see ``portable_hash_sql``). Each round multiplies, adds a
    multiple of the seed modulo P, and xors the high bits into the low ones; the
    xor is not linear modulo P, so two seeds give unrelated orders."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    s = F.pmod((F.lit(seed) if isinstance(seed, int) else seed).cast("long"), F.lit(HASH_P))
    x = F.pmod(c.cast("long"), F.lit(HASH_P))
    for a, b, k in HASH_ROUNDS:
        x = (x * F.lit(a) + (s * F.lit(b)) % F.lit(HASH_P)) % F.lit(HASH_P)
        x = x.bitwiseXOR(F.shiftright(x, k))
    return x % F.lit(HASH_P)


def portable_hash_sql(id_expr: str, seed_expr: str) -> str:
    """DuckDB twin of ``portable_hash`` for non-negative ids and seeds."""
    x = f"(({id_expr})::BIGINT % {HASH_P})"
    for a, b, k in HASH_ROUNDS:
        x = f"(({x} * {a} + ((({seed_expr})::BIGINT % {HASH_P}) * {b}) % {HASH_P}) % {HASH_P})"
        x = f"xor({x}, {x} >> {k})"
    return f"({x} % {HASH_P})"


def bounded_round(c: Column | str, lo: float, hi: float, closed_right: bool = False) -> Column:
    """Equal-width binning of ``c`` into ``floor(hi - lo) + 1`` bins over [lo, hi].

    Returns 1..bins inside the range, 0 below ``lo`` and bins + 1 at or above
    ``hi`` (the reference behaviour, so a value equal to the top label moves
    one class up). ``closed_right=True`` folds ``hi`` itself into the last bin.
    """
    c = F.col(c) if isinstance(c, str) else c
    n = int(hi - lo) + 1
    b = F.width_bucket(c.cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(n))
    if closed_right:
        b = F.when(c.cast("double") == F.lit(float(hi)), F.lit(n).cast("long")).otherwise(b)
    return b


def half_even_round(c: Column | str) -> Column:
    """Round half to even (numpy / pandas ``round``), not Spark's half-up ``round``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(c.cast("double"), 0)


def relevel(c: Column | str, levels: int, top: int = 5) -> Column:
    """Linear rescale of a 1..top rating to 1..levels: 1 + (y-1)*(L-1)/(top-1)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lit(1.0) + (c.cast("double") - F.lit(1.0)) * F.lit(float(levels - 1)) / F.lit(float(top - 1))


def row_sum(cols: list[str]) -> Column:
    """Row-wise sum skipping nulls (pandas ``sum(axis=1)``): all-null rows give 0."""
    if not cols:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def erfc(x: Column) -> Column:
    """Complementary error function, Chebyshev fit with fractional error < 1.2e-7
    everywhere (Numerical Recipes ``erfcc``)."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    # Chebyshev coefficients of the erfc fit, highest order last.
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coef[-1])
    for a in reversed(coef[:-1]):
        poly = F.lit(a) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def normal_sf(z: Column | str) -> Column:
    """Upper-tail normal probability 1 - Phi(z) = erfc(z / sqrt 2) / 2."""
    z = F.col(z) if isinstance(z, str) else z
    return F.lit(0.5) * erfc(z / F.lit(2.0 ** 0.5))


def sig_level(p: Column | str) -> Column:
    """-1 (n.s.), 0 (p < .05), 1 (p < .01), 2 (p < .001)."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p < 0.001, 2).when(p < 0.01, 1).when(p < 0.05, 0).otherwise(-1)).cast("int")


def round_half_up(c: Column, digits: int) -> Column:
    """``F.round`` of a double, to the same double, without a decimal number for each value: multiplied, cut and
    divided as numbers; only a value so near to a tie (or so large) that its last bits could decide goes through ``F.round``."""
    scaled = F.abs(c) * F.lit(10.0 ** digits)
    near = F.floor(scaled + 0.5)
    plain = (scaled < 1e12) & (F.abs(scaled + 0.5 - near - 0.5) < 0.499)
    return F.when(plain, F.when(c < 0, -near).otherwise(near) / F.lit(10.0 ** digits)).otherwise(F.round(c, digits))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (for order-insensitive value comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_up(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only behind a size check.

    ``known_rows`` is a proven bound (e.g. number of classes); without it the
    rows are counted (one cheap job over an already-aggregated frame). Above the
    bound the frame is returned as is and Spark plans a shuffle join.
    """
    n = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if n <= max_rows else df


def fixed_decimals(c: Column | str, digits: int = 3) -> Column:
    """Deterministic fixed-point text of a non-negative number ('0.123').

    The value is first taken to integer micro-units (so float summation noise
    below 1e-6 cannot move a tie like 0.4925 either way), then rounded half up
    in integer arithmetic and formatted; no engine-specific float formatting."""
    c = F.col(c) if isinstance(c, str) else c
    micro = F.round(c * F.lit(1e6), 0).cast("long")
    step = 10 ** (6 - digits)
    n = F.floor((micro + F.lit(step // 2)) / F.lit(step)).cast("long")
    scale = 10 ** digits
    return F.concat(F.floor(n / scale).cast("long").cast("string"), F.lit("."),
                    F.lpad((n % scale).cast("string"), digits, "0"))
