"""Small Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_PREFIX = "LABEL-"
COLABEL_PREFIX = "COLABEL-"


def col(name: str) -> Column:
    """A column by its literal name; label names hold '-', '+' and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(value: float) -> Column:
    """A DOUBLE literal (plain literals such as 1.5 would be DECIMAL in SQL)."""
    return F.lit(float(value))


def null_if_nan(c: Column) -> Column:
    """Missing numbers are NULL everywhere after the source."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def half_even(c: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(c).cast("long")


def truncated(c: Column) -> Column:
    """Integer part, towards zero."""
    return c.cast("long")


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(c, high), low)


def min_max_scale(c: Column, low: Column, high: Column) -> Column:
    return F.try_divide(c - low, high - low)


def to_uint8(unit: Column) -> Column:
    """0..1 to 0..255, ties to even."""
    return F.rint(unit * number(255)).cast("int")


def natural_key(name: Column) -> Column:
    """Case-insensitive natural order: every digit run, without leading zeros, goes behind its length."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(part: Column) -> Column:
        run = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(run).cast("string"), 10, "0"), run)).otherwise(part)

    return F.array_join(F.transform(parts, key), "")


def rgb_from_packed(packed: Column) -> Column:
    """Packed 24-bit colour to three numbers in 0..1."""
    channel = lambda bits: F.shiftright(packed, bits).bitwiseAND(F.lit(255)) / number(255)
    return F.array(channel(16), channel(8), channel(0))


def resize_dims(
    height: Column,
    width: Column,
    size: tuple[int, int] | None = None,
    scale: float | None = None,
    keep_aspect: bool = False,
) -> tuple[Column, Column]:
    """Output (height, width); give either ``size`` or ``scale``."""
    if (size is None) == (scale is None):
        raise ValueError("give exactly one of size and scale")
    if size is None:
        out_h = truncated(height * number(scale))
        out_w = truncated(width * number(scale))
    else:
        out_h, out_w = F.lit(int(size[0])).cast("long"), F.lit(int(size[1])).cast("long")
    if keep_aspect:
        factor = F.greatest(
            F.try_divide(height.cast("double"), out_h.cast("double")),
            F.try_divide(width.cast("double"), out_w.cast("double")),
        )
        out_h = half_even(F.try_divide(height.cast("double"), factor))
        out_w = half_even(F.try_divide(width.cast("double"), factor))
    return out_h, out_w


def preview_box(x: Column, y: Column, side: int, width: Column, height: Column) -> Column:
    """A side x side box around a point, moved inside the image; struct(x0, y0, x1, y1)."""
    half = side // 2
    x0 = F.greatest(F.lit(0), F.least(truncated(x) - half, width - side))
    y0 = F.greatest(F.lit(0), F.least(truncated(y) - half, height - side))
    return F.struct(
        x0.alias("x0"),
        y0.alias("y0"),
        F.least(x0 + side, width).alias("x1"),
        F.least(y0 + side, height).alias("y1"),
    )


def structs_equal(a: Column, b: Column) -> Column:
    """NULL equals NULL, on whole structs."""
    return a.eqNullSafe(b)


def label_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(LABEL_PREFIX)]


def flag_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith((LABEL_PREFIX, COLABEL_PREFIX))]


# ---------------------------------------------------------------- hashed draws
# The generator is a 32-bit multiply/xor mix.  It never overflows a BIGINT, so the
# same numbers come out of Spark, of numpy (see functions.draws) and of plain SQL.
MIX_MULTIPLIER = 73244475
MIX_SAMPLE = 506952113
MIX_RESAMPLE = 40503
MIX_SEED = 69069
_WORD = 4294967296


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    A value named twice in an expression is written out twice, so a chain of such steps would
    double at every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mix(h: Column) -> Column:
    for _ in range(2):
        h = let(h, lambda x: F.pmod(x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * F.lit(MIX_MULTIPLIER), F.lit(_WORD)))
    return let(h, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 16)))


def draw62(seed: int, resample: Column, sample: Column) -> Column:
    """A pseudo-random 62-bit integer.  For one (seed, resample) it is a bijection of
    ``sample`` below 2**32, so draws never tie and an order by draw is a permutation."""
    r = F.pmod(resample.cast("long"), F.lit(_WORD))
    s = F.pmod(sample.cast("long"), F.lit(_WORD))

    def drawn(key: Column) -> Column:
        first = _mix(F.pmod(F.pmod(s * F.lit(MIX_SAMPLE), F.lit(_WORD)) + key, F.lit(_WORD)))
        low = lambda high: _mix(F.pmod(high + key * F.lit(3) + F.lit(1), F.lit(_WORD)))
        return let(
            _mix(F.pmod(first + key * F.lit(5) + F.lit(7), F.lit(_WORD)).bitwiseXOR(key)),
            lambda high: high * F.lit(1 << 30) + F.shiftrightunsigned(low(high), 2),
        )

    return let(_mix(F.pmod(r * F.lit(MIX_RESAMPLE) + F.lit((seed * MIX_SEED) % _WORD), F.lit(_WORD))), drawn)
