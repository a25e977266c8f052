"""256-bit unsigned integers as columns: three limbs of 26 decimal digits, and the canonical decimal string.

A limb struct is struct<d2, d1, d0: decimal(26,0)>; the value is (d2 * 10^26 + d1) * 10^26 + d0. Everything is built-in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = str(10**26)
LIMBS = "struct<d2:decimal(26,0),d1:decimal(26,0),d0:decimal(26,0)>"
MAX_TEXT = str((1 << 256) - 1)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value named once: Catalyst would repeat its whole expression at each place where f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _significant(hex_text: Column) -> Column:
    """Lower-case hex digits without a 0x prefix and leading zeros."""
    return F.regexp_replace(F.lower(F.regexp_replace(hex_text, "^0[xX]", "")), "^0+", "")


def limbs_from_hex(hex_text: Column) -> Column:
    """Limbs of a big-endian hex number of any length; more than 256 bits saturate, empty is 0, other text gives null.

    The number is the sum of its eight 32-bit words times powers of 2^32, taken limb by limb: each product stays below 10^36.
    """
    s = _significant(hex_text)
    x = F.lpad(F.when(F.length(s) > 64, F.lit("f" * 64)).otherwise(s), 64, "0")

    def limb(words: Column, k: int) -> Column:
        parts = [(words[i], (1 << 32 * (7 - i)) // 10 ** (26 * k) % 10**26) for i in range(8)]
        return reduce(lambda a, b: (a + b).cast("decimal(38,0)"), [w * F.lit(str(c)).cast("decimal(26,0)") for w, c in parts if c]).cast("decimal(38,0)")

    words = let(x, lambda x: F.array(*[F.conv(F.substring(x, 1 + 8 * i, F.lit(8)), 16, 10).cast("decimal(10,0)") for i in range(8)]))
    sums = let(words, lambda w: F.struct(*[limb(w, k).alias(f"d{k}") for k in (2, 1, 0)]))
    return F.when(s.rlike("^[0-9a-f]*$"), carried(sums).cast(LIMBS))


def hex_to_text(hex_text: Column) -> Column:
    """The decimal string of limbs_from_hex; numbers below 2^60 without limbs."""
    s = _significant(hex_text)
    short = F.when(s.rlike("^[0-9a-f]*$"), F.coalesce(F.conv(s, 16, 10), F.lit("0")))
    return F.when(F.length(s) <= 15, short).otherwise(to_text(limbs_from_hex(hex_text)))


def limbs_from_decimal(text: Column) -> Column:
    """Limbs of a decimal string of up to 78 digits; other text gives null."""
    x = F.lpad(text, 78, "0")
    part = lambda k: F.substring(x, 1 + 26 * k, 26).cast("decimal(26,0)")
    return F.when(text.rlike("^[0-9]{1,78}$"), F.struct(part(0).alias("d2"), part(1).alias("d1"), part(2).alias("d0")))


def to_text(limbs: Column) -> Column:
    """The canonical decimal string."""
    digits = let(limbs, lambda v: F.concat(*[F.lpad(v[d].cast("string"), 26, "0") for d in ("d2", "d1", "d0")]))
    return F.regexp_replace(digits, "^0+(?=.)", "")


def carried(sums: Column) -> Column:
    """Limbs of sums of limbs (decimal(38,0) each)."""
    base = F.lit(BASE).cast("decimal(27,0)")
    low = lambda t: (t % base).cast("decimal(26,0)")
    over = lambda t: ((t - t % base) / base).cast("decimal(13,0)")
    first = let(sums, lambda s: F.struct(s.d2.alias("d2"), (s.d1 + over(s.d0)).cast("decimal(38,0)").alias("t1"), low(s.d0).alias("d0")))
    return let(first, lambda s: F.struct((s.d2 + over(s.t1)).cast("decimal(38,0)").alias("d2"), low(s.t1).alias("d1"), s.d0.alias("d0")))


def sum_limbs(limbs: Column) -> Column:
    """Aggregate: the exact sum of limbs, as limbs; up to 10^10 rows."""
    return carried(F.struct(*[F.sum(limbs[d]).alias(d) for d in ("d2", "d1", "d0")]))


def less(a: Column, b: Column) -> Column:
    """a < b: limb structs compare in the order d2, d1, d0."""
    return a < b
