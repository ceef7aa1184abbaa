"""A bounded bitmap of hashed keys, so that rows which cannot match a key set stay out of a join's shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per key, and bits of the bitmap at least and at most, as powers of two (at most 8 MB).
PER_KEY, LEAST, MOST = 4, 15, 26


def sieve(keys: DataFrame, key: str, most: int = MOST) -> Callable[[Column], Column]:
    """A test that is true for every value of the bigint column ``key`` and for few others.

    The bitmap holds ``2 ** most`` bits however many keys there are: with more
    keys it lets more rows through, and with far more, all of them.  An exact join
    has to follow.  Null is never let through.
    """
    bits = min(max((max(keys.count(), 1) - 1).bit_length() + PER_KEY, LEAST), most)
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    at = keys.select(place(F.col(key)).alias("p"))
    # the built-in bitmaps have 2 ** 15 bits each
    found = at.groupBy(F.shiftright("p", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("b")).collect()
    held = bytearray(1 << (bits - 3))
    for r in found:
        held[r["k"] * 4096 : r["k"] * 4096 + 4096] = r["b"]
    bitmap = F.lit(bytes(held))

    def test(c: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place(c), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return c.isNotNull() & (F.getbit(byte, place(c).bitwiseAND(F.lit(7)).cast("int")) == 1)

    return test
