"""Vectors of bits packed into 64-bit words, a 64th of the room: packing, counting and comparing without leaving the JVM.

Bit i of a vector is bit i % 64 of word i // 64; bits beyond the width are zero. Functions take vectors of one width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def words_in(width: int) -> int:
    return -(-width // WORD)


def pack(x: Column | str, width: int) -> Column:
    """The words of a vector of zeros and ones; what isn't zero or null is a one."""
    x = F.col(x) if isinstance(x, str) else x
    bit = lambda v: F.coalesce((v != 0).cast("bigint"), F.lit(0))

    def word(k: Column) -> Column:
        own = F.reverse(F.slice(x, k * WORD + 1, WORD))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda held, v: F.shiftleft(held, 1).bitwiseOR(bit(v)))

    return F.transform(F.sequence(F.lit(0), F.lit(words_in(width) - 1)), word)


def unpack(words: Column | str, width: int) -> Column:
    """The vector of zeros and ones."""
    words = F.col(words) if isinstance(words, str) else words
    at = lambda i: F.getbit(F.get(words, F.floor(i / WORD).cast("int")), (i % WORD).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: at(i).cast("double"))


def ones(words: Column | str) -> Column:
    """How many bits are set."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def apart(a: Column | str, b: Column | str) -> Column:
    """In how many places two vectors differ: the bits of their exclusive or."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.bitwiseXOR(v)), F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))
