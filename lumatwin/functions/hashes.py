"""Hash texts as numbers, and distances between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_digits(text: Column, digits: int) -> Column:
    """The lower-case digits of a hash text, or null where it isn't usable.

    Outer white space, a label (``name:``, ``name=``) and ``0x`` may stand before the digits. There must be exactly
    ``digits`` of them, all hexadecimal and not all the same.
    """
    found = F.regexp_extract(text, rf"^[\s ]*(?:[A-Za-z][A-Za-z0-9_\-]*\s*[:=]\s*)?(?:0[xX])?([0-9a-fA-F]{{{digits}}})[\s ]*$", 1)
    found = F.lower(found)
    return F.when((found != "") & ~found.rlike(r"^(.)\1*$"), found)


def hex_long(digits: Column) -> Column:
    """16 hexadecimal digits as a 64-bit number."""
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hash_long(text: Column) -> Column:
    """A perceptual hash text as a 64-bit number, null where unusable."""
    return hex_long(hex_digits(text, 16))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def hex_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal texts of one length up to 16; null for empty, unequal or other texts."""
    a, b = F.lower(a), F.lower(b)
    ok = (F.length(a) > 0) & (F.length(a) == F.length(b)) & a.rlike("^[0-9a-f]{1,16}$") & b.rlike("^[0-9a-f]{1,16}$")
    pad = lambda x: hex_long(F.lpad(x, 16, "0"))
    return F.when(ok, hamming(pad(a), pad(b)))


def similarity_score(distances: list[tuple[Column, float]]) -> Column:
    """Weighted mean of 2^(-d/8) over the distances that are there; 0 where none is."""
    total = reduce(lambda x, y: x + y, [F.when(d.isNotNull(), F.lit(w)).otherwise(0.0) for d, w in distances])
    score = reduce(lambda x, y: x + y, [F.coalesce(F.pow(F.lit(2.0), -d / 8.0) * w, F.lit(0.0)) for d, w in distances])
    return F.when(total > 0, score / total).otherwise(0.0)
