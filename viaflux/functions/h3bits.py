"""Hexagonal cells of the H3 grid by bit arithmetic on 64-bit ids; texts are lower-case hex.

A cell holds mode 1 in bits 59-62, zeros in 56-58, its resolution in 52-55, the
base cell in 45-51, and 15 digits of three bits, those below its resolution 7.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base cells that are pentagons.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def to_long(cell: Column) -> Column:
    """The id of a cell's text; null unless it is hex of 16 digits at most."""
    t = F.lower(F.trim(cell))
    return F.when(t.rlike("^[0-7]?[0-9a-f]{1,15}$"), F.conv(t, 16, 10).try_cast("long"))


def to_text(v: Column) -> Column:
    return F.lower(F.hex(v))


def long_resolution(v: Column) -> Column:
    return F.shiftright(v, 52).bitwiseAND(F.lit(15)).cast("int")


#: The lowest bit of each of the 15 digits.
_ONES = sum(1 << 3 * k for k in range(15))
_DIGITS = (1 << 45) - 1


def long_valid(v: Column) -> Column:
    """Whether an id is a cell; false for null.

    Unused digits are all ones; among the used ones none is 7, which shows as
    a bit that its two neighbours share; on a pentagon the first that isn't 0
    may not be 1, so its highest set bit may not be a digit's lowest.
    """
    unused = 3 * (15 - long_resolution(v))
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), unused) - 1
    used = F.call_function("shiftright", v.bitwiseAND(F.lit(_DIGITS)), unused)
    sevens = F.call_function("shiftright", v.bitwiseAND(F.shiftright(v, 1)).bitwiseAND(F.shiftright(v, 2)).bitwiseAND(F.lit(_ONES)), unused)
    base = F.shiftright(v, 45).bitwiseAND(F.lit(127))
    head = (v >= 0) & (F.shiftright(v, 56) == 8) & (base <= 121)
    bent = base.isin(*PENTAGONS) & (used > 0) & (F.length(F.bin(used)) % 3 == 1)
    return F.coalesce(head & (v.bitwiseAND(ones) == ones) & (sevens == 0) & ~bent, F.lit(False))


def once(value: Column, f) -> Column:
    """f(value), the value being evaluated once however often f names it, also where a filter is pushed below its column."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def valid(cell: Column) -> Column:
    return once(to_long(cell), long_valid)


def resolution(cell: Column) -> Column:
    """The resolution of a valid cell's text, else null."""
    return once(to_long(cell), lambda v: F.when(long_valid(v), long_resolution(v)))


def long_parent(v: Column, res: int) -> Column:
    """The ancestor at a resolution not above the cell's own; null where it is."""
    keep = ~((15 << 52) | ((1 << 3 * (15 - res)) - 1)) & ((1 << 63) - 1)
    parent = v.bitwiseAND(F.lit(keep)).bitwiseOR(F.lit((res << 52) | ((1 << 3 * (15 - res)) - 1)))
    return F.when(long_resolution(v) >= res, parent)


def parent(cell: Column, res: int) -> Column:
    """The text of a valid cell's ancestor; null for invalid cells and finer targets."""
    return once(to_long(cell), lambda v: F.when(long_valid(v), to_text(long_parent(v, res))))
