"""Columns evaluated once, and bit maps that are looked up inside arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map at most (8 MB).
BITS = 1 << 26


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x evaluated once a row: a column named inside a lambda is an expression that every element repeats."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def bit_map(hashes: DataFrame, col: str, n: int, most: int = BITS) -> tuple[Column, int]:
    """The distinct hashes (longs; n of them) as bits of one array of longs, and the number of bits: about a thousand bits
    a hash, so a share of 1 / 1024 of other hashes passes, up to ``most`` bits, beyond which more do.

    The map is a scalar subquery. Such a column can't be named inside a lambda; select it as a column of its own and name
    that once, through ``bound``: the optimizer then puts the subquery there and never copies the map into rows.
    """
    bits = 1 << min(most.bit_length() - 1, max(12, (1024 * n).bit_length()))
    slot = F.col(col).bitwiseAND(F.lit(bits - 1))
    marks = hashes.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({col} & 63 as int))")).alias("mark"))
    dense = hashes.sparkSession.range(bits // 64).join(marks, "id", "left").select(F.struct("id", F.coalesce("mark", F.lit(0).cast("long")).alias("mark")).alias("x"))
    return dense.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["mark"]).alias("map")).scalar(), bits


def held(map_: Column, bits: int, h: Column) -> Column:
    """Whether the map has h's bit."""
    return F.getbit(F.get(map_, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63))) == 1
