"""How alike two lists of words are, in order, as a native fold.

The longest common subsequence is found bit by bit in parallel: one bit for each word of the first list says whether it is still free, and each word of the
second list takes one addition and a few masks. Words beyond 60 go to further limbs of the same state, with the addition's carry handed on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a limb: sums of two limbs and a carry stay within 64 bits.
LIMB = 60
FULL = (1 << LIMB) - 1


def common_length(a: Column, b: Column, most: int) -> Column:
    """The length of the longest common subsequence of two arrays, ``a`` of at most ``most`` elements. Nulls inside are equal; null for a null array."""
    limbs = range(max(1, -(-most // LIMB)))
    long = lambda n: F.lit(n).cast("bigint")

    def mask(x: Column, limb: int) -> Column:
        """The places of the limb's part of ``a`` that hold ``x``."""
        start = F.struct(long(0).alias("mask"), long(1).alias("bit"))
        step = lambda s, y: F.struct((s["mask"] + F.when(y.eqNullSafe(x), s["bit"]).otherwise(long(0))).alias("mask"), (s["bit"] * 2).alias("bit"))
        return F.aggregate(F.slice(a, limb * LIMB + 1, LIMB), start, step)["mask"]

    def taken(state: Column, held: Column) -> Column:
        carry, after = long(0), []
        for i in limbs:
            own, hit = state[f"v{i}"], state[f"v{i}"].bitwiseAND(held[f"m{i}"])
            total = own + hit + carry
            after.append(total.bitwiseAND(long(FULL)).bitwiseOR(own.bitwiseAND(F.bitwise_not(hit))).alias(f"v{i}"))
            carry = F.shiftright(total, LIMB)
        return F.struct(*after)

    masks = F.transform(b, lambda x: F.struct(*(mask(x, i).alias(f"m{i}") for i in limbs)))
    free = F.aggregate(masks, F.struct(*(long(FULL).alias(f"v{i}") for i in limbs)), taken)
    matched = F.transform(F.array(free), lambda s: sum((LIMB - F.bit_count(s[f"v{i}"]) for i in limbs), F.lit(0)))
    return F.when(a.isNotNull() & b.isNotNull(), F.get(matched, F.lit(0)))


def edit_ratio(a: Column, b: Column, most: int) -> Column:
    """Twice the common subsequence of two arrays over both lengths: 1 for equal ones and for two empty ones, 0 without a common word."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2 * common_length(a, b, most) / both)
