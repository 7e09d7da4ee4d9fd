"""Column functions over fingerprints: folding, packing, popcounts, Tanimoto.

A fingerprint is a sorted array of on-bits; its packed form is an array of 64-bit words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(digest: Column, n_bits: int) -> Column:
    """A hexadecimal digest modulo ``n_bits``."""
    if n_bits <= 0:
        raise ValueError(f"n_bits must be positive, not {n_bits}")
    if n_bits & (n_bits - 1) == 0 and n_bits <= 65536:
        return (F.conv(F.substring(digest, -4, 4), 16, 10).cast("int") % n_bits).cast("int")
    # Horner over seven hex digits at a time keeps every step within 64 bits
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(digest) - 1) / 7).cast("int")), lambda k: F.substring(digest, k * 7 + 1, F.lit(7)))
    step = lambda acc, p: (acc * F.call_function("shiftleft", F.lit(1).cast("long"), 4 * F.length(p)) + F.conv(p, 16, 10).cast("long")) % n_bits
    return F.aggregate(parts, F.lit(0).cast("long"), step).cast("int")


def on_bits(values: Column) -> Column:
    """Positions of the true entries of an array of booleans."""
    return F.filter(F.transform(values, lambda x, i: F.when(x, i).otherwise(-1)), lambda b: b >= 0)


def pack(bits: Column, n_bits: int) -> Column:
    """On-bits as ceil(n_bits / 64) words."""
    one = F.lit(1).cast("long")
    word = lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, b.cast("int") % 64)))
    return F.array(*(word(w) for w in range(-(-n_bits // 64))))


def unpack(words: Column, n_bits: int) -> Column:
    """Words as an array of on-bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda b: F.getbit(words[F.floor(b / 64).cast("int")], b % 64) == 1)


def popcount(words: Column, n_words: int) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(words[w]) for w in range(n_words)))


def tanimoto(a: Column, b: Column, n_words: int, empty: float = 0.0) -> Column:
    """Tanimoto similarity of two packed fingerprints; words are addressed one by one, which keeps the sum in generated code.

    ``empty`` is the value for two fingerprints without any bit.
    """
    both = reduce(lambda x, y: x + y, (F.bit_count(a[w].bitwiseAND(b[w])) for w in range(n_words)))
    any_ = reduce(lambda x, y: x + y, (F.bit_count(a[w].bitwiseOR(b[w])) for w in range(n_words)))
    return F.when(any_ == 0, F.lit(empty)).otherwise(both / F.nullif(any_, F.lit(0)))


def tanimoto_table(a: Column, b: Column, n_bits: int, value: Callable[[float], float]) -> Column:
    """``value`` of the Tanimoto similarity of two packed words of ``n_bits`` bits, looked up by their counts of common and of all bits:
    for what costs more than that for each pair, as rounding does."""
    every = [value(both / either if 0 < either >= both else 0.0) for both in range(n_bits + 1) for either in range(n_bits + 1)]
    return F.get(F.array(*map(F.lit, every)), F.bit_count(a.bitwiseAND(b)) * (n_bits + 1) + F.bit_count(a.bitwiseOR(b)))


def bitstring(bits: Column, n_bits: int) -> Column:
    """On-bits as text of 0 and 1."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.array_contains(bits, i).cast("int").cast("string")), "")


def check_binary(values: Column) -> Column:
    """The array itself, or an error if it holds anything but 0 and 1."""
    bad = F.exists(values, lambda x: ~x.isin(0, 1) | x.isNull())
    return F.when(bad, F.raise_error(F.lit("a binary fingerprint holds only 0 and 1"))).otherwise(values)
