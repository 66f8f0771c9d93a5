"""Hashes, hex, bit widths, flags, colours and texel sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bits of registry flags.
FLAGS = {"opaque": 1, "emissive": 2, "special": 4, "collidable": 8}
MASK = 4294967295


def fnv1a64(data: Column) -> Column:
    """FNV-1a of binary ``data`` as 16 lowercase hex digits, in time linear in its length; null for null.

    The state is two 32-bit words, so that nothing overflows. Bytes are taken from the hex digits, cut in pairs once.
    """
    digits = F.hex(data)
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))

    def step(s: Column, pair: Column) -> Column:
        low = s["lo"].bitwiseXOR(F.conv(pair, 16, 10).cast("bigint"))
        t = low * 435
        return F.struct((F.shiftright(t, 32) + s["hi"] * 435 + F.shiftleft(low, 8)).bitwiseAND(F.lit(MASK)).alias("hi"), t.bitwiseAND(F.lit(MASK)).alias("lo"))

    start = F.struct(F.lit(3421674724).cast("bigint").alias("hi"), F.lit(2216829733).cast("bigint").alias("lo"))
    return F.aggregate(pairs, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes; null if the length is odd or a sign is no hex digit."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def u64_hex(v: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(v))


def index_bits(n: Column) -> Column:
    """Bits that tell ``n`` values apart, one at least."""
    return F.when(n <= 2, 1).otherwise(F.length(F.bin(n - 1)))


def bit_width(n: Column) -> Column:
    """Bits that hold the number ``n`` itself, one at least."""
    return F.length(F.bin(F.greatest(n, F.lit(1))))


def align(v: Column, to: int) -> Column:
    return v + F.pmod(-v, F.lit(to).cast("bigint"))


def flag_bits(names: Column) -> Column:
    """Sum of the bits of an array of flag names; a name that is no flag's is an error."""
    known = sum((F.when(F.array_contains(names, n), b).otherwise(0) for n, b in FLAGS.items()), F.lit(0))
    strange = F.array_except(names, F.array(*map(F.lit, FLAGS)))
    return F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown registry flag: "), F.get(strange, F.lit(0)))).cast("int")).otherwise(known)


def hex_number(text: Column, fallback: Column) -> Column:
    """An unsigned 64-bit number, as decimal(20, 0), from hex digits with or without ``0x``; else ``fallback``."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.coalesce(F.when(digits.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(digits, 16, 10).cast("decimal(20,0)")), fallback.cast("decimal(20,0)"))


def flag_names(bits: Column) -> Column:
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in FLAGS.items())))


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return ((r * 256 + g) * 256 + b) * 256 + a


def channels(v: Column) -> list[Column]:
    return [F.shiftright(v, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)]


def mip_extent(base: Column, level: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.call_function("shiftright", base, level))


def is_printable(text: Column) -> Column:
    return F.is_valid_utf8(text) & ~text.rlike(r"[\x00-\x1f\x7f]")
