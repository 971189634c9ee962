"""Column forms of the 4+4-bit sample codec and bulk-mask words."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_offset(byte: Column) -> tuple[Column, Column]:
    """Offset-binary byte to (re, im), each in -8..7."""
    return (F.shiftright(byte, 4).bitwiseAND(15) - 8).cast("int"), (byte.bitwiseAND(15) - 8).cast("int")


def encode_offset(re: Column, im: Column) -> Column:
    return F.shiftleft(re + 8, 4).bitwiseOR(im + 8).cast("int")


def decode_twos(byte: Column) -> tuple[Column, Column]:
    """Two's-complement nibbles to (re, im)."""
    signed = lambda n: F.when(n >= 8, n - 16).otherwise(n).cast("int")
    return signed(F.shiftright(byte, 4).bitwiseAND(15)), signed(byte.bitwiseAND(15))


def repack(byte: Column) -> Column:
    """Between the two encodings, loss-free and its own inverse."""
    return byte.bitwiseXOR(0x88)


def mask_word(bin_index: Column) -> Column:
    return F.floor(bin_index / 64).cast("int")


def mask_bit(bin_index: Column) -> Column:
    """Bit of a bin inside its 64-bit word; the sign bit carries bin 63."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bin_index, F.lit(64)).cast("int"))
