"""The integer codes that a bit-packed index would use: lengths, and codes as strings of bits and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(n: Column) -> Column:
    return F.length(F.bin(n + 1))


def gamma_bits(n: Column) -> Column:
    """Bits of the Elias gamma code of n + 1."""
    return 2 * (_digits(n) - 1) + 1


def digits(n: np.ndarray) -> np.ndarray:
    """Binary digits of n + 1, as in the codes, of whole numbers outside Spark; a negative one has 64."""
    x = (n.astype(np.int64) + 1).view(np.uint64)
    high = x >> np.uint64(32)
    low = np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]  # exact: halves of 32 bits
    return np.maximum(1, np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low)).astype(np.int64)


def gamma_sizes(n: np.ndarray) -> np.ndarray:
    """gamma_bits outside Spark."""
    return 2 * digits(n) - 1


def vbyte_sizes(n: np.ndarray) -> np.ndarray:
    """vbyte_bits outside Spark."""
    return 8 * -(-digits(n) // 7)


def vbyte_bits(n: Column) -> Column:
    """Bits of the variable-byte code of n + 1, seven to the byte."""
    return (8 * F.ceil(_digits(n) / 7)).cast("int")


def gaps(values: Column) -> Column:
    """Differences of an ascending array, the first from 0."""
    return F.transform(values, lambda v, i: v - F.when(i == 0, F.lit(0)).otherwise(F.element_at(values, F.greatest(i, F.lit(1)).cast("int"))))


def gamma_code(n: Column) -> Column:
    """The Elias gamma code of n + 1 as a string of 0 and 1: as many ones as digits follow the leading one, a zero, those digits."""
    rest = F.substring(F.bin(n + 1), F.lit(2), _digits(n) - 1)
    return F.concat(F.repeat(F.lit("1"), _digits(n) - 1), F.lit("0"), rest)


def gamma_value(code: Column) -> Column:
    """The n of a gamma code."""
    k = F.instr(code, "0") - 1
    return F.conv(F.concat(F.lit("1"), F.substring(code, k + 2, k)), 2, 10).cast("bigint") - 1


def vbyte_code(n: Column) -> Column:
    """The variable-byte code of n + 1 as a string of 0 and 1: bytes of seven digits, the least first, each but the last marked by a leading 1."""
    count = F.ceil(_digits(n) / 7).cast("int")
    digits = F.lpad(F.bin(n + 1), count * 7, F.lit("0"))
    byte = lambda i: F.concat(F.when(i < count, F.lit("1")).otherwise(F.lit("0")), F.substring(digits, (count - i) * 7 + 1, F.lit(7)))
    return F.array_join(F.transform(F.sequence(F.lit(1), count), byte), "")


def vbyte_value(code: Column) -> Column:
    """The n of a variable-byte code."""
    count = F.ceil(F.length(code) / 8).cast("int")
    digits = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(code, (count - i) * 8 + 2, F.lit(7))), "")
    return F.conv(digits, 2, 10).cast("bigint") - 1


def text_code(text: Column) -> Column:
    """A string as its variable-byte length in bytes and the bytes, in bits."""
    raw = F.transform(F.sequence(F.lit(1), F.length(F.hex(text))), lambda i: F.lpad(F.conv(F.substring(F.hex(text), i, F.lit(1)), 16, 2), F.lit(4), F.lit("0")))
    return F.concat(vbyte_code(F.octet_length(text)), F.when(F.octet_length(text) > 0, F.array_join(raw, "")).otherwise(F.lit("")))


def text_value(code: Column) -> Column:
    """The string of a text code."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.substring(code, i * 8 + 1, F.lit(1)))  # a length takes five bytes at most
    head = F.array_position(marks, "0").cast("int") * 8
    size = vbyte_value(F.substring(code, F.lit(1), head))
    nibbles = F.transform(F.sequence(F.lit(0), F.greatest(size * 2 - 1, F.lit(0))), lambda i: F.conv(F.substring(code, head + i.cast("int") * 4 + 1, F.lit(4)), 2, 16))
    return F.when(size == 0, F.lit("")).otherwise(F.decode(F.unhex(F.array_join(nibbles, "")), "UTF-8"))
