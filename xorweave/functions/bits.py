"""Columns over unsigned 64-bit keys, held as BIGINT bit patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(2**63)


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def left_mask(n: int) -> int:
    """The top n of 64 bits."""
    return signed(((1 << n) - 1) << (64 - n)) if n > 0 else 0


def right_mask(n: int) -> int:
    """The low n of 64 bits."""
    return signed((1 << n) - 1) if n > 0 else 0


def msb(x: Column, k: int, width: int = 64) -> Column:
    """The top k bits of a key of ``width`` bits; 0 if k is 0 or less."""
    return F.shiftrightunsigned(x, width - k) if k > 0 else F.lit(0).cast("long")


def rotate_left(x: Column, k: int) -> Column:
    k %= 64
    return F.shiftleft(x, k).bitwiseXOR(F.shiftrightunsigned(x, 64 - k)) if k else x


def unsigned_order(x: Column) -> Column:
    """Sorts as the key does without a sign."""
    return x.bitwiseXOR(F.lit(SIGN))


def hex16(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def vector_text(x: Column, n: int = 64) -> Column:
    """The top n bits in brackets, a space for each zero."""
    return F.concat(F.lit("["), F.translate(F.substring(F.lpad(F.bin(x), 64, "0"), 1, n), "0", " "), F.lit("]"))


def trailing_zeros(x: Column) -> Column:
    """Zero bits below the lowest one; 64 for 0."""
    low = F.bit_count((x.bitwiseAND(-x)) - 1)
    return F.when(x == 0, 64).when(x == F.lit(SIGN), 63).otherwise(low).cast("int")


def matvec(x: Column, rows: list[int]) -> Column:
    """The XOR of rows[i] over the set bits i of x: a GF(2) matrix times a vector."""
    terms = [F.when(F.getbit(x, F.lit(i)) == 1, F.lit(signed(r))).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rows)]
    return reduce(lambda a, b: a.bitwiseXOR(b), terms)


def byte_tables(x: Column, rows: list[int]) -> Column:
    """As ``matvec``, for up to 64 rows, by a table of 256 sums for each byte of x: eight lookups in place of 64 tests."""
    found = []
    for byte in range(0, len(rows), 8):
        own = [0]
        for row in rows[byte : byte + 8]:
            own += [row ^ v for v in own]
        table = F.expr(f"array({', '.join(f'{signed(v)}L' for v in own)})")
        found.append(F.get(table, F.shiftrightunsigned(x, byte).bitwiseAND(F.lit(len(own) - 1)).cast("int")))
    return reduce(lambda a, b: a.bitwiseXOR(b), found, F.lit(0).cast("long"))


def parity_bits(x: Column, masks: list[int]) -> Column:
    """A number whose bit i is the parity of the bits of x under masks[i]: a linear map over GF(2)."""
    bits = [F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(signed(m)))).bitwiseAND(F.lit(1)).cast("long"), i) for i, m in enumerate(masks)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))


def hash_key(tag: str, ident: Column, bits: int) -> Column:
    """The first 60 bits of sha256(tag || id), masked to the low ``bits``."""
    digest = F.sha2(F.concat(F.lit(tag), ident.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").bitwiseAND(F.lit(right_mask(bits)))


def word(digest_hex: Column, i: int) -> Column:
    """The i-th 32-bit word of a digest in hex, bytes in the order of the text."""
    return F.conv(F.substring(digest_hex, 8 * i + 1, 8), 16, 10).cast("long")


def score(xored_hex: Column) -> Column:
    """Trailing zero bits of word 4 of an XOR of digests (32 if it is 0)."""
    x = word(xored_hex, 4)
    return F.when(x == 0, 32).otherwise(F.bit_count(x.bitwiseAND(-x) - 1)).cast("int")


def xor_hex(*digests: Column) -> Column:
    """XOR of 32-byte digests in hex."""
    words = [reduce(lambda a, b: a.bitwiseXOR(b), [word(d, i) for d in digests]) for i in range(8)]
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 8, "0") for w in words])
