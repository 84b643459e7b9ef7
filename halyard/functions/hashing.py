"""Keyed digests, composed from built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_bytes(text: str) -> bytes:
    """A hexadecimal key, with or without 0x and dashes; an odd number of digits starts with a 0."""
    digits = text.removeprefix("0x").removeprefix("0X").replace("-", "")
    return bytes.fromhex("0" * (len(digits) % 2) + digits)


def show_key(key: bytes) -> str:
    """A 16-byte key in groups of 8-4-4-4-12 digits."""
    if len(key) != 16:
        raise ValueError(f"a key has 16 bytes, not {len(key)}")
    h = key.hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def hex_to_bytes(c: Column) -> Column:
    digits = F.replace(F.regexp_replace(c, "^0[xX]", ""), F.lit("-"), F.lit(""))
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits))


def hmac_hex(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the text as hexadecimal digits."""
    if len(key) > 64:
        raise ValueError("keys of over 64 bytes are not supported")
    block = key.ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in block) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), c.cast("binary")), 256))), 256)


def scale_hash(c: Column, key: bytes, low: int, high: int) -> Column:
    """The first 48 bits of the digest as a fraction of the range, cut to a whole number."""
    fraction = F.conv(F.substring(hmac_hex(c, key), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return (fraction * (high - low)).cast("int") + low


_BASE = 10**8
#: the powers of 2^32 as five limbs of eight decimal digits each, lowest first
_POWERS = tuple(tuple((1 << 32 * i) // _BASE**j % _BASE for j in range(5)) for i in range(4))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, in lambdas too, where equal expressions are not shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decimal_of(digits: Column) -> Column:
    """The decimal digits of 32 hexadecimal ones: each limb of eight decimal digits is a sum over words of 32 bits, and what is over goes to the next."""
    words = F.array(*(F.conv(F.substring(digits, 25 - 8 * i, 8), 16, 10).cast("long") for i in range(4)))
    div = lambda x: F.call_function("div", x, F.lit(_BASE).cast("long"))

    def sums(w: Column) -> Column:
        return F.array(*(reduce(lambda a, b: a + b, [F.get(w, F.lit(i)) * F.lit(_POWERS[i][j]).cast("long") for i in range(4) if _POWERS[i][j]], F.lit(0).cast("long")) for j in range(5)))

    def shown(s: Column) -> Column:
        limbs, over = [], F.lit(0).cast("long")
        for j in range(5):
            limb = F.get(s, F.lit(j)) + over
            limbs.append(limb % F.lit(_BASE).cast("long"))
            over = div(limb)
        head, middle = (limbs[j + 1] * F.lit(_BASE).cast("long") + limbs[j] for j in (3, 1))
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.regexp_replace(F.concat(head.cast("string"), pad(middle, 16), pad(limbs[0], 8)), "^0+(?=.)", "")

    return F.when(digits.isNotNull(), _with(words, lambda w: _with(sums(w), shown)))


def uid_hash(c: Column, key: bytes) -> Column:
    """A pseudonym of an identifier: the first 16 bytes of its digest as a random-type UUID (version 4, variant 10) under 2.25; blank gives null."""

    def uuid(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(F.substring(h, 1, 12), F.lit("4"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))

    digits = _with(hmac_hex(c, key), uuid)
    return F.when(F.length(F.trim(c)) > 0, F.concat(F.lit("2.25."), _with(digits, decimal_of)))
