"""Redaction operators as Column expressions: value in, replacement out.

A null replacement means that an operator cannot treat a value; or_else() then takes another one's."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much a replacement can give away, from most to least.
LEAK = {"recoverable": 0, "partial": 1, "irrecoverable": 2}


def erase(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(""))


def keep(value: Column) -> Column:
    return value


def mask(value: Column, char: str = "*", prefix: int = 0, suffix: int = 0) -> Column:
    """Every character but the kept ends; a value no longer than these stays as it is."""
    n = F.length(value)
    covered = F.concat(F.substring(value, 1, prefix), F.repeat(F.lit(char), n - prefix - suffix), F.right(value, F.lit(suffix)))
    return F.when(n <= prefix + suffix, value).otherwise(covered)


def replace(value: Column, label: Column, template: str = "[{label}]", coref: Column | None = None) -> Column:
    out = F.replace(F.lit(template), F.lit("{label}"), label)
    out = F.replace(out, F.lit("{value}"), value)
    return F.replace(out, F.lit("{coref}"), F.coalesce(coref if coref is not None else F.lit(None).cast("string"), F.lit("")))


def truncate(value: Column, prefix: int = 0, suffix: int = 0) -> Column:
    """The ends alone; an error where nothing would be dropped."""
    ends = F.concat(F.substring(value, 1, prefix), F.right(value, F.lit(suffix)))
    return F.when(F.length(value) <= prefix + suffix, F.raise_error(F.lit("truncate drops nothing")).cast("string")).otherwise(ends)


def sha2(value: Column, bits: int = 256, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), value).cast("binary"), bits)


def hmac(value: Column, key: bytes, bits: int = 256) -> Column:
    """RFC 2104 with two nested digests; the padded keys are literals."""
    block = 64 if bits == 256 else 128
    key = hashlib.new(f"sha{bits}", key).digest() if len(key) > block else key
    key = key.ljust(block, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), bits))), bits)


def encrypt(value: Column, key: bytes) -> Column:
    """AES-GCM with a random nonce: base64 of nonce, text and tag."""
    return F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM")))


def decrypt(value: Column, key: bytes) -> Column:
    """Null for a wrong key or for what encrypt() did not make."""
    raw = F.when(value.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(value) % 4 == 0), F.unbase64(value))
    return F.try_aes_decrypt(raw, F.lit(key), F.lit("GCM")).cast("string")


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def clamp(value: Column, floor: float | None = None, ceiling: float | None = None, floor_text: str = "<{n}", ceiling_text: str = "{n}+") -> Column:
    """Numbers from the ceiling on, and up to the floor, as a bound; null where no finite number is."""
    x = F.trim(value).try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    if ceiling is not None:
        out = out.when(x >= ceiling, F.lit(ceiling_text.replace("{n}", _number(ceiling))))
    if floor is not None:
        out = out.when(x <= floor, F.lit(floor_text.replace("{n}", _number(floor))))
    return out.otherwise(value)


ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
US = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?)?$"


def generalize_date(value: Column, to: str = "year", style: str | None = None) -> Column:
    """A date to its year, year_month or hour; ISO first, then month/day/year, in the style it came in.

    Null where no real date is, or for hours without a time."""
    v = F.trim(value)
    part = lambda rx, i: F.regexp_extract(v, rx, i)
    iso, us = v.rlike(ISO), v.rlike(US)
    y = F.when(iso, part(ISO, 1)).when(us, part(US, 3))
    m = F.when(iso, part(ISO, 2)).when(us, F.lpad(part(US, 1), 2, "0"))
    d = F.when(iso, part(ISO, 3)).when(us, F.lpad(part(US, 2), 2, "0"))
    h = F.when(iso, part(ISO, 4)).when(us, F.lpad(part(US, 4), 2, "0"))
    real = F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd").isNotNull() & ((h == "") | (h == "00") | (F.coalesce(h.try_cast("int"), F.lit(99)) < 24))
    slash = F.lit(style == "us") if style else us
    out = {"year": y, "year_month": F.when(slash, F.concat_ws("/", m, y)).otherwise(F.concat_ws("-", y, m)), "hour": F.when(F.length(h) == 2, F.when(slash, F.concat(F.concat_ws("/", m, d, y), F.lit(" "), h, F.lit(":00"))).otherwise(F.concat(F.concat_ws("-", y, m, d), F.lit("T"), h, F.lit(":00"))))}[to]
    return F.when((iso | us) & real, out)


def or_else(primary: Column, fallback: Column) -> Column:
    return F.coalesce(primary, fallback)


def surrogate(value: Column, label: Column, coref: Column | None = None, key: bytes = b"", prefix: str = "") -> Column:
    """A stable stand-in for (label, coref or value), from 128 bits of a keyed digest: equal on every node without a shared
    store."""
    who = F.coalesce(coref, value) if coref is not None else value
    digest = hmac(F.concat(label, F.lit("\x1f"), who), key)
    return F.concat(F.lit(prefix), F.upper(label), F.lit("_"), F.substring(digest, 1, 32))


def shape_preserving(value: Column, key: Column) -> Column:
    """A fake of the same shape: digits become digits, letters letters of their case, the rest stays; by digests of key, a
    new one for each 32 characters."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int"))
    digits = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(key, F.lit("\x1f"), b.cast("string")).cast("binary"), 256)), "")

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        low, high = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return F.when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike("^[a-z]$"), F.substring(low, (n % 26) + 1, 1)).when(c.rlike("^[A-Z]$"), F.substring(high, (n % 26) + 1, 1)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")
