"""Native forms of checks: Column expressions that stay in generated code.

Most identifiers are digits with weights and a modulus; these are built from one description. `value` may hold spaces
and hyphens, which are taken out first; any other character fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def only_digits(value: Column, extra: str = r"[\s-]") -> Column:
    return F.regexp_replace(value, extra, "")


def has_digits(plain: Column, *lengths: int) -> Column:
    return F.coalesce(plain.rlike("^[0-9]+$") & F.length(plain).isin(*lengths), F.lit(False))


def digit(plain: Column, i: int) -> Column:
    """The i-th digit (from 0)."""
    return F.substring(plain, i + 1, 1).try_cast("int")


def weighted_sum(plain: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        if w:
            total = total + digit(plain, i) * w
    return total


def mod_check(value: Column, weights: list[int], modulus: int, remainder: int = 0) -> Column:
    """Weighted digits leave the remainder; as many digits as weights."""
    p = only_digits(value)
    return has_digits(p, len(weights)) & F.coalesce(weighted_sum(p, weights) % modulus == remainder, F.lit(False))


def luhn(value: Column) -> Column:
    p = F.regexp_replace(value, "[ -]", "")
    return F.coalesce(value.rlike("^[0-9 -]+$") & p.rlike("[0-9]") & F.call_function("luhn_check", p), F.lit(False))


def ssn(value: Column) -> Column:
    p = F.regexp_replace(value, "[-. ]", "")
    a, b, c = (F.substring(p, *x).try_cast("int") for x in ((1, 3), (4, 2), (6, 4)))
    return F.coalesce(value.rlike(r"^[0-9]{3}[-. ][0-9]{2}[-. ][0-9]{4}$") & (a > 0) & (a < 900) & (a != 666) & (b > 0) & (c > 0), F.lit(False))


def aba_routing(value: Column) -> Column:
    return mod_check(value, [3, 7, 1] * 3, 10)


def npi(value: Column) -> Column:
    p = only_digits(value)
    return has_digits(p, 10) & ~p.rlike(r"^([0-9])\1{8}") & F.call_function("luhn_check", F.concat(F.lit("80840"), p))


def nhs(value: Column) -> Column:
    return mod_check(value, list(range(10, 0, -1)), 11)


def pesel(value: Column) -> Column:
    return mod_check(value, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1], 10)


def nip(value: Column) -> Column:
    p = only_digits(value)
    return has_digits(p, 10) & F.coalesce(weighted_sum(p, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11 == digit(p, 9), F.lit(False))


def abn(value: Column) -> Column:
    p = only_digits(value)
    first = F.when(digit(p, 0) == 0, 9).otherwise(digit(p, 0) - 1)
    return has_digits(p, 11) & F.coalesce((first * 10 + weighted_sum(p, [0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])) % 89 == 0, F.lit(False))


def tfn(value: Column) -> Column:
    return mod_check(value, [1, 4, 3, 7, 5, 8, 6, 9, 10], 11)


def acn(value: Column) -> Column:
    p = only_digits(value)
    return has_digits(p, 9) & F.coalesce((F.lit(10) - weighted_sum(p, list(range(8, 0, -1))) % 10) % 10 == digit(p, 8), F.lit(False))


def sin(value: Column) -> Column:
    p = only_digits(value)
    return has_digits(p, 9) & ~p.rlike("^[08]") & F.call_function("luhn_check", p)


def thai_id(value: Column) -> Column:
    p = only_digits(value)
    return has_digits(p, 13) & p.rlike("^[1-8]") & F.coalesce((F.lit(11) - weighted_sum(p, list(range(13, 1, -1))) % 11) % 10 == digit(p, 12), F.lit(False))


def iban(value: Column) -> Column:
    """The country's form and mod 97, folded over the characters."""
    from veilspark.functions.validators import IBAN_PATTERNS

    v = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    moved = F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))
    each = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).try_cast("int"))
    rest = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)
    return F.coalesce(v.rlike("^(?:" + "|".join(IBAN_PATTERNS.values()) + ")$") & (rest == 1), F.lit(False))


NATIVE = {"luhn": luhn, "us.ssn": ssn, "us.aba_routing": aba_routing, "us.npi": npi, "uk.nhs": nhs, "pl.pesel": pesel, "pl.nip": nip, "au.abn": abn, "au.tfn": tfn, "au.acn": acn, "ca.sin": sin, "th.national_id": thai_id, "iban": iban}
