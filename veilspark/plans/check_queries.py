"""Identifier checks over numbers made from keys, and each check's definition in DuckDB SQL.

Every customer key gives one candidate for each check; some pass, most fail. The query runs the checks that rules name;
the SQL spells each from the identifier's own definition."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.validators import IBAN_LENGTHS, VALIDATORS

KEY = "c_custkey"
SMALL, LARGE = 7919017, 99999999977  # factors that spread the keys over up to 11, and over more, digits


#: A column is made when a session is there.
Value = tuple[Callable[[], Column], str]


def _digits(n: int, shift: int = 0) -> Value:
    factor = SMALL if n < 12 else LARGE
    return lambda: F.lpad(((F.col(KEY) + shift) * factor % 10**n).cast("string"), n, "0"), f"lpad(CAST(({KEY} + {shift}) * {factor} % {10**n} AS VARCHAR), {n}, '0')"


def _letter(options: str, factor: int = 1) -> Value:
    at = f"CAST({KEY} * {factor} % {len(options)} AS BIGINT) + 1"
    return lambda: F.substring(F.lit(options), (F.col(KEY) * factor % len(options) + 1).cast("int"), F.lit(1)), f"substring('{options}', {at}, 1)"


def _text(s: str) -> Value:
    return lambda: F.lit(s), f"'{s}'"


def made(*parts: int | str | Value) -> Value:
    """A value in both languages: numbers are runs of digits, strings themselves."""
    each = [_digits(p) if isinstance(p, int) else _text(p) if isinstance(p, str) else p for p in parts]
    return lambda: F.concat(*[c() for c, _ in each]), "(" + " || ".join(s for _, s in each) + ")"


AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# In SQL; v is the value, places count from 1


def d(i: int) -> str:
    return f"CAST(v[{i}:{i}] AS INT)"


def dd(i: int) -> str:
    return f"CAST(v[{i}:{i + 1}] AS INT)"


def total(weights, first: int = 1) -> str:
    return "(" + " + ".join(f"{w} * {d(first + i)}" for i, w in enumerate(weights)) + ")"


def luhn(n: int, first: int = 1) -> str:
    doubled = lambda x: f"(2 * {x} - CASE WHEN {x} > 4 THEN 9 ELSE 0 END)"
    return "(" + " + ".join(doubled(d(first + n - 1 - j)) if j % 2 else d(first + n - 1 - j) for j in range(n)) + ")"


def cross(products: list[str]) -> str:
    return "(" + " + ".join(f"({p} // 10 + {p} % 10)" for p in products) + ")"


def product_check(n: int, first: int = 1) -> str:
    """Mod 11, 10: the last of n digits checks the others."""
    p = "10"
    for i in range(n - 1):
        p = f"(2 * (({d(first + i)} + {p} - 1) % 10 + 1) % 11)"
    return f"(11 - {p}) % 10 = {d(first + n - 1)}"


def dihedral(n: int) -> str:
    """Products in the symmetries of the pentagon, each digit permuted by its place."""
    table = [(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for a in range(10) for b in range(10)]
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    now, turned = "0", list(range(10))
    for i in range(n):
        now = f"({table}[{now} * 10 + {turned}[{d(n - i)} + 1] + 1])"
        turned = [step[x] for x in turned] if (i + 1) % 8 else list(range(10))
    return f"{now} = 0"


_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_HETU = "0123456789ABCDEFHJKLMNPRSTUVWXY"
_AT = lambda letters, place: f"substring('{letters}', CAST({place} AS BIGINT) + 1, 1)"
_ORD = lambda i: f"(ascii(v[{i}:{i}]) - 64)"

#: name, candidate, definition
DEFINED: list[tuple[str, Value, str]] = []


def _define() -> None:
    add = lambda name, value, sql: DEFINED.append((name, value, sql))
    add("luhn", made("4", 15), f"{luhn(16)} % 10 = 0")
    add("us.ssn", made(3, "-", _digits(2, 5), "-", _digits(4, 9)), f"CAST(v[1:3] AS INT) BETWEEN 1 AND 899 AND v[1:3] <> '666' AND {dd(5)} > 0 AND CAST(v[8:11] AS INT) > 0")
    add("us.aba_routing", made(9), f"{total([3, 7, 1] * 3)} % 10 = 0")
    add("us.npi", made("1", 9), f"(24 + {luhn(10)}) % 10 = 0")
    add("us.dea_number", made(_letter(AZ), _letter(AZ, 7), 7), f"({d(3)} + {d(5)} + {d(7)} + 2 * ({d(4)} + {d(6)} + {d(8)})) % 10 = {d(9)}")
    add("us.postal_code", made(_letter("01", 1), _letter("01", 1), "000"), "CAST(v AS INT) > 0")
    add("uk.nhs", made(10), f"{total(range(10, 0, -1))} % 11 = 0")
    add("uk.nino", made(_letter("ABGNTZK"), _letter("BGKNTZO", 3), 6, "A"), "v[2:2] <> 'O' AND v[1:2] NOT IN ('BG', 'GB', 'NK', 'KN', 'NT', 'TN', 'ZZ')")
    add("uk.vehicle_registration", made("AB", 2, "CDE"), f"{dd(3)} BETWEEN 2 AND 29 OR {dd(3)} BETWEEN 51 AND 79")
    add("uk.driving_licence", made(_letter("AB9"), _letter("CD9", 5), _letter("E9", 3), "99", 6, "AA1BC"), "regexp_full_match(v[1:5], '[A-Z]+9*')")
    add("de.bsnr", made(_letter("01"), "00000000"), "CAST(v AS BIGINT) > 0")
    add("de.lanr", made(9), f"(10 - {total([4, 9] * 3)} % 10) % 10 = {d(7)}")
    add("de.plz", made(_letter("019"), _letter("019", 3), "9", _letter("09", 5), _letter("09", 7)), "v[1:2] <> '00' AND v NOT IN ('01000', '99999')")
    add("de.health_insurance", made(_letter(AZ), 9), cross([f"({_ORD(1)} // 10 * 1)", f"({_ORD(1)} % 10 * 2)", *[f"({d(i)} * {1 + i % 2})" for i in range(2, 10)]]) + f" % 10 = {d(10)}")
    add("de.social_security", made(8, _letter(AZ), _digits(3, 4)), f"({dd(3)} BETWEEN 1 AND 31 OR {dd(3)} BETWEEN 51 AND 81) AND {dd(5)} BETWEEN 1 AND 12 AND " + cross([*[f"({d(i + 1)} * {w})" for i, w in enumerate([2, 1, 2, 5, 7, 1, 2, 1])], f"({_ORD(9)} // 10 * 2)", f"({_ORD(9)} % 10 * 1)", f"({d(10)} * 2)", f"({d(11)} * 1)"]) + f" % 10 = {d(12)}")
    add("de.tax_id", made(11), f"v[1:1] <> '0' AND {' AND '.join(f'''length(replace(v[1:10], '{x}', '')) >= 7''' for x in range(10))} AND {product_check(11)}")
    add("de.vat_id", made("DE", 9), product_check(9, 3))
    add("es.nif", made(8, _letter(_LETTERS, 11)), f"{_AT(_LETTERS, 'CAST(v[1:8] AS INT) % 23')} = v[9:9]")
    add("es.nie", made(_letter("XYZ"), 7, _letter(_LETTERS, 11)), f"{_AT(_LETTERS, '''(10000000 * (ascii(v[1:1]) - 88) + CAST(v[2:8] AS INT)) % 23''')} = v[9:9]")
    add("it.vat_code", made(11), f"CAST(v AS BIGINT) > 0 AND {luhn(11)} % 10 = 0")
    add("pl.pesel", made(11), f"{total([1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1])} % 10 = 0")
    add("pl.nip", made(10), f"{total([6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11 = {d(10)}")
    add("pl.regon", made(9), f"{total([8, 9, 2, 3, 4, 5, 6, 7])} % 11 % 10 = {d(9)}")
    add("pl.regon", made(14), f"{total([2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8])} % 11 % 10 = {d(14)}")
    add("au.abn", made(11), f"(10 * CASE WHEN {d(1)} = 0 THEN 9 ELSE {d(1)} - 1 END + {total(range(1, 20, 2), 2)}) % 89 = 0")
    add("au.acn", made(9), f"(10 - {total(range(8, 0, -1))} % 10) % 10 = {d(9)}")
    add("au.medicare", made(10), f"{d(1)} BETWEEN 2 AND 6 AND {total([1, 3, 7, 9] * 2)} % 10 = {d(9)}")
    add("au.tfn", made(9), f"{total([1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0")
    add("ca.sin", made(9), f"v[1:1] NOT IN ('0', '8') AND {luhn(9)} % 10 = 0")
    add("se.personnummer", made(10), f"{dd(3)} BETWEEN 1 AND 12 AND ({dd(5)} BETWEEN 1 AND 31 OR {dd(5)} BETWEEN 61 AND 91) AND {luhn(10)} % 10 = 0")
    add("se.organisationsnummer", made(10), f"{d(3)} >= 2 AND {luhn(10)} % 10 = 0")
    add("fi.hetu", made(_letter("12"), _letter("0123456789", 3), "0", _letter("0123456789", 7), _digits(2, 3), "-", 3, _letter(_HETU, 13)), f"TRY_CAST('19' || v[5:6] || '-' || v[3:4] || '-' || v[1:2] AS DATE) IS NOT NULL AND {_AT(_HETU, 'CAST(v[1:6] || v[8:10] AS BIGINT) % 31')} = v[11:11]")
    add("in.aadhaar", made(12), f"{d(1)} >= 2 AND v <> reverse(v) AND {dihedral(12)}")
    add("ng.nin", made(11), dihedral(11))
    add("in.pan", made("AB", _letter(AZ, 3), _letter(AZ), "K", 4, "Z"), "v[4:4] IN ('P', 'C', 'H', 'F', 'A', 'T', 'B', 'L', 'J', 'G')")
    add("kr.rrn", made(2, "0", _letter("123456789"), _letter("012"), _letter("123456789", 3), _letter("12345", 5), 6), f"{d(7)} BETWEEN 1 AND 4 AND {dd(3)} BETWEEN 1 AND 12 AND {dd(5)} BETWEEN 1 AND 31 AND {dd(8)} <= 95 AND (11 - {total([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])} % 11) % 10 = {d(13)}")
    add("kr.frn", made(2, "0", _letter("123456789"), _letter("012"), _letter("123456789", 3), _letter("45678", 5), 6), f"{d(7)} BETWEEN 5 AND 8 AND {dd(3)} BETWEEN 1 AND 12 AND {dd(5)} BETWEEN 1 AND 31 AND (13 - {total([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])} % 11) % 10 = {d(13)}")
    add("kr.brn", made(10), f"(10 - ({total([1, 3, 7, 1, 3, 7, 1, 3, 5])} + {d(9)} * 5 // 10) % 10) % 10 = {d(10)}")
    add("kr.driver_license", made(12), f"{dd(1)} BETWEEN 11 AND 26 OR {dd(1)} = 28")
    add("sg.nric", made(_letter("STFG"), 7, _letter("JZIHGFEDCBA", 3)), f"{_AT('JZIHGFEDCBA', f'({total([2, 7, 6, 5, 4, 3, 2], 2)} + CASE WHEN v[1:1] IN (chr(84), chr(71)) THEN 4 ELSE 0 END) % 11')} = v[9:9] AND v[1:1] IN ('S', 'T') OR {_AT('XWUTRQPNMLK', f'({total([2, 7, 6, 5, 4, 3, 2], 2)} + CASE WHEN v[1:1] IN (chr(84), chr(71)) THEN 4 ELSE 0 END) % 11')} = v[9:9] AND v[1:1] IN ('F', 'G')")
    add("sg.uen", made(8, _letter("XMKECAWLJDB", 3)), f"{_AT('XMKECAWLJDB', total([10, 4, 9, 3, 8, 2, 7, 1]) + ' % 11')} = v[9:9]")
    add("sg.uen", made(9, _letter("ZKCMDNERGWH", 3)), f"{_AT('ZKCMDNERGWH', total([10, 8, 6, 4, 9, 7, 5, 3, 1]) + ' % 11')} = v[10:10]")
    add("tr.tckn", made(11), f"{d(1)} > 0 AND (7 * {total([1, 0, 1, 0, 1, 0, 1, 0, 1])} - {total([0, 1, 0, 1, 0, 1, 0, 1])} + 100) % 10 = {d(10)} AND {total([1] * 10)} % 10 = {d(11)}")
    add("th.national_id", made(13), f"{d(1)} BETWEEN 1 AND 8 AND (11 - {total(range(13, 1, -1))} % 11) % 10 = {d(13)}")
    add("iban", made("NL", 2, "ABNA", 10), f"length(v) = {IBAN_LENGTHS['NL']} AND CAST('10112310' || v[9:18] || '2321' || v[3:4] AS HUGEINT) % 97 = 1")
    add("date", made("19", 2, "-", _digits(2, 4), "-", _digits(2, 11)), "TRY_CAST(v AS DATE) IS NOT NULL")
    add("ipv4", made(_letter("0123"), ".", _letter("26", 3), _letter("05", 5), _letter("0569", 7), ".1.", _letter("123456789")), "regexp_full_match(v, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')")


_define()


def checked(rows: DataFrame) -> DataFrame:
    """c_custkey, name, value and valid of each candidate."""
    candidates = F.array(*[F.struct(F.lit(name).alias("name"), value().alias("value")) for name, (value, _), _ in DEFINED])

    def run(batches):
        for batch in batches:
            ok = [bool(VALIDATORS[n](v, ())) for n, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], [*batch.schema.names, "valid"])

    return rows.select(KEY, F.inline(candidates)).mapInArrow(run, f"{KEY} long, name string, value string, valid boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col(KEY).cast("long").alias(KEY)))


ORACLE = " UNION ALL ".join(f"SELECT {KEY}, '{name}' AS name, v AS value, {sql} AS valid FROM (SELECT CAST({KEY} AS BIGINT) AS {KEY}, {value} AS v FROM customer)" for name, (_, value), sql in DEFINED)
