"""Check digits and shapes of typed identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplication and permutation tables of the Verhoeff scheme.
_D = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7], [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3], [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]]
_P = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7], [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]]
_INV = [0, 4, 3, 2, 1, 5, 6, 7, 8, 9]


def _ints(rows: list) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in r]) if isinstance(r, list) else F.lit(r) for r in rows])


def digits(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda x: x.cast("int"))


def verhoeff(c: Column, offset: int = 0) -> Column:
    """Checksum of a digit string read from the right; 0 for a valid number (offset 1 without check digit)."""
    d, p = _ints(_D), _ints(_P)
    back = F.reverse(digits(c))
    pairs = F.transform(back, lambda x, i: F.struct(x.alias("x"), ((i + offset) % 8).alias("i")))
    return F.aggregate(pairs, F.lit(0), lambda acc, y: d[acc][p[y.i][y.x]])


def verhoeff_digit(c: Column) -> Column:
    return F.element_at(_ints(_INV), verhoeff(c, 1) + 1)


def luhn_digit(c: Column) -> Column:
    """Digit that makes c followed by it pass the Luhn check."""
    total = F.aggregate(F.transform(F.reverse(digits(c)), lambda x, i: F.when(i % 2 == 0, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def aba_sum(c: Column) -> Column:
    """Weighted sum 3, 7, 1 of a routing number's digits."""
    return F.aggregate(F.transform(digits(c), lambda x, i: x * F.element_at(F.array(F.lit(3), F.lit(7), F.lit(1)), (i % 3 + 1).cast("int"))), F.lit(0), lambda a, x: a + x)


def mod97(c: Column) -> Column:
    """Remainder by 97 of a digit string of any length."""
    return F.aggregate(digits(c), F.lit(0), lambda a, x: (a * 10 + x) % 97)


def iban_digits(c: Column) -> Column:
    """An IBAN's digits in check order: letters become 10 to 35."""
    moved = F.concat(F.substring(c, 5, 99), F.substring(c, 1, 4))
    return F.array_join(F.transform(F.split(moved, ""), lambda x: F.when(x.rlike("^[A-Z]$"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")


# Shapes of typed identifiers; of some only the digits count, however they are set.
SHAPES = {
    "credit_card": "^[0-9]{13,19}$",
    "routing_number": "^[0-9]{9}$",
    "aadhaar": "^[2-9][0-9]{11}$",
    "ssn": "^(00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])(0[1-9]|[1-9][0-9])([0-9]{3}[1-9]|[0-9]{2}[1-9]0|[0-9][1-9]00|[1-9]000)$",
    "ifsc_code": "^[A-Z]{4}0[A-Z0-9]{6}$",
    "swift_bic": "^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$",
    "iban": "^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$",
    "account_number": "^[0-9]{6,18}$",
}
DIGITS_ONLY = ("ssn", "account_number")


def shaped(c: Column, kind: str) -> Column:
    """Whether a value has the shape of its kind."""
    return (F.regexp_replace(c, "[^0-9]", "") if kind in DIGITS_ONLY else c).rlike(SHAPES[kind])


def valid(c: Column, kind: str) -> Column:
    """Whether a value has the shape and check digits of its kind; null for null."""
    shape = shaped(c, kind)
    extra = {
        "credit_card": F.call_function("luhn_check", c),
        "routing_number": aba_sum(c) % 10 == 0,
        "aadhaar": verhoeff(c) == 0,
        "iban": mod97(iban_digits(c)) == 1,
    }.get(kind)
    return shape if extra is None else F.when(shape, extra).otherwise(shape)
