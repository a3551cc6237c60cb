"""Check digits and structure tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dihedral() -> tuple[list[int], list[int]]:
    """Product table of the symmetries of a pentagon, and the powers of the
    permutation that the Verhoeff scheme applies by position; both flat."""

    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else (a + b - 5) % 5 + 5
        return (a - b) % 5 + 5 if b < 5 else (a - b) % 5

    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers, now = [], list(range(10))
    for _ in range(8):
        powers += now
        now = [turn[x] for x in now]
    return [product(a, b) for a in range(10) for b in range(10)], powers


PRODUCT, POWERS = _dihedral()
INVERSE = [0, 4, 3, 2, 1, 5, 6, 7, 8, 9]


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _verhoeff(digits: Column, first: int) -> Column:
    """Fold over the digits from the right; ``first`` is the position of the last."""
    product = F.array(*[F.lit(x) for x in PRODUCT])
    powers = F.array(*[F.lit(x) for x in POWERS])
    cells = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    placed = F.transform(cells, lambda d, i: F.get(powers, ((i + first) % 8) * 10 + d))
    return F.aggregate(placed, F.lit(0), lambda acc, d: F.get(product, acc * 10 + d))


def verhoeff_valid(text: Column, length: int = 12) -> Column:
    digits = only_digits(text)
    return F.when(F.length(digits) == length, _verhoeff(digits, 0) == 0).otherwise(F.lit(False))


def verhoeff_digit(text: Column) -> Column:
    """The digit that makes ``text`` and it a valid number."""
    return F.get(F.array(*[F.lit(x) for x in INVERSE]), _verhoeff(only_digits(text), 1))


def luhn_valid(text: Column, least: int = 12, most: int = 19) -> Column:
    digits = only_digits(text)
    return F.length(digits).between(least, most) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def luhn_digit(text: Column) -> Column:
    """The digit that makes ``text`` and it pass the Luhn test."""
    cells = F.transform(F.filter(F.split(F.reverse(only_digits(text)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(cells, lambda d, i: F.when(i % 2 == 0, (2 * d) % 10 + F.floor(2 * d / 10).cast("int")).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return (10 - total % 10) % 10


def pan_valid(text: Column) -> Column:
    return F.upper(text).rlike("^[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]$")
