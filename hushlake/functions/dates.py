"""Dates in the spellings that forms use; day first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _month(word: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.left(F.lower(word), F.lit(3)))


def _made(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def parsed(text: Column) -> Column:
    """yyyy-mm-dd, dd/mm/yyyy, "3 March 2024", "March 3, 2024"; else null."""
    t = F.trim(text)
    iso, dmy = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", "^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$"
    name = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
    dmon, mond = f"(?i)^([0-9]{{1,2}})\\s+{name}\\.?,?\\s+([0-9]{{4}})$", f"(?i)^{name}\\.?\\s+([0-9]{{1,2}}),?\\s+([0-9]{{4}})$"
    g = lambda p, k: F.regexp_extract(t, p, k)
    return (
        F.when(t.rlike(iso), _made(g(iso, 1), g(iso, 2), g(iso, 3)))
        .when(t.rlike(dmy), _made(g(dmy, 3), g(dmy, 2), g(dmy, 1)))
        .when(t.rlike(dmon), _made(g(dmon, 3), _month(g(dmon, 2)), g(dmon, 1)))
        .when(t.rlike(mond), _made(g(mond, 3), _month(g(mond, 1)), g(mond, 2)))
    )


def iso_date(text: Column) -> Column:
    """ISO form of what parses; anything else stays as it is."""
    return F.coalesce(F.date_format(parsed(text), "yyyy-MM-dd"), text)


def is_future(text: Column, today: Column) -> Column:
    return F.coalesce(parsed(text) > today, F.lit(False))
