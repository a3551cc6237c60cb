"""Synthetic identities and decoys from keys, by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import checksums

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOLDERS = "PCHFATBLJG"


def _number(key: Column, factor: int, low: int, span: int) -> Column:
    return ((key * factor) % span + low).cast("bigint").cast("string")


def _letter(key: Column, factor: int, of: str = LETTERS) -> Column:
    return F.substr(F.lit(of), ((key * factor) % len(of) + 1).cast("int"), F.lit(1))


def people(keys: DataFrame, key: str) -> DataFrame:
    """``key`` and values of every kind whose check digits hold."""
    k = F.col(key).cast("bigint")
    stem = _number(k, 7919, 20000000000, 79999999999)
    card = F.concat(F.lit("4"), F.lpad(_number(k, 104729, 0, 99999999999999), 14, "0"))
    pan = F.concat(*[_letter(k, f) for f in (3, 5, 7)], _letter(k, 11, HOLDERS), _letter(k, 13), F.lpad(_number(k, 17, 0, 10000), 4, "0"), _letter(k, 19))
    return keys.select(
        key,
        F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example.com")).alias("email"),
        _number(k, 6700417, 6000000000, 3999999999).alias("phone"),
        F.concat(stem, checksums.verhoeff_digit(stem).cast("string")).alias("aadhaar"),
        F.concat(card, checksums.luhn_digit(card).cast("string")).alias("card"),
        pan.alias("pan"),
        F.concat(*[_letter(k, f) for f in (3, 7, 11, 17)], F.lit("0"), F.lpad(_number(k, 31, 0, 1000000), 6, "0")).alias("ifsc"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@okaxis")).alias("upi"),
        F.concat(_letter(k, 3, "ABCDEFGHIJKLMNOPRSTUVWY"), F.lpad(_number(k, 37, 0, 10000000), 7, "0")).alias("passport"),
        _number(k, 41, 100000, 900000).alias("pincode"),
        F.lpad(_number(k, 43, 0, 1000000), 6, "0").alias("otp"),
        F.lpad(_number(k, 47, 0, 1000), 3, "0").alias("cvv"),
        _number(k, 53, 100000000000, 899999999999).alias("account"),
        F.concat_ws("/", F.lpad(_number(k, 3, 1, 28), 2, "0"), F.lpad(_number(k, 5, 1, 12), 2, "0"), _number(k, 7, 1950, 55)).alias("dob"),
    )


def decoys(keys: DataFrame, key: str, tries: int = 20) -> DataFrame:
    """``key`` and a twelve-digit number that passes no check."""
    k = F.col(key).cast("bigint")
    made = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: ((k * 104729 + i * 7919) % 899999999999 + 100000000000).cast("string"))
    return keys.select(key, F.get(F.filter(made, lambda v: ~checksums.verhoeff_valid(v) & ~checksums.luhn_valid(v)), 0).alias("decoy"))


#: Kinds of numbers that are no personal data.
DECOY_KINDS = ("order", "amount", "count", "invalid_card", "invalid_aadhaar", "year")


def mixed_decoys(keys: DataFrame, key: str, tries: int = 20) -> DataFrame:
    """``key``, kind and a number that passes no check, kinds by turns.  Each is one
    of ``tries`` made from the key, the first that passes neither check; a short
    number where all pass."""
    k = F.col(key).cast("bigint")

    def made(i: Column) -> Column:
        h = F.pmod(k * 7368787 + i * 104729, F.lit(899_999_999_999))
        card, number = F.concat(F.lit("4"), F.lpad(h.cast("string"), 14, "0")), (h + 1_000_000_000).cast("string")
        stem = F.substr((h + 200_000_000_000).cast("string"), F.lit(1), F.lit(11))
        spoiled = lambda stem, check: F.rtrim(F.regexp_replace(F.concat(stem, ((check + 1) % 10).cast("string")), "(.{4})", "$1 "))
        forms = F.array(
            number,
            F.concat(F.lit("₹"), F.format_number(F.pmod(h, F.lit(999_900)) + 100, 0)),
            (F.pmod(h, F.lit(99_000)) + 1000).cast("string"),
            spoiled(card, checksums.luhn_digit(card)),
            spoiled(stem, checksums.verhoeff_digit(stem)),
            (F.pmod(h, F.lit(41)) + 1990).cast("string"),
        )
        return F.get(forms, F.pmod(k, F.lit(len(DECOY_KINDS))).cast("int"))

    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), made), lambda v: ~checksums.verhoeff_valid(v) & ~checksums.luhn_valid(v, 13))
    kind = F.get(F.array(*[F.lit(x) for x in DECOY_KINDS]), F.pmod(k, F.lit(len(DECOY_KINDS))).cast("int"))
    return keys.select(key, kind.alias("kind"), F.coalesce(F.get(fits, 0), (F.pmod(k, F.lit(99_000)) + 1000).cast("string")).alias("decoy"))


def sections(spine: Column, optional: Column, seed: Column) -> Column:
    """Sections of a page: the recipe's own, then each optional one at even odds."""
    drawn = F.filter(optional, lambda name, i: F.pmod(F.xxhash64(seed, i, name), F.lit(2)) == 0)
    return F.concat(spine, drawn)


#: Class of a detector for a kind of personal data; a face has none.
DETECTOR_CLASS = {
    "PASSWORD": "password_field", "CARD": "payment_card", "CVV": "payment_card", "ID_DOCUMENT": "id_document",
    "QR_CODE": "qr_code", "SIGNATURE": "signature",
}
TEXT_KINDS = ("AADHAAR", "PAN", "PASSPORT", "IFSC", "UPI", "ACCOUNT", "EMAIL", "PHONE", "OTP", "DOB", "PINCODE", "ADDRESS", "NAME", "GENERIC")
CONTROL_CLASS = {"input": "text_input", "button": "button", "password": "password_field"}


def detector_class(kind: Column, value: Column) -> Column:
    """Class of an annotation: of its kind of data, of its control, or as it says."""
    of = lambda pairs, x: F.try_element_at(F.create_map(*[F.lit(y) for kv in pairs.items() for y in kv]), x)
    data = F.coalesce(of(DETECTOR_CLASS, F.upper(value)), F.when(F.upper(value).isin(*TEXT_KINDS), "pii_text"))
    return F.when(kind == "pii", data).when(kind == "ui", of(CONTROL_CLASS, F.lower(value))).otherwise(value)
