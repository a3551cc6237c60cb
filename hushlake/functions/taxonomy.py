"""The kinds of personal data, with rank, style and what may be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank of each kind; the higher one wins an overlap.
PRIORITY = {
    "PASSWORD": 100, "AADHAAR": 95, "PAN": 94, "CARD": 93, "CVV": 92, "PASSPORT": 91, "ID_DOCUMENT": 90,
    "ACCOUNT": 85, "IFSC": 80, "UPI": 79, "GENERIC": 75, "EMAIL": 70, "PHONE": 69, "OTP": 68, "DOB": 60,
    "PINCODE": 55, "ADDRESS": 50, "NAME": 45, "FACE": 40, "QR_CODE": 35, "SIGNATURE": 30,
}
PIXELATED = ("FACE",)
VISION_ONLY = ("FACE", "ID_DOCUMENT", "QR_CODE", "SIGNATURE")
NEVER_REMEMBERED = ("PASSWORD", "OTP", "CVV", "CARD")
#: Kinds that a profile holds under a key of the same meaning.
PROFILE_KEYS = {
    "EMAIL": "EMAIL", "PHONE": "PHONE", "DOB": "DOB", "PINCODE": "PINCODE", "AADHAAR": "AADHAAR", "PAN": "PAN",
    "PASSPORT": "PASSPORT", "UPI": "UPI", "NAME": "FULL_NAME", "ADDRESS": "ADDRESS",
}
#: A token stands for a value; it starts with a capital.
TOKEN = "⟦[A-Z][A-Z0-9_.]*⟧"


def kinds(spark: SparkSession) -> DataFrame:
    rows = [(k, p, "pixelate" if k in PIXELATED else "block", k in VISION_ONLY) for k, p in PRIORITY.items()]
    return spark.createDataFrame(rows, "type string, priority int, style string, vision_only boolean")


def priority(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in PRIORITY.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), kind)


def is_token(text: Column) -> Column:
    return F.trim(text).rlike(f"^{TOKEN}$")
