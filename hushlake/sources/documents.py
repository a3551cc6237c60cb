"""Scanned cards, model answers and sealed vaults as tables."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TREE = (
    "struct<blocks:array<struct<paragraphs:array<struct<lines:array<struct<confidence:double,"
    "words:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>>>>>"
)


def ocr_lines(scans: DataFrame, tree: str = "tree", key: str = "scan_id") -> DataFrame:
    """(key, line_no, text, confidence, words, before): lines of recognised text
    in order, each with the text of the line before it.  Levels that are missing
    give no lines; words without text or box are left out."""
    parsed = scans.select(key, F.from_json(tree, TREE).alias("t"))
    paragraphs = F.flatten(F.transform(F.coalesce("t.blocks", F.array()), lambda b: F.coalesce(b.paragraphs, F.array())))
    lines = F.flatten(F.transform(paragraphs, lambda p: F.coalesce(p["lines"], F.array())))
    each = parsed.select(key, F.posexplode(lines).alias("line_no", "l"))
    good = F.filter(F.coalesce("l.words", F.array()), lambda w: (F.coalesce(w.text, F.lit("")) != "") & w.bbox.isNotNull())
    words = each.select(key, "line_no", good.alias("w"), F.coalesce("l.confidence", F.lit(0.0)).alias("confidence"))
    starts = F.aggregate(
        "w", F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(w.text) + 1))
    )
    placed = words.withColumn("s", starts).withColumn(
        "words",
        F.zip_with("w", F.slice("s", 1, F.size("w")), lambda w, s: F.struct(w.text.alias("text"), w.bbox.alias("bbox"), s.alias("start"), (s + F.length(w.text)).alias("end"))),
    )
    text = F.array_join(F.transform("w", lambda w: w.text), " ")
    order = Window.partitionBy(key).orderBy("line_no")
    done = placed.select(key, "line_no", text.alias("text"), "confidence", "words").where(F.trim("text") != "")
    return done.withColumn("before", F.lag("text").over(order))


def box_of_span(words: Column, start: Column, end: Column) -> Column:
    """Box around the words that a span touches, or null."""
    hit = F.filter(words, lambda w: (start < w.end) & (w.start < end))
    side = lambda f, name: f(F.transform(hit, lambda w: w.bbox[name]))
    box = F.struct(
        side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1")
    )
    return F.when(F.size(hit) > 0, box)


def _first_object(text: str) -> str | None:
    """The first JSON object of a text: all of it, in a fence, or balanced."""
    tries = [text.strip()]
    fenced = re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.DOTALL)
    if fenced:
        tries.append(fenced[1])
    for t in tries:
        try:
            return json.dumps(json.loads(t), sort_keys=True)
        except ValueError:
            continue
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _first_object(t) if t else None)


def model_action(answer: Column) -> Column:
    """The JSON object in a model's answer, without its visible reasoning."""
    bare = F.regexp_replace(answer, "(?is)<think>.*?</think>", "")
    return _objects(F.regexp_replace(bare, "(?is)<think>.*$", ""))


def sealed(text: Column, key: Column) -> Column:
    """AES-256-GCM with a fresh nonce, as base64."""
    return F.base64(F.aes_encrypt(F.encode(text, "UTF-8"), key, F.lit("GCM")))


def opened(blob: Column, key: Column) -> Column:
    """The text, or null where the blob was tampered with."""
    return F.decode(F.try_aes_decrypt(F.unbase64(blob), key, F.lit("GCM")), "UTF-8")


def yolo_line(index: Column, box: Column, width: Column, height: Column) -> Column:
    """Class and normalised centre and size; null for what is too small or outside."""
    cx, cy = (box.x + box.w / 2) / width, (box.y + box.h / 2) / height
    good = (box.w >= 3) & (box.h >= 3) & cx.between(0, 1) & cy.between(0, 1)
    return F.when(
        good,
        F.format_string("%d %.6f %.6f %.6f %.6f", index, cx, cy, F.least(box.w / width, F.lit(1.0)), F.least(box.h / height, F.lit(1.0))),
    )
