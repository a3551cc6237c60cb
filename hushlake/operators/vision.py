"""What was found in pixels, as relations: decoding, matching with the page, choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions import geometry as g

from .spatial import suppressed

#: Fixed values.
HINT_TYPES = {"person-photo": "FACE", "document-like": "ID_DOCUMENT", "signature": "SIGNATURE", "qr-code": "QR_CODE"}
HINT_CONFIDENCE = 0.75
OCR_WIDTH, OCR_HEIGHT, OCR_REGIONS = 80, 40, 3
BEST_BOXES = 120


def _centre_inside(a: Column, b: Column, slack: float = 4.0) -> Column:
    x, y = a.x + a.w / 2, a.y + a.h / 2
    return (x >= b.x - slack) & (x <= b.x + b.w + slack) & (y >= b.y - slack) & (y <= b.y + b.h + slack)


def same_control(a: Column, b: Column) -> Column:
    """Either centre inside the other, or a real overlap."""
    return _centre_inside(a, b) | _centre_inside(b, a) | (g.iou(a, b) > 0.3)


def undeclared(found: DataFrame, declared: DataFrame, page: str = "page_id") -> DataFrame:
    """Controls found in pixels that the page does not declare itself."""
    f, d = found.alias("f"), declared.alias("d")
    return f.join(d, (F.col(f"f.{page}") == F.col(f"d.{page}")) & same_control(F.col("f.box"), F.col("d.box")), "left_anti")


def without_faces(images: DataFrame, faces: DataFrame, dpr: float, most: float = 160.0, page: str = "page_id") -> DataFrame:
    """Small images in which no face was found yet, by falling area in ``rank``."""
    small = images.where(F.col("kind").isin("img", "canvas") & (F.greatest(F.col("box.w"), F.col("box.h")) * dpr <= most)).alias("i")
    f = faces.alias("f")
    left = small.join(f, (F.col(f"i.{page}") == F.col(f"f.{page}")) & (g.common_area(F.col("i.box"), F.col("f.box")) > 0), "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.desc(g.area(F.col("box"))), "id")))


def from_hints(images: DataFrame) -> DataFrame:
    """Images that their name or text flags as personal."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in HINT_TYPES.items() for x in kv]), F.col("hint"))
    return images.withColumn("type", kind).where("type is not null").withColumn("confidence", F.lit(HINT_CONFIDENCE)).withColumn("source", F.lit("dom-image"))


def reading_targets(images: DataFrame, page: str = "page_id", most: int = OCR_REGIONS) -> DataFrame:
    """The regions worth reading: documents first, then by area."""
    order = Window.partitionBy(page).orderBy(F.desc(F.coalesce((F.col("hint") == "document-like").cast("int"), F.lit(0))), F.desc(g.area(F.col("box"))), "id")
    big = images.where((F.col("box.w") >= OCR_WIDTH) & (F.col("box.h") >= OCR_HEIGHT))
    return big.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def reading_confidence(rule: Column, line: Column) -> Column:
    """A reading is noisier than the page; ``line`` is 0 to 100."""
    return F.least(F.lit(0.95), F.sqrt(rule * line / 100))


def effective_dpr(image_width: Column, viewport_width: Column, reported: Column) -> Column:
    """The measured ratio where it differs from the reported one by more than 3 %."""
    measured = image_width / viewport_width
    known = (image_width > 0) & (viewport_width > 0)
    return F.when(known & (F.abs(measured - reported) / reported > 0.03), F.round(measured, 3)).otherwise(reported)


def decoded(tensor: Column, classes: int, scale: float, score: float = 0.35) -> Column:
    """Boxes of a tensor of 4 + ``classes`` rows by anchors, row after row: structs of
    id (the anchor), class, score and box."""
    anchors = F.floor(F.size(tensor) / (4 + classes)).cast("int")
    at = lambda row, a: F.get(tensor, row * anchors + a).cast("double")

    def one(a: Column) -> Column:
        scores = F.array(*[at(F.lit(4 + c), a) for c in range(classes)])
        best = F.array_max(scores)
        w, h = at(F.lit(2), a) / scale, at(F.lit(3), a) / scale
        return F.struct(
            a.cast("bigint").alias("id"), (F.array_position(scores, best) - 1).cast("int").alias("class"), best.alias("score"),
            g.box(at(F.lit(0), a) / scale - w / 2, at(F.lit(1), a) / scale - h / 2, w, h).alias("box"),
        )

    return F.filter(F.transform(F.sequence(F.lit(0), anchors - 1), one), lambda d: (d.score >= score) & (d.score > 0))


def best_boxes(found: Column, classes: int, overlap: float = 0.45, most: int = BEST_BOXES) -> Column:
    """The boxes that stay of each class, best first; a class does not hide another."""
    kept = F.flatten(F.array(*[suppressed(F.filter(found, lambda d, c=c: d["class"] == c), overlap) for c in range(classes)]))
    ordered = F.array_sort(F.transform(kept, lambda d: F.struct((-d.score).alias("s"), d.id.alias("i"), d.alias("d"))))
    return F.slice(F.transform(ordered, lambda x: x.d), 1, most)


def signature(grid: Column) -> Column:
    """A grid of luma from 0 to 255 in sixteen levels, one digit each."""
    return F.array_join(F.transform(grid, lambda v: F.lower(F.hex(F.floor(v / 16).cast("bigint")))), "")
