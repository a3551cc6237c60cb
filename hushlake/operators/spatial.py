"""Joins and folds over boxes: matching, fusion, suppression, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import geometry as g
from hushlake.functions.arrays import let
from hushlake.functions.taxonomy import PRIORITY


def matched(truth: DataFrame, found: DataFrame, least: float = 0.5, page: str = "page_id") -> DataFrame:
    """Left join of truth boxes with found boxes of their page that contain or
    are contained by at least ``least`` of the smaller one.  The page is the
    equi-key; the geometry is a residual condition."""
    t, d = truth.alias("t"), found.alias("d")
    near = g.containment(F.col("t.box"), F.col("d.box")) >= least
    return t.join(d, (F.col(f"t.{page}") == F.col(f"d.{page}")) & near, "left")


def unmatched(found: DataFrame, truth: DataFrame, least: float = 0.5, page: str = "page_id") -> DataFrame:
    d, t = found.alias("d"), truth.alias("t")
    near = g.containment(F.col("t.box"), F.col("d.box")) >= least
    return d.join(t, (F.col(f"t.{page}") == F.col(f"d.{page}")) & near, "left_anti")


def rank(kind: Column, source: Column) -> Column:
    """Rank of a detection; a vague one from a picture stands below a face."""
    pairs = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in (kv[0], float(kv[1]))])
    return F.when((source == "vision") & (kind == "GENERIC"), F.lit(40.5)).otherwise(F.try_element_at(pairs, kind))


ITEM = "array<struct<id:bigint,type:string,box:struct<x:double,y:double,w:double,h:double>,source:string,confidence:double>>"


def fused(items: Column, width: Column, height: Column, pad: float = 3.0, least: float = 0.6, min_area: float = 16.0) -> Column:
    """One page's detections merged one by one into hosts that grow.

    The order decides (rank, then area), so this is a fold and not a component
    search.  A detection is held against every host once; hosts that don't fit
    each other share the viewport, so on a full page they are far fewer.
    """
    grown = F.transform(
        items, lambda d: d.withField("box", g.padded(d.box, pad, width, height))
    )
    usable = F.filter(grown, lambda d: g.area(d.box) >= min_area)
    ordered = F.array_sort(
        F.transform(usable, lambda d: F.struct((-rank(d.type, d.source)).alias("r"), (-g.area(d.box)).alias("a"), d.id.alias("i"), d.alias("d")))
    )

    def place(hosts: Column, x: Column) -> Column:
        d = x.d
        # most hosts lie elsewhere, where both shares are 0
        fits = lambda h: F.when(
            g.common_area(h.box, d.box) > 0, (g.iou(h.box, d.box) >= least) | (g.containment(h.box, d.box) >= least)
        ).otherwise(F.lit(least <= 0))
        merged = lambda h: h.withField("box", g.united(h.box, d.box)).withField(
            "confidence", F.greatest(h.confidence, d.confidence)
        ).withField(
            "type", F.when((h.source == "vision") & (d.source != "vision"), d.type).otherwise(h.type)
        )
        # bound once: in the lambda of the hosts it would be searched again for each of them
        return let(
            F.array_position(F.transform(hosts, fits), F.lit(True)).cast("int"),
            lambda at: F.when(at == 0, F.concat(hosts, F.array(d))).otherwise(
                F.transform(hosts, lambda h, i: F.when(i == at - 1, merged(h)).otherwise(h))
            ),
        )

    return F.aggregate(ordered, F.array().cast(ITEM), place)


def fuse(detections: DataFrame, width: float, height: float, page: str = "page_id") -> DataFrame:
    item = F.struct(F.col("id").cast("bigint").alias("id"), "type", "box", "source", F.col("confidence").cast("double").alias("confidence"))
    pages = detections.groupBy(page).agg(F.collect_list(item).alias("items"))
    out = pages.select(page, F.explode(fused(F.col("items"), F.lit(width), F.lit(height))).alias("d"))
    return out.select(page, "d.*")


def suppressed(items: Column, most: float) -> Column:
    """Greedy: a box stays if its overlap with every kept one is below ``most``.
    ``items`` are structs of score and box."""
    ordered = F.array_sort(F.transform(items, lambda d: F.struct((-d.score).alias("s"), d.id.alias("i"), d.alias("d"))))
    none = F.filter(items, lambda d: F.lit(False))
    return F.aggregate(
        ordered,
        none,
        lambda kept, x: F.when(F.exists(kept, lambda k: g.iou(k.box, x.d.box) >= most), kept).otherwise(
            F.concat(kept, F.array(x.d))
        ),
    )


def covered_share(box: Column, others: Column, steps: int = 16) -> Column:
    """Share of sample points of ``box`` that lie in one of ``others``."""
    axis = F.sequence(F.lit(0), F.lit(steps - 1))

    def point(i: Column, j: Column) -> Column:
        x, y = box.x + (i + 0.5) * box.w / steps, box.y + (j + 0.5) * box.h / steps
        inside = F.exists(others, lambda r: (x >= r.x) & (x <= r.x + r.w) & (y >= r.y) & (y <= r.y + r.h))
        return F.when(inside, 1.0).otherwise(0.0)

    rows = F.transform(axis, lambda i: F.aggregate(F.transform(axis, lambda j: point(i, j)), F.lit(0.0), lambda a, x: a + x))
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x) / (steps * steps)


def cells(box: Column, grid: int) -> Column:
    """Cells of a grid that a box touches, as structs of cx and cy."""
    axis = lambda a, n: F.sequence(F.floor(a / grid), F.greatest(F.ceil((a + n) / grid) - 1, F.floor(a / grid)))
    return F.flatten(
        F.transform(axis(box.x, box.w), lambda cx: F.transform(axis(box.y, box.h), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))))
    )


def vague_boxes_left(detections: DataFrame, read: DataFrame, page: str = "page_id") -> DataFrame:
    """Detections without the vague ones that the page itself explains: a box of
    the picture detector goes if half of it is text or controls that were read,
    nothing personal and no long number is in it, and no picture lies below it.
    ``read`` has page, kind (text, control, picture, personal), text and box."""
    boxes = read.groupBy(page).agg(F.collect_list(F.struct("kind", "text", "box")).alias("__r"))
    joined = detections.join(boxes, page, "left").withColumn("__r", F.coalesce("__r", F.filter(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("text"), F.col("box"))), lambda x: F.lit(False))))
    d, r = F.col("box"), F.col("__r")
    of = lambda *kinds: F.filter(r, lambda x: x.kind.isin(*kinds))
    picture = F.exists(of("picture"), lambda x: g.share_inside(d, x.box) > 0.2)
    personal = F.exists(of("personal"), lambda x: g.common_area(d, x.box) > 0)
    number = F.exists(of("text"), lambda x: (g.common_area(d, x.box) > 0) & x.text.rlike("[0-9](?:[\\s-]?[0-9]){7,}"))
    spoken = covered_share(d, F.transform(of("text", "control"), lambda x: x.box)) >= 0.5
    gone = (F.col("source") == "vision") & spoken & ~picture & ~personal & ~number
    return joined.where(~gone).drop("__r")
