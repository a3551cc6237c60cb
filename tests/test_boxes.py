"""Fusion of boxes on a full page, held against a plain fold."""

import time

from pyspark.sql import functions as F

from hushlake.functions import geometry
from hushlake.functions.taxonomy import PRIORITY
from hushlake.operators import spatial

W, H = 1280.0, 800.0


def plain_fuse(rows, pad=3.0, least=0.6, min_area=16.0):
    """(box, type, source, confidence, id) of the hosts of one page."""

    def grown(x, y, w, h):
        gx, gy = max(x - pad, 0.0), max(y - pad, 0.0)
        return gx, gy, max(min(x + w + pad, W) - gx, 0.0), max(min(y + h + pad, H) - gy, 0.0)

    def area(b):
        return b[2] * b[3]

    def shares(a, b):
        w = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0.0)
        h = max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0.0)
        return [w * h / whole if whole > 0 else 0.0 for whole in (area(a) + area(b) - w * h, min(area(a), area(b)))]

    def rank(kind, source):
        return 40.5 if (kind, source) == ("GENERIC", "vision") else float(PRIORITY[kind])

    usable = [(*r[:3], grown(*r[3]), r[4]) for r in rows if area(grown(*r[3])) >= min_area]
    hosts = []
    for i, kind, source, b, conf in sorted(usable, key=lambda r: (-rank(r[1], r[2]), -area(r[3]), r[0])):
        host = next((h for h in hosts if max(shares(h["box"], b)) >= least), None)
        if host is None:
            hosts.append({"id": i, "type": kind, "source": source, "box": b, "conf": conf})
            continue
        a = host["box"]
        x, y = min(a[0], b[0]), min(a[1], b[1])
        host["box"] = (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)
        host["conf"] = max(host["conf"], conf)
        if host["source"] == "vision" and source != "vision":
            host["type"] = kind
    return sorted((h["id"], h["type"], h["source"], h["box"], h["conf"]) for h in hosts)


def boxes(n):
    return [
        (
            i,
            ("EMAIL", "GENERIC", "CARD")[i % 3],
            ("dom", "vision")[i // 3 % 2],
            (float(i * 37 % 1200), float(i * 53 % 760), float(20 + i * 7 % 60), float(8 + i * 11 % 40)),
            0.5 + i % 10 / 20,
        )
        for i in range(n)
    ]


def fused(spark, pages):
    rows = [(p, i, kind, source, *b, conf) for p, found in pages.items() for i, kind, source, b, conf in found]
    df = spark.createDataFrame(rows, "page_id int, id long, type string, source string, x double, y double, w double, h double, confidence double")
    out = spatial.fuse(df.select("page_id", "id", "type", "source", geometry.box(*[F.col(c) for c in "xywh"]).alias("box"), "confidence"), W, H)
    got = {p: [] for p in pages}
    for r in out.collect():
        got[r.page_id].append((r.id, r.type, r.source, tuple(r.box), r.confidence))
    return {p: sorted(g) for p, g in got.items()}


def test_fuse_equals_a_plain_fold(spark):
    odd = [(1, "CARD", "dom", (-9.0, -9.0, 0.0, 0.0), 0.5), (2, "CARD", "vision", (1279.0, 799.0, 50.0, 50.0), 0.5), (3, "GENERIC", "dom", (5.0, 5.0, 0.0, 0.0), 0.5)]
    pages = {1: boxes(60), 2: boxes(7), 3: odd, 4: boxes(20) + [(i + 1000, *r) for i, *r in boxes(20)]}
    assert fused(spark, pages) == {p: plain_fuse(found) for p, found in pages.items()}


def test_a_full_page_is_searched_once_a_detection(spark):
    # the search was run again for each host, the square of them for each detection
    found = boxes(1500)
    began = time.time()
    got = fused(spark, {1: found})
    assert time.time() - began < 60
    assert got[1] == plain_fuse(found)
