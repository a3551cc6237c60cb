"""Array building blocks: one-time bindings, running folds, match positions.

Everything is a Column expression; positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches of one text are numbered in runs of this many, so that running sums
#: never copy an array as long as the text.
RUN = 256


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge, start: int) -> Column:
    """Inclusive running folds of an array of integers, in two levels."""

    def run_folds(run: Column, first: Column) -> Column:
        folds = F.aggregate(
            run, F.array(first), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x)))
        )
        return F.slice(folds, 2, RUN)

    def spread(v: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda r: F.slice(v, r * RUN + 1, RUN)
        )
        return let(
            runs,
            lambda rs: F.flatten(
                F.zip_with(
                    rs,
                    F.aggregate(
                        rs,
                        F.array(F.lit(start)),
                        lambda acc, r: F.concat(
                            acc, F.array(merge(F.element_at(acc, -1), F.aggregate(r, F.lit(start), merge)))
                        ),
                    ),
                    # zip_with pads the run that lies past the end with null
                    lambda r, first: F.when(r.isNull(), F.array().cast("array<int>")).otherwise(run_folds(r, first)),
                )
            ),
        )

    return F.when(F.size(values) > 0, let(values, spread)).otherwise(F.array().cast("array<int>"))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, x: a + x, 0)


SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Characters of context that a span carries on either side.
CONTEXT = 40


def _found(text: Column, pattern: str, present: Column | None) -> Column:
    return text.rlike(pattern) if present is None else present & text.rlike(pattern)


def _hits_and_gaps(text: Column, pattern: str, *more: Column) -> Column:
    return F.struct(
        *more,
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.split(text, pattern, -1).alias("gaps"),
    )


def numbered_hits(k: int, text: Column, pattern: str, present: Column | None = None) -> Column:
    """Struct of number, matches and what lies between them; null without any.
    ``present`` is a cheap test that holds where there is a match."""
    return F.when(_found(text, pattern, present), _hits_and_gaps(text, pattern, F.lit(k).alias("k")))


def placed(x: Column) -> Column:
    """Spans of hits (struct of hits and gaps) by the lengths of all before."""
    n = F.size(x.hits)
    steps = F.zip_with(F.slice(x.gaps, 1, n), x.hits, lambda g, h: F.length(g) + F.length(h))
    around = F.zip_with(
        F.transform(F.slice(x.gaps, 1, n), lambda g: F.right(g, F.lit(CONTEXT))),
        F.transform(F.slice(x.gaps, 2, n), lambda g: F.left(g, F.lit(CONTEXT))),
        lambda b, a: F.struct(b.alias("b"), a.alias("a")),
    )
    ends = F.zip_with(running_sums(steps), x.hits, lambda end, h: F.struct(end.alias("end"), h.alias("h")))
    return F.zip_with(
        ends,
        around,
        lambda p, c: F.struct(
            (p.end - F.length(p.h)).alias("start"),
            p.end.alias("end"),
            p.h.alias("value"),
            c.b.alias("before"),
            c.a.alias("after"),
        ),
    )


def regex_spans(text: Column, pattern: str, present: Column | None = None) -> Column:
    """Every leftmost non-overlapping match of ``pattern`` with its code points,
    and what lies between it and its neighbours, up to CONTEXT characters.

    Spark gives no positions; the lengths of the gaps between matches do.
    ``present`` is a cheap test that holds where there is a match, so that most
    texts stop there.
    """
    both = _hits_and_gaps(text, pattern)
    return F.when(_found(text, pattern, present), let(both, placed)).otherwise(F.array().cast(SPAN))
