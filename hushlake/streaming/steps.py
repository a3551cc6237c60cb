"""Requests as a stream or a table: parse, guard, plan, and the view of it.

Every request is handled in its own row, so the same plan serves micro-batches
and tables, and no state is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.arrays import let
from hushlake.functions.taxonomy import is_token
from hushlake.operators.entities import entities
from hushlake.operators.planning import plan
from hushlake.operators.sanitize import blanked

REQUEST = (
    "struct<request_id:bigint,task:string,profile_keys:array<string>,more_below:boolean,visible_text:string,"
    "elements:array<struct<id:int,role:string,label:string,text:string,placeholder:string,value:string,sensitive:string,"
    "group:string,required:boolean,disabled:boolean,checked:boolean,filled:boolean>>,"
    "history:array<struct<action:string,element_id:int,ok:boolean>>>"
)


def parsed(raw: DataFrame, column: str = "value") -> DataFrame:
    """Rows of JSON text as requests; what does not parse is left out."""
    return raw.select(F.from_json(F.col(column).cast("string"), REQUEST).alias("r")).where("r.request_id is not null").select("r.*")


def payload_strings() -> Column:
    """(path, value) of every string that a request carries."""
    item = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    of = lambda e, i: F.array(
        *[
            item(F.concat(F.lit("elements["), i.cast("string"), F.lit(f"].{name}")), e[name])
            for name in ("label", "text", "placeholder", "value")
        ]
    )
    parts = F.concat(
        F.array(item(F.lit("task"), F.col("task")), item(F.lit("visible_text"), F.col("visible_text"))),
        F.flatten(F.transform(F.coalesce("elements", F.array()), of)),
    )
    return F.filter(parts, lambda s: s.value.isNotNull() & (s.value != "") & ~is_token(s.value))


def incidents(strings: Column) -> Column:
    """Types and paths of personal data in the strings, never the values."""
    return F.flatten(
        F.transform(
            strings,
            lambda s: let(
                blanked(s.value),
                lambda t: F.transform(
                    entities(t), lambda m: F.struct(m.type.alias("type"), s.path.alias("path"), m["rule"].alias("rule"))
                ),
            ),
        )
    )


def guarded(requests: DataFrame) -> DataFrame:
    """``requests`` with their incidents."""
    return requests.withColumn("incidents", incidents(payload_strings()))


def answered(requests: DataFrame) -> DataFrame:
    """(request_id, status, action, element_id, text, incidents): 422 and no
    action for a request that leaks, else the plan."""
    clean = F.size("incidents") == 0
    none = F.array().cast("array<struct<action:string,element_id:int,ok:boolean>>")
    seen = guarded(requests).withColumns(
        {"history": F.coalesce("history", none), "profile_keys": F.coalesce("profile_keys", F.array().cast("array<string>"))}
    )
    planned = plan(seen, keep=("incidents",))
    return planned.select(
        "request_id",
        F.when(clean, 200).otherwise(422).alias("status"),
        *[F.when(clean, F.col(c)).alias(c) for c in ("action", "element_id", "text")],
        "incidents",
    )
