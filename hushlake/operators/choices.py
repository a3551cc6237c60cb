"""What can be decided on the device: scrolls, searches, declared fields, memory.

Elements are structs (id, role, type, label, placeholder, value, options, group,
checked, disabled, sensitive, reason); a page holds at most a few hundred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions.taxonomy import NEVER_REMEMBERED, PROFILE_KEYS
from hushlake.functions.text import EDGE, normal_label, squeezed

from .answers import is_question, search_query

#: Fixed values.
SCROLL_DOWN = f"(?i){EDGE}(?:scroll|page|move)\\s+(?:down|further|lower){EDGE}"
SCROLL_UP = f"(?i){EDGE}(?:scroll|page|move)\\s+(?:back\\s+)?(?:up|higher){EDGE}"
SCROLL_FILLER = f"(?i){EDGE}(?:please|pls|a|bit|little|more|the|page|once|again|for me|now|just|can you|could you){EDGE}"
UNCHOSEN = "(?i)^(?:|0|-1|none|select.*|choose.*|--.*)$"
FILLABLE = ("textbox", "searchbox", "combobox", "spinbutton", "radio")
ANSWERABLE = ("textbox", "combobox", "spinbutton", "radio")
FRIENDLY = {"EMAIL": "email address", "PHONE": "phone number", "AADHAAR": "Aadhaar number", "PAN": "PAN", "OTP": "OTP", "UPI": "UPI ID", "DOB": "date of birth", "PASSWORD": "password"}
DOCUMENT_LABEL = {
    "AADHAAR": "Aadhaar number", "PAN": "PAN", "DOB": "Date of birth", "PASSPORT": "Passport number",
    "PHONE": "Mobile number", "EMAIL": "Email", "PINCODE": "PIN code", "UPI": "UPI ID",
}


def _named(pairs: dict[str, str], of: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), of)


def bare_scroll(task: Column) -> Column:
    """up or down where a task is a scroll and nothing else; else null."""

    def only(pattern: str) -> Column:
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(task, pattern, " "), SCROLL_FILLER, " "), "[^\\p{L}\\p{N}]+", " ")
        return task.rlike(pattern) & (F.trim(rest) == "")

    return F.when(only(SCROLL_DOWN), "down").when(only(SCROLL_UP), "up")


def declared_by_page(reason: Column) -> Column:
    return F.coalesce(reason.startswith("autocomplete="), F.lit(False))


def enter_submits(role: Column, kind: Column, label: Column, placeholder: Column) -> Column:
    """Whether Enter sends something: everywhere but in a search box."""
    named = F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(placeholder, F.lit(""))).rlike(f"(?i){EDGE}search{EDGE}|खोज")
    return ~(F.coalesce(role == "searchbox", F.lit(False)) | F.coalesce(kind == "search", F.lit(False)) | named)


def fillable(role: Column, kind: Column, disabled: Column) -> Column:
    return role.isin(*FILLABLE) & ~F.coalesce(disabled, F.lit(False)) & ~F.coalesce(kind == "password", F.lit(False))


def answer_options(e: Column, elements: Column) -> Column:
    """What a question can be answered with: labels of a radio's group, else options."""
    group = F.filter(elements, lambda x: (x.role == "radio") & x.group.eqNullSafe(e.group))
    labels = F.filter(F.transform(group, lambda x: F.coalesce(x.label, F.lit(""))), lambda x: x != "")
    return F.when(e.role == "radio", labels).otherwise(e.options)


def unanswered(e: Column, elements: Column) -> Column:
    """No radio of the group is chosen; a choice still shows its prompt; else empty."""
    chosen = F.exists(elements, lambda x: (x.role == "radio") & x.group.eqNullSafe(e.group) & F.coalesce(x.checked, F.lit(False)))
    value = F.trim(F.coalesce(e.value, F.lit("")))
    return F.when(e.role == "radio", ~chosen).when(e.options.isNotNull(), value.rlike(UNCHOSEN)).otherwise(value == "")


def chosen_option(options: Column, wanted: Column) -> Column:
    """Place (from 0) of the option (value, text) that is meant: equal value, else equal
    text, else text that contains it; the first of the best; null without any."""
    w = F.lower(F.trim(wanted))
    text = lambda o: F.lower(F.trim(o.text))
    tier = lambda o: F.when(F.lower(o.value) == w, 0).when(text(o) == w, 1).when(F.contains(text(o), w), 2)
    ranked = F.filter(F.transform(options, lambda o, i: F.struct(tier(o).alias("tier"), i.alias("at"))), lambda x: x.tier.isNotNull())
    return F.array_min(ranked)["at"]


def friendly_type(kind: Column) -> Column:
    return F.coalesce(_named(FRIENDLY, kind), F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))


def with_article(noun: Column) -> Column:
    """By sound: an email address, a UPI ID."""
    return F.concat(F.when(noun.rlike("(?i)^[aeiou]") & ~noun.rlike("(?i)^u(?:pi|id)"), "an ").otherwise("a "), noun)


def described_action(a: Column) -> Column:
    """A sentence for an action; tokens may be shown, values never get here."""
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    return (
        F.when(a.action == "type", part("type ", a.text, " into element ", a.element_id))
        .when(a.action == "click", part("click element ", a.element_id))
        .when(a.action == "select", part('select "', a.option, '" in element ', a.element_id))
        .when(a.action == "scroll", part("scroll ", F.coalesce(a.direction, F.lit("down"))))
        .when(a.action == "key", part("press ", a.key))
        .when(a.action == "navigate", F.when(a.url.isNotNull() & (a.url != "") & (a.url != "back"), part("open ", a.url)).otherwise("go back"))
        .when(a.action == "wait", part("wait ", F.coalesce(a.ms, F.lit(800)), " ms"))
        .when(a.action == "ask_user", F.lit("ask the user"))
        .otherwise(a.action)
    )


def unique_slugs(answers: DataFrame, scope: str, slug: str = "slug", order: str = "at") -> DataFrame:
    """``answers`` with ``unique``: of equal slugs in a scope the second is called
    slug_2, and so on, in order."""
    n = F.row_number().over(Window.partitionBy(scope, slug).orderBy(order))
    return answers.withColumn("__n", n).withColumn(
        "unique", F.when(F.col("__n") == 1, F.col(slug)).otherwise(F.concat_ws("_", F.col(slug), F.col("__n").cast("string")))
    ).drop("__n")


def document_suggestions(findings: DataFrame, held: DataFrame, owner: str = "owner", order: str = "ord") -> DataFrame:
    """(owner, key, label, type, value): what a scanned card can put in a profile: the
    first finding of each key that is not held and may be remembered."""
    key, label = _named(PROFILE_KEYS, F.col("type")), _named(DOCUMENT_LABEL, F.col("type"))
    usable = findings.withColumn("key", key).withColumn("label", label).where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~F.col("type").isin(*NEVER_REMEMBERED))
    new = usable.join(held.select(owner, "key").distinct(), [owner, "key"], "left_anti")
    firsts = new.groupBy(owner, "key").agg(F.min(F.struct(order, "label", "type", F.trim("value").alias("value"))).alias("f"))
    return firsts.select(owner, "key", "f.label", "f.type", "f.value")


def consents(question: Column) -> Column:
    """Agrees to a declaration and to nothing else."""
    q = F.lower(question)
    return F.contains(q, F.lit("declar")) & ~F.contains(q, F.lit("press")) & ~F.contains(q, F.lit("allow"))


def recalled(questions: DataFrame, memos: DataFrame, owner: str = "owner") -> DataFrame:
    """``questions`` (owner, label) with ``answer``: the memo of equal normalised label;
    the one learnt last counts."""
    last = memos.withColumn("__l", normal_label(F.col("label"))).groupBy(owner, "__l").agg(F.max_by("value", "at").alias("answer"))
    return questions.withColumn("__l", normal_label(F.col("label"))).join(last, [owner, "__l"], "left").drop("__l")


ACTION = "struct<action:string,element_id:int,text:string,option:string,direction:string,key:string,rule:string>"


def plan_local(pages: DataFrame) -> DataFrame:
    """``pages`` with ``local``: what needs no server, null where it does.

    Pages have task, elements, profile_keys, attempted (element ids), scrolled,
    searched, and recall: a map of normalised labels to remembered answers.  The
    order is a bare scroll, nothing for a question, a search, a field that the page
    declares, a remembered answer.
    """
    e, tried = F.col("elements"), F.col("attempted")

    def act(rule: str, action, element=None, text=None, option=None, direction=None, key=None) -> Column:
        value = lambda x, t: F.lit(x).cast(t) if x is None or isinstance(x, str) else x.cast(t)
        return F.struct(
            value(action, "string").alias("action"), value(element, "int").alias("element_id"), value(text, "string").alias("text"),
            value(option, "string").alias("option"), value(direction, "string").alias("direction"), value(key, "string").alias("key"),
            F.lit(rule).alias("rule"),
        )

    none = F.lit(None).cast(ACTION)
    way, query = bare_scroll(F.col("task")), search_query(F.col("task"))
    scroll = F.when(F.col("scrolled"), act("scroll", "done", direction=way)).otherwise(act("scroll", "scroll", direction=way))
    boxes = F.filter(e, lambda x: (x.role == "searchbox") & ~F.coalesce(x.disabled, F.lit(False)))
    box = F.get(boxes, 0)
    same = F.lower(squeezed(F.coalesce(box.value, F.lit("")))) == F.lower(squeezed(query))
    search = (
        F.when(F.col("searched"), act("search", "done", text=query))
        .when(F.size(boxes) != 1, none)
        .when(same, act("search", "key", element=box.id, key="Enter"))
        .when(F.array_contains(tried, box.id), none)
        .otherwise(act("search", "type", element=box.id, text=query))
    )
    free = lambda x: ~F.coalesce(x.disabled, F.lit(False)) & ~F.array_contains(tried, x.id)
    key = lambda x: _named(PROFILE_KEYS, x.sensitive)
    declared = F.get(
        F.filter(
            e,
            lambda x: x.sensitive.isNotNull() & (x.sensitive != "PASSWORD") & free(x) & (F.coalesce(x.value, F.lit("")) == "")
            & declared_by_page(x.reason) & F.coalesce(F.array_contains(F.col("profile_keys"), key(x)), F.lit(False)),
        ), 0,
    )
    answer = lambda x: F.try_element_at(F.col("recall"), normal_label(F.coalesce(F.nullif(x.label, F.lit("")), x.placeholder)))
    offered = lambda x: F.when((x.role == "radio") | x.options.isNotNull(), F.exists(answer_options(x, e), lambda o: F.lower(F.trim(o)) == F.lower(F.trim(answer(x))))).otherwise(True)
    known = F.get(
        F.filter(
            e,
            lambda x: x.role.isin(*ANSWERABLE) & free(x) & (F.coalesce(x.sensitive, F.lit("")) != "PASSWORD") & ~F.coalesce(x.type == "password", F.lit(False))
            & unanswered(x, e) & answer(x).isNotNull() & F.coalesce(offered(x), F.lit(False)),
        ), 0,
    )
    choice = (known.role == "radio") | known.options.isNotNull()
    memory = F.when(choice, act("memory", "select", element=known.id, option=answer(known))).otherwise(act("memory", "type", element=known.id, text=answer(known)))
    fill = act("declared", "type", element=declared.id, text=F.concat(F.lit("⟦PROFILE."), key(declared), F.lit("⟧")))
    return pages.withColumn(
        "local",
        F.when(way.isNotNull(), scroll)
        .when(is_question(F.col("task")), none)
        .when(query.isNotNull(), search)
        .when(declared.id.isNotNull(), fill)
        .when(known.id.isNotNull(), memory),
    )
