"""The next step of a form task: ordered rules, first fit wins.

Rules are rows: every element of a request that a rule fits becomes a
candidate with the number of the rule and its place on the page, and the least
of them is the plan.  So all requests are planned by one grouped minimum.

A request has request_id, task, profile_keys, more_below, elements and
history, as arrays of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.taxonomy import PROFILE_KEYS
from hushlake.functions.text import EDGE

from .answers import is_question, looks_irreversible, search_query, task_facts
from .fields import SOMEONE_ELSE

STOP = ("stop before", "don't submit", "do not submit", "without submitting", "जमा न करें", "जमा मत करें", "सबमिट न करें", "सबमिट मत करें")
ADVANCE = "(?i)^(?:next|next step|continue|proceed|save (?:and|&) continue|आगे|आगे बढ़ें)\\s*[›>→»]*$"
MAX_SCROLLS = 4
STEP = "struct<place:double,pos:int,rule:int,action:string,element_id:int,text:string>"
#: What a task states about the user fills fields after a search and before the profile.
STATED, STATED_PLACE = 11, 2.5


def _step(rule: int, pos: Column, action: str | Column, element: Column, text: Column, place: float | None = None) -> Column:
    return F.struct(
        F.lit(float(rule) if place is None else place).alias("place"),
        pos.cast("int").alias("pos"),
        F.lit(rule).alias("rule"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        element.cast("int").alias("element_id"),
        text.cast("string").alias("text"),
    )


def plan(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, keep, rule, action, element_id, text)."""
    h, none = F.col("history"), F.lit(None)

    def seen(e: Column, fits) -> Column:
        return F.exists(h, lambda x: (x.element_id == e.id) & fits(x))

    def failed(e: Column) -> Column:
        return F.size(F.filter(h, lambda x: (x.element_id == e.id) & ~x.ok)) >= 2

    typed = lambda e: seen(e, lambda x: x.ok & (x.action == "type"))
    clicked = lambda e: seen(e, lambda x: x.action == "click")
    asked = lambda e: seen(e, lambda x: x.action == "ask_user")
    editable = lambda e: e.role.isin("textbox", "searchbox", "combobox") & ~F.coalesce(e.disabled, F.lit(False))
    empty = lambda e: F.coalesce(~e.filled, F.coalesce(e.value, F.lit("")) == "")
    final = lambda e: looks_irreversible(e.text, e.label) & ~F.coalesce(e.disabled, F.lit(False))
    keys = F.create_map(*[F.lit(x) for kv in PROFILE_KEYS.items() for x in kv])

    def each(fits, step) -> Column:
        """Candidates of a rule about elements, in page order."""
        marked = F.transform("elements", lambda e, i: F.struct(e.alias("e"), i.alias("i")))
        return F.transform(F.filter(marked, lambda m: F.coalesce(fits(m.e), F.lit(False))), lambda m: step(m.e, m.i))

    def fill_key(e: Column) -> Column:
        key = F.try_element_at(keys, e.sensitive)
        other = F.coalesce(e.label, e.placeholder, F.lit("")).rlike(SOMEONE_ELSE)
        return F.when((e.sensitive != "PASSWORD") & ~other & F.array_contains("profile_keys", key), key)

    task = F.lower(F.col("task"))
    query = search_query(F.col("task"))
    stop = F.lit(False)
    for phrase in STOP:
        stop = stop | F.contains(task, F.lit(phrase))
    open_ = lambda e: editable(e) & empty(e) & ~failed(e) & ~typed(e)
    always = lambda step, when: F.when(when, F.array(step)).otherwise(F.array().cast(f"array<{STEP}>"))
    in_view = F.exists("elements", lambda e: F.coalesce(editable(e) & empty(e) & ~typed(e), F.lit(False)))
    submit_seen = F.exists("elements", lambda e: F.coalesce((e.role == "button") & final(e), F.lit(False)))
    scrolls = F.size(F.filter(h, lambda x: x.action == "scroll"))
    group_of = lambda e: F.filter("elements", lambda o: (o.role == "radio") & (o.group == e.group))
    yes = lambda c: F.coalesce(c, F.lit(False))

    def about(e: Column, subject: Column) -> Column:
        label = F.replace(F.lower(F.concat_ws(" ", e.label, e.placeholder, e.group)), F.lit("_"), F.lit(" "))
        return F.regexp_like(label, F.concat(F.lit(EDGE), subject, F.lit(EDGE)))

    def stated(fact: Column, j: Column) -> Column:
        """Fields about what the task states, up to a choice that is made already."""
        marked = F.filter(
            F.transform("elements", lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
            lambda m: about(m.e, fact.key) & ~yes(m.e.disabled) & ~failed(m.e) & ~seen(m.e, lambda x: x.action.isin("select", "type", "ask_user")),
        )
        radio = lambda e: yes(e.role == "radio")
        made = F.array_min(F.transform(F.filter(marked, lambda m: radio(m.e) & F.exists(group_of(m.e), lambda o: yes(o.checked))), lambda m: m.i))
        fits = F.filter(marked, lambda m: (m.i < F.coalesce(made, F.size("elements"))) & (radio(m.e) | yes(editable(m.e) & empty(m.e))))
        return F.transform(
            fits,
            lambda m: _step(STATED, j * F.size("elements") + m.i, F.when(radio(m.e), "select").otherwise("type"), m.e.id, fact.value, STATED_PLACE),
        )

    candidates = F.flatten(
        F.array(
            always(_step(1, F.lit(0), "done", none, F.lit("describe")), is_question(F.col("task"))),
            always(_step(2, F.lit(0), "search", none, query), query.isNotNull()),
            F.flatten(F.transform(F.map_entries(task_facts(F.coalesce("task", F.lit("")))), stated)),
            each(lambda e: open_(e) & fill_key(e).isNotNull(), lambda e, i: _step(3, i, "type", e.id, F.concat(F.lit("⟦PROFILE."), fill_key(e), F.lit("⟧")))),
            each(lambda e: yes(e.required) & open_(e), lambda e, i: _step(4, i, "ask_user", e.id, e.label)),
            each(
                lambda e: (e.role == "radio")
                & (e.group != "")
                & F.exists(group_of(e), lambda o: yes(o.required))
                & ~F.exists(group_of(e), lambda o: yes(o.checked))
                & ~F.exists(group_of(e), lambda o: failed(o) | seen(o, lambda x: x.action.isin("select", "type", "ask_user"))),
                lambda e, i: _step(5, i, "ask_user", e.id, F.replace(e.group, F.lit("_"), F.lit(" "))),
            ),
            each(
                lambda e: (e.role == "checkbox") & yes(e.required) & ~yes(e.checked) & ~yes(e.disabled) & ~clicked(e) & ~failed(e) & ~asked(e),
                lambda e, i: _step(6, i, "ask_user", e.id, e.label),
            ),
            each(
                lambda e: (e.role == "button") & ~yes(e.disabled) & ~looks_irreversible(e.text, e.label)
                & F.trim(F.coalesce(e.text, e.label, F.lit(""))).rlike(ADVANCE) & ~clicked(e),
                lambda e, i: _step(7, i, "click", e.id, F.coalesce(e.text, e.label)),
            ),
            always(_step(8, F.lit(0), "scroll", none, F.lit("down")), yes(F.col("more_below")) & ~in_view & ~submit_seen & (scrolls < MAX_SCROLLS)),
            each(lambda e: (e.role == "button") & final(e) & ~stop, lambda e, i: _step(9, i, "ask_user", e.id, F.coalesce(e.text, e.label))),
            F.array(_step(10, F.lit(0), "done", none, F.when(stop, "stopped").otherwise("filled"))),
        )
    )
    return requests.select("request_id", *keep, F.array_min(candidates).alias("s")).select(
        "request_id", *keep, "s.rule", "s.action", "s.element_id", "s.text"
    )
