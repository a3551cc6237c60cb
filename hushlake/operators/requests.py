"""From detections and elements to what may leave: wire rows, screen text, request.

A page is a row; its elements, blocks and detections are arrays of at most a few
hundred structs, so folds over one page stay inside one row and everything else
is a plan over pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import geometry as g
from hushlake.functions.arrays import let
from hushlake.functions.text import clamp_label, squeezed

from .answers import MAX_AREA, SENSITIVE_HOST, is_question

#: Fixed values.
FIELD_CONFIDENCE = 0.98
COVER = 0.3
EXPLAINS = 0.5
MAX_TEXT = 4000
MAX_BLOCK = 400
DETECTION = "struct<id:string,type:string,box:struct<x:double,y:double,w:double,h:double>,confidence:double,source:string,token:string,detail:string>"


# --- detections ---------------------------------------------------------------


def from_fields(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """Filled sensitive fields as detections: an empty one has nothing to hide, and
    a password never left the page, so its token has no number."""
    token = F.when(F.col("sensitive") == "PASSWORD", F.lit("⟦PASSWORD⟧")).otherwise(F.col("token"))
    return elements.where("sensitive is not null and coalesce(value, '') <> ''").select(
        page, F.concat(F.lit("field:"), F.col("id").cast("string")).alias("id"), F.col("sensitive").alias("type"), "box",
        F.lit(FIELD_CONFIDENCE).alias("confidence"), F.lit("dom-field").alias("source"), token.alias("token"), F.col("reason").alias("detail"),
    )


def from_text(findings: DataFrame, page: str = "page_id") -> DataFrame:
    """Findings (ord, type, token, confidence, rects) as detections, one per line."""
    each = findings.select(page, "ord", "type", "token", "confidence", F.posexplode("rects").alias("line", "box"))
    return each.select(
        page, F.concat_ws(":", F.lit("text"), F.col("ord").cast("string"), F.col("line").cast("string")).alias("id"), "type", "box",
        "confidence", F.lit("dom-text").alias("source"), "token", F.lit(None).cast("string").alias("detail"),
    )


def from_frames(frames: DataFrame, page: str = "page_id") -> DataFrame:
    """Frames that could not be read (ord from 0, box): an area, and no value."""
    return frames.select(
        page, F.concat(F.lit("frame:"), F.col("ord").cast("string")).alias("id"), F.lit("GENERIC").alias("type"), "box",
        F.lit(1.0).alias("confidence"), F.lit("dom-image").alias("source"),
        F.concat(F.lit("⟦FRAME_"), (F.col("ord") + 1).cast("string"), F.lit("⟧")).alias("token"),
        F.lit("cross-origin frame — could not be inspected").alias("detail"),
    )


def detected(fields: DataFrame, text: DataFrame, frames: DataFrame, vision: DataFrame | None = None) -> DataFrame:
    """All detections of all pages, before any are merged."""
    parts = [from_fields(fields), from_text(text), from_frames(frames)]
    return reduce(DataFrame.unionByName, parts + ([vision] if vision is not None else []))


def redacted_share(boxes: Column, width: Column, height: Column) -> Column:
    """Sum of areas over the viewport's, at most one; overlaps count twice."""
    total = F.aggregate(boxes, F.lit(0.0), lambda a, b: a + g.area(b))
    return F.when(width * height > 0, F.least(F.lit(1.0), total / (width * height))).otherwise(F.lit(0.0))


def disclosure_of(url: Column, share: Column) -> Column:
    """1: structure only; 2: with picture."""
    host = F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return F.when(host.rlike(SENSITIVE_HOST) | (share > MAX_AREA), 1).otherwise(2)


# --- elements on the wire -------------------------------------------------------


def rounded(box: Column) -> Column:
    return F.array(*[F.round(box[c]).cast("int") for c in "xywh"])


def wire_element(e: Column, clean) -> Column:
    """What of an element may leave: labels clamped and cleaned, a password only as
    filled or not, a sensitive value as its token, any other value cleaned.
    ``clean`` cleans one text."""
    text = lambda c, most=120: F.when(clamp_label(c, most) != "", clean(clamp_label(c, most)))
    value = F.coalesce(e.value, F.lit(""))
    shown = (
        F.when(e.sensitive == "PASSWORD", F.lit(None).cast("string"))
        .when(e.sensitive.isNotNull() & (value != ""), e.token)
        .when(value != "", clean(F.left(value, F.lit(200))))
    )
    filled = F.when(e.sensitive == "PASSWORD", value != "").when(value != "", F.lit(True)).when(e.sensitive.isNotNull(), F.lit(False))
    return F.struct(
        e.id.alias("id"), e.role.alias("role"), rounded(e.box).alias("bbox"), text(e.label).alias("label"), text(e.text).alias("text"),
        text(e.placeholder, 60).alias("placeholder"), F.nullif(e.type, F.lit("")).alias("type"), F.when(e.disabled, True).alias("disabled"),
        F.when(e.required, True).alias("required"), e.checked.alias("checked"), e.sensitive.alias("sensitive"),
        shown.alias("value"), filled.alias("filled"),
    )


def wire_vision_element(e: Column) -> Column:
    """A control that was found in pixels: geometry and a role, nothing more."""
    return F.struct(
        e.id.alias("id"), e.role.alias("role"), rounded(e.box).alias("bbox"), F.lit("detected on screen (no DOM element)").alias("label")
    )


# --- the screen as text -----------------------------------------------------------


def covers(detection: Column, block: Column, least: float = COVER) -> Column:
    smaller = F.least(g.area(detection), g.area(block))
    return (g.common_area(detection, block) > 0) & (smaller > 0) & (g.common_area(detection, block) / smaller >= least)


def explains(finding: Column, pixels: Column) -> Column:
    """The finding fills most of the pixel box; the reverse says nothing."""
    return (g.common_area(finding, pixels) > 0) & (g.share_inside(finding, pixels) >= 0) & (g.common_area(finding, pixels) / g.area(pixels) >= EXPLAINS)


def withholding(detections: Column) -> Column:
    """Detections made in pixels that withhold the text below them: no faces, and
    no vague box that a finding in the text accounts for."""
    said = F.filter(detections, lambda d: d.source.isin("dom-text", "dom-field"))
    return let(
        said,
        lambda s: F.filter(
            detections,
            lambda d: d.source.isin("vision", "ocr")
            & (d.type != "FACE")
            & ~((d.type == "GENERIC") & (d.source == "vision") & F.exists(s, lambda t: explains(t.box, d.box))),
        ),
    )


def cut_at_word(text: Column, most: int) -> Column:
    """At most ``most`` characters and an ellipsis: cut at a space that is not
    before the middle, never inside a token."""
    head = F.left(text, F.lit(most))
    back = F.instr(F.reverse(head), " ")
    space = F.when(back > 0, F.length(head) - back).otherwise(F.lit(-1))
    at = F.when(space < most / 2, F.lit(most - 1)).otherwise(space)
    short = F.left(text, at + 1)
    opened = F.when(F.instr(F.reverse(short), "⟦") > 0, F.length(short) - F.instr(F.reverse(short), "⟦")).otherwise(F.lit(-1))
    closed = F.instr(F.substr(text, F.greatest(opened, F.lit(0)) + 1), "⟧")
    # a token that opens before the cut and closes at or after it moves the cut
    ends = F.greatest(opened, F.lit(0)) + closed - 1
    cut = F.when((opened >= 0) & (closed > 0) & (ends >= at), opened).otherwise(at)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(text, cut)), F.lit("…")))


def screen_text(blocks: Column, detections: Column, clean, most: int = MAX_TEXT) -> Column:
    """The text of a page's ``blocks`` (text, label, box) in reading order.

    A block below a pixel detection is withheld: its distinct tokens stand for it.
    A value whose label is the line before joins it.  Equal neighbours are one
    line.  Where the budget of characters is used up, an ellipsis ends the text.
    The order decides, so this is a fold over one page's blocks.
    """
    hidden = withholding(detections)

    def prepared(d: Column) -> Column:
        def one(b: Column) -> Column:
            over = F.filter(d, lambda x: covers(x.box, b.box))
            return let(
                over,
                lambda o: F.struct(
                    squeezed(b.text).alias("plain"),
                    squeezed(b.label).alias("label"),
                    (F.size(o) > 0).alias("covered"),
                    cut_at_word(
                        F.when(F.size(o) > 0, F.array_join(F.array_distinct(F.transform(o, lambda x: x.token)), " ")).otherwise(clean(squeezed(b.text))),
                        MAX_BLOCK,
                    ).alias("line"),
                ),
            )

        return F.transform(blocks, one)

    start = F.struct(
        F.array().cast("array<string>").alias("lines"), F.lit(0).alias("used"), F.lit("").alias("before"), F.lit(False).alias("full")
    )

    def step(acc: Column, b: Column) -> Column:
        last = F.when(F.size(acc.lines) > 0, F.element_at(acc.lines, -1))
        labelled = b.label.isNotNull() & (b.label == acc.before) & (F.size(acc.lines) > 0) & ~b.covered
        joined = F.concat(last, F.when(last.rlike("[:：]$"), " ").otherwise(": "), b.line)
        base = F.when(labelled, acc.used - F.length(last) - 1).otherwise(acc.used)
        rest = F.when(labelled, F.slice(acc.lines, 1, F.size(acc.lines) - 1)).otherwise(acc.lines)
        new = F.when(labelled, joined).otherwise(b.line)
        over = base + F.length(new) + 1 > most
        kept = lambda lines, used, full: F.struct(lines.alias("lines"), used.alias("used"), b.plain.alias("before"), full.alias("full"))
        return (
            F.when(acc.full, acc)
            .when((b.line == "") | b.line.eqNullSafe(last), kept(acc.lines, acc.used, F.lit(False)))
            .when(over, kept(F.concat(rest, F.array(F.lit("…"))), base, F.lit(True)))
            .otherwise(kept(F.concat(rest, F.array(new)), base + F.length(new) + 1, F.lit(False)))
        )

    return F.array_join(F.aggregate(let(hidden, prepared), start, step, lambda acc: acc.lines), "\n")


# --- requests ---------------------------------------------------------------------


def needs_image(request: Column) -> Column:
    """Whether the text does not say all: none there, controls that were found in
    pixels, or something hidden in a picture."""
    return (
        (F.coalesce(request.visible_text, F.lit("")) == "")
        | F.exists(request.elements, lambda e: e.id >= 1000)
        | F.exists(request.redactions, lambda r: r.source.isin("ocr", "dom-image"))
    )


def described(elements: Column, redactions: Column) -> Column:
    """Counts of the kinds of controls, distinct hidden types, first buttons."""
    role = lambda *names: F.size(F.filter(elements, lambda e: e.role.isin(*names)))
    buttons = F.filter(F.transform(F.filter(elements, lambda e: e.role == "button"), lambda e: F.coalesce(F.nullif(e.label, F.lit("")), e.text)), lambda x: x.isNotNull() & (x != ""))
    return F.struct(
        role("textbox", "searchbox", "spinbutton").alias("fields"), role("combobox").alias("choices"), role("button").alias("buttons"),
        role("link").alias("links"), role("checkbox", "radio").alias("boxes"),
        F.array_sort(F.array_distinct(F.transform(redactions, lambda r: r.type))).alias("hidden"), F.slice(buttons, 1, 4).alias("first_buttons"),
    )


def last_of(items: Column, most: int) -> Column:
    """The last ``most`` entries, all where there are fewer."""
    return F.slice(items, F.greatest(F.size(items) - most, F.lit(0)) + 1, most)


def ledger(runs: DataFrame, keep: tuple[str, ...] = ("session",)) -> DataFrame:
    """Requests, bytes that left and steps that stayed, of steps (planner, payload)."""
    local = F.col("planner") == "local"
    return runs.groupBy(*keep).agg(
        F.sum(F.when(~local, 1).otherwise(0)).alias("requests"),
        F.coalesce(F.sum(F.when(~local, F.octet_length("payload").cast("long"))), F.lit(0)).alias("bytes"),
        F.sum(F.when(local, 1).otherwise(0)).alias("local_steps"),
    )


def audit_row(step: DataFrame) -> DataFrame:
    """What the view keeps of a step: of a rejected one kinds and paths, no value."""
    took = step.where("size(incidents) = 0").select("at", "session", F.lit("step").alias("event"), "action", F.array().cast("array<struct<type:string,path:string>>").alias("incidents"))
    refused = step.where("size(incidents) > 0").select(
        "at", "session", F.lit("rejected").alias("event"), F.lit(None).cast("string").alias("action"),
        F.transform("incidents", lambda i: F.struct(i.type.alias("type"), i.path.alias("path"))).alias("incidents"),
    )
    return took.unionByName(refused)


def recent(steps: DataFrame, most: int = 20) -> DataFrame:
    """The last steps by ``at``; of equal times the greater payloads of all columns."""
    return steps.orderBy(*[F.col(c).desc() for c in ["at", *[c for c in steps.columns if c != "at"]]]).limit(most)


#: Bounds of a wait in milliseconds, and the wait of a step that names none.
WAIT, WAIT_UNNAMED = (100, 5000), 800
#: Steps that a task may take.
STEP_BUDGET = 12


def waited(ms: Column) -> Column:
    return F.least(F.greatest(F.coalesce(ms, F.lit(WAIT_UNNAMED)), F.lit(WAIT[0])), F.lit(WAIT[1]))


def within_budget(step: Column, most: int = STEP_BUDGET) -> Column:
    """Whether a task takes the step with this number, from 0."""
    return F.coalesce((step >= 0) & (step < most), F.lit(False))


#: Notes that a model is given with a request.
NO_PICTURE = (
    "NOTE: no screenshot this step. The page was judged too sensitive, or redaction covered too much of it to be worth sending. "
    "Work from the element list and their bounding boxes alone."
)
NOT_ATTACHED = (
    "NOTE: no screenshot this step — the element list and the screen text below describe everything on the page. Refer to elements by id."
)
MORE_BELOW = "The page continues below what is on screen; scroll down to see more of it."
A_QUESTION = (
    "THIS TASK IS A QUESTION. Do not click, type or scroll. Reply now with "
    '{"action": "done", "summary": "<the answer, in the words of the SCREEN TEXT>"}. '
    "If the answer is behind a token, the token is the answer."
)
ONE_ACTION = "Respond with exactly one JSON action object."
#: Steps of the history that a model is given.
HISTORY = 8


def prompt(r: Column) -> Column:
    """The text that a model is given with a request: what is null or empty is left
    out.  ``r`` has task, step, origin, path, title, level, attached, profile_keys,
    redactions, elements, visible_text, more_below, history and conversation (task,
    summary); elements have role, value and filled at least.  The value of a box or
    radio is not its state, and is left out."""
    there = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    stated = lambda e, c: F.when(~F.coalesce(e.role.isin("checkbox", "radio"), F.lit(False)), c)
    boxes = F.transform(r.elements, lambda e: e.withField("value", stated(e, e.value)).withField("filled", stated(e, e.filled)))
    turns = F.transform(r.conversation, lambda t: F.concat(F.lit("- user: "), t.task, F.when(there(t.summary), F.concat(F.lit("\n  you: "), t.summary)).otherwise("")))
    json = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    keys = F.array_join(r.profile_keys, ", ")
    return F.concat_ws(
        "\n\n",
        F.when(some(r.conversation), F.concat(F.lit("EARLIER IN THIS CONVERSATION (oldest first):\n"), F.array_join(turns, "\n"))),
        F.concat(F.lit("TASK: "), F.coalesce(r.task, F.lit(""))),
        F.concat(F.lit("STEP: "), F.coalesce(r.step, F.lit(0)).cast("string")),
        F.concat(F.lit("PAGE: "), F.coalesce(r.origin, F.lit("")), F.coalesce(r.path, F.lit("")), F.when(there(r.title), F.concat(F.lit(" — "), r.title)).otherwise("")),
        F.when(F.coalesce(r.level, F.lit(1)) < 2, NO_PICTURE).when(~F.coalesce(r.attached, F.lit(False)), NOT_ATTACHED),
        F.concat(F.lit("PROFILE KEYS AVAILABLE: "), F.when(there(keys), keys).otherwise("(none)")),
        F.concat(F.lit("REDACTIONS ON THIS SCREEN:\n"), json(r.redactions)),
        F.concat(F.lit("ELEMENTS:\n"), json(boxes)),
        F.when(there(r.visible_text), F.concat(F.lit("SCREEN TEXT (reading order; personal data already replaced by tokens):\n"), r.visible_text)),
        F.when(r.more_below, MORE_BELOW),
        F.when(some(r.history), F.concat(F.lit("HISTORY (most recent last):\n"), F.to_json(last_of(r.history, HISTORY)))),
        F.when(is_question(F.coalesce(r.task, F.lit(""))), A_QUESTION),
        F.lit(ONE_ACTION),
    )
