"""Review finders: questions for a person, never failures.

A finder is active for the criteria it serves. Finders on single elements are conditions,
those on scripts are patterns over lines, and the others are joins, windows and grouped
sums over elements, declarations and lines, as rules are. Output: file_id, line, col,
finder_id, criterion, confidence and prompt; a finder with several criteria asks once for
each. Files that hold no match, null sources and empty tables give no candidate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrase
from ..sources.scripts import read_code
from .findings import pragma_reasons
from .registry import Tables
from .rules import HEADINGS, INTERACTIVE_ROLES, ancestors, any_of, attr, blank, has, hidden, interactive, lower, number, parents, roles, sheet_rules, some_class, tag
from .scripts import dom_actions, of_project

# ---- fixed values -------------------------------------------------------------------
HIDDEN_TEXT = r"^(sr-only|visually-hidden|screen-reader-text|visuallyhidden)$"
GLYPHS = ["«", "»", "‹", "›", "<", ">", "<<", ">>", "←", "→"]
VAGUE_HEADINGS = ["section", "heading", "title", "untitled", "content", "text", "more", "info", "misc", "other", "label", "field", "input", "value", "name here", "new", "item"]
STATUS_COLOURS = r"^(text|bg|badge|label|border|alert)-(danger|success|warning|error|red|green|yellow|orange)(-\d+)?$"
STATUS_WORDS = r"(?i)\b(error|failed|failure|success|succeeded|warning|ok|done|passed|invalid|valid|required|danger|alert|note|overdue|paid|active|inactive)\b"
HIGH_IMPACT = r"(?i)\b(pay|payment|purchase|buy|order|checkout|transfer|delete|submit application|sign contract|book|donate)\b"
REVIEW_SIGNAL = r"(?i)\b(review|confirm|confirmation|undo|cancel order|are you sure|check your)\b"
CORRECTIVE = r"(?i)\b(must|should|use|enter|format|example|e\.g\.|between|at least|at most|include|try)\b"
SENSORY = r"(?i)\b((round|square|circular|triangular|red|green|blue|yellow|large|small)\s+(button|icon|link|box|arrow|field)|(on|to|at)\s+the\s+(left|right|top|bottom)|(button|link|menu|box|panel)\s+(above|below|on the (left|right)))\b"
MEANING = r"(?i)\b(error|warning|success|failed|new|sale|verified|featured|popular|sold out|happy|sad|angry)\b"
CHALLENGE = r"(?i)(recaptcha|hcaptcha|turnstile|friendly-?captcha|\bcaptcha\b)"
MEDIA_CRITERIA = ["1.2.4", "1.2.6", "1.2.7", "1.2.8", "1.2.9", "1.4.7"]
TOGGLES = r"(?i)^(mute|unmute|favou?rite|like|bookmark|follow|pin|bold|italic|underline|dark mode|expand|collapse)$"


@dataclass(frozen=True)
class Finder:
    id: str
    criteria: tuple[str, ...]
    find: Callable[[Tables], DataFrame] = field(compare=False)
    prompt: str = ""


FINDERS: dict[str, Finder] = {}


def finder(id_: str, criteria: str, prompt: str):
    """Register ``find``: Tables -> file_id, line, col (and criterion or confidence to override)."""

    def keep(find):
        FINDERS[id_] = Finder(id_, tuple(criteria.split()), find, prompt)
        return find

    return keep


def run_finders(t: Tables, ids: list[str] | None = None) -> DataFrame:
    """All candidates of the chosen finders (all of them by default)."""
    shape = ["file_id", "line", "col", "finder_id", "criterion", "confidence", "prompt"]
    parts = []
    for f in (FINDERS[i] for i in (ids or sorted(FINDERS))):
        found = f.find(t)
        own = "criterion" in found.columns
        found = found.withColumn("_c", F.col("confidence") if "confidence" in found.columns else F.lit("medium"))
        found = found.withColumn("_k", F.col("criterion") if own else F.explode(F.array(*map(F.lit, f.criteria))))
        parts.append(found.select("file_id", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), F.lit(f.id).alias("finder_id"), F.col("_k").alias("criterion"), F.col("_c").alias("confidence"), F.lit(f.prompt).alias("prompt")).select(shape))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def places(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("file_id", "line", "col", *more)


def lines(t: Tables, pattern: str) -> DataFrame:
    """file_id, line, col and source of the lines of code that match: comments, and strings
    that are more than a name, are blank. Files without a match are neither read nor cut up."""
    code = read_code(t.files.filter(F.col("source").rlike(pattern)))
    rows = code.select("file_id", F.posexplode(F.split("source", "\n")).alias("line", "source"))
    return rows.filter(F.col("source").rlike(pattern)).select("file_id", (F.col("line") + 1).alias("line"), F.lit(1).alias("col"), "source")


# ---- finders on single elements -----------------------------------------------------
def _no_autocomplete() -> Column:
    return (tag("select", "textarea") | (tag("input") & ~lower("type").isin("hidden", "submit", "reset", "button", "image", "checkbox", "radio", "file", "range", "color"))) & ~has("autocomplete")


def _warned() -> Column:
    return F.lower(F.concat_ws(" ", "text", attr("aria-label"), attr("title"))).rlike("new (window|tab)|opens in|external")


for id_, criteria, condition, prompt in [
    ("review/carousel-pattern", "2.2.2", lambda: lower("aria-roledescription").isin("carousel", "slide") | (lower("data-ride") == "carousel") | (lower("data-bs-ride") == "carousel") | some_class("^(carousel|slider|swiper|slick|slideshow|splide)$"), "Can this rotation be paused?"),
    ("review/data-bg-image", "1.1.1", lambda: ~tag("img", "source") & F.concat_ws(" ", attr("data-src"), attr("data-bg"), attr("data-background"), attr("data-background-image")).rlike(r"(?i)\.(png|jpe?g|gif|webp|svg|avif)"), "Does the background picture say something?"),
    ("review/error-identification", "3.3.1", lambda: (lower("aria-invalid") == "true") & ~has("aria-describedby") & ~has("aria-errormessage"), "Is the error described in text?"),
    ("review/focus-order", "2.4.3", lambda: (attr("tabindex") == "-1") & (tag("button", "select", "textarea", "summary") | (tag("a") & has("href")) | (tag("input") & (lower("type") != "hidden")) | roles(*INTERACTIVE_ROLES)), "Is it right that this is left out of the order of focus?"),
    ("review/form-required-attrs", "3.3.1", lambda: tag("input", "select", "textarea") & (any_of(["required", "pattern", "min", "max", "minlength", "maxlength", "step"]) | (lower("aria-required") == "true")), "Is the error message of this constraint helpful?"),
    ("review/headings-and-labels", "2.4.6", lambda: tag(*HEADINGS, "label") & phrase(F.col("text")).isin(*VAGUE_HEADINGS), "Does this heading or label describe its topic?"),
    ("review/identify-purpose", "1.3.6", _no_autocomplete, "Can the purpose of this field be told?"),
    ("review/live-region-pre-existence", "4.1.3", lambda: (lower("aria-live").isin("polite", "assertive") | roles("status", "alert", "log")) & (has("hidden") | lower("style").rlike(r"display\s*:\s*none") | some_class("^(d-none|hidden|is-hidden)$")), "Is the region there before its message?"),
    ("review/media-variants", " ".join(MEDIA_CRITERIA), lambda: tag("audio", "video"), "Does the media have this alternative?"),
    ("review/no-keyboard-trap", "2.1.2", lambda: tag("dialog") | roles("dialog", "alertdialog") | some_class("^modal$") | number("tabindex").isNotNull(), "Can the keyboard leave this part?"),
    ("review/pagination-glyph-accessible-name", "2.4.4 4.1.2", lambda: tag("a") & F.trim("text").isin(*GLYPHS) & blank(attr("aria-label")), "Does the glyph name where the link goes?"),
    ("review/password-inputs", "3.3.8", lambda: tag("input") & (lower("type") == "password"), "Can one sign in without remembering or copying?"),
    ("review/sensory-characteristics", "1.3.3", lambda: tag("p", "li", "td", "label", "legend", "figcaption", "dd", "h1", "h2", "h3") & F.col("text").rlike(SENSORY), "Is the instruction clear without seeing shape or place?"),
    ("review/target-blank-no-warning", "3.2.5", lambda: tag("a") & (lower("target") == "_blank") & ~_warned(), "Is the new window announced?"),
    ("review/toggle-button-pressed-missing", "4.1.2", lambda: (tag("button") | roles("button")) & (some_class("^(btn-)?toggle(-.*)?$") | lower("data-toggle").isin("button") | lower("data-bs-toggle").isin("button") | phrase(F.coalesce(attr("aria-label"), F.col("text"))).rlike(TOGGLES)) & ~has("aria-pressed") & ~has("aria-checked") & ~has("aria-expanded") & ~roles("switch"), "Does the button say whether it is pressed?"),
]:
    finder(id_, criteria, prompt)(lambda t, c=condition: places(t.nodes.filter(c())))


@finder("review/on-input-change", "3.2.1 3.2.2", "Does focus or input change the context?")
def on_input_change(t: Tables) -> DataFrame:
    code = F.concat_ws(" ", attr("onfocus"), attr("onblur"), attr("onchange"))
    leaves = code.rlike(r"location|submit\(|window\.open|navigate")
    return places(t.nodes.filter(any_of(["onfocus", "onblur", "onchange"])).withColumn("confidence", F.when(leaves, "high").otherwise("low")), "confidence")


@finder("review/media-alternatives", "1.2.1 1.2.3 1.2.5", "Is there an alternative to the media?")
def media_alternatives(t: Tables) -> DataFrame:
    asks = F.when(tag("audio"), F.array(F.lit("1.2.1"))).otherwise(F.array(*map(F.lit, ("1.2.1", "1.2.3", "1.2.5"))))
    return t.nodes.filter(tag("audio", "video")).select("file_id", "line", "col", F.explode(asks).alias("criterion"))


# ---- finders on lines of source -----------------------------------------------------
for id_, criteria, pattern, prompt in [
    ("review/captcha", "3.3.8 3.3.9", CHALLENGE, "Is there a way around the test?"),
    ("review/drag-events", "2.5.7", r"addEventListener\(\s*['\"](drag\w*|drop)['\"]|\bondrag(start|end|over)?\s*=", "Is there a way without dragging?"),
    ("review/live-region-runtime-mutation-missing", "4.1.3", r"\.(innerHTML|textContent|innerText)\s*=[^=]", "Is the change announced?"),
    ("review/motion-actuation", "2.5.4", r"(?i)devicemotion|deviceorientation|Accelerometer\(|Gyroscope\(", "Can the motion be switched off?"),
    ("review/pointer-input", "2.5.1 2.5.6", r"(?i)\bon(touchmove|gesturestart|gesturechange)\b|addEventListener\(\s*['\"](touchmove|touchstart|gesture\w+|mousedown)['\"]|\b(hammer|swipe|pinch)\w*\(|new Hammer", "Is there a way with one pointer and without a path?"),
    ("review/validation-timing", "3.3.3 3.3.4", r"(?i)\bon(input|keyup|keypress)\s*=\s*[^>]*valid|addEventListener\(\s*['\"](input|keyup|keypress)['\"][^;]*valid", "Does validation wait for the end of input?"),
]:
    finder(id_, criteria, prompt)(lambda t, p=pattern: places(lines(t, p)))


@finder("review/timing", "2.2.1 2.2.2 2.2.3 2.2.4 2.2.5 2.2.6", "Can the time limit be changed?")
def timing(t: Tables) -> DataFrame:
    """Refreshing pages, and timers with a duration of a second or more."""
    pattern = r"set(Timeout|Interval)\s*\([^;]*?,\s*(\d+)\s*\)"
    timers = lines(t, pattern).filter(F.regexp_extract("source", pattern, 2).try_cast("long") >= 1000)
    return places(timers).unionByName(places(t.nodes.filter(tag("meta") & (lower("http-equiv") == "refresh"))))


@finder("review/flashing-content", "2.3.1", "Does anything flash more than three times a second?")
def flashing(t: Tables) -> DataFrame:
    elements = t.nodes.filter(tag("marquee", "blink") | (tag("video") & has("autoplay")))
    out = places(elements).unionByName(places(lines(t, r"requestAnimationFrame\(")))
    if t.css is None:
        return out
    seconds = F.regexp_extract("value", r"(?i)([\d.]+)(ms|s)\b", 1).try_cast("double") / F.when(F.regexp_extract("value", r"(?i)([\d.]+)(ms|s)\b", 2) == "ms", 1000).otherwise(1)
    return out.unionByName(t.css.filter(F.col("property").isin("animation", "animation-duration") & (seconds < 0.334) & (seconds > 0)).select("file_id", "line", F.lit(1).alias("col")))


@finder("suppression/no-reason", "suppression-no-reason", "Why is this switched off?")
def no_reason(t: Tables) -> DataFrame:
    return pragma_reasons(t.files).filter("reason is null").select("file_id", "line", F.lit(1).alias("col"))


# ---- finders on several elements ----------------------------------------------------
def inside(t: Tables, rows: DataFrame, host: Column, *columns: str) -> DataFrame:
    """``rows`` with their innermost host's node, line and column."""
    own = ancestors(t, rows, host, "line", "col", *columns)
    first = Window.partitionBy("file_id", "node_id").orderBy(F.desc("above"))
    return own.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def at_host(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "above", F.col("above_line").alias("line"), F.col("above_col").alias("col")).distinct().drop("above")


def siblings(t: Tables, *columns: str) -> DataFrame:
    """Elements with the columns of the sibling before (before_) and after (after_)."""
    order = Window.partitionBy("file_id", "parent_id").orderBy("ord")
    return t.nodes.withColumns({f"before_{c}": F.lag(c).over(order) for c in columns} | {f"after_{c}": F.lead(c).over(order) for c in columns})


def words(c: Column | str) -> Column:
    return F.filter(F.split(phrase(c if isinstance(c, Column) else F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@finder("review/accessible-name-redundant-composition", "2.4.6 4.1.2", "Does the name say something twice?")
def redundant_name(t: Tables) -> DataFrame:
    host = (tag("a") & has("href")) | tag("button")
    said = inside(t, t.nodes.filter(some_class(HIDDEN_TEXT)).withColumn("w", words("text")), host).groupBy("file_id", "above").agg(F.flatten(F.collect_list("w")).alias("said"))
    shown = inside(t, t.nodes.filter(tag("img") & ~blank(attr("alt"))).withColumn("w", words(attr("alt"))), host, "tag").select("file_id", "above", "above_line", "above_col", "above_tag", "w")
    both = shown.join(said, ["file_id", "above"])
    return at_host(both.filter(F.arrays_overlap("w", "said") | F.arrays_overlap("w", F.array(F.lit("link"), F.lit("button")))))


@finder("review/alt-duplicates-sibling-text", "1.1.1", "Is the picture's text needed beside the same words?")
def alt_twice(t: Tables) -> DataFrame:
    rows = inside(t, t.nodes.filter(tag("img") & ~blank(attr("alt"))), (tag("a") & has("href")) | tag("button", "label"), "text")
    return places(rows.filter(phrase(attr("alt")) == phrase(F.col("above_text"))))


@finder("review/auto-advance-no-pause-control", "2.2.2", "Can the movement be paused?")
def auto_advance(t: Tables) -> DataFrame:
    every = F.coalesce(attr("data-interval"), attr("data-bs-interval"))
    moves = (lower("data-ride") == "carousel") | (lower("data-bs-ride") == "carousel") | lower("data-autoplay").isin("true", "1", "") & has("data-autoplay") | some_class("^auto(play|scroll)$")
    rows = t.nodes.filter(moves & ~F.coalesce(every.isin("false", "0"), F.lit(False)))
    control = tag("button", "a", "input") & F.lower(F.concat_ws(" ", "text", attr("aria-label"), attr("class"), attr("value"))).rlike("pause|stop")
    return places(rows.join(t.nodes.filter(control).select("file_id").distinct(), "file_id", "left_anti"))


def coloured_classes(t: Tables) -> DataFrame:
    """Class names whose rules set colours and nothing else."""
    rows = sheet_rules(t).withColumn("only", F.forall("pairs", lambda p: p["property"].rlike("color|^background$|^fill$|^stroke$")))
    names = rows.select("only", F.explode(F.regexp_extract_all("selector", F.lit(r"\.([A-Za-z_][\w-]*)"), F.lit(1))).alias("class"))
    return names.groupBy("class").agg(F.bool_and("only").alias("only")).filter("only").select("class")


@finder("review/color-class-crossref", "1.4.1", "Does only a colour tell this apart?")
def colour_classes(t: Tables) -> DataFrame:
    """A join of style sheets with the markup of all files on the class name."""
    used = t.nodes.select("file_id", "line", "col", F.explode(F.array_distinct("classes")).alias("class"))
    return places(used.join(coloured_classes(t), "class"))


@finder("review/consistent-identification", "3.2.4", "Are things of one function named alike?")
def one_name(t: Tables) -> DataFrame:
    key = F.coalesce(F.nullif(attr("data-testid"), F.lit("")), F.nullif(attr("aria-label"), F.lit("")))
    rows = t.nodes.filter(interactive()).withColumn("key", key).filter("key is not null").withColumn("said", phrase(F.col("text"))).filter("said <> ''")
    rows = of_project(t, rows)
    several = rows.groupBy("project", "key").agg(F.min("said").alias("a"), F.max("said").alias("b")).filter("a <> b").select("project", "key")
    return places(rows.join(several, ["project", "key"]))


@finder("review/consistent-navigation", "3.2.3", "Is the order of navigation the same on all pages?")
def one_order(t: Tables) -> DataFrame:
    rows = inside(t, t.nodes.filter(tag("a") & has("href")).withColumn("href", attr("href")), tag("nav"))
    navs = rows.groupBy("file_id", "above").agg(F.array_sort(F.collect_list(F.struct("node_id", "href"))).alias("found"), F.first("above_line").alias("line"), F.first("above_col").alias("col"))
    navs = navs.withColumn("order", F.array_join(F.transform("found", lambda x: x["href"]), "\n")).withColumn("key", F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["href"]))), "\n"))
    navs = of_project(t, navs)
    several = navs.groupBy("project", "key").agg(F.min("order").alias("a"), F.max("order").alias("b")).filter("a <> b").select("project", "key")
    return places(navs.join(several, ["project", "key"]))


def clicked(t: Tables) -> DataFrame:
    """(project, kind, token) of the ids and classes on which scripts put click handlers."""
    return of_project(t, dom_actions(t).filter("what = 'event' and detail = 'click'")).select("project", "kind", "token").distinct()


def selected(t: Tables, chosen: DataFrame) -> DataFrame:
    """Elements that (project, kind, token) choose: equi-joins on the token."""
    tokens = F.array_union(F.transform("classes", lambda c: F.struct(F.lit("class").alias("kind"), c.alias("token"))), F.when(F.col("id") != "", F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("token")))).otherwise(F.array().cast("array<struct<kind:string,token:string>>")))
    rows = t.nodes.withColumn("_t", F.explode(tokens)).select("*", "_t.kind", "_t.token").drop("_t")
    return of_project(t, rows).join(chosen, ["project", "kind", "token"], "left_semi").dropDuplicates(["file_id", "node_id"])


@finder("review/cross-file-click-handler-on-non-interactive", "2.1.1 4.1.2", "Can the keyboard do what the click does?")
def click_targets(t: Tables) -> DataFrame:
    return places(selected(t, clicked(t)).filter(~interactive() & ~tag("label", "option", "summary")))


@finder("review/decorative-img-with-adjacent-meaning", "1.1.1", "Is the picture decoration?")
def meaningful_decoration(t: Tables) -> DataFrame:
    rows = t.nodes.filter(tag("img") & has("alt") & blank(attr("alt"))).join(parents(t, "text"), ["file_id", "parent_id"])
    return places(rows.filter((F.length("parent_text") <= 60) & F.col("parent_text").rlike(MEANING)))


@finder("review/error-prevention", "3.3.4", "Can what is sent be checked or taken back?")
def error_prevention(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", "text", attr("id"), attr("action"), attr("aria-label"))
    safe = t.nodes.filter(F.col("text").rlike(REVIEW_SIGNAL) & tag("button", "a", "p", "label", *HEADINGS)).select("file_id").distinct()
    return places(t.nodes.filter(tag("form") & said.rlike(HIGH_IMPACT)).join(safe, "file_id", "left_anti"))


@finder("review/error-suggestion", "3.3.3", "Does the message say how to mend the error?")
def error_suggestion(t: Tables) -> DataFrame:
    fields = t.nodes.filter(tag("input", "textarea", "select") & (any_of(["pattern", "min", "max", "minlength", "maxlength"]) | lower("type").isin("email", "url", "tel", "number", "date")))
    asked = F.explode(F.split(F.concat_ws(" ", attr("aria-errormessage"), attr("aria-describedby")), r"\s+"))
    rows = fields.select("file_id", "line", "col", asked.alias("target")).filter("target <> ''")
    told = t.nodes.filter("id <> ''").select("file_id", F.col("id").alias("target"), F.trim("text").alias("told"))
    return places(rows.join(told, ["file_id", "target"]).filter((F.length("told") < 40) & ~F.col("told").rlike(CORRECTIVE)).distinct())


@finder("review/meaningful-sequence", "1.3.2", "Does the order on screen follow the source?")
def sequence(t: Tables) -> DataFrame:
    out = places(t.nodes.filter(some_class(r"^((sm|md|lg|xl|xxl)[:-])?(order-(\d+|first|last)|flex-(row|column|col)-reverse)$")))
    if t.css is None:
        return out
    moved = ((F.col("property") == "order") & ~F.col("value").isin("0", "initial")) | (F.col("property").isin("flex-direction", "flex-flow") & F.col("value").contains("reverse"))
    return out.unionByName(t.css.filter(moved & ~F.col("selector").rlike(r"\.(order-|flex-)")).select("file_id", "line", F.lit(1).alias("col")))


@finder("review/multiple-ways", "2.4.5", "Is there another way to find pages?")
def multiple_ways(t: Tables) -> DataFrame:
    """One question for all files: the first page with navigation, if none has a search, site map or breadcrumb."""
    way = (tag("input") & (lower("type") == "search")) | roles("search") | tag("search") | some_class("^breadcrumbs?$") | (tag("a") & F.lower("text").rlike("site ?map")) | lower("aria-label").contains("breadcrumb")
    pages = t.nodes.groupBy("file_id").agg(F.bool_or(tag("nav")).alias("nav"), F.bool_or(way).alias("way"), F.min(F.when(tag("nav"), F.struct("node_id", "line", "col"))).alias("at"), F.bool_or(tag("body")).alias("page"))
    some = pages.agg(F.bool_or("way").alias("some"), F.min(F.when(F.col("nav") & F.col("page"), F.struct("file_id", "at"))).alias("first"))
    return some.filter("first is not null and not some").select("first.file_id", "first.at.line", "first.at.col")


@finder("review/otp-input-cluster", "1.3.1 1.3.5 3.3.2", "Are the single-character fields one thing to readers?")
def code_fields(t: Tables) -> DataFrame:
    cells = t.nodes.filter(tag("input") & (F.trim(attr("maxlength")) == "1")).groupBy("file_id", "parent_id").agg(F.count("*").alias("n"), F.min(F.struct("node_id", "line", "col")).alias("at"))
    return cells.filter("n >= 4").select("file_id", "at.line", "at.col")


@finder("review/reduced-motion-candidate", "2.3.3", "Is motion reduced for those who ask?")
def reduced_motion(t: Tables) -> DataFrame:
    guarded = t.css.filter(F.exists("at_rules", lambda a: a.contains("prefers-reduced-motion"))).select("file_id").distinct()
    moving = t.css.filter(F.col("property").rlike("^(animation|transition)(-|$)") & ~F.lower("value").isin("none", "0s")).groupBy("file_id").agg(F.min("line").alias("line"))
    return moving.join(guarded, "file_id", "left_anti").select("file_id", "line", F.lit(1).alias("col"))


@finder("review/redundant-alt-text", "1.1.1", "Is the text alternative said again beside the picture?")
def repeated_alt(t: Tables) -> DataFrame:
    alt = phrase(attr("alt"))
    rows = siblings(t, "text").filter(tag("img") & ~blank(attr("alt")) & (F.length(attr("alt")) <= 50))
    near = lambda c: F.coalesce(F.contains(phrase(F.col(c)), alt), F.lit(False))
    return places(rows.filter(near("before_text") | near("after_text")))


@finder("review/redundant-entry", "3.3.7", "Must the same thing be entered again?")
def entered_again(t: Tables) -> DataFrame:
    key = F.coalesce(F.nullif(lower("autocomplete"), F.lit("")), F.when(lower("type") == "email", "email"), F.nullif(lower("name"), F.lit("")))
    rows = inside(t, t.nodes.filter(tag("input", "select", "textarea") & ~lower("type").isin("hidden", "submit", "button", "radio", "checkbox", "password")).withColumn("key", key).filter("key is not null and key not in ('on', 'off')"), tag("form"))
    order = Window.partitionBy("file_id", "above", "key").orderBy("node_id")
    return places(rows.withColumn("n", F.row_number().over(order)).filter("n > 1"))


@finder("review/section-headings", "2.4.10", "Does the section need a heading?")
def headless_sections(t: Tables) -> DataFrame:
    headed = ancestors(t, t.nodes.filter(tag(*HEADINGS)), tag("section")).select("file_id", F.col("above").alias("node_id")).distinct()
    return places(t.nodes.filter(tag("section") & blank(attr("aria-label")) & ~has("aria-labelledby")).join(headed, ["file_id", "node_id"], "left_anti"))


@finder("review/server-error-untied", "3.3.1", "Is the error tied to its field?")
def untied_errors(t: Tables) -> DataFrame:
    told = roles("alert") | lower("aria-live").isin("polite", "assertive") | some_class("^(invalid-feedback|error-message|field-error|error)$")
    rows = siblings(t, "tag", "attrs").filter(told & F.col("before_tag").isin("input", "select", "textarea"))
    tied = F.map_contains_key("before_attrs", F.lit("aria-describedby")) | F.map_contains_key("before_attrs", F.lit("aria-errormessage"))
    return places(rows.filter(~tied))


@finder("review/status-message-plus-minus-readout", "4.1.3", "Is the new value announced?")
def counters(t: Tables) -> DataFrame:
    sign = lambda c: F.trim(F.col(c))
    minus, plus = ["-", "−", "–"], ["+", "＋"]
    rows = siblings(t, "tag", "text").filter(tag("span", "div") & (F.col("before_tag") == "button") & (F.col("after_tag") == "button"))
    around = (sign("before_text").isin(*minus) & sign("after_text").isin(*plus)) | (sign("before_text").isin(*plus) & sign("after_text").isin(*minus))
    return places(rows.filter(around & ~has("aria-live") & ~roles("status", "spinbutton", "alert")))


@finder("review/use-of-color", "1.4.1", "Is there more than the colour?")
def colour_alone(t: Tables) -> DataFrame:
    icons = ancestors(t, t.nodes.filter(tag("svg", "img", "i")), some_class(STATUS_COLOURS)).select("file_id", F.col("above").alias("node_id")).distinct()
    return places(t.nodes.filter(some_class(STATUS_COLOURS) & ~F.col("text").rlike(STATUS_WORDS) & ~blank(F.col("text"))).join(icons, ["file_id", "node_id"], "left_anti"))


@finder("review/visually-hidden-only-name", "2.4.4", "Is the name clear beside the icon?")
def hidden_name(t: Tables) -> DataFrame:
    host = (tag("a") & has("href")) | tag("button")
    said = inside(t, t.nodes.filter(some_class(HIDDEN_TEXT) & ~blank(F.col("text"))), host, "text").filter(phrase(F.col("text")) == phrase(F.col("above_text")))
    icons = inside(t, t.nodes.filter(hidden() & tag("i", "svg", "span", "img")), host).select("file_id", "above").distinct()
    return at_host(said.join(icons, ["file_id", "above"], "left_semi"))


def prune(candidates: DataFrame, findings: DataFrame, subsets: list[tuple[str, str]] = (("1.3.6", "1.3.5"),)) -> DataFrame:
    """Candidates of a criterion go where a finding of the narrower one stands on the line."""
    pairs = F.broadcast(candidates.sparkSession.createDataFrame(list(subsets), "criterion string, narrow string"))
    told = findings.select("file_id", "line", F.explode("criteria").alias("narrow")).distinct().join(pairs, "narrow").select("file_id", "line", "criterion")
    return candidates.join(told, ["file_id", "line", "criterion"], "left_anti")

