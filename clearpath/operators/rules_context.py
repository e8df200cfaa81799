"""Rules that depend on the kind of page, on scripts, or on other files; and rules on
single elements whose predicate has several branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrase
from .finders import HIDDEN_TEXT, STATUS_COLOURS, STATUS_WORDS, clicked, lines, selected
from .pages import kind
from .registry import RULES, Rule, Tables, element_rule, place_rule, rule
from .rules import HEADINGS, INTERACTIVE_ROLES, KEY_HANDLERS, ancestors, any_of, attr, blank, calmed, found, has, hidden, interactive, label_for, lower, named, number, one, optional_field, parents, presentational, roles, some_class, tag, text_of
from .scripts import dom_actions, of_project
from .sheets import Sheet
from .tree import Hit, Place, tokens

# ---- fixed values: roles that tags have, and explicit roles that contradict them -----------
IMPLICIT = {
    "article": "article", "aside": "complementary", "main": "main", "nav": "navigation", "footer": "contentinfo", "header": "banner", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "button": "button", "img": "img", "table": "table", "td": "cell", "tr": "row", "ul": "list", "ol": "list", "menu": "list", "li": "listitem", "dialog": "dialog", "output": "status", "progress": "progressbar",
}
_LANDMARK_CONFLICTS = ["main", "navigation", "banner", "contentinfo", "complementary"]
CONFLICTS = {
    "button": ["link", *_LANDMARK_CONFLICTS, "article"], "link": ["button", *_LANDMARK_CONFLICTS], "main": ["navigation", "complementary", "banner", "contentinfo", "article", "region"],
    "navigation": ["main", "banner", "contentinfo", "complementary", "article"], "banner": ["main", "navigation", "contentinfo", "complementary"], "contentinfo": ["main", "navigation", "banner", "complementary"],
    "complementary": ["main", "navigation", "banner", "contentinfo"], "heading": ["button", "link", "tab", "menuitem"], "list": ["button", "link"], "listitem": ["button", "link"],
    "cell": ["button", "link"], "columnheader": ["button", "link"], "rowheader": ["button", "link"],
}
ICON = r"^(fa|fas|far|fab|fa-.+|bi|bi-.+|icon|icon-.+|glyphicon|glyphicon-.+|material-icons|mdi|mdi-.+)$"
PICTURE_HOSTS = r"(?i)^(https?:)?//([\w-]+\.)*(placeholder\.com|placehold\.co|placehold\.it|placekitten\.com|picsum\.photos|dummyimage\.com|loremflickr\.com|fakeimg\.pl)(/|$)"
EMPTY_ALTS = ["image", "img", "photo", "picture", "graphic", "icon", "placeholder", "alt", "alt text", "untitled", "todo", "logo", "logo image", "image alt", "description", "photograph", "screenshot", "thumbnail", "banner"]
VIDEO_HOSTS = r"(?i)^(https?:)?//([\w-]+\.)*(youtube\.com|youtube-nocookie\.com|youtu\.be|vimeo\.com|dailymotion\.com|wistia\.com|wistia\.net|loom\.com|twitch\.tv|brightcove\.net|vidyard\.com)(/|$)"
TOGGLE_VALUES = ["modal", "dropdown", "collapse", "tab", "pill", "offcanvas", "button"]


# ---- rules on single elements -----------------------------------------------------------
def implicit_role() -> Column:
    table = F.create_map(*(F.lit(x) for kv in IMPLICIT.items() for x in kv))
    return F.when(tag("a", "area"), F.when(has("href"), "link")).when(tag("th"), F.when(lower("scope") == "row", "rowheader").otherwise("columnheader")).otherwise(table[F.col("tag")])


def _conflicts() -> Column:
    table = F.create_map(*(x for k, v in CONFLICTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(table[implicit_role()], F.col("role")), F.lit(False))


def _empty_alt() -> Column:
    said, name = phrase(attr("alt")), F.lower(F.regexp_extract(F.coalesce(attr("src"), F.lit("")), r"([^/?#]+?)(\.\w+)?([?#].*)?$", 1))
    tokens = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 2)
    own = tokens(said)
    from_name = (F.size(own) > 0) & (F.size(F.array_except(own, tokens(name))) == 0) & F.lower(attr("alt")).rlike(r"[_-]|\.\w{3,4}$|\d")
    return (tag("img") | (tag("input") & (lower("type") == "image"))) & ~blank(attr("alt")) & (
        F.coalesce(F.trim(attr("src")).rlike(PICTURE_HOSTS), F.lit(False)) | said.isin(*EMPTY_ALTS) | said.rlike(r"^(image|img|photo|picture|dsc|untitled|slide|figure)[ _-]?\d+$")
        | said.rlike(r"^(\p{L}+)( \1)+$") | said.rlike(r"^(image|picture|photo|graphic|icon) of( an?| the)?( \S+){0,1}$") | from_name
    )


def _progress() -> Column:
    bar = tag("progress")
    now, low, high = (F.when(bar, number(a)).otherwise(number(b)) for a, b in (("value", "aria-valuenow"), ("min", "aria-valuemin"), ("max", "aria-valuemax")))
    given = F.when(bar, has("value")).otherwise(has("aria-valuenow"))
    told = roles("progressbar") & ~bar & (has("aria-valuemin") | has("aria-valuemax")) & ~given
    false = F.lit(False)
    wrong = F.coalesce(now > F.coalesce(high, F.when(bar, 1.0).otherwise(100.0)), false) | F.coalesce(now < F.coalesce(low, F.lit(0.0)), false) | F.coalesce(low > high, false) | (given & now.isNull())
    return (roles("progressbar") | bar) & (lower("aria-busy") != "true") & (wrong | told)


def _no_keyboard() -> Column:
    native = tag("a", "button", "input", "select", "textarea", "summary", "option", "label", "area")
    driven = has("onclick") | (((lower("data-bs-ride") == "carousel") | (lower("data-ride") == "carousel")) & ~has("tabindex")) | has("data-bs-dismiss") | has("data-dismiss") | lower("data-bs-toggle").isin(*TOGGLE_VALUES) | lower("data-toggle").isin(*TOGGLE_VALUES)
    return driven & ~any_of(KEY_HANDLERS) & ~native & ~((has("data-bs-dismiss") | has("data-dismiss") | has("data-bs-toggle") | has("data-toggle")) & ~has("onclick") & roles(*INTERACTIVE_ROLES) & F.coalesce(number("tabindex") >= 0, F.lit(False)))


_VALUE = r"^(\d{1,2}:\d{2}(:\d{2})?\s*([ap]\.?m\.?)?|[$€£]?\s*\d[\d.,\s]*\s*[%$€£]?|[\w.+-]+@[\w-]+\.\w+|\d{4}-\d\d?-\d\d?|\d\d?[/.]\d\d?[/.]\d{2,4}|https?://\S+|[-–—*.:]+)$"
for args in [
    ("aria/conflicting-role", "4.1.2", "error", _conflicts, "The role contradicts what the element is."),
    ("aria/progressbar-value-range", "4.1.2", "error", _progress, "A progress bar's value is not within its range."),
    ("forms/non-empty-label", "2.4.6 1.3.1 3.3.2", "error", lambda: tag("label") & ~named() & (blank(F.col("text")) | F.trim("text").rlike(_VALUE)), "A label has no text, or a value for it.", "guidance"),
    ("media/alt-text-placeholder", "1.1.1", "warning", _empty_alt, "The text alternative says nothing.", "guidance"),
]:
    element_rule(*args)


# ---- rules that depend on the kind of page ------------------------------------------------
@place_rule("document/page-titled", "2.4.2", "error")
def titled(p: Place) -> list[Hit]:
    """Titles in the head. Where a template fills in the title, or there is no body, it is told for information."""
    title = p.is_("title", tag("title")) & p.above("head", tag("head"))
    there = p.file("title", F.bool_or(title))
    said = p.file("title-text", F.bool_or(title & p.is_("text-title", text_of(tag("title")))))
    _, partial, _ = kind(p)
    block = p.about("title-block", F.col("source").rlike(r"(?i)\{%-?\s*block\s+title|@yield\(\s*['\"]title|@section\(\s*['\"]title|<%=?\s*yield\s*\(?:title"))
    bodyless = ~p.file("has-body", F.bool_or(p.is_("body", tag("body"))))
    unsure = block | (bodyless & partial & ~there & (F.col("last_id") > F.col("node_id")))
    return [Hit(p.is_("html", tag("html")) & ~said, F.when(there, "The page's title is empty.").otherwise("The page has no title."), F.when(unsure, "info").otherwise("error"))]


@place_rule("semantics/heading-hierarchy", "1.3.1 2.4.6", "warning")
def headings(p: Place) -> list[Hit]:
    """Fragments need no h1; in partials the findings are for information."""
    heading = p.is_("heading", tag(*HEADINGS))
    level = F.when(heading, F.substring("tag", 2, 1).cast("int"))
    fragment, partial, _ = kind(p)
    severity = F.when(partial, "info").otherwise("warning")
    before = p.running("level", F.last(level, True), itself=False)
    skipped = heading & (F.when(heading, F.substring("tag", 2, 1).cast("int")) > before + 1)
    first, tops = p.running("headings", F.count_if(heading)) == 1, p.running("tops", F.count_if(F.coalesce(level == 1, F.lit(False))))
    none = p.file("tops", F.count_if(F.coalesce(level == 1, F.lit(False)))) == 0
    return [
        Hit(skipped, F.concat(F.lit("A heading level is skipped: from h"), before.cast("string"), F.lit(" to "), "tag"), severity),
        Hit(heading & first & none & ~fragment, "There is no h1.", severity),
        Hit((F.col("tag") == "h1") & (tops > 1), "There is another h1.", severity),
    ]


@place_rule("semantics/landmark-main", "1.3.1", "warning")
def main_landmark(p: Place) -> list[Hit]:
    main = p.is_("main", tag("main") | roles("main"))
    _, partial, full = kind(p)
    lone = p.file("body-children", F.count_if(p.is_("body-child", F.coalesce(F.col("parent_tag") == "body", F.lit(False)) & ~tag("script", "style")))) <= 1
    marked = p.file("marked", F.bool_or(p.is_("mark", tag("nav", "header", "footer", "aside"))))
    none = p.is_("body", tag("body")) & full & (p.file("mains", F.count_if(main)) == 0)
    return [
        Hit(none, "The page has no main landmark.", F.when((lone & ~marked) | partial, "info").otherwise("warning")),
        Hit(main & (p.running("mains", F.count_if(main)) > 1), "There is another main landmark."),
    ]


@place_rule("semantics/duplicate-landmark-unlabeled", "1.3.1 2.4.1", "warning")
def landmarks(p: Place) -> list[Hit]:
    alike = F.lit(False)
    for name in ("nav", "aside", "form", "main", "header", "footer"):
        top = tag(name) if name not in ("header", "footer") else tag(name) & F.coalesce(F.col("parent_tag") == "body", F.lit(False))
        own = p.is_(f"landmark-{name}", top)
        alike = alike | (own & (p.file(f"landmarks-{name}", F.count_if(own)) >= 2))
    _, partial, _ = kind(p)
    return [Hit(alike & ~p.is_("named-landmark", tag("nav", "aside", "form", "main", "header", "footer") & named()), F.concat(F.lit("Several landmarks are alike: "), "tag"), F.when(partial, "info").otherwise("warning"))]


# ---- rules on several elements --------------------------------------------------------------
@place_rule("aria/disabled-link-surrogate", "4.1.2", "warning")
def disabled_links(p: Place) -> list[Hit]:
    """Text among links, in a paragraph or in the items of a list."""
    off = some_class(r"^(disabled|is-disabled|inactive)$") | some_class(r"^(prev|previous|next|first|last)(-(page|link))?$")
    text = p.is_("switched-off", tag("span", "div", "i", "b", "em") & off & ~has("aria-disabled") & ~F.lower("text").rlike("disabled|unavailable"))
    direct = p.beside("a", tag("a")) & F.col("parent_id").isNotNull()
    in_item = p.is_("off-in-item", F.coalesce(F.col("parent_tag") == "li", F.lit(False)))
    item_link = F.coalesce(F.col("parent_tag") == "li", F.lit(False)) & tag("a")
    return [Hit(text & (direct | (in_item & p.cousin("item-link", item_link))), "Text stands for a link that is switched off.")]


def silent_control() -> Column:
    return (tag("button", "summary") | (tag("a") & has("href")) | roles("button", "link", "menuitem", "tab")) & ~named() & blank(F.col("text"))


@place_rule("aria/icon-child-missing-aria-hidden", "1.3.1 4.1.2", "warning")
def icon_children(p: Place) -> list[Hit]:
    glyph = p.is_("icon", tag("i", "span") & some_class(ICON) & blank(F.col("text")) & ~has("aria-hidden") & ~presentational() & ~named())
    return [Hit(glyph & p.above("mute-control", silent_control()), "An icon in a control without a name is not hidden.")]


@place_rule("aria/icon-font-hidden", "4.1.2 1.3.1", "info")
def icons(p: Place) -> list[Hit]:
    """Icon glyphs that readers meet: alone or in prose, in a named control, or with only a title for a name."""
    drawn = tag("i", "span", "em") & ((some_class(ICON) & blank(F.col("text"))) | some_class("^material-(icons|symbols)"))
    glyph = (drawn | tag("ion-icon", "iconify-icon")) & ~hidden() & blank(attr("aria-label")) & ~has("aria-labelledby") & F.col("role").isNull()
    covered = p.above("mute-control", silent_control()) | p.above("hidden", hidden())
    # Beside a text that only readers hear, a glyph is a picture of that text.
    spoken = p.beside("spoken-text", some_class(HIDDEN_TEXT) & ~blank(F.col("text"))) & F.col("parent_id").isNotNull()
    titled_ = p.is_("titled-icon", glyph & ~blank(attr("title")))
    return [Hit(p.is_("glyph", glyph) & ~covered & ~(spoken & ~titled_), F.when(titled_, "An icon relies on its title.").otherwise("An icon is not hidden from readers of text."))]


@place_rule("aria/tab-widget-roles", "4.1.2 1.3.1", "error")
def tab_widgets(p: Place) -> list[Hit]:
    toggled = lower("data-toggle").isin("tab", "pill") | lower("data-bs-toggle").isin("tab", "pill")
    any_tab, tab = p.is_("any-tab", toggled | roles("tab")), p.is_("tab", roles("tab"))
    target = F.regexp_replace(F.coalesce(attr("data-bs-target"), attr("data-target"), attr("aria-controls"), attr("href")), "^#", "")
    p.mentions("tab-target", tokens(any_tab, one(p.value("tab-target", F.when(toggled | roles("tab"), target)))))
    other = p.is_("no-panel", (F.col("id") != "") & ~roles("tabpanel"))
    return [
        Hit(any_tab & ~tab, "A tab has no tab role."),
        Hit(tab & ~p.is_("selected", has("aria-selected")), "A tab does not say whether it is selected."),
        Hit(any_tab & ~p.above("tablist", roles("tablist")), "A tab stands in no tab list."),
        Hit(p.mentioned("no-panel", "self", other), "What a tab shows is no tab panel.", on="tab-target"),
    ]


@place_rule("color/meaning-by-color-only", "1.4.1 4.1.2", "error")
def meaning_by_colour(p: Place) -> list[Hit]:
    told = p.below("shown-too", tag("svg", "img", "i") | some_class(HIDDEN_TEXT) | some_class(ICON)) > 0
    coloured = p.is_("coloured", some_class(STATUS_COLOURS) & ~named() & ~F.col("text").rlike(STATUS_WORDS) & ~blank(F.col("text")) & ~roles("alert", "status") & ~has("aria-live"))
    return [Hit(coloured & ~told & ~p.above("live", roles("alert", "status", "log") | has("aria-live")), "Only a colour tells what this means.")]


@place_rule("forms/error-message-not-associated", "3.3.1 3.3.3", "error")
def loose_errors(p: Place) -> list[Hit]:
    certain = some_class(r"^(invalid-feedback|error-message|field-error)$") | roles("alert")
    maybe = some_class(r"^alert-(danger|warning)$") | F.coalesce(F.col("id").rlike(r"[-_]error$"), F.lit(False))
    field = p.earlier("field", F.when(tag("input", "select", "textarea"), F.concat_ws(" ", attr("aria-describedby"), attr("aria-errormessage"))))
    tied = F.coalesce(F.array_contains(F.split(field, r"\s+"), F.col("id")), F.lit(False))
    return [Hit(p.is_("message", certain | maybe) & field.isNotNull() & ~tied, "An error message is not tied to its field.", F.when(p.is_("certain-message", certain), "error").otherwise("info"))]


@place_rule("forms/required-marker-without-required-attr", "1.3.1 3.3.2", "error")
def marked_required(p: Place) -> list[Hit]:
    mark = (tag("span", "sup", "em", "b", "strong", "i") & (F.trim("text") == "*")) | (tag("abbr") & (lower("title") == "required"))
    label_for(p)
    starred = (p.below("required-mark", mark) > 0) | p.is_("says-required", tag("label") & F.lower("text").rlike(r"\brequired\b"))
    return [Hit(starred & optional_field(p), "A label says required, its field does not.", on="for")]


@rule("media/audio-controls-or-transcript-missing", "1.1.1", "warning")
def audio_alternatives(t: Tables) -> DataFrame:
    tracks = t.nodes.filter(tag("track")).select("file_id", F.col("parent_id").alias("node_id")).distinct()
    links = t.nodes.filter(tag("a") & F.lower("text").contains("transcript")).select("file_id", F.col("parent_id").alias("beside")).distinct()
    rows = t.nodes.filter(tag("audio") & ~has("controls")).join(tracks, ["file_id", "node_id"], "left_anti")
    told = rows.withColumn("beside", F.explode(F.array_compact(F.array(F.col("parent_id"), F.get("ancestors", F.size("ancestors") - 2))))).join(links, ["file_id", "beside"]).select("file_id", "node_id").distinct()
    return found(rows.join(told, ["file_id", "node_id"], "left_anti"), "Audio has neither controls nor a transcript.")


@place_rule("media/video-captions-missing", "1.2.2", "warning")
def captions(p: Place) -> list[Hit]:
    have = p.child("captions", tag("track") & lower("kind").isin("captions", "subtitles", ""))
    frames = p.is_("video-frame", tag("iframe") & ~hidden() & F.coalesce(F.trim(attr("src")).rlike(VIDEO_HOSTS), F.lit(False)))
    return [Hit(p.is_("video", tag("video") & ~hidden()) & ~have, "A video has no captions."), Hit(frames, "An embedded video may have no captions.")]


def _endless(value: Column) -> Column:
    """Whether an animation runs for five seconds, three times or without end."""
    seconds = F.regexp_extract(value, r"(?i)(^|[\s,])([\d.]+)(ms|s)\b", 2).try_cast("double") / F.when(F.regexp_extract(value, r"(?i)(^|[\s,])([\d.]+)(ms|s)\b", 3) == "ms", 1000).otherwise(1)
    times = F.regexp_extract(value, r"(^|\s)(\d+)(\s|$)", 2).try_cast("int")
    return F.lower(value).rlike(r"\binfinite\b") | F.coalesce(seconds >= 5, F.lit(False)) | F.coalesce(times >= 3, F.lit(False))


def _moves() -> Column:
    """Marquees, carousels that start by themselves, and endless animations in attributes."""
    every = F.coalesce(attr("data-interval"), attr("data-bs-interval"))
    auto = ((lower("data-ride") == "carousel") | (lower("data-bs-ride") == "carousel") | has("data-autoplay")) & ~F.coalesce(every.isin("false", "0"), F.lit(False))
    inline = F.regexp_extract(lower("style"), r"animation\s*:\s*([^;]+)", 1)
    return tag("marquee") | auto | ((inline != "") & _endless(inline))


def _animated(s: Sheet) -> list[Hit]:
    runs = F.exists("all", lambda d: ((d["property"] == "animation") & _endless(d["value"])) | ((d["property"] == "animation-iteration-count") & F.lower(d["value"]).rlike("infinite|^([3-9]|\\d\\d+)$")))
    return [Hit(runs & ~F.col("selector").rlike(":hover|:focus|:active") & ~calmed(s), "An animation cannot be paused.")]


RULES["motion/pause-stop-hide"] = Rule("motion/pause-stop-hide", ("2.2.2",), "error", fix_class="runtime-only", element=_moves, message="Moving content cannot be paused.", sheet=_animated)


# ---- rules on scripts and across files -----------------------------------------------------------
@rule("aria/live-region-missing-on-innerhtml-target", "4.1.3", "warning")
def silent_targets(t: Tables) -> DataFrame:
    """Elements of a project whose id a script with timers or handlers writes text into."""
    later = r"setTimeout|setInterval|addEventListener|\.on\w+\s*=|fetch\("
    busy = t.files.filter(F.col("source").rlike(later)).select("file_id")
    written = dom_actions(t).filter("what = 'text' and kind = 'id'").join(busy, "file_id", "left_semi")
    chosen = of_project(t, written).select("project", "kind", "token").distinct()
    live = roles("status", "alert", "log", "timer", "marquee") | lower("aria-live").isin("polite", "assertive") | tag("output")
    rows = selected(t, chosen).filter(~live)
    heard = ancestors(t, rows, live).select("file_id", "node_id").distinct()
    return found(rows.join(heard, ["file_id", "node_id"], "left_anti"), "A script changes this text and nothing announces it.")


@rule("keyboard/handler-missing", "2.1.1 4.1.2", "error")
def no_key_handler(t: Tables) -> DataFrame:
    """Elements with click handlers and no counterpart, and script files that put a click
    handler on a target, none on its keys, where no element of the project that the target
    names is a control by itself."""
    own = found(t.nodes.filter(_no_keyboard()), "A click handler has no counterpart for the keyboard.")
    place = ["project", "kind", "token"]
    acts = of_project(t, dom_actions(t).filter("what = 'event'"))
    keys = acts.filter("detail like 'key%'").select(*place).distinct()
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    clicks = acts.filter("detail = 'click'").join(t.files.filter(ext.isin("js", "mjs", "cjs", "ts")).select("file_id"), "file_id", "left_semi").join(keys, place, "left_anti")
    tokens = F.concat(F.transform("classes", lambda c: F.struct(F.lit("class").alias("kind"), c.alias("token"))), F.array(F.struct(F.lit("id").alias("kind"), F.coalesce("id", F.lit("")).alias("token"))))
    controls = of_project(t, t.nodes.filter(interactive()).select("file_id", F.explode(tokens).alias("x"))).select("project", "x.kind", "x.token").distinct()
    lone = clicks.join(controls, place, "left_anti").select("file_id", "line", "col", F.concat(F.lit("A script handles clicks on "), F.when(F.col("kind") == "id", "#").otherwise("."), "token", F.lit(" and no keys.")).alias("message"))
    return own.unionByName(lone)


@rule("keyboard/interactive-div-role-missing", "4.1.2 2.1.1", "warning")
def scripted_elements(t: Tables) -> DataFrame:
    rows = selected(t, clicked(t)).filter(~interactive() & ~tag("label", "option", "summary") & ~has("tabindex") & ~named())
    return found(rows, "A script makes this a control, but it has no role.")


@rule("keyboard/character-shortcuts", "2.1.4", "warning", "guidance")
def shortcuts(t: Tables) -> DataFrame:
    """Key listeners on the window or document that act on one printable character alone."""
    listens, compares = r"(window|document)(\.body)?\.(addEventListener\(\s*['\"]key(down|up|press)|onkey(down|up|press)\s*=)", r"\.(key|code)\s*={2,3}\s*['\"](\w|Key[A-Z]|[^\w\s])['\"]|\.(keyCode|which|charCode)\s*={2,3}\s*\d+"
    guarded = r"ctrlKey|metaKey|altKey|activeElement|isContentEditable|tagName"
    rows = lines(Tables(t.files.filter(F.col("source").rlike(listens) & ~F.col("source").rlike(guarded)), t.nodes, t.css), compares)
    return rows.select("file_id", "line", "col", F.lit("A single character is a shortcut.").alias("message"))


@rule("forms/required-indicator-missing", "3.3.2", "error")
def required_components(t: Tables) -> DataFrame:
    """Components that hand ``required`` on to a native control and show no sign of it."""
    hands_on, sign = r"\brequired=\{\s*(props\.)?(required|isRequired)\s*\}", r"aria-required|\*|(?i:>\s*\(?required\)?)"
    code = F.regexp_replace("source", r"(?s)/\*.*?\*/|(?m)^\s*//[^\n]*$", "")
    rows = lines(Tables(t.files.filter(F.lower("path").rlike(r"\.(tsx|jsx)$") & F.col("source").rlike(r"<(input|select|textarea)\b") & ~code.rlike(sign)), t.nodes, t.css), hands_on)
    return rows.select("file_id", "line", "col", F.lit("A required field shows no sign of it.").alias("message"))


@rule("parsing/malformed-tag", "4.1.1", "warning")
def no_such_heading(t: Tables) -> DataFrame:
    """Start and end tags of heading levels that there are not."""
    ends = lines(t, r"</[hH]([07-9]|\d\d+)\s*>").join(t.nodes.select("file_id").distinct(), "file_id", "left_semi")
    starts = t.nodes.filter(F.col("tag").rlike(r"^h\d+$") & ~tag(*HEADINGS))
    rows = starts.select("file_id", "line", "col").unionByName(ends.select("file_id", "line", "col").join(starts.select("file_id", "line"), ["file_id", "line"], "left_anti"))
    return found(rows, "There is no such heading level.")
