"""The rules. Single-element rules are conditions; the others are conditions on an
element's place in its page (``tree``) or on a style rule and its file (``sheets``)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import contrast, points
from ..functions.text import phrase
from ..sources.fragments import utility_declarations
from .registry import RULES, Tables, element_rule, many, place_rule, rule, sheet_rule
from .sheets import Sheet, each, sheet_rows
from .tree import Hit, Place, mention, none, tokens

# ---- fixed values -------------------------------------------------------------------
GENERIC = ["this", "that", "the", "here", "there", "this link", "that link", "the link", "this page", "that page", "click", "click here", "more", "more info", "more information", "more details", "details", "info", "read more", "learn more", "link"]
ROLES = (
    "alert alertdialog application article banner blockquote button caption cell checkbox code columnheader combobox complementary contentinfo definition deletion dialog directory document emphasis feed figure form generic grid gridcell group "
    "heading img insertion link list listbox listitem log main mark marquee math menu menubar menuitem menuitemcheckbox menuitemradio meter navigation none note option paragraph presentation progressbar radio radiogroup region row rowgroup rowheader "
    "scrollbar search searchbox separator slider spinbutton status strong subscript superscript switch tab table tablist tabpanel term textbox time timer toolbar tooltip tree treegrid treeitem"
).split()
ARIA = (
    "activedescendant atomic autocomplete braillelabel brailleroledescription busy checked colcount colindex colindextext colspan controls current describedby description details disabled dropeffect errormessage expanded flowto grabbed haspopup hidden "
    "invalid keyshortcuts label labelledby level live modal multiline multiselectable orientation owns placeholder posinset pressed readonly relevant required roledescription rowcount rowindex rowindextext rowspan selected setsize sort valuemax valuemin valuenow valuetext"
).split()
REQUIRED_BY_ROLE = {"checkbox": ["checked"], "menuitemcheckbox": ["checked"], "menuitemradio": ["checked"], "radio": ["checked"], "scrollbar": ["controls", "valuenow"], "slider": ["valuenow"], "switch": ["checked"]}
IDREFS = ["aria-labelledby", "aria-describedby", "aria-controls", "aria-owns", "aria-flowto", "aria-activedescendant", "aria-details", "aria-errormessage"]
REDUNDANT = [("nav", "navigation"), ("main", "main"), ("button", "button"), ("form", "form")]
UNLABELLED_TYPES = ["hidden", "submit", "reset", "button", "image"]
TEXT_TYPES = ["", "text", "email", "tel", "url", "search", "password", "number", "date"]
AUTOCOMPLETE_TYPES = ["email", "tel", "url", "password"]
AUTOCOMPLETE_NAMES = "firstname|first_name|lastname|last_name|fullname|full_name|username|email|phone|mobile|postalcode|postal_code|zipcode|zip_code|country|city|street|address"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
SPACING = ["line-height", "letter-spacing", "word-spacing", "margin-bottom"]
FOCUSABLE = ["button", "select", "textarea", "iframe", "summary"]
INTERACTIVE_ROLES = ["button", "link", "checkbox", "radio", "switch", "tab", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "slider", "spinbutton", "textbox", "combobox", "searchbox", "treeitem"]
KEY_HANDLERS, CLICK = ["onkeydown", "onkeyup", "onkeypress"], "onclick"
DOWN, UP = ["onmousedown", "onpointerdown", "ontouchstart"], ["onmouseup", "onpointerup", "ontouchend"]
SYMBOLS = r"^[\p{P}\p{S}]{1,2}$"
LANG = r"^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{1,8})*$"
PART_LANG = r"^([a-z]{2,3}(-[a-zA-Z0-9]{1,8})*|x(-[a-zA-Z0-9]{1,8})+)$"
FRAME_TITLES = ["iframe", "frame", "video", "youtube video", "vimeo video", "embed", "embedded content", "embedded video", "content", "untitled", "video player", "title"]


# ---- conditions ---------------------------------------------------------------------
# Written as SQL: a condition is then one call to the JVM, however long, and all rules
# together are built in a few seconds.
def listed(names) -> str:
    return ", ".join("'" + n.replace("'", "\\'") + "'" for n in names)


def tag(*names: str) -> Column:
    return F.expr(f"tag in ({listed(names)})")


def attr(name: str) -> Column:
    return F.expr(f"attrs['{name}']")


def has(name: str) -> Column:
    return F.expr(f"map_contains_key(attrs, '{name}')")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def lower(name: str) -> Column:
    return F.expr(f"lower(trim(coalesce(attrs['{name}'], '')))")


_NUMBER = "try_cast(regexp_extract(trim(coalesce(attrs['{}'], '')), r'^[+-]?\\d*\\.?\\d+', 0) as double)"


def number(name: str) -> Column:
    return F.expr(_NUMBER.format(name))


def some_class(pattern: str) -> Column:
    return F.exists("classes", lambda c: c.rlike(pattern))


_HIDDEN = "lower(trim(coalesce(attrs['aria-hidden'], ''))) = 'true'"
_NATIVE_INPUT = "(tag = 'input' and lower(trim(coalesce(attrs['type'], ''))) <> 'hidden')"


def hidden() -> Column:
    return F.expr(_HIDDEN)


def presentational() -> Column:
    return F.expr(f"coalesce(role in ('none', 'presentation'), false) or {_HIDDEN}")


def roles(*names: str) -> Column:
    return F.expr(f"coalesce(role in ({listed(names)}), false)")


def named() -> Column:
    return F.expr("given_name is not null")


def any_of(names: list[str]) -> Column:
    return F.expr(" or ".join(f"map_contains_key(attrs, '{n}')" for n in names))


def interactive() -> Column:
    return F.expr(
        f"tag in ('button', 'select', 'textarea', 'details') or (tag = 'a' and map_contains_key(attrs, 'href')) or {_NATIVE_INPUT} "
        f"or (tag in ('audio', 'video') and map_contains_key(attrs, 'controls')) or coalesce(role in ({listed(INTERACTIVE_ROLES)}), false)"
    )


def focusable() -> Column:
    order = _NUMBER.format("tabindex")
    native = f"(tag in ({listed(FOCUSABLE)}) or (tag in ('a', 'area') and map_contains_key(attrs, 'href')) or {_NATIVE_INPUT})"
    return F.expr(f"({native} and not map_contains_key(attrs, 'disabled') and coalesce({order} >= 0, true)) or coalesce({order} >= 0, false)")


# ---- rules on single elements -------------------------------------------------------
for args in [
    ("aria/dialog-role-missing", "4.1.2", "error", lambda: (attr("tabindex") == "-1") & (has("aria-labelledby") | has("aria-label")) & has("aria-hidden") & some_class(r"^(modal|dialog|drawer|offcanvas|popover)([-_]|$)") & ~roles("dialog", "alertdialog") & ~has("aria-modal") & ~tag("dialog"), "A dialog container has no dialog role."),
    ("aria/dropdown-toggle-triple-aria-missing", "4.1.2", "warning", lambda: ((lower("data-toggle") == "dropdown") | (lower("data-bs-toggle") == "dropdown")) & (~has("aria-haspopup") | ~has("aria-controls")), "A drop-down trigger lacks aria-haspopup or aria-controls."),
    ("aria/live-region-valid", "4.1.3", "error", lambda: (has("aria-live") & ~lower("aria-live").isin("off", "polite", "assertive")) | (has("aria-atomic") & ~lower("aria-atomic").isin("true", "false")) | (has("aria-live") & hidden()) | (roles("alert") & lower("aria-live").isin("off", "polite")) | (roles("status", "log") & lower("aria-live").isin("off", "assertive")), "A live region has values that do not work."),
    ("aria/popover-trigger-missing-haspopup", "4.1.2", "warning", lambda: (((lower("data-toggle") == "popover") | (lower("data-bs-toggle") == "popover")) & ~has("aria-haspopup")) | (((lower("data-toggle") == "tooltip") | (lower("data-bs-toggle") == "tooltip")) & ~has("aria-describedby") & ~has("title")), "A pop-over or tooltip trigger does not announce what it opens."),
    ("aria/required-attrs", "4.1.2", "error", lambda: F.reduce(F.array(*(roles(r) & ~(has(f"aria-{a}")) for r, need in REQUIRED_BY_ROLE.items() for a in need)), F.lit(False), lambda x, y: x | y), "An attribute that the role requires is missing."),
    ("aria/redundant-role-on-host-element", "4.1.2", "warning", lambda: F.reduce(F.array(*((tag(t) & roles(r)) for t, r in REDUNDANT), (tag("a") & has("href") & roles("link")), (tag("img") & ~blank(attr("alt")) & roles("img"))), F.lit(False), lambda x, y: x | y), "The role repeats what the element is."),
    ("document/iframe-title", "4.1.2 2.4.1", "error", lambda: tag("iframe") & ~hidden() & (~named() | phrase(attr("title")).isin(*FRAME_TITLES)), "An iframe has no title."),
    ("document/lang-on-parts", "3.1.2", "error", lambda: ~tag("html", "script", "style") & (has("lang") | has("xml:lang")) & ~F.coalesce(attr("lang"), attr("xml:lang")).rlike(PART_LANG) & ~F.coalesce(attr("lang"), attr("xml:lang")).rlike("[{<]"), "A part's language is not a language tag."),
    ("focus/tabindex-positive", "2.4.3", "error", lambda: number("tabindex") >= 1, "A positive tabindex changes the order of focus."),
    ("forms/aria-invalid-missing", "1.4.1 4.1.3", "error", lambda: tag("input", "select", "textarea") & F.array_contains("classes", "is-invalid") & ~lower("aria-invalid").rlike(r"^(true|grammar|spelling|\{.*)$") & (lower("type") != "hidden"), "A field looks invalid but does not say so."),
    ("forms/autocomplete-missing", "1.3.5", "warning", lambda: tag("input") & ~has("autocomplete") & (lower("type").isin(*AUTOCOMPLETE_TYPES) | (lower("type").isin("", "text") & (lower("name").rlike(AUTOCOMPLETE_NAMES) | lower("id").rlike(AUTOCOMPLETE_NAMES)))), "A field for personal data has no autocomplete."),
    ("keyboard/anchor-button-not-focusable", "2.1.1 4.1.2", "error", lambda: tag("a") & (roles("button") | some_class("^(btn|button)$")) & ~has("href") & ~F.coalesce(number("tabindex") >= 0, F.lit(False)), "A link made a button cannot get focus."),
    ("media/audio-video-no-controls", "1.4.2 2.1.1", "warning", lambda: tag("audio", "video") & ~has("controls"), "Audio or video without controls."),
    ("media/autoplay-sound", "1.4.2", "error", lambda: tag("audio", "video") & has("autoplay") & ~has("muted") & ~has("controls"), "Sound starts by itself and cannot be stopped."),
    ("navigation/href-empty-fragment", "4.1.2 2.1.1", "error", lambda: tag("a") & has("href") & F.trim(attr("href")).isin("", "#"), "A link leads nowhere."),
    ("navigation/href-javascript-scheme", "4.1.2 2.1.1", "error", lambda: tag("a") & F.trim(attr("href")).rlike("(?i)^javascript"), "A link runs a script."),
    ("navigation/link-name-only-symbol", "2.4.4 4.1.2", "warning", lambda: tag("a") & has("href") & ~named() & F.trim(F.col("text")).rlike(SYMBOLS), "A link's name is a symbol.", "guidance"),
    ("navigation/link-no-href", "2.1.1 4.1.2", "error", lambda: tag("a") & ~has("href") & (has(CLICK) | some_class("^(btn|button|link|nav-link|dropdown-item)$")), "A link without href acts as one."),
    ("navigation/link-target-blank-announcement", "3.2.5", "warning", lambda: tag("a") & (lower("target") == "_blank") & ~F.lower(F.concat_ws(" ", "text", attr("aria-label"))).rlike("new (window|tab)|opens in|external"), "A link opens a new window without saying so.", "guidance"),
    ("parsing/html-has-lang", "3.1.1 3.1.2", "error", lambda: has("lang") & ~tag("script", "style") & ~F.coalesce(attr("lang"), F.lit("")).rlike(LANG), "lang is not a language tag."),
    ("parsing/invalid-id-shape", "4.1.1", "error", lambda: has("id") & ~attr("id").rlike(r"^[A-Za-z0-9_-]+$") & ~attr("id").rlike(r"[{<]"), "An id is empty or holds characters that break references."),
    ("pointer/cancellation", "2.5.2", "warning", lambda: any_of(DOWN) & ~any_of(UP), "An action begins on the down event."),
    ("pointer/draggable-no-keyboard-alt", "2.5.7 2.1.1", "warning", lambda: (lower("draggable") == "true") & ~any_of(KEY_HANDLERS), "Dragging has no counterpart for the keyboard."),
    ("semantics/button-name-only-symbol", "4.1.2", "warning", lambda: (tag("button") | roles("button")) & ~named() & F.trim(F.col("text")).rlike(SYMBOLS), "A button's name is a symbol.", "guidance"),
    ("semantics/heading-class-on-nonheading", "1.3.1", "warning", lambda: some_class("^(h[1-6]|display-[1-6])$") & ~tag(*HEADINGS) & ~(roles("heading") & has("aria-level")), "Text looks like a heading and is none."),
    ("semantics/label-in-name", "2.5.3", "error", lambda: interactive() & ~blank(attr("aria-label")) & ~blank(F.col("text")) & ~tag("select") & ~F.contains(F.lower(F.regexp_replace(attr("aria-label"), r"\s+", " ")), F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))), "The name does not hold the visible text.", "guidance"),
    ("semantics/visual-disabled-non-control", "4.1.2", "warning", lambda: (tag("div", "span", "li") | (tag("a") & ~has("href"))) & (F.array_contains("classes", "disabled") | lower("style").rlike("cursor:\\s*not-allowed|pointer-events:\\s*none")) & ~has("aria-disabled") & ~roles(*INTERACTIVE_ROLES), "It looks disabled but does not say so."),
    ("aria/expanded-on-disclosure", "4.1.2", "warning", lambda: (lower("data-toggle").isin("collapse", "dropdown", "accordion", "offcanvas") | lower("data-bs-toggle").isin("collapse", "dropdown", "accordion", "offcanvas")) & (~has("aria-expanded") | (~has("aria-controls") & ~has("data-bs-target") & ~has("data-target") & ~F.coalesce(attr("href").rlike("^#."), F.lit(False)))) | ((tag("button", "a") | roles("button")) & has("aria-controls") & ~has("aria-expanded") & ~roles("tab") & ~has("data-bs-toggle") & ~has("data-toggle") & ~has("aria-haspopup")) | ((tag("button") | roles("button")) & lower("onclick").rlike(r"classlist\s*\.\s*toggle\(") & ~has("aria-expanded")), "A control that opens content does not say whether it is open."),
    ("aria/role-from-class-only", "1.3.3 1.4.1 4.1.2", "warning", lambda: (some_class("^(alert|callout|admonition)(-|$)") | (some_class("^(note|notice|message|box)$") & some_class("^(warning|danger|error|caution|important|tip|success|info)$"))) & F.col("role").isNull() & ~F.col("text").rlike("(?i)^(warning|error|danger|note|info|success|tip|caution|important)"), "Only a class says what kind of message this is."),
    ("forms/select-onchange-context-change", "3.2.2", "error", lambda: tag("select") & lower("onchange").rlike(r"location|submit\(|window\.open|navigate"), "Choosing an option leaves the page.", "guidance"),
    ("tooltip/dismissable", "1.4.13", "warning", lambda: ~blank(attr("title")) & interactive() & (~blank(F.col("text")) | has("aria-label")) & (F.trim(attr("title")) != F.trim("text")), "A title tooltip cannot be dismissed.", "runtime-only"),
]:
    element_rule(*args)


# ---- rules on single elements whose message or severity depends on it ------------------
def _wrong_roles() -> Column:
    return F.filter(F.split(F.col("role"), r"\s+"), lambda r: (r != "") & ~r.isin(*ROLES))


def _wrong_names() -> Column:
    return F.filter(F.map_keys("attrs"), lambda n: n.startswith("aria-") & ~F.regexp_replace(n, "^aria-", "").isin(*ARIA))


def _meant(name: Column) -> Column:
    short = F.regexp_replace(name, "^aria-", "")
    near = F.array_sort(F.filter(F.transform(F.array(*map(F.lit, ARIA)), lambda a: F.struct(F.levenshtein(short, a).alias("d"), a.alias("a"))), lambda s: s["d"] <= 2))
    return F.concat(F.lit("No such attribute: "), name, F.when(F.size(near) > 0, F.concat(F.lit(", meant aria-"), F.get(near, F.lit(0))["a"], F.lit("?"))).otherwise(""))


def _delay() -> Column:
    return F.regexp_extract(F.coalesce(attr("content"), F.lit("")), r"^\s*(\d+(\.\d+)?)", 1).try_cast("double")


def _zoom() -> Column:
    parts = F.transform(F.split(F.lower(F.coalesce(attr("content"), F.lit(""))), "[,;]"), lambda p: F.transform(F.split(p, "="), lambda x: F.trim(x)))
    value = lambda name: F.get(F.get(F.filter(parts, lambda p: F.get(p, F.lit(0)) == name), F.lit(0)), F.lit(1))
    scale = F.regexp_extract(value("maximum-scale"), r"^[+-]?\d*\.?\d+", 0).try_cast("double")
    return F.array_compact(F.array(F.when(value("user-scalable").isin("no", "0"), "Zoom is switched off."), F.when(scale < 2, "Zoom ends below 200 %.")))


LISTS = ["ul", "ol", "menu"]
for args in [
    ("aria/invalid-role", "4.1.2", "error", lambda: F.col("role").isNotNull() & (F.size(_wrong_roles()) > 0), lambda: F.concat(F.lit("Not a role: "), F.array_join(_wrong_roles(), ", ")), "mechanical"),
    ("aria/valid-attr", "4.1.2", "error", lambda: F.size(_wrong_names()) > 0, many(lambda: F.transform(_wrong_names(), _meant))),
    ("document/lang-attribute", "3.1.1", "error", lambda: tag("html") & (blank(attr("lang")) | (has("xml:lang") & (lower("lang") != lower("xml:lang")))), "The page does not state its language."),
    (
        "document/meta-refresh", "2.2.1 2.2.4 3.2.5", "error", lambda: tag("meta") & (lower("http-equiv") == "refresh") & _delay().isNotNull(),
        lambda: F.when(_delay() == 0, "The page leaves at once.").when(lower("content").contains("url"), "The page leaves by itself.").otherwise("The page reloads by itself."), "verify-in-source", lambda: F.when(_delay() == 0, "warning").otherwise("error"),
    ),
    ("document/viewport-zoom", "1.4.4", "error", lambda: tag("meta") & (lower("name") == "viewport"), many(_zoom)),
    (
        "semantics/list-structure", "1.3.1", "warning", lambda: ((F.col("tag") == "li") & ~F.coalesce(F.col("parent_tag").isin(*LISTS), F.lit(False))) | (F.coalesce(F.col("parent_tag").isin(*LISTS), F.lit(False)) & ~tag("li", "script", "template")),
        many(lambda: F.array_compact(F.array(F.when((F.col("tag") == "li") & ~F.coalesce(F.col("parent_tag").isin(*LISTS), F.lit(False)), "A list item stands outside a list."), F.when(F.col("parent_tag").isin(*LISTS) & ~tag("li", "script", "template"), "A list holds something that is no item.")))),
    ),
]:
    element_rule(*args)


# ---- for rules and finders that are queries of their own --------------------------------
def found(rows: DataFrame, message: str | Column) -> DataFrame:
    return rows.select("file_id", "line", "col", (F.lit(message) if isinstance(message, str) else message).alias("message"))


def ancestors(t: Tables, rows: DataFrame, keep: Column, *columns: str) -> DataFrame:
    """``rows`` (with node_id and ancestors) joined with those ancestors that ``keep``
    chooses: an equi-join on (file, node), since an element knows its ancestors."""
    own = t.nodes.filter(keep).select("file_id", F.col("node_id").alias("above"), *(F.col(c).alias(f"above_{c}") for c in columns))
    return rows.withColumn("above", F.explode("ancestors")).join(own, ["file_id", "above"])


def parents(t: Tables, *columns: str) -> DataFrame:
    return t.nodes.select("file_id", F.col("node_id").alias("parent_id"), *(F.col(c).alias(f"parent_{c}") for c in columns))


# ---- rules on an element's place ----------------------------------------------------------
def one(value: Column) -> Column:
    return F.array(value)


def target_exists(p: Place) -> Column:
    return p.mentioned("self", "self")


def label_for(p: Place) -> Column:
    """Whether this element is a label for an id; its mentions are of kind ``for``."""
    mine = p.is_("label-for", tag("label") & (attr("for") != ""))
    p.mentions("for", tokens(mine, one(p.value("for", attr("for")))))
    return mine


def optional_field(p: Place) -> Column:
    """Whether the token's element is a field that is not required."""
    field = p.is_("optional-field", tag("input", "select", "textarea") & ~has("required") & (lower("aria-required") != "true"))
    return p.mentioned("optional", "self", field)


def text_of(condition: Column) -> Column:
    return condition & ~blank(F.col("text"))


@place_rule("aria/labelledby-target-exists", "4.1.2", "error")
def references(p: Place) -> list[Hit]:
    words = lambda n: F.filter(F.split(F.trim(attr(n)), r"\s+"), lambda x: x != "")
    all_ = F.flatten(F.array(*(F.coalesce(tokens(has(n), words(n), n), none()) for n in IDREFS)))
    some = p.is_("references", any_of(IDREFS))
    p.mentions("ref", F.when(some, p.value("references", all_)).otherwise(none()))
    return [Hit(~target_exists(p), F.concat(mention("name"), F.lit(" refers to a missing id: "), mention("token")), on="ref")]


@place_rule("aria/hidden-focus", "4.1.2 2.1.1", "error")
def hidden_focus(p: Place) -> list[Hit]:
    return [Hit(p.is_("hidden", hidden()) & (p.is_("focusable", focusable()) | (p.below("focusable", focusable()) > 0)), "Hidden content can get focus.")]


@place_rule("aria/tablist-on-non-tab-container", "1.3.1 4.1.2", "error")
def tablist_without_tabs(p: Place) -> list[Hit]:
    return [Hit(p.is_("tablist", roles("tablist")) & (p.below("tab", roles("tab")) == 0), "A tab list has no tab.")]


@place_rule("aria/tab-controls-missing", "4.1.2 1.3.1", "error")
def tab_controls(p: Place) -> list[Hit]:
    tab, panel = p.is_("tab", roles("tab")), p.is_("tabpanel", roles("tabpanel"))
    controls = p.is_("controls", has("aria-controls"))
    p.mentions("shown", tokens(tab & controls, one(p.value("controls", attr("aria-controls")))))
    return [
        Hit(tab & ~controls, "A tab names no panel."),
        Hit(~p.mentioned("panel", "self", panel), "A tab names something that is no panel.", on="shown"),
        Hit(panel & ~p.is_("labelledby", has("aria-labelledby")) & ~p.mentioned("shown", "shown"), "A panel belongs to no tab."),
    ]


@place_rule("aria/presentation-on-semantic-ancestor", "1.3.1 4.1.2", "warning")
def presentation_over_children(p: Place) -> list[Hit]:
    needs = {"table": ["th", "caption", "thead", "tfoot"], "ul": ["li"], "ol": ["li"], "dl": ["dt", "dd"], "figure": ["figcaption"], "form": ["input", "select", "textarea", "button"]}
    given_up = p.is_("presentation", roles("none", "presentation"))
    hit = F.lit(False)
    for host, parts in needs.items():
        hit = hit | ((F.col("tag") == host) & (p.below(f"of-{'list' if host in ('ul', 'ol') else host}", tag(*parts)) > 0))
    return [Hit(given_up & hit, "Children keep a meaning that the parent gave up.")]


@place_rule("document/charset-first-1024-bytes", "1.3.1 4.1.1", "error")
def charset(p: Place) -> list[Hit]:
    declares = p.is_("charset", tag("meta") & (has("charset") | (lower("http-equiv") == "content-type")))
    first = p.file("charset", F.min(F.when(declares, F.struct("node_id", "ord", p.value("octets", F.col("octets")).alias("octets")))))
    problem = F.when(first.isNull(), "No character set is declared.").when(first["ord"] > 0, "The character set is not declared first.").when(first["octets"] > 1024, "The character set is declared after 1024 bytes.")
    return [Hit(p.is_("head", tag("head")) & problem.isNotNull(), problem)]


@place_rule("forms/fieldset-legend", "1.3.1 3.3.2", "error")
def legends(p: Place) -> list[Hit]:
    return [Hit(p.is_("unnamed-set", tag("fieldset") & ~(has("aria-label") | has("aria-labelledby"))) & ~p.child("legend", text_of(tag("legend"))), "A field set has no legend.")]


def unlabelled(p: Place) -> Column:
    """Controls that no attribute, label or wrapping label names."""
    control = (tag("input") & ~lower("type").isin(*UNLABELLED_TYPES)) | tag("select", "textarea") | (has("contenteditable") & lower("contenteditable").isin("", "true"))
    label_for(p)
    return p.is_("unnamed-control", control & ~named()) & ~p.above("label", tag("label")) & ~p.mentioned("labelled", "for")


@place_rule("forms/labels-required", "1.3.1 3.3.2 4.1.2", "error")
def labels_required(p: Place) -> list[Hit]:
    return [Hit(unlabelled(p) & ~p.is_("placeholder", ~blank(attr("placeholder"))), "A field has no label.")]


@place_rule("forms/placeholder-as-label", "3.3.2 1.3.1", "warning")
def placeholder_as_label(p: Place) -> list[Hit]:
    return [Hit(unlabelled(p) & p.is_("placeholder", ~blank(attr("placeholder"))), "A placeholder stands for a label.")]


@place_rule("forms/value-as-label", "1.3.1 4.1.2", "warning")
def value_as_label(p: Place) -> list[Hit]:
    return [Hit(unlabelled(p) & p.is_("valued", tag("input") & lower("type").isin(*TEXT_TYPES) & attr("value").rlike(r"\p{L}") & ~has("placeholder")), "A value stands for a label.")]


@place_rule("forms/label-for-id-mismatch", "1.3.1 3.3.2 4.1.2", "error")
def label_for_nothing(p: Place) -> list[Hit]:
    label_for(p)
    return [Hit(~target_exists(p), F.concat(F.lit("A label is for a missing id: "), mention("token")), on="for")]


@place_rule("forms/label-adjacent-unassociated", "1.3.1 3.3.2 4.1.2", "error", "mechanical")
def label_beside(p: Place) -> list[Hit]:
    before = p.previous("bare-label", F.when(tag("label") & ~has("for") & (F.col("last_id") == F.col("node_id")), True))
    return [Hit(p.is_("bare-field", tag("input", "select", "textarea") & ~lower("type").isin(*UNLABELLED_TYPES) & ~named()) & before.isNotNull(), "The label beside the field is not tied to it.")]


@place_rule("forms/label-adjacent-mismatch", "1.3.1 3.3.2 4.1.2", "error")
def label_beside_other(p: Place) -> list[Hit]:
    before = p.previous("label-of", F.when(tag("label"), attr("for")))
    p.mentions("beside", tokens(p.is_("field", tag("input", "select", "textarea")) & (before != "") & ~before.eqNullSafe(F.col("id")), one(before)))
    return [Hit(target_exists(p), "The label beside the field belongs to another.", on="beside")]


@place_rule("forms/multiple-label-for-same-id", "1.3.1 4.1.2", "warning")
def many_labels(p: Place) -> list[Hit]:
    label_for(p)
    return [Hit(target_exists(p) & (p.rank() > 1), F.concat(F.lit("Another label for this field is in line "), p.first_line().cast("string")), on="for")]


def submits(p: Place) -> tuple[Column, Column]:
    """Whether an element is a form, and whether something in it sends it."""
    submit = (tag("input") & lower("type").isin("submit", "image")) | (tag("button") & lower("type").isin("", "submit"))
    return p.is_("form", tag("form")), p.below("submit", submit) > 0


@place_rule("forms/no-submit-control", "3.3.2", "error")
def no_submit(p: Place) -> list[Hit]:
    form, sent = submits(p)
    fields = (tag("input") & lower("type").isin(*TEXT_TYPES)) | tag("textarea")
    return [Hit(form & (p.below("text-field", fields) > 0) & ~sent & ~p.is_("scripted", has("onsubmit")), "A form cannot be sent.")]


@place_rule("forms/submit-not-button-or-input", "4.1.2 3.3.2", "error")
def submit_by_link(p: Place) -> list[Hit]:
    form, sent = submits(p)
    return [Hit(form & (p.below("link-button", tag("a") & (some_class("^btn") | roles("button"))) > 0) & ~sent, "A link sends the form.")]


@place_rule("forms/radio-group-without-fieldset", "1.3.1 3.3.2 4.1.2", "error")
def radio_groups(p: Place) -> list[Hit]:
    """At the first radio button of a name, if some of them stand in no named group. A group
    is named by itself or by the legend that is its child."""
    radio = p.is_("radio", tag("input") & (lower("type") == "radio") & (attr("name") != ""))
    legend = p.is_("told-legend", text_of(tag("legend")))
    group = tag("fieldset") | roles("radiogroup")
    named_group = p.is_("group", group) & (p.is_("named-group", group & named()) | (p.within("group", group, "legends", lambda by: F.max(F.when(legend & (F.col("parent_id") == F.col("nearest_group")), 1)).over(Window.partitionBy(*by))) == 1))
    told = p.within("group", group, "named", lambda by: F.max(F.when(named_group, 1)).over(Window.partitionBy(*by))) == 1
    p.mentions("radio", tokens(radio, one(p.value("radio", attr("name"))), F.when(told, "told").otherwise("")), "radio")
    return [Hit((p.rank() == 1) & p.mentioned("loose-radio", "radio", mention("name") == "") & p.mentioned("second-radio", "radio", p.rank() > 1), "Radio buttons have no common name.", on="radio")]


@place_rule("keyboard/accesskey-duplicate", "2.1.1 2.1.4", "error")
def access_keys(p: Place) -> list[Hit]:
    p.mentions("key", tokens(p.is_("accesskey", has("accesskey")), p.value("keys", F.filter(F.split(lower("accesskey"), r"\s+"), lambda k: k != ""))), "key")
    return [Hit(p.rank() > 1, F.concat(F.lit("Access key used before: "), mention("token")), on="key")]


def fragment(href: Column) -> Column:
    return F.when(href.rlike("^#."), F.regexp_replace(href, "^#", ""))


@place_rule("navigation/in-page-link-fragment-missing", "2.4.1", "warning")
def fragments(p: Place) -> list[Hit]:
    leads = p.is_("fragment", tag("a") & attr("href").rlike(r"^#.") & (lower("href") != "#top") & ~attr("href").rlike(r"[{}%$<]"))
    p.mentions("fragment", tokens(leads, one(p.value("fragment", fragment(attr("href"))))))
    p.mentions("name", tokens(p.is_("anchor", tag("a") & (attr("name") != "")), one(p.value("anchor", attr("name")))))
    return [Hit(~target_exists(p) & ~p.mentioned("anchor", "name"), F.concat(F.lit("A link leads to a missing place: "), mention("token")), on="fragment")]


def link_name() -> Column:
    return phrase(F.coalesce(F.nullif(F.trim(attr("aria-label")), F.lit("")), F.col("text")))


def pictured() -> Column:
    return tag("img") & ~blank(attr("alt"))


@place_rule("navigation/link-descriptive-text", "2.4.4 4.1.2 2.4.9", "warning", "guidance")
def link_text(p: Place) -> list[Hit]:
    """Links without a name, with a generic one, and of one name with several targets."""
    link = tag("a") & has("href")
    silent = p.is_("silent-link", link & (link_name() == "") & F.col("given_name").isNull())
    generic = p.is_("generic-link", link & link_name().isin(*GENERIC))
    # The text of an icon font is a glyph's name: it is drawn, not read.
    ligature = p.is_("ligature-link", link & F.col("given_name").isNull() & F.trim("text").rlike("^[a-z0-9_]+$")) & (p.below("ligature", some_class("^material-(icons|symbols)") & F.trim("text").rlike("^[a-z0-9_]+$") & ~hidden()) > 0)
    return [
        Hit((silent | ligature) & (p.below("alt", pictured()) == 0), "A link has no text."),
        Hit(generic, F.concat(F.lit("A link's text says nothing: "), p.value("link-name", F.when(link & link_name().isin(*GENERIC), link_name())))),
    ]


@place_rule("navigation/skip-link", "2.4.1", "warning")
def skip_link(p: Place) -> list[Hit]:
    """At the first navigation of two links or more that no link before it leads past."""
    link = p.is_("link", tag("a") & has("href"))
    bar = p.is_("nav", tag("nav")) & (p.below("link", tag("a") & has("href")) >= 2)
    at = p.file("bar", F.min(F.when(bar, F.col("node_id"))))
    first = p.file("first-link", F.min(F.when(link, F.struct("node_id", p.value("link-target", F.when(tag("a"), fragment(attr("href")))).alias("to")))))
    here = bar & (F.col("node_id") == at)
    p.mentions("skip", tokens(here, one(F.when(first["node_id"] < at, first["to"]))))
    return [Hit(mention("token").isNull() | ~target_exists(p), "Nothing leads past the navigation.", on="skip")]


@place_rule("parsing/duplicate-id", "1.3.1 4.1.2 4.1.1", "error")
def duplicate_ids(p: Place) -> list[Hit]:
    return [Hit(p.is_("id", F.col("id") != "") & (p.rank() > 1), F.concat(F.lit("The id is used before: "), "id"))]


@place_rule("semantics/button-name", "4.1.2", "error")
def button_name(p: Place) -> list[Hit]:
    inputs = tag("input") & ((lower("type") == "button") & blank(attr("value")) | (lower("type") == "image") & blank(attr("alt")))
    silent = p.is_("silent-button", ((tag("button") | (roles("button") & ~tag("input"))) & blank(F.col("text")) | inputs) & ~named())
    return [Hit(silent & ~p.child("picture", pictured() | (tag("svg") & named())) & (p.below("drawn-text", text_of(tag("title", "text"))) == 0), "A button has no name.")]


@place_rule("semantics/empty-heading", "2.4.6", "error")
def empty_headings(p: Place) -> list[Hit]:
    empty = p.is_("empty-heading", tag(*HEADINGS) & blank(F.col("text")) & blank(attr("aria-label")) & ~has("aria-labelledby"))
    return [Hit(empty & (p.below("alt", pictured()) == 0), "A heading is empty.")]


@place_rule("semantics/form-landmark-name-missing", "1.3.1 4.1.2", "warning")
def form_name(p: Place) -> list[Hit]:
    form = p.is_("form", tag("form"))
    return [Hit(form & (p.file("forms", F.count_if(form)) == 1) & ~p.is_("named-form", tag("form") & named()), "The form has no name.")]


@place_rule("semantics/inline-display-none-on-focusable", "2.4.3 4.1.2", "error")
def hidden_by_style(p: Place) -> list[Hit]:
    return [Hit(p.is_("undisplayed", lower("style").rlike(r"display\s*:\s*none")) & (p.is_("focusable", focusable()) | (p.below("focusable", focusable()) > 0)), "Content that can get focus is not displayed.")]


@place_rule("semantics/interactive-ancestor-of-heading", "1.3.1", "error")
def heading_inside(p: Place) -> list[Hit]:
    return [Hit(p.is_("heading", tag(*HEADINGS)) & p.above("link-or-button", (tag("a") & has("href")) | tag("button")), "A heading stands inside a control.")]


@place_rule("semantics/nested-interactive", "4.1.2", "error")
def nested(p: Place) -> list[Hit]:
    solid = ((interactive() & ~roles(*INTERACTIVE_ROLES)) | F.coalesce(number("tabindex") >= 0, F.lit(False)) | has(CLICK)) & ~tag("details")
    return [Hit(p.is_("interactive", interactive()) & p.above("solid", solid), "A control stands inside another.")]


@place_rule("semantics/section-accessible-name-missing", "1.3.1 4.1.2", "warning")
def sections(p: Place) -> list[Hit]:
    beside = p.beside("main-tag", tag("main")) & F.col("parent_id").isNotNull()
    top = p.is_("top-section", tag("section") & ~named() & F.coalesce(F.col("parent_tag").isin("body", "main"), F.lit(False)))
    return [Hit((top | (p.is_("bare-section", tag("section") & ~named()) & beside)) & ~p.child("heading", tag(*HEADINGS)), "A section has no name.")]


@place_rule("semantics/svg-title-missing", "1.1.1 4.1.2", "error")
def svg_titles(p: Place) -> list[Hit]:
    return [Hit(p.is_("bare-svg", tag("svg") & ~presentational() & ~named()) & ~p.child("title-text", text_of(tag("title"))), "A drawing has no title.")]


def cells(p: Place, name: str, condition: Column) -> Column:
    """How many elements that are so have this as their innermost table."""
    own = p.is_(name, condition)
    return p.within("table", tag("table"), name, lambda by: F.count_if(own).over(Window.partitionBy(*by)), together=True)


def grid(p: Place) -> tuple[Column, dict[str, Column]]:
    counts = {name: cells(p, name, tag(name)) for name in ("td", "th", "thead", "tfoot", "caption")}
    some = counts["td"] + counts["th"] + counts["thead"] + counts["tfoot"] + counts["caption"] > 0
    return p.is_("table", tag("table")) & some, counts


@place_rule("semantics/table-headers", "1.3.1", "warning")
def table_headers(p: Place) -> list[Hit]:
    table, n = grid(p)
    return [Hit(table & (n["td"] >= 1) & (n["th"] == 0) & ~p.is_("presentational-table", tag("table") & presentational()), "A table has no header cells.")]


@place_rule("semantics/table-caption-missing", "1.3.1", "warning")
def table_captions(p: Place) -> list[Hit]:
    table, n = grid(p)
    return [Hit(table & (n["td"] + n["th"] > 0) & (n["caption"] == 0) & ~p.is_("named-table", tag("table") & (named() | presentational())), "A table has no caption.")]


@place_rule("semantics/layout-table-no-presentation-role", "1.3.1", "warning")
def layout_tables(p: Place) -> list[Hit]:
    table, n = grid(p)
    tied = cells(p, "tied", tag("td", "th", "thead", "tfoot", "caption") & (has("scope") | has("headers"))) > 0
    return [Hit(table & (n["th"] + n["thead"] + n["tfoot"] + n["caption"] == 0) & ~tied & ~p.is_("role-table", tag("table") & (named() | F.col("role").isNotNull())), "A table for layout does not say so.")]


@place_rule("semantics/table-th-scope-missing", "1.3.1", "warning")
def header_scopes(p: Place) -> list[Hit]:
    cell = p.is_("cell", tag("th", "td"))
    in_row = lambda by: Window.partitionBy(*by, "parent_id")
    columns = p.within("table", tag("table"), "in-row", lambda by: F.count_if(cell).over(in_row(by)), together=True)
    first = p.within("table", tag("table"), "first", lambda by: F.min(F.when(cell, F.col("node_id"))).over(in_row(by)), together=True)
    widest = p.within("table", tag("table"), "widest", lambda by: F.max(F.when(cell, columns)).over(Window.partitionBy(*by)))
    rows = p.within("table", tag("table"), "rows", lambda by: F.count_if(cell & (F.col("node_id") == first)).over(Window.partitionBy(*by)))
    bare = p.is_("bare-header", tag("th") & ~lower("scope").isin("row", "col", "rowgroup", "colgroup"))
    return [Hit(bare & F.col("nearest_table").isNotNull() & (widest >= 2) & (rows >= 2), "A header cell does not say what it heads.")]


@place_rule("media/alt-text-missing", "1.1.1", "error")
def without_alternative(p: Place) -> list[Hit]:
    picture = (tag("img") | (tag("input") & (lower("type") == "image")) | (roles("img") & ~tag("svg"))) & ~has("alt")
    bare = (picture | (tag("canvas") & blank(F.col("text")))) & ~named() & ~presentational()
    drawing = p.is_("bare-svg", tag("svg") & ~presentational() & ~named()) & (p.below("image", tag("image")) > 0) & ~p.child("title-text", text_of(tag("title")))
    return [Hit(p.is_("bare-picture", bare) | drawing, "An image has no text alternative.")]


@place_rule("media/img-empty-alt-in-clickable-group", "1.1.1 4.1.2", "warning")
def silent_pictures(p: Place) -> list[Hit]:
    silent = ((tag("a") & has("href")) | tag("button")) & blank(F.col("text")) & ~named()
    return [Hit(p.is_("mute-picture", tag("img") & has("alt") & blank(attr("alt"))) & p.above("silent-control", silent), "The only content of a control is a picture without text.")]


@place_rule("media/svg-accessible-name", "1.1.1", "error")
def control_drawings(p: Place) -> list[Hit]:
    silent = interactive() & blank(F.col("text")) & ~named()
    return [Hit(p.is_("mute-svg", tag("svg") & ~hidden() & ~named()) & p.above("silent-interactive", silent) & ~p.child("title-text", text_of(tag("title"))), "A control's only content is a drawing without a name.")]


@place_rule("forms/asterisk-required-marker", "1.3.1 3.3.2", "warning")
def starred_labels(p: Place) -> list[Hit]:
    label_for(p)
    return [Hit(p.is_("starred", tag("label") & F.col("text").rlike(r"\*\s*$")) & optional_field(p), "An asterisk alone says that a field is required.", on="for")]


@place_rule("pointer/drag-alternative", "2.5.7", "warning")
def drag_only(p: Place) -> list[Hit]:
    drags = p.is_("drags", (lower("draggable") == "true") | any_of(["ondragstart", "ondrag", "ondragend"]))
    other = p.is_("handled", any_of([CLICK, *KEY_HANDLERS]))
    # Components that a library makes draggable, and no button to do the same.
    library = p.about("drag-library", F.col("source").rlike(r"(?m)\bfrom\s+['\"](@dnd-kit/\w+|react-dnd|react-beautiful-dnd|@hello-pangea/dnd|react-sortable-hoc|sortablejs)['\"]"))
    buttons = p.file("buttons", F.count_if(p.is_("button", tag("button") | roles("button"))))
    none = p.file("handled", F.count_if(other)) == 0
    return [Hit(drags & none, "Nothing but dragging does this."), Hit(p.is_("first", F.col("node_id") == 0) & library & none & (buttons == 0) & (p.file("drags", F.count_if(drags)) == 0), "Nothing but dragging does this.")]


@place_rule("pointer/stretched-link-multiple-in-container", "2.4.4", "error")
def stretched(p: Place) -> list[Hit]:
    link, box = p.is_("stretched", F.array_contains("classes", "stretched-link")), some_class("^(position-relative|card)$") | lower("style").rlike(r"position\s*:\s*relative")
    rank = p.within("box", box, "stretched", lambda by: F.count_if(link).over(Window.partitionBy(*by).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)))
    return [Hit(link & p.nearest("box", box).isNotNull() & (rank > 1), "Two links cover the same container.")]


# ---- rules on style sheets ----------------------------------------------------------------
def style(t: Tables, rows: DataFrame, message: str | Column) -> DataFrame:
    return rows.select("file_id", "line", F.lit(1).alias("col"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def sheet_rules(t: Tables) -> DataFrame:
    """One row a style rule (``sheet_rows``), made once for all that read them."""
    return t.once("sheet rules", lambda: sheet_rows(t.css))


def decl(name: str) -> Column:
    return F.col("decls")[name]


def said(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(decl(name), F.lit(""))))


def root() -> Column:
    return F.trim("selector").isin(":root", "html", "body")


def some_decl(condition) -> Column:
    return F.exists("all", condition)


def calmed(s: Sheet) -> Column:
    return s.file("calmed", F.exists("at_rules", lambda a: a.contains("prefers-reduced-motion")))


def contrast_rows(t: Tables) -> DataFrame:
    """Style rules with text or background colours, resolved, and their contrast."""
    def make() -> DataFrame:
        back = F.coalesce(decl("background-color"), decl("background"))
        top = sheet_rules(t).filter(root())
        defaults = top.groupBy("file_id").agg(F.max_by(decl("color"), F.when(decl("color").isNotNull(), F.col("rule_id"))).alias("base_color"), F.max_by(back, F.when(back.isNotNull(), F.col("rule_id"))).alias("base_back"))
        variables = t.css.filter(root() & F.col("property").startswith("--")).groupBy("file_id", F.col("property").alias("name")).agg(F.max_by("value", "rule_id").alias("known"))

        def resolved(rows: DataFrame, column: str) -> DataFrame:
            named_ = rows.withColumn("name", F.nullif(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^var\(\s*(--[\w-]+)", 1), F.lit("")))
            return named_.join(variables, ["file_id", "name"], "left").withColumn(column, F.coalesce("known", column)).drop("name", "known")

        rows = sheet_rules(t).filter(decl("color").isNotNull() | decl("background-color").isNotNull() | decl("background").isNotNull()).join(defaults, "file_id", "left")
        rows = rows.withColumns({"front": F.coalesce(decl("color"), "base_color"), "back": F.coalesce(back, F.col("base_back"))})
        size = points(decl("font-size"))
        bold = F.coalesce(decl("font-weight").isin("bold", "bolder") | (decl("font-weight").try_cast("int") >= 700), F.lit(False))
        rows = rows.withColumn("large", F.coalesce((size >= 18) | ((size >= 14) & bold), F.lit(False)))
        return resolved(resolved(rows, "front"), "back").withColumn("ratio", contrast(F.col("front"), F.col("back"))).select("file_id", "rule_id", "line", "selector", "ratio", "large")

    return t.once("contrast", make)


def contrast_rule(t: Tables, normal: float, large: float) -> DataFrame:
    rows = contrast_rows(t).filter(F.col("ratio") < F.when(F.col("large"), large).otherwise(normal))
    return style(t, rows, F.concat(F.lit("Contrast "), F.format_number("ratio", 2), F.lit(" of "), "selector"))


@rule("contrast/minimum", "1.4.3", "error", "guidance")
def contrast_minimum(t: Tables) -> DataFrame:
    """Over pictures and gradients the ratio cannot be told; that is said for information."""
    d = lambda n: F.coalesce(decl(n), F.lit(""))
    over = sheet_rules(t).filter((d("color") != "") & F.concat_ws(" ", d("background"), d("background-image")).rlike(r"(?i)url\(|gradient\("))
    unsure = style(t, over, F.concat(F.lit("Text over a picture, contrast cannot be told: "), "selector")).withColumn("severity", F.lit("info"))
    return contrast_rule(t, 4.5, 3.0).withColumn("severity", F.lit("error")).unionByName(unsure)


@rule("contrast/enhanced", "1.4.6", "warning", "guidance")
def contrast_enhanced(t: Tables) -> DataFrame:
    return contrast_rule(t, 7.0, 4.5)


@sheet_rule("contrast/non-text", "1.4.11", "error", "guidance")
def contrast_parts(s: Sheet) -> list[Hit]:
    edge = F.coalesce(decl("border-color"), decl("outline-color"), decl("fill"), decl("stroke"))
    part = F.col("selector").rlike(r"(?i)button|input|select|textarea|\.btn|svg|icon") & ~F.col("selector").rlike("(?i)disabled|hidden")
    lined = edge.isNotNull() | F.coalesce(decl("border"), decl("outline")).rlike("#|rgb|hsl")
    over = F.concat_ws(" ", decl("background"), decl("background-image")).rlike(r"(?i)url\(|gradient\(")
    return [Hit(part & (contrast(edge, F.coalesce(decl("background-color"), decl("background"))) < 3), "A control's edge is hard to see."), Hit(part & lined & over, "A control's edge lies over a picture, contrast cannot be told.", "info")]


@sheet_rule("layout/text-spacing", "1.4.12", "warning")
def text_spacing(s: Sheet) -> list[Hit]:
    fixed = lambda d: d["important"] & d["property"].isin(*SPACING)
    return [Hit(some_decl(fixed), each(fixed, lambda d: F.concat(F.lit("Spacing is fixed: "), d["property"])), on="each")]


@sheet_rule("layout/reflow-hardcoded-width", "1.4.10", "warning")
def fixed_width(s: Sheet) -> list[Hit]:
    def wide(d: Column) -> Column:
        n = F.regexp_extract(F.lower(d["value"]), r"^([\d.]+)(px|pt|pc|in|cm|mm)?$", 1).try_cast("double")
        unit = F.regexp_extract(F.lower(d["value"]), r"^([\d.]+)(px|pt|pc|in|cm|mm)?$", 2)
        return d["property"].isin("width", "min-width") & F.coalesce(F.when(unit.isin("pt", "pc", "in", "cm", "mm"), n.isNotNull()).otherwise(n > 320), F.lit(False))

    return [Hit(~root() & ~F.exists("at_rules", lambda a: a.contains("min-width")), each(wide, lambda d: F.lit("A width does not fit a narrow screen.")), on="each")]


@sheet_rule("layout/orientation-lock", "1.3.4", "warning")
def orientation(s: Sheet) -> list[Hit]:
    value = lambda d: F.lower(d["value"])
    stops = lambda d: ((d["property"] == "display") & (value(d) == "none")) | ((d["property"] == "visibility") & (value(d) == "hidden")) | ((d["property"] == "transform") & value(d).contains("rotate"))
    return [Hit(F.exists("at_rules", lambda a: F.lower(a).rlike(r"@media.*orientation")), each(stops, lambda d: F.lit("Content depends on the orientation.")), on="each")]


@sheet_rule("layout/horizontal-scroll-no-keyboard", "2.1.1", "warning")
def scroll_boxes(s: Sheet) -> list[Hit]:
    """A box that scrolls sideways and is no control, which gets focus by itself."""
    subjects = F.transform(F.split("selector", ","), lambda x: F.regexp_extract(F.trim(x), r"([^\s>+~]+)$", 1))
    control = lambda x: x.rlike(r"(?i)^(textarea|input|select|button|iframe|summary)\b|^a\[href|\[tabindex")
    scrolls = lambda d: d["property"].isin("overflow", "overflow-x") & F.lower(d["value"]).rlike("^(auto|scroll)")
    return [Hit(some_decl(scrolls) & F.exists(subjects, lambda x: ~control(x)), "A scrolling box may not get focus.")]


@sheet_rule("color/state-class-color-only", "1.4.1", "warning")
def color_only(s: Sheet) -> list[Hit]:
    return [Hit(F.col("selector").rlike(r"\.(is-)?(active|error|success|warning|selected|invalid|valid)\b") & F.forall("pairs", lambda p: p["property"].rlike("color|^background$|^fill$|^stroke$")), "A state shows by colour only.")]


@sheet_rule("focus/outline-visible", "2.4.7", "error")
def outlines(s: Sheet) -> list[Hit]:
    gone = said("outline").rlike("^(none|0|0px)$") | (said("outline-style") == "none")
    instead = ~said("box-shadow").isin("", "none") | ~said("border").isin("", "none", "0") | ~said("border-color").isin("") | ~said("background-color").isin("") | ~said("text-decoration").isin("", "none")
    return [Hit(gone & ~instead & (F.col("selector").rlike(":focus") | (F.trim("selector") == "*")), "Focus cannot be seen.")]


@sheet_rule("focus/not-obscured", "2.4.11", "warning")
def obscured(s: Sheet) -> list[Hit]:
    padded = s.file("padded", root() & some_decl(lambda d: d["property"].startswith("scroll-padding") & ~d["value"].rlike(r"^0(px)?$")))
    return [Hit(said("position").isin("fixed", "sticky") & (decl("top").isNotNull() | decl("bottom").isNotNull()) & ~padded, "What gets focus may lie under a fixed part.")]


@rule("keyboard/hover-only-no-focus-mirror", "1.4.13 2.1.1", "warning")
def hover_only(t: Tables) -> DataFrame:
    shown = t.css.filter(F.col("property").isin("transform", "opacity", "visibility", "display")).withColumn("part", F.explode(F.split("selector", ",")))
    plain = lambda pattern: F.trim(F.regexp_replace(F.regexp_replace("part", pattern, ""), r"\s+", " "))
    hover = shown.filter(F.col("part").contains(":hover")).select("file_id", "rule_id", "line", "property", plain(":hover").alias("host"))
    focus = shown.filter(F.col("part").rlike(":focus(-within|-visible)?")).select("file_id", "property", plain(":focus(-within|-visible)?").alias("host"))
    return style(t, hover.join(focus, ["file_id", "property", "host"], "left_anti").select("file_id", "rule_id", "line").distinct(), "It shows on hover and not on focus.")


@sheet_rule("motion/animation-from-interactions", "2.3.3", "warning", "runtime-only")
def animated(s: Sheet) -> list[Hit]:
    moves = F.map_contains_key("decls", F.lit("animation")) | F.map_contains_key("decls", F.lit("transition"))
    return [Hit(F.col("selector").rlike(":(hover|focus|active)") & moves & ~calmed(s), "Motion follows an action and cannot be switched off.")]


def small_target(least: int) -> Column:
    px = lambda n: F.regexp_extract(F.coalesce(decl(n), F.lit("")), r"^([\d.]+)px$", 1).try_cast("double")
    small = F.coalesce(px("width") < least, F.lit(False)) | F.coalesce(px("height") < least, F.lit(False))
    return F.col("selector").rlike(r"(^|[\s,>])(button|a|input|select)\b|\.btn|\[role=.?button") & small & ~F.map_contains_key("decls", F.lit("padding"))


def small_by_class(least: int):
    """Controls that utility classes make too small; links in running text are exempt."""
    def run(t: Tables) -> DataFrame:
        control = (tag("button", "select") | (tag("a") & has("href")) | roles("button", "link")) & ~(tag("a") & F.coalesce(F.col("parent_tag").isin("p", "li", "span"), F.lit(False)))
        sizes = utility_declarations(t.nodes.filter(control)).filter("variant is null and property in ('width', 'height', 'padding')")
        px = F.regexp_extract("value", r"^([\d.]+)(px|rem)$", 1).try_cast("double") * F.when(F.col("value").endswith("rem"), 16).otherwise(1)
        small = sizes.groupBy("file_id", "node_id").agg(F.bool_or((F.col("property") != "padding") & (px < least)).alias("small"), F.bool_or(F.col("property") == "padding").alias("padded")).filter("small and not padded")
        return found(t.nodes.select("file_id", "node_id", "line", "col").join(small, ["file_id", "node_id"]), f"A target is smaller than {least} px.")

    return run


@sheet_rule("pointer/target-size", "2.5.8", "warning", "guidance")
def target_minimum(s: Sheet) -> list[Hit]:
    return [Hit(small_target(24), "A target is smaller than 24 px.")]


@sheet_rule("pointer/target-size-enhanced", "2.5.5", "warning", "guidance")
def target_enhanced(s: Sheet) -> list[Hit]:
    return [Hit(small_target(44), "A target is smaller than 44 px.")]


for id_, least in (("pointer/target-size", 24), ("pointer/target-size-enhanced", 44)):
    RULES[id_] = replace(RULES[id_], find=small_by_class(least))
