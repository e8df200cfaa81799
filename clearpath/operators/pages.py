"""What kind of file a markup source is: page, fragment, layout or partial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables
from .rules import HEADINGS, roles, tag
from .tree import Place, placed

# ---- fixed values: template directives, folders of layouts, landmarks ------------------
LAYOUT_DIRECTIVE = r"(?i)\{%-?\s*(extends|layout)\b|\{\{-?\s*content\s*-?\}\}|@extends\s*\(|@yield\s*\(|<%=?\s*yield\b|<slot\s*/?>|\{\{\{?\s*body\s*\}?\}\}"
COMPOSITION = r"(?i)\{%-?\s*(include|block|render|partial)\b|\{\{>|@include\s*\(|<%-?\s*include\b|<\?(php)?\s*(include|require)|<!--\s*#include"
FRONT_MATTER = r"(?s)^---\s*\n.*?^layout\s*:.*?^---"
LAYOUT_DIRS = r"(?i)(^|/)_?layouts?/"
LANDMARKS = ["main", "nav", "header", "footer", "aside"]
UNSEEN = ["script", "style", "noscript", "template"]


def kind(p: Place) -> tuple[Column, Column, Column]:
    """Whether a file is a fragment, a partial, a full page.

    A fragment has no html element or doctype, no layout directive, and is not in a
    folder of layouts. A partial has html without body or the other way round, names a
    layout, or is composed of others. A full page has a body and one of: a landmark; an
    h1 and five elements in the body; a heading with a list and a control; a heading and
    a script in the body; three visible elements and neither landmark nor heading."""
    some = lambda name, c: p.file(name, F.bool_or(c))
    html, body = p.is_("html", tag("html")), p.is_("body", tag("body"))
    inside = p.above("body", tag("body"))
    first = p.file("body", F.min(F.when(body, F.struct("node_id", "last_id"))))
    size = first["last_id"] - first["node_id"]
    seen = size - p.file("unseen", F.count_if(p.is_("unseen", tag(*UNSEEN)) & inside))
    within = lambda name, c: some(f"in-body-{name}", p.is_(name, c) & inside)
    mark, h1 = some("landmark", p.is_("landmark", tag(*LANDMARKS))), within("h1", tag("h1"))
    heading = within("any-heading", tag(*HEADINGS) | roles("heading"))
    lists, control, script = within("list", tag("ul", "ol", "dl")), within("control", tag("a", "button", "input", "select", "textarea")), within("script", tag("script"))
    source = F.col("source")
    directive, composed = p.about("directive", source.rlike(LAYOUT_DIRECTIVE)), p.about("composed", source.rlike(COMPOSITION))
    opener, folder = p.about("opener", source.rlike(r"(?i)<!doctype\s+html|<html[\s>]")), p.about("folder", F.col("path").rlike(LAYOUT_DIRS))
    front = p.about("front", source.rlike("(?m)" + FRONT_MATTER))
    has_html, has_body = some("html", html), some("has-body", body)
    full = has_body & (mark | (h1 & (size >= 5)) | (heading & lists & control) | (heading & script) | (~mark & ~heading & (seen >= 3)))
    return ~(opener | has_html | directive | folder), (has_html != has_body) | front | composed | directive, full


def page_kinds(t: Tables) -> DataFrame:
    """file_id with fragment, partial and full_page, one row a file that has elements."""
    p = Place()
    first = p.is_("first", F.col("node_id") == 0)
    names = ("fragment", "partial", "full_page")
    columns = [c.alias(n) for c, n in zip(kind(p), names, strict=True)]
    return placed(t.nodes, t.files, p, t.elements()).filter(first).select("file_id", *columns)
