"""Text and identity expressions that reports and rules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase(text: Column) -> Column:
    """A link text as it is compared: one space, lower case, no closing marks."""
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.trim(F.regexp_replace(t, r"[.!?→>»…\s]+$", ""))


def finding_id(rule: Column, path: Column, line: Column, col: Column) -> Column:
    """12 hex digits that name one finding."""
    return F.substring(F.sha2(F.concat_ws(" ", rule, path, line.cast("string"), col.cast("string")), 256), 1, 12)


def group_key(rule: Column, shape: Column) -> Column:
    """Equal for findings of one rule on elements of one shape."""
    return F.substring(F.sha2(F.concat(rule, F.lit("\0"), shape), 256), 1, 12)


def criterion_order(local_id: Column) -> Column:
    """Sort key of a dotted criterion number."""
    return F.transform(F.split(local_id, r"\."), lambda x: x.try_cast("int"))


def group_id(rule: Column, path: Column, line_text: Column) -> Column:
    """12 hex digits that survive moves of a line: its text with single spaces counts, not its number."""
    return F.substring(F.sha2(F.concat_ws(" ", rule, path, F.trim(F.regexp_replace(line_text, r"\s+", " "))), 256), 1, 12)


def candidate_id(finder: Column, criterion: Column, path: Column, line: Column, col: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(" ", finder, criterion, path, line.cast("string"), col.cast("string")), 256), 1, 12)


def shape(tag: Column, attr_names: Column, role: Column) -> Column:
    """A canonical description of an element: tag, role and sorted names of attributes."""
    return F.concat(tag, F.lit("["), F.array_join(F.array_sort(F.array_distinct(attr_names)), ","), F.lit("]"), F.coalesce(F.concat(F.lit(":"), role), F.lit("")))


def kebab(text: Column) -> Column:
    """An id made of a text: lower case words with hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def shortened(text: Column, n: int = 200) -> Column:
    """For display: at most n characters and an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def posix(path: Column) -> Column:
    """Forward slashes, no ./ in front, no doubled ones."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""), r"/{2,}", "/")


def extension(path: Column) -> Column:
    """Lower-case extension; a template's ending (.html.erb, .blade.php) counts by what it makes."""
    p = F.lower(path)
    return F.when(p.rlike(r"\.blade\.php$"), "html").otherwise(F.regexp_extract(F.regexp_replace(p, r"\.(erb|ejs|hbs|njk|liquid|twig|j2)$", ""), r"\.([a-z0-9]+)$", 1))


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(__tests__|tests?|spec|e2e|cypress)/|\.(test|spec|stories)\.\w+$")


def host(url: Column) -> Column:
    """Lower-case host of an absolute or protocol-relative URL; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^@/]*@)?([^/:?#]+)", 1)), F.lit(""))


def canonical_json(rows: dict | list) -> str:
    """JSON with sorted keys and no spaces, for digests of small driver-side values."""
    import json

    return json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
