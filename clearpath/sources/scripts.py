"""Scripts as a table of tokens, and as text without comments.

``script_tokens`` gives one row a token of each script file and each script element:
names, punctuation, strings, templates, numbers and regular expressions, with the scope
(the path of open braces, as ``/3/17/``) it stands in. Comments give none. What the tokens
mean is DataFrame work (``operators.scripts``): windows over neighbours, joins of names with
what they are bound to.

A task reads one script at a time; nothing is nested, so a script of any depth is read in
a loop. Unclosed strings end with their line, unclosed templates and comments with the
source. Null sources give no token.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import line_finder

SCRIPTS = ["js", "mjs", "cjs", "ts", "jsx", "tsx"]
SCHEMA = "file_id long, script int, n int, line int, col int, kind string, text string, scope string"
_ROWS = pa.schema([("file_id", pa.int64()), ("script", pa.int32()), ("n", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("scope", pa.string())])
_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|<!--[^\n]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))"
    r"|(?P<template>`)|(?P<slash>/)|(?P<sign>=>|===|!==|==|!=|&&|\|\||\?\?|\?\.|\+=|-=|\S)", re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these a slash begins a regular expression, after other names it divides.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do".split())
#: A string of this shape names something; longer ones are prose or code.
_PLAIN = re.compile(r"[\w\-#.:/@\[\]* ,?&%]{0,200}\Z")


def _template(source: str, at: int) -> int:
    """Place of the end of the template whose text goes on at ``at``: its closing mark or
    the brace of a substitution."""
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 2
        elif c == "`" or source.startswith("${", at):
            return at
        else:
            at += 1
    return len(source)


def tokens(source: str):
    """(start, end, kind, text) of tokens and comments; of a template each piece of text."""
    at, last, kind_of_last = 0, "", ""
    open_: list[str] = []  # braces: of blocks, and of substitutions in templates
    while m := _TOKEN.search(source, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "slash":
            value = kind_of_last in ("number", "string", "template", "regex") or kind_of_last == "name" and last not in _BEFORE_REGEX or last in (")", "]", "}")
            r = None if value else _REGEX.match(source, start)
            kind, at = ("regex", r.end()) if r else ("sign", start + 1)
        elif kind == "sign" and m[0] == "{":
            open_.append("{")
        elif kind == "sign" and m[0] == "}" and open_ and open_.pop() == "$":
            kind = "template"
        if kind == "template":
            stop = _template(source, at)
            yield start, stop, kind, source[at:stop]
            at = stop + (2 if source.startswith("${", stop) else 1)
            if source.startswith("${", stop):
                open_.append("$")
                last, kind_of_last = "(", "sign"
                continue
            last, kind_of_last = "`", kind
            continue
        text = source[start:at]
        yield start, at, kind, text[1:-1] if kind == "string" and len(text) > 1 and text[-1] == text[0] else text
        if kind != "comment":
            last, kind_of_last = text, kind


def uncommented(source: str) -> str:
    """The script with comments, and strings that are more than a name, blanked in place."""
    out, at = [], 0
    for start, end, kind, text in tokens(source):
        if kind in ("comment", "regex") or kind in ("string", "template") and not _PLAIN.match(text):
            out += [source[at:start], re.sub(r"[^\n]", " ", source[start:end])]
            at = end
    return "".join([*out, source[at:]])


_INNER = re.compile(r"(<!--.*?(?:-->|\Z))|(<script\b[^>]*>)(.*?)(?=</script|\Z)", re.S | re.I)


def code_only(source: str, ext: str) -> str:
    """A file's text without comments: scripts, and markup with the scripts in it."""
    if ext in SCRIPTS:
        return uncommented(source)
    return _INNER.sub(lambda m: re.sub(r"[^\n]", " ", m[1]) if m[1] else m[2] + uncommented(m[3]), source)


def read_code(files: DataFrame) -> DataFrame:
    """``files`` (file_id, path, source) with ``source`` as ``code_only`` leaves it."""

    def run(batches):
        for batch in batches:
            ids, sources, exts = (c.to_pylist() for c in batch.columns[:3])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code_only(s or "", e) for s, e in zip(sources, exts, strict=True)], pa.string())], names=["file_id", "source"])

    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("file_id", "source", ext.alias("ext")).mapInArrow(run, "file_id long, source string")


def script_tokens(sources: DataFrame) -> DataFrame:
    """``sources``: file_id, script (0 for a whole file, or a number), first_line, source."""

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for file_id, script, first, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line_of, stack, n = line_finder(source or ""), [], 0
                for start, _, kind, text in tokens(source or ""):
                    if kind == "comment":
                        continue
                    if text == "}" and kind == "sign" and stack:
                        stack.pop()
                    line = line_of(start)
                    col = start - (source.rfind("\n", 0, start) + 1) + 1
                    rows.append((file_id, script, n, first + line - 1, col, kind, text, "/" + "".join(f"{s}/" for s in stack)))
                    if text == "{" and kind == "sign":
                        stack.append(n)
                    n += 1
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return sources.select("file_id", "script", "first_line", "source").mapInArrow(run, SCHEMA)
