"""Style sheets as a table of declarations: one row a declaration, with its selector
and the at-rules around it. Comments go; nested at-rules are kept as a path."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialects import sheet
from .lines import line_finder

CSS_SCHEMA = "file_id long, rule_id long, selector string, at_rules array<string>, line int, property string, value string, important boolean, ord long"
_CSS = pa.schema([("file_id", pa.int64()), ("rule_id", pa.int64()), ("selector", pa.string()), ("at_rules", pa.list_(pa.string())), ("line", pa.int32()), ("property", pa.string()), ("value", pa.string()), ("important", pa.bool_()), ("ord", pa.int64())])
_PART = re.compile(r"([^{};]*)([{};])", re.S)


def declarations(source: str) -> list[tuple]:
    """(rule, selector, at-rules, line, property, value, important, place) in order."""
    source = re.sub(r"/\*.*?(\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    line_of = line_finder(source)
    out, stack, rule = [], [], -1
    for m in _PART.finditer(source):
        head, mark = m[1].strip(), m[2]
        if mark == "{":
            rule += 1
            stack.append((head, rule, line_of(m.end())))
            continue
        if head and ":" in head and stack and not stack[-1][0].startswith("@"):
            name, _, value = head.partition(":")
            important = value.rstrip().lower().endswith("!important")
            value = re.sub(r"\s*!important\s*$", "", value.strip(), flags=re.I)
            line = line_of(m.start() + len(m[1]) - len(m[1].lstrip()))
            out.append((stack[-1][1], stack[-1][0], [s[0] for s in stack[:-1]], line, name.strip().lower(), value, important, len(out)))
        if mark == "}" and stack:
            stack.pop()
    return out


def read_css(files: DataFrame) -> DataFrame:
    """``files`` (file_id, source, and maybe dialect, first_line and first_rule, where the
    source is a part of a file) -> declarations. Null source: none."""
    optional = {"dialect": "", "first_line": 1, "first_rule": 0}
    columns = [F.col(c) if c in files.columns else F.lit(v).alias(c) for c, v in optional.items()]

    def run(batches):
        for batch in batches:
            rows = []
            for file_id, source, dialect, line, rule in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(file_id, rule + d[0], d[1], d[2], line - 1 + d[3], *d[4:7], rule + d[7]) for d in declarations(sheet(source or "", dialect))]
                if len(rows) >= 20_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    return files.select("file_id", "source", *columns).mapInArrow(run, CSS_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_CSS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CSS, strict=True)], schema=_CSS)
