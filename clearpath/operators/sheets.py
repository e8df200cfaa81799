"""What rules ask about a rule of a style sheet: its declarations and facts of its file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sheet_rows(css: DataFrame) -> DataFrame:
    """One row a style rule: its selector, first line, at-rules, all declarations in order
    (``all``) and the last of each name (``decls``, ``pairs``). One shuffle, by file."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", "property", "value", "line", "important")))
    rows = css.repartition("file_id").groupBy("file_id", "rule_id").agg(F.first("selector").alias("selector"), F.min("line").alias("line"), F.first("at_rules").alias("at_rules"), pairs.alias("all"))
    last = F.aggregate("all", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["property"]), F.create_map(p["property"], p["value"])))
    rows = rows.withColumn("decls", last)
    return rows.withColumn("pairs", F.transform(F.map_entries("decls"), lambda e: F.struct(e["key"].alias("property"), e["value"].alias("value"))))


@dataclass
class Sheet:
    """Facts of files that rules on style rules have asked for."""

    wanted: dict[str, Column] = field(default_factory=dict)

    def file(self, name: str, condition: Column) -> Column:
        """Whether some style rule of the file is so."""
        self.wanted.setdefault(name, condition)
        return F.col(f"file_{name}")

    def rows(self, rules: DataFrame) -> DataFrame:
        whole = Window.partitionBy("file_id")
        return rows_with(rules, {f"file_{n}": F.max(F.coalesce(c, F.lit(False))).over(whole) for n, c in self.wanted.items()})


def rows_with(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rows.withColumns(columns) if columns else rows


def each(condition, message) -> Column:
    """(line, message) of the declarations that are so; both are functions of a declaration."""
    return F.transform(F.filter("all", condition), lambda d: F.struct(d["line"].alias("line"), message(d).alias("message")))
