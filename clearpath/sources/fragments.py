"""Markup inside scripts, and utility classes as declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: a small default theme ------------------------------------------------
SIZES = {"xs": "0.75rem", "sm": "0.875rem", "base": "1rem", "lg": "1.125rem", "xl": "1.25rem", "2xl": "1.5rem", "3xl": "1.875rem", "4xl": "2.25rem", "5xl": "3rem"}
COLOURS = {
    "white": "#ffffff", "black": "#000000", "gray-100": "#f3f4f6", "gray-200": "#e5e7eb", "gray-300": "#d1d5db", "gray-400": "#9ca3af", "gray-500": "#6b7280", "gray-600": "#4b5563", "gray-700": "#374151", "gray-800": "#1f2937", "gray-900": "#111827",
    "red-500": "#ef4444", "red-600": "#dc2626", "red-700": "#b91c1c", "green-500": "#22c55e", "green-600": "#16a34a", "green-700": "#15803d", "blue-500": "#3b82f6", "blue-600": "#2563eb", "blue-700": "#1d4ed8", "yellow-500": "#eab308",
}
SPACED = {"p": "padding", "m": "margin", "w": "width", "h": "height", "gap": "gap", "min-w": "min-width", "min-h": "min-height"}


def utility_declarations(nodes: DataFrame, colours: dict[str, str] | None = None) -> DataFrame:
    """file_id, node_id, line, variant, property and value of utility classes: colours of
    text and background, font sizes, spacing in quarters of a rem, and values in brackets.
    Unknown classes give nothing; a variant (hover, md) is what stands before a colon."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    rows = nodes.select("file_id", "node_id", "line", F.explode("classes").alias("token"))
    rows = rows.withColumn("variant", F.nullif(F.regexp_extract("token", r"^(.*):", 1), F.lit(""))).withColumn("name", F.regexp_replace("token", r"^.*:(?![^\[]*\])", ""))
    kind, key = F.regexp_extract("name", r"^(text|bg|border|p|m|w|h|gap|min-w|min-h)-(.+)$", 1), F.regexp_extract("name", r"^(text|bg|border|p|m|w|h|gap|min-w|min-h)-(.+)$", 2)
    rows = rows.withColumns({"kind": kind, "key": key}).filter("kind <> ''")
    given = F.nullif(F.regexp_extract("key", r"^\[(.+)\]$", 1), F.lit(""))
    colour, size = table(colours or COLOURS)[F.col("key")], table(SIZES)[F.col("key")]
    steps = F.regexp_extract("key", r"^(\d+(?:\.\d+)?)$", 1).try_cast("double")
    spacing = F.concat(F.regexp_replace((steps * 0.25).cast("string"), r"\.0$", ""), F.lit("rem"))
    is_size = (F.col("kind") == "text") & (size.isNotNull() | F.coalesce(given.rlike(r"^[\d.]+(px|rem|em|pt)$"), F.lit(False)))
    prop = F.when(is_size, "font-size").when(F.col("kind") == "text", "color").when(F.col("kind") == "bg", "background-color").when(F.col("kind") == "border", "border-color").otherwise(table(SPACED)[F.col("kind")])
    value = F.when(F.col("kind").isin("text", "bg", "border"), F.coalesce(F.when(is_size, size), colour, given)).otherwise(F.coalesce(given, spacing))
    return rows.select("file_id", "node_id", "line", "variant", prop.alias("property"), value.alias("value")).filter("value is not null and property is not null")


def inline_markup(files: DataFrame) -> DataFrame:
    """file_id, first_line and source of the strings and templates of scripts that hold
    markup: the pieces a reader of elements may be given."""
    # Possessive, so that a match takes no stack however long a string is.
    body = lambda q, no: rf"{q}(?:[^{q}\\<{no}]++|\\.|<(?![a-zA-Z]))*+<[a-zA-Z](?:[^{q}\\{no}]++|\\.)*+{q}"
    piece = "(?s)" + "|".join((body("`", ""), body('"', "\\n"), body("'", "\\n")))
    scripts = files.filter(F.lower("path").rlike(r"\.(js|ts|mjs|cjs)$") & F.col("source").rlike(piece))
    found = scripts.select("file_id", "source", F.posexplode(F.regexp_extract_all("source", F.lit(piece), F.lit(0))).alias("n", "piece"))
    # Equal pieces begin where the first does; what stands before it tells the line.
    before = F.expr("substring(source, 1, locate(piece, source) - 1)")
    return found.select("file_id", "n", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("first_line"), F.expr("substring(piece, 2, length(piece) - 2)").alias("source"))
