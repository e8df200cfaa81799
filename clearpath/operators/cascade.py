"""Computed styles: which declaration wins at each element, and what it inherits.

1. Selectors are compiled to rows: a selector is a chain of compounds (a tag, ids, classes,
   attributes) joined by descendant or child combinators. Selectors with pseudo-classes,
   sibling combinators or under at-rules hold under conditions that a source does not tell,
   and are left out.
2. Compounds meet elements in an equi-join on their rarest part (id, else class, else tag)
   within a page's sheets: its style elements and the sheets that its links name.
3. A chain is matched from its left end: an element matches the first j compounds if it
   matches the j-th, and an ancestor (or its parent, by combinator) the first j - 1. One join
   a compound, as many as the longest chain has.
4. Of the declarations of a property at an element one wins: important, inline, specificity,
   order. A window by (file, element, property).
5. What is not declared comes from the nearest ancestor that has it: an equi-join of
   elements with their ancestors' winners.

Elements without any declaration above them have no row. Files without sheets give none.

Both sides of each join grow with the files. Persisted tables of like rows are packed to a
few bytes a row, and by that size Spark would send them to the driver and to every task;
so the joins ask for a shuffle and merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import contrast, points, transparent
from .registry import Tables

#: Selectors that a source alone decides.
PLAIN = r"^[\w\-#.*\[\]=\"'\s>]+$"
_NAME = r"[\w-]+"


def selectors(t: Tables) -> DataFrame:
    """One row a compound: file_id (of the sheet), rule_id, alternative, at (from 1), length,
    child (by combinator), tag, ids, classes, attributes, key, and the whole chain's specificity."""
    rules = t.css.filter("size(at_rules) = 0").groupBy("file_id", "rule_id").agg(F.first("selector").alias("selector"))
    parts = rules.select("file_id", "rule_id", F.posexplode(F.split("selector", ",")).alias("alternative", "chain"))
    chain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("chain", r":root\b", "html"), r"\s*>\s*", " >"), r"\s+", " "))
    parts = parts.withColumn("chain", chain).filter(F.col("chain").rlike(PLAIN) & ~F.col("chain").startswith(">"))
    every = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    bare = F.regexp_replace("chain", r"\[[^\]]*\]", "")
    weight = F.struct(F.size(every(bare, rf"#({_NAME})")).alias("a"), (F.size(every(bare, rf"\.({_NAME})")) + F.size(every(F.col("chain"), r"\[([^\]]*)\]"))).alias("b"), F.size(every(bare, rf"(?:^|[ >])({_NAME})")).alias("c"))
    parts = parts.withColumn("weight", weight).withColumn("length", F.size(F.split("chain", " ")))
    rows = parts.select("file_id", "rule_id", "alternative", "weight", "length", F.posexplode(F.split("chain", " ")).alias("at", "compound"))
    part = F.regexp_replace("compound", r"^>|\[[^\]]*\]", "")
    rows = rows.select(
        "file_id", "rule_id", "alternative", "weight", "length", (F.col("at") + 1).alias("at"), F.col("compound").startswith(">").alias("child"), F.lower(F.nullif(F.regexp_extract(part, rf"^({_NAME})", 1), F.lit(""))).alias("c_tag"),
        every(part, rf"#({_NAME})").alias("c_ids"), every(part, rf"\.({_NAME})").alias("c_classes"), every(F.col("compound"), r"\[([^\]]*)\]").alias("c_attrs"),
    )
    key = F.when(F.size("c_ids") > 0, F.concat(F.lit("#"), F.col("c_ids")[0])).when(F.size("c_classes") > 0, F.concat(F.lit("."), F.col("c_classes")[0])).otherwise(F.coalesce("c_tag", F.lit("*")))
    return rows.withColumn("key", key)


def sheets_of(t: Tables) -> DataFrame:
    """(file_id, sheet): the sheets of each page, its own style elements among them."""
    own = t.nodes.filter("tag = 'style'").select("file_id", F.col("file_id").alias("sheet"))
    links = t.nodes.filter((F.col("tag") == "link") & F.coalesce(F.lower(F.col("attrs")["rel"]).contains("stylesheet"), F.lit(False)) & F.col("attrs")["href"].isNotNull()).select("file_id", F.col("attrs")["href"].alias("href"))
    named = links.join(t.files.select("file_id", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("folder")).hint("merge"), "file_id")
    path = F.regexp_replace(F.when(F.col("href").startswith("/"), F.substring("href", 2, 1_000_000)).otherwise(F.concat("folder", F.regexp_replace("href", r"^(\./)+", ""))), r"[?#].*$", "")
    for _ in range(8):  # folders that a path leaves again
        path = F.regexp_replace(path, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    linked = named.select("file_id", path.alias("path")).join(t.files.select(F.col("file_id").alias("sheet"), "path").hint("merge"), "path").select("file_id", "sheet")
    return own.unionByName(linked).distinct()


def _fits(n: str = "") -> Column:
    """Whether an element is what a compound says."""
    attribute = lambda a: F.when(a.contains("="), F.col("attrs")[F.regexp_extract(a, r"^([\w-]+)", 1)] == F.regexp_extract(a, r"=[\"']?([^\"']*)", 1)).otherwise(F.map_contains_key("attrs", F.trim(a)))
    return (F.col("c_tag").isNull() | (F.col("c_tag") == F.col("tag"))) & F.forall("c_ids", lambda i: i == F.col("id")) & F.forall("c_classes", lambda c: F.array_contains("classes", c)) & F.forall("c_attrs", lambda a: F.coalesce(attribute(a), F.lit(False)))


def matches(t: Tables, longest: int | None = None) -> DataFrame:
    """file_id, node_id, sheet, rule_id and weight of the style rules that hold at elements;
    ``longest`` chain (counted if not given)."""
    compounds = t.once("selectors", lambda: selectors(t))
    longest = longest or compounds.agg(F.max("length")).first()[0] or 0
    keys = F.concat(F.array(F.col("tag"), F.lit("*")), F.when(F.col("id") != "", F.array(F.concat(F.lit("#"), "id"))).otherwise(F.array().cast("array<string>")), F.transform("classes", lambda c: F.concat(F.lit("."), c)))
    elements = t.nodes.join(sheets_of(t).hint("merge"), "file_id").select("file_id", "sheet", "node_id", "parent_id", "ancestors", "tag", "id", "classes", "attrs", F.explode(F.array_distinct(keys)).alias("key"))
    name = ["sheet", "rule_id", "alternative"]
    held = elements.join(compounds.withColumnRenamed("file_id", "sheet").hint("merge"), ["sheet", "key"]).filter(_fits())
    held = t.once("compounds", lambda: held.select("file_id", "node_id", "parent_id", "ancestors", *name, "weight", "length", "at", "child"))
    so_far = held.filter("at = 1").select("file_id", "node_id", *name, "length", "weight")
    done = [so_far.filter("length = 1")]
    for at in range(2, longest + 1):
        here = held.filter(F.col("at") == at)
        above = F.explode(F.when(F.col("child"), F.array("parent_id")).otherwise(F.col("ancestors")))
        pairs = here.withColumn("above", above).join(so_far.select("file_id", F.col("node_id").alias("above"), *name).hint("merge"), ["file_id", "above", *name], "left_semi")
        so_far = pairs.select("file_id", "node_id", *name, "length", "weight").distinct()
        done.append(so_far.filter(F.col("length") == at))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("file_id", "node_id", "sheet", "rule_id").agg(F.max("weight").alias("weight"))


def cascaded(t: Tables, properties: list[str], longest: int | None = None) -> DataFrame:
    """file_id, node_id, property, value and rule_id (null: inline) of the winning declarations."""
    declared = t.css.filter(F.col("property").isin(*properties)).select(F.col("file_id").alias("sheet"), "rule_id", "property", "value", "important", "ord")
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    by_rule = matches(t, longest).join(declared.hint("merge"), ["sheet", "rule_id"]).select("file_id", "node_id", "property", "value", "important", F.lit(False).alias("inline"), "weight", "ord", "rule_id")
    own = t.nodes.filter(F.map_contains_key("attrs", F.lit("style"))).select("file_id", "node_id", F.posexplode(F.split(F.col("attrs")["style"], ";")).alias("ord", "d"))
    own = own.select("file_id", "node_id", F.lower(F.trim(F.regexp_extract("d", r"^([^:]*):", 1))).alias("property"), F.trim(F.regexp_extract("d", r":(.*)$", 1)).alias("value"), F.col("ord").cast("long"))
    own = own.filter(F.col("property").isin(*properties)).select("file_id", "node_id", "property", F.regexp_replace("value", r"(?i)\s*!\s*important\s*$", "").alias("value"), F.col("value").rlike(r"(?i)!\s*important\s*$").alias("important"), F.lit(True).alias("inline"), zero.alias("weight"), "ord", F.lit(None).cast("long").alias("rule_id"))
    order = Window.partitionBy("file_id", "node_id", "property").orderBy(F.desc("important"), F.desc("inline"), F.desc("weight"), F.desc("ord"))
    return by_rule.unionByName(own).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("file_id", "node_id", "property", "value", "rule_id")


def computed(t: Tables, properties: list[str], longest: int | None = None, skip=None) -> DataFrame:
    """``cascaded``, and for elements without a declaration what the nearest ancestor with one
    gives: file_id, node_id, property, value and at (whose declaration it is). ``skip``: a
    condition on winners that let what is behind them through."""
    won = cascaded(t, properties, longest).filter(~F.lower("value").isin("inherit", "unset"))
    won = won if skip is None else won.filter(~skip)
    family = t.nodes.select("file_id", "node_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("at"))
    pairs = family.join(won.select("file_id", F.col("node_id").alias("at"), "property", "value").hint("merge"), ["file_id", "at"])
    return pairs.groupBy("file_id", "node_id", "property").agg(F.max(F.struct("at", "value")).alias("w")).select("file_id", "node_id", "property", "w.value", "w.at")


def text_contrast(t: Tables, longest: int | None = None) -> DataFrame:
    """file_id, node_id, line, col, front, back, ratio and large of elements with text of
    their own whose colours are told, by their page's whole cascade."""
    styles = ["color", "background-color", "background", "font-size", "font-weight"]
    see_through = F.col("property").startswith("background") & (transparent(F.col("value")) | F.lower("value").isin("none", ""))
    rows = computed(t, styles, longest, see_through).groupBy("file_id", "node_id").agg(
        *(F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in ("color", "font-size", "font-weight")), F.max(F.when(F.col("property").startswith("background"), F.struct("at", "value")))["value"].alias("back"),
    )
    inner = t.nodes.filter("parent_id is not null").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.sum(F.length("text")).alias("inner"))
    spoken = t.nodes.filter(~F.col("tag").isin("script", "style", "title", "head", "html")).join(inner.hint("merge"), ["file_id", "node_id"], "left").filter(F.length("text") > F.coalesce("inner", F.lit(0)))
    size, weight = points(F.col("font-size")), F.col("font-weight")
    large = F.coalesce((size >= 18) | ((size >= 14) & (weight.isin("bold", "bolder") | (weight.try_cast("int") >= 700))), F.lit(False))
    out = spoken.join(rows.hint("merge"), ["file_id", "node_id"]).select("file_id", "node_id", "line", "col", F.col("color").alias("front"), "back", contrast(F.col("color"), F.col("back")).alias("ratio"), large.alias("large"))
    return out.filter("ratio is not null")
