"""What rules ask about an element's place in its page, worked out for all rules at once.

A rule names the facts it needs (``place.above("label", tag("label"))``) and gets columns;
facts asked for by several rules are made once. The compiled plan is one shuffle by file
of slim rows (elements that no rule asks about leave before it), then sorts within it:

* above, below: a sweep over the tree's intervals. An element opens at its number and
  closes at that of its last descendant; running counts of flagged elements that opened
  and closed give how many lie around it, and, by their difference at its two ends, how
  many lie inside. Two rows an element, whatever the depth.
* nearest: the elements that open on one level of a kind are a sequence, and the latest of
  them is around all that comes on that level: a running last value by (file, level).
* child, beside, previous, earlier: windows by parent.
* within: counts by the nearest element of a kind. In file: windows by file.
* refs: rows for the ids, keys and names that an element mentions; a window by (file,
  token) tells what else mentions them.

All windows are within a file, so the work grows with the elements (times the logarithm
of a page's), and a lost executor costs its own files. Each window copies its rows field by
field, so what a row carries is kept narrow: facts that hold or not are bits of a few
numbers, counts are two to a number, and who asks for a fact gets the expression that reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facts to a number.
BITS = 60


def _bit(names, name: str, column: str) -> str:
    """Whether the fact holds, in numbers that ``_bits`` made of the same names."""
    i = list(names).index(name)
    return f"({column}{i // BITS} & {1 << i % BITS}L) <> 0"


def _bits(conditions: list[str]) -> list[str]:
    """Numbers whose bits are the conditions (none of which is null), in their order."""
    return [" | ".join(f"if({c}, {1 << j}L, 0L)" for j, c in enumerate(conditions[i : i + BITS])) for i in range(0, len(conditions), BITS)]


def _half(names, name: str, column: str) -> str:
    """A count out of pairs that ``_pairs`` made of the same names."""
    i = list(names).index(name)
    return f"(shiftrightunsigned({column}{i // 2}, 32))" if i % 2 else f"({column}{i // 2} & 4294967295L)"


def _pairs(counts: list[str]) -> list[str]:
    """Counts two to a number: of elements of a page, each stays below 2 ** 31. They may be
    summed and subtracted so, as long as no count in it comes below nought."""
    return [" + ".join(f"{c} * {1 << 32 * j}L" for j, c in enumerate(counts[i : i + 2])) for i in range(0, len(counts), 2)]


@dataclass
class Hit:
    """A finding where ``when`` holds; ``on`` names the kind of mention it is about."""

    when: Column
    message: str | Column
    severity: str | Column | None = None
    on: str = "self"


@dataclass
class Place:
    """Facts that the rules of a run have asked for."""

    flags: dict[str, Column] = field(default_factory=dict)
    values: dict[str, Column] = field(default_factory=dict)
    wanted: dict[str, dict[str, Column | tuple | None]] = field(default_factory=dict)
    columns: dict[str, Column] = field(default_factory=dict)

    def _column(self, sql: str) -> Column:
        if sql not in self.columns:
            self.columns[sql] = F.expr(sql)
        return self.columns[sql]

    def _want(self, kind: str, name: str, how=None, sql: str = "{}") -> Column:
        self.wanted.setdefault(kind, {}).setdefault(name, how)
        return self._column(sql.format(f"`{kind}_{name}`"))

    def _packed(self, kind: str, name: str) -> Column:
        self._want(kind, name)
        return self._column(_bit(self.wanted[kind], name, f"_{kind}"))

    def is_(self, name: str, condition: Column) -> Column:
        """A condition on the element itself."""
        self.flags.setdefault(name, condition)
        return self._column(self.flag(name))

    def flag(self, name: str) -> str:
        return _bit(self.flags, name, "_is")

    def value(self, name: str, value: Column) -> Column:
        """A value of the element itself, for rows that some flag keeps."""
        self.values.setdefault(name, value)
        return self._column(f"`v_{name}`")

    def above(self, name: str, condition: Column) -> Column:
        """Whether an ancestor is so."""
        self.is_(name, condition)
        return self._packed("above", name)

    def below(self, name: str, condition: Column) -> Column:
        """How many descendants are so."""
        self.is_(name, condition)
        self._want("below", name)
        return self._column(_half(self.wanted["below"], name, "_below"))

    def child(self, name: str, condition: Column) -> Column:
        """Whether a child is so."""
        self.is_(name, condition)
        return self._packed("child", name)

    def beside(self, name: str, condition: Column) -> Column:
        """Whether an element with the same parent (itself too) is so."""
        self.is_(name, condition)
        return self._packed("beside", name)

    def cousin(self, name: str, condition: Column) -> Column:
        """Whether an element with the same grandparent is so."""
        self.is_(name, condition)
        return self._packed("cousin", name)

    def previous(self, name: str, value: Column) -> Column:
        """A value of the sibling just before."""
        self.values.setdefault(name, value)
        return self._want("previous", name)

    def earlier(self, name: str, value: Column) -> Column:
        """The latest value among siblings before."""
        self.values.setdefault(name, value)
        return self._want("earlier", name)

    def nearest(self, name: str, condition: Column) -> Column:
        """Number of the innermost ancestor that is so; null without one."""
        self.above(name, condition)
        return self._want("nearest", name)

    def within(self, kind: str, condition: Column, name: str, made: Callable[[list], Column], together: bool = False) -> Column:
        """An aggregate (of a window over them) of the elements whose innermost ``kind`` (those that
        ``condition`` names) is this element's, or this element. ``together``: it rests on no
        other such aggregate, so it may share a window with those asked for just before."""
        self.nearest(kind, condition)
        return self._want("within", f"{kind}_{name}", (kind, made, together))

    def file(self, name: str, aggregate: Column) -> Column:
        """An aggregate over all rows of the file; it may use facts of the tree."""
        return self._want("file", name, aggregate)

    def running(self, name: str, aggregate: Column, itself: bool = True) -> Column:
        """An aggregate over the file's rows up to this one."""
        return self._want("running", name, (aggregate, 0 if itself else -1))

    def about(self, name: str, condition: Column) -> Column:
        """A condition on the file (path, source)."""
        return self._want("about", name, condition)

    def mentions(self, kind: str, tokens: Column, space: str = "id") -> None:
        """``tokens``: array of (token, name) that an element mentions, as facts or own values."""
        self._want("mentions", kind, (tokens, space))

    def mentioned(self, name: str, kind: str, condition: Column | None = None) -> Column:
        """Whether a mention of this kind, and so, has the same token as this one."""
        if kind == "self" and condition is None:  # any element with an id may be what is meant
            self.is_("identified", F.col("id") != "")
        return self._want("mentioned", name, (kind, condition))

    def rank(self) -> Column:
        """1 for the first mention of its kind and token in the file."""
        return self._want("rank", "all")

    def first_line(self) -> Column:
        self._want("rank", "all")
        return self._column("first_line")


def mention(name: str) -> Column:
    return F.expr(f"mention.{name}")


def tokens(condition: Column, values: Column, name: Column | str = "") -> Column:
    """Mentions: an array of tokens as (token, name), empty where ``condition`` does not hold."""
    said = F.lit(name) if isinstance(name, str) else name
    return F.when(condition, F.transform(values, lambda x: F.struct(x.alias("token"), said.alias("name")))).otherwise(none())


def none() -> Column:
    return F.expr("cast(array() as array<struct<token:string,name:string>>)")


#: Elements of a task, which holds the rows of several sorts of them.
ELEMENTS_A_TASK = 60_000


def placed(nodes: DataFrame, files: DataFrame, place: Place, elements: int) -> DataFrame:
    """Rows of elements (and their mentions) with all columns that ``place`` was asked for.
    ``elements``: how many there are; as many tasks as they need do the windows, so a task's
    memory does not grow with the input (but by a page larger than that)."""
    w = place.wanted
    valued = [n for n in place.values if n in w.get("previous", {}) or n in w.get("earlier", {})]
    # Flags travel as one array, which the filter looks at: a filter that named them one by
    # one would give the optimizer a fact for each way to write it. Exploded, they are made
    # once: the optimizer would put a filter of a plain column beneath it, with all flags in it.
    known = F.array(*place.flags.values(), *(place.values[n].isNotNull() for n in valued))
    base = "file_id node_id parent_id last_id ord line col tag parent_tag id".split()
    rows = nodes.select("*", F.explode(F.array(known)).alias("_flags")).filter("array_contains(_flags, true)")
    rows = rows.select(*base, F.expr("get(ancestors, size(ancestors) - 2) as grand_id"), "_flags", *(c.alias(f"v_{n}") for n, c in place.values.items()))
    packed = "aggregate(reverse(slice(_flags, {0}, {1})), 0L, (bits, f) -> shiftleft(bits, 1) | if(f, 1L, 0L)) as _is{2}"
    rows = _with(rows, [packed.format(i + 1, BITS, i // BITS) for i in range(0, len(place.flags), BITS)]).drop("_flags")
    if "about" in w:
        about = files.select("file_id", *(F.coalesce(c, F.lit(False)).alias(f"about_{n}") for n, c in w["about"].items()))
        rows = rows.join(about, "file_id")
    rows = rows.repartition(-(-elements // ELEMENTS_A_TASK) or 1, "file_id")
    if "above" in w or "below" in w:
        rows = _swept(rows, place)
    if "child" in w:
        rows = _children(rows, [place.flag(n) for n in w["child"]])
    by_parent = "(partition by file_id, parent_id order by ord"
    just = f"if(lag(ord) over {by_parent}) = ord - 1, lag(`v_{{0}}`) over {by_parent}), null) as `previous_{{0}}`"
    rows = _with(rows, [just.format(n) for n in w.get("previous", {})] + [f"last(`v_{n}`, true) over {by_parent} rows between unbounded preceding and 1 preceding) as `earlier_{n}`" for n in w.get("earlier", {})])
    of = lambda kind: enumerate(_bits([place.flag(n) for n in w.get(kind, {})]))
    rows = _with(rows, [f"bit_or({bits}) over (partition by file_id, parent_id) as _beside{i}" for i, bits in of("beside")])
    rows = _with(rows, [f"if(grand_id is null, 0L, bit_or({bits}) over (partition by file_id, grand_id)) as _cousin{i}" for i, bits in of("cousin")])
    for n in w.get("nearest", {}):
        rows = _nearest(rows, n, place.flag(n))
        inner = [(f"within_{k}", made, together) for k, (kind, made, together) in w.get("within", {}).items() if kind == n]
        if inner:
            rows = _with(rows, [f"if({place.flag(n)}, node_id, `nearest_{n}`) as _key"])
            for _, shared in groupby(enumerate(inner), lambda x: -1 if x[1][2] else x[0]):  # one may rest on those before
                rows = rows.select("*", *(made(["file_id", "_key"]).alias(k) for _, (k, made, _) in shared))
            rows = rows.drop("_key")
    if "file" in w:
        whole = Window.partitionBy("file_id")
        rows = rows.select("*", *(c.over(whole).alias(f"file_{n}") for n, c in w["file"].items()))
    if "running" in w:
        order = Window.partitionBy("file_id").orderBy("node_id")
        rows = rows.select("*", *(c.over(order.rowsBetween(Window.unboundedPreceding, upto)).alias(f"running_{n}") for n, (c, upto) in w["running"].items()))
    return _mentions(rows, w)


def _with(rows: DataFrame, more: list[str]) -> DataFrame:
    return rows.selectExpr("*", *more) if more else rows


def _swept(rows: DataFrame, place: Place) -> DataFrame:
    """``above`` as bits, ``below`` as pairs of counts, and how many lie around for what
    ``nearest`` asks. An element without any inside needs no end: nothing is around by it."""
    above, below = list(place.wanted.get("above", {})), list(place.wanted.get("below", {}))
    rows = rows.selectExpr("*", "explode(if(last_id > node_id, array(false, true), array(false))) as _end")
    sweep = "over (partition by file_id order by if(_end, last_id, node_id), _end rows between unbounded preceding and {})"
    upto, before = sweep.format("current row"), sweep.format("1 preceding")
    opened = _pairs([f"bigint(not _end and {place.flag(n)})" for n in below])
    around = _pairs([f"if(last_id > node_id and {place.flag(n)}, if(_end, -1L, 1L), 0L)" for n in above])
    rows = _with(rows, [f"sum({c}) {upto} as _opened{i}" for i, c in enumerate(opened)] + [f"coalesce(sum({c}) {before}, 0L) as _around{i}" for i, c in enumerate(around)])
    rows = _with(rows, [f"coalesce(lead(_opened{i}) over (partition by file_id, node_id order by _end), _opened{i}) - _opened{i} as _below{i}" for i in range(len(opened))]).filter("not _end")
    levels = [f"{_half(above, n, '_around')} as `_level_{n}`" for n in place.wanted.get("nearest", {})]
    rows = _with(rows, [f"{c} as _above{i}" for i, c in enumerate(_bits([f"{_half(above, n, '_around')} > 0" for n in above]))] + levels)
    return rows.drop("_end", *(f"_opened{i}" for i in range(len(opened))), *(f"_around{i}" for i in range(len(around))))


def _children(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Flagged elements are seen once more under their parent's number."""
    rows = rows.selectExpr("*", f"posexplode(if(({' or '.join(flags)}) and parent_id is not null, array(node_id, parent_id), array(node_id))) as (_seen, _under)")
    rows = _with(rows, [f"bit_or(if(_seen = 1, {bits}, 0L)) over (partition by file_id, _under) as _child{i}" for i, bits in enumerate(_bits(flags))])
    return rows.filter("_seen = 0").drop("_seen", "_under")


def _nearest(rows: DataFrame, n: str, flag: str) -> DataFrame:
    level = f"`_level_{n}`"
    rows = rows.selectExpr("*", f"posexplode(if({flag}, array({level}, {level} + 1), array({level}))) as (_seen, _depth)")
    latest = "last(if(_seen = 1, node_id, null), true) over (partition by file_id, _depth order by node_id, _seen rows between unbounded preceding and 1 preceding)"
    return _with(rows, [f"if({level} > 0, {latest}, null) as `nearest_{n}`"]).filter("_seen = 0").drop("_seen", "_depth", f"_level_{n}")


def _mentions(rows: DataFrame, w: dict) -> DataFrame:
    if not {"mentions", "mentioned", "rank"} & set(w):
        return rows.selectExpr("*", "named_struct('kind', 'self') as mention")
    # An element without an id is alone with a token that no id can be.
    itself = F.expr(r"array(named_struct('kind', 'self', 'space', 'id', 'token', coalesce(nullif(id, ''), concat('\u0000', string(node_id))), 'name', ''))")
    made = list(w.get("mentions", {}).items())
    rows = rows.select("*", itself.alias("_m"), *(m.alias(f"_m{i}") for i, (_, (m, _)) in enumerate(made)))
    every = "transform(`_m{0}`, t -> named_struct('kind', '{1}', 'space', '{2}', 'token', t.token, 'name', t.name))"
    rows = rows.selectExpr("*", "explode(concat(" + ", ".join(["_m", *(every.format(i, kind, space) for i, (kind, (_, space)) in enumerate(made))]) + ")) as mention").drop("_m", *(f"_m{i}" for i in range(len(made))))
    same = "partition by file_id, mention.space, mention.token"
    if "rank" in w:
        order = f"({same}, mention.kind order by node_id)"
        rows = _with(rows, [f"row_number() over {order} as rank_all", f"first(line) over {order} as first_line"])
    some = Window.partitionBy("file_id", "mention.space", "mention.token")
    more = []
    for n, (kind, c) in w.get("mentioned", {}).items():
        own = F.expr(f"mention.kind = '{kind}'")
        more.append(F.max(F.coalesce(own if c is None else own & c, F.lit(False))).over(some).alias(f"mentioned_{n}"))
    return rows.select("*", *more) if more else rows
