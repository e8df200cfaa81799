"""Pages as a table of elements.

A tolerant reader turns each page's source into one row an element; everything after
that is DataFrame work. Spark partitions the pages; a task reads one page at a time.
An unclosed element stays open to the end of what holds it; a closing tag closes the
innermost open element (elements whose end may be left out give way) and is ignored if
that has another name; raw-text elements hide their content from the reader, and what
stands in code and pre elements is text, tags and all, as pages show examples there. A second
output of the reader is what it had to get over (``read_errors``). Elements
nest ``DEPTH`` deep, as in browsers, so a page's rows grow with its size, not with its square;
``depth=None`` keeps every level, at the price of long lists of ancestors.
"""

from __future__ import annotations

import bisect
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialects import markup
from .lines import line_finder

# HTML's void and raw-text elements, and which open elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}} | {t: {"table"} for t in ("tr", "td", "th", "tbody", "tfoot")}
OPAQUE = frozenset(("code", "pre"))
#: Elements that no one misses the end of, besides those below.
OUTER = frozenset(("html", "head", "body"))
END_MAY_MISS = frozenset("li dt dd p option optgroup tr td th thead tbody tfoot".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Elements open at a time, as in browsers: one more becomes a sibling of the innermost.
DEPTH = 512
#: Characters and numbers of a batch of elements.
BATCH_SIZE = 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

NODE_SCHEMA = (
    "file_id long, node_id int, parent_id int, parent_tag string, last_id int, depth int, ord int, tag string, attrs map<string,string>, attr_names array<string>, "
    "ancestors array<int>, text string, start int, stop int, octets int, line int, col int"
)
_NODE = pa.schema([
    ("file_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("parent_tag", pa.string()), ("last_id", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("attr_names", pa.list_(pa.string())), ("ancestors", pa.list_(pa.int32())), ("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("octets", pa.int32()), ("line", pa.int32()), ("col", pa.int32()),
])


def attributes(source: str) -> tuple[dict[str, str], list[str]]:
    """Attributes by lower-case name (the first of equal names counts; no value: empty)
    and all names in order."""
    values, names = {}, []
    for name, *quoted in _ATTRIBUTE.findall(source):
        names.append(name.lower())
        values.setdefault(name.lower(), entities.unescape("".join(quoted)))
    return values, names


def opaque_end(source: str, at: int, tag: str) -> tuple[int, int] | None:
    """Start and stop of the end tag that closes ``tag``, ends of such tags inside apart."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(source, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.start(), m.end()
    return None


def parse(source: str, opaque: bool = True, errors: list | None = None, depth: int | None = DEPTH) -> tuple[list[dict], str]:
    """Elements in document order, and the text of the whole source; an element's text is
    a span of it, or a string of its own. ``errors`` gets (code, place, whether reading
    went on after it)."""
    nodes: list[dict] = []
    told = errors if errors is not None else []
    open_: list[dict] = []
    text: list[str] = []
    length, roots = 0, 0
    counted, octets = 0, 0
    lines = [m.end() for m in re.finditer("\n", source)]
    def say(s: str) -> None:
        nonlocal length
        text.append(s)
        length += len(s)

    def close(upto: int) -> None:
        while len(open_) > upto:
            n = open_.pop()
            n["last_id"], n["text"] = len(nodes) - 1, (n["text"], length)

    at = 0
    while m := _TOKEN.search(source, at):
        say(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                told.append(("unterminated-comment", m.start(), False))
            continue
        tag = m[2].lower()
        if m[1]:
            i = len(open_) - 1
            while i > 0 and open_[i]["tag"] != tag and open_[i]["tag"] in END_MAY_MISS:
                i -= 1
            if i >= 0 and open_[i]["tag"] == tag:
                close(i)
            elif tag not in VOID and tag != "p":  # browsers make a paragraph of </p>
                told.append(("stray-end-tag", m.start(), True))
            continue
        closes = CLOSED_BY.get(tag, {"p"} if tag in ENDS_P else set())
        for i in range(len(open_) - 1, -1, -1):
            if open_[i]["tag"] in closes:
                close(i)
                if tag not in STOPS:
                    break
            elif open_[i]["tag"] in STOPS.get(tag, {"button", "td", "th", "li"}):
                break
        close(len(open_) if depth is None else min(len(open_), depth))
        values, names = attributes(m[3])
        if len(values) < len(names):
            told.append(("duplicate-attribute", m.start(), True))
        parent = open_[-1] if open_ else None
        line = bisect.bisect_right(lines, m.start())
        octets += len(source[counted : m.end()].encode("utf-8", "surrogatepass"))
        counted = m.end()
        node = {
            "node_id": len(nodes), "parent_id": parent["node_id"] if parent else None, "parent_tag": parent["tag"] if parent else None, "last_id": len(nodes), "depth": len(open_), "ord": parent["children"] if parent else roots, "tag": tag, "attrs": values, "attr_names": names,
            "ancestors": [n["node_id"] for n in open_], "text": length, "start": m.start(), "stop": m.end(), "octets": octets, "line": line + 1, "col": m.start() - (lines[line - 1] if line else 0) + 1, "children": 0,
        }
        if parent:
            parent["children"] += 1
        else:
            roots += 1
        nodes.append(node)
        if tag in VOID or m[3].rstrip().endswith("/"):
            node["text"] = (length, length)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(source, at)
            inner = source[at : end.start()]
            if end.start() == end.end():
                told.append(("unterminated-raw-text", m.start(), False))
            node["text"] = inner if tag in ("title", "textarea") else ""
            node["raw"] = inner
            at = end.end()
        elif opaque and tag in OPAQUE:
            end = opaque_end(source, at, tag)
            if end is None:
                told.append(("unterminated-raw-text", m.start(), False))
            stop, behind = end or (len(source), len(source))
            say(entities.unescape(source[at:stop]))
            node["text"], at = (node["text"], length), behind
        else:
            open_.append(node)
    say(entities.unescape(source[at:]))
    told += [("unclosed-element", n["start"], True) for n in open_ if n["tag"] not in END_MAY_MISS | OUTER]
    close(0)
    return nodes, "".join(text)


def own_text(node: dict, whole: str) -> str:
    if node["tag"] in ("style", "script"):
        return node.get("raw", "")
    text = node["text"]
    return whole[slice(*text)].strip() if isinstance(text, tuple) else text


def elements(source: str) -> list[dict]:
    """Elements in document order, each with the text of its whole subtree."""
    nodes, whole = parse(source)
    for n in nodes:
        n["text"] = own_text(n, whole)
    return nodes


def _parse(batches, depth: int | None = DEPTH):
    """Rows of some thousand elements at a time: texts are cut from the page's text, and
    columns made, only as they leave."""
    names, columns, size = _NODE.names, [[] for _ in _NODE.names], 0

    def flush():
        nonlocal columns, size
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)
        columns, size = [[] for _ in names], 0
        return out

    for batch in batches:
        for file_id, source, dialect in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nodes, whole = parse(markup(source or "", dialect), dialect not in ("jsx", "mdx"), None, depth)
            for n in nodes:
                n["text"], n["file_id"], n["attrs"] = own_text(n, whole), file_id, list(n["attrs"].items())
                for column, name in zip(columns, names, strict=True):
                    column.append(n[name])
                size += 200 + len(n["text"]) + 8 * len(n["ancestors"])
                if size >= BATCH_SIZE:
                    yield flush()
    if columns[0]:
        yield flush()


def read_elements(files: DataFrame, depth: int | None = DEPTH) -> DataFrame:
    """``files`` (file_id, source, and maybe dialect) -> elements with what most rules ask
    for: lower-case role, class tokens, id, and the name given by attributes. Null source:
    no element."""
    dialect = F.col("dialect") if "dialect" in files.columns else F.lit("")
    nodes = files.select("file_id", "source", dialect.alias("dialect")).mapInArrow(lambda batches: _parse(batches, depth), NODE_SCHEMA)
    attr = lambda name: F.col("attrs")[name]
    tokens = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    return nodes.withColumns({
        "role": F.lower(F.trim(attr("role"))),
        "classes": tokens(attr("class")),
        "id": attr("id"),
        "given_name": F.coalesce(F.nullif(F.trim(attr("aria-label")), F.lit("")), F.nullif(F.trim(attr("aria-labelledby")), F.lit("")), F.nullif(F.trim(attr("title")), F.lit(""))),
    })


ERRORS = pa.schema([("file_id", pa.int64()), ("code", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("recoverable", pa.bool_())])


def read_errors(files: DataFrame) -> DataFrame:
    """file_id, code, line, col and recoverable of what the reader had to get over: stray end
    tags, elements without their end, attributes given twice (after these it went on as if
    nothing were); comments and raw text without an end (these hide the rest)."""

    def run(batches):
        for batch in batches:
            rows = []
            for file_id, source, dialect in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, errors = markup(source or "", dialect), []
                parse(text, dialect not in ("jsx", "mdx"), errors)
                line_of = line_finder(text)
                rows += [(file_id, code, line_of(at), at - text.rfind("\n", 0, at), on) for code, at, on in errors]
            columns = zip(*rows, strict=True) if rows else [()] * len(ERRORS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ERRORS, strict=True)], schema=ERRORS)

    dialect = F.col("dialect") if "dialect" in files.columns else F.lit("")
    return files.select("file_id", "source", dialect.alias("dialect")).mapInArrow(run, "file_id long, code string, line int, col int, recoverable boolean")
