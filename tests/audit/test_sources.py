import time

import pyarrow as pa

from clearpath.operators.registry import run_rules
from clearpath.plans.audit import tables
from clearpath.sources.css import declarations
from clearpath.sources.dialects import markup, sheet
from clearpath.sources.html import DEPTH, _parse, elements

JSX = """import X from "x";
// <b>no</b>
const a = 1 < 2 && b > 3, s = "<i>no</i>";
export default function F({items}) {
  return (
    <div className="card" onClick={() => go("x")} tabIndex={2}>
      {items.map(i => <Item key={i} {...i}><img src={i.src} /></Item>)}
      {ok ? <button aria-label='Close'>×</button> : null}
      <label htmlFor="a">Name</label><>x</><Img alt={"A door"}></Img>
    </div>
  );
}"""


def test_jsx():
    got = [(n["tag"], n["line"]) for n in elements(markup(JSX, "jsx"))]
    assert got == [("div", 6), ("x-item", 7), ("img", 7), ("button", 8), ("label", 9), ("x-img", 9)]
    by = {n["tag"]: n["attrs"] for n in elements(markup(JSX, "jsx"))}
    assert by["div"] == {"class": "card", "onclick": "{() =  go( x )}", "tabindex": "2"}
    assert by["img"] == {"src": "{i.src}"} and by["label"] == {"for": "a"} and by["x-img"] == {"alt": "A door"}


def test_templates_and_text():
    tags = lambda s, d: [(n["tag"], n["line"]) for n in elements(markup(s, d))]
    assert tags("---\nlayout: x\n---\n```html\n<img>\n```\n`<b>`\n<p>x</p>", "markdown") == [("p", 8)]
    assert tags("import A from 'a'\n\n# T {1 < 2}\n<A x={1}/>\n<p>{y}</p>", "mdx") == [("x-a", 4), ("p", 5)]
    assert tags("---\nconst a = '<b>'\n---\n<p class={x}>{y.map(z => <i>z</i>)}</p>", "astro") == [("p", 4), ("i", 4)]
    assert tags('<p><?php echo "<b>"; ?>x</p>', "php") == [("p", 1)] and tags("<% if x %>\n<p>", "erb") == [("p", 2)]


def test_nested_sheets():
    scss = "$c: #777; // brand\n.card { color: $c;\n  &:hover { background: #fff }\n  .t, .u { font-size: 12px;\n    @media (min-width: 1px) { width: 900px } }\n}\n@mixin m { color: red }\n"
    assert [d[1:6] for d in declarations(sheet(scss, "scss"))] == [
        (".card", [], 2, "color", "#777"), (".card:hover", [], 3, "background", "#fff"), (".card .t, .card .u", [], 4, "font-size", "12px"), (".card .t, .card .u", ["@media (min-width: 1px)"], 5, "width", "900px"),
    ]
    assert [d[1:6] for d in declarations(sheet("@c: #123;\n.m() { top: 0 }\n.a { .b { color: @c } }", "less"))] == [(".a .b", [], 3, "color", "#123")]


def test_large_sources_stay_linear():
    began = time.process_time()
    assert len(declarations("a { color: red;\n background: blue }\n" * 30_000)) == 60_000
    assert time.process_time() - began < 10
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["<b>x "] * 1).take(pa.array([0])), pa.array([""])], names=["a", "b", "c"])
    assert sum(map(len, _parse([batch]))) == 1
    nodes = elements("<b>" * 3000)
    assert len(nodes) == 3000 and max(len(n["ancestors"]) for n in nodes) == DEPTH


def test_rules_over_dialects(spark):
    files = [
        (1, "a.scss", "$c: #777;\np { color: $c; background: #fff }"), (2, "b.html", "<html>\n<style>\np { color: #777;\n background: #fff }</style></html>"), (3, "c.tsx", JSX), (4, "d.md", "```\n<img>\n```\n<img src='x'>"),
        (5, "e.less", None), (6, "f.bin", "<img>"), (7, "g.mdx", ""),
    ]
    got = run_rules(tables(spark.createDataFrame(files, "file_id long, path string, source string")), ["contrast/minimum", "media/alt-text-missing", "focus/tabindex-positive"])
    assert sorted((r.file_id, r.line, r.rule_id) for r in got.collect()) == [(1, 2, "contrast/minimum"), (2, 3, "contrast/minimum"), (3, 6, "focus/tabindex-positive"), (3, 7, "media/alt-text-missing"), (4, 4, "media/alt-text-missing")]


def test_inline_markup_of_any_length(spark):
    from clearpath.sources.fragments import inline_markup

    long = "x" * 300_000 + "\\`" + "<b>y</b>" + "z\\\\" * 100_000
    rows = [(1, "a.js", f"const a = `{long}`;\nconst b = '<i>q</i>' + \"no markup\" + \"a < b\";\nconst c = 'cut\n';"), (2, "b.js", None), (3, "c.html", "`<b>`"), (4, "d.ts", 'const e = "<a href=\\"/x\\">t</a>";')]
    got = sorted((r.file_id, r.first_line, r.source) for r in inline_markup(spark.createDataFrame(rows, "file_id long, path string, source string")).collect())
    assert got == [(1, 1, long), (1, 2, "<i>q</i>"), (4, 1, '<a href=\\"/x\\">t</a>')]


def test_examples_are_text_and_errors_are_rows(spark):
    from clearpath.sources.html import elements, read_errors

    tags = lambda x: [n["tag"] for n in elements(x)]
    assert tags("<pre><code><a href=/x>y</a></code></pre><b>z</b>") == ["pre", "b"]
    assert elements("<code>a &lt; <i>b</code>c")[0]["text"] == "a < <i>b"
    assert elements("<p>x <code>y <b>z</b></code></p>")[0]["text"] == "x y <b>z</b>"
    assert tags("<pre><preview><pre></pre>x</pre><i>y</i>") == ["pre", "i"] and tags("<code><b>") == ["code"]
    rows = [(1, "<ul><li>a<li>b</ul><p>c<table><tr><td>d</table>"), (2, "<b>\n</i><a x=1 x=2>"), (3, "<p>\n<!-- "), (4, "<title>x"), (5, None), (6, "<html><body>")]
    got = sorted((r.file_id, r.code, r.line, r.col, r.recoverable) for r in read_errors(spark.createDataFrame(rows, "file_id long, source string")).collect())
    assert got == [
        (2, "duplicate-attribute", 2, 5, True), (2, "stray-end-tag", 2, 1, True), (2, "unclosed-element", 1, 1, True), (2, "unclosed-element", 2, 5, True), (3, "unterminated-comment", 2, 1, False), (4, "unterminated-raw-text", 1, 1, False),
    ]


def test_marks_in_strings_switch_nothing_off():
    from clearpath.operators.findings import pragma_lines

    mark = "a11y-disable-line r/x"
    assert pragma_lines(f"// {mark}\nx('{mark}')\n`{mark}`\n/* {mark} */", "ts") == [(1, "r/x"), (4, "r/x")]
    assert pragma_lines(f"<p>{{/* {mark} */}}</p>\n<p>{mark}</p>", "tsx") == [(1, "r/x")]
    assert pragma_lines(f"<!-- {mark} -->\n<p title='{mark}'>{mark}</p>\n{{# {mark} #}}") == [(1, "r/x"), (3, "r/x")]
    assert pragma_lines(f"/* {mark} */\na {{ content: '{mark}' }}\n// {mark}", "scss") == [(1, "r/x"), (3, "r/x")]


def test_mixins():
    from clearpath.sources.css import declarations
    from clearpath.sources.dialects import sheet

    scss = "$c: #777;\n@mixin ink($front, $back: #fff) { color: $front;\n background: $back }\n@mixin all { @include ink(red); outline: none }\na { @include ink($c);\n margin: 0; @include gone; }\nb { @include all; i { @include ink($back: #000, $front: blue); } }\n@mixin loop { @include loop; top: 0 }\nu { @include loop; }"
    got = [(d[1], d[4], d[5], d[3]) for d in declarations(sheet(scss, "scss"))]
    assert got[:3] == [("a", "color", "#777", 5), ("a", "background", "#fff", 5), ("a", "margin", "0", 6)]
    assert [g[:3] for g in got[3:8]] == [("b", "color", "red"), ("b", "background", "#fff"), ("b", "outline", "none"), ("b i", "color", "blue"), ("b i", "background", "#000")]
    less = ".ink(@f; @b: #fff) { color: @f; background: @b }\n.x { .ink(#888); width: 2px }\n.y { .none(); }"
    assert [(d[1], d[4], d[5], d[3]) for d in declarations(sheet(less, "less"))] == [(".x", "color", "#888", 2), (".x", "background", "#fff", 2), (".x", "width", "2px", 2)]
