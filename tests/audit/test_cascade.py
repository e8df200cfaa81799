from clearpath.operators.cascade import cascaded, computed, selectors, text_contrast
from clearpath.plans.audit import tables

PAGE = """<html><head><link rel="stylesheet" href="../css/a.css?v=1"><style>
p { color: #111 } .x p { color: #222 } #i > p { color: #333 } #i p.k { color: #444 } p { color: #555 !important }
div > b { color: #666 } section div b { color: #777 } [data-a="1"] { color: #888 } a:hover { color: red }
@media print { i { color: red } }
</style></head><body class="x"><p>1</p><div id="i"><p class="k">2</p><span><p>3</p></span></div>
<section><div><b>4</b><em><b>5</b></em></div></section><i data-a="1">6</i><i style="color: #999" data-a="1">7</i><u>8</u></body></html>"""


def styles(spark, rows, properties=("color",)):
    t = tables(spark.createDataFrame(rows, "file_id long, path string, source string"))
    return t, {(r.file_id, r.node_id, r.property): r.value for r in cascaded(t, list(properties)).collect()}


def test_winners(spark):
    t, got = styles(spark, [(1, "site/pages/p.html", PAGE), (2, "site/css/a.css", "u { color: #abc } p { color: #000 }"), (3, "other/css/a.css", "u { color: red }")])
    by_text = {r.text: r.node_id for r in t.nodes.filter("file_id = 1 and tag in ('p', 'b', 'i', 'u')").collect()}
    assert {k: got.get((1, n, "color")) for k, n in by_text.items()} == {"1": "#555", "2": "#555", "3": "#555", "4": "#777", "5": "#777", "6": "#888", "7": "#999", "8": "#abc"}
    assert {r.length for r in selectors(t).collect()} == {1, 2, 3}
    with t:
        pass


def test_chains_need_their_combinators(spark):
    css = "<style>a > b c { color: red } d e > c { color: blue }</style>"
    body = "<a><b><x><c>1</c></x></b></a><a><x><b><c>2</c></b></x></a><d><x><e><c>3</c></e></x></d><d><e><x><c>4</c></x></e></d>"
    t, got = styles(spark, [(1, "p.html", css + body)])
    by_text = {r.text: r.node_id for r in t.nodes.filter("tag = 'c'").collect()}
    assert {k: got.get((1, n, "color")) for k, n in by_text.items()} == {"1": "red", "2": None, "3": "blue", "4": None}
    t.__exit__()


def test_inheritance_and_contrast(spark):
    page = "<style>body { color: #777; background: #fff } .big { font-size: 24px } .none { background: transparent } .own { background-color: #000 }</style><body><div class='none'><p>a</p><p class='big'>b</p><h2 class='own'>c <i>d</i></h2></div></body>"
    t = tables(spark.createDataFrame([(1, "p.html", page), (2, "n.html", None), (3, "m.html", "<p>x</p>")], "file_id long, path string, source string"))
    got = {(r.line, r.front, r.back, round(r.ratio, 2), r.large) for r in text_contrast(t).collect()}
    assert got == {(1, "#777", "#fff", 4.48, False), (1, "#777", "#fff", 4.48, True), (1, "#777", "#000", 4.69, False)}
    assert {r.at for r in computed(t, ["color"]).filter("property = 'color'").collect()} == {1}
    t.__exit__()


def test_no_side_of_a_join_goes_through_the_driver(spark):
    """However small the persisted tables are when packed, both sides are shuffled."""
    rows = [(i, f"{i}.html", "<style>p { color: #111 } div p { color: #222 }</style><body><div><p>a</p></div></body>") for i in range(50)]
    t = tables(spark.createDataFrame(rows, "file_id long, path string, source string"))
    out = text_contrast(t, 2)
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    t.__exit__()
