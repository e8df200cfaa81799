from clearpath.operators.findings import as_of, in_hunks, merge_co_firing, pragma_lines, suppress
from clearpath.plans.standards import closure, criteria
from clearpath.sources.css import declarations
from clearpath.sources.html import elements
from clearpath.sources.sinks import FORMATS


def test_unclosed_and_implied_ends():
    got = [(n["tag"], n["parent_id"], n["text"]) for n in elements("<ul><li>a<li>b</ul><p>c<div>d <b>e<p>f</div><footer>g")]
    assert got == [("ul", None, "ab"), ("li", 0, "a"), ("li", 0, "b"), ("p", None, "c"), ("div", None, "d efg"), ("b", 4, "efg"), ("p", 5, "f"), ("footer", 5, "g")]


def test_raw_text_places_and_attributes():
    n = elements('<script>var t="</p>";</script>\r\n <A HREF=x href="y" disabled>&amp;</a>')[1]
    assert (n["tag"], n["line"], n["col"], n["text"]) == ("a", 2, 2, "&")
    assert n["attrs"] == {"href": "x", "disabled": ""} and n["attr_names"] == ["href", "href", "disabled"]
    assert elements("") == [] and elements("<<>") == []


def test_declarations():
    got = declarations("/* x */ a, b { color: red !important; top: 0 }\n@media print { p { width: 1px } }")
    assert [(d[1], d[2], d[3], d[4], d[5], d[6]) for d in got] == [("a, b", [], 1, "color", "red", True), ("a, b", [], 1, "top", "0", False), ("p", ["@media print"], 2, "width", "1px", False)]


def test_pragmas():
    source = "<!-- a11y-disable r/one -->\nx\n<!-- a11y-enable -->\ny <!-- a11y-disable-line: all of it -->\n<!-- a11y-disable-next-line r/two -- reason -->\nz"
    assert sorted(pragma_lines(source)) == [(2, "r/one"), (3, "r/one"), (4, "*"), (6, "r/two")]


def test_suppress_and_merge(spark):
    rows = [(1, "p", 2, 1, "a/one", ["1.1.1"]), (1, "p", 2, 1, "a/two", ["2.2.2"]), (1, "p", 3, 1, "a/two", ["2.2.2"])]
    f = spark.createDataFrame(rows, "file_id long, path string, line int, col int, rule_id string, criteria array<string>")
    files = spark.createDataFrame([(1, "p", "<!-- a11y-disable-next-line -->\n\n")], "file_id long, path string, source string")
    assert [r.line for r in suppress(f, files).collect()] == [3]
    got = {(r.line, r.rule_id): r.criteria for r in merge_co_firing(f, [("a/one", "a/two")]).collect()}
    assert got == {(2, "a/one"): ["1.1.1", "2.2.2"], (3, "a/two"): ["2.2.2"]}


def test_range_and_as_of(spark):
    f = spark.createDataFrame([("p", 3), ("p", 9), ("q", 3)], "path string, line int")
    assert in_hunks(f, spark.createDataFrame([("p", 1, 4), ("p", 2, 5)], "path string, start int, stop int")).collect() == [("p", 3)]
    e = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    s = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, t int, v string")
    assert sorted((r.id, r.v) for r in as_of(e, s, ["k"], "t", "t", "v").collect()) == [(1, "y"), (2, None), (3, None)]


def test_standards(spark):
    assert {r["standard_id"]: r["count"] for r in criteria(spark).groupBy("standard_id").count().collect()} == {"wcag22": 86, "wcag21": 78, "section508": 38, "en301549": 50}
    reached = {r.reaches for r in closure(spark).filter("criterion_id = 'section508:1.1.1'").collect()}
    assert reached == {"section508:1.1.1", "wcag21:1.1.1", "wcag22:1.1.1", "en301549:9.1.1.1"}


def test_sinks(spark):
    f = spark.createDataFrame([("p", 1, 2, "r/x", "error", 'a <b> | "c"')], "path string, line int, col int, rule_id string, severity string, message string")
    got = {n: [r.value for r in make(f).collect()] for n, make in FORMATS.items()}
    assert got["plain"] == ['p:1:2 error r/x a <b> | "c"'] and "&lt;b&gt;" in got["junit"][0] and "\\|" in got["markdown"][0]
    assert '"ruleId":"r/x"' in got["sarif"][0] and all(len(v) == 1 for v in got.values())


def test_findings_are_read_once_for_their_criteria(spark):
    """What findings cite joins nothing with the findings again; findings alike but for their criteria share these."""
    from clearpath.plans.standards import cited

    found = spark.range(6).selectExpr("id", "if(id = 4, 'b.html', 'a.html') as path", "1 as line", "1 as col", "'r' as rule_id", "'m' as message", "element_at(array(array('1.1.1'), array('1.4.6', '1.1.1'), array('1.4.6'), array('0.0.0'), array('1.4.6', '0.0.0'), null), int(id) + 1) as criteria")
    got = cited(spark, found, ["wcag22"], "AA")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    both = ["wcag22:1.1.1", "wcag22:1.4.6"]
    assert {r.id: r.cited for r in got.collect()} == {i: both for i in (0, 1, 2, 3, 5)}  # b.html touches a criterion of level AAA only
    assert got.columns == [*found.columns, "cited"]


def test_pairs_of_a_closure_are_dealt_by_number(spark):
    from clearpath.plans.standards import transitive

    reached = transitive(spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 4)], "a int, b int"))
    assert reached.rdd.getNumPartitions() == 1
    assert {tuple(r) for r in reached.select("a", "reaches").collect()} == {(a, b) for g in ((1, 2, 3, 4), (7, 8)) for a in g for b in g}
