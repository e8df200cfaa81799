from clearpath.operators.finders import lines
from clearpath.operators.registry import run_rules
from clearpath.operators.scripts import dom_actions
from clearpath.plans.audit import tables
from clearpath.sources.scripts import tokens, uncommented


def kinds(source):
    return [(k, t) for _, _, k, t in tokens(source)]


def test_tokens():
    assert kinds("a = b / c; // x\n/* y */ `t ${a + '}'} u` / 2") == [
        ("name", "a"), ("sign", "="), ("name", "b"), ("sign", "/"), ("name", "c"), ("sign", ";"), ("comment", "// x"), ("comment", "/* y */"), ("template", "t "), ("name", "a"), ("sign", "+"), ("string", "}"), ("template", " u"), ("sign", "/"), ("number", "2"),
    ]
    assert ("regex", "/[/'\"]+/g") in kinds("return /[/'\"]+/g.test(x)")
    assert ("string", "cut") in [(k, t.strip("'")) for k, t in kinds("x = 'cut\ny = 1")]
    assert kinds("") == [] and kinds("`open ${") == [("template", "open ")]
    deep = "{" * 20_000 + "}" * 20_000
    assert len(kinds(deep)) == 40_000


def test_comments_and_prose_are_blank():
    source = "go('click'); // el.innerHTML = 1\nsay('el.innerHTML = 2');/* a\nb */x.innerHTML = `<b>`"
    assert uncommented(source) == "go('click');                     \nsay(                    );    \n    x.innerHTML =      " or "innerHTML = 1" not in uncommented(source) and "innerHTML = 2" not in uncommented(source)
    assert "x.innerHTML =" in uncommented(source) and "'click'" in uncommented(source) and uncommented(source).count("\n") == 2


JS = """
const b = document.getElementById('save');
// document.getElementById('comment').onclick = f;
const s = "document.getElementById('string').onclick = f";
function one() { const b = document.querySelector('.inner'); b.addEventListener('keydown', f); { b.onclick = g } }
function two() { b.onclick = g; }
b.textContent = 'x';
document.querySelector('#direct')?.addEventListener("click", f);
a.b.onclick = h;
late.onclick = f; const late = document.getElementById('late');
"""


def test_bindings_follow_scopes(spark):
    rows = [(1, "a.js", JS), (2, "p.html", "<p>x</p>\n<script>\nlet q = document.getElementById('q')\nq.onclick = f</script><!-- <script>document.getElementById('z').onclick = f</script> -->"), (3, "n.js", None)]
    with tables(spark.createDataFrame(rows, "file_id long, path string, source string")) as t:
        got = sorted((r.file_id, r.line, r.kind, r.token, r.what, r.detail) for r in dom_actions(t).collect())
    assert got == [
        (1, 5, "class", "inner", "event", "click"), (1, 5, "class", "inner", "event", "keydown"), (1, 6, "id", "save", "event", "click"), (1, 7, "id", "save", "text", "textContent"), (1, 8, "id", "direct", "event", "click"), (2, 4, "id", "q", "event", "click"),
    ]


def test_projects_do_not_meet(spark):
    rows = [(1, "a.js", "const b = document.getElementById('go'); b.onclick = f", "one"), (2, "a.html", '<div id="go">x</div>', "one"), (3, "b.html", '<div id="go">x</div>', "two")]
    files = spark.createDataFrame(rows, "file_id long, path string, source string, project string")
    with tables(files) as t:
        got = sorted((r.file_id, r.rule_id) for r in run_rules(t, ["keyboard/interactive-div-role-missing", "keyboard/handler-missing"]).collect())
    assert got == [(1, "keyboard/handler-missing"), (2, "keyboard/interactive-div-role-missing")]
    with tables(files.drop("project")) as t:
        assert run_rules(t, ["keyboard/interactive-div-role-missing"]).count() == 2


def test_lines_of_code(spark):
    rows = [(1, "a.js", "// x.innerHTML = 1\ny.innerHTML = 2"), (2, "a.html", "<!-- a.innerHTML = b -->\n<script>// a.innerHTML = b\nc.innerHTML = d</script>")]
    with tables(spark.createDataFrame(rows, "file_id long, path string, source string")) as t:
        assert sorted((r.file_id, r.line) for r in lines(t, r"\.innerHTML\s*=").collect()) == [(1, 2), (2, 3)]
