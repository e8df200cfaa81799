"""Shapes of sources that a rule finds or leaves, beside its minimal pair."""

from pyspark.sql import functions as F

from clearpath.operators.registry import run_rules
from clearpath.plans.audit import tables

#: (rule, extension, source, findings)
SHAPES = [
    ("pointer/target-size", "tsx", "const A = () => <div><button className='w-4 h-4'>x</button><button className='w-[20px]'>y</button><a href='/' className='w-6 h-6'>z</a></div>", 2),
    ("pointer/target-size", "tsx", "const A = () => <p><a href='/' className='h-4'>x</a><button className='w-4 p-2'>y</button><i className='w-1'>z</i></p>", 0),
    ("pointer/target-size-enhanced", "tsx", "const A = () => <div><div role='button' className='w-10'>x</div><button className='w-11'>y</button></div>", 1),
    ("layout/horizontal-scroll-no-keyboard", "css", "textarea { overflow: auto } .x a[href] { overflow-x: scroll } [tabindex='0'] { overflow: auto } .y { overflow-y: auto }", 0),
    ("layout/horizontal-scroll-no-keyboard", "css", "textarea, .box { overflow: auto }", 1),
    ("keyboard/hover-only-no-focus-mirror", "css", ".m:hover .o,\n.m:focus-within .o { opacity: 1 }", 0),
    ("contrast/non-text", "css", "button.a { border: 1px solid #888; background-image: url(x.png) }", 1),
    ("contrast/non-text", "css", "p { border: 1px solid #888; background-image: url(x.png) } button { background-image: url(x.png) }", 0),
    ("aria/expanded-on-disclosure", "tsx", "const A = () => <button onClick={() => m.classList.toggle('open')}>M</button>", 1),
    ("aria/expanded-on-disclosure", "tsx", "const A = () => <button aria-expanded={o} onClick={() => m.classList.toggle('open')}>M</button>", 0),
    ("aria/role-from-class-only", "html", "<div class='note warning'>Run it first.</div><div class='note'>x</div><p class='info'>y</p>", 1),
    ("navigation/link-descriptive-text", "html", "<a href='/'><span class='material-icons'>home</span></a>", 1),
    ("navigation/link-descriptive-text", "html", "<a href='/'><span class='material-icons' aria-hidden='true'>home</span> Start page</a><a href='/x' title='y'><i class='material-icons'>x</i></a>", 0),
    ("pointer/drag-alternative", "tsx", "import { D } from '@dnd-kit/core';\nconst A = () => <D><div>x</div></D>", 1),
    ("pointer/drag-alternative", "tsx", "import { D } from '@dnd-kit/core';\nconst A = () => <D><button>Up</button></D>", 0),
    ("media/alt-text-missing", "html", "<svg><image href='a.svg'/></svg>", 1),
    ("media/alt-text-missing", "html", "<svg><title>Logo</title><image href='a.svg'/></svg><svg aria-label='x'><image/></svg><svg><path/></svg>", 0),
    ("aria/icon-font-hidden", "html", "<p><i class='fa fa-x'></i><span class='sr-only'>Close</span></p>", 0),
    ("semantics/landmark-main", "html", "<html lang='en'><body><nav>x</nav><main>a</main><main>b</main></body></html>", 1),
    ("semantics/nested-interactive", "html", "<div>" * 400 + "<a href='/x'><button>y</button></a>", 1),
]


def test_shapes(spark):
    rows = [(i, f"{i}.{ext}", source) for i, (_, ext, source, _) in enumerate(SHAPES)]
    with tables(spark.createDataFrame(rows, "file_id long, path string, source string")) as t:
        got = {(r.file_id, r.rule_id): r.n for r in run_rules(t, sorted({s[0] for s in SHAPES})).groupBy("file_id", "rule_id").agg(F.count("*").alias("n")).collect()}
    wrong = [(s, got.get((i, s[0]), 0)) for i, s in enumerate(SHAPES) if got.get((i, s[0]), 0) != s[3]]
    assert not wrong


def test_every_level_counts_if_asked(spark):
    deep = "<a href='/x'>" + "<div>" * 2000 + "<button>y</button>"
    files = spark.createDataFrame([(1, "a.html", deep)], "file_id long, path string, source string")
    for depth, n in ((None, 1), (512, 1)):
        with tables(files, depth) as t:
            assert run_rules(t, ["semantics/nested-interactive"]).count() == n
