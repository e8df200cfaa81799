import re

import pytest
from pyspark.sql import functions as F

from clearpath.operators.registry import RULES, run_rules
from clearpath.plans.audit import tables
from clearpath.plans.cases import CASES


@pytest.fixture(scope="module")
def parsed(spark):
    ids = sorted(CASES)
    rows = [(2 * i + k, f"{'good' if k else 'bad'}{i}.{CASES[r][0]}", CASES[r][3 if k else 1]) for i, r in enumerate(ids) for k in (0, 1)]
    return ids, tables(spark.createDataFrame(rows, "file_id long, path string, source string"))


def test_every_rule_has_a_pair():
    assert set(CASES) == set(RULES)


def test_minimal_pairs(parsed):
    ids, t = parsed
    wrong = []
    single = [r for r in ids if RULES[r].element is not None]
    for group in [single, [r for r in ids if r not in single]]:
        got = {(x.file_id, x.rule_id): x.n for x in run_rules(t, group).groupBy("file_id", "rule_id").agg(F.count("*").alias("n")).collect()}
        for r in group:
            i = ids.index(r)
            if got.get((2 * i, r), 0) != CASES[r][2] or got.get((2 * i + 1, r), 0):
                wrong.append((r, got.get((2 * i, r), 0), CASES[r][2], got.get((2 * i + 1, r), 0)))
    assert not wrong


def test_a_fact_has_one_meaning(spark):
    """Rules share facts by name: whoever asks for one must mean the same."""
    from clearpath.operators import tree

    seen, clashes = {}, []

    class Watched(tree.Place):
        def _note(self, kind, name, meaning):
            meaning = re.sub(r"x_\d+", "x", meaning)  # parameters of lambdas are numbered
            if seen.setdefault((kind, name), meaning) != meaning:
                clashes.append((kind, name, seen[kind, name], meaning))

        def is_(self, name, condition):
            self._note("is", name, str(condition))
            return super().is_(name, condition)

        def value(self, name, value):
            self._note("value", name, str(value))
            return super().value(name, value)

        def previous(self, name, value):
            self._note("value", name, str(value))
            return super().previous(name, value)

        def earlier(self, name, value):
            self._note("value", name, str(value))
            return super().earlier(name, value)

        def _want(self, kind, name, how=None, sql="{}"):
            if kind not in ("within", "rank"):
                self._note(kind, name, str(how))
            return super()._want(kind, name, how, sql)

    place = Watched()
    for r in RULES.values():
        if r.place:
            r.place(place)
    assert seen and not clashes


def test_crashing_rules_stand_beside_sound_ones(spark):
    from clearpath.operators import registry

    def crashes_in_task(rows):
        raise ValueError("no")

    def long_texts(rows):
        return ["Long." if len(x) > 3 else None for x in rows["text"]]

    before = dict(RULES)
    try:
        registry.element_rule("mine/no-column", "1.1.1", "error", lambda: F.col("no_such_column") > 1, "x")
        registry.place_rule("mine/no-place", "1.1.1", "error")(lambda p: [registry.Hit(p.above("mine", F.col("nor_this")), "x")])
        registry.rule("mine/raises", "1.1.1", "error")(lambda t: 1 / 0)
        registry.python_rule("mine/in-task", "1.1.1", "error")(crashes_in_task)
        registry.python_rule("mine/long", "1.1.1", "info")(long_texts)
        files = spark.createDataFrame([(1, "a.html", "<p>ab</p><p>abcde</p>"), (2, "b.html", "<img>")], "file_id long, path string, source string")
        with tables(files) as t:
            ids = ["mine/no-column", "mine/no-place", "mine/raises", "mine/in-task", "mine/long", "media/alt-text-missing", "semantics/list-structure"]
            got = sorted((r.file_id, r.rule_id, r.message) for r in registry.run_isolated(t, ids).collect())
        crash = lambda f, r, e: (f, registry.CRASH, f"{r} failed: {e}")
        crashes = [("mine/no-column", "AnalysisException"), ("mine/no-place", "AnalysisException"), ("mine/raises", "ZeroDivisionError"), ("mine/in-task", "ValueError")]
        assert got == sorted([crash(f, r, e) for f in (1, 2) for r, e in crashes] + [(1, "mine/long", "Long."), (2, "media/alt-text-missing", "An image has no text alternative.")])
        with pytest.raises(ZeroDivisionError):
            registry.run_rules(t, ["mine/raises"])
    finally:
        RULES.clear()
        RULES.update(before)


def test_tasks_of_places_grow_with_elements(spark, monkeypatch):
    """A task's memory is that of so many elements, however many pages there are."""
    from clearpath.operators import tree

    monkeypatch.setattr(tree, "ELEMENTS_A_TASK", 10)
    for n in (5, 50):
        with tables(spark.range(n).selectExpr("id as file_id", "concat(id, '.html') as path", "'<p id=a></p><p id=a></p>' as source")) as t:
            place = tree.Place()
            place.rank()
            place.is_("any", F.col("id") != "")
            assert tree.placed(t.nodes, t.files, place, t.elements()).rdd.getNumPartitions() == 2 * n // 10
            assert run_rules(t, ["parsing/duplicate-id"]).select("file_id").distinct().count() == n


def test_rows_of_places_stay_narrow(spark):
    """Facts that hold or not are bits and counts are pairs, so windows copy a few columns however many facts there are."""
    from clearpath.operators import tree

    names = [f"x{i}" for i in range(130)]
    # Each element stands in the one before; every third has a sibling of its kind after it, which has nothing inside.
    source = "".join(f"<{n}>" for n in names) + "".join(f"</{n}>" + (f"<{n}></{n}>" if i % 3 == 0 else "") for i, n in reversed(list(enumerate(names))))
    with tables(spark.createDataFrame([(1, "a.html", source), (2, "b.html", "<x7><x8></x8><x8></x8></x7>")], "file_id long, path string, source string")) as t:
        place, facts = tree.Place(), {}
        for n in names:
            is_ = F.col("tag") == n
            facts |= {f"is {n}": place.is_(n, is_), f"above {n}": place.above(n, is_), f"below {n}": place.below(n, is_), f"child {n}": place.child(n, is_), f"beside {n}": place.beside(n, is_), f"cousin {n}": place.cousin(n, is_)}
        rows = tree.placed(t.nodes, t.files, place, t.elements())
        assert len(rows.columns) < 100
        values = list(facts.values())
        got = {(r.file_id, r.node_id): r for r in rows.select("file_id", "node_id", "parent_id", "tag", *(c.cast("int").alias(n) for n, c in zip(facts, values))).collect()}
    def chain(r):
        while r.parent_id is not None:
            r = got[r.file_id, r.parent_id]
            yield r
    around = {k: list(chain(r)) for k, r in got.items()}
    assert len(got) == 130 + 44 + 3
    for k, r in got.items():
        mine = [s for j, s in got.items() if j[0] == k[0]]
        up = r.parent_id
        over = None if up is None else got[k[0], up].parent_id
        for n in names:
            alike = [s for s in mine if s.tag == n]
            want = (r.tag == n, any(a.tag == n for a in around[k]), sum(r in around[s.file_id, s.node_id] for s in alike), any(s.parent_id == k[1] for s in alike), any(s.parent_id == up for s in alike))
            want += (over is not None and any(s.parent_id is not None and got[k[0], s.parent_id].parent_id == over for s in alike),)
            assert tuple(r[f"{f} {n}"] for f in ("is", "above", "below", "child", "beside", "cousin")) == tuple(map(int, want)), (k, n)
