import os
import re

from clearpath.sources.trees import pattern, scan_tree


def test_patterns():
    def fits(line, path):
        return bool(re.search(pattern(line)[0], path))

    assert fits("*.log", "a/b/x.log") and not fits("*.log", "a/x.log.txt") and fits("/top.css", "top.css") and not fits("/top.css", "a/top.css")
    assert fits("a/**/z", "a/z") and fits("a/**/z", "a/b/c/z") and fits("x?y", "d/xay") and not fits("x?y", "x/y") and fits("out/", "q/out")
    assert pattern("# note") is None and pattern("  ") is None and pattern("!keep.md")[2] and pattern("out/")[1]


def test_ignored_folders_are_never_read(spark, tmp_path):
    made = {
        "index.html": "<p>ä</p>", ".gitignore": "*.log\n/secret/\nout/\n!keep.log\n", "x.log": "no", "keep.log": "yes", "a/one.html": "1", "a/.gitignore": "one.*\n!deep/one.html\n", "a/b/c/d/two.html": "2", "a/b/one.html": "no", "a/b/c/out/q.html": "no",
        "secret/s.html": "no", "a/secret/t.html": "3", "node_modules/m.js": "no", "bad.html": b"\xff<p>",
    }
    for path, text in made.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{path}"), exist_ok=True)
        with open(f"{tmp_path}/{path}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    os.symlink("/nowhere", f"{tmp_path}/secret/broken.html")  # whoever opens this fails
    os.makedirs(f"{tmp_path}/a/b/c/out/e")
    os.symlink("/nowhere", f"{tmp_path}/a/b/c/out/e/broken.html")
    got = {r.path: r.source for r in scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"index.html": "<p>ä</p>", "keep.log": "yes", "a/b/c/d/two.html": "2", "a/secret/t.html": "3", "bad.html": "�<p>"}
    named = {r.path for r in scan_tree(spark, str(tmp_path), ["x.log", "a/one.html", "node_modules/m.js", "gone.html"]).collect()}
    assert named == {"x.log", "a/one.html"}
    assert scan_tree(spark, str(tmp_path), []).count() == 0
    assert {r.path for r in scan_tree(spark, f"file://{tmp_path}/a", ignored=["b"]).collect()} == {"secret/t.html"}
