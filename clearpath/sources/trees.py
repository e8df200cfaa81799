"""Text files of a project folder as a Spark data source that heeds ignore files.

    spark.dataSource.register(ProjectFiles)
    spark.read.format("project_files").option("root", uri).load()    -- path, source

An ignore file's patterns hold for its folder and those below: ``name`` at any depth,
``/name`` in that folder only, ``name/`` for folders, ``*``, ``?`` and ``**``, ``!name`` to
take back; the last one that matches decides, nearer folders after farther ones. A folder
that is passed over is neither listed nor read, so nothing in it can be taken back.

The driver lists the first ``levels`` of folders (two by default); every folder below them, with the patterns that
it inherits, is a partition, which a task walks and reads by itself. With ``paths`` (lines) only the
named files are opened, whatever is ignored, but for dependencies and version control.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .diffs import IGNORED

IGNORE_FILES = (".gitignore", ".ignore")
NEVER = {"node_modules", ".git"}


def pattern(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression on the path below the file's folder, for folders only, takes back)."""
    line = line.rstrip("\n").strip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line.removeprefix("!")
    folder = line.endswith("/")
    body = line.strip("/")
    anchored = "/" in line.rstrip("/")
    out = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body))
    return (r"\A" if anchored else r"(?:\A|/)") + out + r"\Z", folder, back


@dataclass
class Folder(InputPartition):
    path: str  # below the root, with a slash behind it
    rules: list[tuple[str, str, bool, bool]]  # folder of the ignore file, and its patterns
    files: list[str] | None = None  # None: the whole tree below


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/")
        self.names = set(options["ignored"].split(",")) if "ignored" in options else set(IGNORED)
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.levels = int(options.get("levels", "2"))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def _passed(self, path: str, is_folder: bool, rules) -> bool:
        off = False
        for base, expression, folder, back in rules:
            if (is_folder or not folder) and re.search(expression, path[len(base) :]):
                off = not back
        return off

    def _listed(self, system, root: str, path: str, rules) -> tuple[list[str], list[str], list]:
        """Kept files and folders of one folder, and the patterns that hold in it."""
        found = system.get_file_info(fs.FileSelector(f"{root}/{path}".rstrip("/")))
        for info in sorted((i for i in found if i.base_name in IGNORE_FILES), key=lambda i: i.base_name):
            with system.open_input_stream(info.path) as f:
                lines = f.read().decode("utf-8", "replace").splitlines()
            rules = rules + [(path, *p) for p in map(pattern, lines) if p]
        files, folders = [], []
        for info in sorted(found, key=lambda i: i.base_name):
            own, folder = path + info.base_name, info.type == fs.FileType.Directory
            if info.base_name not in self.names and not self._passed(own, folder, rules) and info.base_name not in IGNORE_FILES:
                (folders if folder else files).append(own)
        return files, [f + "/" for f in folders], rules

    def partitions(self) -> list[Folder]:
        if self.paths:
            own = sorted({p for p in self.paths if not NEVER & set(p.split("/"))})
            return [Folder("", [], own[i : i + 100]) for i in range(0, len(own), 100)]
        system, root = self._open()
        out, now = [], [("", [])]
        for _ in range(self.levels):
            below = []
            for path, rules in now:
                files, folders, rules = self._listed(system, root, path, rules)
                out.append(Folder(path, rules, files))
                below += [(f, rules) for f in folders]
            now = below
        return out + [Folder(path, rules) for path, rules in now]

    def read(self, partition: Folder):
        system, root = self._open()
        todo, files = [], partition.files
        if files is None:
            todo, files = [(partition.path, partition.rules)], []
        while todo or files:
            for path in files:
                if self.paths and system.get_file_info(f"{root}/{path}").type != fs.FileType.File:
                    continue  # a named file that is not there
                with system.open_input_stream(f"{root}/{path}") as f:
                    yield path, f.read().decode("utf-8", "replace")
            files = []
            if todo:
                path, rules = todo.pop()
                files, folders, rules = self._listed(system, root, path, rules)
                todo += [(f, rules) for f in folders]


class ProjectFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return "path string, source string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def scan_tree(spark: SparkSession, root: str, paths: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """file_id, path and source of a folder's files, or of the named ones alone."""
    spark.dataSource.register(ProjectFiles)
    read = spark.read.format("project_files").option("root", root)
    if ignored is not None:
        read = read.option("ignored", ",".join(ignored))
    if paths is not None:
        read = read.option("paths", "\n".join(paths) or "\n")
    rows = read.load()
    rows = rows.filter("false") if paths is not None and not paths else rows
    return rows.select(F.xxhash64("path").alias("file_id"), "path", "source")
