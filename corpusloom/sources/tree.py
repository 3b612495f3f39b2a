"""A source tree as a table, read by a Python data source whose tasks share out large folders."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.sources.config import ProjectConfig
from corpusloom.sources.ignore import IgnoreRules

IGNORE_FILES = (".gitignore", ".corpusignore", ".cplignore")
SCHEMA = "path string, size_bytes long, modified_unix long, sha256 string, text string"


def rules_for(root: str) -> IgnoreRules:
    lines: list[str] = []
    for f in IGNORE_FILES:
        try:
            with open(os.path.join(root, f), encoding="utf-8", errors="replace") as fh:
                lines += fh.read().splitlines()
        except OSError:
            pass
    return IgnoreRules.of([*lines, *ProjectConfig.load(os.path.join(root, "corpusloom.toml")).ignore_paths])


def guarded(root: str, path: str) -> str:
    """The real path below ``root``; an error for one outside it."""
    real, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.commonpath([real, top]) != top:
        raise ValueError(f"{path} is outside {root}")
    return real


#: Files that a task reads of one folder, about, and tasks from which folders are left whole.
FILES_A_TASK, ENOUGH_TASKS = 256, 256


class _Part(InputPartition):
    """The files of a folder whose name's hash is ``part`` of ``parts``, or with ``parts`` 0 the whole tree below it."""

    def __init__(self, rel: str, part: int = 0, parts: int = 0):
        self.rel, self.part, self.parts = rel, part, parts


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, expression: str, content: bool):
        self.root, self.rules, self.content = root, IgnoreRules(expression), content

    def listed(self, rel: str) -> Iterator[tuple[str, bool]]:
        """(path, whether it is a folder) of what no rule leaves out, links apart; nothing of a folder that is gone or closed."""
        try:
            with os.scandir(os.path.join(self.root, rel)) as entries:
                for e in entries:
                    path = f"{rel}/{e.name}" if rel else e.name
                    if not e.is_symlink() and not self.rules.ignores(path):
                        yield path, e.is_dir(follow_symlinks=False)
        except OSError:
            return

    def partitions(self):
        """Folders level by level until there are tasks enough; names of files aren't kept, so the driver's part stays small."""
        out: list[_Part] = []
        level = [""]
        while level:
            if len(out) + len(level) > ENOUGH_TASKS:
                return out + [_Part(rel) for rel in level]
            below = []
            for rel in level:
                files = 0
                for path, folder in self.listed(rel):
                    if folder:
                        below.append(path)
                    else:
                        files += 1
                parts = -(-files // FILES_A_TASK)
                out += [_Part(rel, k, parts) for k in range(parts)]
            level = sorted(below)
        return out or [_Part("", 0, 1)]

    def read(self, partition) -> Iterator[tuple]:
        folders = [partition.rel]
        while folders:
            rel = folders.pop()
            files = []
            for path, folder in self.listed(rel):
                if folder and not partition.parts:
                    folders.append(path)
                elif not folder and (not partition.parts or zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.parts == partition.part):
                    files.append(path)
            yield from filter(None, map(self.row, sorted(files)))

    def row(self, rel: str) -> tuple | None:
        """A file's row, null for one that is gone; of one that can't be read text and hash are null."""
        path = os.path.join(self.root, rel)
        data = text = None
        try:
            stat = os.stat(path)
        except OSError:
            return None
        try:
            if self.content:
                with open(path, "rb") as f:
                    data = f.read()
                text = data.decode()
        except FileNotFoundError:
            return None
        except (OSError, UnicodeDecodeError):
            pass
        return rel, stat.st_size, int(stat.st_mtime), hashlib.sha256(data).hexdigest() if data is not None else None, text


class TreeSource(DataSource):
    """Options: ``path``, ``ignore`` (an expression), ``content`` (read and hash files)."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], self.options["ignore"], self.options.get("content", "true") == "true")


def read_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, size_bytes, modified_unix, sha256, text) of the files below ``root`` that no rule leaves out.

    Symbolic links aren't followed.  Text that isn't UTF-8 is null.  Every executor must see ``root``.
    """
    root = os.path.abspath(root)
    spark.dataSource.register(TreeSource)
    return spark.read.format("corpusloom_tree").option("path", root).option("ignore", rules_for(root).expression).option("content", str(content).lower()).load()
