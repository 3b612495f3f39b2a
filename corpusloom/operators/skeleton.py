"""The skeleton of a project: modules, entry points, configuration and public names."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import scan
from corpusloom.operators.symbols import public_api

#: What a module is for, by the words of its path: the purpose with most words wins, the later word where they draw.
PURPOSES = {
    "access control": {"auth", "login", "session", "token", "permission", "account", "user", "users"},
    "storage": {"db", "database", "store", "storage", "repository", "model", "models", "migration", "migrations", "cache"},
    "service interface": {"api", "route", "routes", "router", "controller", "handler", "handlers", "server", "http", "rpc"},
    "screens": {"ui", "view", "views", "page", "pages", "component", "components", "widget", "widgets", "screen"},
    "native code": {"native", "ffi", "napi", "cpp", "jni", "bindings"},
    "checks": {"test", "tests", "spec", "specs", "bench", "benches", "fixture", "fixtures"},
    "tooling": {"tool", "tools", "script", "scripts", "build", "ci", "deploy"},
    "documentation": {"doc", "docs", "example", "examples"},
}
SHOWN = {"entries": 12, "modules": 16, "api": 20, "configs": 16, "recent": 12}


def bucket(path: Column) -> Column:
    """The first two components of a deep path, else the first."""
    p = F.split(path, "/")
    return F.when(F.size(p) > 2, F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1)))).otherwise(F.get(p, F.lit(0)))


def modules(files: DataFrame, key_files: int = 5) -> DataFrame:
    """(bucket, files, key_files) of (path).

    Only the first paths of a bucket are kept while counting, so a bucket of any size fits a task.
    """
    b = files.select(bucket(F.col("path")).alias("bucket"), "path")
    n = b.groupBy("bucket").agg(F.count("*").alias("files"))
    first = b.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("path"))).where(F.col("r") <= key_files)
    first = first.groupBy("bucket").agg(F.array_sort(F.collect_list("path")).alias("key_files"))
    return n.join(first, "bucket")


def purpose(path: str) -> str:
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", path)]
    scores = {what: (sum(w in marks for w in words), max((k for k, w in enumerate(words) if w in marks), default=-1)) for what, marks in PURPOSES.items()}
    best = max(scores, key=scores.__getitem__)
    return best if scores[best][0] else "code"


def entry_kind(path: str) -> str:
    """Kind of an entry point by its name."""
    name = path.rsplit("/", 1)[-1]
    known = {"main.rs": "BinaryMain", "lib.rs": "LibraryRoot", "EntryAbility.ets": "Ability", "Index.ets": "Page", "App.ets": "Page", "CMakeLists.txt": "NativeBuild", "module.json5": "ModuleConfig"}
    return known.get(name, "WebEntry" if name.startswith(("index.", "main.")) else "Other")


def config_kind(path: str) -> str:
    return paths.CONFIG_KINDS.get(path.rsplit("/", 1)[-1], "Other")


@dataclass
class Skeleton:
    totals: Row
    languages: dict[str, int]
    entries: list[str]
    configs: list[str]
    modules: list[Row]
    api: list[Row]
    recent: list[str] = field(default_factory=list)

    @staticmethod
    def build(files: DataFrame, symbols: DataFrame, recent: list[str] = ()) -> Skeleton:
        """From classified files and symbols.  What comes to the driver is a project's outline, as a prompt would hold it."""
        by_path = paths.parts(F.col("path"))
        some = lambda flag: [r.path for r in files.where(flag).select("path").orderBy(by_path).collect()]
        return Skeleton(
            scan.complexity(files).first(), {r.language: r.files for r in scan.language_counts(files).orderBy("language").collect()}, some("is_entry"), some("is_config"),
            modules(files.where("is_source")).orderBy("bucket").collect(), public_api(symbols).collect(), sorted(recent),
        )

    def prompt(self) -> str:
        """The outline as text, each list cut with the number of what is left out."""
        lines = ["# Project skeleton", f"Mode: {self.totals.mode}; files: {self.totals.files}; tokens: about {self.totals.estimated_tokens}", "Languages: " + (", ".join(f"{k}={v}" for k, v in self.languages.items()) or "none")]
        lists = [
            ("Entry points", "entries", [f"{e} ({entry_kind(e)})" for e in self.entries]), ("Modules", "modules", [f"{m.bucket} [{m.files}] {purpose(m.bucket)}" for m in self.modules]),
            ("Public API", "api", [f"{s.kind} {s.name} - {s.file_path}" for s in self.api]), ("Configuration", "configs", [f"{c} ({config_kind(c)})" for c in self.configs]), ("Recent changes", "recent", list(self.recent)),
        ]
        for title, key, rows in lists:
            most = SHOWN[key]
            if rows:
                lines += [f"## {title}", *(f"- {r}" for r in rows[:most]), *([f"... {len(rows) - most} more"] if len(rows) > most else [])]
        return "\n".join(lines) + "\n"

    def context_paths(self, intent: str, hints: list[str]) -> list[str]:
        """Paths that the outline adds to a query."""
        out = set(self.entries + self.configs) if intent in ("BuildError", "ArchitectureQuestion", "Unknown") else set()
        for m in self.modules:
            if any(h in m.bucket.lower() for h in hints):
                out |= set(m.key_files)
        return sorted(out)

    def navigate(self, section: str = "", needle: str = "") -> list[str]:
        """Entries of a section ('entries', 'modules', 'api', 'configs', 'recent', or all) that hold ``needle``."""
        rows = {"entries": self.entries, "modules": [m.bucket for m in self.modules], "api": [f"{s.name} {s.file_path}" for s in self.api], "configs": self.configs, "recent": list(self.recent)}
        return [f"{k}: {r}" for k, rs in rows.items() if not section or k == section for r in rs if needle.lower() in r.lower()]
