"""Checks of a project's index and their repair."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from corpusloom.plans.store import IndexStore, VectorStore
from corpusloom.sources.tree import read_tree


@dataclass(frozen=True)
class Check:
    name: str
    status: str  # Ok, Warning or Error
    detail: str


def doctor(spark: SparkSession, root: str, index: str) -> list[Check]:
    """The state of folder, scan, index and vectors."""
    if not os.path.isdir(root):
        return [Check("root", "Error", f"{root} is no folder")]
    out = [Check("root", "Ok", os.path.abspath(root))]
    files = read_tree(spark, root)
    n = files.count()
    out.append(Check("scan", "Ok" if n else "Warning", f"{n} files"))
    store, vectors = IndexStore(spark, f"{index}/index"), VectorStore(spark, f"{index}/vectors")
    if not store.version():
        out.append(Check("index", "Warning", "missing"))
    elif not store.usable():
        out.append(Check("index", "Warning", "written by another version"))
    else:
        stale = store.changed(files).count()
        out.append(Check("index", "Warning" if stale else "Ok", f"{stale} files differ"))
    out.append(Check("vectors", "Ok" if vectors.version() else "Warning", f"{vectors.read('vectors').count()} records" if vectors.version() else "missing"))
    return out


def heal(spark: SparkSession, root: str, index: str, embeddings: str = "existing", dims: int = 256) -> list[Check]:
    """Refresh the index, and the vectors: ``off``, ``existing`` ones only, or ``ensure`` that there are some; then check."""
    store, vectors = IndexStore(spark, f"{index}/index"), VectorStore(spark, f"{index}/vectors")
    store.refresh(read_tree(spark, root))
    if embeddings == "ensure" or embeddings == "existing" and vectors.version():
        vectors.refresh(store.read("chunks"), dims)
    return doctor(spark, root, index)


def render(checks: list[Check]) -> str:
    return "\n".join(f"[{c.status}] {c.name}: {c.detail}" for c in checks) + "\n"
