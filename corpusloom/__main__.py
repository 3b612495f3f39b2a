"""Command line: python -m corpusloom COMMAND --root FOLDER [--index FOLDER] [QUERY]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from corpusloom.operators import scan
from corpusloom.plans import maintenance
from corpusloom.plans.engine import Engine
from corpusloom.plans.store import IndexStore, VectorStore
from corpusloom.sources import git

COMMANDS = (
    "scan skeleton panel nav retrieve context symbols references chunks graph index-search index-build index-db index-freshness index-refresh "
    "embed-index embed-refresh embed-search vector-db doctor heal tree grep git-status git-diff"
).split()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpusloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--root", default=".")
    p.add_argument("--index", default=None, help="folder of the stored index")
    p.add_argument("--limit", type=int, default=30)
    p.add_argument("--tokens", type=int, default=32_000)
    p.add_argument("--dimensions", type=int, default=256)
    a = p.parse_args(argv)
    index = a.index or f"{a.root}/.corpusloom"
    if a.command in ("git-status", "git-diff"):
        print(git.status(a.root) if a.command == "git-status" else git.diff(a.root, a.query or None), end="")
        return
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    e = Engine.open(spark, a.root, a.index)
    rows = lambda df: "\n".join(str(r.asDict()) for r in df.limit(a.limit).collect()) + "\n"
    store, vectors = IndexStore(spark, f"{index}/index"), VectorStore(spark, f"{index}/vectors")
    do = {
        "scan": e.scan, "skeleton": lambda: e.skeleton.prompt(), "panel": lambda: e.retrieve(a.query).panel(), "nav": lambda: "\n".join(e.skeleton.navigate(needle=a.query)) + "\n",
        "retrieve": lambda: e.retrieve(a.query).render(), "context": lambda: e.context(a.query, a.tokens)[0], "symbols": lambda: rows(e.find_symbols(a.query)),
        "references": lambda: rows(e.find_references(a.query, a.limit)), "chunks": lambda: rows(e.table("chunks")), "graph": e.graph_summary, "index-search": lambda: rows(e.index_search(a.query, a.limit)),
        "index-build": lambda: f"{store.build(e.files)}\n", "index-db": lambda: f"{store.summary()}\n", "index-freshness": lambda: rows(store.changed(e.files)), "index-refresh": lambda: f"{store.refresh(e.files)}\n",
        "embed-index": lambda: f"{vectors.rebuild(e.table('chunks'), a.dimensions)}\n", "embed-refresh": lambda: f"{vectors.refresh(e.table('chunks'), a.dimensions)}\n", "embed-search": lambda: rows(e.embed_search(a.query, a.limit)),
        "vector-db": lambda: f"{vectors.meta()}\n", "doctor": lambda: maintenance.render(maintenance.doctor(spark, a.root, index)), "heal": lambda: maintenance.render(maintenance.heal(spark, a.root, index)),
        "tree": lambda: "\n".join(r.line for r in scan.file_tree(e.files).collect()) + "\n", "grep": lambda: rows(e.grep(a.query, a.limit)),
    }
    print(do[a.command](), end="")


if __name__ == "__main__":
    main()
