"""Chunks: overlapping line windows over symbols, files and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths, text

COLUMNS = ["id", "file_path", "line_start", "line_end", "chunk_type", "signature", "source", "docs", "symbols", "imports", "module_path", "text_hash"]
#: Marks that begin a documentation line.
DOC_MARKS = r"^(///|//!|//|\*|/\*\*|#)"
MOST_DOCS = 8


def file_chunk_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.contains("test") | p.contains("spec"), "Test").when(p.contains("native") | p.contains("napi") | p.contains("cpp"), "NativeBinding").otherwise("Module")


def symbol_chunk_type(path: Column, name: Column, kind: Column) -> Column:
    t = F.concat_ws(" ", F.lower(path), F.lower(name))
    function = F.when(t.contains("route") | t.contains("handler"), "Route").when(t.contains("native") | t.contains("napi") | t.contains("ffi"), "NativeBinding").when(t.contains("test") | t.contains("spec"), "Test").otherwise("Function")
    struct = F.when(paths.extension(path) == "ets", "Component").otherwise("Struct")
    return F.when(kind.isin("Function", "Method"), function).when(kind == "Struct", struct).when(kind.isin("Class", "Enum", "Interface", "Component"), kind).otherwise(file_chunk_type(path))


def docs_above(lines: Column, start: Column) -> Column:
    """Documentation lines right above line ``start``: blank lines are passed, code ends the search."""
    above = F.reverse(F.transform(F.slice(lines, 1, F.greatest(start - 1, F.lit(0))), lambda x: F.trim(x)))
    state = F.struct(F.array().cast("array<string>").alias("docs"), F.lit(True).alias("on"))
    doc = lambda x: x.rlike(DOC_MARKS)
    step = lambda a, x: F.struct(F.when(a["on"] & doc(x), F.concat(F.array(x), a["docs"])).otherwise(a["docs"]).alias("docs"), (a["on"] & (doc(x) | (x == "")) & (F.size(a["docs"]) + doc(x).cast("int") < MOST_DOCS)).alias("on"))
    found = F.aggregate(above, state, step)["docs"]
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def chunk_id(path: Column, scope: str, symbol: Column | None, start: Column, end: Column) -> Column:
    name = F.lit("whole") if symbol is None else F.regexp_replace(symbol, r"[^\p{L}\p{N}_$]", "_")
    return F.concat(path, F.lit(f"::{scope}::"), name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def embed_text() -> Column:
    """What is indexed of a chunk: signature, docs, symbols, imports and the first 40 lines."""
    head = F.array_join(F.slice(text.lines(F.col("source")), 1, 40), "\n")
    return F.concat_ws("\n", "signature", "docs", "symbols", "imports", head)


def chunk_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks of (path, text): configuration whole, sources by symbol or, without symbols, by line windows.

    Text outside of symbols is in no chunk of a file that has some.  Chunks of equal id are one.
    """
    ready = files.select("path", "text", text.lines(F.col("text")).alias("lines"), text.line_count(F.col("text")).alias("n"), text.imports(F.col("text")).alias("imports"), paths.module_path(F.col("path")).alias("module_path"))
    ready = ready.where(paths.is_source(F.col("path")) | paths.is_config(F.col("path")))
    config = paths.is_config(F.col("path"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    whole = ready.where(config).select(
        chunk_id(F.col("path"), "config", None, F.lit(1), F.col("n")).alias("id"), F.col("path").alias("file_path"), F.lit(1).alias("line_start"), F.col("n").alias("line_end"), F.lit("Config").alias("chunk_type"),
        none.alias("signature"), F.col("text").alias("source"), none.alias("docs"), empty.alias("symbols"), "imports", "module_path",
    )
    code = ready.where(~config)
    s = symbols.select(F.col("file_path").alias("path"), "name", "kind", "line_start", "line_end", "signature")
    by_symbol = code.join(s, "path").withColumn("end", F.greatest(F.least("line_end", "n"), "line_start"))
    by_symbol = by_symbol.select("*", F.posexplode(text.windows(F.col("line_start"), F.col("end"))).alias("part", "w"))
    cut = F.array_join(F.slice("lines", F.col("w.start"), F.col("w.end") - F.col("w.start") + 1), "\n")
    symbol_rows = by_symbol.select(
        chunk_id(F.col("path"), "symbol", F.col("name"), F.col("w.start"), F.col("w.end")).alias("id"), F.col("path").alias("file_path"), F.col("w.start").alias("line_start"), F.col("w.end").alias("line_end"),
        symbol_chunk_type(F.col("path"), F.col("name"), F.col("kind")).alias("chunk_type"), "signature", cut.alias("source"), F.when(F.col("part") == 0, docs_above(F.col("lines"), F.col("line_start"))).alias("docs"),
        F.array("name").alias("symbols"), "imports", "module_path",
    )
    bare = code.join(s.select("path").distinct(), "path", "left_anti").select("*", F.explode(text.windows(F.lit(1), F.col("n"))).alias("w"))
    file_rows = bare.select(
        chunk_id(F.col("path"), "file", None, F.col("w.start"), F.col("w.end")).alias("id"), F.col("path").alias("file_path"), F.col("w.start").alias("line_start"), F.col("w.end").alias("line_end"), file_chunk_type(F.col("path")).alias("chunk_type"),
        none.alias("signature"), cut.alias("source"), none.alias("docs"), empty.alias("symbols"), "imports", "module_path",
    )
    every = whole.unionByName(symbol_rows).unionByName(file_rows).dropDuplicates(["id"])
    return every.withColumn("text_hash", F.sha2(embed_text(), 256)).select(*COLUMNS)


def line_windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id") -> DataFrame:
    """(key, line_start, line_end, source) of line windows of a text table."""
    d = docs.select(key, text.lines(F.col("text")).alias("lines"), text.line_count(F.col("text")).alias("n"))
    d = d.select(key, "lines", F.explode(text.windows(F.lit(1), F.col("n"), size, overlap)).alias("w"))
    cut = F.array_join(F.slice("lines", F.col("w.start"), F.col("w.end") - F.col("w.start") + 1), "\n")
    return d.select(key, F.col("w.start").alias("line_start"), F.col("w.end").alias("line_end"), cut.alias("source"))
