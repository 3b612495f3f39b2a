"""Classification of files and the size class of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths


def classified(files: DataFrame) -> DataFrame:
    """``files`` (with path) and language, is_source, is_config, is_entry, is_text, depth."""
    p = F.col("path")
    return files.withColumns({
        "language": paths.language(p), "is_source": paths.is_source(p), "is_config": paths.is_config(p), "is_entry": paths.is_entry(p),
        "is_text": paths.is_text(p), "depth": F.size(F.split(p, "/")) - 1,
    })


def language_counts(files: DataFrame) -> DataFrame:
    return files.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("files"))


def complexity(files: DataFrame, ignored_dirs: int = 0) -> DataFrame:
    """One row: files, source_files, bytes, estimated_tokens, max_depth, generated_ratio, mode."""
    one = files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum(F.col("is_source").cast("long")), F.lit(0)).alias("source_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )
    one = one.withColumn("estimated_tokens", F.floor(F.col("bytes") / 4))
    ratio = F.when(F.col("files") == 0, 0.0).otherwise(F.lit(float(ignored_dirs)) / (F.col("files") + ignored_dirs))
    small, tokens = F.col("source_files"), F.col("estimated_tokens")
    mode = F.when(small == 0, "Explorer").when((small <= 80) & (tokens <= 120_000), "Full").when((small <= 1000) & (tokens <= 1_500_000), "Hybrid").otherwise("Rag")
    return one.withColumn("generated_ratio", ratio).withColumn("mode", mode)


def report(files: DataFrame) -> str:
    """The scan as text: totals, languages, and the first configuration files, entry points and sources."""
    c = complexity(files).first()
    langs = ", ".join(f"{r.language}: {r.files}" for r in language_counts(files).orderBy(F.desc("files"), "language").collect())
    out = [f"Files: {c.files} ({c.source_files} source), {c.bytes} bytes, about {c.estimated_tokens} tokens", f"Mode: {c.mode}", f"Languages: {langs or 'none'}"]
    for title, flag, most in (("Configuration", "is_config", 20), ("Entry points", "is_entry", 30), ("Sources", "is_source", 30)):
        rows = files.where(flag).select("path").orderBy(paths.parts(F.col("path"))).limit(most + 1).collect()
        out += [f"{title}:", *(f"  {r.path}" for r in rows[:most]), *(["  ..."] if len(rows) > most else [])]
    return "\n".join(out) + "\n"


def file_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(line) of files and folders down to ``depth``, indented, in order."""
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.slice(parts, 1, k))
    rows = files.select(F.explode(heads).alias("p"), F.size(parts).alias("n")).groupBy("p").agg(F.max((F.col("n") > F.size("p")).cast("int")).alias("folder"))
    text = F.concat(F.repeat(F.lit("  "), F.size("p") - 1), F.element_at("p", -1), F.when(F.col("folder") == 1, "/").otherwise(""))
    return rows.orderBy("p").select(text.alias("line"))
