"""References: uses of known names, apart from their declarations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths, text

IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
GAP = "[^A-Za-z_$]*+"
#: Identifiers of a line that are looked at together.
PIECE = 32
#: Names that are broadcast; more go through a sieve of 2**10 to 2**20 words of 64 bits, in rows of 2**10.
FEW_NAMES = 10_000
WORDS_A_ROW, MOST_WORDS = 10, 20
#: Tasks that the uses of one name are dealt to, by their path.
DEALS = 16


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line_number, line) of (path, text)."""
    return files.select("path", F.posexplode(text.lines(F.col("text"))).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_number"), "line")


def pieces(line: Column) -> Column:
    """Array of (start, piece): the line, cut behind every ``PIECE`` identifiers, and the characters before each piece.

    A piece goes on to the next one's first identifier, so what stands around each of its own is whole.
    """

    def placed(cut: Column) -> Column:
        start = lambda widths, k: F.aggregate(F.slice(widths, 1, k), F.lit(0), lambda a, x: a + x)
        gap = lambda k: F.coalesce(F.regexp_extract(F.get(cut, k + 1), f"^{GAP}", 0), F.lit(""))
        return text.let(F.transform(cut, F.length), lambda widths: F.transform(cut, lambda p, k: F.struct(start(widths, k).alias("start"), F.concat(p, gap(k)).alias("piece"))))

    return text.let(F.regexp_extract_all(line, F.lit(rf"(?:{GAP}{IDENTIFIER}+){{1,{PIECE}}}(?:{GAP}\z)?"), F.lit(0)), placed)


def identifiers(files: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(path, line_number, name, column_start, kind, snippet): every identifier of every line, or those rows that ``keep`` leaves by their name.

    A piece of the line is cut at identifiers; what stands before and behind one gives its column and kind.
    """
    rows = numbered_lines(files).select("path", "line_number", "line", F.inline(pieces(F.col("line"))))
    # Digits that touch an identifier from the left are no part of one: 1abc holds abc.
    names = F.regexp_extract_all("piece", F.lit(IDENTIFIER), F.lit(0))
    rows = keep(rows.select("path", "line_number", "line", "start", "piece", F.posexplode(names).alias("i", "name")))
    rows = rows.withColumns({"gaps": F.split("piece", IDENTIFIER, -1), "names": names})
    width = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    before, after = F.get("gaps", F.col("i")), F.get("gaps", F.col("i") + 1)
    component = F.rtrim(before).endswith("<")
    kind = F.when(component, "ComponentUse").when(F.ltrim(after).startswith("("), "Call").otherwise("Identifier")
    column = F.col("start") + width(F.col("gaps"), F.col("i") + 1) + width(F.col("names"), F.col("i")) + 1
    return rows.select("path", "line_number", "name", column.alias("column_start"), kind.alias("kind"), F.trim("line").alias("snippet"))


def sieve(names: DataFrame, count: int) -> Callable[[Column], Column]:
    """A test that all of the ``count`` (name) pass and few others: two bits of a name's hash, in a word of a table that its hash chooses.

    A name has 16 bits at least, as long as the table is not at its largest, 8 MB; with more names more others pass.
    """
    words = 1 << min(max((count // 4).bit_length(), WORDS_A_ROW), MOST_WORDS)
    bit = lambda h, shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    bits = lambda h: bit(h, 0).bitwiseOR(bit(h, 6))
    word = lambda h: F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(words - 1))
    listed = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]).alias(value)
    h = F.xxhash64("name")
    marks = names.select(word(h).alias("word"), bits(h).alias("bits")).unionByName(names.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    marks = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).groupBy(F.shiftright("word", WORDS_A_ROW).alias("row")).agg(listed("word", "bits"))
    table = marks.agg(listed("row", "bits")).scalar()

    def passes(name: Column) -> Column:
        h = F.xxhash64(name)
        row, at = F.shiftright(word(h), WORDS_A_ROW).cast("int"), word(h).bitwiseAND(F.lit((1 << WORDS_A_ROW) - 1)).cast("int")
        return F.get(F.get(table, row), at).bitwiseAND(bits(h)) == bits(h)

    return passes


def _uses(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Identifiers that name a symbol, without those on the line that declares them.

    Most identifiers are no such names and go before anything is shuffled, by the names themselves or by their sieve.
    """
    known = symbols.select("name").distinct()
    declared = symbols.select("name", F.col("file_path").alias("path"), F.col("line_start").alias("line_number")).distinct()
    count = known.count()
    if count <= FEW_NAMES:
        found = identifiers(files, lambda rows: rows.join(F.broadcast(known), "name", "left_semi"))
    else:
        passes = sieve(known, count)
        # A common name is dealt to several tasks.
        found = identifiers(files, lambda rows: rows.where(passes(F.col("name")))).withColumn("deal", F.pmod(F.xxhash64("path"), F.lit(DEALS)).cast("int"))
        found = found.join(known.select("name", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal")), ["name", "deal"], "left_semi")
    return found.join(declared, ["name", "path", "line_number"], "left_anti")


def places(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, symbol_name, line_number, column_start, kind): ``references`` without their lines, each place once."""
    return _uses(files, symbols).select(F.col("path").alias("file_path"), F.col("name").alias("symbol_name"), "line_number", "column_start", "kind").distinct()


def references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Identifiers that name a symbol, without those on the line that declares them, and their lines."""
    return _uses(files, symbols).select(F.col("path").alias("file_path"), F.col("name").alias("symbol_name"), "line_number", "column_start", "kind", "snippet").distinct()


def find(refs: DataFrame, name: str) -> DataFrame:
    return refs.where(F.col("symbol_name") == name)


def find_any(refs: DataFrame, names: list[str], limit: int) -> DataFrame:
    """The first ``limit`` references of each name, in order of path, line and name."""
    path = paths.parts(F.col("file_path"))
    w = Window.partitionBy("symbol_name").orderBy(path, "line_number", "column_start", "kind")
    some = refs.where(F.col("symbol_name").isin(names)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")
    return some.orderBy(path, "line_number", "symbol_name", "column_start")


def counts(refs: DataFrame) -> DataFrame:
    return refs.agg(F.countDistinct("symbol_name").alias("symbols"), F.count("*").alias("references"))
