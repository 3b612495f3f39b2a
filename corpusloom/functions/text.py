"""Column expressions on text; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of code that the tokeniser drops.
CODE_STOP_WORDS = [
    "fn", "let", "return", "pub", "use", "self", "mut", "const", "static", "if", "else", "for", "while", "match", "impl", "struct", "enum", "trait",
    "type", "where", "as", "in", "ref", "move", "async", "await", "unsafe", "super", "crate", "mod", "true", "false", "none", "some", "ok", "err",
    "import", "export", "default", "from", "class", "function", "var", "def", "yield", "lambda", "pass", "break", "continue", "and", "or", "not",
    "is", "null", "undefined", "void",
]
#: An import is a statement of one line; what it imports is quoted, in angle brackets, or the path behind its keyword.
QUOTED_IMPORT = r"""(?m)(?:^[ \t]*(?:import|export)\b[^"'\n;]*|\brequire\([ \t]*|^[ \t]*#[ \t]*include[ \t]+)["']([^"'\n]+)["']"""
BARE_IMPORT = r"(?m)^[ \t]*(?:#[ \t]*include[ \t]+<|(?:use|mod|import)[ \t]+|from[ \t]+(?=\S+[ \t]+import\b))([\w.:]++|(?<=<)[^>\n]+)"
MAX_CHUNK_LINES, CHUNK_OVERLAP = 120, 20


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; ``lower`` is the fast way for ASCII texts."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a last line end."""
    return let(F.split(text, r"\r?\n", -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def line_count(text: Column) -> Column:
    """Number of lines, 1 at least."""
    return F.greatest(F.size(lines(text)), F.lit(1))


def windows(start: Column, end: Column, size: int = MAX_CHUNK_LINES, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of (start, end) of overlapping windows of ``size`` lines; the last one reaches ``end``."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((end - start + 1 - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((start + k * step).cast("int").alias("start"), F.least(start + k * step + size - 1, end).cast("int").alias("end")))


def words(text: Column) -> Column:
    """Runs of letters, digits, ``_`` and ``$`` of two characters or more, ASCII lower-cased."""
    return F.filter(F.regexp_extract_all(ascii_lower(text), F.lit(r"[\p{L}\p{N}_$]+"), F.lit(0)), lambda w: F.length(w) >= 2)


def _plain_tokens(text: Column) -> Column:
    """``code_tokens`` of a text without ``_``, ``$`` and, once lower-cased, inner capitals: each word twice, by patterns on the text as a whole."""
    spaced = F.regexp_replace(ascii_lower(text), r"[^\p{L}\p{N}]+", " ")
    kept = F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), rf"(?<= )(?:.|{'|'.join(CODE_STOP_WORDS)}) ", "")
    return F.filter(F.split(F.trim(F.regexp_replace(kept, "([^ ]+) ", "$1 $1 ")), " "), lambda w: w != "")


def code_tokens(text: Column) -> Column:
    """Each word and its pieces between ``_`` and ``$``, in order, without stop words."""
    return F.when(ascii_lower(text).rlike(r"[_$]|\p{Ll}\p{Lu}"), _cut_tokens(text)).otherwise(_plain_tokens(text))


def _cut_tokens(text: Column) -> Column:
    """``code_tokens`` word by word."""

    def pieces(w: Column) -> Column:
        parts = F.split(F.regexp_replace(w, r"(\p{Ll})(\p{Lu})", "$1_$2"), "[_$]", -1)
        return F.concat(F.array(w), F.transform(F.filter(parts, lambda p: F.octet_length(p) >= 2), ascii_lower))

    every = F.flatten(F.transform(words(text), pieces))
    stop = F.array(*map(F.lit, CODE_STOP_WORDS))
    return F.filter(every, lambda t: ~F.array_contains(stop, t))


def imports(text: Column) -> Column:
    """Imported names, distinct and sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (QUOTED_IMPORT, BARE_IMPORT)]))
    trimmed = F.transform(found, lambda x: F.regexp_replace(F.trim(x), ";+$", ""))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def token_estimate(text: Column) -> Column:
    """A quarter of the ASCII and half of the other characters, each rounded down, 1 at least; 0 for empty text."""
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    guess = F.floor(plain / 4) + F.floor((F.length(text) - plain) / 2)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(guess, F.lit(1))).cast("long")


def fts_terms(query: str, most: int = 16) -> list[str]:
    """Distinct lower-cased ASCII words of a search query, sorted, the first ``most``."""
    import re

    return sorted({w.lower() for w in re.findall(r"[A-Za-z0-9_]+", query) if len(w) >= 2})[:most]


#: Lower-case letters of the Latin blocks with diacritics, and the letters they stand on.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def fts_line(text: Column) -> Column:
    """Words of the full-text index, each between two blanks: letters and digits, lower-cased, without diacritics."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), ACCENTED, PLAIN)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def excerpt(text: Column, line: Column | int, context: Column | int) -> Column:
    """Numbered lines around ``line``, each ended by a line break."""
    at = F.lit(line) if isinstance(line, int) else line
    start = F.greatest(at - context, F.lit(1))
    numbered = F.transform(lines(text), lambda s, i: F.format_string("%5d: %s\n", i + 1, s))
    return F.array_join(F.slice(numbered, start, F.lit(at + context) - start + 1), "")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def subsequence_pattern(query: str) -> str:
    """Regular expression of texts that hold the query's characters in order."""
    import re

    return ".*".join(re.escape(c) for c in query)


def hash_embedding(tokens: Column, dims: int) -> Column:
    """Array of doubles: each token adds a sign to one component, by SHA-256; unit length."""
    n = max(8, dims)

    def slot(t: Column) -> Column:
        h = F.sha2(t, 256)
        little = F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
        return (F.conv(little, 16, 10).cast("decimal(20,0)") % n).cast("int")

    def sign(t: Column) -> Column:
        return F.when(F.conv(F.substring(F.sha2(t, 256), 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)

    zero = F.array_repeat(F.lit(0.0), n)
    raw = F.aggregate(tokens, zero, lambda a, t: F.transform(a, lambda x, i: F.when(i == slot(t), x + sign(t)).otherwise(x)))
    return unit(raw)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the components that both have."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
