"""Language identification with language-bitmask n-gram filters.

One table of ``SLOTS`` bit masks, a bit per language, is a Bloom filter for every
language at once: the AND of an n-gram's ``HASHES`` slots is the set of languages
that contain it.  A text's languages are counted by bit; each count is corrected for its
filter's rate of false positives, and the largest decides.

A language contains an n-gram when its rate there is at least ``SHARE`` of the
n-gram's highest rate and ``LEAST`` of all n-grams, so foreign lines in some documents
don't fill the filters as the corpus grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import column, fold, pick, small_batches
from corpusloom.llm.pieces import NO_LETTER, begins, give_back, letter_table, mixed, slices, tidy
from corpusloom.sources.scratch import staged

SLOTS, HASHES = 1 << 19, 3
SHARE, LEAST = 0.2, 2e-6
ORDERS = (2, 3)
#: The filters are fitted on about so many labelled documents of each language, drawn by a hash of the identifier, and
#: on those n-grams of a language that make up this share of its sample at least, so what comes to the driver is bounded.
TRAIN_DOCS, LEAST_COUNTED = 3_000, 1e-6
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, first position of each text, letters of each text).

    Code points are packed 21 bits each, so n-grams are exact; a run of non-letters is one
    boundary.  An n-gram holds a letter at least.  Each text is given lower-cased, and begins and ends with a boundary.
    """
    low = [f" {t} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(low) + 1, np.int64)
    np.cumsum([*map(len, low)], out=starts[1:])
    letter = letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[starts]
    letters = np.add.reduceat(letter, starts[:-1], dtype=np.int64) if len(low) else np.zeros(0, np.int64)
    x = np.where(letter, points, 0)[keep].astype(np.uint64)
    return x, at, letters


def orders(x: np.ndarray, at: np.ndarray):
    """The n-grams that end at each position, per order; 0 where there is none, as where texts begin (``at``)."""
    s = np.uint64(21)
    inside = np.ones(len(x), bool)
    inside[at[:-1]] = False
    two = np.zeros_like(x)
    two[1:] = (x[:-1] << s) | x[1:]
    three = np.zeros_like(x)
    three[2:] = (x[:-2] << np.uint64(42)) | two[2:]
    inner = np.zeros(len(x), bool)
    inner[1:] = x[:-1] != 0  # a boundary in the middle belongs to two words
    yield np.where(inside & (two != 0), two | np.uint64(1) << np.uint64(63), np.uint64(0))
    yield np.where(inside & inner, three, np.uint64(0))


@dataclass(frozen=True)
class Filters:
    """Bit-sliced Bloom filters: ``planes`` has a row of masks for each 64 languages."""

    langs: tuple[str, ...]
    planes: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def build(rows: list[tuple[str, int, int]], totals: dict[str, int] | None = None) -> Filters:
        """From (lang, n-gram, count) and the number of n-grams of each language, by default that of the rows."""
        if totals is None:
            totals = {}
            for lang, _, n in rows:
                totals[lang] = totals.get(lang, 0) + n
        langs = tuple(sorted(totals))
        if not langs:
            return Filters((), np.zeros((1, SLOTS), np.uint8), np.zeros(0))
        number = {x: k for k, x in enumerate(langs)}
        lang = np.array([number[r[0]] for r in rows])
        gram, where = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64), return_inverse=True)
        rate = np.zeros((len(langs), len(gram)))
        np.add.at(rate, (lang, where), [r[2] for r in rows])
        rate /= np.array([totals[x] for x in langs], float)[:, None]
        held = (rate >= SHARE * rate.max(axis=0)) & (rate >= LEAST)
        kind = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint32 if len(langs) <= 32 else np.uint64
        planes = np.zeros(((len(langs) + 63) // 64, SLOTS), kind)
        for k in range(len(langs)):
            for slot in probes(gram[held[k]]):
                np.bitwise_or.at(planes[k // 64], slot, kind(1 << (k % 64)))
        fill = np.array([np.count_nonzero(planes[k // 64] & kind(1 << (k % 64))) / SLOTS for k in range(len(langs))])
        return Filters(langs, planes, fill**HASHES)

    def masks(self, gram: np.ndarray, plane: int) -> np.ndarray:
        """The languages that contain each n-gram."""
        out = None
        for slot in probes(gram):
            got = self.planes[plane][slot]
            out = got if out is None else out & got
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams, letters, n-grams held by each language) of each text."""
        x, at, letters = grams(texts)
        n = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(self.langs)), np.int64)
        for gram in orders(x, at):
            real = gram != 0
            n += np.add.reduceat(real, at[:-1], dtype=np.int64)
            for plane in range(len(self.planes)):
                m = np.where(real, self.masks(gram, plane), 0)
                for k in range(64 * plane, min(len(self.langs), 64 * plane + 64)):
                    hits[:, k] += np.add.reduceat((m >> m.dtype.type(k % 64)) & m.dtype.type(1), at[:-1], dtype=np.int64)
        return n, letters, hits

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the corrected share of its n-grams that the language holds."""
        n = np.zeros(len(texts), np.int64)
        letters = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), max(1, len(self.langs))), np.int64)
        for index, part in slices([t.lower() for t in texts], cut=NO_LETTER):
            a, b, c = self.counts(part)
            np.add.at(n, index, a)
            np.add.at(letters, index, b)
            if self.langs:
                np.add.at(hits, index, c)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        real = (hits - n[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999))
        best = real.argmax(axis=1)  # ties: the first in order of name
        score = np.clip(real[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
        return [self.langs[k] if some else UNKNOWN for k, some in zip(best, letters, strict=True)], np.where(letters > 0, score, 0.0)


def probes(gram: np.ndarray):
    h = mixed(gram)
    step = (h >> np.uint64(40)) | np.uint64(1)
    for _ in range(HASHES):
        yield (h & np.uint64(SLOTS - 1)).astype(np.int64)
        h = h + step


def _count(batches):
    for batch in batches:
        texts, lang = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        total: dict[str, list[np.ndarray]] = {}
        for name in sorted(set(lang)):
            for _, part in slices([t.lower() for t, x in zip(texts, lang, strict=True) if x == name], cut=NO_LETTER):
                x, at, _ = grams(part)
                for gram in orders(x, at):
                    g, n = np.unique(gram[gram != 0], return_counts=True)
                    total.setdefault(name, []).append(np.stack([g, n.astype(np.uint64)]))
        for name, parts in total.items():
            both = np.concatenate(parts, axis=1)
            g, where = np.unique(both[0], return_inverse=True)
            n = np.bincount(where, weights=both[1].astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(g)), "gram": pa.array(g.view(np.int64)), "n": pa.array(n)})


def fit(labelled: DataFrame, most: int = TRAIN_DOCS) -> Filters:
    """Filters from (doc_id, text, lang); rows whose text or lang is null teach nothing.

    About ``most`` rows of each language are used, those whose identifier's hash is least, so a rare language is used
    whole.  N-grams are counted by the executors; those too rare to be in a filter (``LEAST``) don't come to the driver,
    so a language sends 1 / ``LEAST_COUNTED`` counts an order at most.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rates = rows.groupBy("lang").agg(F.count("*").alias("rows")).select("lang", F.least(F.lit(1.0), F.lit(float(most)) / F.col("rows")).alias("rate"))
    cut = rates.where("rate < 1").collect()  # a row per frequent language
    if cut:
        rate = F.coalesce(F.create_map(*[F.lit(x) for r in cut for x in (r.lang, r.rate)])[F.col("lang")], F.lit(1.0))
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))
    counts = rows.select("text", "lang").mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = staged(counts, "langid-counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters.build([], {})
    least = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, int(LEAST_COUNTED * n))])[F.col("lang")]
    return Filters.build([tuple(r) for r in counts.where(F.col("n") >= least).collect()], totals)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` (with a text column) and the columns lang_pred and score; no other column is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # fixed size: SLOTS masks
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lang, score = shared.value.predict([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(tidy(run), schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows that may teach: crc32(identifier) mod 3 is not 1."""
    d = small_batches(pick(docs, doc_id=id_col, text=text_col, lang=lang_col))
    return d.where(fold("doc_id", 3) != 1)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is ``und`` with score 0 for a text that is null or has no letter, and for all texts if
    nothing could be learned.  Texts of any length are judged whole; an empty table gives an empty result.  Repeated
    rows give repeated results; further columns are ignored.
    """
    filters = fit(training_rows(docs, id_col, text_col, lang_col))
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.select("doc_id", F.col("text").cast("string").alias("text"))
    out = predict(d, filters)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of ``least`` at least; all columns stay.

    Null and empty texts, and texts without a letter, go.  Texts of any length are judged whole.  Repeated rows stay or
    go together.  From an empty table, or where nothing can be learned, no row stays.
    """
    filters = fit(training_rows(docs, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        begins(__name__)
        for part in texts:
            lang, score = shared.value.predict(part.fillna("").tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        give_back()

    # Only texts go to Python; the rows wait in the JVM.
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    p = predicted(F.col(f"c{column(docs, text_col)}").cast("string"))
    return plain.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= least)).toDF(*names)
