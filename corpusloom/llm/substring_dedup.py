"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; it depends on the last 16 of them only, and a
chunk ends where its top bits are zero.  Text put in before a passage shifts no
boundary inside it.  Chunks are deduplicated by digest: a digest found in two
documents or more belongs to the first of its places, and the others may go.

Two repeated chunks in a row anchor a run.  A run is extended byte by byte at both ends
against another document that holds its end chunk, then back to whole words.  What is reported are
runs of ``min_run`` bytes of whole chunks, or of ``MIN_WORDS`` words as extended, so that a short line
in common is no finding.

Chunks are computed once and written.  Digests and positions are shuffled once to find the repeated digests, with map-side
aggregation, and once to look them up, by a join that deals common digests out to several tasks.  Texts
are shuffled once, to the anchors, and give only the bytes about them.

A text is known by its identifier and a hash of its own, ``key``, so rows that share an identifier don't mix.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import pick, small_batches, spread_join
from corpusloom.llm.pieces import mixed, tidy
from corpusloom.sources.scratch import staged

#: Window of the gear hash in bytes, and bits that must be zero at a boundary.
WINDOW, ZERO_BITS = 16, 4
#: Bytes of a chunk; the mean is about LEAST + 2 ** ZERO_BITS.
LEAST, MOST = 16, 96
#: Bytes of whole repeated chunks in a row that count, larger than MOST, or else words of the extended run.
MIN_RUN, MIN_WORDS = 180, 50
#: Bytes about a chunk that are compared.  Behind it a chunk bounds them; before it the two texts' chunks may not agree yet.
BEFORE, AFTER = 3 * MOST, MOST + 4
WHITE = b" \t\n\v\f\r"


@lru_cache(maxsize=1)
def gears() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint16)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of chunks by the rolling hash alone; never inside a character."""
    h = gears()[data]
    width = 1
    while width < WINDOW:  # each round doubles the bytes that the hash has seen
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint16(width)
        h = h + shifted
        width *= 2
    cut = (h >> np.uint16(16 - ZERO_BITS)) == 0
    whole = np.ones(len(data), bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    return np.flatnonzero(cut & whole) + 1


def chunks(data: bytes) -> list[int]:
    """Ends of the chunks of one text; the last is its length."""
    n = len(data)
    ends: list[int] = []
    start = 0
    for b in [*boundaries(np.frombuffer(data, np.uint8)).tolist(), n]:
        while b - start > MOST:  # no boundary for long
            at = start + MOST
            while at > start + LEAST and data[at] & 0xC0 == 0x80:
                at -= 1
            ends.append(at)
            start = at
        if b - start >= LEAST or b == n > start:
            ends.append(b)
            start = b
    return ends


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, digest, place) of each chunk of (doc_id, key, text).

    ``place`` packs the start, a bit that says whether the text has the chunk before, and the length.
    """

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests, places = [], [], []
                for text in part.column("text"):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    start = 0
                    ends = chunks(data)
                    seen: set[int] = set()
                    for end in ends:
                        x = digest(data[start:end])
                        digests.append(x)
                        places.append(start << 8 | (x in seen) << 7 | end - start)
                        seen.add(x)
                        start = end
                    counts.append(len(ends))
                rows = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(rows), "key": part.column("key").take(rows), "digest": pa.array(np.array(digests, np.uint64).view(np.int64)), "place": pa.array(places, pa.int64())})

    schema = docs.select("doc_id", "key").schema.add("digest", "long").add("place", "long")
    return docs.select("doc_id", "key", "text").mapInArrow(tidy(run), schema)


def whole_words(own: bytes, other: bytes, most: int) -> int:
    """Bytes that both begin with, back to white space unless the word there ends in both; ``most`` are at hand."""
    n, least = 0, min(len(own), len(other))
    while n < least and own[n] == other[n]:
        n += 1
    if n < most and all(x[n : n + 1] in WHITE for x in (own, other)):  # both go on with white space, or end
        return n
    while n and own[n - 1] not in WHITE:
        n -= 1
    return n


def _about(batches):
    """Bytes before (backwards) and behind spans of a text, and about the first place of each digest asked for."""
    digest = xxhash.xxh3_64_intdigest
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        index, rows = [], []
        for k, (text, spans, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "asked")), strict=True)):
            data = text.encode("utf-8", "surrogatepass")
            for s in spans or ():
                a, b = s["start"], s["start"] + s["n_bytes"]
                torn = sum(0 < x < len(data) and data[x - 1] not in WHITE and data[x] not in WHITE for x in (a, b))
                rows.append((None, a, len(data[a:b].split()) - torn, data[max(0, a - BEFORE) : a][::-1], data[b : b + AFTER]))
                index.append(k)
            left, start = {x & (1 << 64) - 1: x for x in asked or ()}, 0
            for end in chunks(data) if left else ():
                x = left.pop(digest(data[start:end]), None)
                if x is not None:
                    rows.append((x, None, None, data[max(0, start - BEFORE) : start][::-1], data[end : end + AFTER]))
                    index.append(k)
                start = end
        columns = [*zip(*rows, strict=True)] or [[]] * 5
        ids = [batch.column(c).take(pa.array(index, pa.int64())) for c in ("doc_id", "key")]
        yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "key", "digest", "at", "words", "before", "after"])


def _stretched(batches):
    """Runs with their start, bytes and words as extended; ``whole`` are the bytes of their chunks."""
    for batch in batches:
        start, size, words, held, removed = [], [], [], [], []
        for spans, at, n, w, *sides in zip(*(batch.column(c).to_pylist() for c in ("held", "start", "whole", "words", "before", "after", "left_before", "right_after")), strict=True):
            before, after, left, right = (x or b"" for x in sides)
            a, b = whole_words(before, left, BEFORE), whole_words(after, right, AFTER)
            for x in spans:
                left_end, right_end = x["start"] == at, x["start"] + x["n_bytes"] == at + n
                x["start"], x["n_bytes"] = x["start"] - a * left_end, x["n_bytes"] + a * left_end + b * right_end
            held.append(spans)
            removed.append(sum(x["n_bytes"] for x in spans))
            start.append(at - a)
            size.append(a + n + b)
            words.append((w or 0) + len(before[:a].split()) + len(after[:b].split()))
        found = {"start": pa.array(start, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "words": pa.array(words, pa.int64()), "removed_bytes": pa.array(removed, pa.int64()), "held": pa.array(held, batch.column("held").type)}
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "key", "n_chunks", "first_doc_id", "whole")} | found)


def extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` extended at both ends against the documents named in ``left`` and ``right``."""
    text = ["doc_id", "key"]
    spans = runs.groupBy(*text).agg(F.collect_list(F.struct("start", "n_bytes")).alias("spans"))  # as many as the text has
    asked = runs.select("left.other", "left.other_key", "left.digest").union(runs.select("right.other", "right.other_key", "right.digest")).distinct()
    asked = asked.groupBy(F.col("other").alias("doc_id"), F.col("other_key").alias("key")).agg(F.collect_list("digest").alias("asked"))
    schema = docs.select(*text).schema.add("digest", "long").add("at", "long").add("words", "long").add("before", "binary").add("after", "binary")
    about = staged(docs.join(spans.join(asked, text, "full"), text).select(*text, "text", "spans", "asked").mapInArrow(tidy(_about), schema), "substring-about")
    # Rows may repeat identifier and text.  Written, so that a join with a large key can be split.
    side = about.where(F.col("digest").isNotNull()).groupBy(*text, "digest").agg(F.max(F.struct("before", "after")).alias("s"))
    side = staged(side.select(*text, "digest", "s.*"), "substring-side")
    own = about.where(F.col("digest").isNull()).groupBy(*text, F.col("at").alias("start")).agg(F.max(F.struct("words", "before", "after")).alias("s")).select(*text, "start", "s.*")
    j = runs.withColumnRenamed("n_bytes", "whole").join(own, [*text, "start"], "left")
    for end, byte in (("left", "before"), ("right", "after")):
        other = side.select(*[F.col(c).alias(f"{end}_{c}") for c in (*text, "digest", byte)])
        j = j.join(other, (F.col(f"{end}.other") == F.col(f"{end}_doc_id")) & (F.col(f"{end}.other_key") == F.col(f"{end}_key")) & (F.col(f"{end}.digest") == F.col(f"{end}_digest")), "left")
    keep = [*text, "n_chunks", "first_doc_id", "whole"]
    out = j.select(keep).schema.add("start", "long").add("n_bytes", "long").add("words", "long").add("removed_bytes", "long").add(j.schema["held"])
    return j.select(*keep, "held", "start", "words", "before", "after", "left_before", "right_after").mapInArrow(tidy(_stretched), out)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    return d.withColumn("key", F.xxhash64("text"))


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """One row per run of repeated chunks: doc_id, start, n_bytes, n_chunks, removed_bytes, first_doc_id, kept, held, key.

    ``start`` and ``n_bytes`` give the run in UTF-8 bytes, extended to the last whole word that both documents hold;
    an extension goes with the chunk it continues, and may reach into the next run.  ``first_doc_id`` is the smallest
    identifier of the documents that hold the run's first chunk.  ``kept`` is true where this
    document is first to hold every chunk of the run, so that nothing of it goes;
    ``removed_bytes`` are its bytes that an earlier document holds, and ``held`` the spans (start, n_bytes) of
    neighbouring chunks that they form.  Chunks count as repeated if two documents, known by identifier, hold them; ``within`` adds
    those that a text holds twice, of which its first place stays.  ``key`` (xxhash64 of the text) tells apart rows that
    share an identifier and differ in text; equal rows count once.  Null and empty texts have no chunks, and rows without
    identifier no runs.  Texts of any length are cut whole; an empty table gives an empty result; further columns are ignored.
    """
    if min_run <= MOST:
        raise ValueError(f"min_run must be over {MOST}, the longest chunk")
    d = small_batches(_texts(docs, id_col, text_col)).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    c = staged(chunk_rows(d), "substring-chunks")
    again = F.col("place").bitwiseAND(128) != 0
    more = [F.max(again).alias("again")] if within else []
    twice = c.groupBy("digest").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.min_by("key", "doc_id").alias("first_key"), F.max_by("key", "doc_id").alias("last_key"), F.count("*").alias("copies"), *more,
    )
    twice = staged(twice.where((F.col("first_doc_id") < F.col("last")) | (F.col("again") if within else F.lit(False))).drop("again"), "substring-twice")
    found = spread_join(c, twice, ["digest"], F.hash("key", "place"))
    found = found.where((F.col("first_doc_id") < F.col("last")) | again).select(
        "doc_id", "key", "first_doc_id", "first_key", "last", "last_key", "digest", F.shiftright("place", 8).alias("start"), F.col("place").bitwiseAND(127).alias("size"), (again & F.lit(within)).alias("again"),
    )
    w = Window.partitionBy("doc_id", "key").orderBy("start")
    found = found.withColumn("same", F.lag("start").over(w)).where("same IS NULL OR same <> start").drop("same")  # equal rows
    fresh = F.coalesce(F.lag(F.col("start") + F.col("size")).over(w) != F.col("start"), F.lit(True))
    before = F.col("first_doc_id") < F.col("doc_id")
    earlier = before | F.col("again")
    turn = fresh | F.coalesce(F.lag(earlier).over(w) != earlier, F.lit(True))
    found = found.withColumns({"run": F.sum(fresh.cast("int")).over(w), "part": F.sum(turn.cast("int")).over(w), "earlier": earlier})
    # Parts of a run that an earlier document holds, or none does; then runs.  Both are dealt by document already.
    holder = lambda first, own, last: F.when(before, F.col(first)).when(F.col("again"), F.col(own)).otherwise(F.col(last))
    end = F.struct("digest", holder("first_doc_id", "doc_id", "last").alias("other"), holder("first_key", "key", "last_key").alias("other_key"))
    parts = found.groupBy("doc_id", "key", "run", "part", "earlier").agg(
        F.min("start").alias("start"), F.sum("size").alias("n_bytes"), F.count("*").alias("n_chunks"), F.min_by("first_doc_id", "start").alias("first_doc_id"),
        F.min_by(end, "start").alias("left"), F.max_by(end, "start").alias("right"),
    )
    runs = parts.groupBy("doc_id", "key", "run").agg(
        F.min("start").alias("start"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_chunks").alias("n_chunks"),
        F.sum(F.when(F.col("earlier"), F.col("n_bytes")).otherwise(0)).alias("removed_bytes"),
        F.min_by("first_doc_id", "start").alias("first_doc_id"),
        F.sort_array(F.collect_list(F.when(F.col("earlier"), F.struct("start", "n_bytes")))).alias("held"),
        F.min_by("left", "start").alias("left"), F.max_by("right", "start").alias("right"),
    ).where("n_chunks > 1").drop("run")
    runs = extended(d, staged(runs, "substring-runs"))
    return runs.where((F.col("whole") >= min_run) | (F.col("words") >= MIN_WORDS)).select("doc_id", "start", "n_bytes", "n_chunks", "removed_bytes", "first_doc_id", (F.col("removed_bytes") == 0).alias("kept"), "held", "key")


def without_repeats(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """(doc_id, text) of every row without the spans that earlier documents hold: runs, or ``min_run`` bytes or more of a run.

    ``within`` takes out what a text repeats itself, too.  Null and empty texts, and rows without identifier, stay as they
    are; rows that share an identifier lose what is in their own runs; equal rows lose the same.  An empty table
    gives an empty result; further columns are ignored.
    """
    gone = repeated_runs(docs, min_run, id_col, text_col, within).select("doc_id", "key", F.col("n_bytes").alias("all"), F.explode("held").alias("h")).select("doc_id", "key", "all", "h.*")
    gone = gone.where((F.col("n_bytes") >= min_run) | (F.col("n_bytes") == F.col("all"))).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias("gone"))  # as many as the text has
    d = _texts(docs, id_col, text_col).join(gone, ["doc_id", "key"], "left").select("doc_id", "text", "gone")

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if text and spans:
                    data, kept, at = text.encode(), [], 0
                    for s in spans:
                        kept.append(data[at : s["start"]])
                        at = max(at, s["start"] + s["n_bytes"])
                    text = b"".join([*kept, data[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())})

    return d.mapInArrow(tidy(run), pick(docs, doc_id=id_col).schema.add("text", "string"))
