"""Toxicity with noisy-channel deobfuscation.

A text passes a channel that swaps letters for look-alikes, puts separators between
letters and repeats letters.  Where it shows such marks, the span becomes a lattice of
letters, and Viterbi decoding under a character trigram model finds the likeliest
original; elsewhere the lattice has one path and the text stands.  The restored text is
scored by the words, and beginnings of words, that tell toxic from other documents.

Decoding is exact and spans may be of any length: no state is dropped.  Where nearly all of a word are look-alikes, the
character model decides whether it is one.  The character model counts all documents (a table of fixed size); the words are
learned from a bounded sample of labelled rows, drawn per label so that a rare one is used whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, pick, small_batches
from corpusloom.llm.pieces import NO_LETTER, letter_table, mixed, prefix_sums, slices, tidy
from corpusloom.sources.scratch import staged

#: Characters that stand for letters.
LOOKALIKES = {"4": "a", "@": "a", "3": "e", "€": "e", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z"}
MARKS = "".join(LOOKALIKES)
SEPARATORS = " .-_*"
ALPHABET = 28  # a boundary, a to z, any other letter
#: Natural logs of the channel's probabilities: a look-alike used, or meant as it is; a separator or a repeated letter put in.
SWAP, LITERAL, SEPARATE, BREAK, REPEAT, TWICE = -1.0, -14.0, -0.3, -6.0, -0.3, -1.5
SWAPPED = re.compile(rf"(?<=[^\W\d_])[{re.escape(MARKS.replace('!', ''))}]|[{re.escape(MARKS)}](?=[^\W\d_])")
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{re.escape(MARKS)}])(?:[ .\-_*]+(?:[^\W_]|[{re.escape(MARKS)}])){{3,}}(?![^\W_])")
REPEATED = re.compile(r"([^\W\d_])\1\1")
#: What is decoded as a whole where a look-alike or a repeated letter is found: letters, digits and look-alikes in a row.
WORD = re.compile(rf"(?:[^\W_]|[{re.escape(MARKS)}])+")
#: White space between words of two letters or digits or more, where no span can cross.
BETWEEN = re.compile(r"(?<=[^\W_]{2})[\x20\x09-\x0D](?=[^\W_]{2})")
#: A word of mostly look-alikes is decoded if its letters are on average likelier than any of the alphabet.
LIKELY = -math.log(ALPHABET)
KEPT_SPAN = 64  # longer spans aren't remembered
#: About so many labelled rows of each label teach the words; so many features are kept.
TRAIN_DOCS, FEATURES = 6_000, 4096
#: Labelled rows whose so many least feature hashes agree are near copies, of which one teaches.
SKETCH = 12
#: A feature needs so many toxic documents, and so large a share of toxic ones at the lower end of a 95 % interval.
LEAST_DOCS, LEAST_SHARE = 5, 0.55
BEGINNING = 5


def _codes(points: np.ndarray) -> np.ndarray:
    letter = letter_table()[points]
    plain = (points >= 97) & (points <= 122)
    return np.where(plain, points.astype(np.int64) - 96, np.where(letter, 27, 0))


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts, lower-cased; a run of non-letters is one boundary."""

    def run(batches):
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = [t.lower() for t in batch.slice(at, 1024).column("text").to_pylist() if t]
                for _, part in slices(texts, cut=NO_LETTER):
                    x = _codes(np.frombuffer("\n\n".join(["", *part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32))
                    keep = x > 0
                    keep[1:] |= x[:-1] > 0
                    keep[:1] = True
                    x = x[keep]
                    if len(x) > 2:
                        total += np.bincount((x[:-2] * ALPHABET + x[1:-1]) * ALPHABET + x[2:], minlength=ALPHABET**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    out = np.zeros(ALPHABET**3)
    for r in docs.mapInArrow(tidy(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # ALPHABET ** 3 rows at most
        out[r.gram] = r.n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of the third of each trigram, smoothed by the lower orders."""
    c3 = counts.reshape((ALPHABET,) * 3)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + ALPHABET)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    return np.log((c3 + 10 * p2[None]) / (c3.sum(2, keepdims=True) + 10))


class Channel:
    """Viterbi decoding of suspicious spans."""

    def __init__(self, model: np.ndarray):
        self.p = model.reshape(-1).tolist()
        self.known: dict[tuple[str, bool], str] = {}

    @staticmethod
    def code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0

    def decode(self, span: str, spaced: bool = False) -> str:
        """The likeliest original of a lower-cased span."""
        key = (span, spaced)
        if len(span) > KEPT_SPAN:
            return self._viterbi(span, spaced)
        out = self.known.get(key)
        if out is None:
            if len(self.known) > 200_000:
                self.known.clear()
            out = self.known[key] = self._viterbi(span, spaced)
        return out

    def _viterbi(self, span: str, spaced: bool) -> str:
        p, code = self.p, self.code
        # State: the last two codes and the last letter; value: log probability and the letters so far.
        states: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
        for at, c in enumerate(span):
            arcs: list[tuple[str, float]] = []
            if c.isalpha():
                arcs.append((c, 0.0))
            for x in LOOKALIKES.get(c, ""):
                arcs.append((x, SWAP))
            if not c.isalpha():
                arcs.append((c, BREAK if spaced and c in SEPARATORS else LITERAL if c in LOOKALIKES else 0.0))
            new: dict[tuple[int, int, str], tuple[float, tuple]] = {}
            for (a, b, last), (v, path) in states.items():
                steps = [(x, code(x), w) for x, w in arcs]
                for x, k, w in steps:
                    if k == 0 and b == 0:
                        score, key = v + w, (a, 0, x)
                    else:
                        score, key = v + w + p[(a * ALPHABET + b) * ALPHABET + k], (b, k, x)
                    if x == last and k:
                        score += TWICE
                    if key not in new or score > new[key][0]:
                        new[key] = (score, (path, x))
                same = c == last or last and last in LOOKALIKES.get(c, "")
                skip = SEPARATE if spaced and c in SEPARATORS else REPEAT if same and c * 3 in span[max(0, at - 2) : at + 3] else None
                if skip is not None and ((key := (a, b, last)) not in new or v + skip > new[key][0]):
                    new[key] = (v + skip, path)
            states = new
        ends = [(v + (p[(a * ALPHABET + b) * ALPHABET] if b else 0.0), path) for (a, b, _), (v, path) in states.items()]
        path = max(ends, key=lambda x: x[0])[1]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def likely(self, word: str) -> bool:
        """Whether the letters of a decoded word are likelier than chance."""
        codes = [0, 0, *map(self.code, word), 0]
        total = sum(self.p[(x * ALPHABET + y) * ALPHABET + z] for x, y, z in zip(codes, codes[1:], codes[2:], strict=False) if y or z)
        return total > LIKELY * (len(word) + 1)

    def _words(self, text: str, sign: re.Pattern) -> str:
        """``text`` with the words decoded in which ``sign`` is found."""
        out, done = [], 0
        for m in sign.finditer(text):
            s = m.start()
            if s < done:
                continue
            while s > done and WORD.match(text, s - 1, s):
                s -= 1
            e = WORD.match(text, m.start()).end()
            core = text[s:e].rstrip("!|+")
            marks = sum(c in LOOKALIKES for c in core)
            if marks or sign is REPEATED:
                found = self.decode(core)
                if 3 * marks <= 2 * len(core) or self.likely(found):
                    out += [text[done:s], found, text[s + len(core) : e]]
                    done = e
        return "".join([*out, text[done:]]) if out else text

    def restore(self, text: str) -> str:
        """A lower-cased text with its suspicious spans decoded."""
        text = SPACED.sub(lambda m: self.decode(m[0], True), text)
        return self._words(self._words(text, SWAPPED), REPEATED)


@lru_cache(maxsize=1)
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter or digit, and whether it is one that is no decimal digit, as the patterns have it."""
    every = [chr(c) for c in range(0x110000)]
    return np.fromiter((c.isalnum() for c in every), bool), np.fromiter((c.isalnum() and not c.isdecimal() for c in every), bool)


_MARK = np.zeros(0x110000, bool)
_MARK[[ord(c) for c in MARKS]] = True
_SEPARATOR = np.zeros(0x110000, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True


def suspicious(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text, whether it may show any of the channel's marks; where it doesn't no pattern matches."""
    alnum, letter = (t[points] for t in word_tables())
    mark = _MARK[points]
    odd = np.zeros(len(points), bool)
    odd[1:] |= mark[:-1] & letter[1:]  # a look-alike before a letter
    odd[1:] |= letter[:-1] & mark[1:] & (points[1:] != 33)  # or behind one; an exclamation mark is none there
    odd[2:] |= letter[2:] & (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
    gap = _SEPARATOR[points]
    first = np.flatnonzero(~gap | np.concatenate([[True], ~gap[:-1]]))  # separators in a row count as one
    one, gap = (alnum | mark)[first], gap[first]
    odd[first[6:]] |= one[6:] & gap[5:-1] & one[4:-2] & gap[3:-3] & one[2:-4] & gap[1:-5] & one[:-6]
    return np.logical_or.reduceat(odd, starts[:-1])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and word beginning; texts are lower-cased."""
    low = [t + " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sums, inverse = prefix_sums(mixed(points.astype(np.uint64) + np.uint64(1)))
    edge = np.diff(np.concatenate([[False], letter_table()[points], [False]]).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([*map(len, low)])
    doc = np.searchsorted(ends, s, side="right")
    word = mixed((sums[e] - sums[s]) * inverse[s])
    long = e - s > BEGINNING
    begin = mixed((sums[s[long] + BEGINNING] - sums[s[long]]) * inverse[s[long]]) ^ np.uint64(0x5BD1E995)
    return np.concatenate([doc, doc[long]]), np.concatenate([word, begin])


@dataclass(frozen=True)
class Scorer:
    """Sorted features, their weights, and the weight of none."""

    model: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    prior: float

    def pieces(self, texts: list[str], channel: Channel):
        """(numbers of texts, restored texts), lower-cased, in slices that no span crosses."""
        for index, part in slices([t.lower() for t in texts], cut=BETWEEN):
            held = [t + " " for t in part]
            points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.concatenate([[0], np.cumsum([*map(len, held)])])
            yield index, [channel.restore(t) if odd else t for t, odd in zip(part, suspicious(points, starts), strict=True)]

    def restored(self, texts: list[str], channel: Channel) -> list[str]:
        out: list[list[str]] = [[] for _ in texts]
        for index, part in self.pieces(texts, channel):
            for k, t in zip(index, part, strict=True):
                out[k].append(t)
        return ["".join(x) for x in out]

    def score(self, texts: list[str], channel: Channel) -> np.ndarray:
        """Probability that each text is toxic."""
        light = np.zeros(1 << 16, bool)
        light[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        total = np.full(len(texts), self.prior)
        docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for index, part in self.pieces(texts, channel):
            doc, key = features(part)
            some = light[(key & np.uint64(0xFFFF)).astype(np.int64)]
            doc, key = doc[some], key[some]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            docs.append(np.asarray(index)[doc[hit]])
            keys.append(at[hit])
        pair = np.unique(np.stack([np.concatenate(docs), np.concatenate(keys)]), axis=1)
        np.add.at(total, pair[0].astype(np.int64), self.weights[pair[1].astype(np.int64)] if len(self.weights) else 0.0)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sampled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of about ``most`` rows of each label outside the held-out fold; and the share drawn by label."""
    known = pick(labels, doc_id="doc_id", toxic="toxic").where(F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0))
    known = known.select("doc_id", (F.col("toxic").cast("double") != 0).cast("int").alias("toxic")).distinct()
    rows = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    rate = {k: min(1.0, most / n) for k, n in rows.items()}
    least = F.when(F.col("toxic") == 1, int((1 << 30) * rate.get(1, 1.0))).otherwise(int((1 << 30) * rate.get(0, 1.0)))
    wanted = staged(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < least), "toxicity-sample")
    if wanted.count() <= 4 * most:  # as drawn, about 2 * most; broadcast, so that no text but these is moved
        wanted = F.broadcast(wanted)
    return docs.where(F.col("text").isNotNull()).join(wanted, "doc_id").select("doc_id", "text", "toxic"), rate


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Scorer:
    """Learn from (doc_id, text) and (doc_id, toxic)."""
    model = log_model(char_counts(docs.select("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    blank = Scorer(model, np.zeros(0, np.uint64), np.zeros(0), 0.0)

    def run(batches):
        channel = Channel(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                feats: list[list[int]] = [[] for _ in texts]
                for index, piece in blank.pieces(texts, channel):
                    doc, key = features(piece)
                    for d, k in zip(np.asarray(index)[doc].tolist(), key.view(np.int64).tolist(), strict=True):
                        feats[d].append(k)
                feats = [sorted(set(f)) for f in feats]
                sketch = [xxhash.xxh3_128_digest(np.array(f[:SKETCH], np.int64).tobytes()) for f in feats]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.string()), "toxic": part.column("toxic"), "sketch": pa.array(sketch, pa.binary()), "features": pa.array(feats, pa.list_(pa.int64()))})

    sample, rate = _sampled(docs, labels, most)
    taught = sample.mapInArrow(tidy(run), "doc_id string, toxic int, sketch binary, features array<long>")
    # Copies teach once; of copies with both labels the toxic one.
    taught = taught.groupBy("sketch").agg(F.max(F.struct("toxic", "doc_id", "features")).alias("r")).select("r.toxic", "r.features")
    # One job counts features and documents: feature null stands for the document itself.
    f = taught.select("toxic", F.explode(F.concat("features", F.array(F.lit(None).cast("long")))).alias("f"))
    n = f.groupBy("f").agg(F.count("*").alias("rows"), F.sum("toxic").alias("pos"))
    # Where labels are drawn at different rates, clean rows count for as many as they stand for.
    n = n.withColumn("n", F.col("pos") + (F.col("rows") - F.col("pos")) * (rate.get(1, 1.0) / rate.get(0, 1.0)))
    share, z2 = F.col("pos") / F.col("n"), 3.84
    low = (share + z2 / (2 * F.col("n")) - 1.96 * F.sqrt((share * (1 - share) + z2 / (4 * F.col("n"))) / F.col("n"))) / (1 + z2 / F.col("n"))
    n = n.withColumn("low", low).where(F.col("f").isNull() | ((F.col("pos") >= LEAST_DOCS) & (F.col("low") >= LEAST_SHARE)))
    found = n.orderBy(F.col("f").isNotNull(), F.desc("pos"), "f").limit(FEATURES + 1).collect()
    if not found or found[0].f is not None:
        return Scorer(model, np.zeros(0, np.uint64), np.zeros(0), math.log(1 / 9))
    toxic, clean = found[0].pos, found[0].rows - found[0].pos
    prior = math.log((toxic + 0.5) / (clean * rate.get(1, 1.0) / rate.get(0, 1.0) + 0.5))
    keys = np.array([r.f for r in found[1:]], np.int64).view(np.uint64)
    weights = np.array([math.log((r.pos + 0.5) / (toxic + 1)) - math.log((r.rows - r.pos + 0.5) / (clean + 1)) for r in found[1:]])
    order = np.argsort(keys)
    return Scorer(model, keys[order], weights[order], min(prior, -0.5))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_restored: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (and restored, the decoded text, if asked for).

    A null, empty or wordless text gets the score of no evidence, below 0.5.  Rows of
    ``labels`` with a null label teach nothing; without any label nothing is predicted toxic.
    Repeated rows give repeated results; further columns are ignored.
    """
    d = small_batches(pick(docs, doc_id=id_col, text=text_col))
    d = d.select("doc_id", F.col("text").cast("string").alias("text"))
    scorer = fit(d, labels)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # FEATURES weights and ALPHABET ** 3 probabilities at most
    schema = d.select("doc_id").schema.add("score", "double")
    if with_restored:
        schema = schema.add("restored", "string")

    def run(batches):
        s = shared.value
        channel = Channel(s.model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column("text").to_pylist()]
                columns = {"doc_id": part.column("doc_id"), "score": pa.array(s.score(texts, channel))}
                if with_restored:
                    columns["restored"] = pa.array(s.restored(texts, channel), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    out = d.mapInArrow(tidy(run), schema)
    first = out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["restored"] if with_restored else []))
    return first
