"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that BPE produces.
It starts as one state with a loop for every base symbol.  Each merge (u, v) -> w,
in order, applies a gadget: the state that u leads to is forked, the fork loses
its v arc (u before v would have been merged), u leads to the fork from now on, and
every state with a u arc gets a w arc to where v led.  All arcs with one label lead to one
state, so the automaton is kept as fork records instead of copied arc lists:

* ``gadgets[u, v]`` is the step at which u's state was forked and lost v;
* ``lineage[t]`` lists the labels whose forks t's state has inherited, each with the step
  after which it no longer follows that label (w takes over v's state as it is at w's step).

An arc exists when no inherited fork removed it, or removed the arc it was built
from before it was built.  Looked-up arcs are kept in a table.

A word's symbols are encoded by one pass over its positions.  Labels are compiled into a table of transitions
(state, symbol) -> state, in which a state names the token that it completes; a second table holds the automaton's arcs,
(token, token) -> allowed, as they are looked up.  Every prefix has one
accepted token sequence, so a position keeps its last token, and an arc's token is
taken if the automaton has the arc from the state of the token before it.
Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusloom.llm.common import pick, small_batches
from corpusloom.llm.pieces import KEPT, tidy

NEVER = 1 << 60
NOTHING: dict[int, bool] = {}
#: Looked-up arcs that a worker keeps; encoded words that it keeps for good once seen twice, and words seen once lately.
KEEP_ARCS, KEEP_WORDS, RECENT_WORDS = 200_000, 160_000, 40_000
#: The tokenizer file's split in Python's engine; it is right for texts without the characters of ODD.  For other
#: texts the library splits, as the character classes of its Unicode version count.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
ODD = re.compile("[^\x00-ɏ]|[\x1c-\x1f²³¹¼-¾]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Accepts the token sequences of BPE with ``merges``; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>"):
        self.labels: list[str] = [""] * (max(vocab.values()) + 1)
        for label, t in vocab.items():
            self.labels[t] = label
        self.suffix = suffix
        #: The first state of the table of transitions: a state maps a symbol to the next state, and "" to the token that it
        #: completes, or -1.
        self.start: dict = {"": -1}
        for label, t in vocab.items():
            if not label.endswith(suffix):
                state = self.start
                for c in label:
                    state = state.setdefault(c, {"": -1})
                state[""] = t
        self.final = {x[: -len(suffix)]: t for x, t in vocab.items() if x.endswith(suffix) and x != suffix}
        self.longest_final = max(map(len, self.final), default=0)
        self.gadgets: dict[tuple[int, int], int] = {}
        self.built: dict[int, tuple[int, int]] = {}  # merged token: its step, and the arc it was built from
        self.lineage: dict[int, tuple[tuple[int, int], ...]] = {}
        for step, (left, right) in enumerate(merges, 1):
            u, v, w = vocab[left], vocab[right], vocab.get(left + right)
            if w is not None and self.allows(u, v):
                self._apply(step, u, v, w)
        #: The table of arcs: by the token before, whether the automaton has the arc of a token; filled as they are looked up.
        self.arcs: dict[int, dict[int, bool]] = {}
        self.held = 0

    def _apply(self, step: int, u: int, v: int, w: int) -> None:
        inherited = self.lineage.get(v, ((v, NEVER),))
        self.gadgets[u, v] = step
        self.built[w] = (step, u)
        self.lineage[w] = ((w, NEVER), *((x, min(until, step)) for x, until in inherited))

    def allows(self, a: int, b: int) -> bool:
        """Whether the state after token ``a`` has an arc ``b``."""
        lineage = self.lineage.get(a, ((a, NEVER),))
        before, gadgets, built = NEVER, self.gadgets, self.built
        while True:
            for x, until in lineage:
                step = gadgets.get((x, b))
                if step is not None and step < until and step <= before:
                    return False
            made = built.get(b)
            if made is None:
                return True
            before, b = made

    def arc(self, a: int, b: int) -> bool:
        """``allows``, put into the table."""
        if self.held >= KEEP_ARCS:
            self.arcs.clear()
            self.held = 0
        self.held += 1
        found = self.arcs.setdefault(a, {})[b] = self.allows(a, b)
        return found

    def encode(self, symbols: str) -> list[int]:
        """The tokens of one word, given as byte symbols without the suffix."""
        n = len(symbols)
        if not n:
            return []
        final, arcs, arc, longest, start = self.final.get, self.arcs, self.arc, self.longest_final, self.start
        last: list[int] = [-1] * (n + 1)
        came = [0] * (n + 1)
        inner = symbols[:-1]
        for i in range(n):
            p = last[i]
            if i and p < 0:
                continue
            known = arcs.get(p, NOTHING)
            state, e = start, i
            for c in inner[i:] if i else inner:
                state = state.get(c)
                if state is None:
                    break
                e += 1
                if last[e] < 0 and (t := state[""]) >= 0:
                    if i:
                        ok = known.get(t)
                        if ok or ok is None and arc(p, t):
                            last[e], came[e] = t, i
                    else:
                        last[e], came[e] = t, i
            if n - i <= longest and (t := final(symbols[i:])) is not None:
                ok = known.get(t) if i else True
                if ok or ok is None and arc(p, t):
                    last[n], came[n] = t, i
                    break
        out, i = [], n
        while i > 0:
            out.append(last[i])
            i = came[i]
        return out[::-1]


class Words(dict):
    """Word to (ids joined by spaces, labels joined by spaces); rare words don't drive out common ones."""

    def __init__(self, automaton: MergeAutomaton, as_symbols: bool = False):
        super().__init__()
        self.automaton, self.recent, self.as_symbols, self.symbols = automaton, {}, as_symbols, byte_symbols()

    def __missing__(self, word: str) -> tuple[str, str]:
        found = self.recent.get(word)
        if found is not None:
            if len(self) < KEEP_WORDS:
                self[word] = found
            return found
        symbols = word if self.as_symbols or (word.isascii() and word.isalnum()) else "".join(map(self.symbols.__getitem__, word.encode("utf-8", "replace")))
        ids = self.automaton.encode(symbols)
        found = (" ".join(map(str, ids)), " ".join(map(self.automaton.labels.__getitem__, ids)))
        if len(self.recent) >= RECENT_WORDS:
            self.recent.clear()
        self.recent[word] = found
        return found


#: What a tokenizer file must say of normalising and splitting, for FAST to split as the file does.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def check(spec: dict) -> None:
    """Raise unless FAST and the automaton stand for what the file says: another kind of file would give other tokens."""
    model = spec["model"]
    wanted = {
        "a BPE model with an end-of-word suffix": model.get("type", "BPE") == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix"),
        "no dropout, byte fallback or ignored merges": not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges"),
        f"the normaliser {NORMALIZER}": spec.get("normalizer") == NORMALIZER, f"the pre-tokenizer {PRE_TOKENIZER}": spec.get("pre_tokenizer") == PRE_TOKENIZER,
        "no decoder or post-processor": spec.get("decoder") is None and spec.get("post_processor") is None,
        "added tokens that are taken as they stand": not any(t.get(x) for t in spec.get("added_tokens", []) for x in ("lstrip", "rstrip", "single_word", "normalized")),
    }
    missing = [what for what, holds in wanted.items() if not holds]
    if missing:
        raise ValueError("a tokenizer file needs: " + "; ".join(missing))


class Tokenizer:
    """What a ``tokenizers`` file of a lower-casing, word-end BPE says, for whole texts."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        check(spec)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = Words(MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"]))
        self.symbol_words = Words(self.words.automaton, as_symbols=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = tokenizers.Tokenizer.from_str(raw)

    def found(self, text: str) -> list[tuple[str, str]]:
        """Ids and labels of each word of a text without special tokens."""
        if ODD.search(text):
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [self.symbol_words[x] for x, _ in split]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return [*map(self.words.__getitem__, FAST.findall(text.lower()))]

    def encode(self, text: str) -> tuple[str, str]:
        """Ids and labels of a text, each joined by single spaces."""
        if not any(x in text for x in self.special):
            words = self.found(text)
            if not words:
                return "", ""
            ids, labels = zip(*words, strict=True)
            return " ".join(ids), " ".join(labels)
        found = [(str(self.special[x]), x) if k % 2 else self.encode(x) for k, x in enumerate(self.cut.split(text))]
        return " ".join(i for i, _ in found if i), " ".join(s for i, s in found if i)


@lru_cache(maxsize=1)
def load(raw: str) -> Tokenizer:
    return Tokenizer(raw)


KEPT[__name__] = load.cache_clear


def decode(ids: list[int], raw: str) -> str:
    """The arcs' labels, joined by spaces: the file names no decoder."""
    t = load(raw)
    labels = t.words.automaton.labels
    special = {i: s for s, i in t.special.items()}
    return " ".join(special.get(i) or labels[i] for i in ids)



def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) if asked for.

    Whole texts are encoded; null counts as empty and has no tokens.  Each row stands
    for itself, so repeated rows give repeated results; an empty table gives none and further
    columns are ignored.  The tokenizer file is read on the driver and broadcast (a
    vocabulary, whose size no input changes); nothing is shuffled.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    d = small_batches(pick(docs, doc_id=id_col, text=text_col))
    schema = d.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches):
        encode = load(raw.value).encode
        sha = hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, a, b, every = [], [], [], []
                for text in part.column("text"):
                    ids, labels = encode(text.as_py() or "")
                    n.append(ids.count(" ") + 1 if ids else 0)
                    a.append(sha(ids.encode()).hexdigest())
                    b.append(sha(labels.encode()).hexdigest())
                    if with_ids:
                        every.append([*map(int, ids.split())])
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
                if with_ids:
                    columns["ids"] = pa.array(every, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return d.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)
