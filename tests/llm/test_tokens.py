import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(FILE, encoding="utf-8") as f:
        return bpe.load(f.read()), Tokenizer.from_file(FILE)


def same(both, text):
    mine, library = both
    e = library.encode(text, add_special_tokens=False)
    ids, labels = mine.encode(text)
    assert ids == " ".join(map(str, e.ids)), text[:80]
    assert labels == library.decode(e.ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinorst'! 1é", max_size=80), st.text("ha", max_size=60)))
def test_equals_the_library(both, text):
    same(both, text)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "x<|startoftext|>Y <|endoftext|>", "It's WE'LL 'sense'", "a" * 5000, "!" * 999, "ΣΑΣ Σ", "é Å", "\x1c a\x85b　c", "½²", "İstanbul", "՘a"])
def test_equals_the_library_on_corners(both, text):
    same(both, text)


def test_equals_the_library_on_documents(both, some):
    for r in some.collect():
        same(both, r.text)


def test_automaton_accepts_only_what_bpe_makes(both):
    mine = both[0].words.automaton
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abehilnorst") for _ in range(rng.randint(1, 15)))
        ids = mine.encode(word)
        assert all(mine.allows(a, b) for a, b in zip(ids, ids[1:]))
        labels = [mine.labels[t] for t in ids]
        assert "".join(labels) == word + "</w>"


def test_uneven_repeats_merge_from_the_left():
    a = bpe.MergeAutomaton({"a": 0, "b": 1, "a</w>": 2, "b</w>": 3, "aa": 4}, [("a", "a")])
    assert a.encode("aaaab") == [4, 4, 3] and a.encode("aaab") == [4, 0, 3]


def test_documents(odd, empty, both):
    rows = odd.select("doc_id", "text").collect()
    got = bpe.encode_documents(odd, FILE, with_ids=True).collect()
    want = []
    for r in rows:
        e = both[1].encode(r.text or "", add_special_tokens=False)
        want.append((r.doc_id, len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(both[1].decode(e.ids, skip_special_tokens=False).encode()).hexdigest(), e.ids))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.decode(want[4][4], open(FILE, encoding="utf-8").read()) == both[1].decode(want[4][4], skip_special_tokens=False)
    assert bpe.encode_documents(empty, FILE).count() == 0


def test_other_tokenizer_files_are_refused():
    with open(FILE, encoding="utf-8") as f:
        spec = json.load(f)
    for part, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", {"type": "ByteLevel"})):
        with pytest.raises(ValueError, match="tokenizer file needs"):
            bpe.check(spec | {part: value})
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="tokenizer file needs"):
        bpe.Tokenizer(f.read())
