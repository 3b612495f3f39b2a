import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, pieces, toxicity

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_on_odd_rows(odd, empty):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd).collect()]
    assert len(got) == odd.count()
    assert {(i, "und", 0.0) for i in (1, 2, 3, 10)} <= set(got)
    assert langid.identify(empty).count() == 0
    kept = langid.known_language(odd, 0.0)
    assert kept.columns == odd.columns and kept.count() == len([1 for _, p, _ in got if p != "und"])
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_many_languages_use_more_planes():
    rows = [(f"l{k:03d}", int.from_bytes(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}".encode(), "big"), 5) for k in range(70) for a in "abc"]
    f = langid.Filters.build(rows)
    assert f.planes.shape[0] == 2 and len(f.langs) == 70
    assert langid.Filters.build([]).predict(["text", ""])[0] == ["und", "und"]


def model():
    counts = np.zeros(toxicity.ALPHABET**3)
    text = "\n" + "\n".join("you are a total idiot moron pathetic worthless loser stupid trash scum asshole shit the and nation other plain words stay".split()) + "\n"
    x = toxicity._codes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        counts[(a * 28 + b) * 28 + c] += 100
    return toxicity.log_model(counts)


@pytest.mark.parametrize(
    ("seen", "want"),
    [
        ("you-are-a-total-m0r0n-and-1d10t", "you-are-a-total-moron-and-idiot"), ("i__d__i__o__t", "idiot"), ("1d107 4$$h0l3 $h17", "idiot asshole shit"), 
        ("m0r0n,1d10t,l0s3r,tr4sh,scum", "moron,idiot,loser,trash,scum"), ("idi" + "o" * 100 + "t", "idiot"), ("w o r t h l e s s " * 5, "worthless " * 5),
    ],
)
def test_spans_of_any_length_are_restored(seen, want):
    got = toxicity.Scorer(model(), np.zeros(0, np.uint64), np.zeros(0), 0.0).restored([seen], toxicity.Channel(model()))[0]
    assert got.replace(" ", "") == want.replace(" ", "") if "w o r" in seen else got == want


def every_path(channel, span, spaced):
    """All (log probability, letters) of a span, by enumeration."""
    p, code = channel.p, channel.code
    ways = []
    for at, c in enumerate(span):
        arcs = [(c, 0.0)] if c.isalpha() else []
        arcs += [(x, toxicity.SWAP) for x in toxicity.LOOKALIKES.get(c, "")]
        if not c.isalpha():
            arcs.append((c, toxicity.BREAK if spaced and c in toxicity.SEPARATORS else toxicity.LITERAL if c in toxicity.LOOKALIKES else 0.0))
        ways.append([*arcs, None])
    for path in itertools.product(*ways):
        total, a, b, last, out = 0.0, 0, 0, "", ""
        for at, (c, arc) in enumerate(zip(span, path, strict=True)):
            if arc is None:
                same = c == last or last and last in toxicity.LOOKALIKES.get(c, "")
                if spaced and c in toxicity.SEPARATORS:
                    total += toxicity.SEPARATE
                elif same and c * 3 in span[max(0, at - 2) : at + 3]:
                    total += toxicity.REPEAT
                else:
                    break
                continue
            x, w = arc
            k = code(x)
            total += w
            if not (k == 0 and b == 0):
                total += p[(a * 28 + b) * 28 + k]
                a, b = b, k
            if x == last and k:
                total += toxicity.TWICE
            last, out = x, out + x
        else:
            yield total + (p[(a * 28 + b) * 28] if b else 0.0), out


@pytest.mark.parametrize(("span", "spaced"), [("m0r0n", False), ("1d107", False), ("l0s3r", False), ("4$$h0l3", False), ("s.c.u.m", True), ("1 d 1 0 7", True), ("truuuush", False), ("i__d__1", True)])
def test_decoding_equals_enumeration(span, spaced):
    channel = toxicity.Channel(model())
    best = max(every_path(channel, span, spaced))
    found = channel.decode(span, spaced)
    assert abs(max(v for v, out in every_path(channel, span, spaced) if out == found) - best[0]) < 1e-9


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(3)
    words = ["w.o.r.t.h.l.e.s.s", "l o s e r", "m0r0n", "plain", "words", "a", "be", "sooooo", "ÄÖ", "漢字" * 40, "x" * 90, ", ", "i__d"]
    texts = [rng.choice([" ", "  ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(20)]
    scorer = toxicity.Scorer(model(), np.zeros(0, np.uint64), np.zeros(0), 0.0)
    rows = [("a", g, 3) for g in (int(x) for x in np.unique(np.concatenate([*langid.orders(*langid.grams(["plain words a be loser"])[:2])])).view(np.int64)) if g]
    filters = langid.Filters.build([*rows, ("b", 7, 1)])
    whole = scorer.restored(texts, toxicity.Channel(model())), filters.predict(texts), [filters.predict([t])[1][0] for t in texts]
    for module in (toxicity, langid):
        monkeypatch.setattr(module, "slices", lambda t, most=50, cut=pieces.WHITE: pieces.slices(t, 50, cut))
    assert scorer.restored(texts, toxicity.Channel(model())) == whole[0]
    again = filters.predict(texts)
    assert again[0] == whole[1][0] and (again[1] == whole[1][1]).all() and (whole[1][1] == whole[2]).all() and whole[1][1].max() > 0


def test_filters_hold_what_sets_hold():
    rng = random.Random(4)
    held = {lang: {rng.getrandbits(62) for _ in range(3000)} for lang in "abc"}
    filters = langid.Filters.build([(lang, g, 1) for lang, gs in held.items() for g in gs])
    probe = np.array([*held["a"], *(rng.getrandbits(62) for _ in range(20_000))], np.int64).view(np.uint64)
    got = filters.masks(probe, 0)
    for k, lang in enumerate("abc"):
        real = np.array([int(g) in held[lang] for g in probe.tolist()])
        bit = (got >> k) & 1 == 1
        assert (bit | ~real).all() and abs(np.count_nonzero(bit & ~real) / len(probe) - filters.false_rate[k]) < 0.001


@pytest.mark.parametrize(("seen", "want"), [("m0r0n", "moron"), ("1d10t", "idiot"), ("p@th3tic", "pathetic"), ("w o r t h l e s s", "worthless"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("trash!!", "trash!!"), ("plain words stay", "plain words stay")])
def test_channel_restores(seen, want):
    counts = np.zeros(toxicity.ALPHABET**3)
    text = "\n" + "\n".join("idiot moron pathetic worthless loser stupid trash scum the and nation other plain words stay".split()) + "\n"
    x = toxicity._codes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        counts[(a * 28 + b) * 28 + c] += 100
    assert toxicity.Channel(toxicity.log_model(counts)).restore(seen) == want


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    right = [r for r in got if r.predicted == r.toxic]
    found = [r for r in got if r.predicted and r.toxic]
    assert len(right) / len(got) > 0.95 and len(found) > 0.9 * sum(r.toxic for r in got) and len(found) > 0.9 * sum(r.predicted for r in got)


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (6, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(odd, labels, with_restored=True).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.score_documents(odd, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.score_documents(empty, labels).count() == 0
