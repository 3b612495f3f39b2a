import collections
import hashlib
import random
import re

import pytest

from corpusloom.llm import exact_dedup, jaccard_join, substring_dedup
from corpusloom.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_on_odd_rows(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()].append(r.doc_id)
    for r in got:
        ids = groups[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(ids), max((i for i in ids if i is not None), default=None))
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == collections.Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.kept_documents(odd).columns == odd.columns and exact_dedup.kept_documents(odd).count() == len(groups)
    smallest = {r.text_sha256: r.keep_id for r in exact_dedup.exact_dedup(odd, keep="smallest").collect()}
    assert all(smallest[h] == min((i for i in ids if i is not None), default=None) for h, ids in groups.items())


def test_exact_dedup_salts_large_groups(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot' WHEN id % 3 = 1 THEN 'hOT' ELSE CAST(id AS STRING) END AS text")
    got = exact_dedup.exact_dedup(df).where("text_sha256 = sha2('hot', 256)").collect()
    assert len(got) == 2000 and {(r.keep_id, r.group_size) for r in got} == {(2998, 2000)} and [r.doc_id for r in got if r.kept] == [2998]


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        m = min(n, len(w))
        sets[i] = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                    p, q = sorted((find(a), find(b)))
                    top[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, n, num):
    rng = random.Random(n)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 80))] for _ in range(10)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, "x " * 50), (1006, "X " * 60)]
    for k in range(250):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((k, rng.choice([" ", "\t", "\r\n"]).join(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, n, num, 100).collect()}
    assert got == brute(rows, n, num, 100)
    one = {r.doc_id for r in jaccard_join.one_of_each(df, n, num, 100).collect()}
    assert one == {i for i, (_, c) in got.items() if c == i}


def test_jaccard_join_on_odd_rows(odd, empty):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect())
    assert got[5, 3, 4] == 2 and got[4, 3, 4] == 1 and got[1, 0, 1] == got[2, 0, 2] == got[3, 0, 3] == 1
    assert got[6, 3, 6] == got[7, 3, 6] == 1 and sum(n for (i, _, c), n in got.items() if i is None and c is None) == 2
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.one_of_each(odd).columns == odd.columns


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(2000, i) for i in range(2001, 2200)] + [(5000, 5001), (7, 7)], "a long, b long")
    rounds = []
    got = {r.node: r.component for r in components(edges, count=rounds).collect()}
    assert got == {i: 0 for i in range(1001)} | {i: 2000 for i in range(2000, 2200)} | {5000: 5000, 5001: 5000}
    assert len(rounds) <= 8 and rounds[-1] == 0


def test_rows_that_share_an_identifier_keep_their_links(spark):
    rng = random.Random(9)
    a, b = (" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(300)) for _ in "ab")
    rows = [(1, a), (2, b), (3, a + " q"), (3, b + " q"), (4, "something else altogether here")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_chunks_cover_texts_and_resist_insertions():
    rng = random.Random(1)
    data = " ".join("".join(rng.choice("aeiouthnrsé") for _ in range(rng.randint(1, 9))) for _ in range(3000)).encode()
    ends = substring_dedup.chunks(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= substring_dedup.MOST and min(sizes[:-1]) >= substring_dedup.LEAST
    for a, b in zip([0, *ends], ends):
        data[a:b].decode()
    moved = b"some words before " + data
    cut = lambda d: {d[a:b] for a, b in zip([0, *substring_dedup.chunks(d)], substring_dedup.chunks(d))}
    assert len(cut(data) & cut(moved)) > 0.95 * len(cut(data))
    assert substring_dedup.chunks(b"") == [] and substring_dedup.chunks(b"x" * 300)[-1] == 300


def test_repeated_passages_are_found_and_short_lines_are_not(spark):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("aeiouthnrsl") for _ in range(rng.randint(2, 9))) for _ in range(n))
    line = "A short line in common."
    passages = [say(52) for _ in range(40)]
    docs = [(i, f"{say(60)}\n{line}\n{say(60)}") for i in range(200)]
    planted = {}
    for k, p in enumerate(passages):
        for i in (200 + 2 * k, 201 + 2 * k):
            docs.append((i, f"{say(40)} {p} {say(40)}"))
            planted[i] = p
    got = substring_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(planted)
    texts = dict(docs)
    for r in got:
        assert texts[r.doc_id].encode()[r.start : r.start + r.n_bytes].decode() in f" {planted[r.doc_id]} "
        assert r.kept == (r.doc_id % 2 == 0) and r.first_doc_id == r.doc_id - r.doc_id % 2
    rest = {r.doc_id: r.text for r in substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(rest[i] == t for i, t in docs if i % 2 == 0 or i < 200) and all(len(rest[i]) < len(texts[i]) for i in planted if i % 2)


def test_substring_dedup_on_odd_rows(odd, empty):
    assert {r.doc_id for r in substring_dedup.repeated_runs(odd).collect()} >= {6, 8}
    assert substring_dedup.repeated_runs(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_runs(odd, min_run=50)


def test_what_an_earlier_document_holds_goes_though_the_rest_of_the_run_recurs_later(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("aeiouthnrsl") for _ in range(rng.randint(2, 9))) for _ in range(n))
    p, q = say(150), say(150)
    docs = [(1, f"{say(20)} {p} {say(20)}"), (2, f"{say(20)} {p} {q} {say(20)}"), (3, f"{say(20)} {q} {say(20)}")]
    rest = {r.doc_id: r.text for r in substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    middle = slice(len(p) // 4, len(p) // 2)
    assert rest[1] == docs[0][1] and p[middle] not in rest[2] and q[middle] in rest[2] and q[middle] not in rest[3]


def test_passages_of_50_short_words_are_found_to_their_ends(spark):
    rng = random.Random(4)
    say = lambda n, low=3, high=3: " ".join("".join(rng.choice("aeiouthnrsl") for _ in range(rng.randint(low, high))) for _ in range(n))
    docs, planted = [], {}
    for k in range(40):
        p = say(51)
        for i in (2 * k, 2 * k + 1):
            docs.append((i, f"{say(40, 2, 9)} {p} {say(40, 2, 9)}"))
            planted[i] = p
    docs += [(100 + i, f"{say(40, 2, 9)} {line} {say(40, 2, 9)}") for line in (say(30), say(35)) for i in range(2)]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.repeated_runs(df).collect()}
    assert set(got) == set(planted)
    assert all(planted[i] in docs[i][1].encode()[r.start : r.start + r.n_bytes].decode() for i, r in got.items())


def test_rows_that_share_an_identifier_keep_their_own_texts(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("aeiouthnrsl") for _ in range(rng.randint(2, 9))) for _ in range(n))
    a, b, alone = say(150), say(150), "unique " * 600
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (3, alone), (3, a), (None, a)], "doc_id long, text string")
    rows = substring_dedup.repeated_runs(df).where("doc_id = 3").collect()
    assert sorted((r.first_doc_id, r.n_bytes) for r in rows) == [(1, len(a)), (2, len(b))] and not any(r.kept for r in rows)
    rest = collections.Counter((r.doc_id, r.text) for r in substring_dedup.without_repeats(df).collect())
    assert rest == collections.Counter([(1, a), (2, b), (3, ""), (3, ""), (3, ""), (3, alone), (None, a)])


def test_repeats_inside_a_text_are_found_if_asked_for(spark):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("aeiouthnrsl") for _ in range(rng.randint(2, 9))) for _ in range(n))
    a, head = say(150), say(30)
    df = spark.createDataFrame([(1, f"{head} {a} {head[::-1]} {a} {a}")], "doc_id long, text string")
    assert substring_dedup.repeated_runs(df).count() == 0
    rest = substring_dedup.without_repeats(df, within=True).first().text
    assert rest.startswith(f"{head} {a} {head[::-1]}") and len(rest) < len(head) * 2 + len(a) + 250


def test_runs_equal_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("aeiouthnrslé") for _ in range(rng.randint(6, 9))) for _ in range(n))
    parts = [say(rng.randint(5, 120)) for _ in range(40)]
    docs = [(i, " ".join(rng.choice(parts) if rng.random() < 0.6 else say(30) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    held, cut = collections.defaultdict(set), {}
    for i, t in docs:
        data = t.encode()
        ends = substring_dedup.chunks(data)
        cut[i] = [(x, y, data[x:y]) for x, y in zip([0, *ends], ends)]
        for _, _, x in cut[i]:
            held[x].add(i)
    want = collections.defaultdict(list)
    for i, rows in cut.items():
        run = []
        for x, y, data in [*rows, (-1, -1, b"")]:
            if data and len(held[data]) > 1:
                run.append((x, y, min(held[data]) < i))
                continue
            if len(run) > 1:
                want[i].append((run[0][0], run[-1][1], len(run), any(e for _, _, e in run)))
            run = []
    got = collections.defaultdict(list)
    for r in substring_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.start, r.start + r.n_bytes, r.n_chunks, not r.kept))
    for i, runs in want.items():
        for x, y, n, later in runs:
            found = [g for g in got[i] if g[0] <= x and g[1] >= y and g[2:] == (n, later)]
            assert len(found) == 1 or y - x < substring_dedup.MIN_RUN and not found
    assert all(any(g[0] <= x and g[1] >= y and g[2:] == (n, later) for x, y, n, later in want[i]) for i, gs in got.items() for g in gs)
    assert sum(map(len, got.values())) > 50
