"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its word shingles.  Two sets can only reach the threshold
if they share one of the first few elements in an order common to all: its prefix.  Elements
are ordered by rarity, as estimated by a counter array of fixed size over all documents, so
wide-spread passages stay out of prefixes.

1. Documents with equal sets are one class; classes with equal prefix and size are one group.
2. Groups are listed by prefix element.  Lists with two groups or more are what is left to do.
   Pairs are filtered by size, position and element counts before their sets are fetched.
3. In each list and group, every entry is verified against one: the one with fewest rarer elements.  In large groups of
   near copies this links nearly all, with as many pairs as entries.
4. What must still be verified are pairs of different components in one list: group pairs
   that pass the size and position filters are expanded to members and verified.  Pairs inside a
   component can't change the result.  A list's largest component is never paired with itself.

The components found are those of all links.  Nothing about documents comes to the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from corpusloom.llm.common import pick, rows_of, small_batches, with_row
from corpusloom.llm.fixed import merged
from corpusloom.llm.graph import components
from corpusloom.llm.pieces import mixed, prefix_sums, slices, tidy
from corpusloom.sources.scratch import staged

#: Counters of the rarity estimate, and slots of the filter on candidates' identifiers.
COUNTERS, ID_SLOTS = 1 << 20, 1 << 20
#: Counts by which pairs are filtered before their sets are fetched, and the largest count held.
SPREAD, FULL = 256, 255
#: An element is frequent from this share of documents on; its list has more entries than one, which needs no counting.
FREQUENT = 0.001
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_CODES = mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words, A-Z lower-cased."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for index, part in slices(texts):
        coded = [t.encode("utf-8", "surrogatepass") for t in part]
        data = np.frombuffer(b"\n".join([*coded, b""]).translate(_UPPER), np.uint8)
        edge = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums, inverse = prefix_sums(_CODES[data])
        words = mixed((sums[e] - sums[s]) * inverse[s])
        ends = np.cumsum([len(c) + 1 for c in coded])
        cuts = np.searchsorted(s, ends)
        for k, a, b in zip(index, [0, *cuts[:-1]], cuts, strict=True):
            out[k].append(words[a:b])
    return [np.concatenate(x) if len(x) != 1 else x[0] for x in out] if texts else []


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``n``-word shingles; of all its words if there are fewer."""
    out = []
    for words in word_hashes([t or "" for t in texts]):
        k = len(words)
        if k == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        m = min(n, k)
        h = np.full(k - m + 1, m, np.uint64)
        for i in range(m):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : k - m + 1 + i])
        out.append(np.unique(h))
    return out


def _batches(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _described(d: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, digest, group, prefix, frequent, spread) of each document; prefix is rarest first, spread counts elements by their first byte."""

    def count(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in _batches([batch]):
            sets = shingle_sets(part.column("text").to_pylist(), n)
            total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)

    spark = d.sparkSession
    counters = merged(d.select("text"), COUNTERS, np.uint32, count)
    rare = spark.sparkContext.broadcast(counters)  # COUNTERS numbers
    level = int(counters.mean() * 2 + max(200, FREQUENT * d.count()))

    def run(batches):
        order = rare.value
        for part in _batches(batches):
            size, digest, group, prefix, frequent, spread = [], [], [], [], [], []
            for x in shingle_sets(part.column("text").to_pylist(), n):
                k = len(x)
                size.append(k)
                digest.append(xxhash.xxh3_128_digest(x.tobytes()))
                seen = order[(x & np.uint64(COUNTERS - 1)).astype(np.int64)]
                p = k + (-num * k // den) + 1 if k else 0  # k - ceil(k * num / den) + 1
                first = np.lexsort((x, seen))[:p]
                head = x[first]
                group.append(xxhash.xxh3_128_digest(head.tobytes() + k.to_bytes(8, "little")))
                prefix.append(head.view(np.int64))
                frequent.append(int(np.count_nonzero(seen[first] >= level)))
                spread.append(np.minimum(np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=SPREAD), FULL).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.binary()), "group": pa.array(group, pa.binary()),
                "prefix": pa.array(prefix, pa.list_(pa.int64())), "frequent": pa.array(frequent, pa.int32()), "spread": pa.array(spread, pa.binary()),
            })

    schema = d.select("doc_id").schema.add("n", "long").add("digest", "binary").add("group", "binary").add("prefix", ArrayType(LongType())).add("frequent", "integer").add("spread", "binary")
    return d.mapInArrow(tidy(run), schema)


def _sets(d: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(digest, elements) of the classes in ``ids`` (digest, doc_id); a filter of fixed size spares shuffling the other texts.

    Rows may share an identifier and differ in text, so a class's set is known by its digest.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(ID_SLOTS)).cast("int")

    def mark(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total[batch.column("slot").to_numpy()] = 1

    marks = merged(ids.select(slot.alias("slot")), ID_SLOTS, np.uint8, mark)
    shared = d.sparkSession.sparkContext.broadcast(marks > 0)

    def run(batches):
        for part in _batches(batches):
            part = part.filter(pa.array(shared.value[part.column("slot").to_numpy()]))
            sets = shingle_sets(part.column("text").to_pylist(), n)
            raw = [x.tobytes() for x in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "digest": pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), "elements": pa.array(raw, pa.binary())})

    out = d.withColumn("slot", slot).mapInArrow(tidy(run), d.select("doc_id").schema.add("digest", "binary").add("elements", "binary"))
    return out.join(ids, ["doc_id", "digest"], "left_semi").select("digest", "elements").dropDuplicates(["digest"])


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of classes whose sets may reach the threshold, as counts by first byte bound the intersection."""

    def run(batches):
        for part in _batches(batches):
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, SPREAD) for c in ("x", "y"))
            sizes = part.column("na").to_numpy() + part.column("nb").to_numpy()
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            may = ((num + den) * most >= num * sizes) | (np.minimum(x, y).max(axis=1) == FULL)
            yield part.select(["a", "b"]).filter(pa.array(may))

    left, right = (classes.select(F.col("digest").alias(i), F.col("spread").alias(v), F.col("n").alias(c)) for i, v, c in (("a", "x", "na"), ("b", "y", "nb")))
    both = pairs.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b")
    return staged(both.select("a", "b", "x", "y", "na", "nb").mapInArrow(tidy(run), pairs.select("a", "b").schema), "join-near")


def _verified(d: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, as a written table."""
    if pairs.isEmpty():
        return pairs
    pairs = _near(pairs, classes, num, den)
    ids = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    ids = staged(ids.join(classes.select("digest", F.col("rep").alias("doc_id")), "digest"), "join-ids")
    sets = staged(_sets(d, ids, n), "join-elements")

    def run(batches):
        for part in _batches(batches, 256):
            x, y = part.column("x"), part.column("y")
            good = np.zeros(part.num_rows, bool)
            for k in range(part.num_rows):
                p, q = np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)
                z = np.concatenate([p, q])
                z.sort(kind="stable")  # two sorted runs
                common = int(np.count_nonzero(z[1:] == z[:-1]))
                good[k] = den * common >= num * (len(z) - common)
            yield part.select(["a", "b"]).filter(pa.array(good))

    left, right = sets.select(F.col("digest").alias("a"), F.col("elements").alias("x")), sets.select(F.col("digest").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b")
    return staged(both.select("a", "b", "x", "y").mapInArrow(tidy(run), pairs.select("a", "b").schema), "join-links")


def _possible(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Size and position filter of two entries of one list."""
    need = F.ceil(F.lit(num) * (n1 + n2) / F.lit(num + den) - F.lit(1e-9))
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (F.least(n1 - p1, n2 - p2) >= need)


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, links_verified.

    Two documents link when ``den`` * intersection >= ``num`` * union of their sets of ``n``-word shingles
    (A-Z lower-cased).  A null, empty or blank text has an empty set and links with
    nothing.  ``component_id`` is the smallest doc_id reachable by links; ``links_verified`` counts the links between
    classes of equal sets that were looked up at the document's class: enough to connect its component, not all there are.
    Rows with the same doc_id are one document: each has its own set, and a link of any of them reaches all.  Rows without
    one link with nothing and get no component.  Texts of any length are taken whole, an empty table gives an empty
    result, further columns are ignored.
    """
    d = small_batches(pick(docs, doc_id=id_col, text=text_col)).select("doc_id", F.col("text").cast("string").alias("text"))
    a = staged(_described(d, n, num, den), "join-sets")
    real = a.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    small = real.select("doc_id", "n", "digest", "group")
    # A class is known by the digest of its set, a group by the least digest of its classes.
    classes = small.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("group").alias("group"))
    groups = small.groupBy("group").agg(F.min("digest").alias("gid"), F.max("digest").alias("d2"))
    m = staged(classes.join(groups, "group").select("digest", "rep", "n", "gid", (F.col("gid") != F.col("d2")).alias("many")), "join-classes")
    described = real.join(m.select("digest", F.col("rep").alias("doc_id"), "rep"), ["digest", "doc_id"]).dropDuplicates(["digest"])
    heads = real.join(m.where("digest = gid").select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])

    # Lists with more than one entry.
    entry = heads.select(F.col("digest").alias("gid"), "n", F.size("prefix").alias("len"), "frequent", F.posexplode("prefix").alias("pos", "token"))
    entry = entry.withColumn("place", F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("pos").cast("long")))  # one column is a third less to shuffle
    often = F.col("pos") >= F.col("len") - F.col("frequent")
    near = Window.partitionBy("token").orderBy("gid").rowsBetween(-1, 1)
    lists = entry.where(~often).select("token", "gid", "place").withColumn("about", F.count("*").over(near)).where("about > 1").drop("about")
    lists = staged(lists.union(entry.where(often).select("token", "gid", "place")), "join-lists")
    lists = lists.select("token", "gid", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND((1 << 32) - 1).alias("pos"))

    reps = m.select(F.col("digest").alias("rep"), "gid", "n", "many")
    pivots = lists.groupBy("token").agg(F.min(F.struct("pos", "gid", "n")).alias("p"))  # the least rare elements of its own: the likeliest origin of copies
    star = lists.join(pivots.hint("shuffle_merge"), "token").where(_possible(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), num, den)).select(F.col("p.gid").alias("g"), "gid")
    star = star.union(reps.where("many").select("gid", "rep"))
    star = staged(_ordered(star.toDF("g", "h"), "g", "h"), "join-star")
    links = _verified(d, described, star, n, num, den)
    comp = components(links)

    # Entries by group and component; a group whose members are in several components is a list, too.
    listed = lists.select("gid").distinct().withColumn("listed", F.lit(True))
    open_reps = reps.join(listed, "gid", "left").where("many or listed").select("rep", "gid")
    unit_of = open_reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "gid", F.coalesce("component", "rep").alias("comp"))
    unit_of = staged(unit_of, "join-units")
    units = unit_of.groupBy("gid", "comp").agg(F.min("rep").alias("unit"))
    by_token = lists.join(units, "gid").select(F.lit(0).alias("kind"), F.col("token").alias("key"), "unit", "comp", "n", "pos")
    sizes = m.groupBy("gid").agg(F.first("n").alias("n"))
    by_group = units.join(sizes, "gid").select(F.lit(1).alias("kind"), F.xxhash64("gid").alias("key"), "unit", "comp", "n", F.lit(0).cast("long").alias("pos"))
    rows = by_token.unionByName(by_group)
    counts = rows.groupBy("kind", "key", "comp").agg(F.count("*").alias("rows"))
    mixed_keys = counts.groupBy("kind", "key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1").select("kind", "key", "largest")
    rows = staged(rows.join(mixed_keys.hint("shuffle_merge"), ["kind", "key"]), "join-rest")
    x, y = rows.where("comp <> largest").alias("x"), rows.alias("y")
    fits = _possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
    on = (F.col("x.kind") == F.col("y.kind")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & fits
    pairs = _ordered(x.join(y.hint("shuffle_merge"), on).select(F.col("x.unit").alias("u"), F.col("y.unit").alias("v")), "u", "v")
    member = unit_of.join(units, ["gid", "comp"]).select("unit", "rep")
    pairs = pairs.join(member.select(F.col("unit").alias("a"), F.col("rep").alias("ra")), "a").join(member.select(F.col("unit").alias("b"), F.col("rep").alias("rb")), "b")
    pairs = _ordered(pairs, "ra", "rb")
    more = _verified(d, described, staged(pairs, "join-pairs"), n, num, den)
    if not more.isEmpty():
        links = links.union(more)
        comp = components(links)
    ends = links.select(F.col("a").alias("digest")).union(links.select(F.col("b").alias("digest"))).groupBy("digest").agg(F.count("*").alias("links_verified"))
    named = reduce(lambda p, q: p.join(q, "digest", "left"), [m.select("digest", "rep"), comp.withColumnRenamed("node", "digest"), ends])
    named = named.select("digest", "rep", F.coalesce("component", "digest").alias("component"), "links_verified")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    found = staged(small.select("doc_id", "digest").distinct().join(named.join(least, "component").select("digest", "least", "links_verified"), "digest"), "join-found")
    found = found.groupBy("doc_id").agg(F.min("least").alias("component_id"), F.max("least").alias("last"), F.max("links_verified").alias("links_verified"))
    found = staged(found, "join-documents")
    # A document with several texts unites the components that these are in.
    across = found.where("component_id <> last").select("doc_id")
    if not across.isEmpty():
        parts = small.select("doc_id", "digest").join(across, "doc_id").join(named.join(least, "component").select("digest", "least"), "digest")
        bridges = parts.join(found.select("doc_id", "component_id"), "doc_id").select(F.col("least").alias("a"), F.col("component_id").alias("b"))
        united = components(bridges).select(F.col("node").alias("component_id"), F.col("component").alias("united"))
        found = found.join(united, "component_id", "left").select("doc_id", F.coalesce("united", "component_id").alias("component_id"), "links_verified")
    out = a.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links_verified", F.lit(0)).cast("long").alias("links_verified"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller identifier; all columns stay.

    Rows without identifier stay, and so do null, empty and blank texts; repeated rows stay or go together.  An empty
    table gives an empty result.
    """
    gone = jaccard_components(docs, n, num, den, id_col, text_col).where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct()
    return rows_of(with_row(docs, doc_id=id_col).join(staged(gone, "join-gone"), F.col("doc_id") == F.col("gone"), "left_anti"), docs.columns)
