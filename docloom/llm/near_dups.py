"""Near-duplicate texts: covering groups of runs, prefixes inside them, bitmaps, then exact sets.

A text is the set of its runs of three words.  Runs are dealt into groups by their hash, the same way
for all texts.  Two sets are alike by s where they share s / (1 + s) of the sum of their sizes, so
in at least one group they share as much of what they have in it: the groups cover every pair within
the radius, as the masks of a covering family do.  (Masks over single coordinates can't: at one half
two sets differ in two thirds of a set's size, and their number doubles with each of these.)

Inside a group the sets that are so alike have their first common run, in any order of all
runs, among the first ones of either.  Texts are joined on those; the order puts frequent runs last.
Their counts come from a sample of texts, which decides how many candidates there are, never which
pairs are found.  With each row go the sizes and a bitmap of what the text has in the group: its
differing bits are never more than the runs that differ, so most pairs of no likeness end inside the
join.  The rest are compared by bitmaps of the whole sets, and those left by the sets, so no pair is
lost.

Texts with equal sets are one class with one representative, so copies never meet in the join.
Runs are joined as relations, with no cap on a run's texts and none gathered in a task; adaptive
execution splits hot ones.

Defined cases: null texts and those below LEAST_WORDS words have no near-duplicates; rows with one id
are one text, under the smallest number; a null id is an id of its own; texts of any length are
read whole; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, store
from .common import arrow_rows, bounded

SHINGLE, SIMILAR, LEAST_WORDS = 3, 0.5, 25
FIELDS = ("content", "description")
#: Runs in a group of a text of the mean size.  Texts beyond LONGER times the mean size have FINER times as many
#: groups, those beyond FINER times that size FINER times as many again, and so on.
GROUP, LONGER, FINER = 16, 4, 4
#: The most that a group's two sizes are told as.
MOST = 255
#: Runs for a word of 64 bits of a set's bitmap.
FOR_WORD = 32
#: Texts whose runs are counted for the order, and most runs told apart by their counts.
ORDERING, FREQUENT = 20_000, 200_000
CACHE = 500_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_runs(text: str) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    import re

    return re.findall(r"[^\W_]+", text.lower())


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[list[str]], table: WordHash) -> list[np.ndarray]:
    """Of each text of words, the sorted distinct hashes of its runs of SHINGLE words."""
    sizes = np.array(list(map(len, texts)), np.int64)
    w = _mixed(np.fromiter((table[x] for t in texts for x in t), np.uint64, int(sizes.sum())))
    n = max(0, len(w) - SHINGLE + 1)
    x = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        x = x * _MIX[0] + w[i : i + n]
    of = np.repeat(np.arange(len(texts)), sizes)
    inside = of[:n] == of[SHINGLE - 1 :][:n]
    x, of = x[inside], of[:n][inside]
    at = np.lexsort((x, of))
    x = x[at]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    x, of = x[new], of[new]
    return np.split(x, np.searchsorted(of, np.arange(1, len(texts)))) if texts else []


def _counter():
    table = WordHash()

    def step(b):
        spoken = [(f, w) for f, w in zip(b["field"], map(word_runs, b["text"])) if len(w) >= LEAST_WORDS]
        sets = list(zip([f for f, _ in spoken], shingle_sets([w for _, w in spoken], table)))
        runs, n = np.unique(np.concatenate([x for _, x in sets]), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        runs, n = runs[n > 1], n[n > 1]
        of = [[len(x) for g, x in sets if g == f] for f in FIELDS]
        return {
            "field": [None] * len(runs) + list(FIELDS),
            "run": [*runs.view(np.int64).tolist(), *map(sum, of)],
            "n": [*n.tolist(), *map(len, of)],
        }

    return step


def ordering(fields: DataFrame, sample: int = ORDERING, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """From about sample texts: the runs met twice or more in a batch, sorted, the most frequent only, with their counts; the mean number of runs of each field's texts."""
    k = max(1, -(-fields.count() // sample))
    some = fields.where(F.pmod(F.xxhash64(F.lit("order"), "field", "elem_no"), F.lit(k)) == 0).select("field", "text")
    counted = arrow_rows(some, "field string, run long, n long", _counter)
    runs = counted.where("field IS NULL").groupBy("run").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "run").limit(most).toPandas()
    at = (hashes := runs["run"].to_numpy(np.int64).view(np.uint64)).argsort()
    sizes = {r["field"]: r["runs"] / max(1, r["texts"]) for r in counted.where("field IS NOT NULL").groupBy("field").agg(F.sum("run").alias("runs"), F.sum("n").alias("texts")).collect()}
    return hashes[at], runs["n"].to_numpy(np.int64)[at], [max(1.0, sizes.get(f, 0)) for f in FIELDS]


def grades(size: int, mean: float, similar: float) -> list[int]:
    """The grades of sizes in which a set of this size meets others: that of the larger of the two, so some sets have two."""
    grade, ends = 0, LONGER * mean
    while size >= ends:
        grade, ends = grade + 1, ends * FINER
    out = [grade]
    while size >= (similar - 1e-9) * ends:
        grade, ends = grade + 1, ends * FINER
        out.append(grade)
    return out


def prefixes(sets: list[np.ndarray], codes: list[int], order: tuple[np.ndarray, np.ndarray, list[float]], similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of rows of each set, key, size, map) of the rows that sets of runs are joined on.

    codes has the number of each set's field.  A key is 32 bits of the run's hash; a size tells how many runs the
    set has in the run's group, and how many of them come from this one on, both MOST at most; a map is
    the bitmap of those in the group.
    """
    known, counts, means = order
    each = [(i, g) for i, (s, c) in enumerate(zip(sets, codes)) for g in grades(len(s), means[c], similar)]
    x = np.concatenate([sets[i] for i, _ in each])
    sizes = np.array([len(sets[i]) for i, _ in each])
    of = np.repeat(np.arange(len(each)), sizes)
    n = np.zeros(len(x), np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        n = np.where(known[at] == x, counts[at], 0).astype(np.uint64)
    own = _mixed(x)
    k = np.array([max(1, round(means[codes[i]] / GROUP)) * FINER**g for i, g in each], np.uint64)
    kind = np.array([codes[i] + len(FIELDS) * g for i, g in each], np.uint64)
    group = of.astype(np.uint64) * k.max() + (own >> np.uint64(20)) % k[of]
    # by group, then count, then hash: sets are sorted
    at = np.argsort((group << np.uint64(20)) | np.minimum(n, np.uint64(0xFFFFF)), kind="stable")
    own, group, of = own[at], group[at], of[at]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(own)))
    bitmap = np.bitwise_or.reduceat(np.uint64(1) << (own & np.uint64(63)), first)
    place = np.arange(len(own)) - np.repeat(first, size)
    early = place < np.repeat(size - np.ceil((similar - 1e-9) * size).astype(np.int64) + 1, size)
    size_of = np.repeat(size, size)[early]
    told = np.minimum(size_of, MOST) << 8 | np.minimum(size_of - place[early], MOST)
    key = (_mixed(own[early] + kind[of[early]]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    rows = np.bincount(np.array([i for i, _ in each])[of[early]], minlength=len(sets))
    return rows, key, told.astype(np.int32), np.repeat(bitmap, size)[early].view(np.int64)


def bitmaps(sets: list[np.ndarray]) -> pa.Array:
    """A bitmap of each set's runs: a power of two of words, in proportion to the set."""
    words = np.array([1 << ((len(s) - 1) // FOR_WORD).bit_length() for s in sets])
    ends = np.concatenate(([0], np.cumsum(words)))
    hashed = _mixed(np.concatenate(sets))
    sizes = [len(s) for s in sets]
    at = np.repeat(ends[:-1], sizes) + ((hashed >> np.uint64(6)) % np.repeat(words, sizes).astype(np.uint64)).astype(np.int64)
    out = np.zeros(ends[-1], np.uint64)
    np.bitwise_or.at(out, at, np.uint64(1) << (hashed & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.view(np.int64)))


_SKETCH = pa.schema(
    [("elem_no", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64()), ("field", pa.string()), ("h1", pa.int64()), ("h2", pa.int64())]
    + [("bitmap", pa.list_(pa.int64())), ("n", pa.int32()), ("keys", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("maps", pa.list_(pa.int64()))]
)


def sketches(fields: DataFrame, similar: float) -> DataFrame:
    """(elem_no, id1, id2, field, h1, h2, bitmap, n, keys, sizes, maps) of the texts long enough; fields has elem_no, id, field, text."""
    ship(fields.sparkSession)
    order = fields.sparkSession.sparkContext.broadcast(ordering(fields))
    own = F.coalesce("id", F.concat(F.lit("row "), F.col("elem_no")))
    rows = fields.select("elem_no", F.xxhash64(own).alias("id1"), F.xxhash64(F.lit(1), own).alias("id2"), "field", "text").where(F.length("text") >= 2 * LEAST_WORDS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for b in batches:
            if len(table) > CACHE:
                table.clear()
            spoken = [word_runs(t) for t in b.column("text").to_pylist()]
            kept = [i for i, w in enumerate(spoken) if len(w) >= LEAST_WORDS]
            if not kept:
                continue
            sets = shingle_sets([spoken[i] for i in kept], table)
            b = b.take(pa.array(kept))
            hashed = _mixed(np.concatenate(sets))
            sizes = [len(s) for s in sets]
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            n, *lists = prefixes(sets, [FIELDS.index(f) for f in b.column("field").to_pylist()], order.value, similar)
            ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in ("elem_no", "id1", "id2", "field")),
                    pa.array(np.add.reduceat(hashed, at).view(np.int64)),
                    pa.array(np.bitwise_xor.reduceat(_mixed(hashed + _MIX[0]), at).view(np.int64)),
                    bitmaps(sets),
                    pa.array(sizes, pa.int32()),
                    *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists),
                ],
                schema=_SKETCH,
            )

    return rows.mapInArrow(run, "elem_no long, id1 long, id2 long, field string, h1 long, h2 long, bitmap array<long>, n int, keys array<int>, sizes array<int>, maps array<long>")


def node(field: str, elem_no: str) -> Column:
    """One number for a field of an element."""
    code = F.array_position(F.array(*map(F.lit, FIELDS)), F.col(field)) - 1
    return F.col(elem_no) * len(FIELDS) + code


def number(c: str) -> Column:
    """The element's number of a node."""
    return F.expr(f"({c} - pmod({c}, {len(FIELDS)})) div {len(FIELDS)}").alias(c)


def candidates(sets: DataFrame, similar: float) -> DataFrame:
    """(a, b), a < b: distinct representatives (node, keys, sizes, maps) of one field that may be alike by similar.

    Every pair that is comes out: some group covers it.  Pairs come hashed by a.
    """
    key = (F.col("key").cast("long") * (1 << 16) + F.col("size")).alias("key")
    rows = sets.select("node", F.inline(F.arrays_zip("keys", "sizes", "maps"))).toDF("node", "key", "size", "map").select("node", key, "map")
    x, y = rows.alias("x"), rows.alias("y")
    size, left = (lambda s: F.expr(f"(shiftright({s}.key, 8) & {MOST})")), (lambda s: F.expr(f"({s}.key & {MOST})"))
    total, least = size("x") + size("y"), similar - 1e-9
    enough = F.least(left("x"), left("y")) * (1 + least) >= least * total
    near = F.bit_count(F.expr("x.map ^ y.map")) * (1 + least) <= (1 - least) * total
    told = (size("x") < MOST) & (size("y") < MOST)
    one_field = F.expr(f"pmod(x.node - y.node, {len(FIELDS)})") == 0
    one_run = F.shiftright("x.key", 16) == F.shiftright("y.key", 16)
    pairs = x.join(y, one_run & ((near & enough) | ~told) & (F.col("x.node") < F.col("y.node")) & one_field)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).repartition("a").distinct()


def differing(a: str, b: str) -> Column:
    """Number of bits in which two bitmaps differ, the longer one folded to the length of the other."""
    words = F.least(F.size(a), F.size(b))
    folded = lambda c: F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(F.transform(F.sequence(i, F.size(c) - 1, words), lambda j: F.get(c, j)), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)))
    count = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return F.when(F.size(a) == F.size(b), count(F.col(a), F.col(b))).otherwise(count(folded(a), folded(b)))


def _comparer():
    def step(b):
        got, sets, table = [], {}, WordHash()
        for x, y in zip(b["text_a"], b["text_b"]):
            p, q = (sets.get(t) if t in sets else sets.setdefault(t, _runs(t)) for t in (x, y))
            if len(sets) > 20_000:
                sets.clear()
            both = len(p & q)
            got.append(both / max(1, len(p) + len(q) - both))
        return {"field": b["field"], "a": b["a"], "b": b["b"], "similarity": got}

    return step


def _runs(text: str) -> frozenset:
    w = word_runs(text)
    return frozenset(zip(w, w[1:], w[2:]))


def similar_pairs(fields: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (field, a, b, similarity), and members (field, rep, elem_no).

    fields (elem_no, id, field, text) is read twice: for the sets, and for the texts of the candidates.
    """
    group = ["field", "h1", "h2"]
    rows = store(sketches(fields, similar))
    narrow = rows.select(*group, "id1", "id2", "elem_no")
    classed = store(narrow.join(narrow.groupBy(*group).agg(F.min("elem_no").alias("rep")), group).select("field", "rep", "id1", "id2", "elem_no"))
    members = classed.groupBy("field", "rep", "id1", "id2").agg(F.min("elem_no").alias("elem_no")).select("field", "rep", "elem_no")
    # rows that are not their class's first: only these leave the join, so nothing else is shuffled for it
    copies = classed.where("elem_no > rep").select(node("field", "elem_no").alias("node"))
    reps = rows.withColumn("node", node("field", "elem_no")).join(bounded(copies), "node", "left_anti")
    met = candidates(reps, similar)
    a, b = (reps.select(F.col("node").alias(c), F.col("bitmap").alias(f"bitmap_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    least = similar - 1e-9
    alike = differing("bitmap_a", "bitmap_b") * (1 + least) <= (1 - least) * (F.col("n_a") + F.col("n_b"))
    near = cut(met.join(a, "a").join(b, "b").where(alike).select(F.element_at(F.array(*map(F.lit, FIELDS)), F.pmod("a", F.lit(len(FIELDS))).cast("int") + 1).alias("field"), number("a"), number("b")))
    ends = bounded(near.select("field", F.explode(F.array("a", "b")).alias("elem_no")).distinct())
    texts = store(fields.select("field", "elem_no", "text").join(ends, ["field", "elem_no"]).dropDuplicates(["field", "elem_no"]))
    both = near.join(texts.select("field", F.col("elem_no").alias("a"), F.col("text").alias("text_a")), ["field", "a"]).join(
        texts.select("field", F.col("elem_no").alias("b"), F.col("text").alias("text_b")), ["field", "b"]
    )
    exact = arrow_rows(both.select("field", "a", "b", "text_a", "text_b"), "field string, a long, b long, similarity double", _comparer)
    return exact.where(F.col("similarity") >= similar), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(field, elem_a, elem_b), elem_a < elem_b: every pair of texts, copies with one another among them."""
    x = members.select("field", F.col("rep").alias("a"), F.col("elem_no").alias("one"))
    y = members.select("field", F.col("rep").alias("b"), F.col("elem_no").alias("two"))
    across = pairs.select("field", "a", "b").join(x, ["field", "a"]).join(y, ["field", "b"])
    more = members.groupBy("field", "rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("field", F.col("rep").alias("a"))
    inside = x.join(more, ["field", "a"]).join(y.withColumnRenamed("b", "a"), ["field", "a"]).where("one < two")
    both = across.select("field", "one", "two").unionByName(inside.select("field", "one", "two"))
    return both.select("field", F.least("one", "two").alias("elem_a"), F.greatest("one", "two").alias("elem_b"))
