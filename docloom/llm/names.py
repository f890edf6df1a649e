"""Variant spellings of names linked to the entities they mean.

Distinct names and registered names become unit vectors of the character n-grams that registered names have, hashed
into BUCKETS and weighted by inverse document frequency over all distinct names.  The sparse product of names and
registered names is computed by tiles, and every pair of a cosine of AT_LEAST or more comes out of it.  Each pair
is then checked word by word: order, initials, abbreviations, nicknames, titles, legal forms,
acronyms and a few mistyped letters may differ, a different word may not.  A name keeps the TOP
entities by cosine of those that it can be read as.

What is left is grouped by average linkage around the registered names (to_entities): names that read as
one entity only, or as one at clearly the least cost, make its cluster; any other name goes to the
cluster, of those it reads as at nearly the least cost, with whose members its mean cosine is highest,
and to none where two are equally near.  Names that mean no registered entity are joined with each
other as relations (similar_names): two vectors of a cosine of VARIANTS or more have their first common n-gram, rare
ones first, before the point from which on the rest of either is shorter than that, so only n-grams before it
are joined on, and no pair is lost.  They are grouped by average linkage from single names upwards
(average_linkage).

Nicknames are learned from names that give both (`Robert "Bob" ...`).

Defined cases: null, empty and blank names link to nothing; a name equal to a registered one is no
variant; registered names that are repeated count once, with the smallest number; empty tables
give no links; repeated rows are each linked.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, ship
from .common import arrow_rows, letters_digits, tasks

GRAM, TOP, AT_LEAST = 3, 12, 0.3
#: Costs of reading that differ by less are nearly equal.
NEARLY = 0.15
#: Cosine of names, and mean cosine of clusters, from which on they are variants of one another.
VARIANTS = 0.7
#: Names of a block on either side of a tile.
TILE = 20_000
#: Buckets of hashed n-grams, which bounds what is broadcast of their frequencies; most pairs of nicknames learned.
BUCKETS, NICKNAMES = 1 << 18, 200_000
#: Titles, and words that link others.
TITLES = frozenset("mr mrs ms miss dr prof professor ing sir dame herr frau señor señora sr sra srta dra monsieur madame m mme signor signora dott rev hon the".split())
LINKS = frozenset("for of and the f de del der des du da di et und y e".split())
#: Legal forms and their long forms, without points and spaces.
LEGAL = {
    "plc": "plc", "publiclimitedcompany": "plc", "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "gmbh": "gmbh",
    "gesellschaftmitbeschränkterhaftung": "gmbh", "sa": "sa", "sociedadanónima": "sa", "sociedadanonima": "sa", "sociétéanonyme": "sa", "societeanonyme": "sa",
    "sociedadeanónima": "sa", "llc": "llc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?\.?")
_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.casefold().translate(_FOLD))
    return "".join(c for c in t if not unicodedata.combining(c))


def words(name: str) -> tuple[list[str], str | None]:
    """Folded words (abbreviations keep their point) without titles and links, and the legal form."""
    t = fold(name).replace("&", " and ").replace('"', " ").replace("“", " ").replace("”", " ")
    found = _WORD.findall(t)
    legal = None
    for k in (4, 3, 2, 1):
        tail = "".join(w.rstrip(".") for w in found[-k:])
        if len(found) > k and tail in LEGAL and (k == 1 or len(tail) <= k or tail not in ("sa",)):
            legal, found = LEGAL[tail], found[:-k]
            break
    out = [w for w in found if w.rstrip(".") not in TITLES or (w.rstrip(".") == "m" and len(found) < 4)]
    return [w for w in out if len(w.rstrip(".")) == 1 or w.rstrip(".") not in LINKS], legal


def acronym(name: str) -> str | None:
    """The letters of a name that is an acronym."""
    letters = re.sub(r"[.\s]", "", name.strip())
    return letters if 3 <= len(letters) <= 7 and letters.isalpha() and letters.isupper() and not re.search(r"[^\W\d_]{2}\.|\s[^\W\d_]{2}", name) else None


def acronyms(name: str) -> set[str]:
    """Acronyms that a registered organisation may have."""
    if len(_WORD.findall(name)) < 3:
        return set()
    own, legal = words(name)
    plain = "".join(w[0] for w in own).upper()
    every = "".join(w[0] for w in _WORD.findall(fold(name)) if w not in ("the", "and")).upper()
    found = {plain, every} | ({plain + legal[0].upper(), plain + legal.upper()} if legal else set())
    return {a for a in found if len(a) >= 3}


def edits(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between a and b; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _short(a: str, full: str) -> bool:
    """Whether a is an abbreviation of full: its letters in order from the first one on."""
    if not a or a[0] != full[0] or len(a) >= len(full):
        return False
    rest = iter(full)
    return all(c in rest for c in a)


def _cost(word: str, full: str, person: bool, last: bool, nick: dict[str, set[str]]) -> float | None:
    """Cost of reading word as the registered word full; None where it can't be."""
    bare = word.rstrip(".")
    if bare == full:
        return 0.0
    if person and not last:
        if len(bare) == 1:
            return 0.2 if bare == full[0] else None
        if full in nick.get(bare, ()):
            return 0.2
    if not person and _short(bare, full) and (word.endswith(".") or len(bare) <= max(1, len(full) * 3 // 4)):
        return 0.3
    least = min(len(bare), len(full))
    most = 0 if least < 3 else 1 if least < 5 else 2 if least < 12 else 3
    if not most or len(full) == 1:
        return None
    n = edits(bare, full, most)
    return float(n) if n <= most else None


def reading(name: str, registered: str, person: bool, nick: dict[str, set[str]]) -> float | None:
    """Cost of reading name as the registered name, None where some word of it can't be read so."""
    short = acronym(name)
    if short and not person:
        return 0.5 if short in acronyms(registered) else None
    own, legal = words(name)
    full, own_legal = words(registered)
    full = [w.rstrip(".") for w in full]
    if not person:
        own = [w for w in own if w.rstrip(".") not in LINKS]
    if not own or not full:
        return None
    if person:
        if legal:
            return None
    elif legal and own_legal and legal != own_legal:
        return None
    last = len(full) - 1
    used: set[int] = set()
    total = 0.0
    wait = []
    for w in sorted(own, key=len, reverse=True):
        best = None
        for i, f in enumerate(full):
            if i in used:
                continue
            c = _cost(w, f, person, i == last, nick)
            if c is not None and (best is None or c < best[0]):
                best = c, i
        if best is None:
            wait.append(w)
        else:
            total += best[0]
            used.add(best[1])
    for w in wait:
        # a nickname may stand beside the name it is for
        if not (person and 0 in used and len(w) > 1 and (full[0] in nick.get(w.rstrip("."), ()) or full[0].startswith(w.rstrip(".")[:3]) and f'"' in name)):
            return None
    if person:
        if last not in used:
            return None
        missing = [i for i in range(last) if i not in used]
        total += 0.5 if 0 in missing and last > 0 else 0.0
        total += 0.1 * len([i for i in missing if i])
        if 0 in missing and any(i in used for i in range(1, last)):
            return None
    elif len(used) < len(full):
        return None
    return total if total <= 4.0 else None


def grams(name: str, nick: dict[str, set[str]]) -> list[str]:
    """Distinct character n-grams of the words, in any order, and of full given names; of an acronym itself."""
    short = acronym(name)
    if short:
        return [f"={short}"]
    out: set[str] = set()
    bare = [w.rstrip(".") for w in words(name)[0]]
    for w in bare + [g for w in bare for g in sorted(nick.get(w, ()))]:
        p = f"^{w}$"
        out |= {p[i : i + GRAM] for i in range(max(1, len(p) - GRAM + 1))}
    return sorted(out)


def nicknames(names: DataFrame) -> DataFrame:
    """(nick, given, n) from names with a nickname in quotes, counted over all distinct names; pairs seen once only are left out."""
    pattern = r'^(?:\S+\.? )?(\p{L}+)[^"“]*["“](\p{L}+)["”]'
    got = names.select(F.regexp_extract("name", pattern, 1).alias("given"), F.regexp_extract("name", pattern, 2).alias("nick")).where("nick <> ''")
    return got.groupBy("nick", "given").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bucket(gram: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(gram) % BUCKETS


def vector(form: list[str], idf: np.ndarray) -> dict[int, float]:
    """Unit vector of n-grams, the rarest first; n-grams that no name has are left out."""
    own = sorted({b for b in map(bucket, form) if idf[b] > 0}, key=lambda b: (-idf[b], b))
    norm = float(np.sqrt(sum(idf[b] ** 2 for b in own)))
    return {b: float(idf[b]) / norm for b in own}  # empty where no n-gram is left


def early(v: dict[int, float], at_least: float) -> list[int]:
    """Buckets of a vector up to where the rest of it is shorter than at_least."""
    rest, out = 1.0, []
    for b, w in v.items():
        if rest < max(0.0, at_least - 1e-9) ** 2:
            break
        out.append(b)
        rest -= w * w
    return out


def cosine(u: dict[int, float], v: dict[int, float]) -> float:
    return sum(w * v[b] for b, w in u.items() if b in v)


class Frequencies:
    """Weights of n-grams, and the nicknames that names are spelled with: what all tasks share."""

    def __init__(self, names: DataFrame):
        """names (name) are distinct."""
        found = nicknames(names).orderBy(F.desc("n"), "nick", "given").limit(NICKNAMES).collect()
        self.nick: dict[str, set[str]] = {}
        for p in found:
            self.nick.setdefault(fold(p["nick"]), set()).add(fold(p["given"]))
        nick = self.nick

        def counter():
            def step(b):
                n = np.bincount([k for name in b["name"] for k in {bucket(g) for g in grams(name, nick)}] or [0], minlength=1)
                at = np.flatnonzero(n)
                return {"bucket": at, "n": n[at]} if b["name"] else {"bucket": [], "n": []}

            return step

        # one row a bucket at most
        rows = arrow_rows(names, "bucket int, n long", counter).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        n_names = names.count()
        df = np.zeros(BUCKETS)
        df[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
        self.idf = np.where(df > 0, np.log1p(n_names / np.maximum(df, 1)), 0.0)

    def of(self, name: str) -> dict[int, float]:
        return vector(grams(name, self.nick), self.idf)

    def only(self, buckets: list[int]) -> Frequencies:
        """The same with the n-grams of these buckets alone."""
        out = copy(self)
        out.idf = np.zeros_like(self.idf)
        out.idf[buckets] = self.idf[buckets]
        return out

    def forms(self, registered: str) -> list[dict[int, float]]:
        """A registered name has a vector of its own and one for each acronym."""
        return [self.of(registered), *(vector([f"={a}"], self.idf) for a in sorted(acronyms(registered)))]


def _placed(names: DataFrame, shared, at_least: float, keep: str, registered: bool = False) -> DataFrame:
    """The columns `keep` (name among them) and bucket: a row for each n-gram that a name is joined on."""
    columns = [c.split()[0] for c in keep.split(", ")]

    def make():
        f = shared.value

        def step(b):
            out: dict[str, list] = {k: [] for k in (*columns, "bucket")}
            for i, name in enumerate(b["name"]):
                vectors = f.forms(name) if registered else [f.of(name)]
                own = sorted({k for v in vectors for k in early(v, at_least)})
                for c in columns:
                    out[c] += [b[c][i]] * len(own)
                out["bucket"] += own
            return out

        return step

    return arrow_rows(names.select(*columns), f"{keep}, bucket int", make)


def link_names(texts: DataFrame, registry: DataFrame, top: int = TOP, at_least: float = AT_LEAST) -> DataFrame:
    """(name, entity_no, cosine) of the distinct names of texts (name) that are variants of registered ones.

    registry has entity_no, name and entity_type; PERSON marks persons.
    """
    spark = texts.sparkSession
    distinct = cut(texts.where("trim(name) <> ''").select("name").distinct().repartition(tasks(texts)))
    shared = spark.sparkContext.broadcast(Frequencies(distinct))
    return _links(distinct, registry, shared, top, at_least)


class Block:
    """Unit vectors of a block of registered names by n-gram."""

    def __init__(self, f: Frequencies, names: list[str]):
        self.form_of: list[int] = []
        postings: dict[int, tuple[list[int], list[float]]] = {}
        for no, name in enumerate(names):
            for v in f.forms(name):
                for b, w in v.items():
                    at, weights = postings.setdefault(b, ([], []))
                    at.append(len(self.form_of))
                    weights.append(w)
                self.form_of.append(no)
        self.postings = {b: (np.array(x), np.array(w)) for b, (x, w) in postings.items()}

    def near(self, v: dict[int, float], at_least: float) -> dict[int, float]:
        """Every name (its number) of a cosine of at_least or more."""
        met = [(*self.postings[b], w) for b, w in v.items() if b in self.postings]
        if not met:
            return {}
        cosines = np.bincount(np.concatenate([x for x, _, _ in met]), np.concatenate([p * w for _, p, w in met]))
        best: dict[int, float] = {}
        for k in np.flatnonzero(cosines >= at_least - 1e-9).tolist():
            no = self.form_of[k]
            best[no] = max(best.get(no, 0.0), float(cosines[k]))
        return best


def _tiles(names: DataFrame, known: DataFrame, shared, at_least: float, parallel: int) -> DataFrame:
    """(name, entity_no, cosine, cost) of all pairs of at_least or more that can be read: a sparse product by tiles.

    Names and registered names are dealt into blocks of TILE at most on average; each pair of blocks is one tile, met by
    shuffling, and only what passes leaves it.  Neither side reaches the driver or a task as a whole.
    """
    down, across = max(4 * parallel, -(-names.count() // TILE)), max(1, -(-known.count() // TILE))
    deal = lambda n: F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = ["down", "across"]
    left = names.select("name", deal(down).alias("down"), every(across).alias("across")).repartition(2 * parallel, *tile)
    right = known.select("name", "entity_no", "person", deal(across).alias("across"), every(down).alias("down")).repartition(2 * parallel, *tile)
    blocks: dict[int, tuple[list, Block]] = {}

    def product(x: pa.Table, y: pa.Table) -> pa.Table:
        f = shared.value
        out: tuple[list, list, list, list] = ([], [], [], [])
        if x.num_rows and y.num_rows:
            no = y.column("across")[0].as_py()
            if no not in blocks:
                blocks.clear()
                mine = list(zip(*(y.column(c).to_pylist() for c in ("name", "entity_no", "person"))))
                blocks[no] = mine, Block(f, [m[0] for m in mine])
            mine, block = blocks[no]
            for name in x.column("name").to_pylist():
                for k, c in block.near(f.of(name), at_least).items():
                    registered, entity, person = mine[k]
                    cost = reading(name, registered, person, f.nick)
                    if cost is not None:
                        for o, v in zip(out, (name, entity, c, cost)):
                            o.append(v)
        return pa.table([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["name", "entity_no", "cosine", "cost"])

    ship(names.sparkSession)
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(product, "name string, entity_no long, cosine double, cost double")


def _registered(registry: DataFrame) -> DataFrame:
    return registry.where("trim(name) <> ''").groupBy("name").agg(F.min("entity_no").alias("entity_no"), F.max(F.col("entity_type").eqNullSafe("PERSON")).alias("person"))


def _links(distinct: DataFrame, registry: DataFrame, shared, top: int, at_least: float) -> DataFrame:
    known = _registered(registry)
    # n-grams that no registered name has say nothing of which one is meant; one row a bucket at most
    own = _placed(known.select("name"), shared, 0.0, "name string", registered=True).select("bucket").distinct().collect()
    shared = distinct.sparkSession.sparkContext.broadcast(shared.value.only([r["bucket"] for r in own]))
    mine = distinct.join(known.select("name"), "name", "left_anti")
    read = _tiles(mine, known, shared, at_least, tasks(distinct))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("cosine"), "entity_no"))
    linked = cut(read.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank"))
    return to_entities(linked, lambda names: unit_vectors(names, shared))


def unit_vectors(names: DataFrame, shared) -> DataFrame:
    """(name, gram, weight) of distinct names, each of length one; shared is a broadcast of Frequencies."""

    def speller():
        f = shared.value

        def step(b):
            got = [(n, k, w) for n in b["name"] for k, w in f.of(n).items()]
            return dict(zip(("name", "gram", "weight"), map(list, zip(*got)))) if got else {k: [] for k in ("name", "gram", "weight")}

        return step

    return arrow_rows(names.select("name"), "name string, gram int, weight double", speller)


def to_entities(pairs: DataFrame, vectors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(name, entity_no, cosine): each name with the entity whose cluster it is nearest to.

    pairs (name, entity_no, cosine, cost): the links that passed.  vectors gives (name, gram, weight) of
    distinct names (name).  A cluster is an entity's registered name with the names that read as it alone
    at nearly the least cost.  A name that so reads as several goes to the one of the highest mean cosine,
    which is the product with the sum of the members' vectors over their number; to none where it is the
    same for two.
    """
    w = Window.partitionBy("name")
    pairs = pairs.groupBy("name", "entity_no").agg(F.max("cosine").alias("cosine"), F.min("cost").alias("cost"))
    near = pairs.withColumn("least", F.min("cost").over(w)).where(F.col("cost") < F.col("least") + NEARLY).withColumn("n", F.count(F.lit(1)).over(w))
    near = cut(near.select("name", "entity_no", "cosine", "n"))
    sure, several = near.where("n = 1").drop("n"), near.where("n > 1").drop("n")
    if several.isEmpty():
        return sure
    members = cut(sure.join(several.select("entity_no").distinct(), "entity_no", "left_semi").select("entity_no", "name"))
    sums = members.join(vectors(members.select("name").distinct()), "name").groupBy("entity_no", "gram").agg(F.sum("weight").alias("sum"))
    sizes = members.groupBy("entity_no").agg(F.count(F.lit(1)).alias("members"))
    own = several.join(vectors(several.select("name").distinct()), "name")
    products = own.join(sums, ["entity_no", "gram"]).groupBy("name", "entity_no").agg(F.sum(F.col("weight") * F.col("sum")).alias("product"))
    mean = (F.col("cosine") + F.coalesce("product", F.lit(0.0))) / (1 + F.coalesce("members", F.lit(0)))
    scored = several.join(sizes, "entity_no", "left").join(products, ["name", "entity_no"], "left").withColumn("linkage", mean)
    order = w.orderBy(F.desc("linkage"), "entity_no")
    best = scored.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("linkage").over(order))
    return sure.unionByName(best.where("rank = 1 AND linkage > next + 1e-9").select("name", "entity_no", "cosine"))


def similar_names(names: DataFrame, shared, at_least: float = VARIANTS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, cosine), a < b, of at_least or more, and classes (name, first): names of one vector are one, under the first of them.

    names (name) are distinct.
    """

    def speller():
        import xxhash

        f = shared.value
        signed = lambda h: h - (1 << 64) if h >> 63 else h

        def step(b):
            codes = [repr(sorted(f.of(n))) for n in b["name"]]
            return {"name": b["name"], "v1": [signed(xxhash.xxh64_intdigest(c)) for c in codes], "v2": [signed(xxhash.xxh64_intdigest(c, 1)) for c in codes], "blank": [c == "[]" for c in codes]}

        return step

    spelled = cut(arrow_rows(names.select("name"), "name string, v1 long, v2 long, blank boolean", speller).where("NOT blank"))
    firsts = spelled.groupBy("v1", "v2").agg(F.min("name").alias("first"))
    classes = cut(spelled.join(firsts, ["v1", "v2"]).select("name", "first"))
    rows = cut(_placed(classes.where("name = first"), shared, at_least, "name string"))
    met = rows.alias("x").join(rows.alias("y"), "bucket").where("x.name < y.name").select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()

    def measurer():
        f = shared.value
        of: dict[str, dict[int, float]] = {}

        def step(b):
            if len(of) > 100_000:
                of.clear()
            for n in {*b["a"], *b["b"]}:
                if n not in of:
                    of[n] = f.of(n)
            return {"a": b["a"], "b": b["b"], "cosine": [cosine(of[x], of[y]) for x, y in zip(b["a"], b["b"])]}

        return step

    return arrow_rows(met, "a string, b string, cosine double", measurer).where(F.col("cosine") >= at_least - 1e-9), classes


def average_linkage(pairs: DataFrame, at_least: float = VARIANTS) -> DataFrame:
    """(name, cluster): names grouped while the mean cosine of two clusters is at_least or more; a cluster bears its least name.

    pairs (a, b, cosine), a < b; those not given count as 0.  In each round all clusters that are each other's nearest
    are joined.  A joined cluster is never nearer to a third than the nearer of its parts was, so this makes the
    clusters that joining one pair at a time would.  Sums of cosines and sizes are relations; no
    cluster or component reaches one task.  Names without a pair do not appear.
    """
    e = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("cosine").alias("s")))
    names = cut(e.select(F.explode(F.array("u", "v")).alias("name")).distinct().withColumn("cluster", F.col("name")))
    while True:
        size = names.groupBy(F.col("cluster").alias("c")).agg(F.count(F.lit(1)).alias("n"))
        mean = e.join(size.select(F.col("c").alias("u"), F.col("n").alias("nu")), "u").join(size.select(F.col("c").alias("v"), F.col("n").alias("nv")), "v")
        near = mean.withColumn("mean", F.round(F.col("s") / (F.col("nu") * F.col("nv")), 12)).where(F.col("mean") >= at_least - 1e-9)
        order = F.struct((-F.col("mean")).alias("m"), "u", "v")
        best = near.select(F.explode(F.array("u", "v")).alias("c"), order.alias("o")).groupBy("c").agg(F.min("o").alias("o"))
        joined = cut(best.groupBy(F.col("o.u").alias("to"), F.col("o.v").alias("gone")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("to", "gone"))
        if joined.isEmpty():
            return names
        now = lambda df, c: df.join(joined.withColumnRenamed("gone", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        moved = now(now(e, "u"), "v").where("u <> v")
        e = cut(moved.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("s").alias("s")))
        names = cut(now(names, "cluster"))


def cluster_names(texts: DataFrame, registry: DataFrame, top: int = TOP, at_least: float = AT_LEAST, variants: float = VARIANTS) -> DataFrame:
    """(name, cluster, entity_no) of the distinct names of texts (name): the least name of its cluster, and the registered entity where it is one's.

    Names that mean a registered entity are in its cluster, with the registered name; the others are
    grouped with one another.
    """
    spark = texts.sparkSession
    distinct = cut(texts.where("trim(name) <> ''").select("name").distinct().repartition(tasks(texts)))
    shared = spark.sparkContext.broadcast(Frequencies(distinct))
    known = _registered(registry)
    own = distinct.join(known.select("name", "entity_no"), "name")
    linked = cut(_links(distinct, registry, shared, top, at_least).select("name", "entity_no").unionByName(own).distinct())
    least = linked.groupBy("entity_no").agg(F.min("name").alias("cluster"))
    others = cut(distinct.join(linked.select("name"), "name", "left_anti"))
    pairs, classes = similar_names(others, shared, variants)
    grouped = average_linkage(pairs, variants).withColumnRenamed("name", "first")
    free = classes.join(grouped, "first", "left").select("name", F.coalesce("cluster", "first").alias("cluster"))
    free = others.join(free, "name", "left").select("name", F.coalesce("cluster", "name").alias("cluster"))
    return linked.join(least, "entity_no").select("name", "cluster", "entity_no").unionByName(free.withColumn("entity_no", F.lit(None).cast("long")))


def names_of(triples: DataFrame) -> DataFrame:
    """(triple_no, side, name) of all heads and tails."""
    sides: Column = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("name")) for s in ("head", "tail")))
    return triples.select("triple_no", F.explode(sides).alias("s")).select("triple_no", "s.side", "s.name").where("name IS NOT NULL")


def entity_names(triples: DataFrame) -> DataFrame:
    """(name) of the heads and tails whose type is person or organisation, however it is formatted."""
    sides = F.array(*(F.struct(F.col(s).alias("name"), letters_digits(F.col(f"{s}_type")).alias("kind")) for s in ("head", "tail")))
    return triples.select(F.explode(sides).alias("s")).select("s.name", "s.kind").where("name IS NOT NULL").where(F.col("kind").isin("person", "org", "organisation", "organization")).select("name")
