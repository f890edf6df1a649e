"""Training-data operators against brute force, exact round trips, held-out texts and edge cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import answers, language, merkle_dedup, mixing, names, near_dups, scan_repair, splitting, token_ids, toxicity
from docloom.llm.common import element_fields
from docloom.llm.queries import QUERIES, SQL
from tests.conftest import rows

TABLES = ("documents", "elements", "triples", "raw_relations", "entity_ref", "mix_targets", "review_samples")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    if name.endswith("_found"):
        assert len(got) == len(got.drop_duplicates()) > 0


@pytest.fixture(scope="module")
def odd_tables(spark, small, tmp_path_factory):
    """The tables with null rows, repeated rows and further columns of clashing names; and all empty."""
    odd, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    for t in TABLES:
        df = spark.read.parquet(f"{small}/{t}.parquet").limit(60)
        clash = df.withColumns({c: F.lit("x") for c in ("field", "key", "digest", "seq", "no", "lang_", "n_tokens", "range", "prompt", "name_") if c not in df.columns})
        key = next((c for c in ("doc_id", "elem_no", "triple_no", "raw_no", "sample_no") if c in df.columns and dict(df.dtypes)[c] == "bigint"), None)
        nulls = clash.limit(3).select(*(F.lit(None).cast(k).alias(c) if c != key else (F.col(c) + 1_000_000).alias(c) for c, k in clash.dtypes))
        clash.unionByName(nulls).unionByName(clash.limit(5)).coalesce(1).write.parquet(f"{odd}/{t}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{empty}/{t}.parquet")
    return odd, empty


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, odd_tables, name):
    odd, empty = odd_tables
    QUERIES[name](spark, odd).toPandas()
    got = QUERIES[name](spark, empty).toPandas()
    assert len(got) == 0


def test_merkle_nested(spark):
    df = spark.createDataFrame(
        [(1, {"a": {"Relation": "OWNED_BY", "x": [1, 2]}}), (2, {"a": {"Relation": "ownedBy ", "x": [1, 2]}}), (3, {"a": {"Relation": "OWNED_BY", "x": [2, 1]}})],
        "no long, r struct<a: struct<Relation: string, x: array<int>>>",
    )
    recs = merkle_dedup.records(df, "no", F.col("r"), df.schema["r"].dataType, merkle_dedup.format_free(["relation"]))
    assert [tuple(r) for r in merkle_dedup.copies(recs).collect()] == [(1, 2)]
    clash = recs.withColumn("digest", F.lit(1).cast("long"))  # the full comparison keeps clashing digests apart
    assert [tuple(r) for r in merkle_dedup.copies(clash).collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", range(4))
def test_cuts(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(["a", "bc ", ". ", "\n", "\n\n", "é", "😀"]) for _ in range(r.choice([90, 400, 3000]))) for _ in range(20)] + ["x" * 500]
    limit, overlap = 80, 13
    for t, pieces in zip(texts, splitting.cuts(texts, limit, overlap)):
        assert all(b - a <= limit for a, b, _ in pieces)
        assert "".join(t[a if i == 0 else a + overlap : b] for i, (a, b, _) in enumerate(pieces)) == t
        assert all(y[0] == x[1] - overlap for x, y in zip(pieces, pieces[1:]))
        # alone, and with one step after another, a text has the same cuts
        assert splitting.cuts([t], limit, overlap)[0] == pieces


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 2000), (4, "a" * 2001)], "k long, text string")
    got = splitting.split_long(df, {"k": "long"}).collect()
    assert {r["k"] for r in got} == {4} and len(got) == 2


def test_token_ids_exact(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = token_ids.Encoder(token_ids.default_ranks())

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from(["a", " b", "  ", "\n", "'ll", "1", "é", "😀", "!?", "word", "​", "漢字", "<|endoftext|>", "\t", " " * 200, "x" * 150]), max_size=120), st.sampled_from([1, 20]))
    def exact(parts, many):
        text = "".join(parts) * many
        own, again = token_ids.chunks([text, "z" * 3000 + text])
        assert "".join(own) == text and "".join(again) == "z" * 3000 + text
        assert own == token_ids.chunks(["first " * 500, text])[1]
        got = token_ids.join_chunks(enc, [token_ids.encode_chunk(enc, c) for c in own])
        assert got == enc.bpe.encode_ordinary(text)

    exact()
    r = random.Random(8)
    word = lambda: r.choice(["harbour", "wall", "it's", "x1", "漢字", "–", "\n", "moved,", "é"])
    shared = " ".join(word() for _ in range(4000))
    texts = [shared, "a" + shared, " ".join(word() for _ in range(50)) + shared + "b", shared[500:] + " c" * 900, "ab " * 3000, "漢字" * 9000, " " * 9000]
    rows_ = [(1, None), (2, ""), *((3 + i, t) for i, t in enumerate(texts)), (7, texts[4]), (7, texts[4]), (90, texts[4])]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = [(r["doc_id"], r["ids"]) for r in token_ids.token_ids(docs).collect()]
    assert sorted(got) == sorted((i, enc.bpe.encode_ordinary(t) if t else []) for i, t in rows_)
    assert len({c for t in texts[:4] for c in token_ids.chunks([t])[0]}) < sum(len(token_ids.chunks([t])[0]) for t in texts[:4])


def test_mix_shares(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0], 10 + i % 7) for i in range(600)] + [(1000, None, 5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.7, 3), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    got = {r["source"]: r for r in mixing.report(mixed, targets).collect()}
    assert got["a"]["actual_share"] == pytest.approx(0.2 / 0.9, abs=1e-3)
    assert got["b"]["actual_share"] == pytest.approx(0.7 / 0.9, abs=1e-3)
    assert got["none"]["tokens"] == 0 and got["b"]["max_copies"] <= 3 and got["a"]["max_copies"] <= 1
    fixed = {r["source"]: r["tokens"] for r in mixing.report(mixing.mix(docs, targets, total=2000), targets).collect()}
    assert fixed["a"] == 400 and fixed["b"] == 1400


def test_language(spark):
    words = {
        "eng": "the harbour wall was moved next to old furnace and with staff from".split(),
        "spa": "el puerto principal fue comparado con la bomba cerca de los hornos según".split(),
        "deu": "das alte Lager wurde neben der Mauer und mit den Leuten gebaut nach".split(),
    }
    r = random.Random(1)
    say = lambda lab, n=12: " ".join(r.choice(words[lab]) for _ in range(n))
    train = [(lab if i % 10 else "spa", say(lab)) for lab in words for i in range(80)]  # a tenth of the labels is wrong
    trees = language.train(train)
    table = language.WordBits(trees)
    test = [(lab, say(lab)) for lab in words for _ in range(50)]
    best = table.of([t for _, t in test])[0].argmin(axis=1)
    assert sum(language.LANGUAGES[b] == lab for b, (lab, _) in zip(best, test)) == len(test)
    one, two = say("eng", 20).capitalize() + ". ", say("deu", 20).capitalize() + "."
    df = spark.createDataFrame([(1, one * 3 + two), (2, one), (3, " "), (4, None)], "k long, text string")
    b = spark.sparkContext.broadcast(trees)
    got = language.segment_texts(df, {"k": "long"}, b).orderBy("k", "segment_no").collect()
    assert [(x["k"], x["lang"], x["start"]) for x in got] == [(1, "eng", 0), (1, "deu", len(one) * 3), (2, "eng", 0)]
    labels = {x["k"]: (x["lang"], x["confidence"]) for x in language.label_texts(df, {"k": "long"}, b).collect()}
    assert labels[2][0] == "eng" and labels[2][1] > 0.9 and labels[3] == (None, 0.0) and labels[4] == (None, 0.0)


def test_near_duplicates_equal_brute_force(spark, small):
    elements = spark.read.parquet(f"{small}/elements.parquet")
    got = {(r["field"], r["elem_a"], r["elem_b"]) for r in QUERIES["p5_found"](spark, small).collect()}
    first: dict = {}
    for e in sorted(elements.collect(), key=lambda e: e["elem_no"]):
        first.setdefault(e["id"], e)
    want = set()
    for field in near_dups.FIELDS:
        sets = {}
        for e in first.values():
            t = None if field == "content" and e["type"] == "image" else e[field]
            if t and len(near_dups.word_runs(t)) >= near_dups.LEAST_WORDS:
                sets[e["elem_no"]] = near_dups._runs(t)
        keys = sorted(sets)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                both = len(sets[a] & sets[b])
                if 2 * both >= len(sets[a] | sets[b]):
                    want.add((field, a, b))
    assert got == want


def test_near_duplicates_near_one_half(spark):
    """Every pair of one half or more is found, of many that lie near it."""
    r = random.Random(11)
    texts = []
    for k in range(40):
        base = [f"w{k}x{r.randrange(60)}" for _ in range(r.randint(30, 90))]
        texts.append(base)
        for _ in range(8):
            n = len(base)
            at, cut = r.randrange(n), r.randint(n // 4, n // 2)
            own = base[:at] + [f"y{r.randrange(10**6)}" for _ in range(cut // 2)] + base[at + cut // 2 :]
            texts.append(own[r.randint(0, cut // 2) :])
    texts = [t for t in texts if len(t) >= near_dups.LEAST_WORDS]
    df = spark.createDataFrame([(i, str(i), "content", " ".join(t)) for i, t in enumerate(texts)], "elem_no long, id string, field string, text string")
    got = {(r["elem_a"], r["elem_b"]) for r in near_dups.all_pairs(*near_dups.similar_pairs(df)).collect()}
    sets = [near_dups._runs(" ".join(t)) for t in texts]
    both = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j}
    want = {p for p, s in both.items() if s >= 0.5}
    assert got == want and sum(0.5 <= s < 0.6 for s in both.values()) > 100


def test_automaton_equals_brute_force():
    r = random.Random(3)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(300)}
    trie = scan_repair.Trie(words)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + row[1:], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    for _ in range(60):
        t = "".join(r.choice("abcd") for _ in range(r.randint(1, 8)))
        for d in (0, 1, 2):
            assert sorted(trie.within(t, d)) == sorted(w for w in words if distance(w, t) <= d)


def test_scan_repair():
    known = "the modular furnace was moved next to low-cost storage tank between board and request of volume proceedings papers".split()
    rep = scan_repair.Repairer([(w, 5000) for w in known], {"proceedings", "papers"})
    text = "The modu1ar fur-\nnace was rnoved next to the low-\ncost\n\nPROCEEDINGS, VOLUME 5 · Ostfa 12\n\nstoragc tank.\n\nThe board\n— 13 —\nand the request."
    out, damages = rep.repair(text)
    assert out == "The modular furnace was moved next to the low-cost storage tank.\n\nThe board and the request."
    assert damages == ["characters", "header", "hyphenation", "page_number"]
    for clean in ("", " \n", "The modular furnace was moved.", "| A | - |\n|---|---|\n| 12 | 3 |", "The board\n1992."):
        assert rep.repair(clean)[1] == []


def test_repaired_texts_equal_the_undamaged(spark):
    """Clean texts are damaged in known ways; what comes back is compared with what they were."""
    e = spark.read.parquet("/root/testdata/sf0.01/elements.parquet").where("type = 'text' AND content IS NOT NULL").select("content").distinct().collect()
    rows_ = sorted(r["content"] for r in e)
    count = Counter(w for t in rows_ for line in t.split("\n") if scan_repair.title_words(line) is None for w in map(str.lower, scan_repair.WORD.findall(line)))
    rep = scan_repair.Repairer([(w, n) for w, n in count.items() if n >= scan_repair.LEAST], {"proceedings"})
    clean = [scan_repair.reflow(t) for t in rows_ if len(t.split()) > 40 and "|" not in t and rep.repair(t)[1] == []]
    assert len(clean) > 100
    r = random.Random(9)
    restored = damaged = kept = plain = whole = 0
    for t in clean:
        words, marks, own = t.split(), [], []
        for w in words:
            low, kind = w.lower(), None
            can = [(a, b) for a, b in scan_repair.CONFUSIONS if a in low[1:]]
            if len(w) > 4 and w.isalpha() and w.islower() and low in rep.frequent:
                x = r.random()
                if x < 0.05 and can:
                    a, b = r.choice(can)
                    w, kind = w[0] + w[1:].replace(a, b, 1), "characters"
                elif x < 0.08:
                    at = r.randint(2, len(w) - 2)
                    w, kind = f"{w[:at]}-\n{w[at:]}", "hyphenation"
            own.append(w)
            marks.append(kind)
        text = " ".join(own)
        middle = text.find(" ", len(text) // 2)
        text = f"{text[:middle]}\nProceedings of the Society\n— 17 —\n{text[middle + 1 :]}"
        got = rep.repair(text)[0].split()
        whole += got == words
        if len(got) == len(words):
            for g, w, m in zip(got, words, marks):
                damaged, restored = damaged + (m is not None), restored + (m is not None and g == w)
                plain, kept = plain + (m is None), kept + (m is None and g == w)
    # measured: 3,354 of 3,391 damaged words restored, all 100,420 others kept, 675 of 710 texts equal in whole
    assert damaged > 300 and restored >= 0.97 * damaged and kept >= 0.999 * plain and whole >= 0.9 * len(clean)


def test_neighbours_decide_between_candidates():
    known = "the cat eat sat on mat here old and then bear tool rig".split()
    rep = scan_repair.Repairer([(w, 5000) for w in known] + [("harbour", 40_000), ("harbours", 3_000)], set())
    assert set(rep.candidates("c@t")) == {"cat"}
    text = "The old harhour stood. The old harbour wall. The o1d rig."
    assert rep.repair(text) == ("The old harbour stood. The old harbour wall. The old rig.", ["characters", "spelling"])
    assert rep.repair("The old harhour stood. The old harbour wall.")[1] == []


def test_scan_repair_two_letters_for_one():
    known = "under field redundant outside moved number little usual which rive evening".split()
    rep = scan_repair.Repairer([(w, 5000) for w in known], set())
    for read, printed in (("uncler", "under"), ("fielcl", "field"), ("reclundant", "redundant"), ("outsicle", "outside"), ("movecl", "moved"), ("rnoved", "moved"), ("iisual", "usual"), ("wliich", "which")):
        assert rep.candidates(read) == (printed,)
        assert rep.repair(f"It was {read} here.") == (f"It was {printed} here.", ["characters"])


def test_names():
    nick = {"bob": {"robert"}}
    yes = [
        ("Bob Talmoovic", "Robert C. Talmoovic", True), ("TALMOOVIC, R. C.", "Robert C. Talmoovic", True), ("Dr. Robert Tamloovic", "Robert C. Talmoovic", True),
        ('Robert "Bob" Talmoovic', "Robert C. Talmoovic", True), ("Polmonotti University", "University of Polmonotti", False), ("U. of Polmonotti", "University of Polmonotti", False),
        ("Galsasky Power Sociedad Anónima", "Galsasky Power S.A.", False), ("JPOA", "Jasgogoovic Pollen Optics Agency", False), ("Jasgogoovic Pollen Optics Ag.", "Jasgogoovic Pollen Optics Agency", False),
    ]
    no = [
        ("Margaret Talmoovic", "Robert C. Talmoovic", True), ("Robert K. Talmoovic", "Robert C. Talmoovic", True), ("Galsasky Motors S.A.", "Galsasky Power S.A.", False),
        ("Galsasky Power GmbH", "Galsasky Power S.A.", False), ("Robert", "Robert C. Talmoovic", True), ("University of Dovnequist", "University of Polmonotti", False),
    ]
    assert [n for n, r, p in yes if names.reading(n, r, p, nick) is None] == []
    assert [n for n, r, p in no if names.reading(n, r, p, nick) is not None] == []
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("abcd", "wxyz", 2) == 3


def test_names_linked(spark):
    reg = spark.createDataFrame([(1, "Robert C. Talmoovic", "PERSON"), (2, "Galsasky Power S.A.", "ORG"), (3, "Søren Wobrumonau", "PERSON")], "entity_no long, name string, entity_type string")
    n = spark.createDataFrame([(x,) for x in ("R. C. Talmoovic", "galsasky power s.a.", "Wobrumonau, Soren", "Robert C. Talmoovic", "Elizabeth Wobrumonau", " ", None)], "name string")
    want = {("R. C. Talmoovic", 1), ("galsasky power s.a.", 2), ("Wobrumonau, Soren", 3)}
    for top in (12, 1):
        assert {(r["name"], r["entity_no"]) for r in names.link_names(n, reg, top=top).collect()} == want


def test_name_join_loses_no_pair(spark):
    r = random.Random(4)
    made = sorted({" ".join("".join(r.choice("abeiklnorst") for _ in range(r.randint(3, 7))) for _ in range(2)) for _ in range(60)})
    made += [n[:i] + n[i + 1 :] for n in made[:40] for i in (2, 4)] + [" ".join(reversed(n.split())) for n in made[:10]]
    df = spark.createDataFrame([(n,) for n in sorted(set(made))], "name string")
    f = names.Frequencies(df)
    pairs, classes = names.similar_names(df, spark.sparkContext.broadcast(f), 0.6)
    got = {(x["a"], x["b"]) for x in pairs.collect()}
    first = {x["name"]: x["first"] for x in classes.collect()}
    reps = sorted(set(first.values()))
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if names.cosine(f.of(a), f.of(b)) >= 0.6}
    assert got == want and len(want) > 20
    assert all(f.of(a).keys() == f.of(b).keys() for a, b in first.items())


@pytest.mark.parametrize("seed", range(3))
def test_average_linkage_equals_single_steps(spark, seed):
    r = random.Random(seed)
    near = {(a, b): round(r.uniform(0.5, 1.0), 3) for a in range(14) for b in range(a + 1, 14) if r.random() < 0.45}
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", s) for (a, b), s in near.items()], "a string, b string, cosine double")
    got: dict = {}
    for x in names.average_linkage(df, 0.6).collect():
        got.setdefault(x["cluster"], set()).add(x["name"])
    groups = [{x} for x in sorted({x for p in near for x in p})]
    mean = lambda p, q: sum(near.get((min(x, y), max(x, y)), 0) for x in p for y in q) / (len(p) * len(q))
    while len(groups) > 1:
        best = max(((mean(p, q), -i, -j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j))
        if best[0] < 0.6:
            break
        p, q = groups[-best[1]], groups[-best[2]]
        groups = [g for g in groups if g is not p and g is not q] + [p | q]
        groups.sort(key=min)
    assert {frozenset(f"n{x:02}" for x in g) for g in groups} == {frozenset(g) for g in got.values()}


def test_clusters_of_unregistered_names(spark):
    reg = spark.createDataFrame([(1, "Robert C. Talmoovic", "PERSON")], "entity_no long, name string, entity_type string")
    every = ["R. C. Talmoovic", "Robert C. Talmoovic", "Galsasky Power Ltd", "Galsasky Pwer Ltd", "Power Galsasky", "Wobrumonau Mills", " ", None]
    got = {x["name"]: (x["cluster"], x["entity_no"]) for x in names.cluster_names(spark.createDataFrame([(n,) for n in every], "name string"), reg, variants=0.6).collect()}
    assert got["R. C. Talmoovic"] == got["Robert C. Talmoovic"] == ("R. C. Talmoovic", 1)
    assert got["Galsasky Power Ltd"] == got["Galsasky Pwer Ltd"] == got["Power Galsasky"] == ("Galsasky Power Ltd", None)
    assert got["Wobrumonau Mills"] == ("Wobrumonau Mills", None) and len(got) == 6


def test_names_to_entities_by_linkage(spark):
    """A name that reads as two persons goes to the cluster of the higher mean cosine, and to none at equal ones."""
    registry = spark.createDataFrame([(1, "Robert Talmoovic", "PERSON"), (2, "Rachel Talmoovic", "PERSON"), (3, "Anna Polmonotti", "PERSON"), (4, "Arno Polmonotti", "PERSON")], "entity_no long, name string, entity_type string")
    clusters = {1: ["Robert Talmoovic", "Robbert Talmoovic", "Robert Talmoovik"], 2: ["Rachel Talmoovic"]}
    every = sorted({n for c in clusters.values() for n in c} | {"R. Talmoovic", "A. Polmonotti"})
    got = {r["name"]: r["entity_no"] for r in names.link_names(spark.createDataFrame([(n,) for n in every], "name string"), registry).collect()}
    df = Counter(g for n in every for g in names.grams(n, {}))  # no two of these n-grams share a bucket

    def cosine(a, b):
        u, v = ({g: np.log(1 + len(every) / df[g]) for g in names.grams(n, {}) if g in df} for n in (a, b))
        return sum(x * v.get(g, 0) for g, x in u.items()) / np.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))

    mean = {e: np.mean([cosine("R. Talmoovic", m) for m in c]) for e, c in clusters.items()}
    assert got["R. Talmoovic"] == max(mean, key=mean.get)
    assert got["Robbert Talmoovic"] == got["Robert Talmoovik"] == 1
    tie = spark.createDataFrame([("x", 1, 0.5, 0.2), ("x", 2, 0.5, 0.3), ("y", 1, 0.4, 0.1)], "name string, entity_no long, cosine double, cost double")
    flat = lambda d: d.select("name", F.lit("g").alias("gram"), F.lit(0.5).alias("weight"))
    assert {r["name"] for r in names.to_entities(tie.where("name = 'x'"), flat).collect()} == set()
    # with y in its cluster the mean of 1 is (0.5 + 0.25) / 2, below that of 2
    assert {(r["name"], r["entity_no"]) for r in names.to_entities(tie, flat).collect()} == {("x", 2), ("y", 1)}


def test_answers(spark):
    ends = answers.Endings(["The pump was moved next to the tank in the harbour.", "The tank was compared with the pump in the yard."] * 10)
    assert not ends.broken("The pump was moved next to the tank in the harbour") and ends.broken("The pump was moved next to the") and ends.broken("The pump was moved next to the ta")
    assert not ends.broken("Anything at all.") and ends.broken("The pump was moved next...")
    assert answers.placeholder(None) and answers.placeholder(" N/A ") and answers.placeholder("...") and not answers.placeholder("The pump")
    assert answers.refusal("I'm sorry, but I can't help with that.") and answers.refusal("Es tut mir leid, dabei kann ich nicht helfen.") and not answers.refusal("The pump could not match the tank.")
    long = "the first pump was moved next to the second tank in the old harbour"
    assert answers.copied(long + " today", "Here is the summary:\n" + long.upper()) and not answers.copied(long, "a quite different text about the pump and the tank in a far away yard")


def test_refusal_late_in_a_long_text():
    assert answers.refusal("The pump was moved. " * 200 + "I'm sorry, but I can't help with that.")


def test_endings_count_all_rows(spark):
    """The endings of open texts are judged by the counts of all responses, however many there are."""
    r = random.Random(5)
    common = [f"The pump {k} was moved next to the {r.choice(['tank', 'yard', 'harbour'])}." for k in range(24_000)]
    rare = [f"The {w} was painted before the {w}." for w in ("zorgal", "quibnar", "veltrix") for _ in range(4)]
    left = ["The zorgal was painted before the zorgal", "The quibnar was painted before the", "The veltrix was painted before the veltrix", "The pump was moved next to the ta"]
    texts = common + rare + left
    pairs = spark.createDataFrame([(i, None, t, False) for i, t in enumerate(texts)], "no long, prompt string, response string, compare boolean")
    models = spark.sparkContext.broadcast(answers.train_languages([("en", "the pump was moved")]))
    got = {x["no"]: x["defect"] for x in answers.defects(pairs, {"no": "long"}, models).collect()}
    every = answers.Endings(texts)
    assert len(got) == len(texts) and got == {i: "truncated" if every.broken(t) else None for i, t in enumerate(texts)}
    assert [got[len(texts) - 4 + k] for k in range(4)] == [None, "truncated", None, "truncated"]


def test_toxicity_held_out(spark, small):
    r = [(x["text"], x["label"]) for x in spark.read.parquet(f"{small}/review_samples.parquet").collect()]
    chain = toxicity.Chain(r)
    # sentences of one beginning are held out together, and with them names of groups and words of harmless mentions
    for c in toxicity.CHAIN:
        told = Counter((lab == c, p >= 0.5) for (_, lab), p in zip(r, chain.held_out[c]))
        assert told[True, True] >= 0.8 * (told[True, True] + told[True, False])
        assert told[True, True] >= 0.85 * (told[True, True] + told[False, True])
    assert chain.score(None) == chain.score("") == (0.0, 0.0, 0.0)
    assert chain.score("The pump was moved. Y o u are a w0rthless idi*t!")[toxicity.CHAIN.index("abusive")] >= 0.5
    assert toxicity.Chain([]).score("You are an idiot") == (0.0, 0.0, 0.0)
    # words outside the lists weigh too: a sentence without any listed word has a score of its own
    plain, learned = chain.score("The pump stands here."), chain.score("Nobody wants this, whoever wrote it.")
    assert 0 < plain[toxicity.CHAIN.index("abusive")] < learned[toxicity.CHAIN.index("abusive")] < 0.5


def test_copies_refusals_and_headers_of_any_length():
    start = "".join(f"pump {i} stands by tank {i * 7}. " for i in range(12))
    new = "".join(f"Then wall {i * 3} was built of {i} stones in the yard. " for i in range(60))
    assert len(start) > 200 and not answers.copied(start + "old end", start + new) and answers.copied(start + "old end and more of it", start + "new end.")
    line = " ".join(["Proceedings", "Volume", "Society"] * 12)
    rep = scan_repair.Repairer([(w, 5000) for w in "the pump was moved".split()], {"proceedings"})
    assert len(line) > 300 and rep.repair(f"The pump\n{line}\nwas moved.") == ("The pump was moved.", ["header"])
    long = "extraordinarilyoverspecialised"
    rep = scan_repair.Repairer([(long, 5000)], set())
    assert rep.candidates(long.replace("m", "rn", 1)) == () and rep.candidates(long.replace("i", "1", 1)) == (long,)


def test_short_foreign_sentences_at_the_end(spark):
    """Several sentences that are each too short to pay a change of language pay it together."""
    trees = language.train([("eng", "the harbour wall was moved next to the old furnace with staff"), ("deu", "das alte lager wurde neben der mauer und mit den leuten gebaut")] * 30)
    text = "The harbour wall was moved next to the old furnace. " * 2 + "Der alte gebaut und. " * 4
    bits, n = language.WordBits(trees).of(["Der alte gebaut und."])
    b = spark.sparkContext.broadcast(trees)
    got = language.segment_texts(spark.createDataFrame([(1, text)], "k long, text string"), {"k": "long"}, b).collect()
    assert [x["lang"] for x in got] == ["eng", "deu"]


def test_texts_in_none_of_the_languages(spark):
    """Trained on the tables; texts of the Universal Declaration of Human Rights, which they don't have."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.sparkContext.broadcast(language.train(language.labelled_sample(d, "doc_id", "text", "lang")))
    texts = [
        ("eng", "All human beings are born free and equal in dignity and rights."), ("spa", "Todos los seres humanos nacen libres e iguales en dignidad y derechos."),
        ("deu", "Alle Menschen sind frei und gleich an Würde und Rechten geboren."), ("por", "Todos os seres humanos nascem livres e iguais em dignidade e em direitos."),
        ("und", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."), ("und", "Alla människor är födda fria och lika i värde och rättigheter."),
        ("und", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."), ("und", "Tüm insanlar özgür, onur ve haklar bakımından eşit doğarlar."),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "k long, text string")
    for f in (language.label_texts, language.segment_texts):
        assert {x["k"]: x["lang"] == "und" for x in f(df, {"k": "long"}, b).collect()} == {i: lab == "und" for i, (lab, _) in enumerate(texts)}


def test_languages_are_sampled_in_even_shares(spark):
    df = spark.createDataFrame([(i, "x", "eng") for i in range(3000)] + [(5000 + i, "y" * 9000, "por") for i in range(20)] + [(9000, None, "deu"), (9001, "z", "xx")], "no long, text string, lang string")
    got = Counter(lab for lab, _ in language.labelled_sample(df, "no", "text", "lang", 600))
    assert got["por"] == 20 and 60 < got["eng"] < 150 and set(got) == {"eng", "por"}
    assert all(len(t) == 9000 for lab, t in language.labelled_sample(df, "no", "text", "lang", 600) if lab == "por")


def test_element_fields(spark):
    df = spark.createDataFrame([(1, "c", "x", "image"), (2, "c", None, None), (3, None, "", "text")], "elem_no long, content string, context string, type string")
    assert sorted(map(tuple, element_fields(df).collect())) == [(1, "context", "x"), (2, "content", "c"), (3, "context", "")]
