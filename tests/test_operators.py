"""Operators against literal loops, rules and edge cases."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from docloom.functions import ids, jsons, models, text
from docloom.operators import dedup, elements, graph, rag, search, store, triples
from docloom.plans import pipelines
from docloom.sources import readers


def items_of(spark, docs):
    rows = [(f, i, f"#/{i}", lab, t, None) for f, lines in docs.items() for i, (lab, t) in enumerate(lines)]
    from docloom.schemas import ITEM

    return spark.createDataFrame(rows, ITEM)


def some_docs(seed, n_docs=3, n_items=40):
    r = random.Random(seed)
    line = lambda: " ".join("w" * r.randint(1, 3) for _ in range(r.choice([1, 2, 5, 9, 30])))
    return {f"f{d}": [(r.choice(["text", "text", "table", "picture"]), line()) for _ in range(n_items)] for d in range(n_docs)}


def expected_context(lines, at, budget):
    """Neighbours by their running sums: those before within half of what the target leaves, those after within the rest."""
    texts, n = [t for _, t in lines], [len(t.split(" ")) for _, t in lines]
    left = budget - n[at]
    if left <= 0:
        words = lines[at][1].split(" ")
        return " ".join(words[(len(words) - budget) // 2 :][:budget])
    back = [s for s in accumulate(reversed(n[:at])) if s <= left // 2]
    ahead = [s for s in accumulate(n[at + 1 :]) if s <= left - max(back, default=0)]
    before, after = texts[at - len(back) : at], texts[at + 1 : at + 1 + len(ahead)]
    return "\n".join([*before, "", texts[at], "", *after]).strip()


@pytest.mark.parametrize("budget", [8, 33, 120])
def test_context_equals_running_sums(spark, budget):
    docs = some_docs(budget)
    items = items_of(spark, docs)
    got = {(r["filename"], r["seq"]): r["context"] for r in elements.context(items, F.col("label").isin("table", "picture"), budget).collect()}
    want = {(f, i): expected_context(lines, i, budget) for f, lines in docs.items() for i, (lab, _) in enumerate(lines) if lab != "text"}
    assert got == want


def test_chunks_equal_loop(spark):
    docs, budget = some_docs(5), 20
    got = sorted((r["filename"], r["chunk_no"], r["text"]) for r in elements.pack_chunks(items_of(spark, docs), budget).collect())
    want = []
    for f, lines in docs.items():
        chunks, used = [], 0
        for _, t in lines:
            n = len(t.split(" "))
            if chunks and used + n <= budget:
                chunks[-1].append(t)
                used += n
            else:
                chunks.append([t])
                used = n
        want += [(f, i, "\n".join(c)) for i, c in enumerate(chunks)]
    assert got == sorted(want)
    assert elements.pack_chunks(items_of(spark, {}), budget).count() == 0


def test_running_sum(spark):
    from docloom.operators.running import running_sum

    rows = [("a", i, i % 5) for i in range(40)] + [("b", 7, 3), ("c", -2, 1), ("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, o int, v long")
    got = {(r["g"], r["o"]): r["s"] for r in running_sum(df, "g", "o", F.col("v"), "s", block=3).collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p <= o) for g, o, _ in rows}


def test_greedy_dedup(spark):
    h = [0, 2**10 - 1, 2**11 - 1]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(h)] + [("e", 0, 7), ("e", 1, None)], "g string, o int, h long")
    for f in (dedup.greedy_hamming, dedup.greedy_hamming_sql):
        assert sorted((r["g"], r["o"]) for r in f(df, "g", "o", "h").collect()) == [("d", 0), ("d", 2), ("e", 0)]
    chain = spark.createDataFrame([("d", i, x) for i, x in enumerate([0, 2**8 - 1, 2**16 - 1])], "g string, o int, h long")
    assert [r["o"] for r in dedup.greedy_hamming(chain, "g", "o", "h").orderBy("o").collect()] == [0, 2]


def test_scalars(spark):
    df = spark.createDataFrame([("Revenue (Q1)", " \n a b \t", "E=mc² 18 de abril")], "h string, s string, t string")
    r = df.select(text.screaming_snake(F.col("h")), text.strip(F.col("s")), text.title_case(F.col("t")), ids.element_id(F.lit("c"), F.lit("f"))).first()
    import hashlib

    assert list(r) == ["REVENUE_Q1", "a b", "E=Mc² 18 De Abril", hashlib.sha256(b"c_f").hexdigest()]
    crop = spark.createDataFrame([(" ".join(map(str, range(n))),) for n in (5, 9, 20)], "t string").select(text.central_crop(F.col("t"), 4, 10)).collect()
    assert [r[0] for r in crop] == ["0 1 2 3 4", "0 1 2 3 4 5 6 7 8", "8 9 10 11"]
    v = spark.createDataFrame([("the cat",), ("",), (None,)], "t string").select(models.hashing_embedding(F.col("t"))).collect()
    assert [round(sum(x * x for x in r[0]), 3) for r in v] == [1.0, 0.0, 0.0]


def test_parse_or_text(spark):
    cases = {"abc": ("abc", "text"), "{}": ("", ""), '{"type":"image","content":"b"}': ("b", "image"), "[1]": ("[1]", "text"), '{"content": "x"': ('{"content": "x"', "text")}
    c, t = jsons.parse_or_text(F.col("v"))
    got = {r["v"]: (r["c"], r["t"]) for r in spark.createDataFrame([(v,) for v in cases], "v string").select("v", c.alias("c"), t.alias("t")).collect()}
    assert got == cases


def test_insert_twice_adds_nothing(spark, tmp_path):
    docs, vec = str(tmp_path / "docs"), str(tmp_path / "vec")
    e = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", "f")], "content string, filename string").withColumns(
        {"context": F.lit(""), "type": F.lit("text"), "metadata": F.lit("{}")}
    )
    for _ in range(2):
        pipelines.populate(spark, e, docs, vec)
        assert spark.read.parquet(docs).count() == 2
        assert spark.read.parquet(vec).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from docloom.streaming.ingest import ingest, watch

    src, at = str(tmp_path / "src"), str(tmp_path)
    df = spark.createDataFrame([("a", "f", "text"), ("b", "f", "text")], "content string, filename string, type string")
    to = lambda b: b.withColumns({"context": F.lit(""), "description": F.col("content"), "metadata": F.lit("{}")})
    for _ in range(2):
        df.write.mode("append").parquet(src)
        ingest(watch(spark, src, schema=df.schema), to, f"{at}/docs", f"{at}/vec", f"{at}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{at}/docs").count() == 2


def test_failed_model_rows_keep_their_error(spark):
    def model(systems, asked):
        if any("bad" in p for a in asked for p in a):
            raise ValueError("no")
        return ["ok"] * len(asked)

    got = models.generate(spark.createDataFrame([("good",), ("bad",)], "t string").coalesce(1), "a", ["t"], model).collect()
    assert {(r["t"], r["a"], r["a_error"]) for r in got} == {("good", "ok", None), ("bad", None, "no")}


def test_extraction(spark):
    e = spark.createDataFrame(
        [("1", "x", "text"), ("2", None, "text"), ("3", "x", None), ("4", "x", "audio"), ("5", "none", "text")], "id string, content string, type string"
    ).withColumns({"description": F.lit(""), "context": F.lit("")})
    plan = {r["id"]: r["reason"] for r in triples.extraction_plan(e).collect()}
    assert plan == {"1": None, "2": "no content", "3": "no type", "4": "unknown type", "5": None}
    model = lambda s, a: ['{"relationships": []}' if x[0] == "none" else '{"relationships": [{"head": "a", "relation": "R", "tail": "b"}]}' for x in a]
    raw = triples.extract(e, {"text": model}, concurrency=1)
    assert {r["id"]: len(r["relationships"]) for r in raw.collect()} == {"1": 1, "5": 0}
    assert triples.explode_triples(raw).count() == 1


def test_markdown_triples(spark):
    md = "Intro\n| No. | Revenue (Q1) | Cost |\n|---|---|---|\n| A | 1 | N/A |\n| B |  | 2 |"
    got = triples.markdown_triples(spark.createDataFrame([(1, md), (2, None), (3, "no table")], "k int, content string"), "k").collect()
    assert {(r["head"], r["relation"], r["tail"]) for r in got} == {("A", "REVENUE_Q1", "1"), ("B", "COST", "2")}


def test_graph(spark):
    t = spark.createDataFrame(
        [("a", "P", "KNOWS", "b", "P", 0.5), ("a", "P", "KNOWS", "b", "P", 0.9), ("b", "P", "IN", "c", "G", 1.0), ("x", "P", "IN", "x", "G", 1.0), (None, "P", "IN", "c", "G", 1.0)],
        "head string, head_type string, relation string, tail string, tail_type string, confidence double",
    )
    e = graph.edges(t)
    assert {(r["src"], r["dst"], r["weight"], r["confidence"]) for r in e.collect()} == {("a", "b", 2, 0.9), ("b", "c", 1, 1.0), ("x", "x", 1, 1.0)}
    assert [tuple(r) for r in graph.match(e, "KNOWS", "IN").collect()] == [("a", "b", "c")]
    assert {r["node"]: r["degree"] for r in graph.degrees(e).collect()} == {"a": 1, "b": 2, "c": 1}
    assert graph.upsert_edges(e, e).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a int, b int")
    assert {r["node"]: r["component"] for r in graph.components(path).collect()} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert graph.components(path.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert [r["filename"] for r in readers.files(spark, str(tmp_path)).collect()] == ["a.pdf"]
    html = spark.createDataFrame([("u", "<h1>T</h1><p>a <b>c</b></p>")], "url string, html string")
    assert [(r["label"], r["text"]) for r in readers.html_items(html).orderBy("seq").collect()] == [("section_header", "T"), ("text", "a c")]
    code = spark.createDataFrame([("import x\ndef f():\n  pass\nclass A:\n  pass",)], "text string")
    assert readers.code_blocks(code).count() == 3


def test_prompt_and_search(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, "Why?", [0.4, 0.0]), (2, "Who?", [9.0, 0.0])], "qid long, question string, qvec array<float>")
    hits = search.top_k(q, v, 2)
    assert {(r["qid"], r["doc_id"], r["rank"]) for r in hits.collect()} == {(1, 0, 1), (1, 1, 2), (2, 5, 1), (2, 4, 2)}
    assert sorted(map(tuple, search.top_k(q, v, 2, block=1).collect())) == sorted(map(tuple, hits.collect()))
    docs = spark.createDataFrame([(0, '{"content":"zero","type":"text"}'), (1, '{"content":"aGk=","type":"image"}')], "id long, value string")
    found = rag.modalities(rag.route(search.parents(hits, docs)))
    p = {r["qid"]: r for r in rag.prompts(q, found).collect()}
    assert p[1]["prompt"] == "Context:\n[Source 0]: zero\n\nQuestion: Why?"
    assert p[1]["messages"][1]["parts"][1]["url"] == "data:image/png;base64,aGk="
    assert p[2]["prompt"] == "Context:\n\n\nQuestion: Who?"
    assert store.with_ids(spark.createDataFrame([("c", "f")], "content string, filename string")).first()["id"]


def test_pictures(spark):
    import zlib

    import numpy as np

    from docloom.functions import images

    r = np.random.default_rng(0)
    for shape in ((5, 7), (4, 4, 2), (9, 3, 3), (2, 6, 4)):
        p = r.integers(0, 256, shape, dtype=np.uint8)
        assert (images.decode_png(images.encode_png(p)) == p.reshape(*shape[:2], -1)).all()
    assert images.decode_png(b"no picture") is None and images.decode_png(images.SIGNATURE + b"cut") is None
    # each way of filtering a line, undone by its definition
    p = r.integers(0, 256, (5, 6, 3), dtype=np.uint8).astype(int)
    big = np.zeros((6, 7, 3), int)
    big[1:, 1:] = p
    a, b, c = big[1:, :-1], big[:-1, 1:], big[:-1, :-1]
    d = [abs(a + b - c - v) for v in (a, b, c)]
    guess = [0 * a, a, b, (a + b) // 2, np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], b, c))]
    lines = b"".join(bytes([y]) + ((p - guess[y])[y] % 256).astype(np.uint8).tobytes() for y in range(5))
    plain = images.encode_png(p.astype(np.uint8))
    at = plain.index(b"IDAT")
    packed = zlib.compress(lines)
    own = plain[: at - 4] + len(packed).to_bytes(4, "big") + b"IDAT" + packed + b"0000" + plain[plain.index(b"IEND") - 4 :]
    assert (images.decode_png(own) == p).all()
    smooth = np.kron(r.integers(0, 255, (5, 5)), np.ones((20, 20))).astype(np.uint8)
    h = images.hash_pixels(smooth)
    assert bin(h ^ images.hash_pixels(smooth[::2, ::2])).count("1") <= 10 and h == images.hash_pixels(np.stack([smooth] * 3, axis=2))
    assert bin(h ^ images.hash_pixels(np.kron(r.integers(0, 255, (5, 5)), np.ones((20, 20))))).count("1") > 10
    df = spark.createDataFrame([("QUI=",), ("?",), (None,)], "t string")
    assert [x[0] for x in df.select(images.from_base64(F.col("t"))).collect()] == [b"AB", None, None]
    assert [x[0] for x in df.select(images.perceptual_hash(F.col("t"))).collect()] == [None, None, None]


def test_near_hashes_equal_all_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(20)]
    h = base + [b ^ sum(1 << i for i in r.sample(range(63), r.randint(0, 14))) for b in base for _ in range(4)]
    df = spark.createDataFrame([("g" if i % 3 else "h", i, x) for i, x in enumerate(h)], "g string, k long, h long")
    for threshold in (0, 3, 7, 10, 11, 14):
        got = {(x["a"], x["b"], x["distance"]) for x in dedup.hamming_pairs(df, "g", "k", "h", threshold).collect()}
        want = {(i, j, bin(x ^ y).count("1")) for i, x in enumerate(h) for j, y in enumerate(h) if i < j and bool(i % 3) == bool(j % 3) and bin(x ^ y).count("1") <= threshold}
        assert got == want


def test_top_k_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0]), (6, [0.0, 2.0])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "qid string, qvec array<float>")
    got = lambda metric: [(x["qid"], x["doc_id"], x["score"]) for x in search.top_k(q, v, 2, metric).orderBy("qid", "rank").collect()]
    assert got("l2") == [("a", 1, 0.0), ("a", 5, 0.0), ("b", 2, 1.0), ("b", 6, 1.0)]
    assert got("cosine") == [("a", 1, 1.0), ("a", 5, 1.0), ("b", 6, 1.0), ("b", 1, 0.0)]
    assert search.top_k(q.limit(0), v).count() == search.top_k(q, v.limit(0)).count() == 0


def test_long_items_and_headings(spark):
    items = items_of(spark, {"f": [("text", "a b c d e"), ("section_header", "H"), ("text", "x y")]})
    got = [r["text"] for r in elements.pack_chunks(elements.split_items(items, 2), 2).orderBy("chunk_no").collect()]
    assert got == ["a b", "c d", "e\nH", "x y"]
    got = [r["text"] for r in elements.pack_chunks(items, 9, headings=True).orderBy("chunk_no").collect()]
    assert got == ["a b c d e", "H\nx y"]


def test_community_facts(spark):
    e = spark.createDataFrame([("a", "R", "b", 2), ("b", "R", "c", 1), ("c", "R", "x", 1)], "src string, rel string, dst string, weight long")
    c = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")], "node string, community string")
    got = {r["community"]: (r["n_nodes"], r["n_edges"], r["facts"]) for r in graph.community_facts(e, c, 1).collect()}
    assert got == {"a": (3, 2, "a R b"), "x": (1, 0, "")}


def test_graph_store(spark, tmp_path):
    n = spark.createDataFrame([("a", "Entity", "T", 1), ("b", "Entity", None, 2)], "node string, label string, type string, n long")
    e = spark.createDataFrame([("a", "R", "b", 1, 0.5)], "src string, rel string, dst string, weight long, confidence double")
    at = str(tmp_path / "g")
    assert [x.count() for x in graph.open_graph(spark, at)] == [0, 0]
    for _ in range(2):
        graph.store_graph(spark, n, e, at)
    graph.store_graph(spark, n.limit(0), e.withColumn("rel", F.lit("S")), at)
    assert [x.count() for x in graph.open_graph(spark, at)] == [2, 2]


def test_budgets_of_a_public_tokenizer(spark):
    import public_tokenizers

    from docloom.functions import tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["The harbour wall was moved.", "", None, "internationalisation " * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tokenizer.count(F.col("t"), path), tokenizer.decode(tokenizer.encode(F.col("t"), path), path), tokenizer.central_crop(F.col("t"), 3, path)).collect()
    many = tokenizer.counter(path)
    assert [r[0] for r in got] == [many(t or "") for t in texts] and [r[1] for r in got] == [t or "" for t in texts]
    assert all(r[2] == t if not t or many(t) <= 3 else many(r[2]) <= 4 and r[2] in t for r, t in zip(got, texts))
    items = items_of(spark, {"f": [("text", "one two"), ("table", "internationalisation"), ("text", "three four")]})
    own = F.coalesce("text", F.lit(""))
    near = elements.context(items, F.col("label") == "table", many("internationalisation") + 4, tokenizer.count(own, path), tokenizer.central_crop(own, 3, path)).first()
    assert near["context"] == "one two\n\ninternationalisation\n\nthree four" and near["prev_tokens"] == 2
    small = elements.context(items, F.col("label") == "table", 1, tokenizer.count(own, path), tokenizer.central_crop(own, 1, path)).first()
    assert small["prev_n"] == 0 and small["context"] in "internationalisation" and many(small["context"]) < many("internationalisation")


def test_entity_forms(spark):
    cases = {' "Galsasky  Power S.A." ': "Galsasky Power S.A", "JASGO POWER LTD": "Jasgo Power Ltd", "JPOA": "Jpoa", "R. C.": "R. C", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(triples.normal_entity(F.col("t"))).collect()] == list(cases.values())


@pytest.mark.parametrize("threshold", [0, 2, 5, 11])
def test_greedy_rounds_equal_the_fold(spark, threshold):
    r = random.Random(threshold)
    rows, h = [], 0
    for i in range(160):
        h = r.choice([h, h ^ (1 << r.randrange(63)), h ^ sum(1 << b for b in r.sample(range(63), 6)), r.getrandbits(63)])
        rows.append((r.choice(["g", "h", None]), i, h))
    df = spark.createDataFrame([*rows, ("g", 999, None)], "g string, o int, h long")
    got = {tuple(x) for x in dedup.greedy_near(df, "g", "o", "h", threshold).collect()}
    assert got == {tuple(x) for x in dedup.greedy_hamming(df, "g", "o", "h", threshold).collect()}
    assert dedup.greedy_near(df.limit(0), "g", "o", "h").count() == 0
