"""Whole pipelines."""

from docloom.plans import pipelines, prompts


def test_command_line_fills_the_stores_once(spark, tmp_path):
    from docloom.__main__ import main

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("The pump was moved.\nIt is new.\n| A | B |\n|---|---|\n| 1 | 2 |\nThe end.")
    (src / "b.md").write_text("not read")
    for _ in range(2):
        main(["-df", str(src), "-db", str(tmp_path / "db"), "--budget", "6"])
    docs = spark.read.parquet(str(tmp_path / "db/docs")).collect()
    assert sorted(r["type"] for r in docs) == ["table"] * 3 + ["text"] * 4
    assert len({r["id"] for r in docs}) == len(docs) == spark.read.parquet(str(tmp_path / "db/vectors")).count()
    assert all(r["context"] for r in docs if r["type"] == "table") and all(r["description"] for r in docs)


def png(spark_rows):
    import base64

    from docloom.functions.images import encode_png

    return base64.b64encode(encode_png(spark_rows)).decode()


def test_near_equal_pictures_are_one_element(spark):
    import numpy as np

    r = np.random.default_rng(1)
    smooth = np.kron(r.integers(0, 255, (6, 6)), np.ones((12, 12))).astype(np.uint8)
    other = np.kron(r.integers(0, 255, (6, 6)), np.ones((12, 12))).astype(np.uint8)
    near = smooth.copy()
    near[3, 3] += 1
    one, two, three = png(smooth), png(near), png(np.stack([other] * 3, axis=2))
    rows = [("f", 0, "#/0", "text", "See the pump.", None), ("f", 1, "#/1", "picture", "Fig. 1", one), ("f", 2, "#/2", "picture", "Fig. 2", two), ("f", 3, "#/3", "picture", "Fig. 3", three), ("g", 0, "#/0", "picture", "Fig.", two), ("g", 1, "#/1", "picture", "no image", None)]
    prov = "array<struct<page:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>"
    items = spark.createDataFrame(rows, "filename string, seq int, self_ref string, label string, text string, image string").selectExpr("*", f"cast(null as {prov}) as prov")
    got = sorted((x["filename"], x["content"]) for x in pipelines.build_elements(items).where("type = 'image'").collect())
    assert got == sorted([("f", one), ("f", three), ("g", two), ("g", "no image")])


def test_prompts_reach_the_extraction_model(spark):
    e = spark.createDataFrame([("1", "t", "", "", "text")], "id string, content string, context string, description string, type string")
    asked = []

    def model(systems, parts):
        asked.extend(systems)
        return ['{"relationships": [{"head": "%s", "head_type": "T", "relation": "R", "tail": "b", "tail_type": "T", "confidence": 1.0, "context": "c", "language": "eng"}]}' % s.count("(PERSON)-[OWNS]->(ORG)") for s in systems]

    nodes, _, _ = pipelines.build_graph(e, {"text": model}, kinds=[("PERSON", "OWNS", "ORG")])
    assert {r["node"] for r in nodes.collect()} == {"1", "b"}
    assert prompts.with_schema("x", []) == "x" and prompts.EXTRACTION["text"]


def test_counts_of_what_was_stored(spark, tmp_path):
    e = spark.createDataFrame([("x", "", "text", "{}", "f"), ("y", "", "text", "{}", "f"), ("y", "", "text", "{}", "f")], "content string, context string, type string, metadata string, filename string")
    at = [str(tmp_path / "d"), str(tmp_path / "v")]
    from pyspark.sql import functions as F

    embed = F.array(F.length("description").cast("float"), F.lit(1.0).cast("float"))
    assert pipelines.populate(spark, e, *at, embed=embed) == {"records": 2, "vectors": 2}
    assert pipelines.populate(spark, e, *at, embed=embed) == {"records": 0, "vectors": 0}
    assert {len(r["embedding"]) for r in spark.read.parquet(at[1]).collect()} == {2}


def test_summaries_go_to_the_model_of_their_type(spark):
    e = spark.createDataFrame([("1", "t", "c", "text"), ("2", "b", "c", "image"), ("3", "m", "c", "table"), ("4", "u", "c", None)], "id string, content string, context string, type string")
    models = {k: lambda s, a, k=k: [f"{k}:{'+'.join(x)}" for x in a] for k in prompts.SUMMARY}
    got = {r["id"]: r["description"] for r in pipelines.summarise(e, models).collect()}
    assert got == {"1": "text:t", "2": "image:c+b", "3": "table:c+m", "4": "text:u"}


def test_failed_summaries_wait_for_the_next_run(spark, tmp_path):
    e = spark.createDataFrame([("x", "", "text", "{}", "f"), ("bad", "", "text", "{}", "f")], "content string, context string, type string, metadata string, filename string")

    def flaky(systems, asked):
        if any("bad" in p for a in asked for p in a):
            raise ValueError("not now")
        return ["fine"] * len(asked)

    at = [str(tmp_path / "d"), str(tmp_path / "v")]
    pipelines.populate(spark, e, *at, {"text": flaky})
    assert spark.read.parquet(at[0]).count() == 1
    pipelines.populate(spark, e, *at, {"text": lambda s, a: ["fine"] * len(a)})
    assert spark.read.parquet(at[0]).count() == 2


def test_graph_answers(spark):
    q = spark.createDataFrame([(1, "Who?"), (2, "What?")], "qid long, question string")
    rows = spark.createDataFrame([(1, "b"), (1, "a")], "qid long, row string")
    got = {r["qid"]: r["answer"] for r in pipelines.graph_answers(q, rows, lambda s, a: ["/".join(x) for x in a]).collect()}
    assert got == {1: "Who?/a\nb", 2: prompts.NOT_KNOWN}


def test_questions_to_answers(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "doc_id long, embedding array<float>")
    docs = spark.createDataFrame([(i, '{"content":"d%d","type":"text"}' % i) for i in range(5)], "id long, value string")
    q = spark.createDataFrame([(7, "Which?", [3.1])], "qid long, question string, qvec array<float>")
    got = pipelines.answer_questions(q, v, docs, 2, model=lambda s, a: [x[0] for x in a]).first()
    assert got["answer"] == "Context:\n[Source 0]: d3\n\n[Source 1]: d4\n\nQuestion: Which?"


def test_questions_as_patterns(spark):
    edges = spark.createDataFrame([("a", "OWNS", "b", 3), ("a", "OWNS", "c", 1), ("d", "MADE", "b", 2)], "src string, rel string, dst string, weight long")
    q = spark.createDataFrame([(1, '{"head": "a", "relation": "OWNS"}'), (2, '{"tail": "b"}'), (3, "no pattern"), (4, '{"head": "zz"}'), (5, "{}")], "qid long, question string")
    got = {r["qid"]: r["answer"] for r in pipelines.ask_graph(q, edges, lambda s, a: [x[0] for x in a], lambda s, a: [x[1] for x in a], most=2).collect()}
    assert got == {1: "a OWNS b\na OWNS c", 2: "a OWNS b\nd MADE b", 3: prompts.NOT_KNOWN, 4: prompts.NOT_KNOWN, 5: prompts.NOT_KNOWN}


def test_community_summaries(spark):
    edges = spark.createDataFrame([("a", "R", "b", 2), ("x", "R", "y", 1)], "src string, rel string, dst string, weight long")
    got = {r["community"]: r["summary"] for r in pipelines.summarise_communities(edges, 5, lambda s, a: [f"{s[0] == prompts.COMMUNITY}:{x[0]}" for x in a]).collect()}
    assert got == {"a": "True:a R b", "x": "True:x R y"}


def test_files_by_a_parser(spark, tmp_path):
    from docloom.sources import readers

    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(name.encode() * 2)
    parse = lambda name, data: [{"filename": name, "seq": i, "self_ref": f"#/{i}", "label": "text", "text": w, "prov": None} for i, w in enumerate(data.decode().split("."))]
    got = readers.parse_files(readers.files(spark, str(tmp_path), "*.bin"), parse).collect()
    assert sorted((r["filename"], r["seq"], r["text"]) for r in got) == [(n, i, t) for n in ("a.bin", "b.bin") for i, t in enumerate(n.split(".")[:1] + [f"bin{n[0]}", "bin"])]
    assert [tuple(r) for r in readers.literal_documents(spark, ["x", "y"]).collect()] == [(0, "x"), (1, "y")]
    assert readers.setting(spark, "docloom.none", "z") == "z"
