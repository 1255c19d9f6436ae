"""Ontology, questions, gates, deciders, assembly, audit and evaluation."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ontoweave.operators import assemble, decide, evaluate, grounding, ontology
from ontoweave.plans import scoring
from ontoweave.operators import questions as Q
from ontoweave.plans.pipeline import extract

NEWS = ontology.from_dict({
    "id": "news",
    "types": [{"id": "person", "description": "Somebody."}, {"id": "COMPANY", "description": "A firm.", "aliases": ["startup"]}, "big place"],
    "relations": [
        {"id": "WORKS_FOR", "description": "Works for.", "domain": ["PERSON"], "range": ["COMPANY"]},
        {"id": "FOUNDED", "description": "Founded.", "domain": ["PERSON"], "range": ["COMPANY"]},
        {"id": "CREATED_BY", "description": "Made by.", "domain": ["COMPANY"], "range": ["PERSON"]},
        {"id": "HEADQUARTERED_IN", "description": "Has its seat in.", "domain": ["COMPANY"], "range": ["BIG_PLACE"]},
    ],
    "gazetteer": {"Ada Byron": "PERSON", "Acme Inc": "COMPANY", "Zeta": "COMPANY", "Rome": "big place"},
})


def test_ontology_rules():
    assert [k.id for k in NEWS.kinds] == ["PERSON", "COMPANY", "BIG_PLACE"] and NEWS.kinds[2].description == "Big Place"
    assert ("COMPANY", "BIG_PLACE", "HEADQUARTERED_IN", 3) in NEWS.signatures
    for broken, word in (({"types": ["A"]}, "2 to"), ({"types": ["A", "A"]}, "one id"), ({"types": ["A", "B"], "gazetteer": {"x": "C"}}, "no kind"), ({"types": ["A", "B"], "relations": [{"id": "R", "description": "", "domain": ["A"], "range": ["Z"]}]}, "no kind")):
        with pytest.raises(ontology.OntologyError, match=word):
            ontology.from_dict(broken)
    symmetric = ontology.from_dict({"types": ["A", "B"], "relations": [{"id": "R", "description": "", "domain": ["A"], "range": ["B"], "symmetric": True}]})
    assert {s[:2] for s in symmetric.signatures} == {("A", "B"), ("B", "A")}
    assert NEWS.describe()["legal_pairs"][0] == "PERSON -[WORKS_FOR]-> COMPANY"
    wide = ontology.from_dict({"types": [f"T{i}" for i in range(30)]})
    assert wide.needs_groups() and [len(g) for g in wide.groups()] == [25, 5]


def test_bundled_and_starter(tmp_path):
    assert "trade" in ontology.bundled_names() and ontology.load("trade").id == "trade"
    out = ontology.write_starter(tmp_path / "o.yaml")
    assert ontology.load(out).id == "mine"
    with pytest.raises(FileExistsError):
        ontology.write_starter(out)
    with pytest.raises(FileNotFoundError, match="trade"):
        ontology.load("nothing")
    text = (ontology.Path(ontology.__file__).parent / "ontologies" / "trade.yaml").read_text()
    yaml = pytest.importorskip("yaml")
    assert ontology.read_simple_yaml(text) == yaml.safe_load(text)


def test_gate_bands(spark):
    g = decide.Gate()
    rows = spark.createDataFrame([("A", 0.9, 0.8, False), ("A", 0.2, 0.9, False), ("A", 0.55, 0.4, False), ("A", 0.9, 0.9, True), ("N", 0.95, 0.9, False), ("A", 0.7, None, False)], "c string, p double, s double, f boolean")
    bands = [r.b for r in rows.select(g.choice(F.col("c"), F.col("p"), F.col("s"), F.col("f"), ("N",)).alias("b")).collect()]
    assert bands == ["ACCEPT", "REJECT", "REVIEW", "REVIEW", "REJECT", "ACCEPT"]
    nouls = spark.createDataFrame([(0.8,), (0.2,), (0.5,)], "p double").select(g.noul(F.col("p")).alias("b"))
    assert [r.b for r in nouls.collect()] == ["ACCEPT", "REJECT", "REVIEW"]
    for bad in ({"accept_prob": 1.2}, {"noul_yes": 0.1}):
        with pytest.raises(ValueError):
            decide.Gate(**bad)


@pytest.mark.parametrize(
    ("sentence", "source", "target", "relation", "p"),
    [
        ("Ada Byron works for Acme Inc.", "Ada Byron", "Acme Inc", "WORKS_FOR", 0.95),
        ("Acme Inc was founded by Ada Byron.", "Ada Byron", "Acme Inc", "FOUNDED", 0.94),
        ("Ada Byron was founded by Acme Inc.", "Ada Byron", "Acme Inc", "FOUNDED", 0.08),
        ("Acme Inc was created by Ada Byron.", "Acme Inc", "Ada Byron", "CREATED_BY", 0.94),
        ("Ada Byron never founded Acme Inc.", "Ada Byron", "Acme Inc", "FOUNDED", 0.04),
        ("Ada Byron might have founded Acme Inc.", "Ada Byron", "Acme Inc", "FOUNDED", 0.5),
        ("Ada Byron works with Acme Inc.", "Ada Byron", "Acme Inc", "WORKS_FOR", 0.62),
        ("Ada Byron met Acme Inc, which works for all.", "Ada Byron", "Acme Inc", "WORKS_FOR", 0.45),
        ("Ada Byron met Acme Inc.", "Ada Byron", "Acme Inc", "WORKS_FOR", 0.03),
        ("Nothing here.", "Ada Byron", "Acme Inc", "WORKS_FOR", 0.03),
        ("Ada Byron works a b c d e f g h i for Acme Inc.", "Ada Byron", "Acme Inc", "WORKS_FOR", 0.6),
    ],
)
def test_rules_for_links(spark, sentence, source, target, relation, p):
    row = spark.createDataFrame([(sentence, source, target, relation)], "sentence string, src_text string, tgt_text string, relation string")
    assert decide.rule_links(row, NEWS).first().prob == pytest.approx(p)


def test_rules_for_names(spark):
    rows = spark.createDataFrame([("Ada", "We met Ada.", False), ("Names", "Names are long.", False), ("cat", "A cat.", False), ("v2", "On v2.", False), ("x-y", "An x-y.", False), ("any", "", True)], "m string, s string, l boolean")
    assert [r.p for r in rows.select(decide.rule_name(F.col("m"), F.col("s"), F.col("l")).alias("p")).collect()] == [0.88, 0.15, 0.15, 0.88, 0.5, 0.95]


def test_pipeline_scenarios(spark):
    docs = spark.createDataFrame(
        [("a", "Ada Byron works for Acme Inc. Acme Inc is headquartered in Rome."), ("b", "Ada Byron never founded Zeta. Ada Byron might have founded Acme Inc."), ("c", "```\nAda Byron works for Acme Inc.\n```\n"), ("d", None), ("e", "Zeta uses Zeta. She said so."), ("f", "")],
        "document_id string, text string")
    x = extract(docs, NEWS)
    links = {(r.document_id, r.source, r.relation_type, r.target) for r in x.relationships.collect()}
    # "Inc." does not end a sentence, so the first note is one sentence
    assert links == {("a", "ADA_BYRON", "WORKS_FOR", "ACME_INC"), ("a", "ACME_INC", "HEADQUARTERED_IN", "ROME")}
    items = {(r.document_id, r.queue, r.asked) for r in x.items.collect()}
    assert ("b", "rejected", "FOUNDED") in items and ("b", "review", "FOUNDED") in items
    assert assemble.audit(x.entities, x.relationships, x.sentences, NEWS).count() == 0
    stats = {r.document_id: r for r in x.statistics().collect()}
    assert stats["e"].mentions_skipped == 1 and stats["a"].relationships == 2
    assert {r.decided_by for r in x.lineage().collect()} == {"ontology", "model"}


def test_assembly_order_and_reasons(spark):
    schema = "document_id string, sentence_id string, text string, entity_type string, band string, winner_prob double, start_char int, end_char int, d_ord int, t_ord int"
    typed = spark.createDataFrame([
        ("d", "s", "Acme", "COMPANY", "ACCEPT", 0.8, 0, 4, 0, 0), ("d", "s", "the Acme", "PERSON", "ACCEPT", 0.9, 9, 17, 1, 1), ("d", "s", "42", "COMPANY", "ACCEPT", 0.9, 20, 22, 2, 2),
        ("d", "s", "a" * 32, "COMPANY", "ACCEPT", 0.9, 30, 62, 3, 3), ("d", "s", "Bo", "NOT_ENTITY", "ACCEPT", 0.9, 70, 72, 4, 4), ("d", "s", "Cy", "PERSON", "REVIEW", 0.5, 80, 82, 5, 5)], schema)
    routed = assemble.route_mentions(typed)
    entity = assemble.merge_entities(routed).collect()
    assert [(e.name, e.entity_type, e.importance, e.source_spans) for e in entity] == [("ACME", "COMPANY", 0.9, "Acme; the Acme")]
    assert {(r.text[:2], r.route, r.reason) for r in routed.where("route <> 'entity'").collect()} == {("42", "rejected", "opaque_or_empty_name"), ("aa", "rejected", "opaque_or_empty_name"), ("Bo", "rejected", None), ("Cy", "review", None)}


def test_answers_are_checked(spark):
    rows = [
        ({"type": "noul", "noul": 0.4}, None), ({"type": "noul", "noul": 1.4}, "noul out of range"), ({"type": "choice", "choice": "A", "probabilities": {"A": 0.9, "B": 0.1}}, None),
        ({"type": "choice", "choice": "C", "probabilities": {"A": 0.9, "B": 0.1}}, "choice has no probability"), ({"type": "choice", "choice": "A", "probabilities": {"A": 0.5}}, "probabilities do not sum to 1"),
        ({"type": "score", "score": None}, "no finite score"), ({"type": "odd"}, "unknown type"), ({"type": None}, "no type"), ({"type": "noul", "noul": 0.1, "confidence": 2.0}, "confidence out of range")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], f"i int, answer {Q.ANSWER}")
    got = {r.i: r.p for r in df.select("i", Q.answer_problem(F.col("answer")).alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(rows)}
    asked = df.where("i = 2").select(Q.answer_problem(F.col("answer"), F.array(F.lit("B"))).alias("p")).first().p
    assert asked == "choice was not asked"
    good, bad = decide.split_valid(df.withColumn("question_key", F.col("i").cast("string")))
    assert good.count() == 2 and bad.count() == 7
    with pytest.raises(Exception, match="unusable"):
        decide.split_valid(df, strict=True)[0].collect()


def test_numbers_of_answers(spark):
    row = spark.createDataFrame([([1.0, 2.0, 0.5],)], "z array<double>").select(Q.softmax(F.col("z")).alias("p")).select("p", Q.confidence(F.col("p")).alias("c"), Q.winner(F.col("p")).alias("w"), Q.expected_level(F.col("p")).alias("s")).first()
    e = [math.exp(x) for x in (1.0, 2.0, 0.5)]
    p = [x / sum(e) for x in e]
    assert row.p == pytest.approx(p) and row.w == 1 and row.c == pytest.approx(1 + sum(x * math.log(x) for x in p) / math.log(3)) and row.s == pytest.approx(p[1] + 2 * p[2])


def test_packing_equals_the_loop(spark):
    sizes = [10, 3000, 6000, 100, 200, 7000, 1, 1, 1, 4000]
    rows = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate(sizes)], "document_id string, idx int, q string")
    got = [r.call_no for r in Q.pack(rows, ["document_id"], ["idx"], "q", 3).orderBy("idx").collect()]
    want, call, n, total = [], 0, 0, 0
    for s in sizes:
        tokens = -(-s // 4) + 80
        if n >= 3 or n and total + tokens > 2000:
            call, n, total = call + 1, 0, 0
        n, total = n + 1, total + tokens
        want.append(call)
    assert got == want


def test_keys_and_cache(spark):
    df = spark.createDataFrame([("m", "s", "noul", "q?", "a"), ("m", "s", "noul", "q?", "b")], "m string, s string, k string, i string, o string")
    keys = [r.k for r in df.select(Q.question_key(*[F.col(c) for c in "mskio"]).alias("k")).collect()]
    assert len(set(keys)) == 2 and all(len(k) == 64 for k in keys)
    asked = spark.createDataFrame([("k1",), ("k1",), ("k2",), ("k3",)], "question_key string")
    kept = spark.createDataFrame([("k2", "old", 1), ("k2", "new", 2)], "question_key string, answer string, created_at int")
    assert sorted(r.question_key for r in decide.misses(asked, kept).collect()) == ["k1", "k3"]
    assert {r.question_key: r.answer for r in decide.from_answers(asked, kept).collect()}["k2"] == "new"


def test_prefix_and_rotation(spark):
    row = spark.createDataFrame([([1, 2, 3], [1, 2, 4], [1, 2, 3], [])], "a array<int>, b array<int>, c array<int>, d array<int>")
    got = row.select(Q.common_prefix_length(F.col("a"), F.col("b")), Q.common_prefix_length(F.col("a"), F.col("c")), Q.common_prefix_length(F.col("a"), F.col("d"))).first()
    assert tuple(got) == (2, 3, 0)
    schema = "question_key string, choice string, winner_prob double, confidence double"
    first = spark.createDataFrame([("k", "A", 0.6, 0.2), ("l", "A", 0.6, 0.9)], schema)
    second = spark.createDataFrame([("k", "B", 0.7, 0.3), ("l", "B", 0.7, 0.3)], schema)
    out = {r.question_key: (r.choice, r.flipped) for r in decide.rotate(first, second, decide.Gate(rotate_below_confidence=0.5)).collect()}
    assert out == {"k": ("B", True), "l": ("A", False)}


def test_scores_and_spans(spark):
    e = "doc_id string, start_char int, end_char int, type string"
    r = "doc_id string, src_start int, src_end int, tgt_start int, tgt_end int, type string"
    gold_e, pred_e = spark.createDataFrame([("d", 0, 8, "P"), ("d", 20, 26, "L")], e), spark.createDataFrame([("d", 0, 8, "P"), ("d", 20, 26, "P")], e)
    gold_r, pred_r = spark.createDataFrame([("d", 0, 8, 20, 26, "IN")], r), spark.createDataFrame([("d", 20, 26, 0, 8, "IN")], r)
    s = evaluate.span_scores(pred_e, gold_e, pred_r, gold_r).first()
    assert (s.entity_tp, s.entity_fp, s.entity_fn, s.boundary_only, s.link_tp, s.link_fp, s.direction_swaps) == (1, 1, 1, 1, 0, 1, 1)
    empty = spark.createDataFrame([], "doc_id string, k string")
    one = spark.createDataFrame([("d", "x"), ("d", "x")], "doc_id string, k string")
    got = evaluate.prf(one, empty, ["doc_id", "k"], ["doc_id"]).first()
    assert (got.tp, got.fp, got.fn, got.f1) == (0, 1, 0, 0.0)


def test_curve_and_gate(spark):
    rows = spark.createDataFrame([("g", 0.9, True, 1), ("g", 0.8, True, 2), ("g", 0.6, False, 3), ("g", 0.55, True, 4), ("g", 0.3, False, 5)], "g string, prob double, correct boolean, ord int")
    points = evaluate.curve(rows, ["g"])
    assert [round(r.error, 3) for r in points.orderBy("rank").collect()] == [0.0, 0.0, 0.333, 0.25, 0.4]
    fit = evaluate.fit_gate(points, ["g"], 0.25).first()
    assert (fit.accept_prob, fit.reject_prob) == (0.55, pytest.approx(0.275))
    assert evaluate.fit_gate(points, ["g"], -1.0).first().accept_prob == 0.70


def test_grounding(spark):
    replies = [("a", 'Sure:\n```json\n{"entities":[{"name":"Ada Byron","type":"person"},{"name":"ADA byron","type":"COMPANY"},{"name":"Acme Inc","entity_type":"COMPANY"},{"name":"Q","type":"ODD"}],"relations":[{"source":"Ada Byron","target":"Acme Inc.","type":"works_for"},{"source":"Acme Inc","target":"Acme Inc","type":"FOUNDED"}]}\n```'), ("b", "no json"), ("c", "[1]"), ("d", None)]
    parsed = grounding.parse_replies(spark.createDataFrame(replies, "document_id string, content string"))
    assert {r.document_id: r.ok for r in parsed.collect()} == {"a": True, "b": False, "c": False, "d": False}
    ents, rels = grounding.ground(parsed, NEWS)
    assert {(r.name, r.entity_type) for r in ents.collect()} == {("ADA_BYRON", "PERSON"), ("ACME_INC", "COMPANY")}
    assert [(r.source, r.relation_type, r.target) for r in rels.collect()] == [("ADA_BYRON", "WORKS_FOR", "ACME_INC")]
    assert grounding.retry_waits() == [1.0, 2.0, 4.0]


def test_every_body_of_a_document_is_grounded(spark, tmp_path):
    body = lambda *names: '{"entities":[' + ",".join(f'{{"name":"{n}","type":"PERSON"}}' for n in names) + "]}"
    rows = [("d", body("Ada", "Bo")), ("d", body("Zoe", "ada")), ("d", body("Zoe", "ada")), ("d", None), ("d", "{"), ("e", body("Cy")), (None, body("No"))]
    spark.createDataFrame(rows, "document_id string, body string").write.parquet(str(tmp_path / "label_files.parquet"))
    got = [(r.document_id, r.name) for r in scoring.grounded_replies(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("d", "ADA"), ("d", "BO"), ("d", "ZOE"), ("e", "CY")]
