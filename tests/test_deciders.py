"""The decision loop: question frames, deciders, kept answers, packing, rotation, groups and a host."""

from __future__ import annotations

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ontoweave.operators import ask, deciders, ontology
from ontoweave.operators import questions as Q
from ontoweave.operators.decide import Gate
from ontoweave.plans.pipeline import extract

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests

KINDS = (ontology.Kind("PERSON", "A person."), ontology.Kind("FIRM", "A firm."), ontology.Kind("TOWN", "A town."))
LINKS = (ontology.Link("WORKS_AT", "Somebody works there.", ("PERSON",), ("FIRM",)), ontology.Link("BASED_IN", "Where a firm is.", ("FIRM",), ("TOWN",)))
ONTO = ontology.Ontology("t", KINDS, LINKS, {"Northmill": "FIRM"})
TYPES = {"Ada Holm": "PERSON", "Northmill": "FIRM", "Oslo": "TOWN", "Bo Lund": "PERSON"}
NOTE = "# Mill\n\n**Ada Holm** works at Northmill. Northmill is based in **Oslo**. **Bo Lund** never works at Northmill. **Blue** is nice."


def noul(p):
    return {"type": "noul", "noul": p}


def choice(label, options, p=0.9, sure=0.9):
    rest = (1 - p) / max(1, len(options) - 1)
    return {"type": "choice", "choice": label, "confidence": sure, "probabilities": {o: p if o == label else rest for o in options}}


def answer_one(question):
    """What a host would say: names from TYPES, links unless negated."""
    text = question["instructions"]
    if question["type"] == "choice":
        name = next((n for n in TYPES if f"('{n}')" in text), None)
        options = list(question["criteria"])
        return choice(TYPES.get(name, options[0]) if TYPES.get(name) in options else options[0], options)
    if "named entity" in text:
        return noul(0.95 if any(f"mention ('{n}')" in text for n in TYPES) else 0.05)
    return noul(0.05 if "never" in text else 0.95)


class Host:
    """A function that answers requests and remembers them; it lives in the driver, so it answers through a local server."""

    def __init__(self, busy=0, longest=99, wrong=None):
        self.seen, self.busy, self.longest, self.wrong = [], busy, longest, wrong
        host = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                if host.busy:
                    host.busy -= 1
                    return self.reply(503, {"error": "busy"})
                if len(body["questions"]) > host.longest:
                    return self.reply(400, {"error": "too many tokens in context"})
                host.seen.append(body)
                answers = {k: answer_one(q) for k, q in body["questions"].items()}
                if host.wrong:
                    answers = {k: host.wrong(a) for k, a in answers.items()}
                self.reply(200, {"model": body["model"], "answers": answers, "usage": {"input_tokens": 10, "output_tokens": len(answers)}})

            def reply(self, code, body):
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1/systemone"

    def questions(self):
        return [q for b in self.seen for q in b["questions"].values()]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("n1", NOTE)], "document_id string, text string")


def test_a_host_is_asked_once_and_kept_answers_are_banded_anew(spark, docs, tmp_path):
    host = Host(busy=2, longest=2)
    kept = deciders.Kept(spark, deciders.http_decider(host.url, "m1", waits=[0.01, 0.01, 0.01]), str(tmp_path / "answers"))
    x = extract(docs, ONTO, decider=kept, model="m1")
    assert {(r.source, r.target, r.relation_type) for r in x.relationships.collect()} == {("ADA_HOLM", "NORTHMILL", "WORKS_AT"), ("NORTHMILL", "OSLO", "BASED_IN")}
    assert {(r.name, r.entity_type) for r in x.entities.collect()} == {("ADA_HOLM", "PERSON"), ("NORTHMILL", "FIRM"), ("OSLO", "TOWN"), ("BO_LUND", "PERSON")}
    assert all(q["criteria"] for q in host.questions()) and {tuple(q["criteria"]) for q in host.questions()} == {("true", "false"), ("PERSON", "FIRM", "TOWN")}
    assert not any("mention ('Northmill')" in q["instructions"] for q in host.questions())  # listed names are never asked
    first, counts = len(host.questions()), dict(kept.counts)
    assert counts["answered"] == first == counts["questions"] and counts["hits"] == 0 and counts["input_tokens"] == 10 * len(host.seen) and counts["output_tokens"] == first
    # another cut-off: other bands, no question; a clone that shares the table asks nothing either
    strict = extract(docs, ONTO, gate=Gate(noul_yes=0.96), decider=deciders.Kept(spark, deciders.http_decider(host.url, "m1"), str(tmp_path / "answers")), model="m1")
    assert strict.relationships.count() == 0 and len(host.questions()) == first
    # another model is another question
    extract(docs, ONTO, decider=kept, model="m2")
    assert len(host.questions()) == 2 * first


@pytest.mark.parametrize("wrong", [lambda a: {"type": "noul"}, lambda a: {**a, "choice": "OTHER"} if a["type"] == "choice" else a, lambda a: {**a, "noul": 1.5} if a["type"] == "noul" else a])
def test_unusable_answers_raise(spark, docs, wrong):
    host = Host(wrong=wrong)
    with pytest.raises(Exception, match="unusable answer"):
        extract(docs, ONTO, decider=deciders.http_decider(host.url, "m"), model="m").entities.collect()


def test_host_errors(spark):
    post = deciders.http_post(Host(busy=9).url, waits=[0.0, 0.0])
    with pytest.raises(deciders.HostError, match="503"):
        post({"model": "m", "state": "", "questions": {}})
    with pytest.raises(deciders.TooLong):
        deciders.http_post(Host(longest=0).url)({"model": "m", "state": "", "questions": {"q": {"type": "noul", "instructions": "named entity"}}})


def mentions_of(spark, names):
    rows = [("d", "d-s0", n, 10 * i, 10 * i + 5, "encoder", None, [], i) for i, n in enumerate(names)]
    found = spark.createDataFrame(rows, "document_id string, sentence_id string, text string, start_char int, end_char int, source string, skipped_reason string, heading_path array<string>, m_ord int")
    sents = spark.createDataFrame([("d", "d-s0", 0, " and ".join(names), 0, [])], "document_id string, sentence_id string, idx int, text string, start_char int, heading_path array<string>")
    return found, sents


def by_function(answers):
    """A decider from a function of (kind, mention, labels) to an answer."""

    def answer(questions):
        def run(parts):
            import pandas as pd

            for pdf in parts:
                yield pd.DataFrame({"question_key": pdf.question_key, "j": [json.dumps(answers(k, m, list(o))) for k, m, o in zip(pdf.kind, pdf.mention, pdf.labels)]})

        rows = questions.select("question_key", "kind", F.col("about.mention").alias("mention"), F.transform("options", lambda o: o["label"]).alias("labels"))
        return rows.mapInPandas(run, "question_key string, j string").select("question_key", F.from_json("j", Q.ANSWER).alias("answer"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))

    return answer


def test_an_unsure_choice_is_asked_again_and_a_flip_goes_to_review(spark):
    from ontoweave.operators import decide

    def says(kind, mention, labels):
        if kind == "noul":
            return noul(0.9)
        return choice(labels[0], labels, sure=0.2 if mention in ("Flip", "Stay") else 0.9) if mention != "Stay" else choice("FIRM", labels, sure=0.2)

    found, sents = mentions_of(spark, ["Flip", "Stay", "Sure"])
    typed = decide.type_mentions(found, sents, ONTO.gazetteer(spark), ONTO, Gate(rotate_below_confidence=0.5, accept_confidence=0.1), by_function(says), "m")
    got = {r.text: (r.entity_type, r.band, r.flipped) for r in typed.collect()}
    # the first option is another one when the options are reversed
    assert got == {"Flip": ("TOWN", "REVIEW", True), "Stay": ("FIRM", "ACCEPT", False), "Sure": ("PERSON", "ACCEPT", False)}


def test_many_kinds_are_asked_in_two_stages(spark):
    from ontoweave.operators import decide

    many = ontology.Ontology("many", tuple(ontology.Kind(f"K{i:02d}", f"Kind {i}.") for i in range(40)), ())

    def says(kind, mention, labels):
        if kind == "noul":
            return noul(0.9)
        if labels[0].startswith("GROUP_"):
            return choice("GROUP_1", labels)
        return choice("K30" if mention == "Thirty" else "NOT_ENTITY", labels)

    found, sents = mentions_of(spark, ["Thirty", "Nothing"])
    typed = decide.type_mentions(found, sents, many.gazetteer(spark), many, Gate(), by_function(says), "m")
    assert {r.text: (r.entity_type, r.band) for r in typed.collect()} == {"Thirty": ("K30", "ACCEPT"), "Nothing": ("NOT_ENTITY", "ACCEPT")}
    rules = decide.type_mentions(found, sents, many.gazetteer(spark), many, Gate(noul_yes=0.8), deciders.rule_decider(many), "m")
    assert {r.text: r.entity_type for r in rules.collect()} == {"Thirty": "NOT_ENTITY", "Nothing": "K00"}  # a word that opens a sentence proves nothing


def test_rules_as_a_decider_equal_the_lazy_rules(spark, docs):
    onto = ontology.Ontology("t", KINDS, LINKS, dict(TYPES))
    columns = ("source", "target", "relation_type", "weight")
    lazy, asked = extract(docs, onto), extract(docs, onto, decider=deciders.rule_decider(onto))
    rows = lambda x: sorted(tuple(r) for r in x.relationships.select(*columns).collect())
    assert rows(lazy) == rows(asked) and len(rows(lazy)) == 2


def test_listed_and_table_deciders(spark, docs):
    gazetteer = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(TYPES.items())], "name string, type string, ord long")
    x = extract(docs, ONTO, decider=deciders.listed_decider(gazetteer), model="double")
    assert {(r.source, r.relation_type) for r in x.relationships.collect()} == {("ADA_HOLM", "WORKS_AT"), ("NORTHMILL", "BASED_IN")}
    found, sents = mentions_of(spark, ["Ada Holm"])
    rows = found.join(sents.select("document_id", "sentence_id", F.col("text").alias("sentence")), ["document_id", "sentence_id"]).join(ask.states(sents, found), ["document_id", "sentence_id"])
    answers = spark.createDataFrame([("k", ("noul", None, 0.2, None, None, None), 1)], f"question_key string, answer {Q.ANSWER}, created_at int")
    with pytest.raises(Exception, match="no answer"):
        ask.names(rows, deciders.table_decider(answers), "m").collect()
    state = ask.states(sents, found).first().state
    assert state == "Heading: (none)\nSentence: Ada Holm\nMentions:\n  [0] Ada Holm"


def test_questions_options_and_prompts(spark):
    one = spark.range(1)
    options = Q.options_of([("A", "first"), ("B", None)])
    row = one.select(Q.reversed_options(options).alias("r"), Q.prompt(F.lit("choice"), F.lit("S"), F.lit("Which?"), options).alias("p"), Q.score_options(["low", "high"]).alias("s"), Q.noul_options("y", "n").alias("n")).first()
    assert [o.label for o in row.r] == ["B", "A"] and row.p == "S\n\nWhich?\n\nA. A: first\nB. B: B\n\nAnswer with the letter of one option."
    assert [(o.label, o.description) for o in row.s] == [("0", "low"), ("1", "high")] and [o.label for o in row.n] == ["true", "false"]
    key = lambda o: Q.question_key(F.lit("m"), F.lit("S"), F.lit("choice"), F.lit("Which?"), o)
    assert one.select((key(options) == key(Q.reversed_options(options))).alias("x")).first().x is False
    for n in (1, 27):
        with pytest.raises(Exception, match="a choice has 2 to 26 options"):
            one.select(Q.choice_options(Q.options_of([(str(i), "") for i in range(n)]))).collect()
    a = one.select(Q.answer_from_logits(F.lit("choice"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit(0.0), F.lit(2.0))).alias("a")).first().a
    assert a.choice == "B" and abs(sum(a.probabilities.values()) - 1) < 1e-9
    assert one.select(Q.answer_from_logits(F.lit("noul"), F.array(F.lit("true"), F.lit("false")), F.array(F.lit(0.0), F.lit(0.0))).alias("a")).first().a.noul == 0.5
